"""Product codes of vectors: each part of a vector becomes the index of its nearest
codebook entry.

Vectors become integers and are held in blocks of some thousand rows. For every part of
a block a metric tree is built once (see ``balls``) and staged beside the numbers, so the
rounds of fitting and the last assignment all walk the same trees. A round sends one row
per entry and dimension from each task; the codebooks are the only thing that passes
through the driver, and their size is fixed by the parameters.

Rules for odd input: rows whose vector is NULL or holds a NULL or non-finite component
are dropped, and so are rows whose vector is not as long as that of the least id. A
length that the parts do not divide raises ValueError. Components beyond 2**19 in size
count as 2**19, so that squares and their sums stay whole numbers of 64 bits. A NULL id comes
after all others; rows with equal ids are rows of their own, and the one with the lesser
vector is first. Fewer rows than entries give as many entries as rows. NULL labels are
one label. Other columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amperic.llm.balls import assign, build_tree, node_type
from amperic.llm.common import map_batches, staged

_MOST = 1 << 27  # size of a scaled component
SLOTS = 16  # copies of a label's sum, so that no task reads all rows of a label


def whole_vectors(rows: DataFrame, *, scale: int = 256, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id``, ``label`` and ``v``, the components times ``scale`` rounded down; unusable rows are left out."""
    able = F.col(vector).isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    whole = F.transform(
        vector,
        lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(float(-_MOST))), F.lit(float(_MOST)))).cast("int"),
    )
    return rows.filter(F.coalesce(able, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label).alias("label"), whole.alias("v"))


def _blocks(vectors: DataFrame, width: int, parts: int) -> DataFrame:
    """A row per batch of vectors: ids, labels, the numbers, and the tree of each part."""
    labels = vectors.schema["label"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        points = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)
        trees = [build_tree(part) for part in np.split(points, parts, axis=1)] if len(points) else []
        one = [0, len(points)] if trees else [0]
        lists = lambda c: pa.ListArray.from_arrays(pa.array(one, pa.int32()), batch.column(c))
        return {
            "ids": lists("vec_id"),
            "labels": lists("label"),
            "points": [points.astype("<i4").tobytes()] if trees else [],
            "orders": [[o.tobytes() for o, _ in trees]] if trees else [],
            "nodes": [[n.tobytes() for _, n in trees]] if trees else [],
        }

    schema = f"ids array<bigint>, labels array<{labels}>, points binary, orders array<binary>, nodes array<binary>"
    return map_batches(vectors, run, schema)


def _trees(batch: pa.RecordBatch, width: int, parts: int) -> Iterator[tuple[int, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]]:
    """Row, points, and (points, order, nodes) by part of each block."""
    kind = node_type(width // parts)
    for i in range(batch.num_rows):
        points = np.frombuffer(batch.column("points")[i].as_py(), "<i4").astype(np.int64).reshape(-1, width)
        orders, nodes = batch.column("orders")[i].as_py(), batch.column("nodes")[i].as_py()
        split = np.split(points, parts, axis=1)
        yield i, points, [(p, np.frombuffer(o, "<i4"), np.frombuffer(n, kind)) for p, o, n in zip(split, orders, nodes)]


def _next_codebooks(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """Entries as the floored means of the parts that are nearest to them."""
    parts, k, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, k, width + 1), np.int64)
        for batch in batches:
            for _, _, trees in _trees(batch, parts * width, parts):
                for p, (points, order, nodes) in enumerate(trees):
                    _, counts, sums = assign(points, order, nodes, books[p])
                    total[p, :, :width] += sums
                    total[p, :, width] += counts
        p, e, d = (x.ravel().astype(np.int32) for x in np.indices(total.shape))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (p, e, d, total.ravel())], ["p", "e", "d", "n"])

    found = blocks.select("points", "orders", "nodes").mapInArrow(run, "p int, e int, d int, n long")
    total = np.zeros((parts, k, width + 1), np.int64)
    for p, e, d, n in found.groupBy("p", "e", "d").agg(F.sum("n").alias("n")).collect():  # parts x entries x (width + 1) rows
        total[p, e, d] = n
    sums, counts = total[:, :, :width], total[:, :, width:]
    return np.where(counts > 0, sums // np.maximum(counts, 1), books)


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def product_codes(
    rows: DataFrame, *, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """``vec_id``, ``label``, ``code`` (two hex digits a part), ``error`` (squared distance
    from the code's entries), ``label_error`` and ``codebooks_sha256``.

    At most 256 entries. Codebooks start as the parts of the vectors with the least ids.
    """
    vectors = whole_vectors(rows, scale=scale, id_col=id_col, vector=vector, label=label)
    kind = vectors.schema["label"].dataType.simpleString()
    least = lambda df: [r["v"] for r in df.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()]
    seeds = least(vectors)
    width = len(seeds[0]) if seeds else parts
    if width % parts or not width:
        raise ValueError(f"{parts} parts do not divide vectors of length {width}")
    vectors = vectors.filter(F.size("v") == width)
    if any(len(s) != width for s in seeds):
        seeds = least(vectors)
    blocks = staged(_blocks(vectors, width, parts))
    books = np.array(seeds, np.int64).reshape(len(seeds), parts, width // parts).transpose(1, 0, 2)
    for _ in range(rounds if seeds else 0):
        books = _next_codebooks(blocks, books)
    names = np.array([f"{e:02x}" for e in range(256)])

    def run(batch: pa.RecordBatch) -> dict:
        code, error = [], []
        for _, points, trees in _trees(batch, width, parts):
            found = np.stack([assign(p, o, n, books[i])[0] for i, (p, o, n) in enumerate(trees)])
            nearest = np.concatenate([books[i][found[i]] for i in range(parts)], axis=1)
            error.append(((points - nearest) ** 2).sum(axis=1))
            code += ["".join(c) for c in names[found.T].tolist()]
        return {
            "vec_id": batch.column("ids").flatten(),
            "label": batch.column("labels").flatten(),
            "code": code,
            "error": np.concatenate(error) if error else np.zeros(0, np.int64),
        }

    coded = staged(map_batches(blocks, run, f"vec_id long, label {kind}, code string, error long"))
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    sums = sums.select(F.col("label").alias("_label"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))).alias("_slot"))
    slotted = coded.withColumn("_at", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SLOTS)).cast("int"))
    told = slotted.join(sums, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_at") == F.col("_slot")))
    return told.select("vec_id", "label", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
