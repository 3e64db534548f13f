"""Near-duplicate documents by ProbMinHash, banding and verification.

A document is the set of its five-word shingles. Every shingle is a Poisson
process whose rate is its weight; an arrival falls on a random component of the
signature, and the component keeps its first arrival. Arrivals of a shingle are
drawn in order of time, so drawing stops once they are later than all components.
Two signatures agree in a component with the probability Jaccard similarity of the
documents. All weights are 1 however often a text repeats a shingle, so that this
is the Jaccard similarity of the sets, by which links are defined. Documents that
agree in a band of components are candidates, and candidates are verified on their
shingle sets.

Within a bucket not all pairs are formed. The member that shares most buckets is
the hub, which the others are compared with; who is linked needs no more
comparisons inside its group. What stays apart is compared with further hubs, and
the pairs left between different groups are compared one by one, unless the sizes
or the distances to a common hub already rule out a link (the Jaccard distance is
a metric).

Rules for odd input: a NULL text is empty. Texts of less than five words are one
shingle; texts without words have none and are near only to equal texts. Texts are
compared, not ids: equal texts are one class, named by its least ``doc_id``, and rows
that share an id but not the text are in the groups of their texts. A class or group
without any id has the name NULL; ``group_hash`` tells all groups apart. Of texts whose
64-bit hashes agree by chance one is compared and the others stay alone. Other columns
are ignored. An empty table gives an empty table. Shingles are compared by 32-bit
hashes, which can move a similarity by some ten-thousandths.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from amperic.llm.common import WORKED, map_batches, mix, offsets, spans, staged, utf8, whole_text, windows
from amperic.operators.components import components

WORDS = 5
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(text: bytes, width: int = WORDS) -> np.ndarray:
    """Distinct shingle fingerprints of a text."""
    words = text.split()
    marks = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if not len(marks):
        return marks
    return np.unique(windows(marks, min(width, len(marks))))


def _uniform(seed: np.ndarray) -> np.ndarray:
    return ((mix(seed) >> np.uint64(11)).astype(np.float64) + 1) / (1 << 53)


def prob_min_hash(owner: np.ndarray, keys: np.ndarray, weights: np.ndarray, n: int, size: int) -> np.ndarray:
    """Signatures of ``n`` documents: the shingle (32 bits) that came first per component.

    ``owner`` says which document an element belongs to. A round draws the next
    arrival of every element that can still be first somewhere.
    """
    # time in the upper half, so the least number is the first arrival
    first = np.full(n * size, _NEVER)
    at = np.zeros(len(keys))
    alive = np.arange(len(keys))
    step = np.uint64(0)
    while len(alive):
        step += np.uint64(1)
        seed = keys[alive] + np.array([step]) * _GOLDEN
        at[alive] -= np.log(_uniform(seed)) / weights[alive]
        time = at[alive].astype(np.float32).view(np.uint32).astype(np.uint64)
        slot = (mix(seed ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(size)).astype(np.int64)
        # an arrival later than all components cannot be first, nor can those after it
        mine = owner[alive]
        touched = np.unique(mine)
        latest = np.zeros(n, np.uint64)
        latest[touched] = first.reshape(n, size)[touched].max(axis=1) >> np.uint64(32)
        early = time <= latest[mine]
        alive, slot, time = alive[early], slot[early], time[early]
        np.minimum.at(first, owner[alive] * size + slot, (time << np.uint64(32)) | (keys[alive] & np.uint64(0xFFFFFFFF)))
    return (first & np.uint64(0xFFFFFFFF)).reshape(n, size)


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One fingerprint per band of ``rows`` components, different in every band."""
    n, size = signatures.shape
    out = np.zeros((n, size // rows), np.uint64) + np.arange(size // rows, dtype=np.uint64) * _GOLDEN
    for r in range(rows):
        out = mix(out + signatures[:, r::rows][:, : size // rows] + _GOLDEN)
    return out


def signatures(docs: DataFrame, *, bands: int = 26, rows: int = 5) -> DataFrame:
    """``doc_id``, a 128-bit hash of the text, the number of distinct shingles and the band keys."""

    def run(batch: pa.RecordBatch) -> dict:
        texts = utf8(batch)
        digests = [xxhash.xxh3_128_intdigest(t) for t in texts]
        counts, found = [], [np.zeros(0, np.int64)]
        # a block takes as many rounds as its slowest text, so blocks are not too small
        for a, b in spans(texts, 4 * WORKED):
            parts = [shingles(t) for t in texts[a:b]]
            sizes = np.array([len(k) for k in parts], np.int64)
            keys = np.concatenate(parts)
            # links are verified on sets, so repeats must not weigh
            firsts = prob_min_hash(np.repeat(np.arange(b - a), sizes), keys, np.ones(len(keys)), b - a, bands * rows)
            found.append(band_keys(firsts, rows).view(np.int64)[sizes > 0].ravel())
            counts += sizes.tolist()
        flat = np.concatenate(found)
        ends = offsets([bands if c else 0 for c in counts]).astype(np.int32)
        return {
            "doc_id": batch.column("doc_id"),
            "text_hash": batch.column("text_hash"),
            "t1": np.array([d & 0xFFFFFFFFFFFFFFFF for d in digests], np.uint64).view(np.int64),
            "t2": np.array([d >> 64 for d in digests], np.uint64).view(np.int64),
            "n": counts,
            "bands": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64())),
        }

    rows_in = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    return map_batches(rows_in, run, "doc_id long, text_hash long, t1 long, t2 long, n int, bands array<long>")


def _sets(docs: DataFrame, needed: DataFrame, small: int) -> DataFrame:
    """Shingle sets of the texts in ``needed`` (``node``, the text's hash, ``t1`` and
    ``first``, a row that has it). That list is broadcast where its whole size is below
    ``small`` bytes."""
    wanted = needed.select(F.col("node").alias("_node"), "first")
    few = needed.count() * 24 <= small

    def run(batch: pa.RecordBatch) -> dict:
        texts = utf8(batch)
        marks = np.array([xxhash.xxh3_128_intdigest(t) & 0xFFFFFFFFFFFFFFFF for t in texts], np.uint64)
        found = [np.unique(shingles(t).astype(np.uint32)).view(np.int32) for t in texts]
        return {"node": batch.column("node"), "items": found, "t1": marks.view(np.int64)}

    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), whole_text().alias("text")).withColumn("node", F.xxhash64("text"))
    same = (F.col("node") == F.col("_node")) & F.col("doc").eqNullSafe(F.col("first"))
    texts = texts.join(F.broadcast(wanted) if few else wanted, same, "left_semi")
    sets = map_batches(texts.select("node", "text"), run, "node long, items array<int>, t1 long")
    # rows equal in id and text give a set twice
    return sets.join(needed.select("node", "t1"), ["node", "t1"], "left_semi").dropDuplicates(["node"]).select("node", "items")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a``, ``b`` and their Jaccard similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    rows = pairs.join(left, "a").join(right, "b")
    both = F.size(F.array_intersect("x", "y"))
    return rows.select("a", "b", (both / (F.size("x") + F.size("y") - both)).alias("similarity"))


def _pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """Ordered distinct pairs of columns ``node``, ``n`` and ``other``, ``m`` whose sizes allow a link."""
    fits = F.least("n", "m") >= threshold * F.greatest("n", "m")
    return rows.filter(fits & (F.col("node") != F.col("other"))).select(
        F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")
    ).distinct()


def links(
    docs: DataFrame, nodes: DataFrame, *, threshold: float = 0.8, hub_rounds: int = 2, small: int = 64 << 20
) -> DataFrame:
    """Verified links (``a``, ``b``, ``similarity``) that connect all documents
    which any chain of links over shared buckets connects.

    A pair of one group is left out once the group is known; no link between
    different groups is.

    ``nodes`` has ``node``, ``t1``, ``first``, ``n`` and ``bands``.
    """
    keys = nodes.select("node", "n", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    keys = staged(keys.join(shared, "key"))
    weight = keys.groupBy("node").agg(F.sum("c").alias("popularity"))
    rows = staged(keys.join(weight, "node").select("key", "node", "n", "popularity"))
    sets = staged(_sets(docs, weight.select("node").join(nodes.select("node", "t1", "first"), "node"), small))
    known = nodes.sparkSession.createDataFrame([], "a long, b long, similarity double")

    def linked() -> DataFrame:
        return known.filter(F.col("similarity") >= threshold)

    open_rows = rows.withColumn("root", F.col("node"))
    used = None
    for _ in range(hub_rounds):
        choice = open_rows if used is None else open_rows.join(used, ["key", "node"], "left_anti")
        best = F.struct("popularity", (-F.col("node")).alias("order"))
        hubs = choice.groupBy("key").agg(F.max_by(F.struct("node", "n", "root"), best).alias("hub"))
        hubs = staged(hubs.select("key", F.col("hub.node").alias("other"), F.col("hub.n").alias("m"), F.col("hub.root").alias("top")))
        pairs = _pairs(open_rows.join(hubs, "key").filter("root <> top"), threshold).join(known, ["a", "b"], "left_anti")
        known = staged(known.unionByName(_verified(pairs, sets)))
        mine = hubs.select("key", F.col("other").alias("node"))
        used = mine if used is None else used.unionByName(mine)
        open_rows = staged(_still_open(rows, linked()))
        if open_rows.isEmpty():
            return linked()
    rest = _by_rare_shingles(open_rows, sets, threshold).join(known.select("a", "b"), ["a", "b"], "left_anti")
    return linked().unionByName(_verified(staged(rest), sets).filter(F.col("similarity") >= threshold))


def _by_rare_shingles(rows: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs of different groups that may still be linked, without forming all pairs.

    Two sets of similarity ``t`` share one of the rarest ``n - ceil(t * n) + 1``
    elements of either, in any common order. The order is by how many of the open
    documents have an element, so what thousands share is only met by documents
    that have little else.
    """
    nodes = rows.select("node", "root").distinct()
    items = staged(sets.join(nodes, "node").select("node", "root", F.size("items").alias("n"), F.explode("items").alias("item")))
    held = items.groupBy("item").agg(F.count("*").alias("holders"))
    order = W.partitionBy("node").orderBy("holders", "item")
    rare = items.join(held, "item").withColumn("_rank", F.row_number().over(order))
    rare = staged(rare.filter((F.col("_rank") <= F.col("n") - F.ceil(threshold * F.col("n") - 1e-9) + 1) & (F.col("holders") > 1)))
    mixed = rare.groupBy("item").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("item")
    a = rare.join(mixed, "item").select("item", "node", "n", "root", F.col("_rank").alias("p"))
    b = a.select("item", F.col("node").alias("other"), F.col("n").alias("m"), F.col("root").alias("top"), F.col("p").alias("q"))
    # where the first common element stands bounds how many can follow it
    most = 1 + F.least(F.col("n") - F.col("p"), F.col("m") - F.col("q"))
    enough = most * (1 + threshold) >= threshold * (F.col("n") + F.col("m")) - 1e-6
    fits = (F.col("node") < F.col("other")) & (F.col("root") != F.col("top")) & enough
    return _pairs(a.join(b, "item").filter(fits), threshold)


def _still_open(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Bucket rows with their group, in buckets that hold more than one group."""
    roots = components(edges.select("a", "b"))
    rows = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
    return rows.join(mixed.select("key"), "key", "left_semi")


def near_duplicates(
    docs: DataFrame, *, threshold: float = 0.8, bands: int = 26, rows: int = 5, hub_rounds: int = 2, small: int = 64 << 20
) -> DataFrame:
    """``doc_id``, ``class_id`` (least id with the same text), ``group_id`` (least id
    of the connected near-duplicates), ``n_shingles``, ``text_hash``, which tells rows of
    one id apart, and ``group_hash``, which does so for groups."""
    marks = staged(signatures(docs, bands=bands, rows=rows))
    classes = marks.groupBy("t1", "t2").agg(
        F.min("doc_id").alias("class_id"), F.first("text_hash").alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands")
    )
    classes = staged(classes)
    nodes = classes.groupBy("node").agg(F.min(F.struct("t1", "t2", F.col("class_id").alias("first"), "n", "bands")).alias("r"))
    nodes = staged(nodes.select("node", "r.*"))
    groups = components(links(docs, nodes, threshold=threshold, hub_rounds=hub_rounds, small=small).select("a", "b"))
    alone = nodes.select("t1", "t2", F.lit(True).alias("compared"))
    named = classes.select("t1", "t2", "node", "class_id").join(alone, ["t1", "t2"], "left").join(groups, "node", "left")
    own = F.when(F.col("compared"), F.coalesce("root", "node")).otherwise(F.col("t1"))
    named = staged(named.select("t1", "t2", "class_id", own.alias("group_hash"), F.col("root").isNotNull().alias("linked")))
    # only groups of several texts need their least id looked up
    least = named.filter("linked").groupBy("group_hash").agg(F.min("class_id").alias("least"))
    named = named.join(least, "group_hash", "left")
    named = named.select("t1", "t2", "class_id", F.when(F.col("linked"), F.col("least")).otherwise(F.col("class_id")).alias("group_id"), "group_hash")
    return marks.join(named, ["t1", "t2"]).select(
        "doc_id", "class_id", "group_id", F.col("n").cast("long").alias("n_shingles"), "text_hash", "group_hash"
    )
