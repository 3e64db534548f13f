"""Removal of long byte strings that occur more than once in a corpus.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere
else. All suffixes of a corpus cannot be sorted in one place, so equal strings are
brought together first. From every window of ``length`` bytes one anchor is taken,
the least of its ``gram``-byte substrings by hash; equal windows have equal anchors
at equal offsets. An anchor's context is all that windows through it can cover.

* Contexts that occur again as a whole are settled by counting.
* For anchors with different contexts, one copy of each context goes to the
  anchor's task. There a suffix array by Lyndon grouping sorts the contexts to the
  right of the anchor, and one of the reversed contexts sorts those to the left.
  Common prefixes of neighbours then tell for every offset which windows are equal.
* An anchor with more contexts than one task may hold is settled by counting
  hashes of its windows, which needs no place where they all meet.

Rules for odd input: a NULL text is empty. Texts are UTF-8; matches never cross
documents. Rows are told apart by ``doc_id`` and a hash of the text: rows equal in
both are copies of each other, and each is an occurrence. A NULL ``doc_id`` is a
value. Other columns pass through. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amperic.llm.common import map_batches, offsets, spans, staged, utf8, whole_text
from amperic.llm.suffix import suffix_array

_POSITION = 24  # bits of a position inside a block of texts
_PIECE = 50  # bytes named as one symbol before suffix sorting


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hashes of all substrings of ``gram`` bytes, a power of two, by doubling."""
    h = data.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    h ^= h >> np.uint64(29)
    size = 1
    while size < gram:
        h = h[:-size] * np.uint64(0xBF58476D1CE4E5B9) + h[size:] * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        size *= 2
    return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` successive ones, by prefix and suffix minima of blocks."""
    n = len(x) - width + 1
    pad = -len(x) % width
    blocks = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def anchors(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, position and hash of each text's anchors."""
    sizes = np.array([len(t) for t in texts], np.int64)
    at = offsets(sizes)
    data = np.frombuffer(b"".join(texts), np.uint8)
    width = length - gram + 1
    if len(data) < length or len(data) > 1 << _POSITION:
        found = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)] + [
            (np.full(len(p), i), p, h) for i, t in enumerate(texts) if len(t) >= length for p, h in [_long_anchors(t, length, gram)]
        ]
        return tuple(np.concatenate(c) for c in zip(*found))
    h = gram_hashes(data, gram)
    ranked = (h >> np.uint64(_POSITION) << np.uint64(_POSITION)) | np.arange(len(h), dtype=np.uint64)
    least = (sliding_min(ranked, width) & np.uint64((1 << _POSITION) - 1)).astype(np.int64)
    # only windows inside one text
    first = np.zeros(len(data) + 1, np.int64)
    whole = sizes >= length
    np.add.at(first, at[:-1][whole], 1)
    np.add.at(first, at[:-1][whole] + sizes[whole] - length + 1, -1)
    picked = np.unique(least[np.cumsum(first)[: len(least)] > 0])
    owner = np.searchsorted(at, picked, side="right") - 1
    return owner, picked - at[owner], h[picked]


def _long_anchors(text: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for one text of any size, in overlapping stretches."""
    step = (1 << _POSITION) - length
    parts = []
    for a in range(0, max(1, len(text) - length + 1), step):
        _, p, h = anchors([text[a : a + step + length - 1]], length, gram)
        parts.append((p + a, h))
    p, h = (np.concatenate(c) for c in zip(*parts))
    p, keep = np.unique(p, return_index=True)
    return p, h[keep]


def anchor_rows(docs: DataFrame, *, length: int, gram: int) -> DataFrame:
    """A row per document, anchor hash and context hash: ``at`` lists where it is,
    ``left`` and ``right`` are the bytes of context on either side."""
    back = length - gram

    def run(batch: pa.RecordBatch) -> dict:
        texts = utf8(batch)
        ids = batch.column("doc_id").to_pylist()
        out: dict[str, list] = {c: [] for c in ("doc_id", "row", "h", "c", "left", "right", "at")}
        for a, b in spans(texts, 2 << 20):
            block = texts[a:b]
            found: dict[tuple, list[int]] = {}
            for i, p, h in zip(*(x.tolist() for x in anchors(block, length, gram))):
                t = block[i]
                lo, hi = max(0, p - back), min(len(t), p + length)
                key = (i, h, xxhash.xxh3_64_intdigest(t[lo:hi], seed=p - lo), p - lo, hi - p)
                found.setdefault(key, []).append(p)
            rows = {i: xxhash.xxh3_64_intdigest(block[i]) for i in {k[0] for k in found}}
            for (i, h, c, left, right), at in found.items():
                out["doc_id"].append(ids[a + i])
                out["row"].append(rows[i])
                out["h"].append(h)
                out["c"].append(c)
                out["left"].append(left)
                out["right"].append(right)
                out["at"].append(at)
        for c in ("row", "h", "c"):
            out[c] = np.array(out[c], np.uint64).view(np.int64)
        return out

    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    return map_batches(rows, run, "doc_id long, row long, h long, c long, left int, right int, at array<int>")


def sorted_with_prefixes(groups: np.ndarray, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings by group and bytes, from a suffix array, and how many
    bytes each shares with the one before it (-1 at a new group).

    Strings are cut into pieces of fixed size, and pieces are named by their rank,
    so the suffix array is over short sequences and its order that of the bytes.
    """
    pieces = [[s[k : k + _PIECE] for k in range(0, len(s), _PIECE)] for s in strings]
    names = {p: r for r, p in enumerate(sorted({p for ps in pieces for p in ps}))}
    base = len(names) + 2
    ranks = {g: base + r for r, g in enumerate(sorted(set(groups.tolist())))}
    text: list[int] = []
    owner: dict[int, int] = {}
    for i, (g, ps) in enumerate(zip(groups.tolist(), pieces)):
        owner[len(text)] = i
        text.append(ranks[g])
        text += [names[p] + 2 for p in ps]
        text.append(1)
    text.append(0)
    order = np.array([owner[p] for p in suffix_array(text) if p in owner], np.int64)
    width = max(map(len, strings), default=0)
    grid = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(len(strings), width)
    sizes = np.array([len(s) for s in strings], np.int64)
    shared = np.full(len(order), -1, np.int64)
    for a in range(1, len(order), 20_000):
        now, prev = order[a : a + 20_000], order[a - 1 : a - 1 + len(order[a : a + 20_000])]
        differ = grid[now] != grid[prev]
        n = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        n = np.minimum(n, np.minimum(sizes[now], sizes[prev]))
        shared[a : a + 20_000] = np.where(groups[now] == groups[prev], n, -1)
    return order, shared


def equal_windows(groups: np.ndarray, lefts: list[bytes], rights: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Per context, how far windows that another context of its group shares reach
    to the left and right of the anchor; 0 and 0 if there are none.

    ``lefts`` are reversed. Two contexts share the window that starts ``j`` bytes
    before the anchor if they are in one run of neighbours with common prefixes of
    ``j`` on the left and ``length - j`` on the right.
    """
    n = len(groups)
    by_right, right_shared = sorted_with_prefixes(groups, rights)
    by_left, left_shared = sorted_with_prefixes(groups, lefts)
    left_size, right_size = (np.array([len(s) for s in x], np.int64) for x in (lefts, rights))
    reach = []
    for order, shared in ((by_left, left_shared), (by_right, right_shared)):
        most = np.zeros(n, np.int64)
        most[order] = np.maximum(shared, np.concatenate([shared[1:], [-1]]))
        reach.append(most)
    back, ahead = np.zeros(n, np.int64), np.zeros(n, np.int64)
    hopeful = reach[0] + reach[1] >= length
    for j in range(int(left_size.max(initial=0)) + 1):
        able = np.flatnonzero(hopeful & (reach[0] >= j) & (reach[1] >= length - j))
        if not len(able):
            continue
        run_left, run_right = np.empty(n, np.int64), np.empty(n, np.int64)
        run_left[by_left] = np.cumsum(left_shared < j)
        run_right[by_right] = np.cumsum(right_shared < length - j)
        keys = run_left[able] * (n + 1) + run_right[able]
        _, place, times = np.unique(keys, return_inverse=True, return_counts=True)
        twice = able[times[place] > 1]
        back[twice] = np.maximum(back[twice], j)
        ahead[twice] = np.maximum(ahead[twice], length - j)
    return back, ahead


def _contexts(docs: DataFrame, wanted: DataFrame, back: int, length: int) -> DataFrame:
    """``wanted`` (a representative each) with its bytes: ``lefts`` reversed, ``rights``."""
    listed = wanted.groupBy("doc_id", "row").agg(F.collect_list(F.struct("h", "c", "p", "part", "alone")).alias("list"))
    listed = listed.select(F.col("doc_id").alias("_doc"), F.col("row").alias("_row"), "list")
    texts = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    rows = texts.join(listed, F.col("doc_id").eqNullSafe(F.col("_doc")))

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c: [] for c in ("h", "c", "part", "alone", "lefts", "rights")}
        for text, row, items in zip(utf8(batch), batch.column("_row").to_pylist(), batch.column("list").to_pylist()):
            if np.uint64(xxhash.xxh3_64_intdigest(text)).view(np.int64) != row:
                continue
            for x in items:
                p = x["p"]
                for c in ("h", "c", "part", "alone"):
                    out[c].append(x[c])
                out["lefts"].append(text[max(0, p - back) : p][::-1])
                out["rights"].append(text[p : p + length])
        return out

    return map_batches(rows.select("text", "_row", "list"), run, "h long, c long, part int, alone boolean, lefts binary, rights binary")


def _in_tasks(contexts: DataFrame, length: int) -> DataFrame:
    """``h``, ``c``, ``l``, ``r`` by suffix arrays, one part of the contexts at a time."""

    def run(table: pa.Table) -> pa.Table:
        once = {}
        for h, c, a, b in zip(*(table.column(x).to_pylist() for x in ("h", "c", "lefts", "rights"))):
            once[h, c] = (a, b)  # rows equal in id and text give a context twice
        groups = np.array([h for h, _ in once], np.int64)
        back, ahead = equal_windows(groups, [a for a, _ in once.values()], [b for _, b in once.values()], length)
        found = np.flatnonzero(ahead)
        marks = np.array([c for _, c in once], np.int64)
        return pa.table(
            {"h": groups[found], "c": marks[found], "l": pa.array(back[found], pa.int32()), "r": pa.array(ahead[found], pa.int32())}
        )

    return contexts.groupBy("part").applyInArrow(run, "h long, c long, l int, r int")


def _by_counting(contexts: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many contexts, by counting window hashes."""

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c: [] for c in ("h", "c", "j", "w")}
        for h, c, a, b in zip(*(batch.column(x).to_pylist() for x in ("h", "c", "lefts", "rights"))):
            text = a[::-1] + b
            for j in range(max(0, length - len(b)), len(a) + 1):
                out["h"].append(h)
                out["c"].append(c)
                out["j"].append(j)
                out["w"].append(xxhash.xxh3_128_digest(text[len(a) - j : len(a) - j + length]))
        return out

    found = map_batches(contexts.select("h", "c", "lefts", "rights"), run, "h long, c long, j int, w binary").distinct()
    again = found.groupBy("h", "j", "w").agg(F.count("*").alias("k")).filter("k > 1").drop("k")
    ends = found.join(again, ["h", "j", "w"], "left_semi").groupBy("h", "c").agg(F.max("j").alias("l"), F.min("j").alias("least"))
    return ends.select("h", "c", "l", (F.lit(length) - F.col("least")).cast("int").alias("r"))


def repeated_spans(
    docs: DataFrame, *, length: int = 400, gram: int = 128, part_contexts: int = 20_000, task_contexts: int = 60_000
) -> DataFrame:
    """``doc_id``, ``row`` and ``spans``: start and end of stretches to remove, which may overlap.

    A task gets about ``part_contexts`` contexts, or all of one anchor if those are
    no more than ``task_contexts``, which bounds its memory to some hundred megabytes.
    """
    back = length - gram
    found = staged(anchor_rows(docs, length=length, gram=gram))
    first = F.min(F.struct("doc_id", "row", F.get("at", F.lit(0)).alias("p")))
    classes = found.groupBy("h", "c").agg(
        F.sum(F.size("at")).alias("times"), first.alias("first"), F.first("left").alias("left"), F.first("right").alias("right")
    )
    per_anchor = classes.groupBy("h").agg(F.count("*").alias("kinds"), F.sum("times").alias("all")).filter(F.col("all") > 1)
    classes = staged(classes.join(per_anchor.select("h", "kinds"), "h"))
    again = classes.filter((F.col("times") > 1) & (F.col("left") + F.col("right") >= length)).select(
        "h", "c", F.col("left").alias("l"), F.col("right").alias("r")
    )
    several = classes.filter("kinds > 1")
    parts = max(1, -(-several.count() // part_contexts))
    wanted = several.select(
        "h", "c", "first.*", F.pmod(F.xxhash64("h"), F.lit(parts)).cast("int").alias("part"), (F.col("kinds") <= task_contexts).alias("alone")
    )
    contexts = staged(_contexts(docs, wanted, back, length))
    partial = _in_tasks(contexts.filter("alone"), length)
    crowded = contexts.filter(~F.col("alone"))
    if not crowded.isEmpty():
        partial = partial.unionByName(_by_counting(crowded, length))
    reach = again.unionByName(partial).groupBy("h", "c").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    spans = found.join(reach, ["h", "c"]).select(
        "doc_id", "row", F.explode(F.transform("at", lambda p: F.struct((p - F.col("l")).alias("a"), (p + F.col("r")).alias("b")))).alias("s")
    )
    return spans.groupBy("doc_id", "row").agg(F.collect_set("s").alias("spans"))


def _covered(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal stretches of the spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, *, length: int = 400, gram: int = 128, part_contexts: int = 20_000, task_contexts: int = 60_000) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``kept`` (the
    remaining bytes, which need not be valid UTF-8), ``kept_text`` (the same read as
    UTF-8, without the parts of characters that are left at a cut) and ``spans`` (start
    and end of each removed run, in bytes)."""
    spans = repeated_spans(docs, length=length, gram=gram, part_contexts=part_contexts, task_contexts=task_contexts)
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.struct("row", "spans")).alias("rows")).withColumnRenamed("doc_id", "_doc")
    texts = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "kept_text", "spans")}
        for text, rows in zip(utf8(batch), batch.column("rows").to_pylist()):
            mine = None
            if rows:
                own = np.uint64(xxhash.xxh3_64_intdigest(text)).view(np.int64)
                mine = next((r["spans"] for r in rows if r["row"] == own), None)
            gone = _covered(mine)
            edges = [0, *(x for s in gone for x in s), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
            out["n_bytes"].append(len(text))
            out["n_removed"].append(len(text) - len(kept))
            out["n_spans"].append(len(gone))
            out["kept"].append(kept)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept_text"].append(kept.decode("utf-8", "ignore"))
            out["spans"].append([{"start": a, "end": b} for a, b in gone])
        return {"doc_id": batch.column("doc_id"), **out}

    rows = texts.join(spans, F.col("doc_id").eqNullSafe(F.col("_doc")), "left").select("doc_id", "text", "rows")
    spans_type = "array<struct<start: bigint, end: bigint>>"
    return map_batches(
        rows, run, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, kept_text string, spans {spans_type}"
    )
