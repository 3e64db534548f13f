"""Importance resampling towards a target distribution over hashed word runs.

Runs of one to three words fall into buckets by their CRC. A bucket's gain says how
much more often the target texts hit it than the raw ones do; a document's weight is
the sum of its gains. Adding Gumbel noise that follows from the document's id to the
weights and taking the highest scores draws documents without replacement, in
proportion to their weights, in one pass and alike on every run.

Counts go over all documents, summed per task before they are shuffled: a task sends
one row per bucket, and the gains, one number per bucket, are the only thing that
passes through the driver. Ranks come from even slices of the order, so nothing is
sorted in one place.

Rules for odd input: a NULL text has no words, weight 0, and is never drawn, as any
document with fewer than ``least_words`` words. A NULL ``doc_id`` is noise of an empty
id and comes last among ties. Repeated rows are documents of their own; rows equal in
score and id are ranked by a hash of the text. Without target texts all target counts
are 0. Other columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amperic.llm.common import map_batches, staged, utf8, whole_text
from amperic.llm.prefix_crc import ngram_crcs
from amperic.operators.ordered import even_slices, running


def bucket_counts(docs: DataFrame, *, buckets: int = 10_000, width: int = 3) -> DataFrame:
    """``bucket``, ``n``: how many word runs of all texts fall into it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, crc in ngram_crcs(utf8(batch), width):
                total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(total[hit], pa.int64())], ["bucket", "n"])

    counts = docs.select(whole_text().alias("text")).mapInArrow(run, "bucket int, n long")
    return counts.groupBy("bucket").agg(F.sum("n").alias("n"))


def _collected(counts: DataFrame, buckets: int) -> np.ndarray:
    """Counts by bucket; the table holds a row per bucket at most."""
    out = np.zeros(buckets, np.int64)
    for bucket, n in counts.collect():
        out[bucket] = n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed frequencies, rounded down."""
    k = len(raw)
    all_raw, all_target = int(raw.sum()), int(target.sum())
    parts = ((t + 1) * (all_raw + k) / ((s + 1) * (all_target + k)) for s, t in zip(raw.tolist(), target.tolist()))
    return np.array([math.floor(1000 * math.log(p)) for p in parts], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Thousandths of Gumbel noise, rounded down, from the document's id alone."""
    name = f"{seed}:{'' if doc_id is None else doc_id}".encode()
    h = int(hashlib.sha256(name).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, *, seed: int = 42, width: int = 3) -> DataFrame:
    """``doc_id``, ``row`` (a hash of the text), ``n_words``, ``n_features``, ``weight``, ``score``."""

    def run(batch: pa.RecordBatch) -> dict:
        texts = utf8(batch)
        words, features, weight = (np.zeros(len(texts), np.int64) for _ in range(3))
        for owner, k, crc in ngram_crcs(texts, width):
            if not len(owner):
                continue
            found = np.bincount(owner, minlength=len(texts))
            features += found
            if k[0] == 1:
                words += found
            sums = np.bincount(owner, weights=gain[crc % np.uint32(len(gain))], minlength=len(texts))
            weight += sums.astype(np.int64)
        ids = batch.column("doc_id")
        drawn = np.array([noise(i, seed) for i in ids.to_pylist()], np.int64)
        return {"doc_id": ids, "row": batch.column("row"), "n_words": words, "n_features": features, "weight": weight, "score": weight + drawn}

    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).withColumn("row", F.xxhash64("text"))
    return map_batches(rows, run, "doc_id long, row long, n_words long, n_features long, weight long, score long")


def resample(
    docs: DataFrame, target: DataFrame, *, percent: int = 5, least_words: int = 20, buckets: int = 10_000, width: int = 3, seed: int = 42
) -> DataFrame:
    """``doc_id``, ``n_features``, ``weight``, ``score``, ``rank`` (NULL if not drawn) and ``n_words``.

    Of the documents with ``least_words`` words or more, ``percent`` in a hundred
    (rounded down) are drawn, highest scores first, ties to the smaller id.
    """
    raw = _collected(bucket_counts(docs, buckets=buckets, width=width), buckets)
    aim = _collected(bucket_counts(target, buckets=buckets, width=width), buckets)
    rows = staged(scored(docs, gains(raw, aim), seed=seed, width=width))
    able = rows.filter(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    order = {"_down": -F.col("score"), "_last": F.col("doc_id").isNull(), "_one": F.lit(1).cast("long")}
    by = ["_down", "_last", "doc_id", "row"]
    sliced = staged(even_slices(able.withColumns(order), [], by))
    ranked = running(sliced, by, "_one", "sum", "_rank")
    out = ["doc_id", "n_features", "weight", "score"]
    ranked = ranked.select(*out, F.when(F.col("_rank") <= drawn, F.col("_rank")).alias("rank"), "n_words")
    short = rows.filter(F.col("n_words") < least_words)
    return ranked.unionByName(short.select(*out, F.lit(None).cast("long").alias("rank"), "n_words"))
