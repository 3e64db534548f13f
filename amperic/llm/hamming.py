"""Exact nearest binary codes by incremental multi-index hashing.

A code is cut into disjoint parts. If two codes differ in at most ``d`` bits, some
part differs in at most ``floor(d / parts)`` bits. So after looking up all part
values within radius ``r`` of a query's parts, every code at distance below
``parts * (r + 1)`` has been seen. The radius grows until the ``k``-th verified
distance is below that bound, which proves the result.

Codes are searched in blocks of bounded size, each with its own tables, and the
queries in blocks too; each block of codes proves its own ``k`` nearest, and the
least of those are the result. Equal codes are one entry with its ``k + 1`` least
ids, which is all that a result of ``k`` can need, so a vector that fills a third
of the table does not fill a bucket.

Rules for odd input: a NULL embedding, id or element has no code and is neither
searched nor found; embeddings need not be normalised, but must have as many
elements as ``bits``. Equal distances go to the smaller id. A row is not its own
neighbour; a repeated id counts once, with its least code. Other columns are ignored. An
empty table gives an empty table.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from amperic.llm.common import staged


def sign_code(embedding: Column, bits: int = 64) -> Column:
    """The signs of ``bits`` numbers as one 64-bit code, first number lowest bit;
    a positive number is a one. NULL where the embedding has another length or a
    NULL in it."""
    if bits > 64:
        raise ValueError("a code has at most 64 bits")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    flags = F.transform(embedding, lambda x, i: F.when(x > 0, F.call_function("shiftleft", one, i)).otherwise(none))
    code = F.aggregate(flags, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    whole = (F.size(embedding) == bits) & ~F.exists(embedding, lambda x: x.isNull())
    return F.when(whole, code)


def _masks(width: int, radius: int) -> np.ndarray:
    """All numbers of ``width`` bits with exactly ``radius`` ones."""
    return np.array([sum(1 << b for b in bits) for bits in itertools.combinations(range(width), radius)], np.uint64)


class MultiIndex:
    """Tables over the parts of a block of distinct codes."""

    def __init__(self, codes: np.ndarray, bits: int, parts: int):
        self.codes = codes
        cuts = [bits * i // parts for i in range(parts + 1)]
        self.shifts = cuts[:-1]
        self.widths = [b - a for a, b in zip(cuts, cuts[1:])]
        self.tables = []
        for p in range(parts):
            values = self.part(codes, p)
            order = np.argsort(values, kind="stable")
            self.tables.append((order, values[order]))

    def part(self, codes: np.ndarray, p: int) -> np.ndarray:
        return (codes >> np.uint64(self.shifts[p])) & np.uint64((1 << self.widths[p]) - 1)

    def probe(self, query: np.uint64, radius: int) -> np.ndarray:
        """Entries that have a part at exactly this distance from the query's."""
        found = []
        for p, (order, values) in enumerate(self.tables):
            if radius > self.widths[p]:
                continue
            wanted = self.part(np.array([query]), p)[0] ^ _masks_of(self.widths[p], radius)
            lo, hi = np.searchsorted(values, wanted), np.searchsorted(values, wanted, side="right")
            n = hi - lo
            hit = n > 0
            at = np.repeat(lo[hit], n[hit]) + _within(n[hit])
            found.append(order[at])
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def search(self, query: np.uint64, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Entries and distances that hold the ``k`` nearest ids for certain;
        ``weight`` is how many ids an entry has."""
        seen = np.zeros(0, np.int64)
        dist = np.zeros(0, np.int64)
        parts = len(self.tables)
        for radius in range(max(self.widths) + 1):
            new = np.setdiff1d(self.probe(query, radius), seen, assume_unique=True)
            seen = np.concatenate([seen, new])
            dist = np.concatenate([dist, np.bitwise_count(self.codes[new] ^ query).astype(np.int64)])
            proven = dist < parts * (radius + 1)
            if weight[seen[proven]].sum() >= k:
                break
        order = np.argsort(dist, kind="stable")
        seen, dist = seen[order], dist[order]
        enough = np.searchsorted(np.cumsum(weight[seen]), k)
        last = dist[min(enough, len(dist) - 1)] if len(dist) else 0
        return seen[dist <= last], dist[dist <= last]


_CACHE: dict[tuple[int, int], np.ndarray] = {}


def _masks_of(width: int, radius: int) -> np.ndarray:
    if (width, radius) not in _CACHE:
        _CACHE[width, radius] = _masks(width, radius)
    return _CACHE[width, radius]


def _within(n: np.ndarray) -> np.ndarray:
    """0, 1, ... n[0] - 1, 0, 1, ... n[1] - 1, and so on."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


LEAST_ASKED = 64  # queries that are worth an index of their own


def distinct_codes(rows: DataFrame, k: int, *, slots: int = 64) -> DataFrame:
    """``code`` and ``ids``: the ``k + 1`` least ids of each code. Ids are ranked
    within ``slots`` of a code first, so that a frequent code is not one task's work."""
    ranked = rows.withColumn("_slot", F.pmod(F.xxhash64("id"), F.lit(slots)))
    for keys in (("code", "_slot"), ("code",)):
        order = W.partitionBy(*keys).orderBy("id")
        ranked = ranked.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k + 1)
    return ranked.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def hamming_top_k(
    rows: DataFrame,
    queries: DataFrame,
    *,
    k: int = 10,
    bits: int = 64,
    parts: int = 4,
    code_block: int = 200_000,
    query_block: int = 2_000,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``neighbour_id``, ``distance``: the ``k``
    nearest rows of each query.

    ``rows`` and ``queries`` hold ``id`` and ``code``. A block of about
    ``code_block`` distinct codes meets each block of up to ``query_block``
    queries once, as two inputs of one task. Where that makes fewer tasks than a shuffle
    has, queries are cut finer, down to ``LEAST_ASKED`` a task.
    """
    once = [t.filter("id is not null and code is not null").groupBy("id").agg(F.min("code").alias("code")) for t in (rows, queries)]
    classes, asked = staged(distinct_codes(once[0], k)), staged(once[1])
    n_codes, n_asked = classes.count(), asked.count()
    n_blocks = max(1, -(-n_codes // code_block))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_groups = max(1, -(-n_asked // query_block), min(-(-tasks // n_blocks), -(-n_asked // LEAST_ASKED)))
    block = F.pmod(F.xxhash64("code"), F.lit(n_blocks))
    group = F.pmod(F.xxhash64("id", F.lit("query")), F.lit(n_groups))
    left = classes.withColumn("block", block).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    right = asked.withColumn("group", group).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    kinds = {"block": "long", "group": "long"}
    left = left.select(*[F.col(c).cast(t) for c, t in kinds.items()], "code", "ids")
    right = right.select(*[F.col(c).cast(t) for c, t in kinds.items()], "id", "code")

    def search(codes: pa.Table, ask: pa.Table) -> pa.Table:
        found: dict[str, list] = {"query_id": [], "neighbour_id": [], "distance": []}
        if codes.num_rows and ask.num_rows:
            values = codes.column("code").to_numpy().view(np.uint64)
            ids = codes.column("ids").to_pylist()
            weight = np.array([len(i) for i in ids])
            index = MultiIndex(values, bits, parts)
            for q, code in zip(ask.column("id").to_pylist(), ask.column("code").to_numpy().view(np.uint64)):
                at, dist = index.search(code, weight, k + 1)
                near = sorted((d, i) for e, d in zip(at.tolist(), dist.tolist()) for i in ids[e] if i != q)[:k]
                found["query_id"] += [q] * len(near)
                found["neighbour_id"] += [i for _, i in near]
                found["distance"] += [d for d, _ in near]
        return pa.table(found, schema=pa.schema([(n, pa.int64()) for n in found]))

    best = (
        left.groupBy("block", "group").cogroup(right.groupBy("block", "group"))
        .applyInArrow(search, "query_id long, neighbour_id long, distance long")
    )
    order = W.partitionBy("query_id").orderBy("distance", "neighbour_id")
    best = best.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "neighbour_id", "distance")


def embedding_codes(embeddings: DataFrame, *, bits: int = 64) -> DataFrame:
    """``id`` and ``code`` of a table of ``vec_id`` and ``embedding``."""
    return embeddings.select(F.col("vec_id").cast("long").alias("id"), sign_code(F.col("embedding"), bits).alias("code"))


