"""Line de-duplication over a corpus, in DataFrame operations only.

Line keys are hashed, range-partitioned and sorted by document and position, so
that the first occurrence of a key is met first. What comes back per document is
which lines to keep, as a run-length compressed bitmap; text is joined in last.

Rules for odd input: a NULL or empty text is one empty line. A document is a
value of ``doc_id``; rows that share it count once, and NULL is one document that
is smaller than all others. Rows with the same ``doc_id`` and text get the same
answer. Other columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from amperic.llm.common import BLANKS, fresh, staged, whole_text

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), _UPPER, _LOWER)


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_rows(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """A row per line that is long enough: 128 bits of its key's hash, document, position.

    ``row`` is a hash of the text and tells rows of one ``doc_id`` apart.
    """
    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).select(
        "doc_id", F.xxhash64("text").alias("row"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line")
    )
    key = line_key(F.col("line"))
    return rows.filter(F.length(key) >= min_chars).select(
        F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2"), "doc_id", "row", "pos"
    )


def repeated_keys(rows: DataFrame, *, min_docs: int = 3, slots: int = 16) -> DataFrame:
    """Keys found in ``min_docs`` documents or more, with the document that keeps them.

    A key is spread over ``slots`` by document. Each slot is a sorted stream, of
    which the first row per document counts and the very first is the slot's
    keeper. Slots are then added up, which a partial aggregation does before the
    second shuffle, so no task sees all rows of a frequent line.
    """
    spread = rows.select(*KEY, "doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(slots)).cast("int").alias("slot"), "pos")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stream = W.partitionBy(*KEY, "slot").orderBy(F.desc("doc_id"), "pos")
    firsts = (
        spread.repartitionByRange(parts, *KEY, "slot")
        .withColumn("before", F.lag(F.struct("doc_id")).over(stream))
        .filter(F.col("before").isNull() | ~F.col("before.doc_id").eqNullSafe(F.col("doc_id")))
    )
    found = firsts.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
    return found.filter(F.col("n_docs") >= min_docs)


def keep_bitmaps(docs: DataFrame, *, min_chars: int = 20, min_docs: int = 3, slots: int = 16) -> DataFrame:
    """``doc_id``, ``row``, ``dropped``: sorted positions of the lines to drop, for
    documents that lose any; see :func:`keep_runs` for the bitmap."""
    rows = staged(line_rows(docs, min_chars))
    # a frequent line stays spread by document when it meets its keeper
    keys = repeated_keys(rows, min_docs=min_docs, slots=slots).select(*KEY, "keeper", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    spread = rows.withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(slots)).cast("int"))
    lost = spread.join(keys, [*KEY, "slot"]).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return lost.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))


def keep_runs(dropped: Column, n_lines: Column) -> Column:
    """The keep bitmap as runs of ones: structs of first line and number of lines."""
    size = F.size(dropped)

    def run(i: Column) -> Column:
        first = F.when(i == 0, F.lit(0)).otherwise(F.get(dropped, i - 1) + 1)
        after = F.when(i == size, n_lines).otherwise(F.get(dropped, i))
        return F.struct(first.cast("int").alias("first"), (after - first).cast("int").alias("n"))

    return F.filter(F.transform(F.sequence(F.lit(0), size), run), lambda r: r["n"] > 0)


def kept_text(lines: Column, runs: Column) -> Column:
    """The lines of the runs, joined."""
    parts = F.transform(runs, lambda r: F.array_join(F.slice(lines, r["first"] + 1, r["n"]), "\n"))
    return F.array_join(parts, "\n")


def line_dedup(docs: DataFrame, *, min_chars: int = 20, min_docs: int = 3, slots: int = 16) -> DataFrame:
    """All columns of ``docs``, and ``n_lines``, ``n_dropped``, ``keep`` (the
    compressed bitmap) and ``kept`` (the remaining text).

    Lines whose key has at least ``min_chars`` characters and is in at least
    ``min_docs`` documents stay in the largest ``doc_id`` only.
    """
    doc, row, tag, dropped = fresh(docs, "doc", "row", "tag", "dropped")
    found = keep_bitmaps(docs, min_chars=min_chars, min_docs=min_docs, slots=slots).select(
        F.col("doc_id").alias(doc), F.col("row").alias(row), F.col("dropped").alias(dropped)
    )
    text = whole_text()
    rows = docs.withColumn(tag, F.xxhash64(text))
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(tag) == F.col(row)), "left")
    lost = F.col(dropped)
    lines = split_lines(text)
    runs = keep_runs(lost, F.size(lines))
    whole = F.array(F.struct(F.lit(0).alias("first"), F.size(lines).alias("n")))
    return rows.select(
        *docs.columns,
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size(lost), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(lost.isNull(), whole).otherwise(runs).alias("keep"),
        F.when(lost.isNull(), text).otherwise(kept_text(lines, runs)).alias("kept"),
    )
