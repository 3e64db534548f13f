"""What the text operators share: staging, Arrow batches, word fingerprints."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from amperic.session import configure, stage

# Characters that separate words, as in [^\x20\x09-\x0D]+; bytes.split() uses the same six.
BLANKS = " \t\n\x0b\x0c\r"

# Bytes of text whose words a Python worker holds at a time. Words and what is worked
# out of them take some twenty times the text, and the workers stay between stages.
WORKED = 1 << 20


def staged(df: DataFrame) -> DataFrame:
    """The rows written once as Parquet on shared storage and read back, so that
    a lost executor costs no recomputation and later steps prune columns."""
    return stage(df, "zstd")


def prepared(spark: SparkSession) -> SparkSession:
    """Session settings for text: batches to Python are bounded in bytes, as one
    row may be megabytes long."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until ``df`` has no such columns."""
    taken = {c.lower() for c in df.columns}
    lead = "_"
    while any(lead + n in taken for n in names):
        lead += "_"
    return [lead + n for n in names]


def whole_text(name: str = "text") -> Column:
    """The text, empty where it is NULL."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """One function call per Arrow batch of bounded size; it returns columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = fn(batch)
            yield pa.RecordBatch.from_arrays([_typed(cols[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def _typed(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, (pa.Array, pa.ChunkedArray)) else pa.array(values, kind)


def utf8(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8 bytes; NULL is empty."""
    return [t or b"" for t in batch.column(name).cast(pa.binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of all runs of ``width`` successive word fingerprints."""
    n = len(words) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(width if n > 0 else 0):
        out = mix(out + words[k : k + n] + np.uint64(0x9E3779B97F4A7C15))
    return out


def offsets(counts: list[int] | np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.asarray(counts, np.int64))])


def spans(texts: list, size: int, rows: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes together, and no more than ``rows`` texts."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= size or i + 1 - start == rows:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def chunks(items: Iterable, size: int) -> Iterator[list]:
    it = iter(items)
    while part := list(itertools.islice(it, size)):
        yield part
