"""A source for readings that are fetched by conditions, as from a database.

One partition per span of time, and the filters that the source understands are handed
to it with every fetch, so a task asks for the rows and columns it needs and no others.
What fetches the rows is a function; the one here reads Parquet files. A database is
read by the same partitions and filters in :mod:`amperic.sources.jdbc`.
"""

from __future__ import annotations

import datetime as dt
import functools
import operator
import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.dataset as ds
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.types import StructType

# Executors need not have this package installed: the reader travels by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

UTC = dt.timezone.utc
COMPARES = {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


class Span(InputPartition):
    """Rows with ``start <= time < end``; either may be open (None)."""

    def __init__(self, start: dt.datetime | None, end: dt.datetime | None):
        self.start, self.end = start, end


def _aware(value):
    return value.replace(tzinfo=UTC) if isinstance(value, dt.datetime) and value.tzinfo is None else value


def condition(schema: pa.Schema, column: str, compare: str, value) -> ds.Expression:
    """A filter as the files understand it; their times may have no zone, and are UTC then."""
    field, kind = ds.field(column), schema.field(column).type
    if compare == "known":
        return field.is_valid()

    def typed(v):
        plain = pa.types.is_timestamp(kind) and kind.tz is None and isinstance(v, dt.datetime)
        return pa.scalar(v.astimezone(UTC).replace(tzinfo=None) if plain else v, kind)

    if compare == "in":
        return field.isin(pa.array([typed(v).as_py() for v in value], kind))
    value = typed(value)
    return {"==": field == value, ">": field > value, ">=": field >= value, "<": field < value, "<=": field <= value}[compare]


class TimeReader(DataSourceReader):
    """Partitions by time, cut to what the pushed filters leave of it."""

    def __init__(self, path: str, time: str, bounds: Sequence[dt.datetime], names: Sequence[str]):
        self.path, self.time, self.bounds, self.names = path, time, list(bounds), list(names)
        self.pushed: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons, lists and NULL tests of whole columns are the source's; the rest is left to Spark."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name not in self.names:
                yield f
            elif type(f) in COMPARES:
                self.pushed.append((name, COMPARES[type(f)], _aware(f.value)))
            elif isinstance(f, In):
                self.pushed.append((name, "in", tuple(_aware(v) for v in f.value)))
            elif isinstance(f, IsNotNull):
                self.pushed.append((name, "known", None))
            else:
                yield f

    def _asked(self, span: Span) -> bool:
        """Whether a span can hold rows that the pushed filters let through."""
        for name, compare, value in self.pushed:
            if name != self.time or compare in ("known", "in"):
                continue
            if compare in ("==", ">", ">=") and span.end is not None and value >= span.end:
                return False
            if compare in ("==", "<=") and span.start is not None and value < span.start:
                return False
            if compare == "<" and span.start is not None and value <= span.start:
                return False
        return True

    def partitions(self) -> list[Span]:
        edges = [None, *self.bounds, None]
        # rows before the first and after the last bound, and rows without a time, are read too
        return [s for s in (Span(a, b) for a, b in zip(edges, edges[1:])) if self._asked(s)] or [Span(None, None)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        files = ds.dataset(self.path, format="parquet")
        parts = [condition(files.schema, *p) for p in self.pushed]
        if partition.start is not None:
            parts.append(condition(files.schema, self.time, ">=", partition.start))
        if partition.end is not None:
            before = condition(files.schema, self.time, "<", partition.end)
            parts.append(before if partition.start is not None else before | ds.field(self.time).is_null())
        wanted = functools.reduce(operator.and_, parts) if parts else None
        yield from files.to_batches(columns=self.names, filter=wanted, batch_size=64_000)


class TimeScan(DataSource):
    """``path``: Parquet files; ``time``: the column; ``bounds``: inner bounds of the
    partitions in epoch seconds, comma-separated."""

    @classmethod
    def name(cls) -> str:
        return "time_scan"

    def schema(self) -> StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        return from_arrow_schema(ds.dataset(self.options["path"], format="parquet").schema)

    def reader(self, schema: StructType) -> TimeReader:
        bounds = [dt.datetime.fromtimestamp(int(b), UTC) for b in self.options.get("bounds", "").split(",") if b]
        return TimeReader(self.options["path"], self.options.get("time", "time"), bounds, schema.names)


def time_bounds(start: str, end: str, *, days_per_part: int = 7) -> list[int]:
    """Bounds of contiguous parts of ``[start, end)`` in epoch seconds; a span shorter than one part is one part."""
    first, last = (dt.datetime.fromisoformat(v).replace(tzinfo=UTC).timestamp() for v in (start, end))
    parts = max(1, int((last - first) / (days_per_part * 86400)))
    return [int(first + i * (last - first) / parts) for i in range(parts + 1)]


def read_by_time(spark: SparkSession, path: str, *, start: str, end: str, days_per_part: int = 7, time: str = "time") -> DataFrame:
    """The rows of Parquet files, in partitions of ``days_per_part`` days between ``start``
    and ``end``, one before and one after. Filters on the result are pushed."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TimeScan)
    bounds = ",".join(map(str, time_bounds(start, end, days_per_part=days_per_part)))
    return spark.read.format("time_scan").option("path", path).option("time", time).option("bounds", bounds).load()
