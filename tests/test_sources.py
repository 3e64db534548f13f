"""Tables by day and fetches by condition: what is read, and that the rows are the same."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, IsNotNull, LessThan, StringContains

from amperic.functions.clock import epoch
from amperic.operators.intervals import in_intervals
from amperic.operators.readings import deployed
from amperic.sources import fixtures, lake, scan

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("days") / "readings")
    lake.write_days(fixtures.readings(spark, SF), path)
    return path


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def rows(df, *names):
    return sorted(map(tuple, df.select(*names).collect()), key=str)


def test_a_bounded_read_opens_its_days_only(spark, folder):
    got = lake.read_days(spark, folder, start="2024-01-05", end="2024-01-08")
    whole = fixtures.readings(spark, SF).filter("time >= timestamp'2024-01-05' and time < timestamp'2024-01-08'")
    assert rows(got, "event_id") == rows(whole, "event_id") and got.count() > 0
    assert re.search(r"PartitionFilters: \[[^\]]*day", plan(got))
    days = {r[0] for r in got.select("day").distinct().collect()}
    first = int(dt.datetime(2024, 1, 5, tzinfo=dt.timezone.utc).timestamp()) // 86400
    assert days <= set(range(first, first + 3))
    assert lake.read_days(spark, folder).count() == fixtures.readings(spark, SF).count()


def test_deployed_from_the_table_by_day(spark, folder):
    places = fixtures.deployments(spark, SF)
    got = lake.deployed_days(spark, folder, places, start="2024-01-05", end="2024-01-12")
    want = deployed(fixtures.readings(spark, SF), places, start="2024-01-05", end="2024-01-12")
    assert rows(got, "event_id", "site_id") == rows(want, "event_id", "site_id") and want.count() > 0
    assert re.search(r"PartitionFilters: \[[^\]]*day", plan(got))


def test_intervals_prune_days_while_running(spark, folder):
    base = int(dt.datetime(2024, 1, 6, tzinfo=dt.timezone.utc).timestamp())
    spans = spark.createDataFrame(
        [(1, base + 100, base + 7000, 3), (2, base + 86400 * 2 - 50, base + 86400 * 2 + 5000, 3), (3, base + 86400 * 9, base + 86400 * 20, 1), (4, None, None, 3), (5, base + 5, base, 3)],
        "label long, min_time long, max_time long, size int",
    ).filter("size = 3")
    got = lake.in_interval_days(spark.read.parquet(folder), spans)
    flat = fixtures.readings(spark, SF).withColumn("_s", epoch(F.col("time")))
    want = in_intervals(flat, spans.filter("min_time <= max_time"), t="_s")
    assert rows(got, "label", "event_id") == rows(want, "label", "event_id") and want.count() > 0
    assert "dynamicpruning" in plan(got).lower()


def test_null_times_have_a_folder(spark, tmp_path):
    table = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (2, None), (None, dt.datetime(2024, 1, 2))], "core_id long, time timestamp")
    lake.write_days(table, f"{tmp_path}/t")
    assert lake.read_days(spark, f"{tmp_path}/t").count() == 3
    assert lake.read_days(spark, f"{tmp_path}/t", start="2024-01-02").count() == 1


# --- fetches by condition


def reader(bounds=(0, 100, 200)):
    edges = [dt.datetime.fromtimestamp(b, scan.UTC) for b in bounds]
    return scan.TimeReader("nowhere", "time", edges, ["time", "core_id", "name"])


def at(seconds):
    return dt.datetime.fromtimestamp(seconds, scan.UTC)


def test_pushed_filters_and_partitions():
    r = reader()
    assert [(s.start and s.start.timestamp(), s.end and s.end.timestamp()) for s in r.partitions()] == [(None, 0), (0, 100), (100, 200), (200, None)]
    odd = StringContains(("name",), "x")
    nested = EqualTo(("place", "lat"), 1.0)
    left = list(r.pushFilters([GreaterThanOrEqual(("time",), at(100)), IsNotNull(("core_id",)), odd, nested, EqualTo(("core_id",), 7)]))
    assert left == [odd, nested]
    assert r.pushed == [("time", ">=", at(100)), ("core_id", "known", None), ("core_id", "==", 7)]
    assert [s.start.timestamp() for s in r.partitions()] == [100, 200]
    r = reader()
    assert not list(r.pushFilters([LessThan(("time",), at(100)), GreaterThanOrEqual(("time",), at(0))]))
    assert [s.start.timestamp() for s in r.partitions()] == [0]
    r = reader()
    list(r.pushFilters([EqualTo(("time",), at(100))]))
    assert [s.start.timestamp() for s in r.partitions()] == [100]


def test_scan_by_time(spark, tmp_path):
    table = fixtures.readings(spark, SF).select("event_id", "core_id", F.col("time").cast("timestamp").alias("time"), "is_powered", "millis")
    table = table.unionByName(spark.createDataFrame([(-1, 5, None, True, None)], table.schema))
    spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")
    table.repartition(3).write.option("compression", "zstd").parquet(f"{tmp_path}/r")
    spark.conf.unset("spark.sql.parquet.outputTimestampType")
    read = lambda: scan.read_by_time(spark, f"{tmp_path}/r", start="2024-01-01", end="2024-01-29")
    assert rows(read(), *table.columns) == rows(table, *table.columns)
    assert read().rdd.getNumPartitions() == 6  # four weeks, what is before and what is after
    some = lambda df: df.filter("time >= timestamp'2024-01-09' and time < timestamp'2024-01-12' and core_id in (3, 4, 5, 6, 7, 8, 9)").filter("is_powered")
    assert rows(some(read()), "event_id") == rows(some(table), "event_id")
    assert some(read()).rdd.getNumPartitions() == 1
