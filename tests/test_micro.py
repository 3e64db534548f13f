"""Small hand-computed cases for every rule that is easy to get wrong."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from amperic.functions import geo
from amperic.functions.clock import corrected_time, epoch, parse_time
from amperic.functions.scaling import zscore
from amperic.operators import clusters_time, evaluation, hulls, reliability, snapshots, summary, topology
from amperic.operators.intervals import in_intervals
from amperic.operators.places import nearest_places
from amperic.operators.population import population, population_members
from amperic.operators.readings import deployed
from amperic.operators.transitions import number_per_sensor, outages, power_edges, transitions
from amperic.plans import flows  # noqa: F401  (imports must hold together)
from amperic.sources import jdbc, tables

T0 = datetime(2024, 1, 1, 12, 0, 0)
E0 = 1704110400


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def power_log(spark, states, core=1, start=0, step=60):
    """Readings of one sensor without usable counters."""
    rows = [
        (core, at(start + i * step), core * 1000 + i, s, 0.0, 0.0, 0.0, 5.0 + core, -1.0 * core)
        for i, s in enumerate(states)
    ]
    return spark.createDataFrame(
        rows,
        "core_id bigint, time timestamp, event_id bigint, is_powered boolean, millis double, "
        "last_unplug_millis double, last_plug_millis double, location_latitude double, location_longitude double",
    )


def ids(df, col="event_id"):
    return sorted(r[0] for r in df.select(col).collect())


def test_first_off_transition_is_an_outage_only_after_an_on_transition(spark):
    log = power_log(spark, [True, False, True, False, True])
    assert ids(transitions(log)) == [1001, 1002, 1003, 1004]
    assert ids(outages(log)) == [1003]


def test_unknown_state_makes_no_transition(spark):
    log = power_log(spark, [True, None, False, True, False, True])
    assert ids(transitions(log)) == [1003, 1004, 1005]
    assert ids(outages(log)) == [1004]


@pytest.mark.parametrize("slices", [1, 2, 5, 30])
def test_slices_do_not_change_transitions(spark, slices):
    states = [True, True, False, False, None, True, False, True, True, False, False, True, None, None, True, False]
    log = power_log(spark, states).unionByName(power_log(spark, states[::-1], core=2, start=7, step=45))
    want_t, want_o = ids(transitions(log)), ids(outages(log))
    assert ids(transitions(log, slices=slices)) == want_t
    assert ids(outages(log, slices=slices)) == want_o
    assert 1006 in want_t


def test_hot_sensor_is_spread_within_a_minute(spark):
    """One flapping sensor holds 90 % of the rows, all of them in one minute."""
    n = 4000
    hot = spark.range(n).selectExpr(
        "1L AS core_id", "timestamp_micros(1704067200000000 + id * 15000) AS time", "id AS event_id", "id % 3 <> 1 AS is_powered",
        "CAST(1000 AS DOUBLE) AS millis", "CAST(0 AS DOUBLE) AS last_unplug_millis", "CAST(0 AS DOUBLE) AS last_plug_millis",
    )
    rest = hot.filter("event_id % 9 = 0").withColumn("core_id", F.col("event_id") % 40 + 2)
    edges = power_edges(hot.unionByName(rest), slices=16)
    per_slice = [r["n"] for r in edges.filter("core_id = 1").groupBy("_slice").agg(F.count("*").alias("n")).collect()]
    assert len(per_slice) > 8 and max(per_slice) < n / 6
    want = [i for i in range(1, n) if (i % 3 != 1) != ((i - 1) % 3 != 1)]
    assert ids(edges.filter("core_id = 1 and _changed")) == want
    assert edges.select("core_id").distinct().count() == 41


def test_outage_table_reads_the_readings_once(spark, tmp_path):
    """What is made of the staged power edges does not go back to the readings."""
    edges = power_edges(power_log(spark, [True, False, True]))
    for df in (outages(edges, edges=edges), population(edges)):
        assert "Scan ExistingRDD" not in df._jdf.queryExecution().executedPlan().toString()


def test_rows_as_the_database_query_returns_them(spark):
    """No event id: the columns of the derived table are enough for outages."""
    log = power_log(spark, [True, False, True, False, True]).drop("event_id").withColumns(
        {"product_id": F.lit(7008), "location_latitude": F.lit(5.5), "location_longitude": F.lit(-0.2), "site_id": F.lit(1)}
    )
    text = jdbc.deployed_query("2024-01-01", "2024-01-02")
    columns = [c.strip().split(".")[1] for c in text[len("(SELECT "): text.index(" FROM")].split(",")]
    assert set(columns) == set(log.columns)
    got = outages(log.select(*columns)).collect()
    assert [(r.core_id, r.location_latitude) for r in got] == [(1, 5.5)]


def test_rows_without_time_or_place_are_noise(spark):
    rows = spark.createDataFrame([(1, 10), (2, 20), (3, None)], "event_id bigint, outage_time bigint")
    for k in (2, 3):
        got = {r.event_id: r.label for r in clusters_time.dbscan_time(rows, eps=30, min_samples=k).collect()}
        assert len(got) == 3 and got[3] == -1
    merged = {r.event_id: r.cluster for r in clusters_time.agglomerate_time(rows, partition=None).collect()}
    assert merged == {1: 10, 2: 10, 3: None}


def test_kernel_density_without_spread_is_empty(spark):
    one = spark.createDataFrame([(1.0, 2.0)], "lon double, lat double")
    assert evaluation.kde_grid(one).count() == 0 and evaluation.kde_grid(one.limit(0)).count() == 0
    assert evaluation.kde_line(one.unionByName(one), "lon").count() == 0


def test_restore_time_is_the_next_transition(spark):
    row = outages(power_log(spark, [False, True, False, False, True])).first()
    assert (row.outage_time, row.restore_time) == (E0 + 120, E0 + 240)


@pytest.mark.parametrize(
    "millis, edge, want",
    [
        (10_000.0, 0.0, 0),
        (10_000.0, None, 0),
        (None, 5_000.0, 0),
        (10_000.0, float("nan"), 0),
        (float("nan"), 5_000.0, 0),
        (10_000.0, 10_500.0, 0),
        (10_000.0, 4_000.0, -6),
        (10_000.9, 4_000.2, -6),
        (10_000.0, 8_500.0, -2),  # 1.5 s back, seconds are floored
    ],
)
def test_clock_correction(spark, millis, edge, want):
    df = spark.createDataFrame([(T0, millis, edge)], "t timestamp, m double, e double")
    assert df.select(epoch(corrected_time(F.col("t"), F.col("m"), F.col("e")))).first()[0] == E0 + want


def test_deployments_that_touch(spark):
    log = power_log(spark, [True]).withColumn("product_id", F.lit(7008))
    spans = spark.createDataFrame(
        [(1, 5.0, -0.2, "10", at(-100), T0), (1, 6.0, -0.3, "20", T0, None), (1, 7.0, -0.4, "x", None, None)],
        "core_id bigint, location_latitude double, location_longitude double, site_id string, "
        "deployment_start_time timestamp, deployment_end_time timestamp",
    )
    log = log.drop("location_latitude", "location_longitude")
    assert sorted(r.site_id for r in deployed(log, spans).collect()) == [10, 20]
    assert [r.site_id for r in deployed(log, spans, end_inclusive=False).collect()] == [20]
    assert deployed(log, spans, site_below=None).count() == 3
    assert deployed(log, spans, products=[1]).count() == 0
    assert deployed(log, spans, end="2024-01-01 12:00:00").count() == 0


def test_even_split_is_off_and_windows_are_half_open(spark):
    log = power_log(spark, [True, False, True, False], step=30)
    got = {r.time: r.is_powered for r in snapshots.majority_resample(log).collect()}
    assert got[at(60)] == 0  # two of four
    assert got[at(-120)] == 1  # sees [-270, 30): the first reading only
    assert min(got) == at(-120) and max(got) == at(240)


def test_snapshot_needs_power_throughout(spark):
    log = power_log(spark, [True, True, False], step=120)
    got = [r.minute for r in snapshots.powered_snapshot(log).orderBy("minute").collect()]
    # [m, m + 240 s) holds a reading but not the one at 240 s
    assert got == [at(60 * k) for k in range(-3, 1)]


def test_population_day_borders(spark):
    log = spark.createDataFrame([(1, datetime(2024, 1, 10)), (2, datetime(2024, 1, 21))], "core_id bigint, time timestamp")
    got = {r.day.day + (31 if r.day.month == 2 else 0): r.sensors_reporting for r in population(log).collect()}
    assert got == {d: 1 for d in [*range(6, 16), *range(17, 27)]}
    assert population_members(log).count() == 20
    near = spark.createDataFrame([(1, datetime(2024, 1, 10)), (1, datetime(2024, 1, 20))], "core_id bigint, time timestamp")
    assert population(near).count() == 20


def test_outages_without_powered_sensor(spark):
    out = spark.createDataFrame([(1, E0 + 5), (2, E0 + 65)], "core_id bigint, outage_time bigint")
    snap = spark.createDataFrame([(T0, 1), (T0, 3)], "minute timestamp, core_id bigint")
    got = snapshots.with_powered(out, snap).collect()
    assert [(r.core_id, r.n_powered, r.n_powered_others) for r in got] == [(1, 2, 1)]
    kept = snapshots.with_powered(out, snap, keep_unmatched=True).orderBy("core_id").collect()
    assert [(r.core_id, r.n_powered) for r in kept] == [(1, 2), (2, 0)]


def test_places_powered_and_out_at_once(spark):
    schema = "minute timestamp, lon double, lat double"
    on = spark.createDataFrame([(T0, 1.0, 1.0), (T0, 2.0, 2.0), (at(60), 1.0, 1.0), (at(120), 3.0, 3.0)], schema)
    off = spark.createDataFrame([(T0, 1.0, 1.0), (T0, 1.0, 5.0), (at(60), 1.0, 1.0)], schema)
    got = snapshots.minute_places(on, off)
    assert {(r.kind, r.lon, r.lat) for r in got.collect()} == {("powered", 2.0, 2.0), ("outage", 1.0, 1.0), ("outage", 1.0, 5.0)}
    share = snapshots.minute_shares(got).first()
    assert (share.outage_lons, share.powered_lons, share.percent_not_powered) == (1, 1, 50.0)


def topo(spark, rows):
    return spark.createDataFrame(
        rows, "core_id bigint, start_time timestamp, end_time timestamp, transformer string, feeder string"
    )


def test_grid_distance_levels_and_touching_validity(spark):
    grid = topo(
        spark,
        [
            (1, None, T0, "T1", "AC1"),
            (2, T0, None, "T1", "AC1"),
            (3, at(1), None, "T1", "AC1"),
            (4, None, None, "T2", "AC1"),
            (5, None, None, "T3", "AC2"),
            (6, None, None, "T4", "7"),
            (7, None, None, "T5", "8"),
        ],
    )
    want = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 4), (1, 5), (1, 6), (6, 7)], "core_1 bigint, core_2 bigint")
    got = {(r.core_1, r.core_2): r.grid_distance for r in topology.pair_distances(want, grid).collect()}
    assert got == {(1, 1): 0, (1, 2): 1, (1, 3): None, (1, 4): 2, (1, 5): 3, (1, 6): 4, (6, 7): 3}
    rows = {r.core_id: [r[f"distance_{i}"] for i in range(5)] for r in topology.distance_profile(grid).collect()}
    assert rows[1] == [1, 1, 1, 1, 2]
    assert rows[3] == [1, 1, 1, 1, 2]
    assert rows[6] == [1, 0, 0, 1, 5]


def members(spark, times, label=None):
    rows = [(i, 100 + i, t, 5.0, -0.1) for i, t in enumerate(times)]
    return spark.createDataFrame(
        rows, "event_id bigint, core_id bigint, outage_time bigint, location_latitude double, location_longitude double"
    )


def labels(df):
    return [r.label for r in df.orderBy("event_id").collect()]


def test_gap_of_exactly_eps_joins_and_of_max_gap_splits(spark):
    rows = members(spark, [0, 90, 181, 1000])
    assert labels(clusters_time.dbscan_time(rows, eps=90)) == [0, 0, -1, -1]
    rows = members(spark, [0, 180, 359])
    got = clusters_time.agglomerate_time(rows, max_gap=180).orderBy("event_id").collect()
    assert [r.cluster for r in got] == [0, 180, 180]


@pytest.mark.parametrize("width", [50, 100, 1000])
def test_runs_across_slices(spark, width):
    rows = members(spark, [0, 40, 99, 101, 160, 400, 470, 1000, 1001])
    assert labels(clusters_time.dbscan_time(rows, eps=60, width=width)) == [0, 0, 0, 0, 0, -1, -1, 1000, 1000]


def test_merge_rounds(spark):
    def solve(times):
        return [(r.cluster, r.cluster_time) for r in clusters_time.agglomerate_time(members(spark, times)).orderBy("event_id").collect()]

    # equal gaps: the middle one goes ahead, the first follows a round later
    assert solve([0, 10, 20]) == [(0, 10)] * 3
    # 0 and 100 meet at 50, then 250 is 200 away
    assert solve([0, 100, 250]) == [(0, 50), (0, 50), (250, 250)]
    assert solve([5, 5, 8]) == [(5, 6)] * 3


def test_border_rows_join_the_earlier_cluster(spark):
    # core rows: 20, 40, 60 and 140, 160, 180; both 60 and 140 reach 100
    rows = members(spark, [0, 20, 40, 60, 100, 140, 160, 180, 200])
    got = labels(clusters_time.dbscan_time(rows, eps=40, min_samples=4))
    assert got == [20, 20, 20, 20, 20, 140, 140, 140, 140]


def test_hulls_of_few_and_collinear_places(spark):
    points = [("a", 1.0, 1.0), ("b", 0.0, 0.0), ("b", 2.0, 2.0), ("c", 0.0, 0.0), ("c", 1.0, 1.0), ("c", 2.0, 2.0)]
    points += [("d", x, y) for x, y in [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (1.0, 0.0), (1.0, 1.0)]]
    df = spark.createDataFrame(points, "k string, x double, y double")
    got = hulls.convex_hulls(df, ["k"], x="x", y="y")
    corner = {r.k: set(zip(r.hx, r.hy)) for r in got.collect()}
    assert corner["a"] == {(1.0, 1.0)}
    assert corner["b"] == corner["c"] == {(0.0, 0.0), (2.0, 2.0)}
    assert corner["d"] == {(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)}
    asks = [("a", 1.0, 1.0), ("a", 1.0, 1.1), ("b", 1.0, 1.0), ("b", 2.0, 2.0), ("b", 1.0, 1.2), ("b", 3.0, 3.0),
            ("d", 1.0, 1.0), ("d", 2.0, 1.0), ("d", 0.0, 0.0), ("d", 2.5, 1.0)]
    spots = spark.createDataFrame(asks, "k string, px double, py double").join(got, "k")
    inside = hulls.strictly_inside(F.col("px"), F.col("py"), F.col("hx"), F.col("hy"))
    assert {tuple(r) for r in spots.filter(inside).select("k", "px", "py").collect()} == {
        ("a", 1.0, 1.0), ("b", 1.0, 1.0), ("d", 1.0, 1.0)
    }
    areas = {r.k: r.area_degrees for r in hulls.hull_areas(got).collect()}
    assert areas == {"a": 0.0, "b": 0.0, "c": 0.0, "d": 4.0}


def test_projections(spark):
    df = spark.createDataFrame([(5.6, -0.2, 5.6, -0.19), (5.6, -0.2, 5.61, -0.2)], "a double, b double, c double, d double")
    ends = [F.col(c) for c in "abcd"]
    rows = df.select(geo.great_circle_metres(*ends).alias("s"), geo.albers_metres(*ends).alias("p"), geo.planar_metres(*ends).alias("q")).collect()
    for r in rows:
        assert abs(r.s - r.p) / r.s < 0.01
        assert abs(r.q - 1102.5) < 1e-6
    x, y = geo.utm(F.col("a"), F.col("b"))
    first = df.select(x.alias("x"), y.alias("y")).first()
    assert abs(first.x - 810_100) < 1000 and abs(first.y - 619_700) < 1000


def test_zscore_of_a_constant(spark):
    df = spark.createDataFrame([(1.0, 3.0), (3.0, 3.0)], "a double, b double")
    got = zscore(df, ["a", "b"], {"a": 10}).orderBy("a").collect()
    assert [(r.z_a, r.z_b) for r in got] == [(-10.0, 0.0), (10.0, 0.0)]


def test_nearest_label_ties(spark):
    from amperic.operators.ordered import nearest

    asks = spark.createDataFrame([(50,), (120,), (0,), (300,)], "t bigint")
    marks = spark.createDataFrame([(2, 0.0), (1, 100.0), (3, 100.0)], "label bigint, mean double")
    got = {r.t: r.nearest_label for r in nearest(asks, marks, "t", "mean", "label", width=40).collect()}
    assert got == {50: 1, 120: 1, 0: 2, 300: 1}


def test_nearest_place_ties(spark):
    asks = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 10.0)], "ask_id bigint, x double, y double")
    spots = spark.createDataFrame([(1, 1.0, 0.0), (2, 0.0, 1.0), (3, 5.0, 5.0)], "place_id bigint, x double, y double")
    got = {(r.ask_id, r.place_id) for r in nearest_places(asks, spots).collect()}
    assert got == {(1, 1), (1, 2), (2, 3)}


def test_other_label_needs_exactly_one_match(spark):
    schema = "label bigint, core_id bigint, outage_time bigint, restore_time bigint, event_id bigint, time timestamp"
    rows = spark.createDataFrame(
        [(1, 1, 10, 100, 1, T0), (1, 2, 11, 100, 2, T0), (1, 3, 12, 101, 3, T0), (1, 4, 13, 500, 4, T0), (-1, 5, 90, 100, 5, T0)],
        schema,
    )
    ends = spark.createDataFrame([(7, 1, 10, 100, 1, T0), (7, 2, 11, 100, 2, T0), (7, 2, 20, 100, 9, T0), (-1, 4, 13, 500, 4, T0)], schema)
    lookup = rows.filter("core_id <> 3")
    got = {r.core_id: r.other_label for r in reliability.with_other_label(rows, ends, lookup).collect()}
    # 2 matches twice, 3 is not in the look-up, 4 restores as noise, 5 is noise itself
    assert got == {1: 7, 2: -1, 3: -1, 4: -1}


def test_saidi_by_hand(spark):
    schema = "label bigint, other_label bigint, outage_time bigint, restore_time bigint, sensors_reporting bigint"
    rows = spark.createDataFrame([(1, 5, 0, 100, 10), (1, -1, 10, 130, 11), (2, -1, 50, 60, 20)], schema)
    assert reliability.saidi(rows).first().saidi == pytest.approx((110 * 2 + 10) / 15)
    parts = {r.part: r.saidi for r in reliability.saidi_by_noise(rows).collect()}
    assert parts == {"clustered": pytest.approx(11.0), "noise": pytest.approx((110 + 10) / 15)}


def test_pairs_of_small_clusters(spark):
    df = spark.createDataFrame(
        [(1, 1, 10, 1), (1, 2, 11, 2), (2, 3, 20, 3), (2, 4, 21, 4), (2, 5, 22, 5), (3, 6, 30, 6)] + [(4, 9 + i, 40, 9 + i) for i in range(4)],
        "label bigint, core_id bigint, outage_time bigint, event_id bigint",
    ).withColumns({"location_latitude": F.lit(5.0), "location_longitude": F.lit(1.0)})
    got = {(r.core_1, r.core_2) for r in summary.small_cluster_pairs(df).collect()}
    assert got == {(1, 2), (3, 4), (4, 5), (5, 3)}


def test_intervals_keep_empty_ones(spark):
    rows = spark.createDataFrame([(5,), (600,), (1300,)], "time_s bigint")
    spans = spark.createDataFrame([("a", 0, 600), ("b", 601, 1299), ("c", 590, 1300)], "k string, min_time bigint, max_time bigint")
    got = in_intervals(rows, spans, how="left").groupBy("k").agg(F.count("time_s").alias("n"))
    assert {r.k: r.n for r in got.collect()} == {"a": 2, "b": 0, "c": 2}


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 5, 10]], "v double")
    assert {r.bucket: r.n for r in evaluation.histogram(df, "v", 10).collect()} == {1: 1, 2: 1, 6: 1, 10: 1}
    same = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert [(r.bucket, r.n) for r in evaluation.histogram(same, "v", 10).collect()] == [(1, 2)]


def test_ordinals_across_slices(spark):
    rows = spark.createDataFrame([(1, i, 100 * i) for i in range(10)] + [(2, 50, 5)], "core_id bigint, event_id bigint, outage_time bigint")
    got = {r.event_id: r.ordinal for r in number_per_sensor(rows, slices=4).collect()}
    assert got == {**{i: i for i in range(10)}, 50: 0}


def test_time_predicates():
    got = jdbc.time_predicates("2018-07-01", "2019-09-01")
    assert len(got) == 61
    assert got[0].startswith("time >= '2018-07-01 00:00:00' AND time < '2018-07-08 00:00:00'")
    assert got[-1].endswith("time < '2019-09-01 00:00:00'")
    assert jdbc.time_predicates("2024-01-01", "2024-01-03") == [
        "time >= '2024-01-01 00:00:00' AND time < '2024-01-03 00:00:00'"
    ]
    assert "site_id < 100" in jdbc.deployed_query("2018-07-01", "2019-09-01")


def test_text_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, [(1, -0.25)])], "k bigint, spots array<struct<id: bigint, lon: double>>")
    back = tables.nested_from_json(tables.nested_to_json(df), {"spots": "array<struct<id: bigint, lon: double>>"})
    assert back.collect() == df.collect()
    edges = spark.createDataFrame([("a", "b", "s", "e", 4)], tables.EDGE_SCHEMA)
    tables.write_csv(edges, f"{tmp_path}/edges")
    assert tables.read_csv(spark, f"{tmp_path}/edges", tables.EDGE_SCHEMA).collect() == edges.collect()
    times = spark.createDataFrame([("2018-07-01 12:00:00",), ("2018-07-01 12:00:00.250000",), ("x",)], "t string")
    got = [r[0] for r in times.select(parse_time(F.col("t"))).collect()]
    assert got == [datetime(2018, 7, 1, 12), datetime(2018, 7, 1, 12, 0, 0, 250000), None]
    assert tables.empty(spark, "a int").count() == 0
    assert len(tables.head_to_pandas(spark.range(10), 3)) == 3


def test_wide_hull_is_looked_up_in_few_cells(spark):
    """A hull of ten degrees over a day: candidates stay near the number of spots."""
    members = spark.createDataFrame(
        [(1, 100 + i, E0 + 60 * i, -5.0 + 10 * (i % 2), 10.0 * (i // 2 % 2)) for i in range(1440)],
        "label bigint, core_id bigint, outage_time bigint, location_longitude double, location_latitude double",
    )
    snapshot = spark.range(2880).selectExpr(
        f"timestamp_seconds({E0} + 60 * (id div 2)) AS minute", "10000 + id % 7 AS core_id",
        "CAST(id % 20 - 10 AS DOUBLE) AS location_longitude", "5.0D AS location_latitude",
    )
    shapes = hulls.convex_hulls(members, ["label"])
    assert len(shapes.first().hx) == 4
    got = hulls.powered_near(members, shapes, snapshot)
    want = {10000 + i % 7 for i in range(2880) if -5 <= i % 20 - 10 <= 5}
    assert {r.core_id for r in got.collect()} == want


def test_hulls_of_one_and_two_places(spark):
    rows = spark.createDataFrame(
        [(1, 0.0, 0.0), (1, 0.0, 0.0), (2, 1.0, 0.0), (2, 0.0, 5.0), (3, None, 1.0)], "k int, location_longitude double, location_latitude double"
    )
    got = {r.k: (r.hx, r.hy) for r in hulls.convex_hulls(rows, ["k"]).collect()}
    assert got == {1: ([0.0], [0.0]), 2: ([0.0, 1.0], [5.0, 0.0])}
