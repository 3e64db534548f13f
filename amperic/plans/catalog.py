"""Every query by name, with the SQL that checks it where there is one.

Results carry plain types only: epoch seconds as bigint and rounded doubles, so
that two engines agree on them.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from amperic.functions import geo
from amperic.functions.clock import epoch, from_epoch, iso_week, parse_time
from amperic.functions.scaling import percent, scaled_eps
from amperic.operators import clusters_space, clusters_time, evaluation, gps, hulls, population, readings
from amperic.operators import reliability as rel
from amperic.operators import snapshots, summary, topology
from amperic.operators.intervals import in_intervals
from amperic.operators.ordered import count_within, islands
from amperic.operators.transitions import number_per_sensor, outages
from amperic.plans import flows
from amperic.plans.oracle import albers_sql, check, utm_sql
from amperic.session import configure, run_folder, stage
from amperic.sources import fixtures, jdbc, lake, tables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        key = name or fn.__name__
        run.__name__, run.__doc__ = key, fn.__doc__
        QUERIES[key] = run
        if sql:
            ORACLES[key] = check(sql)
        return fn

    return register


def rnd(col: str | Column, digits: int = 6) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, digits)


def big(col: str | Column) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("bigint")


LAT, LON = "location_latitude", "location_longitude"


# --- readings and outages ----------------------------------------------------


@query(
    """SELECT event_id, core_id, epoch_us(time) // 1000000 AS time_s, is_powered, CAST(site_id AS BIGINT) AS site_id,
  round(location_latitude, 6) AS lat, round(location_longitude, 6) AS lon
FROM study WHERE time >= TIMESTAMP '2024-01-02' AND time < TIMESTAMP '2024-01-30'"""
)
def deployed_readings(spark, sf_dir):
    rows = readings.deployed(
        fixtures.readings(spark, sf_dir), fixtures.deployments(spark, sf_dir), start="2024-01-02", end="2024-01-30"
    )
    return rows.select(
        "event_id", "core_id", epoch(F.col("time")).alias("time_s"), "is_powered", big("site_id").alias("site_id"),
        rnd(LAT).alias("lat"), rnd(LON).alias("lon"),
    )


@query(
    """SELECT event_id, core_id, epoch_us(time) // 1000000 AS time_s, outage_time, restore_time,
  round(location_latitude, 6) AS lat, round(location_longitude, 6) AS lon FROM study_out"""
)
def outage_transitions(spark, sf_dir):
    return outages(flows.study_readings(spark, sf_dir)).select(
        "event_id", "core_id", epoch(F.col("time")).alias("time_s"), "outage_time", "restore_time",
        rnd(LAT).alias("lat"), rnd(LON).alias("lon"),
    )


@query(
    """SELECT event_id, core_id, row_number() OVER (PARTITION BY core_id ORDER BY outage_time, event_id) - 1 AS ordinal
FROM outs"""
)
def outage_ordinal(spark, sf_dir):
    rows = stage(outages(flows.located_readings(spark, sf_dir)))
    return number_per_sensor(rows).select("event_id", "core_id", big("ordinal").alias("ordinal"))


@query("SELECT CAST(day_no AS BIGINT) * 86400 AS day_s, sensors_reporting FROM study_out_people")
def sensor_population_10d(spark, sf_dir):
    people = population.population(flows.study_readings(spark, sf_dir))
    return people.select(epoch(F.col("day")).alias("day_s"), big("sensors_reporting").alias("sensors_reporting"))


@query(
    """SELECT DISTINCT CAST(d + k AS BIGINT) * 86400 AS day_s, core_id
FROM (SELECT DISTINCT core_id, epoch_us(time) // 86400000000 AS d FROM study), range(-4, 6) r(k)"""
)
def sensor_population_members(spark, sf_dir):
    return population.population_members(flows.study_readings(spark, sf_dir)).select(
        epoch(F.col("day")).alias("day_s"), "core_id"
    )


@query("SELECT minute AS minute_s, core_id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM snap")
def powered_snapshot_4m(spark, sf_dir):
    return flows.snapshot(spark, sf_dir).select(
        epoch(F.col("minute")).alias("minute_s"), "core_id", rnd(LAT).alias("lat"), rnd(LON).alias("lon")
    )


@query("SELECT t AS time_s, core_id, CAST(is_powered AS BIGINT) AS is_powered, round(lat, 6) AS lat FROM maj")
def majority_resample_5m(spark, sf_dir):
    return snapshots.majority_resample(flows.located_readings(spark, sf_dir)).select(
        epoch(F.col("time")).alias("time_s"), "core_id", big("is_powered").alias("is_powered"),
        rnd("powered_latitude").alias("lat"),
    )


@query(
    """SELECT event_id, o.core_id, n AS n_powered,
  n - (SELECT count(*) FROM snap s WHERE s.minute = o.outage_time // 60 * 60 AND s.core_id = o.core_id) AS n_powered_others,
  sensors_reporting
FROM outs o JOIN (SELECT minute, count(*) AS n FROM snap GROUP BY 1) c ON c.minute = o.outage_time // 60 * 60"""
)
def outage_powered_sensors(spark, sf_dir):
    rows = snapshots.with_powered(flows.outage_table(spark, sf_dir), stage(flows.snapshot(spark, sf_dir)))
    return rows.select("event_id", "core_id", "n_powered", big("n_powered_others").alias("n_powered_others"),
                       big("sensors_reporting").alias("sensors_reporting"))


@query(
    """SELECT minute AS minute_s, count(*) FILTER (kind = 'powered') AS powered_places,
  count(*) FILTER (kind = 'outage') AS outage_places,
  round(count(DISTINCT lon) FILTER (kind = 'outage') / CAST(count(DISTINCT lon) FILTER (kind = 'outage')
    + count(DISTINCT lon) FILTER (kind = 'powered') AS DOUBLE) * 100, 6) AS percent_not_powered
FROM spots GROUP BY 1"""
)
def powered_x_outage_minute(spark, sf_dir):
    return snapshots.minute_shares(flows.places(spark, sf_dir)).select(
        epoch(F.col("minute")).alias("minute_s"), "powered_places", "outage_places", rnd("percent_not_powered").alias("percent_not_powered")
    )


@query("SELECT minute AS minute_s, kind, round(lon, 6) AS lon, round(lat, 6) AS lat FROM spots")
def coordinates_by_time(spark, sf_dir):
    return flows.places(spark, sf_dir).select(
        epoch(F.col("minute")).alias("minute_s"), "kind", rnd("lon").alias("lon"), rnd("lat").alias("lat")
    )


_GPS = """SELECT r.core_id, epoch_us(st) // 1000000 AS valid_from_s, {site} epoch_us(min(time)) // 1000000 AS mintime_s,
  epoch_us(max(time)) // 1000000 AS maxtime_s, count(*) AS n_gps_samples, round(avg(gps_satellites), 9) AS gps_satellites_avg,
  round(avg(gps_latitude), 12) AS lat_avg, round(max(location_latitude), 6) AS lat_fixed, round(avg(gps_longitude), 12) AS lon_avg,
  round(110.25 * 1000 * sqrt(pow(avg(gps_latitude) - max(location_latitude), 2)
    + pow(avg(gps_longitude) - max(location_longitude), 2)), 1) AS dist_diff_meters
FROM readings r JOIN spans s ON r.core_id = s.core_id AND time >= st AND time < et
WHERE time >= TIMESTAMP '2024-01-01' AND time <= TIMESTAMP '2024-01-29' AND {fix}
GROUP BY r.core_id, {group} st"""


def _gps(spark, sf_dir, **how):
    rows = gps.gps_accuracy(
        fixtures.readings(spark, sf_dir), fixtures.deployments(spark, sf_dir), start="2024-01-01", end="2024-01-29", **how
    )
    site = [big("site_id").alias("site_id")] if "site_id" in rows.columns else []
    return rows.select(
        "core_id", epoch(F.col("valid_from")).alias("valid_from_s"), *site, epoch(F.col("mintime")).alias("mintime_s"),
        epoch(F.col("maxtime")).alias("maxtime_s"), "n_gps_samples", rnd("gps_satellites_avg", 9).alias("gps_satellites_avg"),
        rnd("lat_avg", 12).alias("lat_avg"), rnd("lat_fixed").alias("lat_fixed"), rnd("lon_avg", 12).alias("lon_avg"),
        rnd("dist_diff_meters", 1).alias("dist_diff_meters"),
    )


@query(
    _GPS.format(
        site="CAST(site_id AS BIGINT) AS site_id,", group="site_id,",
        fix="gps_longitude IS NOT NULL AND NOT isnan(gps_longitude) AND gps_satellites >= 4",
    )
)
def gps_accuracy(spark, sf_dir):
    return _gps(spark, sf_dir)


@query(_GPS.format(site="", group="", fix="gps_satellites IS NOT NULL AND NOT isnan(gps_satellites)"))
def gps_accuracy_any_fix(spark, sf_dir):
    return _gps(spark, sf_dir, min_satellites=None, by_site=False)


# --- grid ----------------------------------------------------------------------


@query(
    """SELECT core_1 AS core_id, epoch_us(st_1) // 1000000 AS start_s,
  count(*) FILTER (distance = 0) AS distance_0, count(*) FILTER (distance = 1) AS distance_1,
  count(*) FILTER (distance = 2) AS distance_2, count(*) FILTER (distance = 3) AS distance_3,
  count(*) FILTER (distance = 4) AS distance_4 FROM edges GROUP BY 1, 2"""
)
def grid_distance(spark, sf_dir):
    rows = topology.distance_profile(fixtures.topology(spark, sf_dir))
    return rows.select(
        "core_id", epoch(F.col("start_time")).alias("start_s"), *[big(f"distance_{i}").alias(f"distance_{i}") for i in range(5)]
    )


def _pairs(spark, sf_dir):
    pairs = summary.with_distances(stage(summary.small_cluster_pairs(flows.labelled(spark, sf_dir))))
    return topology.pair_distances(
        pairs, fixtures.topology(spark, sf_dir), one="core_1", two="core_2", at="t"
    )


@query(
    """SELECT label, cluster_size, pair, core_1, core_2, round(degrees, 6) AS degrees, round(degrees * 110250, 3) AS planar_m,
  round(sphere_m, 1) AS sphere_m, round(projected_m, 3) AS projected_m, CAST(grid_distance AS BIGINT) AS grid_distance FROM pair_far"""
)
def pair_distances(spark, sf_dir):
    return _pairs(spark, sf_dir).select(
        "label", "cluster_size", big("pair").alias("pair"), "core_1", "core_2", rnd("degrees").alias("degrees"),
        rnd("planar_m", 3).alias("planar_m"), rnd("sphere_m", 1).alias("sphere_m"), rnd("projected_m", 3).alias("projected_m"),
        big("grid_distance").alias("grid_distance"),
    )


@query(
    """SELECT cluster_size, count(*) AS clusters, CAST(sum(n) AS BIGINT) AS pairs, round(sum(near) / sum(n), 6) AS share_near,
  round(sum(step) / sum(n), 6) AS share_same_transformer, round(avg(CAST(far < 5000 AS INT)), 6) AS share_mean_near
FROM (SELECT cluster_size, label, count(*) AS n, sum(CAST(projected_m < 5000 AS INT)) AS near,
    sum(CAST(grid_distance = 1 AS INT)) AS step, avg(projected_m) AS far FROM pair_far GROUP BY 1, 2) GROUP BY 1"""
)
def pair_grid_distance(spark, sf_dir):
    shares = summary.distance_shares(_pairs(spark, sf_dir), limit_m=5000)
    return shares.select(
        "cluster_size", "clusters", big("pairs").alias("pairs"), rnd("share_near").alias("share_near"),
        rnd("share_same_transformer").alias("share_same_transformer"), rnd("share_mean_near").alias("share_mean_near"),
    )


# --- clustering -----------------------------------------------------------------


@query("SELECT event_id, core_id, outage_time, label FROM out90")
def dbscan_time_eps90(spark, sf_dir):
    return flows.labelled(spark, sf_dir, eps=90).select("event_id", "core_id", "outage_time", "label")


@query("SELECT event_id, core_id, restore_time, label FROM rest90")
def dbscan_restore_eps90(spark, sf_dir):
    return flows.labelled(spark, sf_dir, "restore_time", 90).select("event_id", "core_id", "restore_time", "label")


_MIN5 = """
, pts AS (SELECT event_id, outage_time AS t FROM outs),
lim AS (SELECT CAST(floor({eps} * stddev_pop(t)) AS BIGINT) AS e FROM pts),
near AS (SELECT a.event_id, a.t, (SELECT count(*) FROM pts b, lim WHERE abs(a.t - b.t) <= e) AS n FROM pts a),
core AS (SELECT *, max(st) OVER (ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS isl FROM (
  SELECT *, CASE WHEN t - lag(t) OVER (ORDER BY t, event_id) <= (SELECT e FROM lim) THEN NULL ELSE t END AS st
  FROM near WHERE n >= {min_samples}))
SELECT event_id, near.t AS outage_time, n AS neighbours,
  coalesce((SELECT min(isl) FROM core c, lim WHERE abs(c.t - near.t) <= e), -1) AS label FROM near"""


def _with_extra(used: str, text: str) -> str:
    """A check whose own tables follow the shared blocks."""
    base = check(f"SELECT 1 FROM {used}")
    return base[: base.rindex("SELECT 1 FROM")].rstrip() + text


@query(None)
def dbscan_time_min5(spark, sf_dir):
    rows = flows.outage_table(spark, sf_dir)
    eps = scaled_eps(rows, "outage_time", 0.005)
    found = clusters_time.dbscan_time(rows, eps=eps, min_samples=5)
    counts = rows.groupBy("outage_time").agg(F.count("*").alias("_n"))
    near = count_within(counts, "outage_time", "_n", int(eps), "neighbours").select("outage_time", "neighbours")
    return found.join(near, "outage_time").select("event_id", "outage_time", big("neighbours").alias("neighbours"), "label")


ORACLES["dbscan_time_min5"] = _with_extra("outs", _MIN5.format(eps=0.005, min_samples=5))

# Brute force: all near pairs, core rows, least reachable core id.
_DENSE = """
, pts AS ({pts}),
near AS (SELECT a.id AS a, b.id AS b FROM pts a JOIN pts b ON {cond}),
core AS (SELECT a AS id FROM near GROUP BY 1 HAVING count(*) >= {min_samples}),
link AS (SELECT a, b FROM near WHERE a IN (FROM core) AND b IN (FROM core)),
reach(a, b) AS (SELECT id, id FROM core UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
own AS (SELECT a AS id, min(b) AS label FROM reach GROUP BY 1)
SELECT p.id AS event_id, coalesce((SELECT min(o.label) FROM near n JOIN own o ON n.b = o.id
    WHERE n.a = p.id AND (p.id NOT IN (FROM core) OR n.b = p.id)), -1) AS label
FROM pts p"""

_PLACED = "SELECT event_id AS id, outage_time AS t, location_longitude AS x, location_latitude AS y FROM outs"


def _st(eps: float, seconds: float, samples: int) -> str:
    cond = (
        f"abs(a.t - b.t) <= {seconds} AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {eps} * {eps}"
    ).replace(f"{eps} * {eps}", f"CAST({eps} AS DOUBLE) * CAST({eps} AS DOUBLE)")
    return _with_extra("outs", _DENSE.format(pts=_PLACED, cond=cond, min_samples=samples))


def _labels(df: DataFrame) -> DataFrame:
    return df.select("event_id", "label")


@query(None)
def st_dbscan(spark, sf_dir):
    return _labels(clusters_space.st_dbscan(flows.outage_table(spark, sf_dir), spatial_eps=0.03, temporal_eps=90))


ORACLES["st_dbscan"] = _st(0.03, 90, 2)


@query(None)
def st_dbscan_min3(spark, sf_dir):
    return _labels(
        clusters_space.st_dbscan(
            flows.outage_table(spark, sf_dir), spatial_eps=0.03, temporal_eps=3600, min_neighbors=3
        )
    )


ORACLES["st_dbscan_min3"] = _st(0.03, 3600, 4)

_SCALED = """SELECT event_id AS id,
  (outage_time - (SELECT avg(outage_time) FROM outs)) / (SELECT stddev_pop(outage_time) FROM outs) AS t,
  (location_latitude - (SELECT avg(location_latitude) FROM outs)) / (SELECT stddev_pop(location_latitude) FROM outs) * {w} AS y,
  (location_longitude - (SELECT avg(location_longitude) FROM outs)) / (SELECT stddev_pop(location_longitude) FROM outs) AS x
FROM outs"""
_BALL = "(a.t - b.t) * (a.t - b.t) + (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) <= {r2}"


@query(None)
def dbscan_features(spark, sf_dir):
    return _labels(clusters_space.dbscan_features(flows.outage_table(spark, sf_dir), eps=0.3, min_samples=5))


ORACLES["dbscan_features"] = _with_extra(
    "outs", _DENSE.format(pts=_SCALED.format(w=1.0), cond=_BALL.format(r2=0.09), min_samples=5)
)


@query(None)
def dbscan_features_weighted(spark, sf_dir):
    return _labels(
        clusters_space.dbscan_features(
            flows.outage_table(spark, sf_dir), eps=0.5, min_samples=2, weights={LAT: 100.0}
        )
    )


ORACLES["dbscan_features_weighted"] = _with_extra(
    "outs", _DENSE.format(pts=_SCALED.format(w=100.0), cond=_BALL.format(r2=0.25), min_samples=2)
)


@query(None)
def st_dbscan_grid(spark, sf_dir):
    rows = flows.outage_table(spark, sf_dir)
    found = clusters_space.grid_dbscan(rows, fixtures.topology(spark, sf_dir), max_distance=2, temporal_eps=3600)
    return _labels(found)


ORACLES["st_dbscan_grid"] = _with_extra(
    "outs, grid",
    """
, placed AS (SELECT event_id AS id, outage_time AS t, o.core_id, transformer, feeder FROM outs o JOIN grid g
  ON o.core_id = g.core_id AND epoch_us(g.st) <= outage_time * 1000000 AND outage_time * 1000000 <= epoch_us(g.et)),
near AS (SELECT a.id AS a, b.id AS b FROM placed a JOIN placed b ON abs(a.t - b.t) <= 3600
  AND (a.core_id = b.core_id OR a.transformer = b.transformer OR a.feeder = b.feeder)),
reach(a, b) AS (SELECT id, id FROM placed UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a),
own AS (SELECT a AS id, min(b) AS least, count(*) AS n FROM reach GROUP BY 1)
SELECT event_id, CASE WHEN n > 1 THEN least ELSE -1 END AS label FROM outs LEFT JOIN own ON event_id = id""",
)
ORACLES["st_dbscan_grid"] = ORACLES["st_dbscan_grid"].replace(
    "CASE WHEN n > 1 THEN least ELSE -1 END", "coalesce(CASE WHEN n > 1 THEN least END, -1)"
)


@query(
    """SELECT week, isl AS first_time, max(t) AS last_time, count(*) AS members, count(DISTINCT core_id) AS sensors
FROM (SELECT *, max(st) OVER (PARTITION BY week ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS isl
  FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY week ORDER BY t, event_id) < 600 THEN NULL ELSE t END AS st
    FROM (SELECT event_id, core_id, outage_time AS t, CAST(weekofyear(make_timestamp(outage_time * 1000000)) AS BIGINT) AS week
      FROM outs))) GROUP BY 1, 2"""
)
def agglomerate_runs(spark, sf_dir):
    """Clusters gathered back into the gap runs they must tile exactly."""
    rows = stage(clusters_time.agglomerate_time(flows.outage_table(spark, sf_dir), max_gap=600))
    rows = rows.withColumn("week", big(iso_week(F.col("outage_time"))))
    runs = islands(rows, "outage_time", 600, keys=["week"], closed=False)
    placed = rows.join(runs, ["week", "outage_time"])
    whole = placed.groupBy("cluster").agg(F.countDistinct("island").alias("runs"))
    # a cluster that crossed a gap would be counted under neither run
    placed = placed.join(whole.filter("runs = 1"), "cluster")
    return placed.groupBy("week", F.col("island").alias("first_time")).agg(
        F.max("outage_time").alias("last_time"), F.count("*").alias("members"), F.countDistinct("core_id").alias("sensors")
    )


@query(None)
def agglomerate_time(spark, sf_dir):
    rows = clusters_time.agglomerate_time(flows.outage_table(spark, sf_dir))
    return rows.select("event_id", "core_id", "outage_time", "cluster", "cluster_time")


# One row per group and round; pruned groups are final and leave the recursion.
_ROUNDS = """
, merged(round, grp, c, ids, first_t, s, n, fin) AS (
  SELECT 0, event_id, outage_time, [event_id], outage_time, CAST(outage_time AS HUGEINT), CAST(1 AS HUGEINT), FALSE FROM outs
  UNION ALL
  SELECT round + 1, min(grp), CAST(sum(s) // sum(n) AS BIGINT), flatten(list(ids)), min(first_t), sum(s), sum(n), alone
  FROM (SELECT *, CASE WHEN alone THEN NULL
      WHEN up < {gap} AND coalesce(up <= up2, TRUE) AND coalesce(up <= down, TRUE) THEN next_c
      WHEN down < {gap} AND coalesce(down <= down2, TRUE) AND coalesce(down <= up, TRUE) THEN c END AS meet
    FROM (SELECT *, lead(c) OVER w AS next_c, lead(c) OVER w - c AS up, lead(c, 2) OVER w - lead(c) OVER w AS up2,
        c - lag(c) OVER w AS down, lag(c) OVER w - lag(c, 2) OVER w AS down2
      FROM (SELECT *, coalesce(lead(c) OVER v - c >= {gap}, TRUE) AND coalesce(c - lag(c) OVER v >= {gap}, TRUE) AS alone
        FROM (SELECT *, weekofyear(make_timestamp(c * 1000000)) AS week FROM merged WHERE NOT fin)
        WINDOW v AS (PARTITION BY week ORDER BY c, grp))
      WINDOW w AS (PARTITION BY week, alone ORDER BY c, grp)))
  GROUP BY round, alone, meet, CASE WHEN meet IS NULL THEN grp END),
agglo AS (SELECT unnest(ids) AS event_id, first_t AS cluster, c AS cluster_time FROM merged WHERE fin)"""
ORACLES["agglomerate_time"] = _with_extra(
    "outs",
    _ROUNDS.format(gap=180)
    + "\nSELECT event_id, core_id, outage_time, cluster, cluster_time FROM agglo JOIN outs USING (event_id)",
)


@query(None)
def agglomerate_time_600(spark, sf_dir):
    """The same with a wider gap, where rounds matter more."""
    rows = clusters_time.agglomerate_time(flows.outage_table(spark, sf_dir), max_gap=600)
    return rows.select("event_id", "cluster", "cluster_time")


ORACLES["agglomerate_time_600"] = _with_extra(
    "outs", _ROUNDS.format(gap=600) + "\nSELECT event_id, cluster, cluster_time FROM agglo"
)


@query(None)
def agglomerate_summary(spark, sf_dir):
    """Cluster table with the population of the day of the cluster's time."""
    rows = stage(clusters_time.agglomerate_time(flows.outage_table(spark, sf_dir)))
    centre = rows.select("cluster", "cluster_time").distinct()
    per = summary.cluster_summary(rows, label="cluster")
    people = population.population(flows.located_readings(spark, sf_dir))
    per = per.drop("sensors_reporting", "cluster_size").join(centre, "cluster")
    per = population.with_population(per, people, t="cluster_time", how="inner")
    per = rel.relative_sizes(per.withColumnRenamed("sensors", "cluster_size"))
    return per.select(
        "cluster", "cluster_time", "cluster_size", "time_range", rnd("time_stddev", 2).alias("outage_times_stddev"),
        rnd("other_mean", 3).alias("restore_times_mean"), "other_range", rnd("other_stddev", 2).alias("restore_times_stddev"),
        big("sensors_reporting").alias("sensors_reporting"), rnd("relative_cluster_size").alias("relative_cluster_size"),
    )


ORACLES["agglomerate_summary"] = _with_extra(
    "outs, outs_people",
    _ROUNDS.format(gap=180)
    + """
SELECT cluster, cluster_time, count(DISTINCT core_id) AS cluster_size, max(outage_time) - min(outage_time) AS time_range,
  round(stddev_pop(outage_time), 2) AS outage_times_stddev, round(avg(restore_time), 3) AS restore_times_mean,
  max(restore_time) - min(restore_time) AS other_range, round(stddev_pop(restore_time), 2) AS restore_times_stddev,
  any_value(p.sensors_reporting) AS sensors_reporting,
  round(count(DISTINCT core_id) / CAST(any_value(p.sensors_reporting) AS DOUBLE), 6) AS relative_cluster_size
FROM agglo JOIN outs USING (event_id) JOIN outs_people p ON p.day_no = cluster_time // 86400 GROUP BY 1, 2""",
)


@query(None)
def optics_time(spark, sf_dir):
    rows = flows.outage_table(spark, sf_dir)
    got = clusters_time.optics_time(rows, max_eps=0.2, min_samples=5, cut=0.1)
    return got.select(
        "period_no", "outage_time", F.col("rows").alias("n_rows"), "core_distance", "reachability", "label"
    )


ORACLES["optics_time"] = _with_extra(
    "outs",
    """
, pts AS (SELECT outage_time AS t, (outage_time - (SELECT min(outage_time) FROM outs)) // 172800 AS p FROM outs),
lim AS (SELECT p, 0.2 * stddev_pop(t) AS e, 0.1 * stddev_pop(t) AS c FROM pts GROUP BY 1),
ranked AS (SELECT a.p, a.t, abs(a.t - b.t) AS d, row_number() OVER (PARTITION BY a.p, a.t ORDER BY abs(a.t - b.t)) AS r
  FROM (SELECT DISTINCT p, t FROM pts) a JOIN pts b ON a.p = b.p),
nodes AS (SELECT q.p, q.t, e, c, (SELECT count(*) FROM pts x WHERE x.t = q.t) AS n,
    CASE WHEN d <= e THEN CAST(d AS DOUBLE) END AS core FROM (SELECT DISTINCT p, t FROM pts) q JOIN lim USING (p)
  LEFT JOIN ranked r ON r.p = q.p AND r.t = q.t AND r.r = 5),
reached AS (SELECT *, (SELECT min(greatest(j.core, q.t - j.t)) FROM nodes j
    WHERE j.p = q.p AND j.t < q.t AND q.t - j.t <= q.e AND j.core IS NOT NULL) AS reach FROM nodes q)
SELECT p AS period_no, t AS outage_time, n AS n_rows, core AS core_distance, reach AS reachability,
  CASE WHEN coalesce(reach > c, TRUE) AND NOT coalesce(core <= c, FALSE) THEN -1
    ELSE max(CASE WHEN coalesce(reach > c, TRUE) AND coalesce(core <= c, FALSE) THEN t END)
      OVER (PARTITION BY p ORDER BY t) END AS label FROM reached""",
)


@query(None)
def optics_xi(spark, sf_dir):
    """Clusters by steep areas, with the parameters' usual values."""
    got = clusters_time.optics_xi(flows.outage_table(spark, sf_dir), max_eps=0.7, min_samples=5, xi=0.05)
    return got.select("period_no", "outage_time", "label", F.col("rows").alias("n_rows"))


# Every steep-down area against every steep-up one after it.
_XI = """
, pts AS (SELECT event_id, outage_time AS t, (outage_time - (SELECT min(outage_time) FROM outs)) // 172800 AS p FROM outs),
lim AS (SELECT p, 0.7 * stddev_pop(t) AS e, CAST(0.95 AS DOUBLE) AS lo FROM pts GROUP BY 1),
line AS (SELECT p, t, e, lo, row_number() OVER (PARTITION BY p ORDER BY t, event_id) AS k FROM pts JOIN lim USING (p)),
apart AS (SELECT a.p, a.k, abs(a.t - b.t) AS d, row_number() OVER (PARTITION BY a.p, a.k ORDER BY abs(a.t - b.t)) AS i
  FROM line a JOIN line b USING (p)),
dense AS (SELECT l.*, CASE WHEN d <= e THEN CAST(d AS DOUBLE) END AS c FROM line l LEFT JOIN apart x ON l.p = x.p AND l.k = x.k AND i = 5),
near AS (SELECT q.p, q.k, min({'v': greatest(j.c, q.t - j.t), 'k': j.k}) AS m FROM dense q JOIN dense j
  ON q.p = j.p AND j.k < q.k AND j.c IS NOT NULL AND q.t - j.t <= q.e GROUP BY 1, 2),
plot AS (SELECT d.p, d.k, d.t, d.lo, coalesce(m.v, CAST('inf' AS DOUBLE)) AS r, m.k AS pred FROM dense d LEFT JOIN near n ON d.p = n.p AND d.k = n.k),
ahead AS (SELECT *, coalesce(lead(r) OVER w, CAST('inf' AS DOUBLE)) AS f, lag(r) OVER w AS b FROM plot WINDOW w AS (PARTITION BY p ORDER BY k)),
ways AS (SELECT *, r < f AND (isinf(f) OR r / f <= lo) AS su, r > f AND (f = 0 OR isinf(r) OR r / f >= 1 / lo) AS sd,
  count(*) FILTER (r < f) OVER w AS ups, count(*) FILTER (r > f) OVER w AS downs FROM ahead WINDOW w AS (PARTITION BY p ORDER BY k)),
steep AS (SELECT p, k, 'd' AS way, ups AS turns FROM ways WHERE sd UNION ALL SELECT p, k, 'u', downs FROM ways WHERE su),
heads AS (SELECT *, CASE WHEN turns = lag(turns) OVER w AND k - lag(k) OVER w <= 6 THEN 0 ELSE 1 END AS head
  FROM steep WINDOW w AS (PARTITION BY p, way ORDER BY k)),
areas AS (SELECT p, way, g, min(k) AS a, max(k) AS z FROM (SELECT *, sum(head) OVER (PARTITION BY p, way ORDER BY k) AS g FROM heads) GROUP BY 1, 2, 3),
pairs AS (SELECT d.p, d.a AS da, d.z AS dz, u.a AS ua, u.z AS uz, s.r AS top, x.f AS after, s.lo,
    (SELECT max(r) FROM plot y WHERE y.p = d.p AND y.k > d.z AND y.k <= u.a) AS between_
  FROM areas d JOIN areas u ON d.p = u.p AND d.way = 'd' AND u.way = 'u' AND d.z < u.a
  JOIN plot s ON s.p = d.p AND s.k = d.a JOIN ahead x ON x.p = u.p AND x.k = u.z),
level AS (SELECT *, CASE WHEN top * lo >= after
      THEN coalesce((SELECT min(k) FROM ahead y WHERE y.p = o.p AND y.k >= o.da AND y.k < o.dz AND y.f <= o.after), dz) ELSE da END AS s,
    CASE WHEN NOT top * lo >= after AND after * lo >= top
      THEN coalesce((SELECT max(k) FROM ahead y WHERE y.p = o.p AND y.k > o.ua AND y.k <= o.uz AND y.b <= o.top), ua) ELSE uz END AS z
  FROM pairs o WHERE between_ <= top * lo AND between_ <= after * lo AND NOT isinf(between_)),
ends AS (SELECT v.p, v.da, v.ua, v.s, max(y.k) AS z FROM level v JOIN plot h ON h.p = v.p AND h.k = v.s
  JOIN plot y ON y.p = v.p AND y.k BETWEEN v.ua AND v.z AND y.k > v.s AND (h.r > y.r OR y.pred >= v.s) GROUP BY 1, 2, 3, 4),
found AS (SELECT p, ua, arg_max(s, da) AS s, arg_max(z, da) AS z FROM ends WHERE z - s + 1 >= 5 GROUP BY 1, 2),
chain AS (SELECT DISTINCT p, CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS z FROM line
  UNION ALL SELECT c.p, n.s, n.z FROM chain c, LATERAL (SELECT s, z FROM found y WHERE y.p = c.p AND y.s > c.z ORDER BY ua LIMIT 1) n)
SELECT l.p AS period_no, l.t AS outage_time, coalesce(h.t, -1) AS label, count(*) AS n_rows
FROM line l LEFT JOIN chain c ON c.p = l.p AND l.k BETWEEN c.s AND c.z LEFT JOIN line h ON h.p = c.p AND h.k = c.s GROUP BY 1, 2, 3"""

ORACLES["optics_xi"] = _with_extra("outs", _XI)


@query(
    """SELECT CAST(week AS BIGINT) AS week, t AS outage_time, count(*) AS n_rows,
  arg_max(lead1, rn) AS lead1, arg_max(lead2, rn) AS lead2, arg_min(lag1, rn) AS lag1, arg_min(lag2, rn) AS lag2
FROM (SELECT week, t, row_number() OVER w AS rn, coalesce(lead(t, 1) OVER w, -1) AS lead1, coalesce(lead(t, 2) OVER w, -1) AS lead2,
    coalesce(lag(t, 1) OVER w, -1) AS lag1, coalesce(lag(t, 2) OVER w, -1) AS lag2
  FROM (SELECT event_id, outage_time AS t, weekofyear(make_timestamp(outage_time * 1000000)) AS week FROM outs)
  WINDOW w AS (PARTITION BY week ORDER BY t, event_id)) GROUP BY 1, 2"""
)
def neighbour_gaps(spark, sf_dir):
    rows = clusters_time.neighbour_gaps(flows.outage_table(spark, sf_dir))
    return rows.select(
        big("week").alias("week"), "outage_time", F.col("rows").alias("n_rows"),
        *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("lead1", "lead2", "lag1", "lag2")],
    )


# --- cluster tables ---------------------------------------------------------------


@query(
    """SELECT label, cluster_size, sensors, min_time, max_time - min_time AS time_range, round(time_stddev, 2) AS time_stddev,
  round(other_mean, 3) AS restore_mean, round(other_stddev, 2) AS restore_stddev, other_range AS restore_range,
  round(lat_range, 6) AS lat_range, round(lon_range, 6) AS lon_range, round(time_mean, 3) AS time_mean,
  CAST(sensors_reporting AS BIGINT) AS sensors_reporting, round(cluster_size / sensors_reporting, 6) AS relative_cluster_size
FROM summ"""
)
def cluster_summary(spark, sf_dir):
    per = rel.relative_sizes(summary.cluster_summary(flows.labelled(spark, sf_dir)))
    return per.select(
        "label", "cluster_size", "sensors", "min_time", "time_range", rnd("time_stddev", 2).alias("time_stddev"),
        rnd("other_mean", 3).alias("restore_mean"), rnd("other_stddev", 2).alias("restore_stddev"),
        F.col("other_range").alias("restore_range"), rnd("lat_range").alias("lat_range"), rnd("lon_range").alias("lon_range"),
        rnd("time_mean", 3).alias("time_mean"), big("sensors_reporting").alias("sensors_reporting"),
        rnd("relative_cluster_size").alias("relative_cluster_size"),
    )


@query(
    """SELECT cluster_size, count(*) AS clusters, round(avg(time_stddev), 2) AS mean_time_stddev FROM summ GROUP BY 1"""
)
def cluster_sizes(spark, sf_dir):
    return summary.size_distribution(summary.cluster_summary(flows.labelled(spark, sf_dir))).select(
        "cluster_size", "clusters", rnd("mean_time_stddev", 2).alias("mean_time_stddev")
    )


@query(
    """SELECT label, count(DISTINCT core_id) AS sensors, CAST(floor(avg(outage_time)) AS BIGINT) AS mean_time,
  CAST(sum(last_event) AS BIGINT) AS last_events, max(since) AS longest_since_first, max(CASE WHEN rn = 2 THEN core_id END) AS second_core
FROM (SELECT *, outage_time - min(outage_time) OVER (PARTITION BY label) AS since,
    row_number() OVER (PARTITION BY label ORDER BY outage_time, event_id) AS rn,
    CASE WHEN row_number() OVER (PARTITION BY label, core_id ORDER BY outage_time DESC, event_id DESC) = 1 THEN event_id ELSE 0 END AS last_event
  FROM outm) GROUP BY 1"""
)
def cluster_rollup(spark, sf_dir):
    """Mean time, latest row per sensor, offsets and the second row of each cluster."""
    rows = summary.clustered(flows.labelled(spark, sf_dir))
    latest = summary.latest_per_sensor(rows).groupBy("label").agg(
        F.count("*").alias("sensors"), F.sum("event_id").alias("last_events")
    )
    offsets = summary.since_first(rows).groupBy("label").agg(
        F.max("since_first").alias("longest_since_first"), big(F.floor(F.avg("outage_time"))).alias("mean_time")
    )
    at = F.struct("outage_time", "event_id")
    first = rows.groupBy("label").agg(F.min(at).alias("_first"))
    second = rows.join(first, "label").filter(at > F.col("_first")).groupBy("label").agg(
        F.min_by("core_id", at).alias("second_core")
    )
    return latest.join(offsets, "label").join(second, "label", "left").select(
        "label", "sensors", "mean_time", "last_events", "longest_since_first", "second_core"
    )


# --- reliability --------------------------------------------------------------------


@query(
    """SELECT count(*) AS members, count(DISTINCT label) AS clusters, (SELECT count(DISTINCT core_id) FROM located) AS sensors,
  round(count(*) / CAST(count(DISTINCT label) * (SELECT count(DISTINCT core_id) FROM located) AS DOUBLE), 8) AS saifi FROM outm"""
)
def saifi(spark, sf_dir):
    got = rel.saifi(flows.labelled(spark, sf_dir), flows.located_readings(spark, sf_dir))
    return got.select("members", "clusters", "sensors", rnd("saifi", 8).alias("saifi"))


@query(None)
def saifi_by_method(spark, sf_dir):
    """The index of three clusterings; agglomerated groups of one do not count."""
    rows = flows.outage_table(spark, sf_dir)
    merged = stage(clusters_time.agglomerate_time(rows))
    several = merged.groupBy("cluster").agg(F.count("*").alias("n")).filter("n > 1").select("cluster")
    found = {
        "time": clusters_time.dbscan_time(rows, eps=90),
        "merged": merged.join(several, "cluster").withColumn("label", F.col("cluster")),
        "space and time": clusters_space.st_dbscan(rows, spatial_eps=0.03, temporal_eps=3600),
    }
    everyone = flows.located_readings(spark, sf_dir)
    parts = [
        rel.saifi(df, everyone).select(F.lit(method).alias("method"), "members", "clusters", rnd("saifi", 8).alias("saifi"))
        for method, df in found.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


ORACLES["saifi_by_method"] = _with_extra(
    "outs, out90, stm, located",
    _ROUNDS.format(gap=180)
    + """
SELECT method, count(*) AS members, count(DISTINCT label) AS clusters,
  round(count(*) / CAST(count(DISTINCT label) * (SELECT count(DISTINCT core_id) FROM located) AS DOUBLE), 8) AS saifi
FROM (SELECT 'time' AS method, label FROM out90 WHERE label <> -1
  UNION ALL SELECT 'space and time', label FROM stm
  UNION ALL SELECT 'merged', cluster FROM (SELECT cluster, count(*) OVER (PARTITION BY cluster) AS n FROM agglo) WHERE n > 1)
GROUP BY 1""",
)


@query(
    """SELECT count(*) AS clusters, round(sum(lasts * n) / avg(people), 4) AS saidi
FROM (SELECT avg(restore_time) - avg(outage_time) AS lasts, count(*) AS n, floor(avg(sensors_reporting)) AS people FROM outm GROUP BY label)"""
)
def saidi_ignore_restore(spark, sf_dir):
    return rel.saidi(flows.labelled(spark, sf_dir)).select("clusters", rnd("saidi", 4).alias("saidi"))


@query("SELECT event_id, label, other_label, round(location_latitude, 6) AS lat FROM pair_or")
def restore_labels(spark, sf_dir):
    rows, _ = flows.paired(spark, sf_dir)
    return rows.select("event_id", "label", "other_label", rnd(LAT).alias("lat"))


@query(
    """SELECT label, count(DISTINCT other_label) AS other_groups, round(avg(CAST(other_label = -1 AS INT)), 6) AS noise_share,
  count(*) AS size FROM pair_or GROUP BY 1"""
)
def label_quality(spark, sf_dir):
    rows, _ = flows.paired(spark, sf_dir)
    return rel.label_quality(rows).select("label", "other_groups", rnd("noise_share").alias("noise_share"), "size")


@query(
    """SELECT r.label AS other_label, r.n AS size, coalesce(p.n, 0) AS held,
  round((1 - coalesce(p.n, 0) / CAST(r.n AS DOUBLE)) * 100, 6) AS percent_outside, round(p.mean, 3) AS held_mean_time
FROM (SELECT label, count(*) AS n FROM restm GROUP BY 1) r
LEFT JOIN (SELECT other_label, count(*) AS n, avg(restore_time) AS mean FROM pair_or WHERE other_label <> -1 GROUP BY 1) p ON r.label = p.other_label"""
)
def restore_outside_share(spark, sf_dir):
    rows, others = flows.paired(spark, sf_dir)
    sizes = rel.other_sizes(rows).select("other_label", rnd("other_mean", 3).alias("held_mean_time"))
    return rel.outside_share(rows, others).join(sizes, "other_label", "left").select(
        "other_label", "size", "held", rnd("percent_outside").alias("percent_outside"), "held_mean_time"
    )


@query(
    """SELECT round(avg(CAST(other_label = -1 AS INT)), 6) AS members_without, (SELECT round(avg(share), 6) FROM (
  SELECT (1 - coalesce(p.n, 0) / CAST(r.n AS DOUBLE)) * 100 AS share
  FROM (SELECT label, count(*) AS n FROM restm GROUP BY 1) r
  LEFT JOIN (SELECT other_label, count(*) AS n FROM pair_or WHERE other_label <> -1 GROUP BY 1) p ON r.label = p.other_label)) AS mean_percent_outside
FROM pair_or"""
)
def noise_shares(spark, sf_dir):
    rows, others = flows.paired(spark, sf_dir)
    outside = rel.outside_share(rows, others).agg(F.avg("percent_outside")).scalar()
    return rows.agg(rnd(F.avg((F.col("other_label") == -1).cast("int"))).alias("members_without")).withColumn(
        "mean_percent_outside", F.round(outside, 6)
    )


def _split_sql(pairs: str, t: str, other: str) -> str:
    return f"""SELECT part, count(*) AS clusters, round(sum(lasts * n) / avg(people), 4) AS saidi
FROM (SELECT label, avg({other}) - avg({t}) AS lasts, floor(avg(sensors_reporting)) AS people FROM {pairs} GROUP BY 1)
JOIN (SELECT label, CASE WHEN other_label = -1 THEN 'noise' ELSE 'clustered' END AS part, count(*) AS n FROM {pairs} GROUP BY 1, 2) USING (label)
GROUP BY 1"""


@query(_split_sql("pair_or", "outage_time", "restore_time"))
def saidi_noise_split(spark, sf_dir):
    rows, _ = flows.paired(spark, sf_dir)
    return rel.saidi_by_noise(rows).select("part", "clusters", rnd("saidi", 4).alias("saidi"))


def _moved_sql(moved: str, means: str, t: str) -> str:
    return f"""SELECT count(*) AS clusters, round(sum(lasts * n) / avg(people), 4) AS saidi
FROM (SELECT label, avg(mean_other) - avg({t}) AS lasts, count(*) AS n, floor(avg(sensors_reporting)) AS people
  FROM {moved} LEFT JOIN ({means}) USING (other_label) GROUP BY 1)"""


@query(_moved_sql("pair_or_intime", "SELECT * FROM pair_or_means", "outage_time"))
def saidi_nearest_time(spark, sf_dir):
    rows, _ = flows.paired(spark, sf_dir)
    moved = rel.nearest_in_time(rows)
    return rel.saidi_reassigned(rows, moved).select("clusters", rnd("saidi", 4).alias("saidi"))


@query(
    _moved_sql(
        "pair_or_inspace",
        "SELECT other_label, avg(restore_time) AS mean_other FROM pair_or_inspace WHERE other_label <> -1 GROUP BY 1",
        "outage_time",
    )
)
def saidi_nearest_space(spark, sf_dir):
    rows, _ = flows.paired(spark, sf_dir)
    moved = stage(rel.nearest_in_space(rows))
    return rel.saidi_reassigned(rows, moved, updated_means=True).select("clusters", rnd("saidi", 4).alias("saidi"))


@query("SELECT event_id, label, other_label FROM pair_or_inspace")
def nearest_space_labels(spark, sf_dir):
    rows, _ = flows.paired(spark, sf_dir)
    return rel.nearest_in_space(rows).select("event_id", "label", "other_label")


@query("SELECT event_id, label, other_label FROM pair_or_intime")
def nearest_time_labels(spark, sf_dir):
    rows, _ = flows.paired(spark, sf_dir)
    return rel.nearest_in_time(rows).select("event_id", "label", "other_label")


@query(
    f"""SELECT 'ignoring' AS part, count(*) AS clusters, round(sum(lasts * n) / avg(people), 4) AS saidi
FROM (SELECT avg(outage_time) - avg(restore_time) AS lasts, count(*) AS n, floor(avg(sensors_reporting)) AS people FROM restm GROUP BY label)
UNION ALL ({_split_sql("pair_ro", "restore_time", "outage_time")})
UNION ALL SELECT 'nearest_time', * FROM ({_moved_sql("pair_ro_intime", "SELECT * FROM pair_ro_means", "restore_time")})
UNION ALL SELECT 'nearest_space', * FROM ({_moved_sql("pair_ro_inspace", "SELECT other_label, avg(outage_time) AS mean_other FROM pair_ro_inspace WHERE other_label <> -1 GROUP BY 1", "restore_time")})"""
)
def saidi_inverse(spark, sf_dir):
    """The indices of restore clusters: the same code with the times swapped."""
    rows, _ = flows.paired(spark, sf_dir, swap=True)
    ends = dict(t="restore_time", other="outage_time")
    whole = rel.saidi(rows, **ends).select(F.lit("ignoring").alias("part"), "clusters", "saidi")
    moved = rel.nearest_in_time(rows, other="outage_time")
    near = rel.saidi_reassigned(rows, moved, **ends).select(F.lit("nearest_time").alias("part"), "clusters", "saidi")
    placed = stage(rel.nearest_in_space(rows, other="outage_time"))
    beside = rel.saidi_reassigned(rows, placed, updated_means=True, **ends)
    near = near.unionByName(beside.select(F.lit("nearest_space").alias("part"), "clusters", "saidi"))
    return whole.unionByName(rel.saidi_by_noise(rows, **ends)).unionByName(near).select(
        "part", "clusters", rnd("saidi", 4).alias("saidi")
    )


@query(
    """SELECT 'day' AS unit, min_time // 86400 * 86400 AS start_s, cluster_size, count(*) AS clusters FROM summ GROUP BY 1, 2, 3
UNION ALL SELECT 'hour', min_time // 3600 * 3600, cluster_size, count(*) FROM summ WHERE cluster_size >= 3 GROUP BY 1, 2, 3
UNION ALL SELECT 'month', epoch_us(date_trunc('month', make_timestamp(min_time * 1000000))) // 1000000, cluster_size, count(*) FROM summ GROUP BY 1, 2, 3"""
)
def outage_size_histograms(spark, sf_dir):
    per = stage(summary.cluster_summary(flows.labelled(spark, sf_dir)))
    parts = [
        rel.size_histogram(per, unit, at_least=3 if unit == "hour" else 1).select(
            F.lit(unit).alias("unit"), epoch(F.col("start")).alias("start_s"), "cluster_size", "clusters"
        )
        for unit in ("day", "hour", "month")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- space --------------------------------------------------------------------------


@query(
    """SELECT label, count(event_id) AS readings, count(DISTINCT (location_latitude, location_longitude)) FILTER (event_id IS NOT NULL) AS places
FROM summ LEFT JOIN (SELECT *, epoch_us(time) // 1000000 AS ts FROM located WHERE NOT is_powered) r
  ON r.ts >= min_time AND r.ts <= max_time GROUP BY 1"""
)
def readings_in_cluster_interval(spark, sf_dir):
    rows = flows.located_readings(spark, sf_dir).filter(~F.col("is_powered")).select(
        epoch(F.col("time")).alias("time_s"), "event_id", F.struct(LAT, LON).alias("place")
    )
    spans = stage(summary.cluster_summary(flows.labelled(spark, sf_dir)).select("label", "min_time", "max_time"))
    return in_intervals(rows, spans, how="left").groupBy("label").agg(
        F.count("event_id").alias("readings"), F.countDistinct("place").alias("places")
    )


def _hull_members(spark, sf_dir):
    return flows.labelled(spark, sf_dir), stage(flows.snapshot(spark, sf_dir))


@query(
    """SELECT label, cluster_size, num_powered, powered_inside, round(percent_powered_inside, 6) AS percent_powered_inside FROM out_in_hull"""
)
def powered_in_hull(spark, sf_dir):
    members, snap = _hull_members(spark, sf_dir)
    counts = hulls.powered_counts(members, snap)
    inside = hulls.powered_in_hull(members, snap).join(counts, "label", "left").fillna(0, ["num_powered"])
    return inside.select(
        "label", "cluster_size", "num_powered", "powered_inside", rnd("percent_powered_inside").alias("percent_powered_inside")
    )


@query(
    """SELECT cluster_size, count(*) AS clusters, round(avg(percent_powered_inside), 6) AS mean_percent FROM out_in_hull GROUP BY 1"""
)
def hull_percent_by_size(spark, sf_dir):
    return hulls.powered_in_hull(*_hull_members(spark, sf_dir)).groupBy("cluster_size").agg(
        F.count("*").alias("clusters"), rnd(F.avg("percent_powered_inside")).alias("mean_percent")
    )


@query(
    """SELECT label, cluster_size, powered_inside, round(percent_powered_inside, 6) AS percent_powered_inside FROM st_in_hull"""
)
def st_dbscan_in_hull(spark, sf_dir):
    """Hulls of clusters that share their minutes with others."""
    rows = stage(clusters_space.st_dbscan(flows.outage_table(spark, sf_dir), spatial_eps=0.03, temporal_eps=3600))
    return hulls.powered_in_hull(rows, stage(flows.snapshot(spark, sf_dir))).select(
        "label", "cluster_size", "powered_inside", rnd("percent_powered_inside").alias("percent_powered_inside")
    )


def _ring(x: tuple[str, str], y: tuple[str, str]) -> str:
    return f"abs(sum({x[0]} * {y[1]} - {x[1]} * {y[0]})) / 2"


def _areas_sql(edges: str, points: str, keys: str) -> str:
    (aax, aay), (abx, aby) = albers_sql("sy", "sx"), albers_sql("ey", "ex")
    (uax, uay), (ubx, uby) = utm_sql("sy", "sx"), utm_sql("ey", "ex")
    return f"""SELECT {keys}, coalesce(deg, 0) AS deg, coalesce(alb, 0) AS alb, coalesce(utm, 0) AS utm
FROM (SELECT DISTINCT {keys} FROM {points}) LEFT JOIN (
  SELECT {keys}, {_ring(('sx', 'ex'), ('sy', 'ey'))} AS deg, {_ring((aax, abx), (aay, aby))} AS alb,
    {_ring((uax, ubx), (uay, uby))} AS utm FROM {edges} WHERE solid GROUP BY {keys}) USING ({keys})"""


@query(
    f"""SELECT label, round(deg, 8) AS area_degrees, round(alb / 1e6, 4) AS area_albers_km2, round(utm / 1e6, 4) AS area_utm_km2
FROM ({_areas_sql('out_hull', 'out_pts', 'label')})"""
)
def hull_area(spark, sf_dir):
    members = summary.clustered(flows.labelled(spark, sf_dir))
    areas = hulls.hull_areas(hulls.convex_hulls(members, ["label"]))
    return areas.select(
        "label", rnd("area_degrees", 8).alias("area_degrees"), rnd(F.col("area_albers_m2") / 1e6, 4).alias("area_albers_km2"),
        rnd(F.col("area_utm_m2") / 1e6, 4).alias("area_utm_km2"),
    )


@query(
    f"""SELECT label, round(abs(alb - utm) / 1e6, 4) AS albers_utm_km2, round(abs(utm - 50000000.0) / 1e6, 4) AS given_utm_km2
FROM ({_areas_sql('out_hull', 'out_pts', 'label')})"""
)
def area_comparison(spark, sf_dir):
    """Areas against each other and against a value given from outside."""
    members = summary.clustered(flows.labelled(spark, sf_dir))
    areas = hulls.hull_areas(hulls.convex_hulls(members, ["label"]))
    given = 50000000.0
    return areas.select(
        "label",
        rnd(F.abs(F.col("area_albers_m2") - F.col("area_utm_m2")) / 1e6, 4).alias("albers_utm_km2"),
        rnd(F.abs(F.col("area_utm_m2") - given) / 1e6, 4).alias("given_utm_km2"),
    )


@query(
    f"""SELECT minute AS minute_s, round(o / 1e6, 4) AS outage_km2, round(p / 1e6, 4) AS powered_km2,
  round(CASE WHEN o + p > 0 THEN o / (o + p) * 100 END, 4) AS percent_area_out
FROM (SELECT minute, max(CASE WHEN kind = 'outage' THEN alb END) AS o, max(CASE WHEN kind = 'powered' THEN alb END) AS p
  FROM ({_areas_sql('spot_hull', 'spot_pts', 'minute, kind')}) GROUP BY 1)"""
)
def percent_area_out(spark, sf_dir):
    areas = hulls.percent_area_out(flows.places(spark, sf_dir))
    return areas.select(
        epoch(F.col("minute")).alias("minute_s"), rnd(F.col("outage_m2") / 1e6, 4).alias("outage_km2"),
        rnd(F.col("powered_m2") / 1e6, 4).alias("powered_km2"), rnd("percent_area_out", 4).alias("percent_area_out"),
    )


@query(
    """SELECT label, round(abs(sum(x * ny - nx * y)) / 2, 8) AS listed_area FROM (
  SELECT label, x, y, coalesce(lead(x) OVER w, first(x) OVER w) AS nx, coalesce(lead(y) OVER w, first(y) OVER w) AS ny
  FROM (SELECT label, outage_time, event_id, location_longitude AS x, location_latitude AS y FROM outm)
  WINDOW w AS (PARTITION BY label ORDER BY outage_time, event_id)) GROUP BY 1"""
)
def listed_area(spark, sf_dir):
    members = summary.clustered(flows.labelled(spark, sf_dir))
    return hulls.listed_area(members, "label", ["outage_time", "event_id"]).select(
        "label", rnd("listed_area", 8).alias("listed_area")
    )


_AX, _AY = albers_sql("location_latitude", "location_longitude")
_UX, _UY = utm_sql("location_latitude", "location_longitude")


@query(
    f"""SELECT core_id, round({_AX}, 3) AS albers_x, round({_AY}, 3) AS albers_y, round({_UX}, 3) AS utm_x, round({_UY}, 3) AS utm_y,
  round(6378137.0 * radians(location_longitude), 3) AS mercator_x,
  round(6378137.0 * (asinh(tan(radians(location_latitude))) - 0.0818191908426215 * atanh(0.0818191908426215 * sin(radians(location_latitude)))), 3) AS mercator_y
FROM deployment"""
)
def projected_locations(spark, sf_dir):
    lat, lon = F.col(LAT), F.col(LON)
    named = {}
    for name, (x, y) in {
        "albers": geo.albers(lat, lon), "utm": geo.utm(lat, lon), "mercator": geo.world_mercator(lat, lon)
    }.items():
        named |= {f"{name}_x": rnd(x, 3), f"{name}_y": rnd(y, 3)}
    return fixtures.deployments(spark, sf_dir).select("core_id", *[c.alias(n) for n, c in named.items()])


# --- distributions --------------------------------------------------------------------


_HIST = """SELECT least(CAST(floor((v - lo) / ((hi - lo) / {bins})) AS BIGINT) + 1, {bins}) AS bucket, count(*) AS n,
  round(min(v), 6) AS least, round(max(v), 6) AS most
FROM (SELECT CAST({v} AS DOUBLE) AS v FROM {src}) a, (SELECT CAST(min({v}) AS DOUBLE) AS lo, CAST(max({v}) AS DOUBLE) AS hi FROM {src}) b GROUP BY 1"""


def _hist(df, col, bins):
    return evaluation.histogram(df, col, bins).select("bucket", "n", rnd("least").alias("least"), rnd("most").alias("most"))


@query(_HIST.format(v="max_time - min_time", src="summ", bins=30))
def histogram_time_range(spark, sf_dir):
    return _hist(stage(summary.cluster_summary(flows.labelled(spark, sf_dir))), "time_range", 30)


@query(_HIST.format(v="restore_time - outage_time", src="outs", bins=40))
def histogram_duration(spark, sf_dir):
    rows = flows.outage_table(spark, sf_dir).withColumn("lasts", F.col("restore_time") - F.col("outage_time"))
    return _hist(rows, "lasts", 40)


_CURVE = """
, gaps AS (SELECT CASE WHEN t = pt OR t = nt THEN 0 ELSE least(coalesce(t - pt, nt - t), coalesce(nt - t, t - pt)) END AS d FROM (
  SELECT t, lag(t) OVER (ORDER BY t) AS pt, lead(t) OVER (ORDER BY t) AS nt FROM (SELECT outage_time AS t FROM outs))),
ranked AS (SELECT d, row_number() OVER (ORDER BY d DESC) AS r FROM gaps),
curve AS (SELECT d AS distance, count(*) AS n, min(r) AS rank_from, max(r) AS rank_to FROM ranked GROUP BY 1)"""


@query(None)
def k_distance(spark, sf_dir):
    curve = evaluation.k_distance(flows.outage_table(spark, sf_dir))
    return curve.select("distance", F.col("rows").alias("n"), big("rank_from").alias("rank_from"), big("rank_to").alias("rank_to"))


ORACLES["k_distance"] = _with_extra("outs", _CURVE + "\nSELECT * FROM curve")


@query(None)
def knee(spark, sf_dir):
    curve = stage(evaluation.k_distance(flows.outage_table(spark, sf_dir)))
    return evaluation.knee(curve).select(big("knee_rank").alias("knee_rank"), "knee_distance", rnd("drop", 8).alias("drop"))


ORACLES["knee"] = _with_extra(
    "outs",
    _CURVE
    + """
SELECT r AS knee_rank, d AS knee_distance, round(1 - y - x, 8) AS "drop" FROM (
  SELECT r, d, (r - 1) / CAST((SELECT max(r) - 1 FROM ranked) AS DOUBLE) AS x,
    (d - (SELECT min(d) FROM gaps)) / CAST((SELECT max(d) - min(d) FROM gaps) AS DOUBLE) AS y FROM ranked)
ORDER BY 1 - y - x DESC, r LIMIT 1""",
)


@query(None)
def kneedle(spark, sf_dir):
    """The first knees by sensitivity, the least one as used on these curves."""
    curve = stage(evaluation.k_distance(flows.outage_table(spark, sf_dir)))
    found = [
        evaluation.kneedle(curve, sensitivity=s).select(
            F.lit(s).alias("sensitivity"), "knee_rank", "knee_distance", rnd("drop", 8).alias("drop")
        )
        for s in (0.001, 1.0, 50.0)
    ]
    return found[0].unionByName(found[1]).unionByName(found[2])


# Rank by rank: extremes of the difference curve, then the thresholds they set.
_KNEEDLE = """
, ends AS (SELECT max(r) - 1 AS steps, min(d) AS lo, max(d) AS hi FROM ranked),
diff AS (SELECT r, d, 1 - (d - lo) / CAST(hi - lo AS DOUBLE) - (r - 1) / CAST(steps AS DOUBLE) AS y, steps FROM ranked, ends),
turns AS (SELECT *, lead(y) OVER w AS f, y >= coalesce(lag(y) OVER w, y) AND y >= coalesce(lead(y) OVER w, y) AS top,
  y <= coalesce(lag(y) OVER w, y) AND y <= coalesce(lead(y) OVER w, y) AS low FROM diff WINDOW w AS (ORDER BY r)),
each AS (SELECT t.*, s.s FROM turns t, (SELECT unnest([0.001, 1, 50]::DOUBLE[]) AS s) s),
held AS (SELECT *, last_value(CASE WHEN low THEN 0 WHEN top THEN y - s / steps END IGNORE NULLS) OVER w AS threshold,
  last_value(CASE WHEN top THEN r END IGNORE NULLS) OVER w AS knee FROM each
  WINDOW w AS (PARTITION BY s ORDER BY r ROWS UNBOUNDED PRECEDING)),
first AS (SELECT s, arg_min(knee, r) AS knee FROM held WHERE knee IS NOT NULL AND f < threshold GROUP BY 1)
SELECT s AS sensitivity, knee AS knee_rank, CAST(d AS DOUBLE) AS knee_distance, round(y, 8) AS "drop" FROM first JOIN diff ON r = knee"""

ORACLES["kneedle"] = _with_extra("outs", _CURVE + _KNEEDLE)


@query(None)
def fit_curve(spark, sf_dir):
    """Gradient descent on the scaled k-distance curve, one point per run."""
    curve = stage(evaluation.k_distance(flows.outage_table(spark, sf_dir)))
    top = curve.agg(F.struct(F.max("rank_to").alias("r"), F.max("distance").alias("d"))).scalar()
    scaled = curve.select(
        (F.col("rank_from") / top["r"]).alias("x"), (F.col("distance") / top["d"]).alias("y"), F.col("rows").alias("w")
    )
    return evaluation.fit_curve(scaled, "x", "y", "w").select(
        "step", rnd("a").alias("a"), rnd("b").alias("b"), rnd("loss").alias("loss")
    )


_STEPS = """
, xy AS (SELECT rank_from / CAST((SELECT max(rank_to) FROM curve) AS DOUBLE) AS x,
    distance / CAST((SELECT max(distance) FROM curve) AS DOUBLE) AS y, n AS w FROM curve),
descent(step, a, b) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) UNION ALL
  SELECT step + 1, any_value(a) + 0.2 * sum(w * (y - x * a - sin(x * b)) * x) / sum(w),
    any_value(b) + 0.2 * sum(w * (y - x * a - sin(x * b)) * x * cos(x * b)) / sum(w)
  FROM descent, xy WHERE step < 20 GROUP BY step)
SELECT step, round(a, 6) AS a, round(b, 6) AS b, round(CASE WHEN step < 20 THEN (
  SELECT sum(w * (y - a) * (y - a)) / sum(w) FROM xy) END, 6) AS loss FROM descent"""
ORACLES["fit_curve"] = _with_extra("outs", _CURVE + _STEPS)

_KDE = """
, pts AS ({pts}),
stat AS (SELECT sum(w) AS n, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM pts),
band AS (SELECT any_value(n) AS n, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy,
  pow(any_value(n), -1.0 / 6) * sqrt(sum(w * pow(x - mx, 2)) / (any_value(n) - 1)) AS wx,
  pow(any_value(n), -1.0 / 6) * sqrt(sum(w * pow(y - my, 2)) / (any_value(n) - 1)) AS wy FROM pts, stat)
SELECT i AS ix, j AS iy, round(sum(w * exp(-0.5 * pow((lx - 3 * wx + i * (hx - lx + 6 * wx) / 15 - x) / wx, 2)
    - 0.5 * pow((ly - 3 * wy + j * (hy - ly + 6 * wy) / 15 - y) / wy, 2))) / any_value(n * 2 * pi() * wx * wy), 6) AS density
FROM pts, band, range(16) a(i), range(16) b(j) GROUP BY 1, 2"""


def _sites(spark, sf_dir) -> DataFrame:
    rows = flows.outage_table(spark, sf_dir)
    return rows.groupBy(F.col(LON).alias("lon"), F.col(LAT).alias("lat")).agg(
        F.countDistinct("outage_time").alias("times")
    )


_SITES = "SELECT location_longitude AS x, location_latitude AS y, {w} AS w FROM outs GROUP BY 1, 2"


@query(None)
def kde_grid(spark, sf_dir):
    return evaluation.kde_grid(_sites(spark, sf_dir)).select("ix", "iy", rnd("density").alias("density"))


ORACLES["kde_grid"] = _with_extra("outs", _KDE.format(pts=_SITES.format(w="1.0::DOUBLE")))


@query(None)
def kde_grid_weighted(spark, sf_dir):
    return evaluation.kde_grid(_sites(spark, sf_dir), weight="times").select("ix", "iy", rnd("density").alias("density"))


ORACLES["kde_grid_weighted"] = _with_extra(
    "outs", _KDE.format(pts=_SITES.format(w="count(DISTINCT outage_time)::DOUBLE"))
)


@query(None)
def kde_time(spark, sf_dir):
    """Density of outage times, in units of a day."""
    rows = flows.outage_table(spark, sf_dir).withColumn("day", F.col("outage_time") / 86400)
    return evaluation.kde_line(rows, "day").select("ix", rnd("gx").alias("day"), rnd("density").alias("density"))


ORACLES["kde_time"] = _with_extra(
    "outs",
    """
, pts AS (SELECT outage_time / 86400.0::DOUBLE AS x FROM outs),
band AS (SELECT count(*)::DOUBLE AS n, min(x) AS lx, max(x) AS hx, pow(count(*)::DOUBLE, -0.2) * stddev_samp(x) AS b FROM pts)
SELECT i AS ix, round(any_value(lx - 3 * b + i * (hx - lx + 6 * b) / 31), 6) AS day,
  round(sum(exp(-0.5 * pow((lx - 3 * b + i * (hx - lx + 6 * b) / 31 - x) / b, 2))) / any_value(n * b * sqrt(2 * pi())), 6) AS density
FROM pts, band, range(32) r(i) GROUP BY 1""",
)


@query(None)
def silhouette_time(spark, sf_dir):
    got = evaluation.silhouette_time(flows.labelled(spark, sf_dir))
    return got.select(F.col("rows").alias("n_rows"), "labels", rnd("silhouette", 8).alias("silhouette"))


ORACLES["silhouette_time"] = _with_extra(
    "outc",
    """
, far AS (SELECT p.event_id, p.label, q.label AS other, count(*) AS n, sum(abs(p.outage_time - q.outage_time)) AS s
  FROM outc p, outc q GROUP BY 1, 2, 3),
score AS (SELECT event_id, label, max(CASE WHEN label = other THEN n END) AS n,
    max(CASE WHEN label = other AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN label <> other THEN s / n END) AS b
  FROM far GROUP BY 1, 2)
SELECT count(*) AS n_rows, count(DISTINCT label) AS labels,
  round(avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 8) AS silhouette FROM score""",
)


@query(
    """SELECT * FROM (SELECT 'longest' AS kind, event_id, restore_time - outage_time AS lasts FROM outs
  QUALIFY rank() OVER (ORDER BY restore_time - outage_time DESC) = 1)
UNION ALL SELECT * FROM (SELECT 'shortest', event_id, restore_time - outage_time FROM outs
  QUALIFY rank() OVER (ORDER BY restore_time - outage_time) = 1)
UNION ALL SELECT * FROM (SELECT 'first five', event_id, restore_time - outage_time FROM outs ORDER BY outage_time, event_id LIMIT 5)"""
)
def extreme_outages(spark, sf_dir):
    """Rows at the extremes, ties included, and the first five in time."""
    rows = flows.outage_table(spark, sf_dir).withColumn("lasts", F.col("restore_time") - F.col("outage_time"))
    ends = rows.agg(F.struct(F.min("lasts").alias("lo"), F.max("lasts").alias("hi"))).scalar()
    pick = lambda kind, df: df.select(F.lit(kind).alias("kind"), "event_id", "lasts")
    return (
        pick("longest", rows.filter(F.col("lasts") == ends["hi"]))
        .unionByName(pick("shortest", rows.filter(F.col("lasts") == ends["lo"])))
        .unionByName(pick("first five", rows.orderBy("outage_time", "event_id").limit(5)))
    )


@query(
    """SELECT event_id, outage_time, outage_time <= lo + 172800 AS in_two_days,
  location_longitude > x1 AND location_longitude < x2 AND location_latitude > y1 AND location_latitude < y2 AS in_box
FROM outs, (SELECT min(outage_time) AS lo, min(location_longitude) AS x1, max(location_longitude) AS x2,
  min(location_latitude) AS y1, max(location_latitude) AS y2 FROM outs)"""
)
def slices(spark, sf_dir):
    """Which outages fall into the first two days, and strictly inside the
    bounding box of all."""
    rows = flows.outage_table(spark, sf_dir)
    box = rows.agg(
        F.struct(
            F.min("outage_time").alias("t"), F.min(LON).alias("x1"), F.max(LON).alias("x2"),
            F.min(LAT).alias("y1"), F.max(LAT).alias("y2"),
        )
    ).scalar()
    inside = (F.col(LON) > box["x1"]) & (F.col(LON) < box["x2"]) & (F.col(LAT) > box["y1"]) & (F.col(LAT) < box["y2"])
    return rows.select(
        "event_id", "outage_time", (F.col("outage_time") <= box["t"] + 172800).alias("in_two_days"), inside.alias("in_box")
    )


# --- scalar functions, set operations, input and output -------------------------------


@query(
    """SELECT event_id, epoch_us(date_trunc('minute', time)) // 1000000 AS minute_s, epoch_us(date_trunc('day', time)) // 1000000 AS day_s,
  CAST(weekofyear(time) AS BIGINT) AS week, CASE WHEN is_powered THEN 1 ELSE 0 END::BIGINT AS powered,
  len(list_distinct([core_id, event_id % 10, core_id]))::BIGINT AS ids, greatest(core_id, event_id % 10) - least(core_id, event_id % 10) AS id_range,
  round(gps_satellites / nullif(gps_satellites + CAST(event_id % 3 AS DOUBLE), 0) * 100, 6) AS percent_fix,
  product_id IN (7008, 7009) AS listed, regexp_extract('AC' || event_id, '^[A-Z]*') AS prefix,
  array_to_string(regexp_extract_all(event_id || ',' || core_id, '\\d+'), ';') AS numbers
FROM readings"""
)
def scalar_functions(spark, sf_dir):
    rows = fixtures.readings(spark, sf_dir)
    ids = F.array(F.col("core_id"), F.col("event_id") % 10, F.col("core_id"))
    text = F.concat_ws(",", "event_id", "core_id")
    return rows.select(
        "event_id",
        epoch(F.date_trunc("minute", "time")).alias("minute_s"),
        epoch(F.date_trunc("day", from_epoch(epoch(F.col("time"))))).alias("day_s"),
        big(iso_week(epoch(F.col("time")))).alias("week"),
        big(F.when(F.col("is_powered"), 1).otherwise(0)).alias("powered"),
        big(F.size(F.array_distinct(ids))).alias("ids"),
        (F.array_max(ids) - F.array_min(ids)).alias("id_range"),
        rnd(percent(F.col("gps_satellites"), (F.col("event_id") % 3).cast("double"))).alias("percent_fix"),
        F.col("product_id").isin(7008, 7009).alias("listed"),
        F.regexp_extract(F.concat(F.lit("AC"), F.col("event_id").cast("string")), "^[A-Z]*", 0).alias("prefix"),
        F.array_join(F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0)), ";").alias("numbers"),
    )


@query(
    """SELECT core_id, CASE WHEN core_id IN (SELECT core_id FROM readings) THEN 'read' ELSE 'none' END AS source,
  count(*) AS n FROM deployment GROUP BY 1, 2"""
)
def set_ops(spark, sf_dir):
    """Union onto a typed empty table, distinct, and values taken from a second
    table where it has one."""
    sensors = fixtures.deployments(spark, sf_dir).select("core_id")
    seed = tables.empty(spark, "core_id bigint")
    known = fixtures.readings(spark, sf_dir).select("core_id", F.lit("read").alias("known")).distinct()
    rows = seed.unionByName(sensors)
    return rows.join(known, "core_id", "left").groupBy("core_id", F.coalesce("known", F.lit("none")).alias("source")).agg(
        F.count("*").alias("n")
    )


@query(
    """SELECT event_id, core_id, epoch_us(time) // 1000000 AS time_s FROM readings
WHERE time >= TIMESTAMP '2024-01-01' AND time < TIMESTAMP '2024-02-01'"""
)
def time_predicates_scan(spark, sf_dir):
    """The parallel scan's conditions, one filter each, put together again."""
    rows = fixtures.readings(spark, sf_dir)
    parts = [rows.filter(p) for p in jdbc.time_predicates("2024-01-01", "2024-02-01")]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.select("event_id", "core_id", epoch(F.col("time")).alias("time_s"))


def _day_table(spark, sf_dir) -> str:
    path = f"{run_folder(spark)}/days-{uuid4().hex}"
    lake.write_days(fixtures.readings(spark, sf_dir), path)
    return path


@query(
    """SELECT event_id, core_id, epoch_us(time) // 1000000 AS time_s, is_powered, CAST(site_id AS BIGINT) AS site_id FROM study
WHERE time >= TIMESTAMP '2024-01-05' AND time < TIMESTAMP '2024-01-12'"""
)
def deployed_by_day(spark, sf_dir):
    """A week of deployed readings from a table with a folder per day."""
    rows = lake.deployed_days(spark, _day_table(spark, sf_dir), fixtures.deployments(spark, sf_dir), start="2024-01-05", end="2024-01-12")
    return rows.select("event_id", "core_id", epoch(F.col("time")).alias("time_s"), "is_powered", big("site_id").alias("site_id"))


@query(
    """SELECT s.label, r.event_id, r.core_id FROM readings r JOIN (
  SELECT label, min_time, max_time FROM summ WHERE cluster_size >= 3) s
ON epoch_us(r.time) // 1000000 BETWEEN s.min_time AND s.max_time"""
)
def intervals_by_day(spark, sf_dir):
    """Readings in the intervals of large clusters, from the days that these touch."""
    spans = stage(summary.cluster_summary(flows.labelled(spark, sf_dir))).filter("cluster_size >= 3").select("label", "min_time", "max_time")
    rows = spark.read.parquet(_day_table(spark, sf_dir))
    return lake.in_interval_days(rows, spans).select("label", "event_id", "core_id")


@query("SELECT event_id, core_id, epoch_us(time) // 1000000 AS time_s, round(lat, 6) AS lat, round(lon, 6) AS lon FROM (SELECT *, location_latitude AS lat, location_longitude AS lon FROM located)")
def io_round_trip(spark, sf_dir):
    """Parquet, then CSV with the nested column as JSON and times as text, and back."""
    folder = f"{run_folder(spark)}/export-{uuid4().hex}"
    rows = flows.located_readings(spark, sf_dir).select(
        "event_id", "core_id", F.date_format("time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("time"), F.struct(LAT, LON).alias("place")
    )
    tables.write_parquet(rows, f"{folder}/stage", compression="gzip", max_records=1_000_000)
    tables.write_csv(tables.nested_to_json(tables.read_parquet(spark, f"{folder}/stage")), f"{folder}/csv")
    back = tables.read_csv(spark, f"{folder}/csv", "event_id bigint, core_id bigint, time string, place string")
    back = tables.nested_from_json(back, {"place": f"struct<{LAT}: double, {LON}: double>"})
    return back.select(
        "event_id", "core_id", epoch(parse_time(F.col("time"))).alias("time_s"), rnd(f"place.{LAT}").alias("lat"),
        rnd(f"place.{LON}").alias("lon"),
    )
