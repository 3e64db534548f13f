"""Building blocks of the checking SQL.

Every block is a named common table expression; :func:`check` prepends the ones
a statement needs.
"""

from __future__ import annotations

import re

from amperic.sources.fixtures import DEPLOYMENT_SQL, GRID_SQL, READINGS_SQL

BLOCKS: dict[str, str] = {}


def block(name: str, text: str) -> None:
    BLOCKS[name] = text.strip()


def check(body: str) -> str:
    wanted: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"[a-z_0-9]+", text)):
            if word in BLOCKS and word not in seen:
                seen.add(word)
                visit(BLOCKS[word])
                if word not in wanted:
                    wanted.append(word)

    visit(body)
    ctes = ",\n".join(f"{n} AS ({BLOCKS[n]})" for n in wanted)
    return f"WITH RECURSIVE {ctes}\n{body.strip()}" if ctes else body.strip()


def corrected(edge: str) -> str:
    return (
        f"CASE WHEN millis IS NULL OR {edge} IS NULL OR isnan(millis) OR isnan({edge}) OR {edge} = 0 "
        f"OR {edge} > millis THEN epoch_us(time) ELSE epoch_us(time) - "
        f"(TRY_CAST(trunc(millis) AS BIGINT) - TRY_CAST(trunc({edge}) AS BIGINT)) * 1000 END // 1000000"
    )


def outages_of(src: str, name: str) -> None:
    """Blocks for transitions and outages of a readings block."""
    block(
        f"{name}_edges",
        f"""
SELECT *, {corrected('last_unplug_millis')} AS outage_time, {corrected('last_plug_millis')} AS plugged
FROM (SELECT *, lag(is_powered) OVER (PARTITION BY core_id ORDER BY time, event_id) AS prev FROM {src})
WHERE prev <> is_powered""",
    )
    block(
        name,
        f"""
SELECT core_id, event_id, time, outage_time, restore_time, location_latitude, location_longitude,
  (SELECT p.sensors_reporting FROM {name}_people p WHERE p.day_no = outage_time // 86400) AS sensors_reporting
FROM (SELECT *, lag(is_powered) OVER w AS was, lead(is_powered) OVER w AS nxt, lead(plugged) OVER w AS restore_time
      FROM {name}_edges WINDOW w AS (PARTITION BY core_id ORDER BY time, event_id))
WHERE NOT is_powered AND was AND nxt""",
    )
    block(
        f"{name}_people",
        f"""
SELECT d + k AS day_no, count(DISTINCT core_id) AS sensors_reporting
FROM (SELECT DISTINCT core_id, epoch_us(time) // 86400000000 AS d FROM {src}), range(-4, 6) r(k) GROUP BY 1""",
    )


def time_clusters(src: str, t: str, eps: float, name: str) -> None:
    block(
        name,
        f"""
SELECT * EXCLUDE (st, isl), CASE WHEN count(*) OVER (PARTITION BY isl) >= 2 THEN isl ELSE -1 END AS label
FROM (SELECT *, max(st) OVER (ORDER BY {t}, event_id ROWS UNBOUNDED PRECEDING) AS isl
  FROM (SELECT *, CASE WHEN {t} - lag({t}) OVER (ORDER BY {t}, event_id) <= {eps} THEN NULL ELSE {t} END AS st FROM {src}))""",
    )


def hull_edges(src: str, keys: str, name: str) -> None:
    """Directed hull edges of the distinct points ``(keys, x, y)``: all points on
    the left, none of those on the line outside the edge."""
    ks = [k.strip() for k in keys.split(",")]
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in ks)
    sel = ", ".join(f"a.{k}" for k in ks)
    cross = "(b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x)"
    along = "(p.x - a.x) * (b.x - a.x) + (p.y - a.y) * (b.y - a.y)"
    length = "(b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)"
    block(
        name,
        f"""
SELECT {sel}, a.x AS sx, a.y AS sy, b.x AS ex, b.y AS ey,
  bool_or({cross} > 1e-12) AS solid
FROM {src} a JOIN {src} b ON {on('a', 'b')} AND (a.x <> b.x OR a.y <> b.y) JOIN {src} p ON {on('a', 'p')}
GROUP BY {sel}, a.x, a.y, b.x, b.y
HAVING bool_and({cross} > 1e-12 OR (abs({cross}) <= 1e-12 AND {along} >= -1e-12 AND {along} <= {length} + 1e-12))""",
    )


ALBERS_PARALLELS = (4.0, 8.0)


def albers_sql(lat: str, lon: str) -> tuple[str, str]:
    """Snyder's ellipsoidal Albers, spelled out on radians."""
    import math

    f = 1 / 298.257223563
    e2 = 2 * f - f * f
    e = math.sqrt(e2)

    def q(s):
        return (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    s1, s2 = (math.sin(math.radians(p)) for p in ALBERS_PARALLELS)
    m1, m2 = ((1 - s * s) / (1 - e2 * s * s) for s in (s1, s2))
    n = (m1 - m2) / (q(s2) - q(s1))
    c = m1 + n * q(s1)
    a = 6378137.0
    s = f"sin(radians({lat}))"
    ql = f"({1 - e2!r} * ({s} / (1 - {e2!r} * {s} * {s}) - ln((1 - {e!r} * {s}) / (1 + {e!r} * {s})) / {2 * e!r}))"
    rho = f"({a / n!r} * sqrt({c!r} - {n!r} * {ql}))"
    theta = f"({n!r} * radians({lon}))"
    return f"{rho} * sin({theta})", f"({a / n * math.sqrt(c)!r} - {rho} * cos({theta}))"


def utm_sql(lat: str, lon: str) -> tuple[str, str]:
    """Transverse Mercator series of zone 30 north, spelled out."""
    f = 1 / 298.257223563
    e2 = 2 * f - f * f
    p2 = e2 / (1 - e2)
    phi = f"radians({lat})"
    n = f"(6378137.0 / sqrt(1 - {e2!r} * pow(sin({phi}), 2)))"
    t = f"pow(tan({phi}), 2)"
    c = f"({p2!r} * pow(cos({phi}), 2))"
    a = f"(radians({lon} + 3.0) * cos({phi}))"
    m = (
        f"(6378137.0 * ({1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256!r} * {phi}"
        f" - {3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024!r} * sin(2 * {phi})"
        f" + {15 * e2**2 / 256 + 45 * e2**3 / 1024!r} * sin(4 * {phi}) - {35 * e2**3 / 3072!r} * sin(6 * {phi})))"
    )
    x = (
        f"(500000 + 0.9996 * {n} * ({a} + (1 - {t} + {c}) * pow({a}, 3) / 6"
        f" + (5 - 18 * {t} + {t} * {t} + 72 * {c} - {58 * p2!r}) * pow({a}, 5) / 120))"
    )
    y = (
        f"(0.9996 * ({m} + {n} * tan({phi}) * (pow({a}, 2) / 2 + (5 - {t} + 9 * {c} + 4 * {c} * {c}) * pow({a}, 4) / 24"
        f" + (61 - 58 * {t} + {t} * {t} + 600 * {c} - {330 * p2!r}) * pow({a}, 6) / 720)))"
    )
    return x, y


block("readings", READINGS_SQL.format(events="events"))
block("deployment", DEPLOYMENT_SQL.format(customer="customer"))
block("core_grid", GRID_SQL.format(deployment="deployment", events="events"))
block(
    "spans",
    """
SELECT core_id, location_latitude, location_longitude, TRY_CAST(site_id AS INTEGER) AS site_id,
  coalesce(deployment_start_time, TIMESTAMP '1970-01-01') AS st,
  coalesce(deployment_end_time, TIMESTAMP '9999-01-01') AS et FROM deployment""",
)
block(
    "located",
    """
SELECT r.*, s.location_latitude, s.location_longitude, s.site_id
FROM readings r JOIN spans s ON r.core_id = s.core_id AND r.time >= s.st AND r.time <= s.et""",
)
block("study", "SELECT * FROM located WHERE site_id < 100 AND product_id IN (7008, 7009, 7010, 7011, 8462)")
outages_of("study", "study_out")
outages_of("located", "outs")
time_clusters("outs", "outage_time", 90, "out90")
time_clusters("outs", "restore_time", 90, "rest90")
time_clusters("outs", "outage_time", 600, "outc")
time_clusters("outs", "restore_time", 600, "restc")
block("outm", "SELECT * FROM outc WHERE label <> -1")
block("restm", "SELECT * FROM restc WHERE label <> -1")
block(
    "snap",
    """
SELECT m - k * 60 AS minute, core_id, arg_min(location_latitude, time) AS lat, arg_min(location_longitude, time) AS lon
FROM (SELECT *, epoch_us(time) // 60000000 * 60 AS m FROM located), range(0, 4) r(k)
GROUP BY 1, 2 HAVING bool_and(is_powered)""",
)
block(
    "maj",
    """
SELECT m - k * 60 + 150 AS t, core_id,
  CASE WHEN sum(CAST(is_powered AS INT)) * 2 > count(*) THEN 1 ELSE 0 END AS is_powered,
  arg_min(location_latitude, time) AS lat, arg_min(location_longitude, time) AS lon
FROM (SELECT *, (epoch_us(time) - 30000000) // 60000000 * 60 + 30 AS m FROM located), range(0, 5) r(k) GROUP BY 1, 2""",
)
block("spot_on", "SELECT DISTINCT t AS minute, lon, lat FROM maj WHERE is_powered = 1")
block(
    "spot_off",
    "SELECT DISTINCT outage_time // 60 * 60 AS minute, location_longitude AS lon, location_latitude AS lat FROM outs",
)
block(
    "spot_clear",
    """
SELECT * FROM spot_on a WHERE minute IN (SELECT minute FROM spot_off)
  AND NOT EXISTS (SELECT 1 FROM spot_off b WHERE a.minute = b.minute AND a.lon = b.lon AND a.lat = b.lat)""",
)
block(
    "spots",
    """
SELECT *, 'powered' AS kind FROM spot_clear UNION ALL
SELECT *, 'outage' FROM spot_off WHERE minute IN (SELECT minute FROM spot_clear)""",
)


def paired_blocks(name: str, here: str, there: str, t: str, other: str) -> None:
    """Members of one clustering with the label of their other end."""
    block(
        name,
        f"""
SELECT m.*, coalesce(CASE WHEN e.n = 1 THEN e.label END, -1) AS other_label
FROM {here} m
LEFT JOIN (SELECT core_id, {t}, arg_min({other}, (epoch_us(time), event_id)) AS far FROM outs GROUP BY 1, 2) f
  ON m.core_id = f.core_id AND m.{t} = f.{t}
LEFT JOIN (SELECT core_id, {other}, count(*) AS n, min(label) AS label FROM {there} GROUP BY 1, 2) e
  ON m.core_id = e.core_id AND f.far = e.{other}""",
    )
    block(
        f"{name}_means",
        f"SELECT other_label, avg({other}) AS mean_other FROM {name} WHERE other_label <> -1 GROUP BY 1",
    )
    block(
        f"{name}_intime",
        f"""
SELECT p.* REPLACE (CASE WHEN other_label = -1 THEN coalesce((SELECT m.other_label FROM {name}_means m
  ORDER BY abs(m.mean_other - p.{other}), m.other_label LIMIT 1), -1) ELSE other_label END AS other_label)
FROM {name} p""",
    )


paired_blocks("pair_or", "outm", "restm", "outage_time", "restore_time")
paired_blocks("pair_ro", "restm", "outm", "restore_time", "outage_time")
for _name, _other in (("pair_or", "restore_time"), ("pair_ro", "outage_time")):
    block(
        f"{_name}_close",
        f"""
SELECT n.event_id, k.other_label,
  pow(k.location_longitude - n.location_longitude, 2) + pow(k.location_latitude - n.location_latitude, 2) AS d,
  abs(m.mean_other - n.{_other}) AS gap
FROM {_name} n JOIN {_name} k ON n.other_label = -1 AND k.other_label <> -1
JOIN {_name}_means m ON m.other_label = k.other_label""",
    )
    block(
        f"{_name}_inspace",
        f"""
SELECT p.* REPLACE (coalesce(b.other_label, p.other_label) AS other_label) FROM {_name} p LEFT JOIN (
  SELECT event_id, other_label FROM {_name}_close
  QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY d, gap, other_label) = 1) b USING (event_id)""",
    )
block(
    "small",
    """
SELECT label, core_id, outage_time, location_latitude AS lat, location_longitude AS lon,
  count(*) OVER (PARTITION BY label) AS cluster_size,
  row_number() OVER (PARTITION BY label ORDER BY outage_time, event_id) AS rn FROM outm""",
)
block(
    "pairs",
    """
SELECT a.label, a.cluster_size, a.rn AS pair, a.outage_time AS t, a.core_id AS core_1, b.core_id AS core_2,
  a.lat AS lat_1, a.lon AS lon_1, b.lat AS lat_2, b.lon AS lon_2
FROM small a JOIN small b ON a.label = b.label AND a.cluster_size <= 3
  AND ((b.rn = a.rn + 1) OR (a.cluster_size = 3 AND a.rn = 3 AND b.rn = 1))""",
)
block(
    "grid",
    """
SELECT core_id, coalesce(start_time, TIMESTAMP '1970-01-01') AS st, coalesce(end_time, TIMESTAMP '2300-01-01') AS et,
  transformer, feeder, regexp_extract(feeder, '^[A-Z]*') AS substation FROM core_grid""",
)
block(
    "edges",
    """
SELECT a.core_id AS core_1, b.core_id AS core_2, a.st AS st_1, a.et AS et_1,
  greatest(a.st, b.st) AS st, least(a.et, b.et) AS et,
  CASE WHEN a.core_id = b.core_id THEN 0 WHEN a.transformer = b.transformer THEN 1
    WHEN a.feeder = b.feeder THEN 2 WHEN a.substation = b.substation THEN 3 ELSE 4 END AS distance
FROM grid a, grid b WHERE least(a.et, b.et) >= greatest(a.st, b.st)""",
)
_ax, _ay = albers_sql("lat_1", "lon_1")
_bx, _by = albers_sql("lat_2", "lon_2")
block(
    "pair_far",
    f"""
SELECT p.*, sqrt(pow(lon_2 - lon_1, 2) + pow(lat_2 - lat_1, 2)) AS degrees,
  6371000.0 * acos(least(1.0, sin(radians(lat_1)) * sin(radians(lat_2))
    + cos(radians(lat_1)) * cos(radians(lat_2)) * cos(radians(lon_2 - lon_1)))) AS sphere_m,
  sqrt(pow({_ax} - {_bx}, 2) + pow({_ay} - {_by}, 2)) AS projected_m,
  (SELECT min(distance) FROM edges e WHERE e.core_1 = p.core_1 AND e.core_2 = p.core_2
    AND epoch_us(e.st) <= p.t * 1000000 AND p.t * 1000000 <= epoch_us(e.et)) AS grid_distance
FROM pairs p""",
)
block("spot_pts", "SELECT DISTINCT minute, kind, lon AS x, lat AS y FROM spots")
hull_edges("spot_pts", "minute, kind", "spot_hull")


def hull_blocks(name: str, members: str) -> None:
    """Hulls of a clustering and the powered places inside, as ``{name}_in_hull``."""
    block(f"{name}_pts", f"SELECT DISTINCT label, location_longitude AS x, location_latitude AS y FROM {members}")
    hull_edges(f"{name}_pts", "label", f"{name}_hull")
    block(
        f"{name}_powered",
        f"""
SELECT label, core_id, arg_max(lat, s.minute) AS y, arg_max(lon, s.minute) AS x
FROM (SELECT DISTINCT label, outage_time // 60 * 60 AS minute FROM {members}) m JOIN snap s USING (minute)
WHERE NOT EXISTS (SELECT 1 FROM {members} o WHERE o.label = m.label AND o.core_id = s.core_id) GROUP BY 1, 2""",
    )
    block(
        f"{name}_inside",
        f"""
SELECT label, count(*) AS n FROM (SELECT DISTINCT label, x, y FROM {name}_powered) p
WHERE CASE
  WHEN EXISTS (SELECT 1 FROM {name}_hull h WHERE h.label = p.label AND h.solid) THEN NOT EXISTS (
    SELECT 1 FROM {name}_hull h WHERE h.label = p.label
      AND (h.ex - h.sx) * (p.y - h.sy) - (h.ey - h.sy) * (p.x - h.sx) <= 1e-12)
  WHEN EXISTS (SELECT 1 FROM {name}_hull h WHERE h.label = p.label) THEN EXISTS (
    SELECT 1 FROM {name}_hull h WHERE h.label = p.label
      AND abs((h.ex - h.sx) * (p.y - h.sy) - (h.ey - h.sy) * (p.x - h.sx)) <= 1e-12
      AND (p.x - h.sx) * (h.ex - h.sx) + (p.y - h.sy) * (h.ey - h.sy) > 1e-12
      AND (p.x - h.ex) * (h.sx - h.ex) + (p.y - h.ey) * (h.sy - h.ey) > 1e-12)
  ELSE EXISTS (SELECT 1 FROM {name}_pts o WHERE o.label = p.label AND o.x = p.x AND o.y = p.y) END
GROUP BY 1""",
    )
    block(
        f"{name}_in_hull",
        f"""
SELECT label, cluster_size, coalesce(np, 0) AS num_powered, coalesce(n, 0) AS powered_inside,
  coalesce(n, 0) / CAST(coalesce(n, 0) + cluster_size AS DOUBLE) * 100 AS percent_powered_inside
FROM (SELECT label, count(*) AS cluster_size FROM {members} GROUP BY 1)
LEFT JOIN (SELECT label, count(*) AS np FROM {name}_powered GROUP BY 1) USING (label)
LEFT JOIN {name}_inside USING (label)""",
    )


hull_blocks("out", "outm")
block(
    "st_near",
    """
SELECT a.event_id AS a, b.event_id AS b FROM outs a JOIN outs b ON abs(a.outage_time - b.outage_time) <= 3600
  AND (a.location_longitude - b.location_longitude) * (a.location_longitude - b.location_longitude)
    + (a.location_latitude - b.location_latitude) * (a.location_latitude - b.location_latitude)
    <= CAST(0.03 AS DOUBLE) * CAST(0.03 AS DOUBLE)""",
)
block("st_reach", "SELECT a, a AS b FROM st_near UNION SELECT r.a, n.b FROM st_reach r JOIN st_near n ON r.b = n.a")
block(
    "stm",
    """
SELECT o.*, least AS label FROM outs o
JOIN (SELECT a, min(b) AS least, count(*) AS n FROM st_reach GROUP BY 1) r ON r.a = o.event_id AND n > 1""",
)
hull_blocks("st", "stm")
block(
    "summ",
    """
SELECT label, count(*) AS cluster_size, count(DISTINCT core_id) AS sensors, min(outage_time) AS min_time,
  max(outage_time) AS max_time, stddev_pop(outage_time) AS time_stddev, avg(restore_time) AS other_mean,
  stddev_pop(restore_time) AS other_stddev, max(restore_time) - min(restore_time) AS other_range,
  max(location_latitude) - min(location_latitude) AS lat_range,
  max(location_longitude) - min(location_longitude) AS lon_range, avg(outage_time) AS time_mean,
  floor(avg(sensors_reporting)) AS sensors_reporting FROM outm GROUP BY 1""",
)
