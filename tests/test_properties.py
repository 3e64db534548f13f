"""Distributed operators against plain brute force on random small inputs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from amperic.operators import clusters_space, clusters_time, evaluation, halo, hulls, topology
from amperic.operators.components import components
from amperic.operators.intervals import in_intervals
from amperic.operators.kernels import _point_pairs, hull_of, maybe_corners, merge_rounds
from amperic.operators.ordered import count_within, islands, nearest, running, with_slice
from amperic.operators.places import nearest_places
from amperic.operators.reach import Axes


def brute_dbscan(near: np.ndarray, ids: np.ndarray, min_samples: int) -> np.ndarray:
    core = near.sum(1) >= min_samples
    label = np.full(len(ids), -1)
    for i in np.argsort(ids):
        if not core[i] or label[i] >= 0:
            continue
        todo = [i]
        label[i] = ids[i]
        while todo:
            j = todo.pop()
            for k in np.flatnonzero(near[j] & core & (label < 0)):
                label[k] = ids[i]
                todo.append(k)
    out = label.copy()
    for i in np.flatnonzero(~core):
        reach = label[near[i] & core]
        out[i] = reach.min() if len(reach) else -1
    return out


def outage_frame(spark, seed, n, seconds, spots):
    g = np.random.default_rng(seed)
    pdf = pd.DataFrame(
        {
            "event_id": g.permutation(n),
            "core_id": g.integers(0, spots, n),
            "outage_time": g.integers(0, seconds, n),
        }
    )
    where = g.integers(0, 30, (spots, 2)) / 1000
    pdf["location_latitude"] = where[pdf["core_id"], 0]
    pdf["location_longitude"] = where[pdf["core_id"], 1]
    return spark.createDataFrame(pdf), pdf


# a third of all rows at one second and place, dense and sparse mixtures
CASES = [(1, 120, 3000, 12, 1), (2, 150, 600, 40, 3), (3, 200, 300, 25, 5)]


@pytest.mark.parametrize("seed, n, seconds, spots, neighbours", CASES)
def test_st_dbscan(spark, seed, n, seconds, spots, neighbours):
    df, pdf = outage_frame(spark, seed, n, seconds, spots)
    if seed == 3:  # one hot place and second
        pdf.loc[: n // 3, ["outage_time", "location_latitude", "location_longitude"]] = [100, 0.01, 0.01]
        df = spark.createDataFrame(pdf)
    t, y, x = (pdf[c].to_numpy() for c in ("outage_time", "location_latitude", "location_longitude"))
    dx, dy = x[:, None] - x, y[:, None] - y
    near = (dx * dx + dy * dy <= 0.006 * 0.006) & (abs(t[:, None] - t) <= 30)
    want = pd.Series(brute_dbscan(near, pdf["event_id"].to_numpy(), neighbours + 1), pdf["event_id"])
    got = clusters_space.st_dbscan(df, spatial_eps=0.006, temporal_eps=30, min_neighbors=neighbours)
    got = got.toPandas().set_index("event_id")["label"]
    assert (got.reindex(want.index) == want).all()


# parts of a few places, crowded cells, and both
CUTS = [(1000, 6), (1, 20_000), (2, 5)]


@pytest.mark.parametrize("crowded, part", CUTS)
@pytest.mark.parametrize("seed, n, seconds, spots, neighbours", CASES)
def test_parts_and_crowded_cells(spark, seed, n, seconds, spots, neighbours, crowded, part):
    """Links between parts, halo points whose part tells, and crowded cells change nothing."""
    df, pdf = outage_frame(spark, seed + 20, n, seconds, spots)
    t, y, x = (pdf[c].to_numpy() for c in ("outage_time", "location_latitude", "location_longitude"))
    dx, dy = x[:, None] - x, y[:, None] - y
    near = (dx * dx + dy * dy <= 0.008 * 0.008) & (abs(t[:, None] - t) <= 40)
    want = pd.Series(brute_dbscan(near, pdf["event_id"].to_numpy(), neighbours + 1), pdf["event_id"])
    metric = [Axes(("location_longitude", "location_latitude"), 0.008), Axes(("outage_time",), 40.0)]
    got = clusters_space.dbscan(df, metric, neighbours + 1, crowded=crowded, part=part).toPandas()
    assert (got.set_index("event_id")["label"].reindex(want.index) == want).all()


def test_cells_around_a_part_are_never_broadcast(spark):
    """The planner takes cells exploded by dozens of offsets for as few as they came from."""
    cells = [(int(i), int(j)) for i, j in np.random.default_rng(3).integers(0, 12, (60, 2))]
    cells = sorted(set(cells))
    rows = [([i, j], k, 1) for k, (i, j) in enumerate(cells)]
    census = spark.createDataFrame(rows, "cell array<bigint>, node bigint, k bigint")
    metric = [Axes(("x",), 1.0), Axes(("y",), 1.0)]
    df = halo.parts(census, metric, 7)
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    got = [(tuple(r.cell), r.node, r.part, r.own) for r in df.collect()]
    own = {c: p for c, _, p, mine in got if mine}
    near = lambda c: {(c[0] + i, c[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1)}
    around = {(d, p) for c, p in own.items() for d in near(c) if own.get(d, p) != p}
    assert own.keys() == set(cells) and len(set(own.values())) > 2
    assert sorted((c, p) for c, _, p, mine in got if not mine) == sorted(around)
    assert all(cells[node] == c for c, node, _, _ in got)


def test_cells_of_random_clouds():
    """One part, against all pairs: cores, links and border points, own and halo."""
    from amperic.operators.halo import offsets
    from amperic.operators.kernels import least_joined, near_cells

    for seed in range(60):
        g = np.random.default_rng(seed)
        n, samples, eps = int(g.integers(1, 150)), int(g.choice([2, 3, 5])), 1.0
        at = np.unique(g.normal(0, g.choice([0.5, 2, 8]), (n, 3)).round(2), axis=0)
        n = len(at)
        metric = [Axes(("a", "b", "c"), eps)]
        cells = np.floor(at / metric[0].side).astype(np.int64)
        pid, weight = g.permutation(n), g.choice([1, 1, 1, 3], n)
        own = (cells[:, 0] % 3 != 0) if seed % 2 else np.ones(n, bool)
        node = np.array([pid[(cells == c).all(1)].min() for c in cells])
        near = ((at[:, None] - at) ** 2).sum(2) <= eps * eps
        core = near @ weight >= samples if samples > 2 else np.ones(n, bool)
        thick = np.array([weight[(cells == c).all(1)].sum() >= samples for c in cells])
        told, links, maybe, border, unsure = near_cells(
            cells, at, pid, weight, np.zeros(n, np.int64), own, node, axes=[([0, 1, 2], eps)], around=np.array(offsets(metric)), min_samples=samples
        )
        assert dict(zip(told[0], told[1])) == {pid[i]: node[i] for i in np.flatnonzero(own & core)}
        known = own | thick | (samples <= 2)
        row = {p: i for i, p in enumerate(pid)}
        # what the links join is what all pairs of core points join, with an own cell on one side
        wanted = [(i, j) for i in np.flatnonzero(own & core) for j in np.flatnonzero(near[i] & core)]
        links = [(row[a], row[b]) for a, b in zip(links[0], links[1])] + [(row[a], row[q]) for a, q in zip(maybe[0], maybe[1]) if core[row[q]]]
        same = [(i, row[node[i]]) for i in range(n)]  # a cell is one node
        got, want = (least_joined(n, *np.array(e + same, np.int64).reshape(-1, 2).T) for e in (links, [(i, j) for i, j in wanted]))
        for i, j in wanted:
            assert got[i] == got[j], seed
        for i, j in links:
            assert want[i] == want[j], seed
        assert all(not known[row[q]] for q in (*maybe[1], *unsure[1]))
        if samples > 2:
            reach = {(pid[i], node[j]) for i in np.flatnonzero(own & ~core) for j in np.flatnonzero(near[i] & core)}
            assert {*zip(border[0], border[1]), *((p, node[row[q]]) for p, q in zip(unsure[0], unsure[1]) if core[row[q]])} == reach


def test_dense_cells_are_split_not_paired(spark):
    """Two dense blobs just out of reach, then just within."""
    g = np.random.default_rng(5)
    for gap, clusters in ((1.02, 2), (0.95, 1)):
        left = g.uniform(0, 0.3, (150, 2)) * [1, 1]
        right = left * [-1, 1] + [0.6 + gap, 0]
        pdf = pd.DataFrame(np.vstack([left, right]), columns=["x", "y"])
        pdf = pd.concat([pdf, pd.DataFrame({"x": [0.3, 0.3 + gap], "y": [0.1, 0.1]})], ignore_index=True)
        pdf["event_id"] = range(len(pdf))
        got = clusters_space.dbscan(spark.createDataFrame(pdf), [Axes(("x", "y"), 1.0)], 2).toPandas()
        xy = pdf[["x", "y"]].to_numpy()
        near = ((xy[:, None] - xy) ** 2).sum(2) <= 1.0
        assert got.set_index("event_id")["label"].sort_index().tolist() == brute_dbscan(near, np.arange(len(pdf)), 2).tolist()
        assert got["label"].nunique() == clusters


@pytest.mark.parametrize("min_samples, eps", [(2, 20), (4, 25), (6, 60)])
def test_time_dbscan(spark, min_samples, eps):
    df, pdf = outage_frame(spark, 11, 150, 4000, 10)
    t = pdf["outage_time"].to_numpy()
    near = abs(t[:, None] - t) <= eps
    core = near.sum(1) >= min_samples
    brute = brute_dbscan(near, pdf["event_id"].to_numpy(), min_samples)
    start = {l: t[(brute == l) & core].min() for l in set(brute) - {-1}}
    # labels are start seconds here, so a row between two clusters has the earlier
    want = []
    for i in range(len(t)):
        reach = [start[l] for l in set(brute[near[i] & core])]
        want.append(min(reach) if reach else -1)
    got = clusters_time.dbscan_time(df, eps=eps, min_samples=min_samples, width=100).toPandas()
    assert got.set_index("event_id")["label"].reindex(pdf["event_id"]).tolist() == want


def test_time_clusters_equal_unbounded_space(spark):
    df, _ = outage_frame(spark, 12, 120, 3000, 10)
    a = clusters_time.dbscan_time(df, eps=15).select("event_id", F.col("label").alias("a"))
    b = clusters_space.st_dbscan(df, spatial_eps=10.0, temporal_eps=15).select("event_id", F.col("label").alias("b"))
    both = a.join(b, "event_id").toPandas()
    assert ((both["a"] == -1) == (both["b"] == -1)).all()
    good = both[both["a"] != -1]
    assert good.groupby("a")["b"].nunique().max() == 1 and good.groupby("b")["a"].nunique().max() == 1


def rounds_by_rows(times, max_gap):
    """The merge rounds on plain rows, one row per group."""
    active, final = [([t], t) for t in sorted(times)], []
    while active:
        active.sort(key=lambda g: g[1])
        t = [g[1] for g in active]

        def gap(i, j):
            return t[j] - t[i] if 0 <= i and j < len(t) else None

        def far(x):
            return x is None or x >= max_gap

        alone = [far(gap(i, i + 1)) and far(gap(i - 1, i)) for i in range(len(t))]
        final += [g for g, a in zip(active, alone) if a]
        active = [g for g, a in zip(active, alone) if not a]
        t = [g[1] for g in active]
        meet, rest = {}, []
        for i, g in enumerate(active):
            up, up2, down, down2 = gap(i, i + 1), gap(i + 1, i + 2), gap(i - 1, i), gap(i - 2, i - 1)

            def most(x, *others):
                return x is not None and x < max_gap and all(o is None or x <= o for o in others)

            if most(up, up2, down):
                meet.setdefault(t[i + 1], []).append(g)
            elif most(down, down2, up):
                meet.setdefault(t[i], []).append(g)
            else:
                rest.append(g)
        active = rest
        for groups in meet.values():
            all_times = [x for g in groups for x in g[0]]
            active.append((all_times, sum(all_times) // len(all_times)))
    return sorted((sorted(m), c) for m, c in final)


def test_merge_rounds_match_the_row_form():
    g = np.random.default_rng(3)
    for _ in range(400):
        times = g.integers(0, g.integers(5, 900), g.integers(1, 25)).tolist()
        gap = int(g.integers(2, 60))
        t, n = np.unique(times, return_counts=True)
        group, centre, sure = merge_rounds(t, n, gap)
        assert sure.all()
        got = sorted(
            (sorted(np.repeat(t[group == k], n[group == k]).tolist()), int(centre[group == k][0])) for k in set(group)
        )
        assert got == rounds_by_rows(times, gap)


def test_what_is_sure_in_a_slice_is_so_in_the_run():
    """Random runs cut into 2 to 7 slices: sure groups are those of the whole run, and
    what is unsure becomes sure with more around it."""
    told = total = 0
    for seed in range(150):
        g = np.random.default_rng(seed)
        gap, kind = 60, seed % 3
        steps = g.integers(1, [59, 12, 59][kind], int(g.integers(20, 700)))
        if kind == 2:
            steps = np.where(g.random(len(steps)) < 0.7, 1 + steps % 5, steps)
        t = np.cumsum(steps)
        n = g.choice([1, 1, 1, 4], len(t))
        group, centre, _ = merge_rounds(t, n, gap)
        cuts = np.sort(g.choice(np.arange(1, len(t)), int(g.integers(1, 7)), replace=False))
        edges = [0, *cuts.tolist(), len(t)]
        for a, b in zip(edges, edges[1:]):
            for margin in (0, 8, 64, len(t)):
                lo, hi = max(0, a - margin), min(len(t), b + margin)
                part, middle, sure = merge_rounds(t[lo:hi], n[lo:hi], gap, lo > 0, hi < len(t))
                assert (group[lo:hi][sure] == part[sure] + lo).all(), (seed, a, b, margin)
                assert (centre[lo:hi][sure] == middle[sure]).all()
                # a group is sure as a whole
                assert all(sure[part == k].all() or not sure[part == k].any() for k in np.unique(part))
            assert sure.all()
            told += int(merge_rounds(t[a:b], n[a:b], gap, a > 0, b < len(t))[2].sum())
            total += b - a
    assert told > 0.3 * total


@pytest.mark.parametrize("slices, margin", [(2, 1), (7, 1), (5, 64)])
def test_one_run_over_many_slices(spark, slices, margin):
    g = np.random.default_rng(slices)
    times = np.concatenate([np.cumsum(g.integers(1, 170, 900)), 400_000 + np.cumsum(g.integers(1, 9, 300)), [900_000, 900_000]])
    df = spark.createDataFrame([(i, int(t)) for i, t in enumerate(times)] + [(-1, None)], "event_id bigint, outage_time bigint")
    rows = clusters_time.agglomerate_time(df, partition=None, slices=slices, margin=margin).toPandas()
    assert len(rows) == len(times) + 1 and rows["cluster"].isna().sum() == 1
    rows = rows.dropna()
    got = sorted((sorted(p["outage_time"].astype(int)), int(p["cluster_time"].iloc[0])) for _, p in rows.groupby("cluster"))
    t, n = np.unique(times, return_counts=True)
    group, centre, _ = merge_rounds(t, n, 180)
    want = sorted((sorted(np.repeat(t[group == k], n[group == k]).tolist()), int(centre[group == k][0])) for k in set(group))
    assert got == want


def test_agglomeration_by_runs_equals_the_whole(spark):
    g = np.random.default_rng(8)
    times = (1704067200 + g.integers(0, 40000, 300)).tolist()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "event_id bigint, outage_time bigint")
    rows = clusters_time.agglomerate_time(df, max_gap=180).toPandas()
    got = sorted((sorted(p["outage_time"]), int(p["cluster_time"].iloc[0])) for _, p in rows.groupby("cluster"))
    assert got == rounds_by_rows(times, 180)


def test_components(spark):
    g = np.random.default_rng(4)
    edges = g.integers(0, 200, (150, 2)).tolist() + [[i, i + 1] for i in range(300, 360)]
    edges += [[500, 500 + i] for i in range(1, 60)]  # a chain and a star
    parent = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in edges:
        lo, hi = sorted((root(a), root(b)))
        parent[hi] = lo
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.node: r.root for r in components(df).collect()}
    loops = {a for a, b in edges if a == b}
    assert got == {v: root(v) for v in list(parent) if v in got}
    assert set(parent) - set(got) <= loops


def test_islands_per_key_and_gap_kind(spark):
    g = np.random.default_rng(6)
    pdf = pd.DataFrame({"k": g.integers(0, 4, 400), "t": g.integers(-500, 3000, 400)})
    df = spark.createDataFrame(pdf)
    for closed in (True, False):
        got = islands(df, "t", 10, keys=["k"], closed=closed, width=64).toPandas()
        for k, part in pdf.groupby("k"):
            t = np.unique(part["t"])
            cut = np.diff(t) > 10 if closed else np.diff(t) >= 10
            first = np.concatenate([[True], cut])
            want = dict(zip(t, t[np.maximum.accumulate(np.where(first, np.arange(len(t)), 0))]))
            mine = got[got["k"] == k]
            assert dict(zip(mine["t"], mine["island"])) == want


def test_running_and_counting(spark):
    g = np.random.default_rng(7)
    t = np.unique(g.integers(0, 2000, 300))
    pdf = pd.DataFrame({"t": t, "n": g.integers(1, 5, len(t))})
    df = spark.createDataFrame(pdf)
    sliced = with_slice(df, F.col("t"), 128)
    got = running(sliced, ["t"], "n", "sum", "s").toPandas().sort_values("t")
    assert got["s"].tolist() == pdf["n"].cumsum().tolist()
    back = running(sliced, ["t"], "n", "sum", "s", backward=True, exclusive=True).toPandas().sort_values("t")
    assert back["s"].tolist() == (pdf["n"].sum() - pdf["n"].cumsum()).tolist()
    near = count_within(df, "t", "n", 33, "c", width=100).toPandas().sort_values("t")
    want = [(pdf["n"] * (abs(pdf["t"] - v) <= 33)).sum() for v in t]
    assert near["c"].tolist() == want


def test_nearest_in_time(spark):
    g = np.random.default_rng(9)
    asks = pd.DataFrame({"k": g.integers(0, 3, 200), "t": g.integers(0, 5000, 200)})
    marks = pd.DataFrame({"k": g.integers(0, 3, 40), "label": range(40), "m": g.integers(0, 10000, 40) / 2})
    got = nearest(spark.createDataFrame(asks), spark.createDataFrame(marks), "t", "m", "label", keys=["k"], width=300).toPandas()
    assert len(got) == len(asks.drop_duplicates())
    for r in got.itertuples():
        near = marks[marks["k"] == r.k].assign(d=lambda x: abs(x["m"] - r.t)).sort_values(["d", "label"]).iloc[0]
        assert (r.nearest_label, r.nearest_gap) == (near["label"], near["d"])


def test_nearest_places(spark):
    g = np.random.default_rng(10)
    asks = g.integers(0, 60, (80, 2)) / 8
    spots = np.unique(g.integers(0, 60, (150, 2)) / 8, axis=0)
    a = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(asks)], "ask_id bigint, x double, y double")
    s = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(spots)], "place_id bigint, x double, y double")
    got = {}
    for r in nearest_places(a, s).collect():
        got.setdefault(r.ask_id, set()).add(r.place_id)
    d = ((asks[:, None] - spots) ** 2).sum(2)
    assert got == {i: set(np.flatnonzero(d[i] == d[i].min())) for i in range(len(asks))}


@pytest.mark.parametrize("held", [1, 3, 1000])
def test_nearest_places_far_and_crowded(spark, held):
    """A dense spot, lone places, asks far outside, on places, and one place alone."""
    g = np.random.default_rng(21)
    spots = np.unique(np.vstack([g.normal(0, 0.001, (120, 2)).round(5), g.uniform(-50, 50, (12, 2)).round(3)]), axis=0)
    asks = np.vstack([g.normal(0, 0.002, (40, 2)).round(5), g.uniform(-60, 60, (30, 2)).round(3), [[1e4, -1e4], [-1e6, 0]], spots[:10]])
    schema = "{}_id bigint, x double, y double"
    a = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(asks)] + [(999, None, 1.0)], schema.format("ask"))
    s = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(spots)], schema.format("place"))
    got = {}
    for r in nearest_places(a, s, held=held).collect():
        got.setdefault(r.ask_id, set()).add(r.place_id)
    gap = np.abs(asks[:, None] - spots)
    d = gap[..., 0] * gap[..., 0] + gap[..., 1] * gap[..., 1]
    assert got == {i: set(np.flatnonzero(d[i] == d[i].min())) for i in range(len(asks))}
    assert {r.place_id for r in nearest_places(a, s.filter("place_id = 5")).collect()} == {5}
    assert nearest_places(a, s.limit(0)).count() == 0


def test_intervals_match_a_full_comparison(spark):
    g = np.random.default_rng(13)
    rows = pd.DataFrame({"time_s": g.integers(0, 9000, 300), "id": range(300)})
    spans = pd.DataFrame({"k": range(40), "min_time": g.integers(0, 9000, 40)})
    spans["max_time"] = spans["min_time"] + g.integers(0, 3000, 40)
    got = in_intervals(spark.createDataFrame(rows), spark.createDataFrame(spans)).select("k", "id").collect()
    want = {(s.k, r.id) for s in spans.itertuples() for r in rows.itertuples() if s.min_time <= r.time_s <= s.max_time}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_hull_holds_every_point():
    g = np.random.default_rng(14)
    for n in (1, 2, 3, 10, 200):
        x, y = g.integers(0, 40, n) / 4, g.integers(0, 40, n) / 4
        h = hull_of(x, y, 1e-12)
        if len(h) < 3:
            continue
        for i, j in zip(h, np.roll(h, -1)):
            assert ((x[j] - x[i]) * (y - y[i]) - (y[j] - y[i]) * (x - x[i]) >= 0).all()


def test_point_pairs_come_in_small_blocks():
    """All pairs of 60 pairs of cells, a few megabytes of them at a time."""
    count, start = np.full(60, 100), np.arange(60) * 100
    every = np.arange(60)
    seen, largest = 0, 0
    for a, b in _point_pairs(every, every[::-1].copy(), (start, start), (count, count)):
        assert (a // 100 + b // 100 == 59).all()
        seen, largest = seen + len(np.unique(a * 6000 + b)), max(largest, len(a))
    assert seen == 60 * 100 * 100 and largest <= 1 << 18


def test_inner_points_are_left_out_before_the_hull():
    """All groups at once: no corner goes, nearly all of a cloud's inside does, odd groups stay."""
    g = np.random.default_rng(21)
    groups = [g.normal(0, 1, (400, 2)), np.array([[1.0, 2.0]]), np.array([[0.0, 0.0], [1.0, 1.0]]), np.linspace(0, 1, 9)[:, None] * [2.0, 1.0]]
    groups += [g.integers(0, 6, (50, 2)) / 10.0, np.array([[0.0, 0], [1, 0], [1, 1], [0, 1], [0.5, 0.5]]), np.array([[np.nan, 1.0], [0, 0], [2, 5], [1, 3]])]
    groups = [np.unique(x, axis=0) for x in groups]
    starts = np.cumsum([0, *[len(x) for x in groups[:-1]]])
    xy = np.concatenate(groups)
    kept = np.split(maybe_corners(xy[:, 0], xy[:, 1], starts, 1e-12), starts[1:])
    for points, keep in zip(groups[:-1], kept):
        corners = lambda p: p[hull_of(p[:, 0], p[:, 1], 1e-12)].tolist()
        assert corners(points[keep]) == corners(points)
    assert kept[0].sum() < 60 and kept[5].tolist() == [True, True, False, True, True]
    assert all(kept[k].all() for k in (1, 2, 3, 6))


def test_partial_hulls_of_a_hot_key(spark):
    g = np.random.default_rng(15)
    xy = g.normal(size=(4000, 2)).round(3)
    df = spark.createDataFrame(pd.DataFrame({"k": np.where(np.arange(4000) < 3000, 0, 1), "x": xy[:, 0], "y": xy[:, 1]}))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {r.k: list(zip(r.hx, r.hy)) for r in hulls.convex_hulls(df, ["k"], x="x", y="y").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k, part in ((0, xy[:3000]), (1, xy[3000:])):
        h = hull_of(part[:, 0], part[:, 1], 1e-12)
        assert got[k] == [tuple(p) for p in part[h]]


def test_distance_profile_matches_all_pairs(spark):
    g = np.random.default_rng(16)
    n = 60
    start = g.integers(0, 50, n)
    pdf = pd.DataFrame(
        {
            "core_id": g.integers(0, 40, n), "s": start, "e": start + g.integers(0, 30, n),
            "transformer": [f"T{v}" for v in g.integers(0, 15, n)],
            "feeder": [f"{'AB'[v % 2]}{v}" if v % 5 else str(v) for v in g.integers(0, 10, n)],
        }
    ).drop_duplicates(["core_id", "s", "e"])
    df = spark.createDataFrame(pdf).select(
        "core_id", F.timestamp_seconds("s").alias("start_time"), F.timestamp_seconds("e").alias("end_time"), "transformer", "feeder"
    )
    got = {
        (r.core_id, r.start_time.timestamp(), r.end_time.timestamp()): [r[f"distance_{i}"] for i in range(5)]
        for r in topology.distance_profile(df).collect()
    }
    sub = pdf["feeder"].str.extract("^([A-Z]*)")[0]
    for i, a in enumerate(pdf.itertuples()):
        want = [0] * 5
        for j, b in enumerate(pdf.itertuples()):
            if min(a.e, b.e) < max(a.s, b.s):
                continue
            same = [a.core_id == b.core_id, a.transformer == b.transformer, a.feeder == b.feeder, sub.iloc[i] == sub.iloc[j], True]
            want[same.index(True)] += 1
        assert got[(a.core_id, float(a.s), float(a.e))] == want


def test_distance_profile_of_repeated_rows_in_small_tasks(spark):
    """Alike rows count by weight, few classes go to a task, and nothing exploded is broadcast."""
    g = np.random.default_rng(18)
    rows = [(int(c), int(s), int(s + d), f"T{c % 3}", f"{'AB'[c % 2]}{c % 4}") for c, s, d in zip(g.integers(0, 9, 80), g.integers(0, 6, 80), g.integers(0, 4, 80))]
    rows += rows[:30]
    df = spark.createDataFrame(rows, "core_id bigint, s bigint, e bigint, transformer string, feeder string").select(
        "core_id", F.timestamp_seconds("s").alias("start_time"), F.timestamp_seconds("e").alias("end_time"), "transformer", "feeder"
    )
    found = topology.distance_profile(df)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    want = {}
    for a in rows:
        counts = want.setdefault(a[:3], [0] * 5)
        for b in rows:
            if min(a[2], b[2]) >= max(a[1], b[1]):
                same = [a[0] == b[0], a[3] == b[3], a[4] == b[4], a[4][0] == b[4][0], True]
                counts[same.index(True)] += 1
    for got in (found, topology.distance_profile(df, task_classes=7)):
        got = {(r.core_id, int(r.start_time.timestamp()), int(r.end_time.timestamp())): [r[f"distance_{i}"] for i in range(5)] for r in got.collect()}
        assert got == want


@pytest.mark.parametrize("distance", [0, 1, 2, 3])
def test_grid_clusters(spark, distance):
    df, pdf = outage_frame(spark, 17, 100, 1500, 20)
    pdf = pdf.assign(tx=pdf["core_id"] % 7, fd=pdf["core_id"] % 3)
    grid = spark.createDataFrame(
        [(c, None, None, f"T{c % 7}", f"{'AB'[c % 2]}{c % 3}") for c in range(20)],
        "core_id bigint, start_time timestamp, end_time timestamp, transformer string, feeder string",
    )
    c = pdf["core_id"].to_numpy()
    feeder = np.array([f"{'AB'[v % 2]}{v % 3}" for v in c])
    same = [c[:, None] == c, (c % 7)[:, None] == c % 7, feeder[:, None] == feeder, (c % 2)[:, None] == c % 2]
    t = pdf["outage_time"].to_numpy()
    near = np.logical_or.reduce(same[: distance + 1]) & (abs(t[:, None] - t) <= 20)
    want = brute_dbscan(near, pdf["event_id"].to_numpy(), 2)
    got = clusters_space.grid_dbscan(df, grid, max_distance=distance, temporal_eps=20).toPandas()
    assert got.set_index("event_id")["label"].reindex(pdf["event_id"]).tolist() == want.tolist()


def test_silhouette(spark):
    df, _ = outage_frame(spark, 18, 120, 6000, 10)
    rows = clusters_time.dbscan_time(df, eps=30)
    pdf = rows.toPandas()
    t, l = pdf["outage_time"].to_numpy(), pdf["label"].to_numpy()
    d = abs(t[:, None] - t)
    scores = []
    for i in range(len(t)):
        own = l == l[i]
        if own.sum() == 1:
            scores.append(0.0)
            continue
        a = d[i][own].sum() / (own.sum() - 1)
        b = min(d[i][l == k].mean() for k in set(l) - {l[i]})
        scores.append((b - a) / max(a, b))
    got = evaluation.silhouette_time(rows, width=500).first()
    assert got.silhouette == pytest.approx(np.mean(scores))
