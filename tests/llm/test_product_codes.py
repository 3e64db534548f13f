"""Product codes against plain numpy, and metric trees against all distances."""

import hashlib
import math

import numpy as np
import pytest

from amperic.llm.balls import LEAF, anchor_groups, assign, build_tree
from amperic.llm.product_codes import product_codes

SCHEMA = "vec_id long, embedding array<double>, label int, v string, error int"


def brute(rows, parts=16, entries=64, rounds=2):
    """(vec_id, label, code, error, label_error, digest) of every kept row."""
    kept = [(i, [math.floor(256 * x) for x in v], l) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == width]
    x = np.array([r[1] for r in kept]).reshape(len(kept), parts, width // parts)
    books = x[:entries].transpose(1, 0, 2).copy()

    def codes():
        d = ((x[:, :, None, :] - books[None]) ** 2).sum(-1)
        return d.argmin(-1), d.min(-1).sum(-1)

    for _ in range(rounds):
        c, _ = codes()
        for p in range(parts):
            for e in range(books.shape[1]):
                own = x[c[:, p] == e, p]
                if len(own):
                    books[p, e] = own.sum(0) // len(own)
    c, error = codes()
    per = {}
    for (_, _, l), e in zip(kept, error.tolist()):
        per[l] = per.get(l, 0) + e
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return [(i, l, "".join(f"{k:02x}" for k in row), e, per[l], digest) for (i, _, l), row, e in zip(kept, c.tolist(), error.tolist())]


def got(df):
    return sorted(map(tuple, df.select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


@pytest.mark.parametrize("spread,n,width", [(3, 700, 2), (1000, 1500, 4), (10**8, 300, 3), (1, 400, 1), (0, 200, 2)])
def test_trees(spread, n, width):
    rng = np.random.default_rng(n)
    points = rng.integers(-spread, spread + 1, (n, width))
    points[: n // 3] = points[0]  # a third are copies
    groups = anchor_groups(points.astype(float))
    assert sorted(np.concatenate(groups).tolist()) == list(range(n))
    order, nodes = build_tree(points)
    assert sorted(order.tolist()) == list(range(n)) and (nodes[0]["lo"], nodes[0]["hi"]) == (0, n)
    for node in nodes:
        inside = points[order[node["lo"] : node["hi"]]]
        assert (inside.sum(0) == node["sums"]).all()
        assert np.sqrt(((inside - node["centre"]) ** 2).sum(1)).max() <= node["radius"] * (1 + 1e-9) + 1e-6
        if node["left"] < 0:
            assert len(inside) <= LEAF or len(np.unique(inside, axis=0)) == 1
        else:
            a, b = nodes[node["left"]], nodes[node["right"]]
            assert (a["lo"], a["hi"], b["hi"]) == (node["lo"], b["lo"], node["hi"])
    entries = np.concatenate([points[:40], points[:3], rng.integers(-spread, spread + 1, (20, width))])
    code, counts, sums = assign(points, order, nodes, entries)
    want = ((points[:, None] - entries[None]) ** 2).sum(-1).argmin(1)
    assert (code == want).all()
    assert (counts == np.bincount(want, minlength=len(entries))).all()
    assert all((sums[e] == points[want == e].sum(0)).all() for e in range(len(entries)))


def test_brute_force_on_embeddings(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    want = brute([(r["vec_id"], [float(x) for x in r["embedding"]], r["label"]) for r in rows.collect()])
    assert got(product_codes(rows.repartition(3))) == sorted(want, key=str)


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in rng.choice([-0.5, -0.001, 0.0, 0.25, 1.0], 32)], int(i) % 3 or None) for i in rng.permutation(150)]
    rows += [(None, rows[0][1], 1), (rows[1][0], rows[2][1], None), (5, None, 1), (6, [None] * 32, 1), (7, [float("nan")] * 32, 2)]
    rows += [(8, [float("inf")] * 32, 2), (9, [1.0] * 31, 2), (10, [], 2)] + [(1000 + i, rows[3][1], 9) for i in range(90)]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA).repartition(4)
    assert got(product_codes(df)) == sorted(brute(rows), key=str)
    few = df.filter("vec_id < 20")
    assert got(product_codes(few)) == sorted(brute([r for r in rows if r[0] is not None and r[0] < 20]), key=str)
    empty = product_codes(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(ValueError):
        product_codes(df, parts=5)
    huge = spark.createDataFrame([(1, [1e300] * 16, None, "", 0), (2, [-1e300] * 16, None, "", 0)], SCHEMA)
    assert [r["error"] for r in product_codes(huge).collect()] == [0, 0]
