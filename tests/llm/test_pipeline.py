"""The pipeline stage by stage against brute force on its own input."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from test_corpus import jaccard_groups, lines_brute
from test_rows import base_counts, reference

import corpus_pipeline as cp
from amperic.llm.common import documents, staged

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before and after each stage."""
    docs, out = documents(spark, SF), []
    extra = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "src1", 0)], docs.schema)
    docs = staged(docs.unionByName(extra))
    for name, stage in cp.STAGES:
        after = staged(stage(spark, docs, SF))
        out.append((name, docs, after))
        docs = after
    return out


def rows(df):
    return [tuple(r) for r in df.select(*cp.COLUMNS).collect()]


def test_columns(stages):
    assert 4 <= len(cp.STAGES) <= 5
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns


def test_quality(stages):
    _, before, after = stages[0]
    kept = Counter(rows(after))
    assert not kept - Counter(rows(before))
    assert all(not base_counts(r[1] or "")[5] for r in kept)


def test_lines(stages):
    _, before, after = stages[1]
    want = {i: t for i, _, _, t in lines_brute([r[:2] for r in rows(before)])}
    got = rows(after)
    assert {r[0]: r[1] for r in got} == want and all(r[4] == len(r[1]) for r in got)


def test_near(stages):
    _, before, after = stages[2]
    groups = jaccard_groups([r[:2] for r in rows(before)])
    assert sorted(r[0] for r in rows(after)) == sorted(set(groups.values()))
    assert not Counter(rows(after)) - Counter(rows(before))


def test_near_keeps_unrelated_texts_of_one_id(spark):
    base = [" ".join(f"w{i}x{j}" for j in range(70)) for i in range(6)]
    other = [" ".join(f"o{i}x{j}" for j in range(70)) for i in range(6)]
    table = [(i, base[i]) for i in range(6)] + [(50 + i, base[i] + " more") for i in range(6)] + [(50 + i, other[i]) for i in range(6)]
    table += [(None, base[0]), (None, other[1]), (7, None), (50, other[0])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in table], documents(spark, SF).schema).repartition(4)
    got = Counter((r[0], r[1]) for r in rows(cp.near_stage(spark, docs, SF)))
    assert got == Counter([(i, base[i]) for i in range(6)] + [(50 + i, other[i]) for i in range(6)] + [(7, None)])


def test_mixing(stages):
    _, before, after = stages[3]
    assert Counter(rows(after)) == Counter(rows(before))


def test_encoding(stages):
    _, before, after = stages[4]
    got, encoding = {r["doc_id"]: r for r in after.collect()}, reference()
    assert len(got) == before.count()
    for r in rows(before):
        ids = encoding.encode_ordinary(r[1])
        assert got[r[0]]["ids"] == ids
        assert got[r[0]]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_output_carries_the_mixed_order(stages):
    _, before, after = stages[4]
    sizes = Counter()
    for r in rows(before):
        sizes[r[3] or ""] += len(r[1])
    weights = {s: n**0.5 / sum(v**0.5 for v in sizes.values()) for s, n in sizes.items()}
    source = {r[0]: r[3] or "" for r in rows(before)}
    got = {(r["slot"], source[r["doc_id"]]) for r in after.collect()}
    assert len({t for t, _ in got}) == len(got) > 10
    for t in range(1, max(t for t, _ in got) + 2):
        done = Counter(s for at, s in got if at < t)
        # a source may run out, or a long text may span blocks; none gets ahead of its weight
        assert all(done[s] < t * w + 1 + t / 500 for s, w in weights.items()), t


def test_run_is_the_stages(spark, stages):
    whole = {r["doc_id"]: r["ids_sha256"] for r in cp.run(spark, SF).collect()}
    assert whole and set(whole) <= {r["doc_id"] for r in stages[-1][2].collect()} | {10**6}
