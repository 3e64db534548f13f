"""Importance resampling and its prefix CRCs against plain Python."""

import hashlib
import math
import random
import re
import zlib

import pytest

from amperic.llm.prefix_crc import ngram_crcs
from amperic.llm.resample import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(folded)
    runs = [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    return len(words), [zlib.crc32(r.encode()) for r in runs]


def brute(docs, target, percent=5, least=20, buckets=10_000):
    """(doc_id, n_features, weight, score, rank) of every row."""
    raw, aim = [0] * buckets, [0] * buckets
    found = [(d, *features(t)) for d, t in docs]
    for _, _, crcs in found:
        for c in crcs:
            raw[c % buckets] += 1
    for t in target:
        for c in features(t)[1]:
            aim[c % buckets] += 1
    s_all, t_all = sum(raw), sum(aim)
    gain = [math.floor(1000 * math.log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets)))) for s, t in zip(raw, aim)]
    rows = []
    for d, n, crcs in found:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[c % buckets] for c in crcs)
        rows.append([d, len(crcs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: len(able) * percent // 100], 1):
        r[4] = k
    return [tuple(r[:5]) for r in rows]


def plain(df):
    return [(r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect()]


@pytest.mark.parametrize("size", [1 << 20, 64])
def test_crcs_of_all_runs(size, monkeypatch):
    from amperic.llm import prefix_crc

    monkeypatch.setattr(prefix_crc.scans, "__defaults__", (size, 3))
    rng = random.Random(1)
    texts = ["", "One", "a-b c__d", "é日本 İX " * 9, "x" * 700 + " " + "y" * 300 + " z " + "w" * 70_000, " \x85\xa0 q"]
    texts += ["".join(rng.choice("aB1 .é\n") for _ in range(rng.randint(0, 400))) for _ in range(40)]
    got = [[] for _ in texts]
    for owner, _, crc in ngram_crcs([t.encode() for t in texts]):
        for o, c in zip(owner.tolist(), crc.tolist()):
            got[o].append(c)
    for t, g in zip(texts, got):
        assert sorted(g) == sorted(features(t)[1]), t[:40]


def test_brute_force_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [r["text"] for r in target.collect()])
    got = plain(resample(docs, target))
    assert sorted(got) == sorted(want, key=lambda r: r[0]) or sorted(got, key=str) == sorted(want, key=str)
    ranks = sorted(r[4] for r in got if r[4] is not None)
    assert ranks == list(range(1, len(ranks) + 1)) and ranks


def test_odd_rows(spark):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "délta", "1", "Ünd"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(15, 40)))) for i in range(60)]
    rows += [(None, rows[3][1]), (3, rows[3][1]), (70, None), (71, ""), (72, "word " * 50_000), (73, rows[3][1])]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, rank string, _down int").repartition(5)
    target = spark.createDataFrame([("alpha beta",), (None,)], "text string")
    got, want = plain(resample(docs, target, percent=30)), brute(rows, ["alpha beta", None], percent=30)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert plain(resample(docs, target.limit(0), percent=30)) != got
    empty = resample(docs.limit(0), target)
    assert empty.columns == ["doc_id", "n_features", "weight", "score", "rank", "n_words"] and empty.count() == 0


def test_one_source_of_ties(spark):
    """Equal texts differ by their noise alone; equal ids and texts get ranks side by side."""
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(i // 2, text) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = plain(resample(docs, docs, percent=50))
    assert sorted(got, key=str) == sorted(brute(rows, [text] * 40, percent=50), key=str)
