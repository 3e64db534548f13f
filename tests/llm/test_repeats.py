"""Repeated strings against brute force, and the suffix sorter against sorting."""

import hashlib
import random
from collections import Counter

import pytest

from amperic.llm.repeats import anchors, equal_windows, remove_repeats
from amperic.llm.suffix import suffix_array


def brute(texts, length):
    """(bytes, removed, stretches, digest) of each text by counting all its windows."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        starts = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), starts, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(rng, n, alphabet, passages):
    parts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(3, 60))) for _ in range(passages)]
    texts = []
    for _ in range(n):
        t = ""
        for _ in range(rng.randint(0, 5)):
            t += rng.choice(parts) if rng.random() < 0.5 else "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        texts.append(t)
    return texts + [None, "", "a" * 70, texts[0] if texts else "x", "é" * 30]


@pytest.mark.parametrize("seed,alphabet,most", [(1, "ab", 20_000), (2, "abcdefghij", 20_000), (3, "abcé ", 4), (4, "ab", 3)])
def test_brute_force(spark, seed, alphabet, most):
    rng = random.Random(seed)
    texts = corpus(rng, 60, alphabet, 6)
    rows = [(i if i % 7 else None if i == 0 else i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnsRenamed({}).selectExpr("*", "text as h", "doc_id as row")
    got = remove_repeats(docs.repartition(4), length=16, gram=8, task_contexts=most)
    rows_got = got.collect()
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows_got}
    by_id = {r[0]: (r[1] or "").encode() for r in rows}
    for r in rows_got:
        whole, at = by_id[r["doc_id"]], 0
        kept = b""
        for s in r["spans"]:
            kept, at = kept + whole[at : s["start"]], s["end"]
        kept += whole[at:]
        assert kept == r["kept"] and kept.decode("utf-8", "ignore") == r["kept_text"]
    want = brute([(t or "").encode() for t in texts], 16)
    assert found == {r[0]: w for r, w in zip(rows, want)}


def test_copies_of_a_row_and_empty_table(spark):
    text = "".join(random.Random(5).choice("abcdefgh") for _ in range(50))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text[:15])], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_removed"]) for r in remove_repeats(docs, length=16, gram=8).collect())
    assert got == [(1, 50), (1, 50), (2, 0)]
    assert remove_repeats(docs.limit(0), length=16, gram=8).count() == 0


def test_suffix_array():
    rng = random.Random(7)
    for _ in range(300):
        t = [rng.randint(1, rng.choice([1, 2, 5])) for _ in range(rng.randint(0, 50))] + [0]
        assert suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def test_long_text_in_stretches(monkeypatch):
    import amperic.llm.repeats as r

    rng = random.Random(8)
    text = bytes(rng.choice(b"abcd") for _ in range(700))
    want = anchors([text], 16, 8)
    monkeypatch.setattr(r, "_POSITION", 7)
    assert [x.tolist() for x in r._long_anchors(text, 16, 8)] and len(want[1])
    # every window holds one of the anchors, whatever the stretches
    places = set(r._long_anchors(text, 16, 8)[0].tolist())
    assert all(places & set(range(i, i + 9)) for i in range(len(text) - 15))


def test_equal_windows_of_reversed_sides():
    import numpy as np

    back, ahead = equal_windows(np.array([1, 1, 2]), [b"cba", b"cbx", b"cba"], [b"defgh", b"defgx", b"defgh"], 6)
    assert back.tolist() == [2, 2, 0] and ahead.tolist() == [4, 4, 0]


def test_query_at_400_bytes(spark, tmp_path):
    """Passages of over 50 words in two documents each go from 400 bytes on; shorter ones stay, as do the other texts."""
    from amperic.llm.queries import QUERIES

    rng = random.Random(9)
    words = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    prose = lambda n: " ".join(words(rng.randint(2, 8)) for _ in range(n))
    passages = [" ".join(words(6) for _ in range(80))[:n] for n in (400, 399, 555)]
    texts = [f"{prose(70)}<{i}{p}{i}>{prose(70)}" for p in passages for i in range(2)] + [prose(200) for _ in range(3)] + [None, "x" * 399]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(QUERIES["op1_suffix_dedup"](spark, str(tmp_path)).collect(), key=lambda r: r["doc_id"])
    assert [r["n_removed"] for r in got] == [400, 400, 0, 0, 555, 555, 0, 0, 0, 0, 0]
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got] == brute([(t or "").encode() for t in texts], 400)
    assert [r["repeats"] for r in got] == [r["n_removed"] > 0 for r in got]
