"""Personal data against plain Python: base spans, patterns, learned spans."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from amperic.llm.personal import find_personal, learned_patterns, occurrences

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"
CARD = r"[0-9](?:[\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ["email", "ip", "card", "phone", "learned"]
ODD = [None, "", " \n", "a@b.c_x@y.z", "1.2.3.4.5.6.7.8 256.1.1.1 0255.001.1.1", "4111 1111-1111 1111", "4111  1111 1111 1111",
       "+1 (017) 555-7713...", "+1234567 +12 34567-89(", "é日" * 20 + " q@r.st 😀 w@r.st", "1" * 5000, "a." * 3000 + "@b", "x@" + "y." * 4000 + "z",
       "49927398716 0049927398716 79927398713000", "+" * 500, "....@a.b", "1.1." * 3000, "\x00 10.0.0.1\x85", "A@B.C" * 4]


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def valid(k, s):
    d = re.sub("[^0-9]", "", s)
    if k == 1:
        return all(int(p) <= 255 for p in s.split("."))
    if k == 2:
        return 12 <= len(d) <= 19 and luhn(d)
    return k != 3 or 9 <= len(d) <= 15


def base_spans(text):
    return sorted((m.start(), k, m.end()) for k, p in enumerate((EMAIL, IP, CARD, PHONE)) for m in re.finditer(p, text) if valid(k, m[0]))


TOKEN = r"(?<![A-Za-z0-9._/@+#:-])(?=(?:[A-Za-z._/@+#:-]*[0-9]){4})[A-Za-z0-9](?:[._/@+#:-]?[A-Za-z0-9])+"
INSTANCE = "|".join((EMAIL, PHONE, r"[0-9](?:[\x20-]?[0-9]){11,}", TOKEN))


def words(s):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[0-9]+", "0", s).lower()) if w]


def instances(text):
    """(start, end, value, seed, patterns)"""
    hits = list(re.finditer(INSTANCE, text))
    out = []
    for i, m in enumerate(hits):
        a = hits[i - 1].end() if i else 0
        b = hits[i + 1].start() if i + 1 < len(hits) else len(text)
        left, right = words(text[a : m.start()][-64:]), words(text[m.end() : b][:64])
        if "@" not in m[0] and len(re.sub("[^0-9]", "", m[0])) < 4:
            continue
        pats = []
        if left:
            pats = [" ".join((left[-2] if len(left) > 1 else "", left[-1], "*")), " ".join((left[-1], "*", right[0] if right else ""))]
        seed = any(re.fullmatch(p, m[0]) and valid(k, m[0]) for k, p in enumerate((EMAIL, IP, CARD, PHONE)))
        out.append((m.start(), m.end(), m[0].lower(), seed, pats))
    return out


def learn(texts, rounds=3, least=600, support=3):
    edges, seeds = defaultdict(set), set()
    for t in texts:
        for _, _, v, seed, pats in instances(t or ""):
            if seed:
                seeds.add(v)
            for p in pats:
                edges[p].add(v)
    score = {v: 1000 for v in seeds}
    for _ in range(rounds):
        good = {}
        for p, vs in edges.items():
            s, n = sum(score.get(v, 0) for v in vs) // (len(vs) + 1), sum(score.get(v, 0) > 0 for v in vs)
            if s >= least and n >= support:
                good[p] = (s, n)
        score = {v: 1000 for v in seeds}
        for p, (s, _) in good.items():
            for v in edges[p] - seeds:
                score[v] = max(score.get(v, 0), s)
    return good


def brute(texts):
    good = learn(texts)
    line = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
    out = []
    for t in texts:
        base = base_spans(t or "")
        more = [(a, 4, b) for a, b, _, seed, pats in instances(t or "") if not seed and any(p in good for p in pats)]
        more = [s for s in more if not any(s[0] < b and a < s[2] for a, _, b in base)]
        kinds = [k for _, k, _ in base]
        out.append((*(kinds.count(k) for k in range(4)), hashlib.sha256(line(base).encode()).hexdigest(), line(sorted(base + more)), len(more)))
    return out


COLUMNS = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_learned"]


def plain(df):
    return sorted(((r["doc_id"], *(r[c] for c in COLUMNS)) for r in df.collect()), key=str)


def test_base_spans_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = [(r["doc_id"], *w) for r, w in zip(rows, brute([r["text"] for r in rows]))]
    assert plain(find_personal(docs)) == sorted(want, key=str)


def planted(rng, n=60):
    """Contexts that lead to known identifiers, and unknown ones in the same contexts."""
    texts = []
    for i in range(n):
        phone = f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}"
        unknown = rng.choice([f"{rng.randint(100, 999)}-{rng.randint(1000, 9999)}", f"user{rng.randint(10**5, 10**6)}"])
        who = phone if i % 5 else unknown
        texts.append(rng.choice(["Please call me at {} today.", "Reach Ünal, call me at {} or write", "order number {} was sent"]).format(who))
        texts.append(f"invoice number {rng.randint(10**6, 10**7)} of 2024-01-{rng.randint(10, 28)}")
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_learned_spans(spark, seed):
    rng = random.Random(seed)
    texts = ODD + planted(rng)
    texts += [texts[-1], texts[40]]
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)]
    rows.append(rows[45])
    want = sorted(((r[0], *w) for r, w in zip(rows, brute([r[1] for r in rows]))), key=str)
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, kind int, spans string").repartition(5)
    assert plain(find_personal(docs)) == want
    assert sum(w[-1] for w in want) > 3


def test_patterns(spark):
    texts = planted(random.Random(3))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["pattern"]: (r["score"], r["support"]) for r in learned_patterns(occurrences(docs).filter("kind = 4")).collect()}
    assert got == learn(texts) and "me at *" in got and "invoice number *" not in got


def test_few_and_none(spark):
    docs = spark.createDataFrame([(1, "call me at 555-12345"), (2, None)], "doc_id long, text string")
    assert [r["spans"] for r in find_personal(docs).collect()] == ["", ""]
    empty = find_personal(docs.limit(0))
    assert empty.columns == ["doc_id", *COLUMNS] and empty.count() == 0


def test_copies_do_not_make_a_pattern(spark):
    text = "call me at +1 (017) 555-7713 now, call me at 555-98765 now"
    docs = spark.createDataFrame([(i, text) for i in range(300)], "doc_id long, text string")
    assert {r["n_learned"] for r in find_personal(docs).collect()} == {0}
