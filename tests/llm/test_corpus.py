"""Operators over many documents: lines, near-duplicates, mixing, search, chats, pages."""

import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from amperic.llm import chat, hamming, lines, mixing, near, wrapper


def frame(spark, rows, schema):
    """Rows with columns whose names the operators use themselves."""
    extra = "row long, h1 string, key int, source string, _row int, html string, n int, t1 string"
    names = {c.split()[0] for c in schema.split(", ")}
    return spark.createDataFrame(rows, schema).withColumns(
        {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in extra.split(", ") if c.split()[0] not in names}
    ).repartition(3)


# --- lines


def lines_brute(rows):
    def key(x):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))

    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                holders[key(x)].add(i)
    out = []
    for i, t in rows:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if len(holders[key(x)]) < 3 or i == max(h for h in holders[key(x)] if h is not None)]
        out.append((i, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return out


def test_lines(spark):
    rng = random.Random(1)
    pool = ["A common line of the corpus É", " a COMMON line of the corpus É\t", "short", "", "Twenty characters!!!!", "unique one %d and more text"]
    rows = [(i, "\n".join(rng.choice(pool).replace("%d", str(rng.randint(0, 9))) for _ in range(rng.randint(0, 6)))) for i in range(60)]
    rows += [(None, pool[0]), (100, None), (101, ""), (102, pool[0] + "\n" + pool[0]), (103, "x" * 50_000), (7, pool[4])]
    got = lines.line_dedup(frame(spark, rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in got) == Counter(lines_brute(rows))
    for r in got:
        assert sum(k["n"] for k in r["keep"]) == r["n_lines"] - r["n_dropped"]
    assert lines.line_dedup(frame(spark, [], "doc_id long, text string")).count() == 0


# --- near-duplicates


def jaccard_groups(rows, threshold=0.8):
    """Components over all pairs of different texts."""
    def items(t):
        w = (t or "").split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [(i, t or "", items(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, t, a), (j, u, b) in itertools.combinations(sets, 2):
        if t == u or (a and b and len(a & b) >= threshold * len(a | b)):
            x, y = sorted((root(i), root(j)))
            parent[y] = x
    return {i: root(i) for i, _ in rows}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randint(0, 10**6)}"
    return words


@pytest.mark.parametrize("rounds", [1, 3])
def test_near_duplicates(spark, rounds):
    rng = random.Random(2)
    texts = []
    for _ in range(12):
        base = [f"v{rng.randint(0, 10**6)}" for _ in range(rng.choice([30, 120, 300]))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            texts.append(" ".join(edited(rng, base, rng.choice([0, 1, 1, 2, 6]))))
    drift = [f"d{i}" for i in range(200)]
    for _ in range(25):  # a chain: neighbours are near, ends are not
        drift = edited(rng, drift, 1)
        texts.append(" ".join(drift))
    hub = [f"h{i}" for i in range(400)]
    texts += [" ".join(hub)] + [" ".join(edited(rng, hub, 6)) for _ in range(40)]
    texts += [None, "", "one", "one", "two three", "two three four five six " * 40, "long " * 20_000]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = near.near_duplicates(frame(spark, rows, "doc_id long, text string"), hub_rounds=rounds).collect()
    assert {r["doc_id"]: r["group_id"] for r in got} == jaccard_groups(rows)
    assert len(got) == len(rows)


def test_near_duplicates_with_unequal_repeats(spark):
    rng, texts = random.Random(8), []
    for k in (20, 50, 50, 200, 200, 200, 200, 200):
        words = " ".join(f"u{rng.randint(0, 10**9)}" for _ in range(300))
        line = " ".join(f"r{rng.randint(0, 10**9)}" for _ in range(12))
        texts += [f"{words} {line}", " ".join([words] + [line] * k)]
    got = near.near_duplicates(frame(spark, list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["group_id"] for r in got} == {i: i - i % 2 for i in range(len(texts))}


def test_near_duplicates_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(None, text), (5, text), (5, text), (3, "other words that stand alone here"), (3, text + " x"), (None, "lonely")]
    got = near.near_duplicates(frame(spark, rows, "doc_id long, text string")).collect()
    told = Counter((r["doc_id"], r["n_shingles"], r["class_id"], r["group_id"]) for r in got)
    # the copies and the text with one more word are one group, named 3; the others are alone
    assert told == {(None, 46, 5, 3): 1, (5, 46, 5, 3): 2, (3, 2, 3, 3): 1, (3, 47, 3, 3): 1, (None, 1, None, None): 1}
    groups = {(r["doc_id"], r["n_shingles"]): r["group_hash"] for r in got}
    assert groups[None, 46] == groups[5, 46] == groups[3, 47] and len(set(groups.values())) == 3
    assert near.near_duplicates(frame(spark, [], "doc_id long, text string")).count() == 0


def test_near_duplicates_of_repeated_ids(spark):
    """Ids that hold a near copy and an unrelated text each: every text is judged for itself."""
    rng = random.Random(12)
    rows = []
    for i in range(12):
        base = [f"b{rng.randint(0, 10**9)}" for _ in range(80)]
        rows += [(i, " ".join(base)), (100 + i, " ".join(edited(rng, base, 1))), (100 + i, " ".join(f"c{rng.randint(0, 10**9)}" for _ in range(60)))]
    got = near.near_duplicates(frame(spark, rows, "doc_id long, text string")).collect()
    per = {}
    for r in got:
        per.setdefault(r["group_hash"], []).append((r["doc_id"], r["n_shingles"], r["group_id"]))
    assert sorted(sorted(v) for v in per.values()) == sorted(
        [[(i, 76, i), (100 + i, 76, i)] for i in range(12)] + [[(100 + i, 56, 100 + i)] for i in range(12)]
    )


def test_signature_estimates_probability_jaccard():
    import numpy as np

    rng = np.random.default_rng(4)
    keys = rng.integers(1, 2**63, 60).astype(np.uint64)
    x, y = rng.integers(1, 6, 60).astype(float), rng.integers(1, 6, 60).astype(float)
    x[40:], y[:15] = 0, 0
    true = sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in range(60)) for i in range(60) if x[i] and y[i])
    owner = np.concatenate([np.zeros((x > 0).sum(), int), np.ones((y > 0).sum(), int)])
    sig = near.prob_min_hash(owner, np.concatenate([keys[x > 0], keys[y > 0]]), np.concatenate([x[x > 0], y[y > 0]]), 2, 4000)
    assert abs((sig[0] == sig[1]).mean() - true) < 0.03


# --- mixing


def test_schedule_is_fair():
    for parts in ({"a": 1}, {"a": 3, "b": 1}, {"a": 333, "b": 333, "c": 334}, {"a": 700, "b": 299, "c": 1}, {str(i): 5 for i in range(20)}):
        slots, period, done = mixing.schedule(parts), sum(parts.values()), Counter()
        for t, s in enumerate(slots, 1):
            done[s] += 1
            assert all(abs(done[k] - t * n / period) < 1 for k, n in parts.items())
        assert done == parts


def test_mixing_keeps_every_row(spark):
    rng = random.Random(5)
    rows = [(i, "x" * rng.randint(0, 400), "hot" if i % 3 else f"s{i % 5}") for i in range(400)]
    rows += [(None, None, None), (7, "again", "hot"), (7, "again", "hot"), (900, "y" * 30_000, "hot")]
    docs = frame(spark, rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(docs, period=50, block_chars=1000).collect()
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in got) == Counter(rows)
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in got)
    by_slot = defaultdict(set)
    for r in got:
        by_slot[r["slot"]].add((r["source"] or "", r["block"]))
    assert all(len(v) == 1 for v in by_slot.values())
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix_sources(docs, period=3)


# --- search


def test_search_is_exact(spark):
    rng = random.Random(6)
    codes = [rng.getrandbits(64) - 2**63 for _ in range(300)]
    codes += [codes[0]] * 40 + [c ^ (1 << rng.randrange(62)) for c in codes[:60]] + [-1, 0]
    rows = [(i, c) for i, c in enumerate(codes)] + [(3, codes[3]), (None, 5), (999, None)]
    data = frame(spark, rows, "id long, code long")
    got = hamming.hamming_top_k(data, data.filter("id % 20 = 0"), k=7, parts=5, code_block=90, query_block=8).collect()
    want = {}
    for q in range(0, len(codes), 20):
        near_ = sorted((bin((codes[q] ^ c) & (2**64 - 1)).count("1"), i) for i, c in enumerate(codes) if i != q)[:7]
        want[q] = [(i, d) for d, i in near_]
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        found[r["query_id"]].append((r["neighbour_id"], r["distance"]))
    assert found == want
    assert hamming.hamming_top_k(data.limit(0), data.limit(0)).count() == 0


def test_codes(spark):
    rows = [(0, [1.0, -1.0, 0.5]), (1, [1.0, None, 1.0]), (2, None), (3, [1.0]), (None, [0.0, 0.0, 1.0])]
    got = hamming.embedding_codes(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), bits=3).collect()
    assert [(r["id"], r["code"]) for r in got] == [(0, 5), (1, None), (2, None), (3, None), (None, 4)]


# --- chats


def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "\\", "<\\s>", "[\\INST]\\\\", "", None, "a\nb", "<<s>", "[/INST", "<s", "é😀" * 50, "x" * 100_000]
    rows = [(1, k, ("user", "assistant", "tool", None)[k % 4], t) for k, t in enumerate(hard)]
    rows += [(2, 0, "assistant", "same"), (2, 0, "assistant", "same"), (None, None, None, None), (3, 5, "assistant", "b"), (3, 1, "assistant", "a")]
    log = chat.turn_events(frame(spark, rows, "conv_id long, turn long, role string, text string"))
    done = chat.render(chat.fold_events(log)).select(
        "conv_id", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("loss"), "formatted", "loss"
    )
    got = {r["conv_id"]: r for r in done.collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [(r[2] or "", r[3] or "") for r in rows[:12]]
    assert got[1][2] == "".join(r[3] or "" for r in rows[:12] if r[2] == "assistant")
    assert got[2][2] == "samesame" and got[3][2] == "ab" and len(got[None]["turns"]) == 1
    assert chat.render(chat.fold_events(log.limit(0))).count() == 0


def test_chat_streamed(spark):
    """Deltas, edits, regenerations and deletions fold to the texts as they were."""
    rows = [(c, t, r, x) for c in (1, 2, None) for t, (r, x) in enumerate([("user", "a"), ("assistant", "</s>[INST] é日😀 [/INST]\\"), ("user", None), (None, "long " * 500), ("assistant", "")])]
    rows += [(3, 0, "user", "b"), (3, 0, "user", "b"), (3, 0, "assistant", "x")]
    table = frame(spark, rows, "conv_id long, turn long, role string, text string")
    log = chat.streamed_events(table)
    kinds = Counter(r["kind"] for r in log.collect())
    assert kinds["delta"] == 4 * len(rows) and kinds["edit"] and kinds["regenerate"] and kinds["delete"] == len(rows)
    told = lambda df: sorted(((r["conv_id"], r["message"], r["role"], r["text"]) for r in df.collect()), key=str)
    want = [(c, 2 * m, r, x) for c, m, r, x in told(chat.fold_events(chat.turn_events(table)))]
    assert told(chat.fold_events(log.repartition(7))) == sorted(want, key=str)


def test_chat_events(spark):
    log = [
        (1, 0, 0, "start", "user", "Hi"), (1, 1, 1, "start", "assistant", ""), (1, 2, 1, "delta", None, "Hel"), (1, 3, 1, "delta", None, "lo"),
        (1, 4, 2, "start", "user", "gone"), (1, 5, 1, "regenerate", None, None), (1, 6, 1, "delta", None, "Good "), (1, 7, 1, "delta", None, "day"),
        (1, 8, 2, "start", "user", "next"), (1, 9, 0, "edit", None, "Hey"), (1, 10, 3, "start", "assistant", "bad"), (1, 11, 3, "delete", None, None),
    ]
    frame_ = spark.createDataFrame(log, "conv_id long, seq long, message long, kind string, role string, text string")
    got = [(r["role"], r["text"]) for r in chat.fold_events(frame_).orderBy("message").collect()]
    assert got == [("user", "Hey"), ("assistant", "Good day"), ("user", "next")]


# --- pages


PAGE = (
    '<html><head><title>t</title></head><body><nav><a href="/">Home</a></nav><div class="site-banner">Shop</div>'
    "<article><h1>Title {i}</h1><p>First &amp; {i}<br>second<p><b>Bold</b> text {j}</p><p>Follow us for more</p>"
    '<div class="comments"><p>nice {i}</p></div><script>var a="<p>";</script></article><footer>Bye {i}</footer></body></html>'
)


def test_pages(spark):
    rows = [(i, "http://a.example/x", PAGE.format(i=i, j=i * 7)) for i in range(12)]
    rows += [(50 + i, "http://a.example/x", PAGE.format(i=1, j=7)) for i in range(3)]
    rows += [(100, None, None), (101, "odd", ""), (102, "http://b.example", "<p>one<p>two &lt;3 <ul><li>x<li>y</ul>"), (103, "http://b.example", "<div>" * 3000 + "deep")]
    rows += [(104, "http://c.example", "<nav>menu</nav><p>plain  text\n here</p><aside>no</aside>"), (104, "http://c.example", "<p>again</p>")]
    got = wrapper.extract_text(frame(spark, rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    text = {(r["page_id"], r["n_chars"]): r["text"] for r in got}
    by = {r["page_id"]: r for r in got}
    assert by[3]["text"] == "Title 3\nFirst & 3 second\nBold text 21"
    assert by[51]["text"] == "Title 1\nFirst & 1 second\nBold text 7" and by[3]["n_template"] == 1
    assert by[100]["text"] == "" and by[101]["text"] == "" and by[102]["text"] == "one\ntwo <3\nx\ny" and by[103]["text"] == "deep"
    assert text[104, 15] == "plain text here" and text[104, 5] == "again"
    assert wrapper.extract_text(frame(spark, [], "page_id long, url string, html string")).count() == 0


def test_alignment_is_simple_tree_matching():
    def best(x, y):
        if x.tag != y.tag:
            return 0
        p, q = x.elements(), y.elements()
        table = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
        for r in range(1, len(p) + 1):
            for c in range(1, len(q) + 1):
                table[r][c] = max(table[r - 1][c], table[r][c - 1], table[r - 1][c - 1] + best(p[r - 1], q[c - 1]))
        return 1 + table[-1][-1]

    rng = random.Random(9)

    def page(depth):
        return "".join(f"<{t}>{page(depth - 1) if depth else ''}</{t}>" for t in rng.choices(["div", "span", "b", "i"], k=rng.randint(0, 4)))

    for _ in range(200):
        a, b = wrapper.tree(page(3)), wrapper.tree(page(3))
        assert sum(1 for _ in wrapper.align(a, b)) == best(a, b)


def _words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def test_two_layouts_and_empty_pages(spark):
    """Boilerplate that only repetition tells, in two layouts of a host, beside empty pages and stubs."""
    rng, rows, want = random.Random(5), [], {}
    for i in range(30):
        body = [_words(rng, 12) for _ in range(rng.randint(2, 6))]
        paragraphs = "".join(f"<p>{x}</p>" for x in body)
        rows.append((i, f"<html><body><p>Our shop since 1990</p><div><div><h2>{_words(rng, 4)}</h2>{paragraphs}</div></div><p>Call us any day</p></body></html>"))
        cells = "".join(f"<tr><td>{x}</td></tr>" for x in body)
        rows.append((100 + i, f"<html><body><section><p>News of the town</p><table>{cells}</table><ul><li>{_words(rng, 3)}</li></ul><p>Printed daily</p></section></body></html>"))
    rows += [(200 + i, ["", "<html><body></body></html>", "<html><body><p>404</p></body></html>"][i % 3]) for i in range(60)]
    for host, kept in (("a", rows), ("b", [r for r in rows if r[0] < 100 or r[0] >= 200]), ("c", rows[:60])):
        table = frame(spark, [(i, f"http://{host}.example/{i}", h) for i, h in kept], "page_id long, url string, html string")
        for r in wrapper.extract_text(table).collect():
            for words in ("Our shop", "Call us", "News of", "Printed"):
                assert words not in r["text"], (host, r["page_id"])
            if r["page_id"] < 200:
                assert r["n_chars"] > 80
            want[host, r["page_id"]] = r["text"]
    assert want["a", 3] == want["b", 3] if ("b", 3) in want else True


def test_template_votes_against_plain(spark):
    """Each page against its pivot, the votes and the texts worked out one by one."""
    rng = random.Random(6)
    rows = []
    for i in range(24):
        same = "".join(f"<p>{w}</p>" for w in ("Fixed one", "Fixed two") if rng.random() < 0.97)
        rows.append((i, "http://v.example", f"<body><div>{same}</div><div><p>{_words(rng, 9)}</p><p>{_words(rng, rng.randint(1, 9))}</p></div><p>End</p></body>"))
    rows += [(50, "http://v.example", rows[0][2]), (51, "http://w.example", rows[1][2])]
    trees = {h: wrapper.tree(h) for _, u, h in rows if u == "http://v.example"}
    got = {r["page_id"]: r for r in wrapper.extract_text(frame(spark, rows, "page_id long, url string, html string")).collect()}
    found = False
    for base_html, base in trees.items():  # whichever page was the pivot
        votes, pages = Counter(), Counter()
        seen_texts = set()
        nodes = wrapper.preorder(base)
        for root in trees.values():
            digest = wrapper.main_text(root)
            if digest in seen_texts:
                continue
            seen_texts.add(digest)
            for x, y in wrapper.align(base, root):
                if wrapper.own_text(x) and not x.aside:
                    pages[nodes.index(x)] += 1
                    votes[nodes.index(x)] += wrapper.own_text(x) == wrapper.own_text(y)
        fixed = {k for k in pages if pages[k] >= 5 and votes[k] >= 0.9 * pages[k]}
        texts = {}
        for i, u, h in rows:
            root = wrapper.tree(h)
            drop = frozenset(id(y) for x, y in wrapper.align(base, root) if nodes.index(x) in fixed and wrapper.own_text(x) == wrapper.own_text(y))
            texts[i] = wrapper.main_text(root, drop if u == "http://v.example" else frozenset())
        found |= texts == {i: r["text"] for i, r in got.items()}
    assert found and "End" not in got[3]["text"] and "End" in got[51]["text"]


def test_alignment_of_deep_trees():
    a = wrapper.tree("<div>" * 4000 + "<b>x</b><i>y</i>")
    b = wrapper.tree("<div>" * 4000 + "<i>y</i><u>z</u>")
    assert sum(1 for _ in wrapper.align(a, b)) == 4002
