"""Quality rules: base counts, and the divergence of a document's character
classes and common words from references of its language.

Rules for odd input: a NULL text is empty; an empty text has zero counts and
fails the base rule. A document without a language, or of one that is too small to have
a reference, is compared with all references. Tests that need more characters or words than a document has are not applied. Every
row gives one row, repeated identifiers included; other columns are ignored. An
empty table gives an empty table.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from amperic.llm.common import WORKED, chunks, fresh, map_batches, offsets, spans, utf8, windows, whole_text

SYMBOLS = b"#*$%&|<>"
# The character classes of the histogram, by UTF-8 byte. Bytes that
# continue a character belong to none.
CLASS_NAMES = ("lower", "upper", "digit", "space", "newline", "stop", "quote", "symbol", "other_ascii", "control", "latin", "beyond", "pipe")


def _class_table() -> np.ndarray:
    table = np.full(256, CLASS_NAMES.index("beyond"), np.int64)
    table[:128] = CLASS_NAMES.index("other_ascii")
    table[:32] = table[127] = CLASS_NAMES.index("control")
    groups = {
        "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789",
        "space": b" \t", "newline": b"\n\r", "stop": b".,;:!?", "quote": b"'\"()-", "symbol": SYMBOLS + b"@^_=+~\\/{}[]`",
    }
    for name, chars in groups.items():
        table[list(chars)] = CLASS_NAMES.index(name)
    table[ord("|")] = CLASS_NAMES.index("pipe")  # what menus are joined by
    table[0xC3:0xCA] = CLASS_NAMES.index("latin")
    table[0x80:0xC0] = -1
    return table


_CLASSES = _class_table()
# Lower-cases ASCII letters and turns ASCII punctuation and digits into blanks.
_PLAIN = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)
)


@dataclass(frozen=True)
class Limits:
    """Jensen-Shannon distances (0 to 1) that a long text may have, and the least
    lengths at which each test is applied. A sample of ``n`` strays from its
    source by the order of ``1 / sqrt(n)``, so ``sqrt(noise / n)`` is allowed on top.
    """

    char_distance: float = 0.12
    char_noise: float = 4.0
    word_distance: float = 0.33
    word_noise: float = 2.6
    min_chars: int = 100
    min_words: int = 30
    min_doc_words: int = 10
    repeat_percent: int = 20

    def chars(self, n: np.ndarray) -> np.ndarray:
        return np.where(n < self.min_chars, 1.0, self.char_distance + np.sqrt(self.char_noise / np.maximum(n, 1)))

    def words(self, n: np.ndarray) -> np.ndarray:
        return np.where(n < self.min_words, 1.0, self.word_distance + np.sqrt(self.word_noise / np.maximum(n, 1)))


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and where each text begins."""
    return np.frombuffer(b"".join(texts), np.uint8), offsets([len(t) for t in texts])


def class_counts(texts: list[bytes]) -> np.ndarray:
    """Characters per class, one row per text."""
    data, at = _joined(texts)
    k = len(CLASS_NAMES)
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    kinds = _CLASSES[data]
    seen = kinds >= 0
    return np.bincount(owner[seen] * k + kinds[seen], minlength=len(texts) * k).reshape(-1, k)


def _count_language(texts: list[bytes], words: Counter) -> np.ndarray:
    for t in texts:
        words.update(t.translate(_PLAIN).split())
    return class_counts(texts).sum(axis=0)


def language_references(docs: DataFrame, *, n_words: int = 200, max_languages: int | None = None, base: Limits | None = None) -> dict[str, dict[str, Any]]:
    """Character-class counts (``c``), the most common words (``w``), and how many words
    (``t``) and documents (``d``) they stand for, per language over all documents, or,
    with ``base``, over those that pass its base rule. The driver takes ``n_words`` and a
    few rows of each language. With ``max_languages``, languages beyond the largest
    share the reference ``""`` with documents without a language.
    """
    known = None
    if max_languages is not None:
        sizes = docs.filter("lang is not null").groupBy("lang").agg(F.count("*").alias("n"))
        known = {r["lang"] for r in sizes.orderBy(F.desc("n"), "lang").limit(max_languages).collect()}

    def count(batches):
        kept: dict[str, Counter] = {}
        sums: dict[str, np.ndarray] = {}
        seen: Counter = Counter()

        def rows():
            out = itertools.chain(
                ((lang, "w", w.decode("utf-8", "replace"), n) for lang, c in kept.items() for w, n in c.items()),
                ((lang, "c", CLASS_NAMES[i], int(n)) for lang, s in sums.items() for i, n in enumerate(s)),
                ((lang, "t", "", c.total()) for lang, c in kept.items()),
                ((lang, "d", "", n) for lang, n in seen.items()),
            )
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64()]
            for part in chunks(out, 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*part), kinds)], names=["lang", "kind", "item", "n"])
            for held in (kept, sums, seen):
                held.clear()

        for batch in batches:
            whole, langs = utf8(batch), batch.column("lang").to_pylist()
            for a, b in spans(whole, WORKED):
                by_lang: dict[str, list[bytes]] = {}
                texts = whole[a:b]
                passed = np.ones(len(texts), bool) if base is None else ~base_failures(texts, base)
                for lang, text, ok in zip(langs[a:b], texts, passed.tolist()):
                    if ok:
                        own = lang is not None and (known is None or lang in known)
                        by_lang.setdefault(lang if own else "", []).append(text)
                for lang, texts in by_lang.items():
                    found = _count_language(texts, kept.setdefault(lang, Counter()))
                    sums[lang] = sums.get(lang, 0) + found
                    seen[lang] += len(texts)
                if sum(map(len, kept.values())) > 400_000:
                    yield from rows()
        yield from rows()

    counts = (
        docs.select(F.col("lang").cast("string"), whole_text().alias("text"))
        .mapInArrow(count, "lang string, kind string, item string, n long")
        .groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    )
    order = W.partitionBy("lang", "kind").orderBy(F.desc("n"), "item")
    top = counts.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= n_words)
    found: dict[str, dict[str, Any]] = {}
    for r in top.collect():
        ref = found.setdefault(r["lang"], {"c": {}, "w": {}, "t": 0, "d": 0})
        if r["kind"] in "td":
            ref[r["kind"]] = r["n"]
        else:
            ref[r["kind"]][r["item"]] = r["n"]
    return found


def _jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distance (root of the divergence in bits) of each row of ``p`` from ``q``."""
    p = p / np.maximum(p.sum(axis=1, keepdims=True), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.maximum((left + right) / 2, 0))


def founded(refs: dict[str, dict[str, Any]], *, least_docs: int, least_words: int) -> dict[str, dict[str, Any]]:
    """References that rest on enough documents and words for a language to vouch for its
    own. Where none does, one of all documents together stands in."""
    found = {k: r for k, r in refs.items() if k and r["d"] >= least_docs and r["t"] >= least_words}
    if found or not refs:
        return found
    pooled: dict[str, Any] = {"c": Counter(), "w": Counter(), "t": 0, "d": 0}
    for r in refs.values():
        pooled["c"].update(r["c"])
        pooled["w"].update(r["w"])
        pooled["t"] += r["t"]
        pooled["d"] += r["d"]
    return {"": pooled}


class _Model:
    """References as arrays: one character histogram and one word list a language."""

    def __init__(self, refs: dict[str, dict[str, Any]]):
        self.vocabulary: dict[bytes, int] = {}
        self.languages = []
        self.place: dict[str, int] = {}
        for name, ref in sorted(refs.items()):
            if not ref["t"]:
                continue
            self.place[name] = len(self.languages)
            chars = np.array([ref["c"].get(k, 0) for k in CLASS_NAMES], float)
            ids = [self.vocabulary.setdefault(w.encode(), len(self.vocabulary)) for w in ref["w"]]
            words = np.array([*ref["w"].values(), max(0, ref["t"] - sum(ref["w"].values()))], float)
            self.languages.append((chars / chars.sum(), np.array(ids, np.int64), words / words.sum()))

    def word_counts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the known words per text, and of all plain words."""
        get, size = self.vocabulary.get, len(self.vocabulary)
        out, totals = np.zeros((len(texts), size)), np.zeros(len(texts))
        for i, t in enumerate(texts):
            words = t.translate(_PLAIN).split()
            totals[i] = len(words)
            ids = [k for w in words if (k := get(w)) is not None]
            if ids:
                out[i] = np.bincount(ids, minlength=size)
        return out, totals

    def distances(self, texts: list[bytes], classes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Character and word distance per text and language, and the plain words."""
        counts, totals = self.word_counts(texts)
        chars = np.ones((len(texts), max(1, len(self.languages))))
        words = np.ones_like(chars)
        for k, (ref_chars, ids, ref_words) in enumerate(self.languages):
            own = counts[:, ids]
            own = np.column_stack([own, totals - own.sum(axis=1)])
            chars[:, k] = _jensen_shannon(classes, ref_chars)
            words[:, k] = _jensen_shannon(own, ref_words)
        return chars, words, totals


def _repeats(words: list[list[bytes]], width: int = 5) -> np.ndarray:
    """Words per text inside a window of ``width`` words that the text has twice."""
    counts = [len(w) for w in words]
    at = offsets(counts)
    flat = np.fromiter((hash(w) for ws in words for w in ws), np.int64, at[-1]).view(np.uint64)
    owner = np.repeat(np.arange(len(words)), counts)
    out = np.zeros(len(words), np.int64)
    if len(flat) < width:
        return out
    inside = owner[: 1 - width] == owner[width - 1 :]
    starts = np.flatnonzero(inside)
    # the owner is part of the key, so that windows of other texts do not count
    keys = windows(flat, width)[starts] + owner[starts].astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    marks = np.zeros(len(flat) + 1, np.int64)
    np.add.at(marks, starts[twice], 1)
    np.add.at(marks, starts[twice] + width, -1)
    covered = np.cumsum(marks[:-1]) > 0
    return np.bincount(owner[covered], minlength=len(words))


def base_failures(texts: list[bytes], limits: Limits) -> np.ndarray:
    words = [t.split() for t in texts]
    n_words = np.array([len(w) for w in words], np.int64)
    return (n_words < limits.min_doc_words) | (100 * _repeats(words) > limits.repeat_percent * n_words)


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.split(None, 1)]
    return len(lines) - len(set(lines))


def assess(texts: list[bytes], model: _Model, limits: Limits, langs: Sequence[str | None] | None = None) -> dict[str, np.ndarray]:
    words = [t.split() for t in texts]
    n_words = np.array([len(w) for w in words], np.int64)
    data, at = _joined(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    blank = np.isin(data, np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
    solid = ((data & 0xC0) != 0x80) & ~blank
    symbol = np.isin(data, np.frombuffer(SYMBOLS, np.uint8))
    n_repeat = _repeats(words)
    classes = class_counts(texts)
    chars, wordy, totals = model.distances(texts, classes)
    fits = (chars <= limits.chars(classes.sum(axis=1))[:, None]) & (wordy <= limits.words(totals)[:, None])
    best = np.argmin(chars + wordy, axis=1)
    rows = np.arange(len(texts))
    # a document answers to its own language's reference where there is one
    own = np.array([model.place.get(lang, -1) for lang in langs or [None] * len(texts)], np.int64)
    best = np.where(own >= 0, own, best)
    close = np.where(own >= 0, fits[rows, best], fits.any(axis=1)) if len(texts) else np.zeros(0, bool)
    failed = (n_words < limits.min_doc_words) | (100 * n_repeat > limits.repeat_percent * n_words)
    return {
        "n_words": n_words,
        "word_chars": np.bincount(owner[solid], minlength=len(texts)),
        "n_symbols": np.bincount(owner[symbol], minlength=len(texts)),
        "n_dup_lines": np.array([_dup_lines(t) for t in texts], np.int64),
        "n_repeat_words": n_repeat,
        "base_failed": failed,
        "kept": ~failed & (close if model.languages else True),
        "char_distance": np.round(chars[rows, best], 6),
        "word_distance": np.round(wordy[rows, best], 6),
    }


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, char_distance double, word_distance double"
)


def quality_rules(
    docs: DataFrame,
    *,
    limits: Limits = Limits(),
    n_words: int = 200,
    max_languages: int = 256,
    least_docs: int = 20,
    least_words: int = 2000,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Base counts and the verdict per document, and the columns named in ``carry``.

    A document stays if it is close, in both its character classes and its common
    words, to the reference of its own language; where that language has none, to that
    of any. A language has a reference if it is one of the ``max_languages`` largest and
    ``least_docs`` of its documents with ``least_words`` words pass the base rule; only
    these are counted. Distances shown are those from the reference that decides, or the
    nearest.
    """
    refs = language_references(docs, n_words=n_words, max_languages=max_languages, base=limits)
    model = _Model(founded(refs, least_docs=least_docs, least_words=least_words))

    def run(batch: pa.RecordBatch) -> dict:
        texts, langs = utf8(batch, text), batch.column(lang).to_pylist()
        parts = [assess(texts[a:b], model, limits, langs[a:b]) for a, b in spans(texts, WORKED, 500)]
        out = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {}
        if not parts:
            out = assess([], model, limits)
        return {"doc_id": batch.column(key), **out, **{c: batch.column(c) for c in passed}}

    key, text, lang = fresh(docs, "id", "text", "lang")
    passed = [c for c in carry if c != "doc_id"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*passed).schema) if passed else ""
    rows = docs.select(F.col("doc_id").cast("long").alias(key), whole_text().alias(text), F.col("lang").cast("string").alias(lang), *passed)
    return map_batches(rows, run, SCHEMA + (", " + kinds if kinds else ""))
