"""Secrets in text: base patterns, and random strings found by token efficiency.

A byte-pair vocabulary needs few tokens for language and many for random
characters. A string whose characters per token fall below a limit is reported,
unless it is a known digest or an identifier. Identifiers are told by the same
measure of their words alone. Letters of one case need a lower limit, as prose has
long words.

Rules for odd input: a NULL text is empty and has no spans. Every row gives one
row, repeated identifiers included; other columns are ignored. An empty table
gives an empty table. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import base64
import bisect
import functools
import hashlib
import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amperic.llm.common import map_batches, whole_text

# The base patterns.
ASSIGN = re.compile(
    r"""(?P<name>password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?(?P<value>[A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}

# A run of characters that keys are written in.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
# Lengths in hexadecimal digits of widely used digests.
DIGESTS = frozenset((32, 40, 56, 64, 96, 128))
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
HEXES = re.compile(r"[0-9a-fA-F]+\Z")
# Words of an identifier or a path, joined by signs, digits or camel case.
WORD = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{3,}")
JOINT = re.compile(r"[_/=+-]")
# Tokens are counted in pieces, so that a run of any length takes linear time.
PIECE = 2048


@functools.lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("scan", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, kinds numbered as listed."""
    out = []
    for m in ASSIGN.finditer(text):
        if len(m["value"]) >= LEAST["assign"]:
            out.append((m.start(), 0, m.end()))
    for kind, pattern, least in ((1, ACCESS, LEAST["access"]), (2, HEX, LEAST["hex"])):
        out += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if m.end() - m.start() >= least]
    return sorted(out)


def is_known(run: str) -> bool:
    """A digest, a universally unique identifier, or a number."""
    return bool(run.isdigit() or UUID.match(run) or (HEXES.match(run) and len(run) in DIGESTS))


def _tokens(run: str, encode) -> int:
    return sum(len(encode(run[i : i + PIECE])) for i in range(0, len(run), PIECE))


def is_identifier(run: str, encode, *, chars_per_token: float, letters_per_token: float, share: float = 0.6) -> bool:
    """Whether words of three letters or more make up the ``share`` of letters and
    digits and compress like language. Words between signs may do so less well."""
    words = [w for w in WORD.findall(run) if len(w) >= 3]
    letters = sum(map(len, words))
    limit = letters_per_token if JOINT.search(run) else chars_per_token
    return letters >= max(1, share * sum(map(str.isalnum, run))) and letters >= limit * sum(_tokens(w, encode) for w in words)


def random_spans(
    text: str, encode, *, chars_per_token: float, least: int, letters_per_token: float = 2.0
) -> list[tuple[int, int, int]]:
    """Runs of key characters that the vocabulary compresses badly (kind 3)."""
    out = []
    for m in RUN.finditer(text):
        run = m[0]
        core = run.strip("=-_+/")
        if len(core) < least or is_known(core):
            continue
        word = core.isalpha() and (core[1:].islower() or core.isupper())
        limits = {"chars_per_token": chars_per_token, "letters_per_token": letters_per_token}
        if len(core) >= limits["letters_per_token" if word else "chars_per_token"] * _tokens(core, encode):
            continue
        if word or not is_identifier(core, encode, **limits):
            out.append((m.start(), 3, m.end()))
    return out


def beside(spans: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans that touch no base span; both are sorted by start. Of the base spans that
    begin before a span ends, only the one that reaches farthest matters."""
    starts = [a for a, _, _ in base]
    reach = list(itertools.accumulate((b for _, _, b in base), max))
    out = []
    for s in spans:
        before = bisect.bisect_left(starts, s[2])
        if not before or reach[before - 1] <= s[0]:
            out.append(s)
    return out


KINDS = ("assign", "access", "hex", "random")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"


def _line(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def secret_scan(
    docs: DataFrame, *, vocabulary: str, pattern: str, chars_per_token: float = 2.2, least: int = 16, letters_per_token: float = 2.0
) -> DataFrame:
    """Spans per document: the base patterns, then random strings outside them.

    ``vocabulary`` is a rank file that every executor can open, ``pattern`` the
    expression that splits text before its merges. A random string that overlaps
    a base span is that span's secret and not reported twice. ``letters_per_token``
    is the limit for letters of one case and for words between signs.
    """

    def run(batch: pa.RecordBatch) -> dict:
        encode = _encoding(vocabulary, pattern).encode_ordinary
        out: dict[str, list] = {n: [] for n in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")}
        for text in batch.column("text").to_pylist():
            base = base_spans(text)
            more = random_spans(text, encode, chars_per_token=chars_per_token, least=least, letters_per_token=letters_per_token)
            more = beside(more, base)
            kinds = [k for _, k, _ in base]
            for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                out[name].append(kinds.count(k))
            out["base_sha256"].append(hashlib.sha256(_line(base).encode()).hexdigest())
            out["spans"].append(_line(base + more))
            out["n_random"].append(len(more))
        return {"doc_id": batch.column("doc_id"), **out}

    return map_batches(docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")), run, SCHEMA)
