"""Byte-level byte-pair encoding by replaying the merges over a corpus block.

The distinct words of a block of documents are laid out as one array of tokens
with links to their neighbours. An inverted index lists for each token pair the
positions where it occurs. The merges are applied in rank order, each to all its
positions at once, and a merge touches only the neighbours of the tokens that it
joins. A word's tokens then stand for all its occurrences in the block.

A block is what one Arrow batch holds, so memory is bounded by the batch size
and not by the corpus; blocks are independent and a lost one is simply redone.

Rules for odd input: a NULL text is empty and gives no tokens. Every row gives
one row, repeated identifiers included; other columns are ignored. An empty
table gives an empty table.
"""

from __future__ import annotations

import base64
import functools
import gc
import hashlib
import heapq
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amperic.llm.common import WORKED, chunks, map_batches, whole_text


class Vocabulary:
    """Tokens by rank, and the rank that each mergeable pair of tokens joins to."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.words = regex.compile(pattern)
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        # pairs are keyed by left * BASE + right
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            self.tokens[rank] = token
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    self.pairs[left * BASE + right] = rank
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        grid = (self.byte_ids[:, None] * BASE + self.byte_ids[None, :]).ravel().tolist()
        # by two successive bytes: the rank they join to, -1 for none
        self.byte_pairs = np.array([self.pairs.get(k, -1) for k in grid], np.int64)

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


BASE = 1 << 20


@functools.lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def _byte_index(data: np.ndarray, borders: np.ndarray, vocab: Vocabulary) -> dict[int, list[int]]:
    """Positions of the pairs of successive bytes, by the rank they join to."""
    ranks = vocab.byte_pairs[data[:-1].astype(np.int64) * 256 + data[1:]]
    ranks[borders[borders < len(ranks)]] = -1
    ranks[borders[borders > 0] - 1] = -1
    at = np.flatnonzero(ranks >= 0)
    order = at[np.argsort(ranks[at], kind="stable")]
    kinds, first = np.unique(ranks[order], return_index=True)
    return {int(k): part.tolist() for k, part in zip(kinds, np.split(order, first[1:]))}


def replay(words: list[bytes], vocab: Vocabulary) -> list[bytes]:
    """Ids of each distinct word as little-endian unsigned 32-bit integers, by
    one replay of all merges.

    The index is keyed by the joined token, which is a merge's rank: pairs that
    join to the same token are merged at the same time, from left to right. A
    heap gives the ranks in order; a rank enters it when its first position does.
    """
    if not words:
        return []
    # one byte between words is a border, which is part of no pair
    data = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
    borders = np.cumsum([len(w) + 1 for w in words]) - 1
    index = _byte_index(data, borders, vocab)
    token = vocab.byte_ids[data]
    token[borders] = -1
    token = token.tolist()
    n = len(token)
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    join = vocab.pairs.get
    ranks = list(index)
    heapq.heapify(ranks)
    while ranks:
        rank = heapq.heappop(ranks)
        for i in sorted(index.pop(rank)):
            left = token[i]
            if left < 0:
                continue
            j = nxt[i]
            right = token[j]
            # an earlier merge may have changed the pair
            if right < 0 or join(left * BASE + right) != rank:
                continue
            token[i], token[j] = rank, -2
            k = nxt[j]
            nxt[i], prv[k] = k, i
            right = token[k]
            if right >= 0:
                after = join(rank * BASE + right)
                if after is not None:
                    if after in index:
                        index[after].append(i)
                    else:
                        index[after] = [i]
                        heapq.heappush(ranks, after)
            h = prv[i]
            left = token[h] if h >= 0 else -1
            if left >= 0:
                before = join(left * BASE + rank)
                if before is not None:
                    if before in index:
                        index[before].append(h)
                    else:
                        index[before] = [h]
                        heapq.heappush(ranks, before)
    left = np.array(token)
    kept = np.flatnonzero(left >= 0)
    cuts = (4 * np.searchsorted(kept, borders)).tolist()
    packed = left[kept].astype("<u4").tobytes()
    return [packed[a:b] for a, b in zip([0, *cuts], cuts)]


# Blanks at which a text cannot simply be cut at single spaces and line ends.
UNEVEN = re.compile(r"\s\s|[^\S \n]")


class Encoder:
    """Ids of the words and units met so far in a task, in bounded dictionaries.

    A unit is what stands between single spaces or line ends. The pattern always
    ends a match there, so a unit's ids do not depend on its surroundings.
    """

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.words: dict[str, bytes] = {}
        # units that open a line, and units after a space
        self.units: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.line_end = replay([b"\n"], vocab)[0]

    def _learn(self, fresh: dict[str, list[str]]) -> None:
        """Replays the merges over the words that are new in these units."""
        found: set[str] = set()
        for ws in fresh.values():
            found.update(ws)
        for part in chunks(list(found.difference(self.words)), REPLAY_WORDS):
            self.words.update(zip(part, replay([w.encode() for w in part], self.vocab)))

    def block(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.words) + sum(map(len, self.units)) > KEPT_WORDS:
            self.words.clear()
            for known in self.units:
                known.clear()
        split = self.vocab.words.findall
        cut = [None if UNEVEN.search(t) else [line.split(" ") for line in t.split("\n")] for t in texts]
        needed: tuple[set[str], set[str]] = (set(), set())
        for lines in cut:
            for line in lines or ():
                needed[0].add(line[0])
                needed[1].update(line[1:])
        units = [{u: split(lead + u) for u in want.difference(known)} for want, known, lead in zip(needed, self.units, ("", " "))]
        whole = {t: split(t) for t, lines in zip(texts, cut) if lines is None}
        for fresh in (*units, whole):
            self._learn(fresh)
        get = self.words.__getitem__
        for fresh, known in zip(units, self.units):
            known.update((u, b"".join(map(get, ws))) for u, ws in fresh.items())
        opens, follows = (known.__getitem__ for known in self.units)
        out = []
        for t, lines in zip(texts, cut):
            if lines is None:
                out.append(b"".join(map(get, whole[t])))
            else:
                out.append(self.line_end.join([opens(x[0]) + b"".join(map(follows, x[1:])) for x in lines]))
        return out


# Words and units kept between the blocks of a task, and words in one replay.
KEPT_WORDS = 1_200_000
REPLAY_WORDS = 100_000


def _blocks(texts: list[str], size: int):
    """Runs of texts of about ``size`` characters."""
    block, held = [], 0
    for t in texts:
        block.append(t)
        held += len(t)
        if held >= size:
            yield block
            block, held = [], 0
    if block:
        yield block


def bpe_encode(
    docs: DataFrame, *, vocabulary_path: str, pattern: str, block_chars: int = WORKED, ids: bool = True, carry: Sequence[str] = ()
) -> DataFrame:
    """``doc_id``, ``n_tokens``, digests of the ids and of the decoded bytes, and
    with ``ids`` the ids themselves; then the columns named in ``carry``.

    ``vocabulary_path`` is a rank file that every executor can open; special
    tokens are ordinary text.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    schema += "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema) if carry else ""
    encoders: list[Encoder] = []

    def encode(texts: list[str], encoder: Encoder, vocab) -> dict[str, list]:
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": []}
        for block in _blocks(texts, block_chars):
            for packed in encoder.block(block):
                numbers = np.frombuffer(packed, "<u4")
                out["n_tokens"].append(len(numbers))
                out["ids_sha256"].append(hashlib.sha256(packed).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(vocab.decode(numbers.tolist())).hexdigest())
                if ids:
                    out["ids"].append(numbers.astype(np.int32))
        return out

    def run(batch: pa.RecordBatch) -> dict:
        vocab = vocabulary(vocabulary_path, pattern)
        if not encoders:
            encoders.append(Encoder(vocab))
        gc.disable()  # the many lists here form no cycles; looking for some takes a fifth of the time
        try:
            out = encode(batch.column("text").to_pylist(), encoders[0], vocab)
        finally:
            gc.enable()
        return {"doc_id": batch.column("doc_id"), **out, **{c: batch.column(c) for c in carry}}

    return map_batches(docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"), *carry), run, schema)


def bpe_decode(encoded: DataFrame, *, vocabulary_path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``text`` from the ids; a NULL list is an empty text."""

    def run(batch: pa.RecordBatch) -> dict:
        vocab = vocabulary(vocabulary_path, pattern)
        texts = [vocab.decode(x or ()).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "text": texts}

    return map_batches(encoded.select(F.col("doc_id").cast("long"), "ids"), run, "doc_id long, text string")
