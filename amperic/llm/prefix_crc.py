"""CRC-32 of every run of words from one scan of the text.

A normalised text is its words with one blank before each. The scan keeps the running
CRC at each word end. CRC is linear over GF(2): the value of a substring is the running
value at its end, cancelled by the one at its start shifted over the substring's length.
So no run of words is ever cut out or hashed by itself.
"""

from __future__ import annotations

import functools
import itertools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

_POLYNOMIAL = 0xEDB88320  # CRC-32 as in zlib, bits reflected
_NEAR = 256  # shifts below this many bytes have a table each

# Digits, letters and all bytes of characters beyond ASCII are words; A-Z become a-z.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)
_WORD = re.compile(rb" [^ ]+")


def _after(crc: np.ndarray) -> np.ndarray:
    """The contribution of a CRC once a zero byte has passed."""
    for _ in range(8):
        crc = (crc >> np.uint32(1)) ^ np.where(crc & np.uint32(1), np.uint32(_POLYNOMIAL), np.uint32(0))
    return crc


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


@functools.lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Per shift below ``_NEAR`` bytes, and per shift of ``_NEAR`` times a power of two,
    what each value of each of the four bytes becomes."""
    bytes_ = np.arange(256, dtype=np.uint32)
    near = [np.stack([bytes_ << np.uint32(8 * k) for k in range(4)])]
    for _ in range(_NEAR):
        near.append(_after(near[-1]))
    far = [near.pop()]
    while len(far) < 40:
        far.append(_apply(far[-1], far[-1]))
    return np.stack(near, axis=1), far


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Each CRC's contribution once ``length`` more bytes have passed."""
    near, far = _tables()
    low = length & (_NEAR - 1)
    out = near[0][low, crc & 255] ^ near[1][low, crc >> 8 & 255] ^ near[2][low, crc >> 16 & 255] ^ near[3][low, crc >> 24]
    rest = length >> 8
    k = 0
    while rest.any():
        odd = np.flatnonzero(rest & 1)
        out[odd] = _apply(far[k], out[odd])
        rest = rest >> 1
        k += 1
    return out


@dataclass
class Scan:
    """Running CRCs of successive words: before the word, after it, and where it begins and ends."""

    owner: np.ndarray
    before: np.ndarray
    after: np.ndarray
    start: np.ndarray
    end: np.ndarray


def scans(texts: list[bytes], size: int = 1 << 20, width: int = 3) -> Iterator[tuple[Scan, int]]:
    """Scans of the texts in blocks of about ``size`` bytes, and how many words at the
    head of a block were in the one before (the last ``width - 1`` of a text that goes on).

    One long text takes several blocks; its running values go on from block to block.
    """
    pieces: list[bytes] = []
    counts: list[tuple[int, int]] = []
    held = 0
    for i, text in enumerate(texts):
        if len(text) <= size:
            found = _WORD.findall(b" " + text.translate(_FOLD))
            pieces += found
            counts.append((i, len(found)))
            held += len(text)
            if held >= size:
                yield _scan(pieces, counts, 0, 0), 0
                pieces, counts, held = [], [], 0
            continue
        crc, at, tail = 0, 0, None
        for found in _stretches(text, size):
            scan = _scan(found, [(i, len(found))], crc, at)
            if len(found):
                crc, at = int(scan.after[-1]), int(scan.end[-1])
            carried = 0 if tail is None else len(tail.owner)
            if carried:
                scan = Scan(*(np.concatenate([getattr(tail, f), getattr(scan, f)]) for f in Scan.__dataclass_fields__))
            yield scan, carried
            tail = Scan(*(getattr(scan, f)[max(0, len(scan.owner) - width + 1) :] for f in Scan.__dataclass_fields__))
    if counts:
        yield _scan(pieces, counts, 0, 0), 0


def _stretches(text: bytes, size: int) -> Iterator[list[bytes]]:
    """The words of a long text, cut between words."""
    rest = b""
    for a in range(0, len(text), size):
        part = rest + text[a : a + size].translate(_FOLD)
        cut = len(part) if a + size >= len(text) else part.rfind(b" ") + 1
        rest = part[cut:]
        yield _WORD.findall(b" " + part[:cut])


def _scan(pieces: list[bytes], counts: list[tuple[int, int]], crc: int, at: int) -> Scan:
    n = len(pieces)
    sizes = np.fromiter(map(len, pieces), np.int64, n)
    running = itertools.accumulate(pieces, lambda c, piece: zlib.crc32(piece, c), initial=crc)
    all_ = np.fromiter(running, np.uint32, n + 1)
    end = at + np.cumsum(sizes)
    before = shifted(all_[:-1], np.ones(n, np.int64)) ^ np.uint32(zlib.crc32(b" "))
    owner = np.repeat([i for i, _ in counts], [k for _, k in counts]).astype(np.int64)
    return Scan(owner, before, all_[1:], end - sizes + 1, end)


def ngram_crcs(texts: list[bytes], width: int = 3) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (text number, words in the run, CRC-32) of all runs of 1 to ``width`` words."""
    for scan, carried in scans(texts, width=width):
        n = len(scan.owner)
        for k in range(width):
            last = np.arange(max(k, carried), n)
            last = last[scan.owner[last - k] == scan.owner[last]]
            first = last - k
            crc = scan.after[last] ^ shifted(scan.before[first], scan.end[last] - scan.start[first])
            yield scan.owner[last], np.full(len(last), k + 1), crc
