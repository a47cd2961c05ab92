"""Words without case and outer punctuation, and sentences made of them, as spans of a block of texts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from assetgraph.llm.textvec import _P, mix, powers, span_hash, text_bytes, words

_U = np.uint64
_PUNCT = np.zeros(256, bool)
_PUNCT[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True
_WIDE = np.array([int.from_bytes(c.encode(), "big") for c in "。！？…।"])
_ARABIC = int.from_bytes("؟".encode(), "big")
#: Sentences of more words are cut where two words' hashes say so, alike wherever the words stand.
LONG = 16


@dataclass
class Words:
    """starts, ends: bytes of each word as it stands; hashes: of its plain form; of: the n + 1 offsets of each text's words."""

    buf: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    of: np.ndarray


def plain_words(column: pa.Array) -> Words:
    """Words of the lower-case texts. Lower case maps code point to code point, so places in code points stay those of the text."""
    buf, offsets = text_bytes(pc.utf8_lower(pc.fill_null(column, "")))
    starts, ends, of = words(buf, offsets)
    a, b = starts.copy(), ends.copy()
    while len(a):
        cut = (a < b) & _PUNCT[buf[np.minimum(a, len(buf) - 1)]]
        if not cut.any():
            break
        a[cut] += 1
    while len(a):
        cut = (a < b) & _PUNCT[buf[b - 1]]
        if not cut.any():
            break
        b[cut] -= 1
    return Words(buf, offsets, starts, ends, span_hash(buf, a, b) if len(a) else np.zeros(0, _U), of)


@dataclass
class Units:
    """Runs of words: first and last (exclusive) word, hash of the plain words, n + 1 offsets of each text's units, line of each unit."""

    first: np.ndarray
    last: np.ndarray
    hashes: np.ndarray
    of: np.ndarray
    line: np.ndarray


def _stops(w: Words) -> np.ndarray:
    """Whether a word ends in a stop."""
    byte = lambda back: w.buf[np.maximum(w.ends - back, 0)].astype(np.int64)
    last = byte(1)
    two = byte(2) << 8 | last
    return _STOP[last] | (two == _ARABIC) | np.isin(byte(3) << 16 | two, _WIDE)


def run_hash(w: Words, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of each run of words."""
    n = len(w.hashes)
    p, inv = powers(n + 1)
    total = np.concatenate([np.zeros(1, _U), np.cumsum(mix(w.hashes) * p[:n])])
    return mix((total[last] - total[first]) * inv[first] + _U(_P) * (last - first).astype(_U))


def units(w: Words, sentences: bool) -> Units:
    """Lines, or sentences within lines: a unit ends with its line, and for sentences after a word that ends in a stop. Long sentences are cut."""
    n = len(w.starts)
    if not n:
        return Units(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(len(w.of), np.int64), np.zeros(0, np.int64))
    newline = np.concatenate([[0], np.cumsum(w.buf == 10)])
    broken = np.zeros(n, bool)
    broken[:-1] = newline[w.starts[1:]] > newline[w.ends[:-1]]
    broken[w.of[1:][w.of[1:] > w.of[:-1]] - 1] = True
    final = broken.copy()
    if sentences:
        final |= _stops(w)
        ends = np.flatnonzero(final) + 1
        size = np.diff(ends, prepend=0)
        before = np.concatenate([np.zeros(1, _U), w.hashes[:-1]])
        before[ends - size] = 0
        final |= (np.repeat(size, size) > LONG) & ((mix(w.hashes + before * _U(_P)) & _U(7)) == 0)
    last = np.flatnonzero(final) + 1
    first = np.concatenate([[0], last[:-1]])
    return Units(first, last, run_hash(w, first, last), np.searchsorted(first, w.of), (np.cumsum(broken) - broken)[first])


def code_points(w: Words) -> np.ndarray:
    """The number of code points before each byte of the block, and in all."""
    return np.concatenate([[0], np.cumsum((w.buf & 0xC0) != 0x80)])
