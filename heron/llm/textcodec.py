"""Vectorised word and shingle hashing of Arrow string batches (numpy, no per-word Python)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes hashed at a time (about 100 bytes of working memory each); a longer text is hashed alone.
CHUNK = 1 << 18
#: Longer words are hashed by BLAKE2: a polynomial modulo 2^64 has equal values for some words of 1,024 letters and more.
LONG_WORD = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
_P = 0x5851F42D4C957F2D
_P_INVERSE = pow(_P, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


class _Powers:
    """Powers of the base and its inverse, as many as the longest chunk so far needed."""

    n = 0

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if cls.n < n:
            cls.up, cls.down, cls.n = _powers(_P, n), _powers(_P_INVERSE, n), n
        return cls.up, cls.down


def chunks(texts: pa.Array):
    """(first row, row offsets, bytes) of runs of whole texts of about CHUNK bytes; null is empty."""
    texts = pa.concat_arrays([texts.fill_null("").cast(pa.large_string())])
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + CHUNK, "right")) - 1)
        yield i, bounds[i : j + 1] - bounds[i], data[bounds[i] : bounds[j]]
        i = j


def _long_hash(word: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(_FOLD[word].tobytes(), digest_size=8).digest(), "little")


def _word_hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    word = ~_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.concatenate([[False], word[:-1]])
    starts = np.flatnonzero(word & (~before | cut[:-1]))
    after = np.concatenate([word[1:], [False]])
    ends = np.flatnonzero(word & (~after | cut[1:])) + 1
    up, down = _Powers.get(n + 1)
    total = np.zeros(n + 1, U)
    np.cumsum(_BYTE[_FOLD[data]] * up[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U))
    for k in np.flatnonzero(ends - starts > LONG_WORD):
        hashes[k] = _long_hash(data[starts[k] : ends[k]])
    return hashes, starts


def word_hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash of each word [^space]+ with A-Z folded, its first byte, and where each text's words begin.

    One long text is read in pieces that end at a blank.
    """
    n = len(data)
    found = [(np.zeros(0, U), np.zeros(0, np.int64))]
    if len(offsets) > 2 or n <= 2 * CHUNK:
        found.append(_word_hashes(offsets, data) if n else found[0])
    else:
        at = 0
        while at < n:
            to = min(at + CHUNK, n)
            if to < n:
                blanks = np.flatnonzero(_SPACE[data[at:to]])
                if not len(blanks):  # one word, longer than a piece
                    while to < n and not (more := np.flatnonzero(_SPACE[data[to : to + CHUNK]])).size:
                        to = min(to + CHUNK, n)
                    to += int(more[0]) if to < n else 0
                    found.append((np.array([_long_hash(data[at:to])], U), np.array([at])))
                    at = to
                    continue
                to = at + int(blanks[-1]) + 1
            h, s = _word_hashes(np.array([0, to - at]), data[at:to])
            found.append((h, s + at))
            at = to
    hashes, starts = (np.concatenate(x) for x in zip(*found, strict=True))
    return hashes, starts, np.searchsorted(starts, offsets)


def shingle_sets(texts: pa.Array, width: int):
    """(row, sorted distinct shingle hashes) of each text, empty texts too."""
    for first, offsets, data in chunks(texts):
        words, _, at = word_hashes(offsets, data)
        if len(words) >= width:
            whole = np.zeros(len(words) - width + 1, U)
            for k in range(width):
                whole = whole * U(0xD6E8FEB86659FD93) + words[k : k + len(whole)]
            whole = mix(whole)
        for r in range(len(offsets) - 1):
            a, b = int(at[r]), int(at[r + 1])
            if b - a >= width:
                s = np.unique(whole[a : b - width + 1])
            elif b > a:
                h = b - a
                for w in words[a:b]:
                    h = (h * (0xD6E8FEB86659FD93 ^ 0xFF) + int(w)) % (1 << 64)
                s = mix(np.array([h], U))
            else:
                s = np.zeros(0, U)
            yield first + r, s
