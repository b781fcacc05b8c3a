"""64-bit hashes of the words of many texts at once, from the Arrow buffers.

A word is a maximal run of bytes other than space and \\x09-\\x0D. Its hash is a sum of
random byte values times odd position factors, mixed at the end, so that a
whole slice of texts is hashed with a few numpy passes and no Python object per
word. Two different words share a hash with a chance of about 2**-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_POWER = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes of letters: ASCII letters and all of the bytes of other scripts' characters.
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(30))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h = h * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts on end, and the n + 1 offsets; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    n = len(texts)
    _, offsets, data = texts.buffers()
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def word_spans(raw: np.ndarray, at: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words; `inside` tells which bytes belong to words."""
    in_word = ~_SPACE[raw] if inside is None else inside
    first = in_word.copy()
    first[1:] &= ~in_word[:-1]
    bounds = at[1:-1]
    bounds = bounds[bounds < len(raw)]
    first[bounds] = in_word[bounds]
    last = in_word.copy()
    last[:-1] &= ~in_word[1:]
    ends = bounds[bounds > 0] - 1
    last[ends] = in_word[ends]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


#: Bytes whose factors are laid out at once; each takes about 40 bytes of memory there.
CHUNK = 256 << 10


def _weighted(raw: np.ndarray, starts: np.ndarray, size: np.ndarray, fold: bool, passed: int = 0) -> np.ndarray:
    """The sum of factors of each span; `passed` bytes of the word lie before it."""
    # the words' bytes on end, without what lies between
    begin = np.cumsum(size) - size
    index = np.arange(int(size.sum()), dtype=np.int64)
    offset = index - np.repeat(begin, size)
    value = (_FOLDED if fold else _BYTE)[raw[offset + np.repeat(starts, size)]]
    offset += passed
    with np.errstate(over="ignore"):
        value *= _POWER[offset & 255]
        if passed or (size > 256).any():  # later rounds of 256 bytes get factors of their own
            value *= np.uint64(2) * (offset >> 8).astype(np.uint64) + np.uint64(1)
        return np.add.reduceat(value, begin)


def hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True, most: int | None = None) -> np.ndarray:
    """A hash per word; `fold` lower-cases A-Z, `most` takes the first bytes only.

    Words are taken in runs of at most `CHUNK` bytes, and a longer word piece by piece.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    if most is not None:
        ends = np.minimum(ends, starts + most)
    size = ends - starts
    upto = np.cumsum(size)
    sums = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        if size[i] > CHUNK:
            with np.errstate(over="ignore"):
                for passed in range(0, int(size[i]), CHUNK):
                    piece = np.array([min(CHUNK, int(size[i]) - passed)])
                    sums[i : i + 1] += _weighted(raw, starts[i : i + 1] + passed, piece, fold, passed)
            i += 1
            continue
        j = int(np.searchsorted(upto, upto[i] - size[i] + CHUNK, side="right"))
        sums[i:j] = _weighted(raw, starts[i:j], size[i:j], fold)
        i = j
    with np.errstate(over="ignore"):
        return mix(sums + size.astype(np.uint64))


def words_of(texts: pa.Array, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts on end, and the n + 1 word offsets."""
    raw, at = text_bytes(texts)
    starts, ends = word_spans(raw, at)
    return hash_words(raw, starts, ends, fold), np.searchsorted(starts, at)


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k words in one text."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.full(n, k, np.uint64)
        for i in range(k):
            h = (h ^ words[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return mix(h)


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-word shingles; a shorter text is one shingle, an empty one none."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(windows(words, min(k, len(words))))
