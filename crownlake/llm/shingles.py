"""Hashed word shingles of many texts at once, in numpy.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. A shingle is ``width`` words in a row; a text with
fewer has its whole sequence as its only shingle; a text without words has none. Shingles are
64-bit hashes; two different ones of a corpus of 10**9 collide with a chance of about 3 %, and a collision
moves a similarity by one shingle at most.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_RNG = np.random.default_rng(0x5EED)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Odd multipliers by place in a word (times one by block of places in longer ones), and by place in a shingle.
_PLACE = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))
_MULT = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)
#: Bytes that are hashed at once.
SEGMENT = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on each other."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of one segment."""
    x = _LOWER[np.frombuffer(data, np.uint8)]
    if not len(x):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    space = _SPACE[x]
    start = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    letter = np.flatnonzero(~space)
    # places of letters in their words
    size = np.diff(np.append(np.searchsorted(letter, start), len(letter)))
    place = np.arange(len(letter)) - np.repeat(np.cumsum(size) - size, size)
    value = _BYTE[x[letter]] * _PLACE[place & 4095]
    if size.max() > 4096:
        value = value * np.where(place < 4096, _U(1), _PLACE[(place >> 12) & 4095] | _U(1))  # 1 for all short words, whatever stands beside them
    return mixed(np.add.reduceat(value, np.cumsum(size) - size) + size.astype(np.uint64)), start


def _long_words(data: bytes) -> np.ndarray:
    """Word hashes of one text of any size, by segments that end in white space."""
    out, at = [], 0
    while at < len(data):
        end = min(at + SEGMENT, len(data))
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        out.append(word_hashes(data[at:end])[0])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_hashes(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of the texts (with repeats) and the index of each one's text."""
    if len(texts) == 1 and len(texts[0]) > SEGMENT:
        words = _long_words(texts[0])
        doc = np.zeros(len(words), np.int64)
    else:
        words, start = word_hashes(b" ".join(texts))
        doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, side="right")
    n = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(n) - n
    hashes, docs = [], []
    if len(words) >= width:
        at = np.flatnonzero(doc[: len(doc) - width + 1] == doc[width - 1 :])
        hashes.append(_sequence(words, at, width)), docs.append(doc[at])
    for few in range(1, width):
        own = np.flatnonzero(n == few)
        if len(own):
            hashes.append(_sequence(words, first[own], few)), docs.append(own)
    return (np.concatenate(hashes), np.concatenate(docs)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _sequence(words: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hash of ``length`` words from each place."""
    h = np.full(len(at), length, np.uint64)
    for k in range(length):
        h += words[at + k] * _MULT[k]
    return mixed(h)


def sets_of(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted, in one array, and the limits of the texts in it."""
    h, doc = shingle_hashes(texts, width)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], np.concatenate([[0], np.cumsum(np.bincount(doc[keep], minlength=len(texts)))]).astype(np.int64)
