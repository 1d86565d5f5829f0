"""Toxicity by class-conditional Kneser-Ney models.

Two word bigram models, of toxic and of ordinary texts, are compared:

    P_c(w | v) = max(n_c(v, w) - B, 0) / n_c(v) + rest_c(v) * P_c(w)
    P_c(w)     = max(N_c(w) - D_c, 0) / N_c     + rest_c    * P_c(s) * P(w | s)
    P_c(s)     = max(N_c(s) - S_c, 0) / N_c     + rest_c'   * P(s)

All counts are Kneser-Ney counts of different contexts, so copies of a text don't count: n_c(v, w) counts
words before v, N_c(w) words before w, N_c(s) sums these over the stem s of w (its first STEM
letters). P(w | s) and P(s) are shared by both classes. Discounts are larger than the usual ones below 1, so
that an expression that is rare in a class stands for its shared backoff there; those of words and stems
grow with the size of the class, so that both classes leave about the same mass to the shared counts.

The log of P_toxic / P_ordinary is taken for each word of a text. Its mean is the length-normalised
comparison. As a few expressions make a long text toxic, the excess of a word's ratio over EXCESS nats is
averaged too, over the text and over its best window. A logistic calibration of these on labelled rows that
took no part in the counts gives the score. Then the counts are made again with these rows.

Scale: most words, bigrams and stems are below the discounts of both classes, so that their ratio is that of
their backoff; the model is a table of all others, each with what it adds to the coarser level. It grows
with the corpus. The most frequent entries are broadcast, for speed alone; other names that may have an
entry (a bit filter) are joined by shuffle. Values are fixed-point numbers, so sums don't depend on their order.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import crc_remainder, drop_stored, most_frequent, release, ship, sliced, stored

#: Most values that are broadcast (the others are joined), and bits of the filter of names with a value.
HEAD, FILTER_BITS = 1_000_000, 1 << 26
#: Letters of a stem.
STEM = 5
#: Discounts of words and of stems in the smaller class (in the other in proportion to its size), and of bigrams.
WORD_DISCOUNT, STEM_DISCOUNT, BIGRAM_DISCOUNT = 2.0, 4.0, 8
#: Read by a test only: more than the values of the crc32 by which it tells contexts apart.
CONTEXTS = 1 << 48
#: Most labels and words that are broadcast to the texts and bigrams, and most rows for the calibration.
BROADCAST_LABELS, BROADCAST_WORDS, CALIBRATION_ROWS = 5_000_000, 200_000, 20_000
#: Words in a half of a window (windows overlap by it), and contexts of bigrams that one task holds before it passes them on.
HALF, TASK_KEYS = 16, 1_000_000
#: Different words that a counting task numbers before it passes on what it holds, and bytes of text whose bigrams make a bucket.
NUMBER_BITS, BUCKET_BYTES = 20, 24 << 20
#: Words whose entries a task remembers.
CACHED_WORDS = 200_000
#: Nats of a word's ratio beyond which it is evidence of its own.
EXCESS = 1.0
#: Steps of a nat in the values; x nats per word enter the calibration as log(1 + SCALE * x), so that copied toxic texts don't rule it.
UNIT, SCALE = 1_000_000_000, 100.0

#: What the calibration weighs.
FEATURES = ("ratio", "mean", "window", "log_words")
CLASSES = ("toxic", "ordinary")
_WORD = re.compile(r"[^\W_]+")
_START = ""
_SUMS = [f"{x}{late}" for late in (0, 1) for x in CLASSES]
#: Of ASCII bytes: letters in lower case, digits, spaces for the others.
_ASCII = bytes(ord(chr(k).lower()) if chr(k).isalnum() else 32 for k in range(128)) + bytes(128)


def words_of(text: str) -> list[str]:
    if text.isascii():  # the same words, faster
        return text.encode().translate(_ASCII).decode().split()
    return _WORD.findall(text.lower())


class _Numbers(dict):
    """Words numbered in the order in which they are asked for."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


@dataclass
class KneserNey:
    """Values by name in steps of 1 / UNIT nats. Names: "\\0s" + stem, "\\0w" + word, "\\0v" + context, "v w" of a bigram.

    A word's ratio in its place is ``base`` and the sum of the values of its stem, itself, its context and its bigram.
    """

    base: int
    entries: DataFrame  # name, value
    head: Head  # the broadcast part of it
    live: np.ndarray | None  # bits of the names' crc32; None if ``head`` is all
    probabilities: DataFrame  # word, p0 (toxic), p1 (ordinary); stems begin with "\\0"
    weights: np.ndarray | None = None  # of the calibration: bias, then FEATURES

    @property
    def words(self) -> list[str]:
        """All words and stems in order, gathered; for looking into small models."""
        return sorted(r.word for r in self.probabilities.select("word").toLocalIterator())

    @property
    def p(self) -> np.ndarray:
        """Probabilities in the order of ``words``."""
        return np.array([r[1:] for r in sorted(map(tuple, self.probabilities.toLocalIterator()))], float).reshape(-1, 2)

    def drop(self) -> None:
        """Delete the model's tables."""
        for table in (self.entries, self.probabilities):
            drop_stored(table)


@dataclass
class Head:
    """The most frequent entries in arrays. Words are numbered; bigrams are numbers of v << 32 | number of w, in order."""

    stems: pa.Array
    stem_values: np.ndarray
    words: pa.Array
    word_values: np.ndarray
    contexts: np.ndarray
    has_word: np.ndarray
    has_context: np.ndarray
    pairs: np.ndarray
    pair_values: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> Head:
        """From name and value."""
        name, value = pa.concat_arrays([pa.array([], pa.string()), *(c.cast(pa.string()) for c in table["name"].chunks)]), table["value"].to_numpy()
        kind = pc.utf8_slice_codeunits(name, 0, 2)
        is_kind = [pc.equal(kind, "\x00" + k).to_numpy(zero_copy_only=False) for k in "swv"]
        is_pair = ~np.logical_or.reduce(is_kind)
        stems, words, before = (pc.utf8_slice_codeunits(name.filter(pa.array(own)), 2) for own in is_kind)
        ends = pc.split_pattern(name.filter(pa.array(is_pair)), " ").flatten()
        coded = pa.concat_arrays([words, before, ends]).dictionary_encode()
        number = coded.indices.to_numpy().astype(np.int64)
        n, m = len(words), len(words) + len(before)
        sums, has = np.zeros((2, len(coded.dictionary)), np.int64), np.zeros((2, len(coded.dictionary)), bool)
        for k, at in enumerate((number[:n], number[n:m])):
            sums[k, at], has[k, at] = value[is_kind[k + 1]], True
        pairs = number[m::2] << 32 | number[m + 1 :: 2]
        order = np.argsort(pairs)
        return cls(stems, value[is_kind[0]], coded.dictionary, *sums, *has, pairs[order], value[is_pair][order])


def _crc_steps(most: int) -> np.ndarray:
    """What n zero bytes (n up to ``most``) make of each byte of a crc32's register: by n, place, byte."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, step >> 1 ^ np.uint32(0xEDB88320), step >> 1)
    out = [np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None]]
    for _ in range(most):
        out.append(out[-1] >> np.uint32(8) ^ step[out[-1] & np.uint32(255)])
    return np.array(out)


class _Lexicon:
    """What a task found for the words of its texts, by their numbers. It is made by each task: a worker that kept it would hold it
    through later stages.

    Open names are those that aren't in the head and may have a value all the same.
    """

    #: Bits of a word's open names: of its stem, itself, its context.
    STEM, WORD, CONTEXT = 1, 2, 4
    LONG = 64

    def __init__(self, head: Head, live: np.ndarray | None, base: int):
        self.head, self.live, self.base = head, live, base
        self.of_word = dict(zip(head.words.to_pylist(), range(len(head.words)), strict=True))
        self.of_stem = dict(zip(head.stems.to_pylist(), head.stem_values.tolist(), strict=True))
        self.steps = None if live is None else _crc_steps(self.LONG)
        self.clear()

    def clear(self) -> None:
        self.numbers = _Numbers()
        # by word: its stem's and its own value with the base, its context's value, its number in the head, open names, whether bigrams may follow
        self.own, self.context, self.place = (np.zeros(0, np.int64) for _ in range(3))
        self.opens, self.goes_on = np.zeros(0, np.uint8), np.zeros(0, bool)
        self.crc, self.crc_before, self.size = np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.names = pa.array([], pa.string())
        self.learn([_START])

    def is_open(self, crc: np.ndarray) -> np.ndarray:
        x = crc.astype(np.int64) % FILTER_BITS
        return (self.live[x >> 3] >> (x & 7).astype(np.uint8) & 1).astype(bool)

    def learn(self, words: list[str]) -> None:
        head, n = self.head, len(words)
        for w in words:
            self.numbers[w]  # numbers it
        place = np.fromiter((self.of_word.get(w, -1) for w in words), np.int64, n)
        stem = [self.of_stem.get(w[:STEM]) for w in words]
        known = place >= 0
        at = place[known]
        own = np.fromiter((x or 0 for x in stem), np.int64, n) + self.base
        own[known] += head.word_values[at]
        context, has_word, has_context = np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n, bool)
        context[known], has_word[known], has_context[known] = head.contexts[at], head.has_word[at], head.has_context[at]
        opens = np.zeros(n, np.uint8)
        if self.live is not None:
            coded = [w.encode("utf-8", "surrogatepass") for w in words]
            crc = lambda f: np.fromiter(map(f, coded), np.uint32, n)
            of_stem = np.fromiter((zlib.crc32(("\x00s" + w[:STEM]).encode("utf-8", "surrogatepass")) for w in words), np.uint32, n)
            no_stem = np.fromiter((x is None for x in stem), bool, n)
            opens |= self.STEM * (no_stem & self.is_open(of_stem)).astype(np.uint8)
            opens |= self.WORD * (~has_word & self.is_open(crc(lambda w: zlib.crc32(b"\x00w" + w)))).astype(np.uint8)
            opens |= self.CONTEXT * (~has_context & self.is_open(crc(lambda w: zlib.crc32(b"\x00v" + w)))).astype(np.uint8)
            self.crc, self.crc_before = np.append(self.crc, crc(zlib.crc32)), np.append(self.crc_before, crc(lambda w: zlib.crc32(w + b" ")))
            self.size = np.append(self.size, np.fromiter(map(len, coded), np.int64, n))
            self.names = pa.concat_arrays([self.names, pa.array(words, pa.string())])
        self.own, self.context, self.place = np.append(self.own, own), np.append(self.context, context), np.append(self.place, place)
        self.opens, self.goes_on = np.append(self.opens, opens), np.append(self.goes_on, has_context | (opens & self.CONTEXT > 0))

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all words of ``texts``, and how many each text has."""
        if len(self.numbers) > CACHED_WORDS:
            self.clear()
        parts, before = [], len(self.numbers)
        for t in texts:
            words = words_of(t)
            parts.append(np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)))
        if len(self.numbers) > before:
            self.learn(list(islice(self.numbers, before, None)))
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))

    def pair_crc(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """crc32 of the names of bigrams: that of v and a space, moved by the length of w, with that of w."""
        n, a = np.minimum(self.size[w], self.LONG), self.crc_before[v]
        out = self.crc[w]
        for k in range(4):
            out = out ^ self.steps[n, k, a >> np.uint32(8 * k) & np.uint32(255)]
        for k in np.flatnonzero(self.size[w] > self.LONG).tolist():
            out[k] = zlib.crc32(f"{self.names[v[k]]} {self.names[w[k]]}".encode("utf-8", "surrogatepass"))
        return out

    def values(self, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, pa.Array]]]:
        """The known value of each bigram's second word in its place, and its open names: at which bigrams, the names."""
        x = self.own[w] + self.context[v]
        after = self.goes_on[v]  # only after a context is there a bigram
        vs, ws = self.place[v], self.place[w]
        at = np.flatnonzero(after & (vs >= 0) & (ws >= 0))
        if len(at) and len(self.head.pairs):
            key = vs[at] << 32 | ws[at]
            found = np.minimum(np.searchsorted(self.head.pairs, key), len(self.head.pairs) - 1)
            hit = self.head.pairs[found] == key
            at = at[hit]
            x[at] += self.head.pair_values[found[hit]]
            after[at] = False
        if self.live is None:
            return x, []
        opens = []
        for bit, kind, of in ((self.STEM, "\x00s", w), (self.WORD, "\x00w", w), (self.CONTEXT, "\x00v", v)):
            at = np.flatnonzero(self.opens[of] & bit)
            name = self.names.take(pa.array(of[at]))
            opens.append((at, pc.binary_join_element_wise(kind, pc.utf8_slice_codeunits(name, 0, STEM) if bit == self.STEM else name, "")))
        at = np.flatnonzero(after)
        at = at[self.is_open(self.pair_crc(v[at], w[at]))]
        opens.append((at, pc.binary_join_element_wise(self.names.take(pa.array(v[at])), self.names.take(pa.array(w[at])), " ")))
        return x, opens


def _name(kind: str, word: str) -> Column:
    return F.concat(F.lit("\x00" + kind), F.col(word))


def calibrate(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Logistic weights (bias first) by damped Newton steps with a small ridge; needs both classes."""
    if not len(y) or y.min() == y.max():
        return np.array([-2.0, 1.0, 2.0, 2.0, 0.0])
    mean, dev = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.hstack([np.ones((len(x), 1)), (x - mean) / dev])
    w = np.zeros(a.shape[1])
    ridge = np.diag([0.0] + [1e-3 * len(x)] * x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge + 1e-9 * np.eye(len(w)), a.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    own = w[1:] / dev
    return np.concatenate([[w[0] - own @ mean], own])


def _labelled(docs: DataFrame, labels: DataFrame, label: str, key: str, text: str, keep, late) -> DataFrame:
    """t (text), y and late of the labelled rows that ``keep`` lets through."""
    own = labels.select(F.col(key), F.col(label).cast("int").alias("y"), late.cast("int").alias("late")).filter(F.col("y").isNotNull() & F.col(key).isNotNull() & keep)
    small = own.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    return docs.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).join(F.broadcast(own) if small else own, key).select("t", "y", "late")


def _shuffled(rows: np.ndarray, numbers: dict[str, int], bits: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Distinct rows (numbers of v, w and u of ``bits`` bits, kind; in order) by the bucket of their bigram, each bucket with its own words.

    The first number and the others go as bytes of one place each, so that they compress to about their entropy.
    """
    words = list(numbers)
    crc = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    mask = (1 << bits) - 1
    v, w, u = ((rows >> place & mask).astype(np.int32) for place in (2 + 2 * bits, 2 + bits, 2))
    mixed = (crc[v] << np.uint64(32) | crc[w]) * np.uint64(0x9E3779B97F4A7C15)
    bucket = ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int64)
    del mixed
    order = np.argsort(bucket, kind="stable")
    limits = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1) if len(rows) else [])
    pack = lambda raw: pa.compress(raw, "zstd", asbytes=True)
    for a, b in zip(limits, limits[1:], strict=False):
        at = order[a:b]
        parts = [x[at] for x in (v, w, u)]
        used = np.zeros(len(words), bool)
        for x in parts:
            used[x] = True
        own = " ".join(words[k] for k in np.flatnonzero(used).tolist()).encode("utf-8", "surrogatepass")
        number = np.cumsum(used, dtype=np.int32) - 1
        parts = [number[x] for x in parts]
        parts[0] = np.diff(parts[0], prepend=np.int32(0))
        planes = [pack((x >> 8 * k).astype(np.uint8).tobytes()) for x in parts for k in range(3)] + [pack((rows[at] & 3).astype(np.uint8).tobytes())]
        columns = [pa.array([int(bucket[at[0]])], pa.int32()), pa.array([len(at)], pa.int32()), pa.array([len(own)], pa.int32()), pa.array([pack(own)]), pa.array([planes], pa.list_(pa.binary()))]
        yield pa.record_batch(columns, ["bucket", "n", "size", "words", "planes"])


class _Contexts:
    """Distinct rows of a bucket: bigrams (numbers of v and w) with a context's number and kind."""

    def __init__(self, most: int):
        self.numbers, self.pairs, self.ends, self.held, self.most = _Numbers(), [], [], 0, most

    def add(self, n: int, size: int, words: bytes, planes: list[bytes]) -> None:
        own = pa.decompress(words, size, "zstd", asbytes=True).decode("utf-8", "surrogatepass").split(" ")
        number = np.fromiter(map(self.numbers.__getitem__, own), np.int64, len(own))
        x = [np.frombuffer(pa.decompress(raw, n, "zstd"), np.uint8).astype(np.int64) for raw in planes]
        v, w, u = (x[k] | x[k + 1] << 8 | x[k + 2] << 16 for k in (0, 3, 6))
        self.pairs.append(number[np.cumsum(v)] << 32 | number[w])
        self.ends.append(number[u] << 2 | x[9])
        self.held += n
        if self.held > 2 * self.most:
            pairs, rows = self.distinct()
            self.pairs, self.ends = [pairs[rows >> 34]], [rows & (1 << 34) - 1]
            self.held = len(rows) - self.most  # so that it is done again after as many more

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """The bigrams in order; and all rows in order: the bigram's place, the context's number, the kind."""
        pairs, which = np.unique(np.concatenate(self.pairs), return_inverse=True)
        self.pairs = []
        rows = np.sort(which << 34 | np.concatenate(self.ends))
        return pairs, rows[np.diff(rows, prepend=-1) != 0]

    def counts(self) -> Iterator[pa.RecordBatch]:
        pairs, rows = self.distinct()
        heads = np.flatnonzero(np.diff(rows >> 2, prepend=-1))
        kinds = np.bitwise_or.reduceat(1 << (rows & 3), heads)
        place = rows[heads] >> 34
        sums = [np.bincount(place[kinds & (1 | 4 * late) << k != 0], minlength=len(pairs)) for late in (0, 1) for k in (0, 1)]
        words = pa.array(list(self.numbers), pa.string())
        for a in range(0, len(pairs), 1 << 16):
            part = pairs[a : a + (1 << 16)]
            yield pa.record_batch([words.take(pa.array(part >> 32)), words.take(pa.array(part & (1 << 32) - 1)), *(pa.array(x[a : a + (1 << 16)], pa.int64()) for x in sums)], ["v", "w", *_SUMS])


def count_bigrams(labelled: DataFrame) -> DataFrame:
    """v, w, and toxic0, ordinary0 (early rows), toxic1, ordinary1 (all rows) of the rows (t, y, late): numbers of contexts
    of all bigrams; v is empty at a text's start.

    A context is the word before v (none at a text's start). All different ones count, told apart by the words
    themselves. A task sends each bigram's contexts once, as numbers with the words they stand for, and they meet those of
    other tasks after the shuffle.
    """
    size = labelled.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    buckets = 1 + max(size // BUCKET_BYTES, min(4 * labelled.sparkSession.sparkContext.defaultParallelism, size >> 20))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, held, n, most = _Numbers({_START: 0}), [], 0, 1 << NUMBER_BITS
        for batch in sliced(batches, "t", 1 << 20):
            for t, y, late in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                kind = 2 * late + (0 if y else 1)
                words = [_START, _START, *words_of(t)]
                for a in range(0, len(words) - 2, most // 4):
                    part = words[a : a + most // 4 + 2]
                    if held and (len(numbers) + len(part) > most or n > 2 * TASK_KEYS):
                        held = [np.unique(np.concatenate(held))]
                        n = len(held[0])
                        if len(numbers) + len(part) > most or n > TASK_KEYS:
                            yield from _shuffled(held[0], numbers, NUMBER_BITS, buckets)
                            numbers, held, n = _Numbers({_START: 0}), [], 0
                    x = np.fromiter(map(numbers.__getitem__, part), np.int64, len(part))
                    held.append(((x[1:-1] << NUMBER_BITS | x[2:]) << NUMBER_BITS | x[:-2]) << 2 | kind)
                    n += len(part) - 2
        if held:
            yield from _shuffled(np.unique(np.concatenate(held)), numbers, NUMBER_BITS, buckets)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        contexts = _Contexts(TASK_KEYS)
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True):
                contexts.add(*row)
        if contexts.pairs:
            yield from contexts.counts()

    dealt = labelled.mapInArrow(run, "bucket int, n int, size int, words binary, planes array<binary>").repartitionById(buckets, F.col("bucket"))
    return dealt.mapInArrow(merged, "v string, w string, " + ", ".join(f"{x} long" for x in _SUMS))


def count_words(grams: DataFrame) -> DataFrame:
    """w, and toxic, ordinary, both of the early rows and of all rows (with a 1): in how many bigrams a word is the second."""
    sums = [F.count_if(F.col(f"{x}{late}") > 0).alias(f"{x}{late}") for late in (0, 1) for x in CLASSES]
    both = [F.count_if(F.col(f"toxic{late}") + F.col(f"ordinary{late}") > 0).alias(f"both{late}") for late in (0, 1)]
    return grams.groupBy("w").agg(*sums, *both)


def _value(nats: Column) -> Column:
    return F.round(nats * UNIT).cast("long")


def _near(rows: DataFrame) -> DataFrame:
    """``rows`` to be broadcast, if they are at most BROADCAST_WORDS."""
    return F.broadcast(rows) if rows.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS else rows


class _Level:
    """One level of the model: of each class its sum, discount and the mass that the discount leaves to the next level."""

    def __init__(self, table: DataFrame, discount: float):
        r = table.agg(*(F.sum(x).alias(x) for x in CLASSES)).first()
        self.sum = [float(r[x] or 0) for x in CLASSES]
        least = min(n for n in self.sum) or 1.0
        self.discount = [discount * max(1.0, n / least) if n else discount for n in self.sum]
        r = table.agg(*(F.sum(F.least(F.col(x).cast("double"), F.lit(d))).alias(x) for x, d in zip(CLASSES, self.discount, strict=True))).first()
        self.rest = [float(r[x] or 0) / n if n else 1.0 for x, n in zip(CLASSES, self.sum, strict=True)]
        self.base = float(np.log(self.rest[0] / self.rest[1])) if min(self.rest) > 0 else 0.0

    def p(self, k: int, backoff: Column) -> Column:
        return F.greatest(F.col(CLASSES[k]) - self.discount[k], F.lit(0.0)) / max(self.sum[k], 1.0) + max(self.rest[k], 1e-12) * backoff

    @property
    def own(self) -> Column:
        """Whether a class has more than its discount."""
        return (F.col(CLASSES[0]) > self.discount[0]) | (F.col(CLASSES[1]) > self.discount[1])


def build_model(grams: DataFrame, counted: DataFrame, late: bool) -> KneserNey:
    """The model of ``count_bigrams`` and ``count_words``, of the early rows or of all rows."""
    c = F.col
    counts = grams.select("v", "w", *(c(f"{x}{int(late)}").alias(x) for x in CLASSES)).filter("toxic + ordinary > 0")
    words = counted.select("w", *(c(f"{x}{int(late)}").alias(x) for x in (*CLASSES, "both")), F.substring("w", 1, STEM).alias("s")).filter("both > 0")
    stems = stored(words.groupBy("s").agg(*(F.sum(x).alias(x) for x in CLASSES), F.sum("both").alias("both")))
    of_words, of_stems = _Level(words, WORD_DISCOUNT), _Level(stems, STEM_DISCOUNT)
    total = float(stems.agg(F.sum("both")).first()[0] or 0) + 1
    by_stem = stems.select("s", c("both").alias("stem_both"), *(of_stems.p(k, c("both") / total).alias(f"s{k}") for k in (0, 1)), of_stems.own.alias("stem_own"))
    full = words.join(_near(by_stem), "s").withColumn("shared", c("both") / (c("stem_both") + 1))
    full = full.select("w", "both", of_words.own.alias("own"), *(of_words.p(k, c(f"s{k}") * c("shared")).alias(f"p{k}") for k in (0, 1)), F.log(c("s0") / c("s1")).alias("stem_ratio"))
    # bigrams with more contexts than the discount, and their contexts
    heavy = stored(counts.filter(F.greatest(*CLASSES) > BIGRAM_DISCOUNT).select("v", "w", *CLASSES))
    before = counts.join(_near(heavy.select("v").distinct()), "v", "left_semi").groupBy("v").agg(
        *(F.sum(x).alias(f"n{k}") for k, x in enumerate(CLASSES)), *(F.sum(F.least(c(x), F.lit(BIGRAM_DISCOUNT))).alias(f"l{k}") for k, x in enumerate(CLASSES)), F.count("*").alias("nexts"))
    rest = [F.when(c(f"n{k}") > 0, c(f"l{k}") / c(f"n{k}")).otherwise(1.0).alias(f"r{k}") for k in (0, 1)]
    before = stored(before.select("v", "n0", "n1", *rest, "nexts").withColumn("context", F.log(c("r0") / c("r1"))))
    pairs = heavy.join(_near(before), "v").join(full.select("w", "p0", "p1"), "w")
    p = [F.greatest(c(x) - BIGRAM_DISCOUNT, F.lit(0)) / F.greatest(c(f"n{k}"), F.lit(1)) + c(f"r{k}") * c(f"p{k}") for k, x in enumerate(CLASSES)]
    more = F.log(p[0] / p[1]) - c("context") - F.log(c("p0") / c("p1"))
    parts = [
        by_stem.filter("stem_own").select(_name("s", "s").alias("name"), _value(F.log(c("s0") / c("s1")) - of_stems.base).alias("value"), c("stem_both").alias("n")),
        full.filter("own").select(_name("w", "w").alias("name"), _value(F.log(c("p0") / c("p1")) - of_words.base - c("stem_ratio")).alias("value"), c("both").alias("n")),
        before.select(_name("v", "v").alias("name"), _value(c("context")).alias("value"), c("nexts").alias("n")),
        pairs.select(F.concat_ws(" ", "v", "w").alias("name"), _value(more).alias("value"), (c("toxic") + c("ordinary")).alias("n")),
    ]
    # a context without a value of its own stays, as it tells that bigrams follow
    entries = stored(parts[0].unionByName(parts[1]).unionByName(parts[3]).filter("value <> 0").unionByName(parts[2]))
    probabilities = stored(full.select(c("w").alias("word"), "p0", "p1").unionByName(by_stem.select(_name("", "s").alias("word"), c("s0").alias("p0"), c("s1").alias("p1"))))
    for used in (stems, heavy, before):
        drop_stored(used)
    live = None
    top = entries
    if entries.count() > HEAD:
        top = most_frequent(entries, "n", HEAD)
        bit = F.crc32(c("name").cast("binary")) % FILTER_BITS
        found = entries.select(F.floor(bit / 64).alias("at"), F.expr("shiftleft(1L, cast(crc32(cast(name as binary)) % 64 as int))").alias("b")).groupBy("at").agg(F.bit_or("b").alias("b")).toPandas()
        live = np.zeros(FILTER_BITS // 64, np.int64)
        live[found["at"].to_numpy(np.int64)] = found["b"].to_numpy(np.int64)
        live = live.view(np.uint8)
    base = round((of_words.base + of_stems.base) * UNIT)
    return KneserNey(base, entries.select("name", "value"), Head.of(top.select("name", "value").toArrow()), live, probabilities)


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", modulus: int = 4, held_out: int = 2) -> KneserNey:
    """The model: a calibration of the last training fold by the counts of the others, then the counts of all."""
    ship(docs.sparkSession)
    folds = [k for k in range(modulus) if k != held_out]
    fold = crc_remainder(key, modulus)
    grams = stored(count_bigrams(_labelled(docs, labels, label, key, text, fold.isin(folds), fold == folds[-1])))
    counted = stored(count_words(grams))
    first = build_model(grams, counted, False)
    chosen = labels.filter(fold == folds[-1])
    n = chosen.count()
    if n > CALIBRATION_ROWS:
        chosen = chosen.filter(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < int((1 << 20) * 0.95 * CALIBRATION_ROWS / n)).limit(CALIBRATION_ROWS)
    rows = evidence(_labelled(docs, chosen, label, key, text, F.lit(True), F.lit(True)), first, "y", "t").toPandas().sort_values(["k", *FEATURES])
    weights = calibrate(rows[list(FEATURES)].to_numpy(float), rows["k"].to_numpy(float))
    first.drop()
    model = build_model(grams, counted, True)
    drop_stored(grams)
    drop_stored(counted)
    model.weights = weights
    return model


def evidence(docs: DataFrame, model: KneserNey, key: str, text: str = "text") -> DataFrame:
    """k (``key``) and FEATURES, a row per row.

    ratio is the mean log ratio of a text's words, mean the mean of their excess, window its highest mean in a window of
    2 * HALF words; the latter two on log scales. A text without words has 0 in all.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.head, model.live, model.base))
    src = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    kind = src.schema["k"].dataType
    key_type = to_arrow_type(kind)
    joined = model.live is not None
    columns = ["rid", "half", "pos", "x", "over", "words", "k", "name"]
    limit = int(EXCESS * UNIT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _Lexicon(*shared.value)
        for batch in sliced(batches, "t", 1 << 20):
            w, count = lexicon.read(batch.column(2).to_pylist())
            n = batch.num_rows
            first = np.cumsum(count) - count
            row = np.repeat(np.arange(n), count)
            pos = np.arange(len(w)) - first[row]
            v = np.where(pos > 0, np.roll(w, 1), 0)
            x, opens = lexicon.values(v, w)
            # what is known of a word with open names goes with its first open name, of the others with the text
            left, apart = x.copy(), np.zeros(len(w), bool)
            more = []
            for at, name in opens:
                more.append((at, np.where(apart[at], 0, x[at]), name))
                apart[at] = True
            left[apart] = 0
            total = np.zeros(n, np.int64)
            has = count > 0
            begin = np.flatnonzero(pos % HALF == 0)
            if len(w):
                total[has] = np.add.reduceat(left, first[has])
                half_over = np.add.reduceat(np.where(left > limit, left - limit, 0), begin)
            else:
                half_over = left
            half_row, half = row[begin], pos[begin] // HALF
            over = np.zeros(n, np.int64)
            over[half_row[half == 0]] = half_over[half == 0]
            on = (half > 0) & (half_over > 0)  # halves without excess have no row but the first
            zeros = lambda k: np.zeros(k, np.int64)
            m, own = int(on.sum()), [at for at, _, _ in more]
            opened = sum(map(len, own))
            rows = np.concatenate([np.arange(n), half_row[on], *(row[at] for at in own)])
            halves = np.concatenate([zeros(n), half[on], *(pos[at] // HALF for at in own)])
            places = np.concatenate([zeros(n + m) - 1, *(pos[at] for at in own)])
            xs = np.concatenate([total, zeros(m), *(x for _, x, _ in more)])
            overs = np.concatenate([over, half_over[on], zeros(opened)])
            rest = np.arange(len(rows)) >= n
            counts = pa.array(np.concatenate([count, zeros(m + opened)]), mask=rest)
            keys = batch.column(1).take(pa.array(rows, mask=rest))
            names = pa.concat_arrays([pa.nulls(n + m, pa.string()), *(name.cast(pa.string()) for _, _, name in more)])
            yield pa.record_batch([batch.column(0).take(pa.array(rows)), pa.array(halves), pa.array(places), pa.array(xs), pa.array(overs), counts, keys.cast(key_type), names], columns)

    c = F.col
    rows = src.mapInArrow(run, f"rid long, half long, pos long, x long, over long, words long, k {kind.simpleString()}, name string")
    if joined:
        # rows without a name meet no entry; a name that no table has spreads them over the join
        rows = rows.withColumn("name", F.coalesce("name", F.concat(F.lit("\x00row "), c("rid").cast("string"))))
        rows = rows.join(model.entries, "name", "left").withColumn("x", c("x") + F.coalesce("value", F.lit(0)))
        whole = rows.groupBy("rid", "half", "pos").agg(F.sum("x").alias("x"), F.sum("over").alias("over"), F.sum("words").alias("words"), F.max("k").alias("k"))
        rows = whole.withColumn("over", F.when(c("pos") >= 0, F.greatest(c("x") - limit, F.lit(0))).otherwise(c("over")))
    halves = rows.groupBy("rid", "half").agg(F.sum("x").alias("x"), F.sum("over").alias("over"), F.sum("words").alias("words"), F.max("k").alias("k"))
    # a window is a half and the next one
    whole = halves.groupBy("rid").agg(F.max("k").alias("k"), F.sum("x").alias("x"), F.sum("over").alias("over"), F.sum("words").alias("words"), F.map_from_entries(F.collect_list(F.when(c("over") > 0, F.struct("half", "over")))).alias("halves"))
    best = F.coalesce(F.array_max(F.transform(F.map_entries("halves"), lambda e: e["value"] + F.coalesce(F.try_element_at("halves", e["key"] + 1), F.lit(0)))), F.lit(0))
    n = F.greatest(c("words"), F.lit(1)).cast("double")
    return whole.select("k", (c("x") / n / UNIT).alias("ratio"), F.log1p(SCALE * c("over") / n / UNIT).alias("mean"), F.log1p(SCALE * best / (2 * HALF) / UNIT).alias("window"), F.log1p(c("words")).alias("log_words"))


def score_column(model: KneserNey) -> Column:
    """The score from the columns of ``evidence``."""
    b, *w = (float(x) for x in model.weights)
    z = F.lit(b) + sum((F.col(c) * v for c, v in zip(FEATURES, w, strict=True)), F.lit(0.0))
    return 1 / (1 + F.exp(-z))


def drop_toxic(docs: DataFrame, model: KneserNey, *, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score less than ``threshold``, with all their columns. Copies have one score."""
    own = [f"c{k}" for k in range(len(docs.columns))]
    digest = F.xxhash64(F.coalesce(F.col(own[docs.columns.index(text)]).cast("string"), F.lit("")))
    rows = docs.toDF(*own).withColumn("digest", digest)
    gone = evidence(rows, model, "digest", own[docs.columns.index(text)]).filter(score_column(model) >= threshold).select(F.col("k").alias("digest")).distinct()
    return rows.join(gone, "digest", "left_anti").select(*own).toDF(*docs.columns)


def score_toxicity(docs: DataFrame, model: KneserNey, *, key: str = "doc_id", text: str = "text", modulus: int = 4, held_out: int = 2, threshold: float = 0.3) -> DataFrame:
    """One row per row of ``docs``: key, held_out, score (0 to 1), predicted (1 from ``threshold`` on).

    Null text is empty and gets the score of no evidence; null or repeated keys keep their rows; an empty
    table gives an empty result. Other columns of ``docs`` are not read.
    """
    rows = evidence(docs, model, key, text)
    out = rows.select(F.col("k").alias(key), (crc_remainder("k", modulus) == held_out).alias("held_out"), score_column(model).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
