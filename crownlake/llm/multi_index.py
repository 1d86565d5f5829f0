"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Codes are signs after a rotation that is learned for least quantisation error (ITQ) on a bounded
sample. A code is split into 16-bit substrings, each with a table from value to rows. Two codes within
Hamming distance r agree in some substring up to r // substrings bits, so probing every value that near
in every table retrieves all codes within the radius; after the check of the whole code, vectors are
reranked by their inner product in double precision. The radius is learned on the sample, so that the
wanted share of true neighbours lies within it; as neighbours in all rows are nearer than in a sample,
it errs to the safe side.

Scale: rows are dealt to index blocks by hash, queries to query blocks; each pair of blocks is one task
of bounded size, and gives its best ``k`` per query. Where the radius holds fewer than ``k`` of a
block, it grows until it does or holds the whole block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship

#: Rows of an index block and of a query block; rows that the codes are learned on.
BLOCK_ROWS, QUERY_ROWS, SAMPLE_ROWS = 32_768, 8_192, 8_192
#: Queries that are reranked together, and the share of a block's rows from which on it is by one product.
BATCH, DENSE_SHARE = 64, 0.05
WORD = 16
_NEAR: dict[int, np.ndarray] = {}


def usable(v: Column) -> Column:
    """True for a vector without null or non-finite components that isn't zero."""
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def within(bits: int) -> np.ndarray:
    """All 16-bit masks with at most ``bits`` ones."""
    if bits not in _NEAR:
        _NEAR[bits] = np.flatnonzero(np.bitwise_count(np.arange(1 << WORD, dtype=np.uint32)) <= bits)
    return _NEAR[bits]


@dataclass
class BinaryCode:
    """``lift``: with it vectors get one more coordinate, so that inner products rank as distances do."""

    mean: np.ndarray
    rotation: np.ndarray  # dimensions x bits
    radius: int
    lift: float = 0.0

    def lifted(self, x: np.ndarray, query: bool) -> np.ndarray:
        if not self.lift:
            return x
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.lift**2 - (x * x).sum(axis=1), 0))
        return np.hstack([x, more[:, None]])

    def words(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Codes as rows of 16-bit words."""
        bits = (self.lifted(x, query) - self.mean) @ self.rotation > 0
        bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % WORD)))
        return np.packbits(bits, axis=1).view(">u2").astype(np.uint16)

    @classmethod
    def fit(cls, x: np.ndarray, *, bits: int = 64, k: int = 20, share: float = 0.98, rounds: int = 40, seed: int = 11) -> BinaryCode:
        """ITQ on the rows of ``x``; the radius holds ``share`` of the k nearest of some of them."""
        norm = np.sqrt((x * x).sum(axis=1))
        top = float(norm.max(initial=0.0))
        own = cls(np.zeros(0), np.zeros((0, 0)), 0, top if len(x) and norm.min() < 0.999 * top else 0.0)
        z = own.lifted(x, False)
        own.mean = z.mean(axis=0)
        z = z - own.mean
        bits = min(bits, z.shape[1])
        _, _, axes = np.linalg.svd(z.T @ z)
        basis = axes[:bits].T
        p = z @ basis
        r = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(p @ r > 0, 1.0, -1.0).T @ p)
            r = (u @ v).T
        own.rotation = basis @ r
        codes, asked = own.words(x), own.words(x[:256], True)
        k = min(k, len(x) - 1)
        if k > 0:
            score = x[:256] @ x.T
            score[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
            best = np.argpartition(-score, k - 1, axis=1)[:, :k]
            far = np.bitwise_count(asked[:, None, :] ^ codes[best]).sum(axis=2)
            own.radius = int(np.quantile(far, share, method="higher"))
        return own


class MultiIndex:
    """Tables over the words of codes: the values a word takes, where the rows of each begin, and each row's value."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.codes = np.ascontiguousarray(np.ascontiguousarray(np.pad(words, ((0, 0), (0, -words.shape[1] % 4)))).view(np.uint64).T)
        self.order = [np.argsort(c, kind="stable").astype(np.int32) for c in words.T]
        self.start = [np.concatenate([[0], np.cumsum(np.bincount(c, minlength=1 << WORD))]) for c in words.T]
        self.values = [np.flatnonzero(np.diff(start)).astype(np.uint16) for start in self.start]
        self.place = [np.searchsorted(values, c).astype(np.intp) for values, c in zip(self.values, words.T, strict=True)]

    def probe(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose code lies within ``radius`` of ``code``."""
        mark = np.zeros(len(self.words), bool)
        bits = min(radius // len(code), WORD)
        masks = within(bits)
        for k, word in enumerate(code):
            if len(masks) < len(self.values[k]):
                order, start, values = self.order[k], self.start[k], masks ^ int(word)
                begin, size = start[values], start[values + 1] - start[values]
                full = size > 0
                begin, size = begin[full], size[full]
                at = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                mark[order[at]] = True
            else:  # the table has fewer values than there are masks, so they are gone through instead
                mark |= (np.bitwise_count(self.values[k] ^ word) <= bits).take(self.place[k], mode="clip")
        # the check of whole codes: of the rows found, or where most are found of all, which needs no copy
        own = np.pad(code, (0, -len(code) % 4)).view(np.uint64)
        rows = np.flatnonzero(mark) if 4 * np.count_nonzero(mark) < len(mark) else None
        far = 0
        for whole, mine in zip(self.codes, own, strict=True):
            far = far + np.bitwise_count((whole if rows is None else whole[rows]) ^ mine).astype(np.int64 if len(own) > 1 else np.uint8)
        return np.flatnonzero(mark & (far <= radius)) if rows is None else rows[far <= radius]


def kth_largest(x: np.ndarray, k: int) -> float:
    """The k-th largest of ``x``; what is below the k-th largest of the maxima of 8 k parts can't be it."""
    size = len(x) // (8 * k)
    if size > 1:
        least = np.partition(x[: 8 * k * size].reshape(size, 8 * k).max(axis=0), 7 * k)[7 * k]
        x = x[x >= least]
    return np.partition(x, len(x) - k)[len(x) - k]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat if isinstance(flat, pa.Array) else pa.concat_arrays(flat.chunks)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def nearest(
    vectors: DataFrame, queries: Column, *, key: str = "vec_id", vector: str = "embedding", k: int = 20, bits: int = 64, share: float = 0.98,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` rows found with the largest inner product.

    ``queries`` is a condition on ``vectors``; a row is never its own neighbour (equal keys). Rows with
    null keys, null or zero vectors or such with null or non-finite components take no part, nor those
    whose length isn't the most frequent one. Repeated rows count once; among rows of one key with
    different vectors all are candidates. Ties go to the smaller key. With fewer candidates all are
    given; an empty table gives an empty result. Other columns are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    own = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asked")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    sizes = own.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    out_schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], out_schema)
    own = own.filter(F.size("v") == sizes.d).groupBy("id", "v").agg(F.max("asked").alias("asked"))
    n, asked = own.agg(F.count("*"), F.count_if("asked")).first()
    parts = 1 << 20
    sample = own if n <= SAMPLE_ROWS else own.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) < int(parts * 0.95 * SAMPLE_ROWS / n)).limit(SAMPLE_ROWS)
    rows = sorted((r.id, r.v) for r in sample.select("id", "v").collect())
    code = BinaryCode.fit(np.array([v for _, v in rows], np.float64), bits=bits, k=k, share=share)
    blocks, query_blocks = max(1, -(-n // BLOCK_ROWS)), max(1, -(-asked // QUERY_ROWS))
    deal = lambda many: F.pmod(F.xxhash64("id", "v"), F.lit(many)).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    base = own.select("id", "v", deal(blocks).alias("b"), every(query_blocks).alias("q"))
    ask = own.filter("asked").select("id", "v", deal(query_blocks).alias("q"), every(blocks).alias("b"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        if left.num_rows and right.num_rows:
            x, ids = _matrix(left["v"]), left["id"].to_numpy()
            y, qids = _matrix(right["v"]), right["id"].to_numpy()
            index, codes = MultiIndex(code.words(x)), code.words(y, True)

            here = np.isin(qids, ids)  # queries with a row of their own in this block

            def retrieved(c: np.ndarray, i: int) -> np.ndarray:
                radius = code.radius
                while True:  # the radius grows by a bit a word, up to all rows
                    rows = index.probe(c, radius)
                    rows = rows[ids[rows] != qids[i]] if here[i] else rows
                    if len(rows) >= k or radius >= WORD * len(c):
                        return rows
                    radius += len(c)

            room = np.empty((min(BATCH, len(y)), len(x)))
            for a in range(0, len(y), BATCH):
                part = [retrieved(c, a + i) for i, c in enumerate(codes[a : a + BATCH])]
                # where many rows are retrieved, one product of matrices is faster than to gather each query's rows
                many = sum(map(len, part)) > DENSE_SHARE * len(part) * len(x)
                products = np.matmul(y[a : a + BATCH], x.T, out=room[: len(part)]) if many else None
                for i, rows in enumerate(part):
                    q, qid = y[a + i], qids[a + i]
                    near = products[i].take(rows, mode="clip") if many else x[rows] @ q
                    if len(rows) > k:  # a little more than k, as the sum below may round otherwise
                        rows = rows[near >= kth_largest(near, k) - 1e-9 * (1 + max(near.max(), -near.min()))]
                    score = (x[rows] * q).sum(axis=1)
                    best = np.lexsort((ids[rows], -score))[:k]
                    found.append((np.full(len(best), qid), ids[rows][best], score[best]))
        cols = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    best = base.groupBy("b", "q").cogroup(ask.groupBy("b", "q")).applyInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
