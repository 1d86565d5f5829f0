"""Token counts by pre-token frequencies.

Method: a text's token number is the sum over its distinct pre-tokens of frequency times pieces.
The pieces of a pre-token are counted once per distinct pre-token of the corpus and joined to the
frequencies; no token ids of a text are ever made.

Scale: pass 1 makes the table of distinct pre-tokens with corpus frequencies (each task sums its
own first). The ``head`` most frequent pre-tokens, a fixed number, are broadcast, so that the
frequent keys never reach a shuffle; the others are joined by shuffle on the pre-token, where no
key is frequent, and summed per row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import checkpointed, most_frequent, ship, sliced

#: Most distinct pre-tokens that one task holds before it passes its sums on.
TASK_KEYS = 400_000
#: Blocks of characters to which the library and ``regex`` give the same classes.
SAME_CLASSES = re.compile("[^\x00-ԯ‐-‧‰-⁞ぁ-ゖ一-龥가-힣]")
#: Fixed value: the pre-token pattern of byte-level BPE with 50,257 ids.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_LOADED: dict[str, PreTokens] = {}


class PreTokens:
    """Splits texts into pre-tokens and special strings, and counts the pieces of a pre-token."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.pattern = regex.compile(BYTE_LEVEL)
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None

    @classmethod
    def load(cls, path: str) -> PreTokens:
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    def _plain(self, text: str) -> list[str]:
        if SAME_CLASSES.search(text) is None:
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def split(self, text: str) -> list[str]:
        if self.special is None or self.special.search(text) is None:
            return self._plain(text)
        out: list[str] = []
        for k, part in enumerate(self.special.split(text)):
            out += [part] if k % 2 else self._plain(part)
        return out

    def pieces(self, tokens: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(tokens, add_special_tokens=False)]


def count_tokens(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", head: int = 1 << 18, limit: int = 1024) -> DataFrame:
    """One row per row of ``docs``: key, n_bytes, n_tokens, over_limit.

    ``path`` is a byte-level BPE file of the ``tokenizers`` library. Null text is empty and has 0
    tokens; null or repeated keys and repeated rows each keep their own row; an empty table gives an
    empty result. Other columns of ``docs`` are not read, so their names can't clash.
    """
    spark = docs.sparkSession
    ship(spark)
    src = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = PreTokens.load(path)
        sums: Counter[str] = Counter()

        def passed() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(sums.keys()), pa.string()), pa.array(list(sums.values()), pa.int64())], ["token", "freq"])

        for batch in sliced(batches, "t"):
            for t in batch.column(0).to_pylist():
                sums.update(own.split(t))
            if len(sums) > TASK_KEYS:
                yield passed()
                sums.clear()
        if sums:
            yield passed()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = PreTokens.load(path)
        for batch in sliced(batches, "token", 1 << 20):
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(own.pieces(batch.column(0).to_pylist()), pa.int64())], ["token", "freq", "pieces"])

    table = (
        src.select("t").mapInArrow(frequencies, "token string, freq long")
        .groupBy("token").agg(F.sum("freq").alias("freq"))
        .mapInArrow(counted, "token string, freq long, pieces long")
    )
    table = checkpointed(table)
    top = {r.token: r.pieces for r in most_frequent(table, "freq", head).select("token", "pieces").toLocalIterator()}
    known = spark.sparkContext.broadcast(top)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = PreTokens.load(path)
        top = known.value
        for batch in sliced(batches, "t"):
            rid, keys, size, base, token, freq = [], [], [], [], [], []
            for r, k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                n = 0
                for tok, m in Counter(own.split(t)).items():
                    p = top.get(tok)
                    if p is None:
                        rid.append(r), keys.append(None), size.append(None), base.append(0), token.append(tok), freq.append(m)
                    else:
                        n += m * p
                # the row itself: a token that no table has, so that these rows spread over the join
                rid.append(r), keys.append(k), size.append(len(t.encode())), base.append(n), token.append(f"\x00row {r}"), freq.append(0)
            yield pa.record_batch(
                [pa.array(rid, pa.int64()), pa.array(keys, key_type), pa.array(size, pa.int64()), pa.array(base, pa.int64()), pa.array(token, pa.string()), pa.array(freq, pa.int64())],
                ["rid", "k", "n_bytes", "base", "token", "freq"],
            )

    kind = src.schema["k"].dataType
    key_type = to_arrow_type(kind)
    rows = src.select(F.monotonically_increasing_id().alias("rid"), "k", "t").mapInArrow(partial, f"rid long, k {kind.simpleString()}, n_bytes long, base long, token string, freq long")
    tail = table.select("token", "pieces")
    n = F.sum(F.col("base") + F.col("freq") * F.coalesce(F.col("pieces"), F.lit(0)))
    out = rows.join(tail, "token", "left").groupBy("rid").agg(F.max("k").alias(key), F.max("n_bytes").alias("n_bytes"), n.alias("n_tokens"))
    return out.select(key, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
