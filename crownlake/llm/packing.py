"""Packing of token sequences: dominance reduction, then best fit.

A plan needs only the number of pieces of each length, at most ``capacity`` numbers, whatever the
size of the corpus. On these counts a Martello-Toth reduction fixes sets of up to three pieces that
dominate every other set with their largest piece; the remainder goes best fit, longest first. Both
treat equal pieces together, so a plan is a list of patterns with multiplicities.

Pieces then take their places by rank among those of equal length. Ranks come from counts per
(length, salt), so a length that many pieces share is dealt to many tasks.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, ship, sliced

Plan = list[tuple[tuple[int, ...], int]]

#: Most distinct chunks of text whose ids a worker remembers.
CACHED_CHUNKS = 300_000
#: Pieces of one length that one task ranks, roughly.
SALT_ROWS = 250_000


class WordPieces:
    """Ids of plain lower-case words for a BPE file whose words end in a suffix, by a rank encoder.

    The rank encoder knows bytes only, so the suffix becomes a private character at each word's end, whose
    bytes join first with each other and then with the byte before, as the file's own alphabet has it.
    """

    end = "\U0010ffff"
    no_id = 0xFFFFFFFF
    plain = re.compile(r"[!-;=-~À-ÖØ-öø-ÿ]+")

    def __init__(self, spec: dict):
        import regex
        import tiktoken

        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        vocab = spec["model"]["vocab"]
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
        hidden = [b for b in range(256) if b not in visible]
        byte = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}
        end = self.end.encode()

        def raw(token: str) -> bytes:
            return bytes(byte[c] for c in token.removesuffix("</w>")) + end * token.endswith("</w>")

        known = {raw(t): k for t, k in vocab.items() if not (t.startswith("<|") and t.endswith("|>"))}
        order = [bytes([b]) for b in range(256)] + [end[:k] for k in range(2, len(end) + 1)] + [bytes([b]) + end for b in range(256)]
        order += [raw("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in spec["model"]["merges"]]
        ranks = {t: k for k, t in enumerate(dict.fromkeys(order))}
        self.ids = np.array([known.get(t, self.no_id) for t in ranks], "<u4")
        self.last = np.array([t.endswith(end) for t in ranks])
        self.encoding = tiktoken.Encoding("words", pat_str=r"[^ \n]+", mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def of(cls, path: str) -> WordPieces | None:
        """For files of this kind only: lower-casing, words by one pattern, bytes, suffix ``</w>``."""
        with open(path) as f:
            spec = json.load(f)
        kinds = lambda part, name: [x["type"] for x in (spec.get(part) or {}).get(name, [])]
        fits = (
            kinds("normalizer", "normalizers") == ["NFC", "Replace", "Lowercase"] and kinds("pre_tokenizer", "pretokenizers") == ["Split", "ByteLevel"]
            and spec["pre_tokenizer"]["pretokenizers"][0].get("invert") and spec["model"].get("end_of_word_suffix") == "</w>" and not spec["model"].get("unk_token")
        )
        return cls(spec) if fits else None

    def encoded(self, chunks: list[str]) -> list[bytes]:
        """For chunks that match ``plain``."""
        marked = self.pattern.sub(rf"\g<0>{self.end} ", "\n".join(chunks).lower())
        words = np.cumsum([line.count(self.end) for line in marked.split("\n")])
        ranks = np.array(self.encoding.encode_ordinary(marked))
        ends = (np.flatnonzero(self.last[ranks]) + 1)[words - 1]
        found = self.ids[ranks]
        if (found == self.no_id).any():
            raise ValueError("a piece without an id in the tokenizer file")
        ids = found.tobytes()
        at = [0, *(4 * ends).tolist()]
        return [ids[a:b] for a, b in zip(at, at[1:], strict=False)]


class ChunkIds:
    """Ids of a text as little-endian 32-bit bytes, by chunks between white space.

    For a tokenizer that drops white space and never joins over it, a text's ids are those of its chunks
    in a row. Texts with characters that only Python takes as white space are encoded as a whole.
    """

    _loaded: dict[str, ChunkIds] = {}
    _odd = re.compile("[\x1c-\x1f]")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, bytes] = {}
        self.words = WordPieces.of(path)

    @classmethod
    def load(cls, path: str) -> ChunkIds:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ids(self, texts: list[str]) -> list[bytes]:
        split = [None if self._odd.search(t) else t.split() for t in texts]
        known = self.known
        new = list({c for chunks in split if chunks for c in chunks if c not in known})
        if len(known) + len(new) > CACHED_CHUNKS:
            known.clear()
            new = list({c for chunks in split if chunks for c in chunks})
        plain = [c for c in new if self.words.plain.fullmatch(c)] if self.words else []
        if plain:
            known.update(zip(plain, self.words.encoded(plain), strict=True))
            new = [c for c in new if c not in known]
        known.update(zip(new, self._encoded(new), strict=True))
        return [b"".join(map(known.__getitem__, chunks)) if chunks is not None else self._encoded([t])[0] for t, chunks in zip(texts, split, strict=True)]


def token_pieces(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of the documents: key, piece, start, length, ids_crc32.

    A document is its ids and then ``end_id``; longer ones than ``capacity`` are cut, the last piece
    being shorter. Null text is empty and gives one piece with the end id. Null or repeated keys keep
    their rows; an empty table gives none. Other columns of ``docs`` are not read.
    """
    ship(docs.sparkSession)
    src = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ChunkIds.load(path)
        for batch in sliced(batches, "t", 1 << 20):
            row, piece, start, length, crc = [], [], [], [], []
            for r, ids in enumerate(own.ids(batch.column(1).to_pylist())):
                ids += end
                for p, a in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[a : a + 4 * capacity]
                    row.append(r), piece.append(p), start.append(a // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
            yield pa.record_batch([batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["k", "piece", "start", "length", "ids_crc32"])
        own.known.clear()  # workers live on, and other operators need the room

    return src.mapInArrow(run, f"k {src.schema['k'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("k", key)


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[Plan, dict[int, int]]:
    """Sets fixed for good, and what is left of ``counts`` (length -> number).

    For the longest piece j left, with room r beside it, a set with j dominates all others with j if
    each other's pieces can be replaced one for one or many for one. So these are fixed: j alone where
    nothing fits beside it; j with a piece of exactly r; j with the longest that fits, i, where no two
    fit, or where no two that fit exceed i together; and j, i and b where no three fit, i and b fit, and
    no pair that fits has both members over b. Then the next j, until a round fixes nothing.
    """
    left = Counter({k: n for k, n in counts.items() if n > 0})
    fixed: Plan = []

    def fix(pieces: tuple[int, ...]) -> None:
        use = Counter(pieces)
        m = min(left[k] // n for k, n in use.items())
        for k, n in use.items():
            left[k] -= n * m
            if not left[k]:
                del left[k]
        fixed.append((pieces, m))

    def beside(j: int) -> tuple[int, ...] | None:
        """The pieces that dominate beside one j, or None."""
        r = capacity - j
        have = lambda k: left[k] - (k == j)  # noqa: E731  without the j itself
        sizes = [k for k in sorted(left) if have(k) > 0]
        fit = sizes[: bisect_right(sizes, r)]
        if not fit:
            return ()
        i = fit[-1]
        if i == r:
            return (i,)
        small = [k for k in fit[:3] for _ in range(min(3, have(k)))][:3]
        if len(small) < 2 or small[0] + small[1] > r:
            return (i,)
        if len(small) == 3 and sum(small) <= r:
            return None
        best, b, hi = 0, 0, len(fit) - 1
        for x in fit:  # pairs x <= y that fit: the largest y for each x
            while hi >= 0 and fit[hi] > r - x:
                hi -= 1
            y = hi
            if y >= 0 and fit[y] == x and have(x) < 2:
                y -= 1
            if y < 0 or fit[y] < x:
                continue
            best, b = max(best, x + fit[y]), max(b, x)
        if best <= i:
            return (i,)
        if i + b <= r and (b != i or have(i) > 1):
            return (i, b)
        return None

    while True:
        before = len(fixed)
        for j in sorted(left, reverse=True):
            while left.get(j) and (more := beside(j)) is not None:
                fix((j, *more))
        if len(fixed) == before:
            return fixed, dict(left)


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best fit, longest first, on equal pieces together."""
    rooms: list[int] = []  # sorted room sizes that open bins have
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(room: int, pattern: tuple[int, ...], m: int) -> None:
        if m:
            if room not in bins:
                bins[room] = []
                rooms.insert(bisect_left(rooms, room), room)
            bins[room].append((pattern, m))

    for size in sorted((k for k, n in counts.items() if n), reverse=True):
        n = counts[size]
        while n:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                room, pattern, m = capacity, (), -(-n // (capacity // size))
            else:
                room = rooms[at]
                pattern, m = bins[room].pop()
                if not bins[room]:
                    del bins[room], rooms[at]
            each = room // size
            whole = min(m, n // each)
            put(room - each * size, pattern + (size,) * each, whole)
            n -= whole * each
            rest = m - whole
            if n and rest:
                put(room - n * size, pattern + (size,) * n, 1)
                n, rest = 0, rest - 1
            put(room, pattern, rest)
    return [x for found in bins.values() for x in found if x[0]]


def plan_of(counts: dict[int, int], capacity: int) -> Plan:
    """Patterns with multiplicities that hold all pieces."""
    if any(not 0 < k <= capacity for k, n in counts.items() if n):
        raise ValueError("a piece has between 1 and capacity tokens")
    fixed, left = reduce_by_dominance(counts, capacity)
    return [*fixed, *best_fit(left, capacity)]


def places_of(plan: Plan) -> dict[str, np.ndarray]:
    """For each slot of a pattern: its length, the first rank that takes it, its first sequence and offset; sorted."""
    taken: Counter[int] = Counter()
    rows, sequence = [], 0
    for pattern, m in plan:
        offset = 0
        for size in pattern:
            rows.append((size, taken[size], sequence, offset))
            taken[size] += m
            offset += size
        sequence += m
    out = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"key": (out[:, 0] << 44) + out[:, 1], "rank": out[:, 1], "sequence": out[:, 2], "offset": out[:, 3]}


def pack(pieces: DataFrame, *, length: str = "length", capacity: int = 2048) -> DataFrame:
    """``pieces`` with sequence_id and offset: sequences of at most ``capacity``, without gaps.

    Lengths are 1 to ``capacity`` (null or other lengths raise). Equal rows each get a place; an empty
    table stays empty. Columns named sequence_id or offset are replaced.
    """
    ship(pieces.sparkSession)
    pieces = checkpointed(pieces.drop("sequence_id", "offset").select(F.struct("*").alias("row"), F.col(length).cast("long").alias("size"), F.monotonically_increasing_id().alias("rid")))
    counts = {r["size"]: r["count"] for r in pieces.groupBy("size").count().collect()}
    if None in counts:
        raise ValueError("a piece has no length")
    places = pieces.sparkSession.sparkContext.broadcast(places_of(plan_of(counts, capacity)))
    salts = max(16, -(-sum(counts.values()) // SALT_ROWS))
    salted = pieces.withColumn("salt", F.col("rid") % salts)
    sums = salted.groupBy("size", "salt").agg(F.count("*").alias("n"))
    base = sums.select("size", "salt", (F.sum("n").over(Window.partitionBy("size").orderBy("salt")) - F.col("n")).alias("base"))
    ranked = salted.withColumn("own", F.row_number().over(Window.partitionBy("size", "salt").orderBy("rid"))).join(base, ["size", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = places.value
        for b in batches:
            size, rank = b.column(1).to_numpy(), b.column(2).to_numpy()
            at = np.searchsorted(p["key"], (size << 44) + rank, side="right") - 1
            yield pa.record_batch([b.column(0), pa.array(p["sequence"][at] + rank - p["rank"][at]), pa.array(p["offset"][at])], ["row", "sequence_id", "offset"])

    chosen = ranked.select("row", "size", (F.col("base") + F.col("own") - 1).alias("rank"))
    out = chosen.mapInArrow(run, f"row {pieces.schema['row'].dataType.simpleString()}, sequence_id long, offset long")
    return out.select("row.*", "sequence_id", "offset")
