"""N-gram Jaccard join: groups of documents linked by the similarity of their shingle sets.

Method: shingles are ordered rarest first (by a count sketch over all documents; any fixed order gives
the same links). Two sets with a similarity of the threshold or more share a shingle among the first
n - ceil(threshold * n) + 1 of each, so only these prefixes are joined. Candidates have to pass the
length filter, the positional filter (the shingles left after the first common one must suffice) and a
suffix filter (numbers of shingles by hash range bound the difference from below). Each pair that is left
is verified once on the whole sets.

Scale: documents with equal sets are one class from the start, so copies cost nothing further. A prefix
shingle that many classes share is a bucket; it is streamed in order, never gathered. First each
bucket's most central class is compared with the others, and linked classes become components; then
only pairs of a bucket that lie in different components are compared, as a link within a component
changes nothing. No link between components is lost, and a group of near copies costs about as many
pairs as it has members, not their square. Shingle sets are made again for the classes in candidate
pairs only. All steps spill, and what is broadcast is bounded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.graph import components
from .common import checkpointed, ship, sliced, stored
from .shingles import mixed, sets_of

#: Counters of the sketch; hash ranges of the suffix filter; most class ids that are broadcast.
COUNTERS, RANGES, BROADCAST_IDS = 1 << 18, 512, 1_000_000
#: Bytes of text that are worked on at once.
BATCH_BYTES = 512 << 10


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))


def _bytes(batch: pa.RecordBatch, column: str) -> list[bytes]:
    return batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary()).to_pylist()


def _signatures(h: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """One 64-bit number per set, whatever the order of its members; 0 for an empty set."""
    out = np.zeros(len(limits) - 1, np.uint64)
    full = np.flatnonzero(np.diff(limits))
    if len(full):
        out[full] = mixed(np.add.reduceat(mixed(h ^ np.uint64(0x243F6A8885A308D3)), limits[:-1][full]) + np.diff(limits)[full].astype(np.uint64))
    return out


def shingle_counts(src: DataFrame, width: int) -> np.ndarray:
    """The count sketch: documents by counter, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(COUNTERS, np.int64)
        for batch in sliced(batches, "t", BATCH_BYTES):
            h, _ = sets_of(_bytes(batch, "t"), width)
            sums += np.bincount((h % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(sums)
        for a in range(0, len(at), 1 << 16):
            yield pa.record_batch([pa.array(at[a : a + (1 << 16)].astype(np.int32)), pa.array(sums[at[a : a + (1 << 16)]])], ["counter", "n"])

    out = np.zeros(COUNTERS, np.int64)
    found = src.select("t").mapInArrow(run, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toPandas()
    out[found["counter"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def prefixes(src: DataFrame, width: int, percent: int) -> DataFrame:
    """k, cls (signature of the set, null if empty), n, prefix (rarest first)."""
    counts = src.sparkSession.sparkContext.broadcast(shingle_counts(src, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "t", BATCH_BYTES):
            h, limits = sets_of(_bytes(batch, "t"), width)
            n = np.diff(limits)
            doc = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((h, counts.value[(h % np.uint64(COUNTERS)).astype(np.int64)], doc))
            place = np.arange(len(h)) - np.repeat(limits[:-1], n)
            size = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
            chosen = h[order][place < np.repeat(size, n)].view(np.int64)
            prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(chosen))
            yield pa.record_batch(
                [batch.column(0), pa.array(_signatures(h, limits).view(np.int64), mask=n == 0), pa.array(n), prefix], ["k", "cls", "n", "prefix"]
            )

    return src.mapInArrow(run, f"k {src.schema['k'].dataType.simpleString()}, cls long, n long, prefix array<long>")


def shared_postings(docs: DataFrame) -> DataFrame:
    """Postings of prefix shingles that two classes or more share, each with its bucket's pivot.

    shingle, cls, n, pos, pivot, pivot_n, pivot_pos. The pivot is the class with the fewest rarer shingles
    before the bucket's. The rows of a bucket stream by; of a bucket only its pivot is held.
    """
    postings = docs.filter("cls is not null").select("cls", "n", F.posexplode("prefix").alias("pos", "shingle"))
    dealt = postings.repartition(F.col("shingle")).sortWithinPartitions("shingle", "pos", "n", "cls").select("shingle", "cls", "n", "pos")
    names = ["shingle", "cls", "n", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot: list[int] | None = None  # of the bucket that may go on
        told = False  # whether its own row is out
        last: list[int] | None = None
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            if not x.shape[1]:
                continue
            keep = np.ones(x.shape[1], bool)  # rows that only repeat a class
            keep[1:] = (x[:2, 1:] != x[:2, :-1]).any(axis=0)
            if last is not None and x[0, 0] == last[0] and x[1, 0] == last[1]:
                keep[0] = False
            last = x[:, -1].tolist()
            x = x[:, keep]
            if not x.shape[1]:
                continue
            goes_on = pivot is not None and x[0, 0] == pivot[0]
            if goes_on and not told:
                x = np.concatenate([np.array(pivot, np.int64)[:, None], x], axis=1)
            new = np.ones(x.shape[1], bool)
            new[1:] = x[0, 1:] != x[0, :-1]
            begin = np.flatnonzero(new)
            size = np.diff(np.append(begin, x.shape[1]))
            head = np.repeat(x[:, begin], size, axis=1)
            out = np.repeat(size > 1, size)
            if goes_on and told:
                head[:, : size[0]] = np.array(pivot, np.int64)[:, None]
                out[: size[0]] = True
            if len(begin) > 1 or not goes_on:
                pivot, told = x[:, begin[-1]].tolist(), bool(size[-1] > 1)
            else:
                told = True
            rows = np.concatenate([x[:, out], head[1:, out]])
            yield pa.record_batch([pa.array(r) for r in rows], [*names, "pivot", "pivot_n", "pivot_pos"])

    return dealt.mapInArrow(run, "shingle long, cls long, n long, pos long, pivot long, pivot_n long, pivot_pos long")


def needed(n: Column, m: Column, percent: int) -> Column:
    """The least common shingles of sets of n and m: 100 * common >= percent * union."""
    return F.ceil((n + m) * percent / (100.0 + percent) - 1e-9)


def may_link(n: Column, pos: Column, m: Column, mpos: Column, percent: int) -> Column:
    """Length filter and positional filter for a first common shingle at the places pos and mpos."""
    length = (100 * n >= percent * m) & (100 * m >= percent * n)
    return length & (1 + F.least(n - pos - 1, m - mpos - 1) >= needed(n, m, percent))


def _pair(a: str, n: str, b: str, m: str) -> list[Column]:
    """a < b, each with its size."""
    low, c = F.col(a) < F.col(b), F.col
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.when(low, c(n)).otherwise(c(m)).alias("n_a"), F.when(low, c(m)).otherwise(c(n)).alias("n_b")]


def _small(ids: DataFrame) -> DataFrame:
    """``ids`` to be broadcast, if they are at most BROADCAST_IDS rows."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def _members(pairs: DataFrame) -> DataFrame:
    """The classes in ``pairs``, once each."""
    return checkpointed(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), small=True)


def class_sets(ids: DataFrame, classes: DataFrame, src: DataFrame, width: int) -> DataFrame:
    """cls, ranges, members of the classes ``ids``: the set, and its numbers by hash range (255 at most)."""
    first = classes.join(_small(ids), "cls").select(F.col("first").alias("k")).distinct()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "t", BATCH_BYTES):
            h, limits = sets_of(_bytes(batch, "t"), width)
            n = np.diff(limits)
            doc = np.repeat(np.arange(len(n)), n)
            ranges = np.bincount(doc * RANGES + (h % np.uint64(RANGES)).astype(np.int64), minlength=len(n) * RANGES).reshape(len(n), RANGES)
            ranges = np.minimum(ranges, 255).astype(np.uint8)
            full = np.flatnonzero(n)
            raw = [h[limits[k] : limits[k + 1]].tobytes() for k in full]
            yield pa.record_batch([pa.array(_signatures(h, limits)[full].view(np.int64)), pa.array([ranges[k].tobytes() for k in full], pa.binary()), pa.array(raw, pa.binary())], ["cls", "ranges", "members"])

    sets = stored(src.join(_small(first), "k", "left_semi").select("t").mapInArrow(make, "cls long, ranges binary, members binary"))
    # a key that is repeated brings more texts or one text several times
    n, different = sets.agg(F.count("*"), F.count_distinct("cls")).first()
    return sets if n == different else sets.dropDuplicates(["cls"])


def verified(pairs: DataFrame, classes: DataFrame, src: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, n_a, b, n_b) of classes that link, as (a, b): the suffix filter, then the whole sets."""
    sets = class_sets(_members(pairs), classes, src, width)

    def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n, m = (batch.column(k).to_numpy() for k in (2, 3))
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, RANGES).astype(np.int16) for k in (4, 5))
                most = n + m - 2 * -(-(n + m) * percent // (100 + percent))  # members that may be in one set only
                yield pa.record_batch(batch.columns[:2], ["a", "b"]).filter(pa.array(np.abs(x - y).sum(axis=1) <= most))

    near = pairs
    for side in "ab":
        near = near.join(sets.select(F.col("cls").alias(side), F.col("ranges").alias(f"ranges_{side}")), side)
    near = checkpointed(near.select("a", "b", "n_a", "n_b", "ranges_a", "ranges_b").mapInArrow(may, "a long, b long"), small=True)
    own = sets.join(_small(_members(near)), "cls", "left_semi")
    for side in "ab":
        near = near.join(own.select(F.col("cls").alias(side), F.col("members").alias(f"members_{side}")), side)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "members_a"):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate([x, y]))  # members of a set differ
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return near.select("a", "b", "members_a", "members_b").mapInArrow(test, "a long, b long")


def linked_groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id (least key reachable by links, or its own).

    Two texts link when 100 * common >= percent * union of their shingle sets. Null text and texts
    without words have an empty set and link with nothing. Rows with a null key belong to a component only by an
    equal set of a row with a key; otherwise their component id is null. Repeated rows and keys keep their rows.
    An empty table gives an empty result. Other columns of ``docs`` are not read.
    """
    ship(docs.sparkSession)
    src = _texts(docs, key, text)
    rows = stored(prefixes(src, width, percent))
    classes = checkpointed(rows.filter("cls is not null").groupBy("cls").agg(F.min("k").alias("first")), small=True)
    shared = stored(shared_postings(rows))
    c = F.col
    star = shared.filter(c("cls") != c("pivot")).filter(may_link(c("n"), c("pos"), c("pivot_n"), c("pivot_pos"), percent)).select(*_pair("cls", "n", "pivot", "pivot_n")).distinct()
    star = checkpointed(star, small=True)
    links = checkpointed(verified(star, classes, src, width, percent), small=True)
    groups = components(links)
    # buckets that still hold several components: what the pivots did not join
    named = _small(groups.select(c("node").alias("cls"), c("component").alias("grp")))
    labelled = shared.select("shingle", "cls", "n", "pos").join(named, "cls", "left").withColumn("grp", F.coalesce("grp", "cls"))
    several = checkpointed(labelled.groupBy("shingle").agg(F.min("grp").alias("low"), F.max("grp").alias("high")).filter("low <> high").select("shingle"), small=True)
    ours = checkpointed(labelled.join(_small(several), "shingle").select("shingle", "cls", "n", "pos", "grp"))
    other = ours.toDF("shingle", "other", "m", "mpos", "other_grp")
    rest = ours.join(other, "shingle").filter((c("cls") < c("other")) & (c("grp") != c("other_grp")) & may_link(c("n"), c("pos"), c("m"), c("mpos"), percent))
    rest = checkpointed(rest.select(*_pair("cls", "n", "other", "m")).distinct().join(star, ["a", "b"], "left_anti"), small=True)
    if not rest.isEmpty():
        groups = components(links.unionByName(verified(rest, classes, src, width, percent)))
    least = classes.join(groups.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls")).select("cls", "component", "first")
    ids = least.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = checkpointed(least.join(ids, "component").select("cls", "component_id"), small=True)
    out = rows.select("k", "n", "cls").join(ids, "cls", "left")
    return out.select(c("k").alias(key), c("n").alias("n_shingles"), F.coalesce("component_id", "k").alias("component_id"))


def class_links(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 3, percent: int = 90) -> tuple[DataFrame, DataFrame]:
    """All links between different sets: members (key, n_shingles, cls) and links (a, b), classes with a < b.

    ``cls`` is the class of rows with equal sets, which link with each other (null: an empty set, which links with
    nothing); members has one row per row of ``docs``, with a null key too. No candidate is left out because its classes are in one
    component already, so this costs more than ``linked_groups`` where many different texts are alike. A bucket meets
    itself by bands of set sizes: only neighbouring bands can pass the length filter. An empty table gives empty results.
    """
    ship(docs.sparkSession)
    src = _texts(docs, key, text)
    c = F.col
    src = src.select(F.struct(c("k").alias("key"), F.xxhash64("t").alias("h")).alias("k"), "t")  # texts without a key are told apart by their hash
    rows = stored(prefixes(src, width, percent))
    first = F.coalesce(F.min(F.when(c("k.key").isNotNull(), c("k"))), F.min("k"))
    classes = checkpointed(rows.filter("cls is not null").groupBy("cls").agg(first.alias("first")), small=True)
    band = F.floor(F.log(c("n").cast("double")) / math.log(100 / percent)) if percent < 100 else c("n")
    low = stored(shared_postings(rows).select("shingle", "cls", "n", "pos").withColumn("band", band.cast("long")))
    # one band more than the filter needs, as logarithms are rounded
    reach = F.explode(F.sequence(c("band") - 2, c("band"))) if percent < 100 else c("band")
    high = low.select("shingle", c("cls").alias("other"), c("n").alias("m"), c("pos").alias("mpos"), reach.alias("band"))
    met = low.join(high, ["shingle", "band"]).filter(((c("n") < c("m")) | ((c("n") == c("m")) & (c("cls") < c("other")))) & may_link(c("n"), c("pos"), c("m"), c("mpos"), percent))
    pairs = checkpointed(met.select(*_pair("cls", "n", "other", "m")).distinct(), small=True)
    links = checkpointed(verified(pairs, classes, src, width, percent), small=True)
    return rows.select(c("k.key").alias(key), c("n").alias("n_shingles"), "cls"), links


def document_links(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, class_id (least key of the rows with an equal set; an empty set's
    own; null where no such row has a key), n_links (other rows that it links with, copies among them). Nulls, repeated rows and empty tables as in ``class_links``."""
    c = F.col
    members, links = class_links(docs, key=key, text=text, width=width, percent=percent)
    sizes = checkpointed(members.filter("cls is not null").groupBy("cls").agg(F.count("*").alias("size"), F.min(key).alias("least")), small=True)
    both = links.unionByName(links.select(c("b").alias("a"), c("a").alias("b")))
    more = both.join(sizes.select(c("cls").alias("b"), "size"), "b").groupBy(c("a").alias("cls")).agg(F.sum("size").alias("more"))
    known = sizes.join(more, "cls", "left").select("cls", "least", (c("size") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
    return members.join(known, "cls", "left").select(key, "n_shingles", F.coalesce("least", key).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each_group(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows whose component has a smaller key, with all their columns.

    Of rows with the same key and text one stays. Rows with a null key stay.
    """
    c = F.col
    groups = stored(linked_groups(docs, key=key, text=text, width=width, percent=percent))
    gone = groups.filter(c(key) != c("component_id")).select(key).distinct()
    again = checkpointed(groups.filter(c(key).isNotNull()).groupBy(key).count().filter("count > 1").select(key))
    kept = docs.join(_small(gone), key, "left_anti")
    if again.isEmpty():
        return kept
    again = _small(again)
    return kept.join(again, key, "left_anti").unionByName(kept.join(again, key, "left_semi").dropDuplicates([key, text]))
