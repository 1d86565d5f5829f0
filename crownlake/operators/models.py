"""Operators for classifiers of clusters: folds, weights, metrics, resampling, voting, spreading, models."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import checkpointed

c = F.col
#: Most training rows that are broadcast, most rows of a graph that is held as one matrix, rows of a block beyond these.
BROADCAST_ROWS, DENSE_ROWS, BLOCK_ROWS = 20_000, 4_096, 4_096


def labelled(features: DataFrame, labels: DataFrame, key: str = "file", name: str = "Name") -> DataFrame:
    """Features joined to their labels, without null and unknown ones."""
    return features.join(labels.select(key, name), key).filter(c(name).isNotNull() & (c(name) != "unknown"))


def class_weights(rows: DataFrame, label: str, boost: dict[str, float] | None = None) -> DataFrame:
    """label, n, weight = rows / (classes * n), times the class's boost."""
    n = rows.groupBy(label).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("_all"), F.count("*").alias("_k"))
    times = F.lit(1.0)
    for value, by in (boost or {}).items():
        times = F.when(c(label) == value, F.lit(float(by))).otherwise(times)
    return n.join(F.broadcast(total)).select(label, "n", (c("_all") / (c("_k") * c("n")) * times).alias("weight"))


def stratified_folds(rows: DataFrame, label: str, key: str, k: int) -> DataFrame:
    """rows with ``fold``: the rank by key within the class, modulo k."""
    return rows.withColumn("fold", (F.row_number().over(Window.partitionBy(label).orderBy(key)) - 1) % k)


def stratified_split(rows: DataFrame, label: str, key: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """rows with ``test``: per class the ``share`` of rows that come first by a hash of key and seed."""
    w = Window.partitionBy(label)
    order = F.row_number().over(w.orderBy(F.xxhash64(key, F.lit(seed)), key))
    return rows.withColumn("test", order <= F.ceil(F.count("*").over(w) * share))


def degraded(rows: DataFrame, label: str, key: str, share: float) -> DataFrame:
    """Per class the first max(1, round(n * share)) rows by key (half to even)."""
    w = Window.partitionBy(label)
    ranked = rows.withColumn("_n", F.count("*").over(w)).withColumn("_k", F.row_number().over(w.orderBy(key)))
    return ranked.filter(c("_k") <= F.greatest(F.lit(1), F.bround(c("_n") * F.lit(share)))).drop("_n", "_k")


def standard_scale(rows: DataFrame, names: list[str]) -> DataFrame:
    """rows with each column less its mean, by its population deviation (by 1 where that is 0)."""
    stats = rows.agg(*(F.avg(n).alias(f"_m_{n}") for n in names), *(F.stddev_pop(n).alias(f"_s_{n}") for n in names))
    scaled = {n: (c(n) - c(f"_m_{n}")) / F.when(c(f"_s_{n}") > 0, c(f"_s_{n}")).otherwise(1.0) for n in names}
    return rows.join(F.broadcast(stats)).withColumns(scaled).drop(*stats.columns)


def confusion(rows: DataFrame, truth: str, guess: str, classes: list) -> DataFrame:
    """truth and one count column per class, zero-filled, for classes that occur in ``truth``."""
    return rows.groupBy(truth).pivot(guess, classes).count().na.fill(0)


def quality(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """n, accuracy, macro_f1 (0 for a class without true or guessed rows), kappa."""
    cells = rows.groupBy(c(truth).alias("t"), c(guess).alias("p")).agg(F.count("*").alias("n"))
    sides = cells.select("n", (c("t") == c("p")).alias("hit"), F.explode(F.array(F.struct(c("t").alias("k"), F.lit(1).alias("own"), F.lit(0).alias("got")), F.struct(c("p").alias("k"), F.lit(0).alias("own"), F.lit(1).alias("got")))).alias("s"))
    by = sides.groupBy("s.k").agg(F.sum(c("n") * c("s.own")).alias("own"), F.sum(c("n") * c("s.got")).alias("got"), F.sum(F.when(c("hit") & (c("s.own") == 1), c("n")).otherwise(0)).alias("hits"))
    out = by.agg(F.sum("own").alias("n"), F.sum("hits").alias("hits"), F.avg(2 * c("hits") / (c("own") + c("got"))).alias("macro_f1"), F.sum(c("own") * c("got")).alias("chance"))
    p0, pe = c("hits") / c("n"), c("chance") / (c("n") * c("n"))
    return out.select("n", p0.alias("accuracy"), "macro_f1", F.try_divide(p0 - pe, 1 - pe).alias("kappa"))


def reliability(rows: DataFrame, truth: str, guess: str, confidence: str, bins: int = 10) -> DataFrame:
    """bin, n, mean_confidence, accuracy: bins between literal edges k / bins, closed below."""
    edges = [float(e) for e in np.linspace(0, 1, bins + 1)]
    at = F.greatest(*(F.when(c(confidence) >= edges[k], k).otherwise(0) for k in range(bins))) if bins > 1 else F.lit(0)
    return rows.withColumn("bin", at).groupBy("bin").agg(F.count("*").alias("n"), F.avg(confidence).alias("mean_confidence"), F.avg((c(truth) == c(guess)).cast("double")).alias("accuracy"))


def soft_vote(rows: DataFrame, columns: list[str], weights: list[float], out: str = "probability") -> DataFrame:
    """rows with the weighted mean of probability arrays."""
    total = float(sum(weights))
    mean = None
    scaled = lambda name, w: F.transform(c(name), lambda x: x * w)
    for name, w in zip(columns, weights, strict=True):
        part = scaled(name, w / total)
        mean = part if mean is None else F.zip_with(mean, part, lambda a, b: a + b)
    return rows.withColumn(out, mean)


def _dealt(rows: DataFrame) -> DataFrame:
    """rows with ``_id``, a number of their own that a checkpoint fixes (keys may repeat)."""
    return checkpointed(rows.withColumn("_id", F.monotonically_increasing_id()))


def _in_blocks(left: DataFrame, right: DataFrame, run, schema: str, blocks: tuple[int, int]) -> DataFrame:
    """``run`` on each block of ``left`` with each block of ``right``; rows are dealt to blocks by a hash of ``_id``."""
    own = lambda n: F.pmod(F.xxhash64("_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = left.withColumn("_i", own(blocks[0])).withColumn("_j", every(blocks[1]))
    b = right.withColumn("_j", own(blocks[1])).withColumn("_i", every(blocks[0]))
    return a.groupBy("_i", "_j").cogroup(b.groupBy("_i", "_j")).applyInPandas(run, schema)


def _blocks_of(*sides: DataFrame) -> tuple[int, ...]:
    return tuple(max(1, -(-side.count() // BLOCK_ROWS)) for side in sides)


def knn_vote(train: DataFrame, rows: DataFrame, names: list[str], label: str, key: str, k: int = 5) -> DataFrame:
    """key, predicted: the most frequent label of the k nearest training rows (ties to the smaller label;
    equal distances to the smaller key). BROADCAST_ROWS training rows at most are broadcast; more are met in
    blocks, each of which gives its k nearest, with the same result."""
    kinds = {n: train.schema[n].dataType.simpleString() for n in (label, key)}
    if train.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        known, asked = _dealt(train.select(c(key).alias("_key"), c(label).alias("_label"), *names)), _dealt(rows.select(c(key).alias("_asked"), *names))

        def near(y: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
            x = x.sort_values(["_key", "_id"])
            p, q, out = y[names].to_numpy(float), x[names].to_numpy(float), []
            for i in range(len(p)):
                d = ((p[i] - q) ** 2).sum(axis=1)
                best = np.argsort(d, kind="stable")[:k]
                out.append(x.iloc[best][["_key", "_label"]].assign(_other=x["_id"].to_numpy()[best], _id=y["_id"].iloc[i], _d=d[best]))
            empty = pd.DataFrame(columns=["_id", "_d", "_key", "_other", "_label"])
            return pd.concat(out)[list(empty)] if out else empty

        found = _in_blocks(asked, known, near, f"_id long, _d double, _key {kinds[key]}, _other long, _label {kinds[label]}", _blocks_of(asked, known))
        order = Window.partitionBy("_id").orderBy(c("_d").asc_nulls_last(), "_key", "_other")
        votes = found.withColumn("_r", F.row_number().over(order)).filter(c("_r") <= k).groupBy("_id", "_label").agg(F.count("*").alias("_n"))
        most = votes.groupBy("_id").agg(F.min(F.struct((-c("_n")).alias("n"), "_label")).alias("_most"))
        return asked.join(most, "_id").select(c("_asked").alias(key), c("_most._label").alias("predicted"))

    pdf = train.select(key, label, *names).orderBy(key).toPandas()
    values, codes = np.unique(pdf[label].to_numpy(), return_inverse=True)
    shared = rows.sparkSession.sparkContext.broadcast((pdf[names].to_numpy(float), codes, len(values)))

    def vote(parts):
        x, codes, m = shared.value
        step = max(1, (1 << 20) // max(len(x), 1))
        for part in parts:
            y, out = part[names].to_numpy(float), []
            for a in range(0, len(y), step):
                d = ((y[a : a + step, None, :] - x[None]) ** 2).sum(axis=2)
                near = np.argsort(d, axis=1, kind="stable")[:, :k]
                out += [int(np.argmax(np.bincount(codes[row], minlength=m))) for row in near]
            yield pd.DataFrame({key: part[key].to_numpy(), "predicted": values[out] if out else values[:0]})

    return rows.select(key, *names).mapInPandas(vote, f"{key} {rows.schema[key].dataType.simpleString()}, predicted {kinds[label]}")


def class_neighbours(rows: DataFrame, names: list[str], label: str, key: str, k: int) -> DataFrame:
    """label, key, rank, neighbour: the k nearest other rows of the same class (ties to the smaller key).

    Blocks of rows meet, whatever the size of a class; each pair of blocks gives its k nearest."""
    kind = rows.schema[key].dataType.simpleString()
    dealt = _dealt(rows.select(c(label).alias("_label"), c(key).alias("_key"), *names))

    def near(y: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["_key", "_id"])
        codes = pd.factorize(pd.concat([y["_label"], x["_label"]]))[0]
        own, others = codes[: len(y)], codes[len(y) :]
        p, q, ids, keys, out = y[names].to_numpy(float), x[names].to_numpy(float), x["_id"].to_numpy(), x["_key"].to_numpy(), []
        for i, me in enumerate(y["_id"]):
            at = np.flatnonzero((others == own[i]) & (ids != me))
            d = ((q[at] - p[i]) ** 2).sum(axis=1)
            out += [(me, d[j], keys[at[j]], ids[at[j]]) for j in np.argsort(d, kind="stable")[:k]]
        return pd.DataFrame(out, columns=["_id", "_d", "neighbour", "_other"])

    found = _in_blocks(dealt, dealt, near, f"_id long, _d double, neighbour {kind}, _other long", _blocks_of(dealt) * 2)
    order = Window.partitionBy("_id").orderBy(c("_d").asc_nulls_last(), "neighbour", "_other")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(c("rank") <= k)
    return dealt.select("_id", "_label", "_key").join(ranked, "_id").select(c("_label").alias(label), c("_key").alias(key), "rank", "neighbour")


def smote(rows: DataFrame, names: list[str], label: str, key: str, target: dict, k: int = 4, seed: int = 42) -> DataFrame:
    """label and features: ``rows`` and new rows between neighbours of a class, up to the class's target."""
    near = class_neighbours(rows, names, label, key, k)
    have = rows.groupBy(label).agg(F.count("*").alias("_n"))
    goal = F.coalesce(*(F.when(c(label) == v, F.lit(int(n))) for v, n in target.items()), F.lit(0))
    base = near.join(have, label).withColumn("_more", F.greatest(F.lit(0), goal - c("_n")))
    copies = base.withColumn("_c", F.explode(F.sequence(F.lit(0), F.ceil(c("_more") / c("_n")).cast("int"))))
    order = F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64(key, "neighbour", "_c", F.lit(seed)), key, "rank"))
    chosen = copies.withColumn("_k", order).filter(c("_k") <= c("_more"))
    a, b = rows.select(label, key, *(c(n).alias(f"_a{i}") for i, n in enumerate(names))), rows.select(c(key).alias("neighbour"), *(c(n).alias(f"_b{i}") for i, n in enumerate(names)))
    t = (F.pmod(F.xxhash64(key, "neighbour", "_c", F.lit(seed + 1)), F.lit(1 << 20)) / (1 << 20)).alias("_t")
    new = chosen.select(label, key, "neighbour", t).join(a, [label, key]).join(b, "neighbour")
    new = new.select(label, *((c(f"_a{i}") + c("_t") * (c(f"_b{i}") - c(f"_a{i}"))).alias(n) for i, n in enumerate(names)))
    return rows.select(label, *names).unionByName(new)


def spread_step(x: np.ndarray, y: np.ndarray, f: np.ndarray, gamma: float, alpha: float) -> np.ndarray:
    """One step of label spreading on the normalised RBF graph without self-loops, rows summing to 1."""
    w = np.exp(-gamma * ((x[:, None, :] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(w, 0)
    d = w.sum(axis=1)
    d[d == 0] = 1
    f = alpha * (w / np.sqrt(d[:, None] * d[None])) @ f + (1 - alpha) * y
    total = f.sum(axis=1, keepdims=True)
    return f / np.where(total == 0, 1, total)


def spread_once(rows: DataFrame, names: list[str], label: str, key: str, values: list, *, alpha: float = 0.2, gamma: float = 0.5) -> DataFrame:
    """key, k, p: the shares of each of ``values`` after one step of label spreading on unscaled features.

    DENSE_ROWS rows at most are one matrix; more are met in blocks, with the same result."""
    src = rows.select(c(key).alias("key"), c(label).alias("label"), *names)
    kind, m = rows.schema[key].dataType.simpleString(), len(values)
    if src.limit(DENSE_ROWS + 1).count() > DENSE_ROWS:
        spread = _Spread(src, names, values, gamma)
        return spread.step(spread.start, alpha).select(c("_key").alias(key), F.posexplode(F.array(*spread.shares())).alias("k", "p"))

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        y = np.stack([(pdf["label"] == v).to_numpy(float) for v in values], axis=1)
        f = spread_step(pdf[names].to_numpy(float), y, y, gamma, alpha)
        return pd.DataFrame({"key": np.repeat(pdf["key"].to_numpy(), m), "k": np.tile(np.arange(m, dtype=np.int32), len(pdf)), "p": f.reshape(-1)})

    return src.groupBy().applyInPandas(step, f"key {kind}, k int, p double").withColumnRenamed("key", key)


def label_spreading(rows: DataFrame, names: list[str], label: str, key: str, *, alpha: float = 0.2, gamma: float = 0.5, max_iter: int = 100, tolerance: float = 1e-3, threshold: float = 0.80, scale: bool = True) -> DataFrame:
    """key, semi_label (``uncertain`` under the threshold), semi_confidence. Null labels are spread to.

    The graph is dense: DENSE_ROWS rows at most are one matrix; more are met in blocks in every round, with the same result.
    """
    src = (standard_scale(rows, names) if scale else rows).select(c(key).alias("key"), c(label).alias("label"), *names)
    if rows.limit(DENSE_ROWS + 1).count() > DENSE_ROWS:
        return _spread_in_blocks(src, names, alpha, gamma, max_iter, tolerance, threshold).withColumnRenamed("key", key)
    kind = rows.schema[key].dataType.simpleString()

    def spread(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        x, known = pdf[names].to_numpy(float), pdf["label"].notna().to_numpy()
        values = sorted(pdf["label"].dropna().unique())
        y = np.zeros((len(pdf), max(len(values), 1)))
        for k, v in enumerate(values):
            y[(pdf["label"] == v).to_numpy() & known, k] = 1
        w = np.exp(-gamma * ((x[:, None, :] - x[None]) ** 2).sum(axis=2))
        np.fill_diagonal(w, 0)
        d = w.sum(axis=1)
        d[d == 0] = 1
        s = w / np.sqrt(d[:, None] * d[None])
        f = y.copy()
        for _ in range(max_iter):
            new = alpha * s @ f + (1 - alpha) * y
            moved = np.abs(new - f).sum()
            f = new
            if moved < tolerance:
                break
        total = f.sum(axis=1, keepdims=True)
        f = f / np.where(total == 0, 1, total)
        best = f.max(axis=1)
        names_of = np.array([str(v) for v in values] or ["uncertain"])
        return pd.DataFrame({"key": pdf["key"].to_numpy(), "semi_label": np.where(best >= threshold, names_of[f.argmax(axis=1)], "uncertain"), "semi_confidence": best})

    out = src.groupBy().applyInPandas(spread, f"key {kind}, semi_label string, semi_confidence double")
    return out.withColumnRenamed("key", key)


def _pulled(rows: DataFrame, state: DataFrame, d: int, n: int, gamma: float, blocks: tuple[int, int]) -> DataFrame:
    """_id and the sums _s0, _s1, ... of the other rows' _v0, _v1, ... by the RBF weight of _x0, _x1, ...; both sides have _id."""
    xs, vs, sums = ([f"_{name}{i}" for i in range(k)] for name, k in (("x", d), ("v", n), ("s", n)))

    def run(x: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        p, q, v = x[xs].to_numpy(float), g[xs].to_numpy(float), g[vs].to_numpy(float)
        me, other, out = x["_id"].to_numpy(), g["_id"].to_numpy(), np.zeros((len(x), n))
        if len(x) and len(g):
            middle = q.mean(axis=0)  # squares of small numbers lose less
            p, q = p - middle, q - middle
            half, order = (q * q).sum(axis=1), np.argsort(other, kind="stable")
            at = np.minimum(np.searchsorted(other[order], me), len(other) - 1)
            own = np.where(other[order][at] == me, order[at], -1)
            for a in range(0, len(p), 128):
                part, mine = p[a : a + 128], own[a : a + 128]
                w = part @ (-2 * q.T)
                w += (part * part).sum(axis=1)[:, None]
                w += half
                np.maximum(w, 0, out=w)
                w *= -gamma
                np.exp(w, out=w)
                w[np.flatnonzero(mine >= 0), mine[mine >= 0]] = 0
                out[a : a + 128] = w @ v
        return pd.DataFrame({"_id": me} | {name: out[:, i] for i, name in enumerate(sums)})

    parts = _in_blocks(rows.select("_id", *xs), state.select("_id", *xs, *vs), run, "_id long" + "".join(f", {name} double" for name in sums), blocks)
    return parts.groupBy("_id").agg(*(F.sum(name).alias(name) for name in sums))


class _Spread:
    """Label spreading of key, label and features in blocks; a round's state is one row per row, and is checkpointed.

    Columns of its own begin with an underscore, whatever the features are named.
    """

    def __init__(self, src: DataFrame, names: list[str], values: list, gamma: float):
        self.m, self.d, self.gamma = range(len(values)), len(names), gamma
        own = [F.coalesce((c("label") == v).cast("double"), F.lit(0.0)).alias(f"_y{i}") for i, v in enumerate(values)]
        rows = _dealt(src.select(c("key").alias("_key"), *own, *(c(x).cast("double").alias(f"_x{i}") for i, x in enumerate(names))))
        self.blocks = _blocks_of(rows) * 2
        degree = _pulled(rows, rows.withColumn("_v0", F.lit(1.0)), self.d, 1, gamma, self.blocks)
        root = degree.select("_id", F.sqrt(F.when(c("_s0") == 0, 1.0).otherwise(c("_s0"))).alias("_root"))
        self.rows = checkpointed(rows.join(root, "_id"))
        self.start = self.rows.select("*", *(c(f"_y{i}").alias(f"_f{i}") for i in self.m))

    def step(self, state: DataFrame, alpha: float) -> DataFrame:
        """The next state; _move is what the row moved by."""
        sent = state.select("*", *((c(f"_f{i}") / c("_root")).alias(f"_v{i}") for i in self.m))
        sums = _pulled(self.rows, sent, self.d, len(self.m), self.gamma, self.blocks)
        new = [alpha * c(f"_s{i}") / c("_root") + (1 - alpha) * c(f"_y{i}") for i in self.m]
        move = sum((F.abs(x - c(f"_f{i}")) for i, x in zip(self.m, new, strict=True)), F.lit(0.0))
        return checkpointed(state.join(sums, "_id").select(*self.rows.columns, *(x.alias(f"_f{i}") for i, x in zip(self.m, new, strict=True)), move.alias("_move")))

    def shares(self) -> list[Column]:
        """Of a state, the columns _f0, _f1, ... by their sum (by 1 where that is 0)."""
        total = sum((c(f"_f{i}") for i in self.m), F.lit(0.0))
        return [c(f"_f{i}") / F.when(total == 0, 1.0).otherwise(total) for i in self.m]


def _spread_in_blocks(src: DataFrame, names: list[str], alpha: float, gamma: float, max_iter: int, tolerance: float, threshold: float) -> DataFrame:
    """``label_spreading`` of key, label and features."""
    values = sorted(r[0] for r in src.select("label").distinct().dropna().collect())
    if not values:
        return src.select("key", F.lit("uncertain").alias("semi_label"), F.lit(0.0).alias("semi_confidence"))
    spread = _Spread(src, names, values, gamma)
    state = spread.start
    for _ in range(max_iter):
        state = spread.step(state, alpha)
        if state.agg(F.sum("_move")).first()[0] < tolerance:
            break
    best = F.array_max(F.array(*spread.shares()))
    top = F.array_position(F.array(*(c(f"_f{i}") for i in spread.m)), F.array_max(F.array(*(c(f"_f{i}") for i in spread.m))))
    name = F.get(F.array(*(F.lit(str(v)) for v in values)), (top - 1).cast("int"))
    return state.select(c("_key").alias("key"), F.when(best >= threshold, name).otherwise("uncertain").alias("semi_label"), best.alias("semi_confidence"))


# ---- models on the ML library ---------------------------------------------------------------------


def random_features(rows: DataFrame, names: list[str], n: int = 100, gamma: float = 0.1, seed: int = 42, out: str = "features") -> DataFrame:
    """rows with ``out``: random Fourier features of the RBF kernel, so that linear models act as RBF ones."""
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, math.sqrt(2 * gamma), (n, len(names))), rng.uniform(0, 2 * math.pi, n)
    part = lambda k: F.cos(sum((c(x) * float(w[k, i]) for i, x in enumerate(names)), F.lit(float(b[k])))) * math.sqrt(2 / n)
    return rows.withColumn(out, array_to_vector(F.array(*(part(k) for k in range(n)))))


def estimator(kind: str, label: str, features: str = "features", weight: str | None = None, **params):
    """forest, logistic, boosting (one against the rest), svm (one against the rest) or perceptron."""
    common = {"featuresCol": features, "labelCol": label} | ({"weightCol": weight} if weight and kind in ("forest", "logistic") else {})
    if kind == "forest":
        return RandomForestClassifier(numTrees=params.get("trees", 200), maxDepth=params.get("depth", 8), seed=42, **common)
    if kind == "logistic":
        return LogisticRegression(family="multinomial", maxIter=100, regParam=params.get("reg", 0.01), **common)
    if kind == "boosting":
        return OneVsRest(classifier=GBTClassifier(maxIter=params.get("trees", 200), maxDepth=4, stepSize=0.05, seed=42, featuresCol=features, labelCol=label), featuresCol=features, labelCol=label)
    if kind == "svm":
        return OneVsRest(classifier=LinearSVC(maxIter=50, regParam=0.01, featuresCol=features, labelCol=label), featuresCol=features, labelCol=label)
    if kind == "perceptron":
        return MultilayerPerceptronClassifier(layers=params["layers"], maxIter=params.get("rounds", 100), seed=42, **common)
    raise ValueError(f"no model {kind}")


def fit(rows: DataFrame, names: list[str], kind: str, label: str, weight: str | None = None, **params):
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), estimator(kind, label, weight=weight, **params)]).fit(rows)


def predicted(model, rows: DataFrame, key: str, label: str) -> DataFrame:
    """key, label, prediction and, for models that give them, the probabilities as an array."""
    out = model.transform(rows)
    more = [vector_to_array("probability").alias("probability")] if "probability" in out.columns else []
    return out.select(key, label, c("prediction").cast("int").alias("prediction"), *more)


def select_features(rows: DataFrame, names: list[str], label: str, trees: int = 100) -> list[str]:
    """Names whose importance in a forest is the mean importance or more."""
    model = fit(rows, names, "forest", label, trees=trees).stages[-1]
    weight = model.featureImportances.toArray()
    return [n for n, w in zip(names, weight, strict=True) if w >= weight.mean()]


def sliced(rows: DataFrame, names: list[str], chosen: list[str]) -> DataFrame:
    """rows with ``chosen_features``, the vector of the chosen ones."""
    all_of = VectorAssembler(inputCols=names, outputCol="_all").transform(rows)
    return VectorSlicer(inputCol="_all", outputCol="chosen_features", indices=[names.index(n) for n in chosen]).transform(all_of).drop("_all")
