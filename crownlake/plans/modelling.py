"""Training, comparing and evaluating classifiers of clusters, and label spreading beside them."""

from __future__ import annotations

import itertools
import random
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import models as M
from .lineage import checkpointed

c = F.col
#: The features that models take, and the fewer ones that the advanced comparison takes.
FEATURES = [
    "height", "radius", "n_points", "obb_extent_x", "obb_extent_y", "obb_extent_z", "eigenvalue_1", "eigenvalue_2", "eigenvalue_3",
    "linearity", "planarity", "sphericity", "mean_r", "mean_g", "mean_b", "std_r", "std_g", "std_b", "verticality", "flatness_ratio",
    "crown_base_ratio", "height_to_radius", "green_dominance", "crown_volume", "color_saturation",
]
#: Classes with at least this many rows are trained without a warning.
FEW_ROWS = 10


@dataclass
class Enhancements:
    """Which of the optional steps a training takes."""

    smote: bool = False
    weighting: bool = True
    selection: bool = True
    tuning: bool = False
    boost: dict[str, float] = field(default_factory=lambda: {"ponderosa": 2.0})


def class_counts(rows: DataFrame, label: str = "Name") -> DataFrame:
    """label, n, few (whether the class has too few rows to trust), most first."""
    return rows.groupBy(label).agg(F.count("*").alias("n")).withColumn("few", c("n") < FEW_ROWS).orderBy(F.desc("n"), label)


def coded(rows: DataFrame, label: str, classes: list[str]) -> DataFrame:
    """rows with ``y``, the place of the label among the classes."""
    return rows.withColumn("y", (F.array_position(F.array(*map(F.lit, classes)), c(label)) - 1).cast("int"))


def named(rows: DataFrame, classes: list[str], column: str = "prediction", out: str = "predicted_label") -> DataFrame:
    return rows.withColumn(out, F.get(F.array(*map(F.lit, classes)), c(column)))


def report(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """class, support, precision, recall, f1 (0 where undefined)."""
    cells = rows.groupBy(c(truth).alias("t"), c(guess).alias("p")).agg(F.count("*").alias("n"))
    sides = cells.select("n", (c("t") == c("p")).alias("hit"), F.explode(F.array(F.struct(c("t").alias("k"), F.lit(True).alias("own")), F.struct(c("p").alias("k"), F.lit(False).alias("own")))).alias("s"))
    by = sides.groupBy(c("s.k").alias("class")).agg(
        F.sum(F.when(c("s.own"), c("n")).otherwise(0)).alias("support"), F.sum(F.when(~c("s.own"), c("n")).otherwise(0)).alias("guessed"), F.sum(F.when(c("s.own") & c("hit"), c("n")).otherwise(0)).alias("hits")
    )
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return by.select(
        "class", "support", zero(F.try_divide("hits", "guessed")).alias("precision"), zero(F.try_divide("hits", "support")).alias("recall"), zero(F.try_divide(2 * c("hits"), c("support") + c("guessed"))).alias("f1")
    )


def fitted(train: DataFrame, names: list[str], kind: str, label: str, classes: list[str], e: Enhancements, **params):
    """A model of ``kind`` on rows with ``label``, after the chosen enhancements, and the features it takes."""
    rows = coded(train, label, classes)
    if e.smote:
        n = {r[label]: r["n"] for r in class_counts(train, label).collect()}
        most = max(n.values())
        goal = {classes.index(k): min(most, max(2 * v, 40)) for k, v in n.items() if v < most}
        rows = M.smote(rows.withColumn("_id", c("file")), names, "y", "_id", goal, k=min(4, min(n.values()) - 1)) if min(n.values()) > 1 else rows
    weight = None
    if e.weighting:
        boost = {classes.index(k): v for k, v in e.boost.items() if k in classes}
        rows, weight = rows.join(F.broadcast(M.class_weights(rows, "y", boost).select("y", "weight")), "y"), "weight"
    rows = checkpointed(rows)
    chosen = M.select_features(rows, names, "y", 50) if e.selection else names
    return M.fit(rows, chosen, kind, "y", weight=weight, **params), chosen


def cross_validated(rows: DataFrame, names: list[str], kind: str, label: str, key: str, classes: list[str], e: Enhancements, folds: int = 3, **params) -> DataFrame:
    """fold, n, accuracy, macro_f1, kappa: each fold predicted by a model of the others."""
    dealt = checkpointed(M.stratified_folds(rows, label, key, folds))
    out = None
    for k in range(folds):
        model, _ = fitted(dealt.filter(c("fold") != k), names, kind, label, classes, e, **params)
        one = M.quality(M.predicted(model, coded(dealt.filter(c("fold") == k), label, classes), key, "y"), "y", "prediction").withColumn("fold", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out.select("fold", "n", "accuracy", "macro_f1", "kappa")


def random_search(rows: DataFrame, names: list[str], kind: str, label: str, key: str, classes: list[str], grid: dict[str, list], tries: int = 30, folds: int = 3, seed: int = 42) -> dict:
    """The settings, of ``tries`` drawn from the grid, with the best mean macro-F1 over folds."""
    every = [dict(zip(grid, v, strict=True)) for v in itertools.product(*grid.values())]
    drawn = random.Random(seed).sample(every, min(tries, len(every)))
    e = Enhancements(selection=False)
    score = lambda p: cross_validated(rows, names, kind, label, key, classes, e, folds, **p).agg(F.avg("macro_f1")).first()[0] or 0.0
    return max(drawn, key=score)


@dataclass
class Training:
    """The best model with its features and classes, and a table of all models."""

    model: object
    features: list[str]
    classes: list[str]
    table: list[dict]

    def predictions(self, features: DataFrame, key: str = "file") -> DataFrame:
        """key, predicted_label, prob_<class> of all rows, labelled or not."""
        out = named(M.predicted(self.model, features.withColumn("y", F.lit(0)), key, "y"), self.classes)
        more = [c("probability")[k].alias(f"prob_{name}") for k, name in enumerate(self.classes)] if "probability" in out.columns else []
        return out.select(key, "predicted_label", *more)


def train(features: DataFrame, labels: DataFrame, *, names: list[str] | None = None, kinds: Iterable[tuple[str, dict]] = (("forest", {"trees": 50}), ("logistic", {})), e: Enhancements | None = None, key: str = "file", label: str = "Name") -> Training:
    """Models of all kinds on 80 % of the labelled rows; the best by macro-F1 on the others wins, and cross-validation
    over at most three folds stands beside it."""
    names, e = names or FEATURES, e or Enhancements()
    rows = checkpointed(M.stratified_split(M.labelled(features, labels, key, label), label, key))
    counts = class_counts(rows, label).collect()
    if len(counts) < 2:
        raise ValueError("two classes are needed")
    classes = sorted(r[label] for r in counts)
    folds = max(2, min(3, min(r["n"] for r in counts)))
    found = []
    for kind, params in kinds:
        if e.tuning and kind == "forest":
            params = random_search(rows.filter("not test"), names, kind, label, key, classes, {"trees": [50, 100, 200], "depth": [4, 8, 12]}, 4, folds)
        model, chosen = fitted(rows.filter("not test"), names, kind, label, classes, e, **params)
        test = M.quality(M.predicted(model, coded(rows.filter("test"), label, classes), key, "y"), "y", "prediction").first()
        cv = cross_validated(rows, names, kind, label, key, classes, e, folds, **params).agg(F.avg("macro_f1").alias("mean"), F.stddev_pop("macro_f1").alias("std")).first()
        found.append(({"model": kind, "test_macro_f1": test.macro_f1 or 0.0, "test_kappa": test.kappa, "cv_mean": cv["mean"], "cv_std": cv["std"]}, model, chosen))
    found.sort(key=lambda x: (-x[0]["test_macro_f1"], x[0]["model"]))
    return Training(found[0][1], found[0][2], classes, [x[0] for x in found])


def confident(predictions: DataFrame, name: str = "pinyon", over: float = 0.80) -> DataFrame:
    """Rows with the given label and a probability over the limit."""
    return predictions.filter((c("predicted_label") == name) & (c(f"prob_{name}") > over))


def isotonic(rows: DataFrame, margins: str, label: str, classes: int) -> DataFrame:
    """rows with ``calibrated``: per class an isotonic curve of its margin (an array column), scaled to sum 1.

    The curves are fitted on the rows given; margins come from models of other rows.
    """
    out = rows
    for k in range(classes):
        part = out.withColumn("_x", c(margins)[k]).withColumn("_hit", (c(label) == k).cast("double"))
        out = IsotonicRegression(featuresCol="_x", labelCol="_hit", predictionCol=f"_p{k}").fit(part).transform(part).drop("_x", "_hit")
    total = sum((c(f"_p{k}") for k in range(classes)), F.lit(0.0))
    share = [F.coalesce(F.try_divide(c(f"_p{k}"), total), F.lit(1.0 / classes)) for k in range(classes)]
    return out.withColumn("calibrated", F.array(*share)).drop(*(f"_p{k}" for k in range(classes)))


def voted(rows: DataFrame, models: list, weights: list[float], key: str) -> DataFrame:
    """key, y, prediction by the weighted mean of the models' probabilities."""
    out = None
    for k, model in enumerate(models):
        one = M.predicted(model, rows, key, "y").select(key, "y", c("probability").alias(f"p{k}"))
        out = one if out is None else out.join(one.drop("y"), key)
    mean = M.soft_vote(out, [f"p{k}" for k in range(len(models))], weights)
    return mean.select(key, "y", (F.array_position("probability", F.array_max("probability")) - 1).cast("int").alias("prediction"))


# ---- label spreading ----------------------------------------------------------------------------------


def spread(features: DataFrame, labels: DataFrame, *, names: list[str] | None = None, key: str = "file", label: str = "Name", **params) -> DataFrame:
    """semi_label and semi_confidence of all rows; rows without a known label are spread to."""
    rows = features.join(labels.select(key, F.when(c(label) != "unknown", c(label)).alias(label)), key, "left")
    return M.label_spreading(rows, names or FEATURES, label, key, **params)


def spread_summary(spreaded: DataFrame) -> DataFrame:
    """semi_label, n, percent."""
    n = spreaded.groupBy("semi_label").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("_all")))).select("semi_label", "n", (100 * c("n") / c("_all")).alias("percent"))


def held_out(features: DataFrame, labels: DataFrame, *, names: list[str] | None = None, key: str = "file", label: str = "Name", folds: int = 5, share: float = 1.0, **params) -> DataFrame:
    """key, fold, label, semi_label, semi_confidence: known labels, each spread to from the other folds.

    With ``share`` under 1 only so much of the other folds' labels, by class, is left.
    """
    known = checkpointed(M.stratified_folds(M.labelled(features, labels, key, label).select(key, label), label, key, folds))
    out = None
    for k in range(folds):
        left = M.degraded(known.filter(c("fold") != k), label, key, share)
        one = spread(features, left, names=names, key=key, label=label, threshold=0.0, **params).join(known.filter(c("fold") == k), key)
        out = one if out is None else out.unionByName(one)
    return out.select(key, "fold", label, "semi_label", "semi_confidence")


def degradation(features: DataFrame, labels: DataFrame, shares: tuple[float, ...] = (1.0, 0.75, 0.5, 0.25, 0.1), **params) -> DataFrame:
    """share, n, accuracy, macro_f1, kappa of held-out spreading with fewer and fewer labels."""
    label = params.get("label", "Name")
    out = None
    for s in shares:
        one = M.quality(held_out(features, labels, share=s, **params), label, "semi_label").withColumn("share", F.lit(s))
        out = one if out is None else out.unionByName(one)
    return out


def compared(features: DataFrame, labels: DataFrame, *, names: list[str] | None = None, key: str = "file", label: str = "Name", folds: int = 5, trees: int = 50) -> DataFrame:
    """method, n, accuracy, macro_f1, kappa: a forest and label spreading on the same folds."""
    names = names or FEATURES
    rows = M.labelled(features, labels, key, label)
    classes = sorted(r[label] for r in rows.select(label).distinct().collect())
    dealt = checkpointed(M.stratified_folds(rows, label, key, folds))
    guessed = None
    for k in range(folds):
        model, _ = fitted(dealt.filter(c("fold") != k), names, "forest", label, classes, Enhancements(selection=False), trees=trees)
        one = M.predicted(model, coded(dealt.filter(c("fold") == k), label, classes), key, "y")
        guessed = one if guessed is None else guessed.unionByName(one)
    forest = M.quality(guessed, "y", "prediction").withColumn("method", F.lit("forest"))
    spreading = M.quality(held_out(features, labels, names=names, key=key, label=label, folds=folds), label, "semi_label").withColumn("method", F.lit("spreading"))
    return forest.unionByName(spreading).select("method", "n", "accuracy", "macro_f1", "kappa")


def full_evaluation(features: DataFrame, labels: DataFrame, **params) -> dict[str, DataFrame]:
    """held_out, compared, degradation and reliability tables."""
    own = held_out(features, labels, **params)
    label = params.get("label", "Name")
    return {"held_out": own, "compared": compared(features, labels, **params), "degradation": degradation(features, labels, **params), "reliability": M.reliability(own, label, "semi_label", "semi_confidence")}


def best(table: DataFrame, score: str, by: str) -> DataFrame:
    """The first row by falling score, ties by name."""
    return table.withColumn("_k", F.row_number().over(Window.orderBy(F.desc(score), by))).filter("_k = 1").drop("_k")


