"""Training plans on made features, the command line, and named files."""

import argparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from crownlake.operators import raster as R
from crownlake.plans import modelling as T
from crownlake.plans.settings import LEGACY, Paths, clustering_parser, flag, settings_of
from crownlake.sources import ply

NAMES = ["f", "g", "h"]


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(90):
        k = i % 3
        rows.append((i, *(float(v) for v in rng.normal([3 * k, -2 * k, 0], 0.5))))
    features = spark.createDataFrame(rows, "file long, f double, g double, h double")
    labels = spark.createDataFrame([(i, ["pinyon", "juniper", "ponderosa"][i % 3] if i < 75 else "unknown") for i in range(90)], "file long, Name string")
    return features, labels


def test_training_chooses_and_predicts(tables):
    features, labels = tables
    out = T.train(features, labels, names=NAMES, kinds=[("forest", {"trees": 10}), ("logistic", {})], e=T.Enhancements(smote=True, selection=True))
    assert [t["model"] for t in out.table] and out.table[0]["test_macro_f1"] > 0.9 and set(out.features) <= set(NAMES)
    guess = out.predictions(features)
    assert guess.count() == 90 and {"prob_juniper", "prob_pinyon", "prob_ponderosa"} <= set(guess.columns)
    sure = T.confident(guess, "pinyon", 0.5).collect()
    assert sure and all(r.file % 3 == 0 for r in sure)
    with pytest.raises(ValueError):
        T.train(features, labels.filter("Name = 'pinyon'"), names=NAMES)


def test_report_by_hand(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "a"), ("a", "b"), ("b", "b"), ("d", "a")], "t string, p string")
    got = {r["class"]: (r.support, round(r.precision, 4), round(r.recall, 4), round(r.f1, 4)) for r in T.report(rows, "t", "p").collect()}
    assert got == {"a": (3, 0.6667, 0.6667, 0.6667), "b": (1, 0.5, 1.0, 0.6667), "d": (1, 0.0, 0.0, 0.0)}


def test_search_and_vote(tables):
    features, labels = tables
    from crownlake.operators import models as M

    rows = M.labelled(features, labels)
    classes = ["juniper", "pinyon", "ponderosa"]
    best = T.random_search(rows, NAMES, "forest", "Name", "file", classes, {"trees": [3], "depth": [1, 4]}, 2, 2)
    assert best["trees"] == 3
    coded = T.coded(rows, "Name", classes)
    models = [M.fit(coded, NAMES, kind, "y", **p) for kind, p in (("forest", {"trees": 5}), ("logistic", {}))]
    out = T.voted(coded, models, [2, 1], "file")
    assert out.filter("y = prediction").count() > 70
    margins = M.predicted(models[1], coded, "file", "y")
    shares = T.isotonic(margins, "probability", "y", 3).select(F.aggregate("calibrated", F.lit(0.0), lambda a, b: a + b).alias("s")).collect()
    assert all(r.s == pytest.approx(1) for r in shares)


def test_spreading_evaluation(tables):
    features, labels = tables
    spreaded = T.spread(features, labels, names=NAMES)
    assert spreaded.count() == 90 and sum(r.n for r in T.spread_summary(spreaded).collect()) == 90
    out = T.full_evaluation(features, labels, names=NAMES, folds=3)
    assert out["held_out"].count() == 75
    methods = {r.method: r.macro_f1 for r in out["compared"].collect()}
    assert set(methods) == {"forest", "spreading"} and min(methods.values()) > 0.8
    assert [r.share for r in out["degradation"].orderBy(F.desc("share")).collect()] == [1.0, 0.75, 0.5, 0.25, 0.1]
    assert sum(r.n for r in out["reliability"].collect()) == 75


def test_command_line_and_paths():
    args = clustering_parser().parse_args(["--root", "/r", "--trial_name", "t", "--max_radius", "3.5", "--min_points", "12", "--save", "Yes"])
    s = settings_of(args)
    assert (s.max_radius, s.min_points, args.save) == (3.5, 12, True) and LEGACY.smooth_sigma == 1.0
    assert Paths("/r", "t").clusters_csv == "/r/t/clusters.csv"
    with pytest.raises(AttributeError):
        Paths("/r", "t").other
    with pytest.raises(argparse.ArgumentTypeError):
        flag("maybe")


def test_rasters_and_seeds(spark):
    dsm = spark.createDataFrame([(0, 0, 5.0), (0, 1, 1.0), (0, 2, 9.0)], "row int, col int, v double")
    dtm = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0)], "row int, col int, v double")
    assert {(r.col, r.chm) for r in R.chm_from_rasters(dsm, dtm).collect()} == {(0, 4.0), (1, 0.0)}
    peaks = spark.createDataFrame([(1, 0.0, 0.0)], "peak_id int, x double, y double")
    assert R.peak_seeds(peaks, spark.createDataFrame([(1.0,), (3.0,)], "z double")).first().z == 2.0


def test_named_files(spark, tmp_path):
    pts = spark.createDataFrame([(1, 0.0, 0.0, 1.0), (2, 1.0, 1.0, 2.0)], "cluster_id int, x double, y double, z double").withColumns({a: F.lit(None).cast("double") for a in "rgb"})
    names = spark.createDataFrame([(1, "a/b"), (2, "c:d")], "cluster_id int, name string")
    assert ply.save_named(pts, names, str(tmp_path / "n")) == 2
    assert sorted(p.name for p in (tmp_path / "n").glob("*.ply")) == ["a_b.ply", "c_d.ply"]
    with pytest.raises(ValueError):
        ply.save_named(pts, names.filter("cluster_id = 1"), str(tmp_path / "n"))
    near = spark.createDataFrame([(2, "001/cluster_2_0.10m.ply")], "file int, path string")
    assert ply.save_multimatches(pts, near, str(tmp_path / "m")) == 1 and (tmp_path / "m/001/cluster_2_0.10m.ply").exists()
