"""Operators without an SQL form, against hand-made values, brute force and invariants."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crownlake.functions.geometry import pairs_within, utm
from crownlake.functions.graph import components
from crownlake.operators import clusters as C
from crownlake.operators import labels as L
from crownlake.operators import models as M
from crownlake.operators import points as P
from crownlake.operators import raster as R


def test_watershed_row():
    pdf = pd.DataFrame({"row": 0, "col": range(7), "v": [3, 2, 1, 0.6, 1.5, 2, 4], "label": [1, 1, None, None, None, 2, 2]})
    out = R.flood(pdf)
    assert out.sort_values("col")["label"].tolist() == [1, 1, 1, 2, 2, 2, 2]


def test_gaussian_equals_dense(spark):
    rng = np.random.default_rng(1)
    dense = rng.random((6, 9))
    rows = [(r, c, float(dense[r, c])) for r in range(6) for c in range(9)]
    out = R.gaussian_smooth(spark.createDataFrame(rows, "row int, col int, v double"), 6, 9, 1.0).toPandas()
    w = np.array([x for _, x in R.gaussian_weights(1.0)])
    for axis in (0, 1):
        pad = np.pad(dense, [(4, 4) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        dense = np.apply_along_axis(lambda v: np.convolve(v, w, mode="valid"), axis, pad)
    got = np.zeros((6, 9))
    got[out["row"], out["col"]] = out["v"]
    assert np.allclose(got, dense)


def test_local_maxima_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    pixels = {(int(r), int(c)): float(v) for r, c, v in zip(rng.integers(0, 12, 60), rng.integers(0, 12, 60), rng.integers(1, 9, 60), strict=True)}
    df = spark.createDataFrame([(*k, v) for k, v in pixels.items()], "row int, col int, v double")
    got = {(r.row, r.col) for r in R.local_maxima(df, 2, 1.5).collect()}
    near = lambda a, b: max(abs(a[0] - b[0]), abs(a[1] - b[1])) <= 2
    assert got == {p for p, v in pixels.items() if v >= 1.5 and v == max(w for q, w in pixels.items() if near(p, q))}


def test_watershed_covers_marked_regions(spark):
    chm = spark.createDataFrame([(r, c, float(5 - abs(c - 2))) for r in range(3) for c in range(5)] + [(0, 9, 3.0)], "row int, col int, v double")
    marks = spark.createDataFrame([(1, 2, 7)], "row int, col int, label int")
    out = R.watershed(chm, marks, 0.5).collect()
    assert len(out) == 15 and {r.label for r in out} == {7}


@pytest.mark.parametrize("shape", [(1, 1), (2, 4), (4, 2), (5, 5), (3, 6)])
def test_assignment_is_optimal(shape):
    for seed in range(8):
        cost = np.random.default_rng(seed).integers(0, 6, shape).astype(float)
        rows, cols = L.assign(cost)
        assert len(rows) == min(shape) and len(set(cols)) == len(cols) and len(set(rows)) == len(rows)
        wide = cost if shape[0] <= shape[1] else cost.T
        best = min(sum(wide[i, p[i]] for i in range(len(wide))) for p in itertools.permutations(range(wide.shape[1]), len(wide)))
        assert cost[rows, cols].sum() == pytest.approx(best)


@pytest.mark.parametrize("spread", [0.1, 1.0, 30.0])
def test_assignment_without_a_matrix_is_optimal(spread):
    rng = np.random.default_rng(5)
    for n, m in ((1, 1), (30, 90), (90, 30), (40, 40), (60, 1)):
        p, q = rng.normal(size=(n, 2)) * spread, rng.normal(size=(m, 2)) * spread
        p, q = (np.round(p), np.round(q)) if n == m else (p, q)
        cost = 1 - np.exp(-(np.hypot(p[:, None, 0] - q[None, :, 0], p[:, None, 1] - q[None, :, 1]) ** 2) / 2)
        rows, cols = L.assign_near(p, q, 1.0)
        assert len(rows) == min(n, m) and len(set(cols)) == len(cols) and len(set(rows)) == len(rows)
        assert cost[rows, cols].sum() == pytest.approx(cost[L.assign(cost)].sum())


def test_matching_without_a_matrix_equals_matching_by_one(spark, monkeypatch):
    rng = np.random.default_rng(6)
    gps = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(rng.normal(size=(40, 2)))], "gps_id long, gx double, gy double")
    centres = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(rng.normal(size=(70, 2)))] + [(70, float("nan"), 0.0)], "file long, x_pos double, y_pos double")
    result = lambda: sorted((r.file, r.gps_id, round(r.label_distance, 9)) for r in L.match_labels(gps, centres, max_distance=0.5, sigma=0.5).collect())
    plain = result()
    monkeypatch.setattr(L, "DENSE_PAIRS", 0)
    monkeypatch.setattr(L, "assign", None)
    assert result() == plain and plain


def test_covered_labels_lie_within_the_limit(spark):
    gps = spark.createDataFrame([(1, 0.0, 0.0), (2, 9.0, 0.0), (3, -6.7, -6.7), (4, 30.0, 0.0), (5, float("nan"), 0.0)], "gps_id long, gx double, gy double")
    centres = spark.createDataFrame([(1, -1.0, 0.0)], "file long, x_pos double, y_pos double")
    assert {r.gps_id for r in L.covered(gps, centres, 10.0).collect()} == {1, 2, 3}
    assert {r.gps_id for r in L.covered(gps, centres, 9.9).collect()} == {1, 3}
    assert L.covered(gps, centres.filter("false"), 10.0).count() == 0


def test_matching_is_global(spark):
    gps = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 0.0)], "gps_id long, gx double, gy double")
    centres = spark.createDataFrame([(1, 1.0, 0.0), (2, -4.0, 0.0)], "file long, x_pos double, y_pos double")
    got = {(r.file, r.gps_id, r.label_distance) for r in L.match_labels(gps, centres, max_distance=4.0, sigma=4.0).collect()}
    assert got == {(1, 2, 2.0), (2, 1, 4.0)}
    score = L.matching_score(gps, centres, 4.0).first()
    assert (score.perfect, score.multiple, score.score) == (1, 1, 0.5)
    assert L.matching_score(gps.filter("false"), centres, 4.0).first().score is None


def test_mean_shift_two_blobs():
    rng = np.random.default_rng(0)
    xy = np.vstack([rng.normal(0, 0.2, (40, 2)), rng.normal(6, 0.2, (40, 2))])
    labels = C.mean_shift(xy, 1.5)
    assert len(set(labels[:40])) == 1 and len(set(labels[40:])) == 1 and labels[0] != labels[-1]


def test_split_keeps_and_drops(spark):
    rng = np.random.default_rng(0)
    rows = []
    for k, at in enumerate([(0, 0), (9, 0)]):
        rows += [(int(len(rows) + i), 1, float(x), float(y), float(z)) for i, (x, y, z) in enumerate(np.column_stack([rng.normal(at[0], 0.5, 60), rng.normal(at[1], 0.5, 60), rng.uniform(0, 4, 60)]))]
    rows += [(1000 + i, 2, 0.0, 0.0, 0.0) for i in range(3)]
    df = spark.createDataFrame(rows, "point_id long, cluster_id int, x double, y double, z double")
    out = C.split_large(df, min_points=10, max_radius=2.0, min_distance=3.0, k=20, min_ratio=1.0).groupBy("cluster_id", "part").count().collect()
    assert {r.cluster_id for r in out} == {1} and sorted(r["count"] for r in out) == [60, 60]


def test_cells_equal_theta_join(spark):
    rng = np.random.default_rng(3)
    a = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-3, 3, (80, 2)))], "i long, x double, y double")
    b = a.toDF("j", "u", "v")
    near = {(r.i, r.j) for r in pairs_within(a, b, 0.7, l_xy=("x", "y"), r_xy=("u", "v")).collect()}
    theta = {(r.i, r.j) for r in a.crossJoin(b).filter("sqrt((x-u)*(x-u)+(y-v)*(y-v)) <= 0.7").collect()}
    assert near == theta


def test_components_of_a_path_and_lone_nodes(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(10, 60)] + [(3, 3), (1, 2)], "a long, b long")
    got = {r.node: r.component for r in components(edges, spark.createDataFrame([(99,)], "node long")).collect()}
    assert all(got[k] == 10 for k in range(10, 61)) and got[2] == 1 and got[99] == 99


def test_utm_origin(spark):
    east, north = utm(F.lit(-111.0), F.lit(0.0))
    row = spark.range(1).select(east.alias("e"), north.alias("n")).first()
    assert row.e == pytest.approx(500000) and row.n == pytest.approx(0)


def test_strip_ground_small_and_idempotent_clusters(spark):
    df = spark.createDataFrame([(1, float(z)) for z in range(11)] + [(2, 1.0)], "cluster_id int, z double")
    out = P.strip_ground(df)
    assert sorted(r.z for r in out.collect()) == [float(z) for z in range(2, 11)]
    assert P.strip_ground(df.filter("false")).count() == 0


def test_metrics_by_hand(spark):
    rows = [("a", "a")] * 2 + [("a", "b")] + [("b", "b")] * 3
    q = M.quality(spark.createDataFrame(rows, "t string, p string"), "t", "p").first()
    assert q.macro_f1 == pytest.approx(0.828571, abs=1e-6) and q.kappa == pytest.approx(0.666667, abs=1e-6)


def test_reliability_edges(spark):
    df = spark.createDataFrame([(1, 1, x) for x in (0.0, 0.3, 0.6, 0.7, 1.0)], "t int, p int, s double")
    assert [r.bin for r in M.reliability(df, "t", "p", "s").orderBy("bin").collect()] == [0, 2, 5, 6, 9]


def test_spreading_one_step():
    x, y = np.array([[0.0], [1.0], [3.0]]), np.array([[1.0, 0], [0, 0], [0, 1.0]])
    out = M.spread_step(x, y, y, 0.5, 0.2)
    assert np.allclose(out, [[0.99085, 0.00915], [0.68576, 0.31424], [0.00915, 0.99085]], atol=1e-5)


def test_smote_reaches_its_target(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "a" if i < 6 else "b", *map(float, rng.normal(0, 1, 2))) for i in range(30)]
    out = M.smote(spark.createDataFrame(rows, "id long, y string, f double, g double"), ["f", "g"], "y", "id", {"a": 15})
    assert {r.y: r["count"] for r in out.groupBy("y").count().collect()} == {"a": 15, "b": 24}


def test_whole_plans(spark):
    from crownlake.plans.pipeline import Settings, clustering, featured, matched

    rng = np.random.default_rng(5)
    rows = [(i, float(x), float(y), float(z), 0.1, 0.5, 0.1) for i, (x, y, z) in enumerate(np.column_stack([rng.uniform(0, 20, 500), rng.uniform(0, 20, 500), rng.uniform(0, 0.2, 500)]))]
    for at in ((5, 5), (14, 13)):
        for x, y in rng.normal(0, 1.0, (400, 2)):
            rows.append((len(rows), at[0] + float(x), at[1] + float(y), float(max(0.3, 6 - 1.5 * np.hypot(x, y)) * rng.uniform(0.3, 1)), 0.1, 0.6, 0.1))
    df = spark.createDataFrame(rows, "point_id long, x double, y double, z double, r double, g double, b double")
    own = clustering(df, Settings(resolution=0.5, smooth_sigma=1.0, search_radius=2.0))
    stats, deep = featured(own)
    assert stats.count() == deep.count() >= 2
    gps = spark.createDataFrame([(0, "pinyon", 5.0, 5.0), (1, "juniper", 14.0, 13.0)], "gps_id long, Name string, gx double, gy double")
    names = [r.Name for r in matched(stats, gps).collect()]
    assert names.count("pinyon") == 1 and names.count("juniper") == 1


def test_samples_and_autoencoder(spark):
    from crownlake.operators import autoencoder as A

    rng = np.random.default_rng(0)
    rows = [(i, i % 3, *(float(v) for v in rng.normal(0, 1 + i % 3, 3))) for i in range(60)]
    df = spark.createDataFrame(rows, "point_id long, cluster_id int, x double, y double, z double")
    for n in (7, 32):
        own = C.sample_normalized(df, n).toPandas()
        assert own.groupby("cluster_id").size().tolist() == [n] * 3 and sorted(own["k"].unique()) == list(range(n))
        assert np.sqrt((own[["x", "y", "z"]] ** 2).sum(axis=1)).max() <= 1
    model = A.PointAutoencoder.create(8, 4)
    x = rng.normal(size=(8, 3))
    loss, grads = model.gradients(x)
    for k, at in ((0, (1, 2)), (5, (1,)), (8, (3, 7))):
        model.weights[k][at] += 1e-6
        high, _ = model.gradients(x)
        model.weights[k][at] -= 2e-6
        low, _ = model.gradients(x)
        model.weights[k][at] += 1e-6
        assert (high - low) / 2e-6 == pytest.approx(grads[k][at], rel=1e-3, abs=1e-6)
    model = A.train_autoencoder(df, n=16, dim=8, epochs=15)
    assert model.losses[-1] < model.losses[0]
    again = A.PointAutoencoder.from_bytes(model.to_bytes())
    assert A.embeddings(df, again).count() == 3


def test_numbers_are_places(spark):
    from crownlake.functions.ranks import numbered

    values = [int(v) for v in np.random.default_rng(1).permutation(500)] + [7, 7]
    got = numbered(spark.createDataFrame([(v,) for v in values], "v int").repartition(7), "v", out="n").orderBy("n").collect()
    assert [r.v for r in got] == sorted(values) and [r.n for r in got] == list(range(1, 503))
    assert numbered(spark.createDataFrame([], "v int"), "v", out="n").count() == 0


def _spots(spark, n=90, seed=3):
    """Rows in three classes, with repeated keys, repeated rows, a null label and ties of distance."""
    rng = np.random.default_rng(seed)
    rows = [(i // 2, ["a", "b", "c"][i % 3] if i % 5 else None, *(float(v) for v in rng.integers(0, 5, 2) + 2 * (i % 3))) for i in range(n)]
    return spark.createDataFrame([*rows, *rows[:4]], "id long, y string, f double, g double")


def test_votes_in_blocks_equal_votes_by_broadcast(spark, monkeypatch):
    rows = _spots(spark)
    known = rows.filter("y is not null")
    plain = sorted(M.knn_vote(known, rows, ["f", "g"], "y", "id").collect())
    monkeypatch.setattr(M, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(M, "BLOCK_ROWS", 25)
    assert sorted(M.knn_vote(known, rows, ["f", "g"], "y", "id").collect()) == plain and len(plain) == 94
    assert M.knn_vote(known, rows.limit(0), ["f", "g"], "y", "id").count() == 0


def test_class_neighbours_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_ROWS", 20)
    rows = _spots(spark, 60).dropDuplicates(["id"])
    got = {(r.id, r["rank"]): r.neighbour for r in M.class_neighbours(rows, ["f", "g"], "y", "id", 3).collect()}
    by = {r.id: r for r in rows.collect()}
    want = {}
    for r in by.values():
        near = sorted(((r.f - o.f) ** 2 + (r.g - o.g) ** 2, o.id) for o in by.values() if o.id != r.id and o.y == r.y)
        want |= {(r.id, k + 1): o for k, (_, o) in enumerate(near[:3])}
    assert got == want


def test_spreading_in_blocks_equals_one_matrix(spark, monkeypatch):
    rows = _spots(spark)
    result = lambda: sorted((r.id, r.semi_label, round(r.semi_confidence, 9)) for r in M.label_spreading(rows, ["f", "g"], "y", "id", threshold=0.6).collect())
    plain = result()
    monkeypatch.setattr(M, "DENSE_ROWS", 10)
    monkeypatch.setattr(M, "BLOCK_ROWS", 30)
    assert result() == plain and {p[1] for p in plain} > {"a", "b"}
    assert {r.semi_label for r in M.label_spreading(rows.withColumn("y", F.lit(None).cast("string")), ["f", "g"], "y", "id").collect()} == {"uncertain"}


def test_spreading_in_blocks_takes_any_feature_names(spark, monkeypatch):
    rows = _spots(spark).withColumnsRenamed({"f": "f0", "g": "v1"})
    result = lambda: sorted((r.id, r.semi_label, round(r.semi_confidence, 9)) for r in M.label_spreading(rows, ["f0", "v1"], "y", "id", threshold=0.6).collect())
    plain = result()
    monkeypatch.setattr(M, "DENSE_ROWS", 10)
    monkeypatch.setattr(M, "BLOCK_ROWS", 30)
    assert result() == plain


def test_one_step_of_spreading_in_blocks_equals_one_matrix(spark, monkeypatch):
    rows = _spots(spark)
    result = lambda: sorted((r.id, r.k, round(r.p, 9)) for r in M.spread_once(rows, ["f", "g"], "y", "id", ["a", "b", "c"]).collect())
    plain = result()
    monkeypatch.setattr(M, "DENSE_ROWS", 10)
    monkeypatch.setattr(M, "BLOCK_ROWS", 30)
    assert result() == plain and len(plain) == 3 * 94
