"""Round trips of the file formats, ragged logs, and a row-wise operator on a stream."""

import numpy as np
import pandas as pd
import pytest

from crownlake.operators import points as P
from crownlake.sources import files, las, ply, tables, tiff


@pytest.fixture
def cloud():
    rng = np.random.default_rng(0)
    return pd.DataFrame({a: rng.uniform(0, 9, 20).round(3) if a in "xyz" else rng.integers(0, 256, 20) / 255 for a in "xyzrgb"})


def test_ply_round_trip(spark, tmp_path, cloud):
    df = spark.createDataFrame(cloud.assign(cluster_id=[k % 3 for k in range(20)]))
    assert ply.save_clusters(df, str(tmp_path / "c")) == 3
    back = ply.read_clusters(spark, str(tmp_path / "c")).toPandas()
    assert sorted(back["cluster_id"].unique()) == [0, 1, 2]
    key = ["x", "y", "z"]
    assert np.allclose(back.sort_values(key)[list("xyzrgb")], cloud.sort_values(key)[list("xyzrgb")])


def test_ply_text_without_colour():
    text = b"ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nend_header\n1 2 3\n4 5 6\n"
    out = ply.decode(text)
    assert out["x"].tolist() == [1, 4] and out["r"].isna().all()
    with pytest.raises(ValueError):
        ply.decode(b"nope\nend_header\n")


def test_las_round_trip(spark, tmp_path, cloud):
    (tmp_path / "a.las").write_bytes(las.encode(cloud))
    (tmp_path / "b.las").write_bytes(las.encode(cloud.iloc[:0]))
    back = las.read(spark, str(tmp_path)).toPandas().sort_values("x")
    assert np.allclose(back[list("xyzrgb")], cloud.sort_values("x")[list("xyzrgb")], atol=6e-4)


def test_tiff_round_trip(spark, tmp_path):
    band = np.arange(12.0).reshape(3, 4)
    band[1, 2] = np.nan
    back, place = tiff.decode(tiff.encode(band, 100.0, 200.0, 0.5))
    assert np.array_equal(back, band, equal_nan=True) and place == (100.0, 200.0, 0.5, 0.5)
    rows = [(r, c, float(band[r, c])) for r in range(3) for c in range(4) if (r, c) != (1, 2)]
    df = spark.createDataFrame(rows, "row int, col int, v double")
    assert tiff.save(df, str(tmp_path), "chm.tif", 3, 4, 100.0, 200.0, 0.5) == 1
    assert {(r.row, r.col, r.v) for r in tiff.read(spark, str(tmp_path)).collect()} == set(rows)


def test_lzw_decode():
    # codes of nine bits: clear, 7, 8, 7, 8 as entry 258, end
    codes = [256, 7, 8, 258, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    bits += "0" * (-len(bits) % 8)
    assert tiff.lzw_decode(int(bits, 2).to_bytes(len(bits) // 8)) == bytes([7, 8, 7, 8])


def test_parameters_and_ragged_log(spark, tmp_path):
    (tmp_path / "p.txt").write_text("# head\n1.0 0.02 4\n\n2.0 0.03 5 # tail\n")
    got = tables.parameters(spark, str(tmp_path / "p.txt"), ["eps", "green", "radius", "none"]).collect()
    assert [tuple(r) for r in got] == [("1.0", "0.02", "4", None), ("2.0", "0.03", "5", None)]
    (tmp_path / "r.csv").write_text("eps,green,score\n1,2,0.5\n\n#-----\n1,2,3,4,0.75\n")
    assert [r.score for r in tables.results_log(spark, str(tmp_path / "r.csv")).collect()] == [0.5, 0.75]
    flags = spark.createDataFrame([("True",), ("0",), (None,)], "f string").select(tables.flag("f").alias("f")).collect()
    assert [r.f for r in flags] == [True, False, None]


def test_csv_and_append(spark, tmp_path):
    df = spark.createDataFrame([("pinyon", -111.0, 35.0)], tables.GPS)
    tables.save_csv(df, str(tmp_path / "g"))
    assert tables.read_csv(spark, str(tmp_path / "g"), tables.GPS).collect() == df.collect()
    for _ in range(2):
        tables.append_results(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    assert files.file_number("file") is not None


def test_row_wise_operator_on_a_stream(spark, tmp_path, cloud):
    spark.createDataFrame(cloud).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("x double, y double, z double, r double, g double, b double").parquet(str(tmp_path / "in"))
    q = P.green_points(stream, 0.01).writeStream.format("memory").queryName("green").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("green").count() == P.green_points(spark.createDataFrame(cloud), 0.01).count()
