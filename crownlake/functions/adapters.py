"""Views that turn the test tables into points, clusters, labels and predictions, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cloud of a whole site: x, y, z, r, g, b, cluster_id."""
    c = F.col
    return read(spark, sf_dir, "lineitem").select(
        (c("l_extendedprice") / 1000).alias("x"), ((c("l_partkey") % 2000) / F.lit(20.0)).alias("y"), (c("l_quantity") + 10 * c("l_discount")).alias("z"),
        (10 * c("l_tax")).alias("r"), (10 * c("l_discount")).alias("g"), (c("l_quantity") / 100).alias("b"), c("l_suppkey").alias("cluster_id"),
    )


def cluster_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with ids in clusters: point_id, cluster_id, x, y, z, r, g, b."""
    e = lambda k: F.col("embedding")[k].cast("double")
    place = [(10 * e(k)).alias(n) for k, n in enumerate("xyz")]
    colour = [((e(k + 3) + 1) / 2).alias(n) for k, n in enumerate("rgb")]
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("label").alias("cluster_id"), *place, *colour)


def gps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gps_id, gx, gy."""
    return cluster_points(spark, sf_dir).filter("point_id % 5 = 0").select(F.col("point_id").alias("gps_id"), F.col("x").alias("gx"), F.col("y").alias("gy"))


def centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, x_pos, y_pos."""
    return cluster_points(spark, sf_dir).filter("point_id % 5 <> 0").select(F.col("point_id").alias("file"), F.col("x").alias("x_pos"), F.col("y").alias("y_pos"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, y_true, y_pred, confidence."""
    v, t = F.col("vec_id"), F.col("label") % 3
    return read(spark, sf_dir, "embeddings").select(v.alias("id"), t.alias("y_true"), ((F.col("label") + F.when(v % 4 == 0, 1).otherwise(0)) % 3).alias("y_pred"), ((v % 101) / F.lit(100.0)).alias("confidence"))


#: The same views for an SQL engine whose lists start at 1.
SQL = {
    "v_points": "SELECT l_extendedprice/1000 AS x, (l_partkey % 2000)/20.0::DOUBLE AS y, l_quantity + 10*l_discount AS z, 10*l_tax AS r, 10*l_discount AS g, l_quantity/100 AS b, l_suppkey AS cluster_id FROM lineitem",
    "v_cluster_points": "SELECT vec_id AS point_id, label AS cluster_id, 10*embedding[1]::DOUBLE AS x, 10*embedding[2]::DOUBLE AS y, 10*embedding[3]::DOUBLE AS z, (embedding[4]::DOUBLE+1)/2 AS r, (embedding[5]::DOUBLE+1)/2 AS g, (embedding[6]::DOUBLE+1)/2 AS b FROM embeddings",
    "v_gps": "SELECT point_id AS gps_id, x AS gx, y AS gy FROM v_cluster_points WHERE point_id % 5 = 0",
    "v_centres": "SELECT point_id AS file, x AS x_pos, y AS y_pos FROM v_cluster_points WHERE point_id % 5 <> 0",
    "v_pred": "SELECT vec_id AS id, label % 3 AS y_true, (label + CASE WHEN vec_id % 4 = 0 THEN 1 ELSE 0 END) % 3 AS y_pred, (vec_id % 101)/100.0::DOUBLE AS confidence FROM embeddings",
}


def with_views(sql: str, **more: str) -> str:
    """``sql`` behind the views it uses (given in the order of their needs)."""
    import re

    views = SQL | more
    need: list[str] = []

    def add(text: str) -> None:
        for name in views:
            if re.search(rf"\b{name}\b", text) and name not in need:
                add(views[name])
                if name not in need:
                    need.append(name)

    add(sql)
    if not need:
        return sql
    sql = sql.strip()
    recursive = "RECURSIVE " if sql.upper().startswith("WITH RECURSIVE") or any("UNION" in views[n] and n in views[n] for n in need) else ""
    head = ", ".join(f"{n} AS ({views[n]})" for n in need)
    if sql.upper().startswith("WITH"):
        body = sql[len("WITH RECURSIVE") if sql.upper().startswith("WITH RECURSIVE") else len("WITH") :]
        return f"WITH {recursive}{head}, {body}"
    return f"WITH {recursive}{head} {sql}"
