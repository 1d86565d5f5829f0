"""Operators on point clouds: columns x, y, z and optional r, g, b (all null without colour)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def voxel_downsample(points: DataFrame, size: float = 0.05) -> DataFrame:
    """Mean point and colour of each cubic cell; cells start half a cell below the least coordinates.

    ix, iy, iz, n, then the means. The least coordinates are a one-row aggregate that is broadcast.
    """
    low = points.agg(*(F.min(a).alias(f"_{a}") for a in "xyz"))
    cell = [F.floor((c(a) - (c(f"_{a}") - size / 2)) / size).alias(f"i{a}") for a in "xyz"]
    return points.join(F.broadcast(low)).groupBy(*cell).agg(F.count("*").alias("n"), *(F.avg(a).alias(a) for a in "xyzrgb"))


def green_points(points: DataFrame, threshold: float = 0.01) -> DataFrame:
    """Points whose green exceeds red and blue by more than the threshold; points without colour stay."""
    green = (c("g") > c("r") + threshold) & (c("g") > c("b") + threshold)
    return points.filter(green | (c("r").isNull() & c("g").isNull() & c("b").isNull()))


def normalize_heights(points: DataFrame, resolution: float = 0.5, ground_percentile: float = 5) -> DataFrame:
    """z less the ground percentile of its cell; cells count from the least x and y."""
    low = points.agg(F.min("x").alias("_x"), F.min("y").alias("_y"))
    cells = points.join(F.broadcast(low)).withColumns({"_i": F.floor((c("x") - c("_x")) / resolution), "_j": F.floor((c("y") - c("_y")) / resolution)})
    ground = cells.groupBy("_i", "_j").agg(F.percentile("z", F.lit(ground_percentile / 100)).alias("_ground"))
    return cells.join(ground, ["_i", "_j"]).withColumn("z", c("z") - c("_ground")).drop("_i", "_j", "_x", "_y", "_ground")


def strip_ground(points: DataFrame, ground_percentile: float = 10, min_height: float = 0.5, least: int = 5, cluster: str = "cluster_id") -> DataFrame:
    """Per cluster the points higher than the percentile plus ``min_height``; clusters with fewer than
    ``least`` points before or after go."""
    floor = points.groupBy(cluster).agg(F.percentile("z", F.lit(ground_percentile / 100)).alias("_floor"), F.count("*").alias("_n")).filter(c("_n") >= least)
    kept = points.join(floor.drop("_n"), cluster).filter(c("z") > c("_floor") + min_height).drop("_floor")
    return kept.withColumn("_n", F.count("*").over(Window.partitionBy(cluster))).filter(c("_n") >= least).drop("_n")


def z_range_clusters(points: DataFrame, over: float = 1.5, cluster: str = "cluster_id") -> DataFrame:
    """Points of clusters whose z range is over the limit."""
    keep = points.groupBy(cluster).agg((F.max("z") - F.min("z")).alias("_range")).filter(c("_range") > over)
    return points.join(keep.select(cluster), cluster, "left_semi")


def aabb_clusters(points: DataFrame, min_height: float = 1.0, min_radius: float = 0.3, cluster: str = "cluster_id") -> DataFrame:
    """Points of clusters whose box is high and wide enough (both limits belong to it)."""
    span = lambda a: F.max(a) - F.min(a)
    keep = points.groupBy(cluster).agg(span("z").alias("_h"), (F.greatest(span("x"), span("y")) / 2).alias("_r")).filter((c("_h") >= min_height) & (c("_r") >= min_radius))
    return points.join(keep.select(cluster), cluster, "left_semi")


def green_crowns(points: DataFrame, top_fraction: float = 0.20, min_exg: float = 0.05, cluster: str = "cluster_id") -> DataFrame:
    """cluster, n_points, n_top, mean_exg, green: whether the mean excess green (2g - r - b) of the greenest
    share of points reaches the limit. Fewer than five points: not green; without colour: green.

    Only a cluster's greenest rows are ranked, so ties in the ranking don't change the mean.
    """
    exg = points.withColumn("_exg", 2 * c("g") - c("r") - c("b"))
    w = Window.partitionBy(cluster)
    ranked = exg.withColumn("_n", F.count("*").over(w)).withColumn("_top", F.greatest(F.lit(1), F.floor(c("_n") * top_fraction))).withColumn("_k", F.row_number().over(w.orderBy(F.desc("_exg"))))
    out = ranked.filter(c("_k") <= c("_top")).groupBy(cluster).agg(F.first("_n").alias("n_points"), F.first("_top").alias("n_top"), F.avg("_exg").alias("mean_exg"))
    green = F.when(c("n_points") < 5, False).when(c("mean_exg").isNull(), True).otherwise(c("mean_exg") >= min_exg)
    return out.withColumn("green", green)
