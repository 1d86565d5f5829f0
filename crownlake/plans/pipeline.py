"""The two plans of the engine: points to matched clusters, and clusters to labelled ones; and sweeps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import pairs_within
from ..functions.ranks import numbered
from ..operators import clusters as C
from ..operators import labels as L
from ..operators import points as P
from ..operators import raster as R
from .lineage import checkpointed

c = F.col


@dataclass(frozen=True)
class Settings:
    """Values of a run; the defaults are the tuned ones."""

    voxel_size: float = 0.08
    resolution: float = 0.5
    ground_percentile: float = 5
    min_height: float = 0.5
    search_radius: float = 2.5
    smooth_sigma: float = 3.0
    max_radius: float = 4.25
    min_points: int = 40
    min_peak_distance: float = 3.0
    min_z_range: float = 1.5
    max_distance: float = 4.0
    gps_sigma: float = 4.0


def crowns(points: DataFrame, s: Settings) -> DataFrame:
    """Points with ``cluster_id``: each takes the crown of its pixel, if a peak is within the crown radius."""
    chm = checkpointed(R.build_chm(points, s.resolution, s.ground_percentile).select("row", "col", c("chm").alias("v")))
    size = chm.agg(F.max("row").alias("r"), F.max("col").alias("k")).first()
    if size.r is None:
        return points.withColumn("cluster_id", F.lit(None).cast("int")).filter("false")
    peaks = checkpointed(R.find_peaks(chm, size.r + 1, size.k + 1, min_height=s.min_height, search_radius=s.search_radius, resolution=s.resolution, sigma=s.smooth_sigma))
    labels = R.watershed(chm, R.markers(peaks, size.r + 1, size.k + 1), 0.5)
    corner = F.broadcast(R.frame(points).select("x0", "y0"))
    placed = points.join(corner).withColumns({"row": F.floor((c("y0") - c("y")) / s.resolution).cast("int"), "col": F.floor((c("x") - c("x0")) / s.resolution).cast("int")})
    tops = peaks.join(corner).select("peak_id", (c("x0") + (c("col") + 0.5) * s.resolution).alias("px"), (c("y0") - (c("row") + 0.5) * s.resolution).alias("py"))
    near = pairs_within(placed.select("point_id", "x", "y"), tops, s.max_radius, l_xy=("x", "y"), r_xy=("px", "py")).select("point_id").distinct()
    own = placed.join(labels.withColumnRenamed("label", "cluster_id"), ["row", "col"]).join(near, "point_id", "left_semi").drop("row", "col", "x0", "y0")
    big = own.groupBy("cluster_id").count().filter(c("count") >= s.min_points).select("cluster_id")
    return own.join(big, "cluster_id", "left_semi")


def clustering(points: DataFrame, s: Settings | None = None) -> DataFrame:
    """Clusters of a cloud (point_id, x, y, z, r, g, b), as points with ``cluster_id`` from 0 on."""
    s = s or Settings()
    own = crowns(points, s)
    own = P.z_range_clusters(own, s.min_z_range)
    green = P.green_crowns(own).filter("green").select("cluster_id")
    own = P.strip_ground(own.join(green, "cluster_id", "left_semi"))
    own = C.split_large(own, min_points=s.min_points, max_radius=s.max_radius, min_distance=s.min_peak_distance, k=s.min_points)
    own = checkpointed(own)
    parts = numbered(own.select("cluster_id", "part").distinct(), "cluster_id", "part", out="new", start=0)
    own = own.join(parts, ["cluster_id", "part"]).drop("cluster_id", "part").withColumnRenamed("new", "cluster_id")
    return P.aabb_clusters(own)


def featured(points: DataFrame, k: int = 40) -> tuple[DataFrame, DataFrame]:
    """The two frames of a clustering: statistics with the density-weighted centre, and deep features."""
    centre = C.density_centers(points, k).select("cluster_id", F.bround("x", 3).alias("x_pos"), F.bround("y", 3).alias("y_pos"))
    stats = C.cluster_stats(points)
    rounded = {n: F.bround(n, 3) for n in ("height", "width_x", "width_y", "radius", "density")}
    deep = C.engineer(C.deep_features(points))
    return stats.withColumns(rounded).join(centre, "cluster_id").withColumnRenamed("cluster_id", "file"), deep.withColumnRenamed("cluster_id", "file")


def matched(stats: DataFrame, gps: DataFrame, s: Settings | None = None) -> DataFrame:
    """``stats`` with Name (unknown without a label) and label_distance (infinite without one)."""
    s = s or Settings()
    pairs = L.match_labels(gps.select("gps_id", "gx", "gy"), stats.select("file", "x_pos", "y_pos"), max_distance=s.max_distance, sigma=s.gps_sigma)
    named = pairs.join(gps.select("gps_id", "Name"), "gps_id").drop("gps_id")
    return stats.join(named, "file", "left").withColumns({"Name": F.coalesce("Name", F.lit("unknown")), "label_distance": F.coalesce("label_distance", F.lit(float("inf")))})


def sweep(settings: list[dict], run: Callable[[dict], DataFrame]) -> DataFrame:
    """The results of ``run`` for each of the settings, with the settings as columns."""
    out = None
    for one in settings:
        rows = run(one).withColumns({k: F.lit(v) for k, v in one.items()})
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no settings")
    return out
