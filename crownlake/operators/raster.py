"""Operators on rasters in long form: row (0 is north), col, v; missing pixels have no row."""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.graph import components
from ..functions.ranks import numbered
from ..plans.lineage import checkpointed

c = F.col


def frame(points: DataFrame) -> DataFrame:
    """One row: x0, y0 (the north-west corner) and the south-east one."""
    return points.agg(F.min("x").alias("x0"), F.max("y").alias("y0"), F.max("x").alias("x1"), F.min("y").alias("y1"))


def build_chm(points: DataFrame, resolution: float = 0.5, ground_percentile: float = 5) -> DataFrame:
    """row, col, dsm (highest point), dtm (ground percentile), chm (their difference, 0 at least)."""
    cell = {"row": F.floor((c("y0") - c("y")) / resolution).cast("int"), "col": F.floor((c("x") - c("x0")) / resolution).cast("int")}
    grid = points.join(F.broadcast(frame(points))).withColumns(cell)
    out = grid.groupBy("row", "col").agg(F.max("z").alias("dsm"), F.percentile("z", F.lit(ground_percentile / 100)).alias("dtm"))
    return out.withColumn("chm", F.greatest(c("dsm") - c("dtm"), F.lit(0.0)))


def bilinear(coarse: DataFrame, fine: DataFrame, ratio: float) -> DataFrame:
    """``fine`` pixels (row, col) with ``v`` of the coarse raster (row, col, v) at their centres.

    ``ratio`` is coarse pixel size by fine pixel size, both grids starting at one corner. A pixel is null if
    one of the four coarse pixels around its centre is missing and has weight.
    """
    at = lambda a: (c(a) + 0.5) / ratio - 0.5
    base = fine.select("row", "col", at("row").alias("_r"), at("col").alias("_c")).withColumns({"_r0": F.floor("_r"), "_c0": F.floor("_c")})
    corner = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1))))
    four = base.withColumn("_k", corner).withColumns({"_cr": c("_r0") + c("_k.i"), "_cc": c("_c0") + c("_k.j")})
    share = lambda a, k: F.when(c(k) == 0, 1 - (c(f"_{a}") - c(f"_{a}0"))).otherwise(c(f"_{a}") - c(f"_{a}0"))
    four = four.withColumn("_w", share("r", "_k.i") * share("c", "_k.j")).filter(c("_w") > 0)
    joined = four.join(coarse.select(c("row").alias("_cr"), c("col").alias("_cc"), "v"), ["_cr", "_cc"], "left")
    out = joined.groupBy("row", "col").agg(F.sum(c("_w") * c("v")).alias("v"), F.count("v").alias("_have"), F.count("*").alias("_need"))
    return out.select("row", "col", F.when(c("_have") == c("_need"), c("v")).alias("v"))


def chm_from_dsm(dsm: DataFrame, points: DataFrame, resolution: float, ground_percentile: float = 5, coarse: float = 0.5) -> DataFrame:
    """row, col, chm: a given surface raster (row, col, v) less a ground raster of the points.

    The ground is a percentile raster on a coarser grid, resampled bilinearly to the surface's pixels.
    """
    ground = build_chm(points, coarse, ground_percentile).select("row", "col", c("dtm").alias("v"))
    fine = bilinear(ground, dsm, coarse / resolution).withColumnRenamed("v", "_ground")
    height = F.when(c("_ground").isNotNull(), F.greatest(c("v") - c("_ground"), F.lit(0.0)))
    return dsm.join(fine, ["row", "col"]).select("row", "col", height.alias("chm"))


def chm_from_rasters(dsm: DataFrame, dtm: DataFrame, ratio: float = 1.0) -> DataFrame:
    """row, col, chm: a surface raster less a given ground raster, whose pixels are ``ratio`` times as wide.

    On the same grid (ratio 1) pixels are matched, else the ground is resampled bilinearly.
    """
    ground = dtm.select("row", "col", c("v").alias("_ground")) if ratio == 1.0 else bilinear(dtm, dsm, ratio).withColumnRenamed("v", "_ground")
    return dsm.join(ground, ["row", "col"]).filter(c("_ground").isNotNull()).select("row", "col", F.greatest(c("v") - c("_ground"), F.lit(0.0)).alias("chm"))


def peak_seeds(peaks: DataFrame, points: DataFrame) -> DataFrame:
    """Peaks (peak_id, x, y) with z, the mean height of the points: seeds for a clustering in space."""
    return peaks.join(F.broadcast(points.agg(F.avg("z").alias("z"))))


def gaussian_weights(sigma: float) -> list[tuple[int, float]]:
    """Offsets and weights that sum to 1, out to four sigmas."""
    radius = int(4 * sigma + 0.5)
    raw = [(k, math.exp(-0.5 * (k / sigma) ** 2)) for k in range(-radius, radius + 1)]
    total = sum(w for _, w in raw)
    return [(k, w / total) for k, w in raw]


def gaussian_smooth(raster: DataFrame, n_rows: int, n_cols: int, sigma: float = 1.0) -> DataFrame:
    """``v`` smoothed by rows and then columns; missing pixels count as 0 and stay missing; borders reflect.

    Each pass sends a pixel's weighted value to the pixels it reaches, so a missing pixel costs nothing.
    """
    if not sigma:
        return raster
    kernel = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in gaussian_weights(sigma)))

    def pass_over(df: DataFrame, axis: str, n: int) -> DataFrame:
        other = "col" if axis == "row" else "row"
        # a pixel serves all offsets at which it, or one of its mirror images, lies from the target
        period = 2 * n
        reach = int(4 * sigma + 0.5)
        images = sorted({k for k in range(-reach // period - 1, reach // period + 2)})
        image = F.explode(F.array(*(x for k in images for x in (c(axis) + k * period, F.lit(k * period - 1) - c(axis)))))
        sent = df.withColumn("_from", image).withColumn("_k", F.explode(kernel)).withColumn("_to", c("_from") + c("_k.k"))
        sent = sent.filter((c("_to") >= 0) & (c("_to") < n))
        return sent.groupBy(c("_to").cast("int").alias(axis), other).agg(F.sum(c("v") * c("_k.w")).alias("v"))

    smooth = pass_over(pass_over(raster.select("row", "col", "v"), "row", n_rows), "col", n_cols)
    return raster.select("row", "col").join(smooth, ["row", "col"])


def local_maxima(raster: DataFrame, half: int, min_height: float = 1.5) -> DataFrame:
    """row, col, v of pixels that are the highest of their square window and high enough."""
    down = Window.partitionBy("col").orderBy("row").rangeBetween(-half, half)
    # row-wise maxima also at places without a pixel, as pixels of other rows need them
    reached = F.explode(F.sequence(c("col") - half, c("col") + half))
    windows = raster.select("row", "v", reached.alias("col")).groupBy("row", "col").agg(F.max("v").alias("_line"))
    top = windows.withColumn("_top", F.max("_line").over(down)).select("row", "col", "_top")
    return raster.join(top, ["row", "col"]).filter((c("v") == c("_top")) & (c("v") >= min_height)).select("row", "col", "v")


def plateaus(mask: DataFrame) -> DataFrame:
    """row, col and region (its first pixel's place in row order) of 4-connected pixels."""
    place = c("row").cast("long") * (1 << 31) + c("col")
    nodes = checkpointed(mask.select("row", "col", place.alias("id")).distinct())
    edges = nodes.select("id", F.explode(F.array(*(c("id") + k for k in (1, -1, 1 << 31, -(1 << 31))))).alias("other"))
    edges = checkpointed(edges.join(nodes.select(c("id").alias("other")), "other", "left_semi"))
    labels = components(edges.toDF("a", "b"), nodes.select(c("id").alias("node"))).toDF("id", "region")
    return nodes.join(labels, "id").select("row", "col", "region")


def find_peaks(raster: DataFrame, n_rows: int, n_cols: int, *, min_height: float = 1.5, search_radius: float = 1.5, resolution: float = 0.5, sigma: float = 1.0) -> DataFrame:
    """peak_id, row, col (fractional, of the plateau's centre), height (of the raster there, or null).

    The raster is smoothed, pixels that are highest in their window become peaks, and neighbouring ones
    merge. The window is 2 * ceil(search_radius / resolution) + 1 pixels wide, 3 at least.
    """
    half = max(1, math.ceil(search_radius / resolution))
    regions = plateaus(local_maxima(gaussian_smooth(raster, n_rows, n_cols, sigma), half, min_height))
    centres = regions.groupBy("region").agg(F.avg("row").alias("row"), F.avg("col").alias("col"))
    peaks = numbered(centres, "region", out="peak_id")
    heights = raster.select(c("row").alias("_r"), c("col").alias("_c"), c("v").alias("height"))
    return peaks.withColumns({"_r": c("row").cast("int"), "_c": c("col").cast("int")}).join(heights, ["_r", "_c"], "left").select("peak_id", "row", "col", "height")


def markers(peaks: DataFrame, n_rows: int, n_cols: int) -> DataFrame:
    """row, col, label: peaks (peak_id, row, col) clipped to the raster and grown to 3 by 3 pixels.

    Of peaks on one pixel the last wins, and the highest label where grown ones overlap.
    """
    clip = lambda a, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(a))).cast("int")
    own = peaks.groupBy(clip(c("row"), n_rows).alias("row"), clip(c("col"), n_cols).alias("col")).agg(F.max("peak_id").alias("label"))
    near = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    grown = own.withColumn("_n", near).select((c("row") + c("_n.i")).alias("row"), (c("col") + c("_n.j")).alias("col"), "label")
    return grown.filter((c("row") >= 0) & (c("row") < n_rows) & (c("col") >= 0) & (c("col") < n_cols)).groupBy("row", "col").agg(F.max("label").alias("label"))


def flood(pdf: pd.DataFrame) -> pd.DataFrame:
    """Labels of one connected region (row, col, v, label or null) by priority flood from its markers.

    The highest open pixel goes first, of equal ones the one that was reached first; a pixel takes the
    label from which it is reached.
    """
    height = {(r, k): v for r, k, v in zip(pdf["row"], pdf["col"], pdf["v"], strict=True)}
    label = {(r, k): int(m) for r, k, m in zip(pdf["row"], pdf["col"], pdf["label"], strict=True) if not pd.isna(m)}
    heap, order = [], 0
    for p in sorted(label):
        heapq.heappush(heap, (-height[p], order, p))
        order += 1
    while heap:
        _, _, (r, k) = heapq.heappop(heap)
        for q in ((r - 1, k), (r, k - 1), (r, k + 1), (r + 1, k)):
            if q in height and q not in label:
                label[q] = label[(r, k)]
                heapq.heappush(heap, (-height[q], order, q))
                order += 1
    rows = sorted(label.items())
    return pd.DataFrame({"row": [p[0] for p, _ in rows], "col": [p[1] for p, _ in rows], "label": [v for _, v in rows]}).astype({"row": "int32", "col": "int32", "label": "int32"})


def watershed(chm: DataFrame, marks: DataFrame, min_height: float = 0.5) -> DataFrame:
    """row, col, label: crowns grown from markers over pixels higher than ``min_height``.

    Flooding can't leave a connected region of such pixels, so regions are flooded apart from each other;
    a region is the unit of memory.
    """
    mask = chm.filter(c("v") > min_height)
    parts = mask.join(plateaus(mask), ["row", "col"]).join(marks, ["row", "col"], "left")
    return parts.groupBy("region").applyInPandas(lambda pdf: flood(pdf), "row int, col int, label int")
