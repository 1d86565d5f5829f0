"""Operators on ground-truth labels: cleaning, matching to clusters, scoring, naming."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import pairs_within

c = F.col
#: Species, substrings that disqualify a name, and a misspelling.
SPECIES, DISQUALIFY, TYPOS = ("pinyon", "juniper", "ponderosa"), ("dead", "point"), {"junioer": "juniper"}
#: Most pairs of labels and clusters that are held as a matrix.
DENSE_PAIRS = 1_000_000


def clean_names(labels: DataFrame, name: str = "Name", *, species: tuple[str, ...] = SPECIES, disqualify: tuple[str, ...] = DISQUALIFY, typos: dict[str, str] | None = None) -> DataFrame:
    """Rows whose name has no disqualifying part, with the first word of the name in lower case; only the
    given species stay. Null names go. Duplicates stay."""
    low = F.lower(c(name))
    bad = F.lit(False)
    for part in disqualify:
        bad = bad | F.contains(low, F.lit(part))
    first = F.element_at(F.split(F.trim(low), r"\s+"), 1)
    for wrong, right in (TYPOS if typos is None else typos).items():
        first = F.replace(first, F.lit(wrong), F.lit(right))
    return labels.filter(~bad).withColumn(name, first).filter(c(name).isin(*species))


def covered(gps: DataFrame, centres: DataFrame, limit: float = 10.0) -> DataFrame:
    """Labels (gps_id, gx, gy) that have a cluster centre (file, x_pos, y_pos) within the limit.

    A centre in the same cell of a diagonal below the limit is near enough; only labels without one are paired with centres.
    """
    cell = lambda x, y: [F.floor(c(v) * (1.5 / limit)).alias(name) for v, name in ((x, "_cx"), (y, "_cy"))]
    finite = lambda x, y: (F.abs(c(x)) < float("inf")) & (F.abs(c(y)) < float("inf"))
    held = centres.filter(finite("x_pos", "y_pos")).select(*cell("x_pos", "y_pos")).distinct()
    own = gps.filter(finite("gx", "gy")).select("gps_id", "gx", "gy", *cell("gx", "gy"))
    alone = own.join(held, ["_cx", "_cy"], "left_anti").select("gps_id", "gx", "gy")
    far = pairs_within(alone, centres, limit, l_xy=("gx", "gy"), r_xy=("x_pos", "y_pos")).select("gps_id")
    near = own.join(held, ["_cx", "_cy"], "left_semi").select("gps_id").unionByName(far).distinct()
    return gps.join(near, "gps_id", "left_semi")


def gaussian_cost(distance: Column, sigma: float) -> Column:
    return 1 - F.exp(-(distance * distance) / (2 * sigma * sigma))


def match_counts(gps: DataFrame, centres: DataFrame, radius: float) -> DataFrame:
    """gps_id, n (clusters within the radius), quality (none, perfect, multiple)."""
    n = pairs_within(gps, centres, radius, l_xy=("gx", "gy"), r_xy=("x_pos", "y_pos")).groupBy("gps_id").agg(F.count("*").alias("n"))
    out = gps.select("gps_id").join(n, "gps_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("quality", F.when(c("n") == 0, "none").when(c("n") == 1, "perfect").otherwise("multiple"))


def matching_score(gps: DataFrame, centres: DataFrame, radius: float = 5.0) -> DataFrame:
    """labels, perfect, none, multiple, score (share of labels with exactly one cluster; null without labels)."""
    of = lambda kind: F.count_if(c("quality") == kind).alias(kind)
    out = match_counts(gps, centres, radius).agg(F.count("*").alias("labels"), of("perfect"), of("none"), of("multiple"))
    return out.withColumn("score", F.try_divide("perfect", "labels"))


def multimatches(gps: DataFrame, centres: DataFrame, radius: float = 3.0) -> DataFrame:
    """gps_id, file, distance, path of each cluster near a label that has two or more of them."""
    near = pairs_within(gps, centres, radius, l_xy=("gx", "gy"), r_xy=("x_pos", "y_pos"))
    several = near.withColumn("_n", F.count("*").over(Window.partitionBy("gps_id"))).filter(c("_n") >= 2)
    return several.select("gps_id", "file", "distance", F.format_string("%03d/cluster_%d_%.2fm.ply", "gps_id", "file", "distance").alias("path"))


def nearest_within(clusters: DataFrame, peaks: DataFrame, limit: float = 3.0) -> DataFrame:
    """Clusters (file, x_pos, y_pos) with a peak (peak_id, px, py) within the limit; all, if there is no peak."""
    near = pairs_within(clusters, peaks, limit, l_xy=("x_pos", "y_pos"), r_xy=("px", "py")).select("file").distinct()
    return clusters if peaks.isEmpty() else clusters.join(near, "file", "left_semi")


def assign(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the least total cost of a rectangular matrix (shortest augmenting paths)."""
    if cost.shape[0] > cost.shape[1]:
        k, r = assign(cost.T)
        order = np.argsort(r)
        return r[order], k[order]
    n, m = cost.shape
    u, v, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        shortest, before, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        i, low, sink, seen = row, 0.0, -1, [row]
        while sink < 0:
            reach = low + cost[i] - u[i] - v
            better = ~done & (reach < shortest)
            shortest[better], before[better] = reach[better], i
            j = int(np.argmin(np.where(done, np.inf, shortest)))
            low = shortest[j]
            done[j] = True
            if owner[j] < 0:
                sink = j
            else:
                i = int(owner[j])
                seen.append(i)
        u[row] += low
        for r in seen[1:]:
            u[r] += low - shortest[np.flatnonzero(owner == r)[0]]
        v[done] += shortest[done] - low
        while sink >= 0:
            i = int(before[sink])
            nxt = np.flatnonzero(owner == i)
            owner[sink] = i
            sink = int(nxt[nxt != sink][0]) if i != row and len(nxt[nxt != sink]) else -1
    cols = np.flatnonzero(owner >= 0)
    order = np.argsort(owner[cols])
    return owner[cols][order], cols[order]


class _Near:
    """Points in square cells, asked for those between two distances."""

    def __init__(self, xy: np.ndarray, cell_points: int = 4):
        self.low, span = xy.min(axis=0), np.ptp(xy, axis=0)
        self.side = float(max(np.sqrt(span[0] * span[1] * cell_points / len(xy)), span.max() / 4096)) or 1.0
        at = self._cell(xy)
        self.wide = int(at[:, 1].max()) + 1
        self.high = int(at[:, 0].max())
        self.order = np.argsort(at[:, 0] * self.wide + at[:, 1], kind="stable")
        self.xy = xy[self.order]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(at[:, 0] * self.wide + at[:, 1], minlength=(self.high + 1) * self.wide))])

    def _cell(self, xy: np.ndarray) -> np.ndarray:
        return np.clip(np.floor((xy - self.low) / self.side), -1, 1 << 40).astype(np.int64)

    def ring(self, p: np.ndarray, beyond: float, to: float) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and distances of the points farther than ``beyond`` and no farther than ``to``."""
        a, b = self._cell(p - to * (1 + 1e-9)), self._cell(p + to * (1 + 1e-9))
        left, right = max(int(a[1]), 0), min(int(b[1]), self.wide - 1)
        rows = range(max(int(a[0]), 0), min(int(b[0]), self.high) + 1) if left <= right else ()
        parts = [np.arange(self.start[r * self.wide + left], self.start[r * self.wide + right + 1]) for r in rows]
        at = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        d = np.hypot(p[0] - self.xy[at, 0], p[1] - self.xy[at, 1])
        keep = (d > beyond) & (d <= to)
        return self.order[at[keep]], d[keep]


def assign_near(rows: np.ndarray, cols: np.ndarray, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the least total Gaussian cost of points, without the matrix of all distances.

    Shortest augmenting paths as in ``assign``, over edges that are made by growing distance: a row's next ring of
    columns is only looked up once a path may be shorter by it, as costs grow with distance and no column's
    potential is above 0. So the total is the optimum over all pairs. A cost that is 1 in double
    precision stands for any pair so far apart; rows that end there take what columns are left, in order.
    """
    if len(rows) > len(cols):
        k, r = assign_near(cols, rows, sigma)
        order = np.argsort(r)
        return r[order], k[order]
    n, m = len(rows), len(cols)
    near = _Near(cols) if m else None
    cost = lambda d: 1 - np.exp(-(d**2) / (2 * sigma**2))
    full = 9.0 * sigma  # cost 1 from here on
    seen = [(np.zeros(0, np.int64), np.zeros(0))] * n  # columns found for a row, and their costs
    reach = np.full(n, -1.0)  # the distance up to which they are all found
    u, v, owner, mate = np.zeros(n), np.zeros(m), np.full(m, -1, np.int64), np.full(n, -1, np.int64)

    def grow(i: int) -> tuple[np.ndarray, np.ndarray]:
        to = min(full, near.side if reach[i] < 0 else 2 * reach[i])
        j, d = near.ring(rows[i], reach[i], to)
        reach[i] = to
        more = j, cost(d)
        seen[i] = tuple(np.concatenate(x) for x in zip(seen[i], more, strict=True))
        return more

    for first in range(n):
        shortest: dict[int, float] = {}
        before: dict[int, int] = {}
        done: dict[int, float] = {}  # columns of the tree, with their distance
        at: dict[int, float] = {first: 0.0}  # rows of the tree, with theirs
        heap: list[tuple[float, int, int]] = []  # distance; 0 a column, 1 a row without a column, 2 a row's next ring
        i, low = first, 0.0

        def relax(i: int, low: float, j: np.ndarray, c: np.ndarray) -> None:
            for k, x in zip(j.tolist(), (low + c - u[i] - v[j]).tolist(), strict=True):
                if k not in done and x < shortest.get(k, np.inf) and x < limit:
                    shortest[k], before[k] = x, i
                    heapq.heappush(heap, (x, 0, k))

        limit = np.inf  # the shortest way known to a free end
        sink = -1
        while True:
            if i >= 0:
                heapq.heappush(heap, (low + 1.0 - u[i], 1, i))
                limit = min(limit, np.nextafter(low + 1.0 - u[i], np.inf))
                relax(i, low, *seen[i])
                if reach[i] < full:
                    heapq.heappush(heap, (low + (float(cost(reach[i])) if reach[i] > 0 else 0.0) - u[i], 2, i))
            low, kind, k = heapq.heappop(heap)
            i = -1
            if kind == 2:
                relax(k, at[k], *grow(k))
                if reach[k] < full:
                    heapq.heappush(heap, (at[k] + float(cost(reach[k])) - u[k], 2, k))
            elif kind == 1:
                end = k
                break
            elif k not in done and low <= shortest[k]:
                done[k] = low
                if owner[k] < 0:
                    sink, end = k, before[k]
                    break
                i = int(owner[k])
                at[i] = low
        for r, x in at.items():
            u[r] += low - x
        for k, x in done.items():
            v[k] -= low - x
        # the path back: each row on it gives up its column to the row before
        j = sink
        while True:
            given = mate[end]
            mate[end] = j
            if j >= 0:
                owner[j] = end
            if end == first:
                break
            j, end = int(given), before[int(given)]
    rest = np.flatnonzero(mate < 0)
    mate[rest] = np.flatnonzero(owner < 0)[: len(rest)]
    return np.arange(n), mate


def match_labels(gps: DataFrame, centres: DataFrame, *, max_distance: float = 3.0, sigma: float = 3.0, coverage: float = 10.0) -> DataFrame:
    """file, gps_id, label_distance: the assignment of labels to clusters with least total Gaussian cost,
    of which pairs no farther apart than ``max_distance`` stay.

    The optimum is global, so the coordinates of all covered labels and all centres meet in one group. Up to DENSE_PAIRS
    pairs are a matrix; beyond it pairs are made as the search asks for them, with the same total.
    """
    both = covered(gps, centres, coverage).select(F.lit(0).alias("side"), c("gps_id").alias("id"), c("gx").alias("x"), c("gy").alias("y"))
    both = both.unionByName(centres.select(F.lit(1).alias("side"), c("file").alias("id"), c("x_pos").alias("x"), c("y_pos").alias("y")))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[np.isfinite(pdf[["x", "y"]].to_numpy(float)).all(axis=1)].sort_values(["side", "id"])
        a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        empty = pd.DataFrame({"file": [], "gps_id": [], "label_distance": []}).astype({"file": "int64", "gps_id": "int64", "label_distance": float})
        if a.empty or b.empty:
            return empty
        p, q = a[["x", "y"]].to_numpy(float), b[["x", "y"]].to_numpy(float)
        if len(p) * len(q) <= DENSE_PAIRS:
            d = np.hypot(p[:, None, 0] - q[None, :, 0], p[:, None, 1] - q[None, :, 1])
            rows, cols = assign(1 - np.exp(-(d**2) / (2 * sigma**2)))
        else:
            rows, cols = assign_near(p, q, sigma)
        d = np.hypot(*(p[rows] - q[cols]).T)
        keep = d <= max_distance
        return pd.DataFrame({"file": b["id"].to_numpy()[cols[keep]], "gps_id": a["id"].to_numpy()[rows[keep]], "label_distance": d[keep]})

    return both.groupBy().applyInPandas(solve, "file long, gps_id long, label_distance double")


def labelled_names(clusters: DataFrame, name: str = "Name", order: str = "file") -> DataFrame:
    """order, file_name: ``species_number`` of clusters with a name other than unknown, counted per species."""
    own = clusters.filter(c(name).isNotNull() & (c(name) != "unknown"))
    k = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    return own.select(order, F.format_string("%s_%d", c(name), k).alias("file_name"))


def safe_name(name: Column) -> Column:
    """The name with characters that file systems refuse replaced."""
    return F.regexp_replace(name, r'[<>:"/\\|?*]', "_")
