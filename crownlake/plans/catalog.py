"""The registered queries on the test tables, and the same in SQL for comparison.

Floating results are rounded to six places on both sides, as engines add in different orders.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import adapters as A
from ..functions.geometry import pairs_within, pixel_centre, pixel_of, utm
from ..functions.ranks import numbered
from ..operators import clusters as C
from ..operators import labels as L
from ..operators import models as M
from ..operators import points as P
from ..operators import raster as R
from ..operators import reports as Q

Query = Callable[[SparkSession, str], DataFrame]
c = F.col

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Side of the test raster, in metres and pixels: the view of points spans 0.9 to 105 by 0 to 100.
N_ROWS, N_COLS = 101, 106


def r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def query(sql: str | None = None, **views: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = A.with_views(sql, **(VIEWS | views))
        return f

    return add


VIEWS = {
    "v_frame": "SELECT min(x) AS x0, max(y) AS y0 FROM v_points",
    "v_chm": 'SELECT floor((y0 - y)/1.0)::INT AS "row", floor((x - x0)/1.0)::INT AS col, max(z) AS dsm, quantile_cont(z, 0.05) AS dtm, greatest(max(z) - quantile_cont(z, 0.05), 0) AS chm FROM v_points, v_frame GROUP BY 1, 2',
    "v_stats": "SELECT cluster_id, count(*) AS n_points, max(z)-min(z) AS height, max(x)-min(x) AS width_x, max(y)-min(y) AS width_y, greatest(max(x)-min(x), max(y)-min(y))/2 AS radius FROM v_points GROUP BY 1",
    "v_engineered": "SELECT cluster_id, height/(radius+1e-6) AS height_to_radius, mean_g-(mean_r+mean_b)/2 AS green_dominance, radius*radius*height AS crown_volume, std_r+std_g+std_b AS color_saturation, n_points, height, radius FROM v_stats JOIN (SELECT cluster_id, avg(r) AS mean_r, avg(g) AS mean_g, avg(b) AS mean_b, stddev_pop(r) AS std_r, stddev_pop(g) AS std_g, stddev_pop(b) AS std_b FROM v_points GROUP BY 1) USING (cluster_id)",
    "v_near": "SELECT g.gps_id, t.file, sqrt((gx-x_pos)*(gx-x_pos)+(gy-y_pos)*(gy-y_pos)) AS distance FROM v_gps g, v_centres t WHERE sqrt((gx-x_pos)*(gx-x_pos)+(gy-y_pos)*(gy-y_pos)) <= 0.15",
    "v_counts": "SELECT g.gps_id, count(file) AS n FROM v_gps g LEFT JOIN v_near USING (gps_id) GROUP BY 1",
    "v_knn": "SELECT a.cluster_id, a.point_id, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS d, row_number() OVER (PARTITION BY a.point_id ORDER BY sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)), b.point_id) AS k, b.point_id AS other FROM v_cluster_points a JOIN v_cluster_points b USING (cluster_id) WHERE a.point_id <> b.point_id",
}


# ---- points ---------------------------------------------------------------------------------------


@query("SELECT floor((x-(x0-0.5))/1.0)::BIGINT AS ix, floor((y-(y0-0.5))/1.0)::BIGINT AS iy, floor((z-(z0-0.5))/1.0)::BIGINT AS iz, count(*) AS n, round(avg(x),6) AS x, round(avg(y),6) AS y, round(avg(z),6) AS z, round(avg(r),6) AS r, round(avg(g),6) AS g, round(avg(b),6) AS b FROM v_points, (SELECT min(x) AS x0, min(y) AS y0, min(z) AS z0 FROM v_points) GROUP BY 1,2,3")
def voxel_downsample(spark, sf_dir):
    return r6(P.voxel_downsample(A.points(spark, sf_dir), 1.0), *"xyzrgb")


@query("SELECT round(x,6) AS x, round(y,6) AS y, round(z,6) AS z, cluster_id FROM v_points WHERE g > r + 0.025 AND g > b + 0.025")
def green_point_filter(spark, sf_dir):
    return r6(P.green_points(A.points(spark, sf_dir), 0.025).select(*"xyz", "cluster_id"), *"xyz")


@query("SELECT round(x,6) AS x, round(y,6) AS y, round(z - quantile_cont(z, 0.05) OVER (PARTITION BY floor((x-x0)/5.0), floor((y-y0)/5.0)), 6) AS z FROM v_points, (SELECT min(x) AS x0, min(y) AS y0 FROM v_points)")
def normalize_heights(spark, sf_dir):
    return r6(P.normalize_heights(A.points(spark, sf_dir), 5.0).select(*"xyz"), *"xyz")


@query("SELECT cluster_id, count(*) AS n, round(min(z),6) AS low FROM (SELECT cluster_id, z, quantile_cont(z, 0.1) OVER (PARTITION BY cluster_id) AS f, count(*) OVER (PARTITION BY cluster_id) AS k FROM v_points) WHERE k >= 5 AND z > f + 0.5 GROUP BY 1 HAVING count(*) >= 5")
def strip_ground(spark, sf_dir):
    return r6(P.strip_ground(A.points(spark, sf_dir)).groupBy("cluster_id").agg(F.count("*").alias("n"), F.min("z").alias("low")), "low")


@query("SELECT cluster_id, count(*) AS n FROM v_points GROUP BY 1 HAVING max(z) - min(z) > 48.8")
def cluster_z_range(spark, sf_dir):
    return P.z_range_clusters(A.points(spark, sf_dir), 48.8).groupBy("cluster_id").agg(F.count("*").alias("n"))


@query("SELECT cluster_id, count(*) AS n FROM v_points GROUP BY 1 HAVING max(z) - min(z) >= 48.8 AND greatest(max(x)-min(x), max(y)-min(y))/2 >= 50")
def aabb_filter(spark, sf_dir):
    return P.aabb_clusters(A.points(spark, sf_dir), 48.8, 50.0).groupBy("cluster_id").agg(F.count("*").alias("n"))


@query("SELECT cluster_id, n_points, n_top, round(m,6) AS mean_exg, CASE WHEN n_points < 5 THEN false ELSE m >= 0.9 END AS green FROM (SELECT cluster_id, any_value(n) AS n_points, any_value(t) AS n_top, avg(exg) AS m FROM (SELECT *, greatest(1, floor(n*0.2))::BIGINT AS t FROM (SELECT cluster_id, 2*g-r-b AS exg, count(*) OVER (PARTITION BY cluster_id) AS n, row_number() OVER (PARTITION BY cluster_id ORDER BY 2*g-r-b DESC) AS k FROM v_points)) WHERE k <= t GROUP BY 1)")
def green_crown(spark, sf_dir):
    return r6(P.green_crowns(A.points(spark, sf_dir), 0.20, 0.9), "mean_exg")


# ---- rasters --------------------------------------------------------------------------------------


def _chm(spark, sf_dir) -> DataFrame:
    return R.build_chm(A.points(spark, sf_dir), 1.0)


@query('SELECT "row", col, round(dsm,6) AS dsm, round(dtm,6) AS dtm, round(chm,6) AS chm FROM v_chm')
def chm_grid(spark, sf_dir):
    return r6(_chm(spark, sf_dir), "dsm", "dtm", "chm")


_LERP = """
WITH coarse AS (SELECT floor((y0-y)/4.0)::INT AS cr, floor((x-x0)/4.0)::INT AS cc, quantile_cont(z, 0.05) AS v FROM v_points, v_frame GROUP BY 1, 2),
f AS (SELECT "row", col, dsm, ("row"+0.5::DOUBLE)/4.0::DOUBLE-0.5::DOUBLE AS r, (col+0.5::DOUBLE)/4.0::DOUBLE-0.5::DOUBLE AS k FROM v_chm),
w AS (SELECT "row", col, dsm, floor(r)::INT + i AS cr, floor(k)::INT + j AS cc, (CASE WHEN i=0 THEN 1-(r-floor(r)) ELSE r-floor(r) END)*(CASE WHEN j=0 THEN 1-(k-floor(k)) ELSE k-floor(k) END) AS w FROM f, (VALUES (0),(1)) a(i), (VALUES (0),(1)) b(j))
"""


@query(_LERP + 'SELECT "row", col, CASE WHEN count(v) = count(*) THEN round(greatest(any_value(dsm) - sum(w*v), 0) + 1e-7, 5) END AS chm FROM w LEFT JOIN coarse USING (cr, cc) WHERE w > 0 GROUP BY 1, 2')
def coarse_dtm_bilinear(spark, sf_dir):
    surface = _chm(spark, sf_dir).select("row", "col", c("dsm").alias("v"))
    out = R.chm_from_dsm(surface, A.points(spark, sf_dir), 1.0, 5, 4.0)
    return out.select("row", "col", F.round(c("chm") + 1e-7, 5).alias("chm"))  # off the ties that quarters make


_KERNEL = ", ".join(f"({k}, {w!r}::DOUBLE)" for k, w in R.gaussian_weights(1.0))
_SMOOTH = f"""
kernel(k, w) AS (VALUES {_KERNEL}),
src AS (SELECT "row", col, chm AS v FROM v_chm),
flip AS (SELECT col, v, unnest([{", ".join(f'"row" + {2 * N_ROWS * i}, {2 * N_ROWS * i - 1} - "row"' for i in (-1, 0, 1))}]) AS s FROM src),
rows_done AS (SELECT s + k AS "row", col, sum(v*w) AS v FROM flip, kernel WHERE s + k BETWEEN 0 AND {N_ROWS - 1} GROUP BY 1, 2),
flop AS (SELECT "row", v, unnest([{", ".join(f"col + {2 * N_COLS * i}, {2 * N_COLS * i - 1} - col" for i in (-1, 0, 1))}]) AS s FROM rows_done),
both_done AS (SELECT "row", s + k AS col, sum(v*w) AS v FROM flop, kernel WHERE s + k BETWEEN 0 AND {N_COLS - 1} GROUP BY 1, 2)
"""


@query(f'WITH {_SMOOTH} SELECT "row", col, round(b.v, 6) AS v FROM src JOIN both_done b USING ("row", col)')
def gaussian_smooth(spark, sf_dir):
    return r6(R.gaussian_smooth(_chm(spark, sf_dir).select("row", "col", c("chm").alias("v")), N_ROWS, N_COLS, 1.0), "v")


_TOPS = 'SELECT "row", col, chm AS v FROM (SELECT a."row", a.col, a.chm, max(b.chm) AS top FROM v_chm a JOIN v_chm b ON b."row" BETWEEN a."row"-{h} AND a."row"+{h} AND b.col BETWEEN a.col-{h} AND a.col+{h} GROUP BY 1,2,3) WHERE chm = top AND chm >= 1'


@query('SELECT "row", col, round(v,6) AS v FROM (' + _TOPS.format(h=3) + ")")
def local_max_peaks(spark, sf_dir):
    return r6(R.local_maxima(_chm(spark, sf_dir).select("row", "col", c("chm").alias("v")), 3, 1.0), "v")


@query(
    "WITH RECURSIVE mask AS (SELECT \"row\", col FROM v_chm WHERE chm >= 44), reach AS (SELECT \"row\", col, \"row\"::BIGINT*2147483648+col AS region FROM mask UNION SELECT m.\"row\", m.col, r.region FROM reach r JOIN mask m ON abs(m.\"row\"-r.\"row\")+abs(m.col-r.col) = 1), best AS (SELECT \"row\", col, min(region) AS region FROM reach GROUP BY 1, 2) SELECT region, count(*) AS n, round(avg(\"row\"),6) AS \"row\", round(avg(col),6) AS col FROM best GROUP BY 1"
)
def plateau_centroids(spark, sf_dir):
    regions = R.plateaus(_chm(spark, sf_dir).filter("chm >= 44"))
    return r6(regions.groupBy("region").agg(F.count("*").alias("n"), F.avg("row").alias("row"), F.avg("col").alias("col")), "row", "col")


@query('SELECT "row", col, round(x0 + (col + 0.5)*1.0, 6) AS x, round(y0 - ("row" + 0.5)*1.0, 6) AS y, "row"::BIGINT AS back_row, col::BIGINT AS back_col FROM v_chm, v_frame')
def pixel_xy_roundtrip(spark, sf_dir):
    grid = _chm(spark, sf_dir).select("row", "col").join(F.broadcast(R.frame(A.points(spark, sf_dir)).select("x0", "y0")))
    x, y = pixel_centre(c("row"), c("col"), c("x0"), c("y0"), 1.0)
    row, col = pixel_of(c("x"), c("y"), c("x0"), c("y0"), 1.0)
    return r6(grid.withColumns({"x": x, "y": y}).withColumns({"back_row": row, "back_col": col}).drop("x0", "y0"), "x", "y")


@query('WITH p AS (SELECT row_number() OVER (ORDER BY "row", col)::INT AS peak_id, "row", col FROM (' + _TOPS.format(h=3) + f')), grown AS (SELECT "row"+i AS "row", col+j AS col, max(peak_id) AS label FROM p, (VALUES (-1),(0),(1)) a(i), (VALUES (-1),(0),(1)) b(j) GROUP BY 1, 2) SELECT * FROM grown WHERE "row" BETWEEN 0 AND {N_ROWS - 1} AND col BETWEEN 0 AND {N_COLS - 1}')
def marker_dilation(spark, sf_dir):
    return R.markers(_peaks(spark, sf_dir), N_ROWS, N_COLS)


def _peaks(spark, sf_dir) -> DataFrame:
    return numbered(R.local_maxima(_chm(spark, sf_dir).select("row", "col", c("chm").alias("v")), 3, 1.0), "row", "col", out="peak_id")


@query()
def find_chm_peaks(spark, sf_dir):
    return r6(R.find_peaks(_chm(spark, sf_dir).select("row", "col", c("chm").alias("v")), N_ROWS, N_COLS, resolution=1.0, sigma=1.0), "row", "col", "height")


@query()
def watershed_crowns(spark, sf_dir):
    chm = _chm(spark, sf_dir).select("row", "col", c("chm").alias("v"))
    return R.watershed(chm, R.markers(_peaks(spark, sf_dir), N_ROWS, N_COLS), 30.0)


# ---- clusters -------------------------------------------------------------------------------------


@query("SELECT cluster_id, n_points, round(height,6) AS height, round(width_x,6) AS width_x, round(width_y,6) AS width_y, round(radius,6) AS radius, round(CASE WHEN height*width_x*width_y > 0 THEN n_points/(height*width_x*width_y) ELSE 0 END, 6) AS density FROM v_stats")
def cluster_stats(spark, sf_dir):
    return r6(C.cluster_stats(A.points(spark, sf_dir)), "height", "width_x", "width_y", "radius", "density")


@query("WITH d AS (SELECT cluster_id, point_id, 1/(avg(d)+1e-6) AS w FROM v_knn WHERE k <= 9 GROUP BY 1, 2) SELECT p.cluster_id, round(sum(w*x)/sum(w),6) AS x, round(sum(w*y)/sum(w),6) AS y, round(sum(w*z)/sum(w),6) AS z FROM v_cluster_points p JOIN d USING (point_id) GROUP BY 1")
def density_center(spark, sf_dir):
    return r6(C.density_centers(A.cluster_points(spark, sf_dir), 10), *"xyz")


@query("WITH d AS (SELECT cluster_id, point_id, 1/(avg(d)+1e-6) AS density FROM v_knn WHERE k <= 9 GROUP BY 1, 2), m AS (SELECT cluster_id, avg(density) AS mean FROM d GROUP BY 1), t AS (SELECT a.point_id, max(b.density) AS top FROM v_knn a JOIN d b ON b.point_id = a.other WHERE a.k <= 9 GROUP BY 1) SELECT d.cluster_id, d.point_id, round(density, 6) AS density FROM d JOIN m USING (cluster_id) JOIN t USING (point_id) WHERE density >= top AND density > mean*1.1")
def density_peak_candidates(spark, sf_dir):
    return r6(C.density_peaks(A.cluster_points(spark, sf_dir), 10, 3.0, 1.1, suppress=False), "density")


@query("""
WITH v AS (SELECT cluster_id, covar_samp(x,x) AS xx, covar_samp(y,y) AS yy, covar_samp(z,z) AS zz, covar_samp(x,y) AS xy, covar_samp(x,z) AS xz, covar_samp(y,z) AS yz FROM v_cluster_points GROUP BY 1),
q AS (SELECT *, (xx+yy+zz)/3 AS q FROM v),
p AS (SELECT *, sqrt(((xx-q)*(xx-q)+(yy-q)*(yy-q)+(zz-q)*(zz-q)+2*(xy*xy+xz*xz+yz*yz))/6) AS p FROM q),
t AS (SELECT *, acos(greatest(-1, least(1, ((xx-q)*((yy-q)*(zz-q)-yz*yz)-xy*(xy*(zz-q)-yz*xz)+xz*(xy*yz-(yy-q)*xz))/(2*p*p*p))))/3 AS phi FROM p),
e AS (SELECT cluster_id, q+2*p*cos(phi) AS e1, q+2*p*cos(phi+2*pi()/3) AS e3, q FROM t)
SELECT cluster_id, round(e1,6) AS eigenvalue_1, round(3*q-e1-e3,6) AS eigenvalue_2, round(e3,6) AS eigenvalue_3, round((e1-(3*q-e1-e3))/(e1+1e-6),6) AS linearity, round(((3*q-e1-e3)-e3)/(e1+1e-6),6) AS planarity, round(e3/(e1+1e-6),6) AS sphericity FROM e
""")
def pca_shape(spark, sf_dir):
    return r6(C.shape_features(A.cluster_points(spark, sf_dir)), "eigenvalue_1", "eigenvalue_2", "eigenvalue_3", "linearity", "planarity", "sphericity")


@query("WITH e AS (SELECT cluster_id, min(z) AS lo, max(z) AS hi FROM v_points GROUP BY 1), n AS (SELECT cluster_id, any_value((hi-lo+1e-6)/3) AS t, count(*) FILTER (z < lo+(hi-lo+1e-6)/3) AS nl, count(*) FILTER (z > hi-(hi-lo+1e-6)/3) AS nu FROM v_points JOIN e USING (cluster_id) GROUP BY 1) SELECT cluster_id, round((nu/(t+1e-6))/(nl/(t+1e-6)+1e-6),6) AS crown_base_ratio FROM n")
def crown_base_ratio(spark, sf_dir):
    return r6(C.crown_base_ratio(A.points(spark, sf_dir)), "crown_base_ratio")


@query("SELECT cluster_id, round(height_to_radius,6) AS height_to_radius, round(green_dominance,6) AS green_dominance, round(crown_volume,6) AS crown_volume, round(color_saturation,6) AS color_saturation FROM v_engineered")
def engineered(spark, sf_dir):
    names = ["height_to_radius", "green_dominance", "crown_volume", "color_saturation"]
    return r6(_engineered(spark, sf_dir).select("cluster_id", *names), *names)


def _engineered(spark, sf_dir) -> DataFrame:
    pts = A.points(spark, sf_dir)
    return C.engineer(C.cluster_stats(pts).join(C.colour_features(pts), "cluster_id"))


@query()
def deep_features(spark, sf_dir):
    out = C.engineer(C.deep_features(A.cluster_points(spark, sf_dir)))
    return r6(out, *(n for n, t in out.dtypes if t == "double"))


@query(
    "WITH RECURSIVE near AS (SELECT a.point_id, b.point_id AS other FROM v_cluster_points a JOIN v_cluster_points b ON sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) <= 0.9), cores AS (SELECT point_id FROM near GROUP BY 1 HAVING count(*) >= 4), reach AS (SELECT point_id, point_id AS root FROM cores UNION SELECT n.other, r.root FROM reach r JOIN near n USING (point_id) JOIN cores k ON k.point_id = n.other), core_root AS (SELECT point_id, min(root) AS root FROM reach GROUP BY 1), numbers AS (SELECT root, (dense_rank() OVER (ORDER BY root) - 1)::INT AS label FROM (SELECT DISTINCT root FROM core_root)), border AS (SELECT n.point_id, min(root) AS root FROM near n JOIN core_root k ON k.point_id = n.other WHERE n.point_id NOT IN (SELECT point_id FROM cores) GROUP BY 1) SELECT p.point_id, coalesce(label, -1) AS label FROM v_cluster_points p LEFT JOIN (SELECT * FROM core_root UNION ALL SELECT * FROM border) USING (point_id) LEFT JOIN numbers USING (root)"
)
def dbscan(spark, sf_dir):
    return C.dbscan(A.cluster_points(spark, sf_dir), 0.9, 4)


@query()
def mean_shift_split(spark, sf_dir):
    out = C.split_large(A.cluster_points(spark, sf_dir), min_points=5, max_radius=1.0, min_distance=1.5, k=10, min_ratio=1.0)
    return out.groupBy("cluster_id", "part").agg(F.count("*").alias("n"))


@query("WITH m AS (SELECT cluster_id, point_id, x-avg(x) OVER w AS x, y-avg(y) OVER w AS y, z-avg(z) OVER w AS z FROM v_cluster_points WINDOW w AS (PARTITION BY cluster_id)) SELECT cluster_id, count(*) AS n, round(max(sqrt(x*x+y*y+z*z))/(max(sqrt(x*x+y*y+z*z))+1e-6),6) AS top FROM m GROUP BY 1")
def normalize_points(spark, sf_dir):
    pts = A.cluster_points(spark, sf_dir)
    most = pts.groupBy("cluster_id").count().agg(F.max("count")).first()[0] or 1
    whole = C.sample_normalized(pts, most).join(pts.groupBy("cluster_id").agg(F.count("*").alias("n")), "cluster_id").filter("k < n")
    return r6(whole.groupBy("cluster_id").agg(F.count("*").alias("n"), F.max(F.sqrt(c("x") * c("x") + c("y") * c("y") + c("z") * c("z"))).alias("top")), "top")


@query("WITH p AS (SELECT cluster_id, point_id % 2 AS s, point_id AS k, x, y, z FROM v_cluster_points), d AS (SELECT a.cluster_id, a.k, b.k AS o, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) AS d FROM p a JOIN p b ON a.cluster_id = b.cluster_id AND a.s = 0 AND b.s = 1), t AS (SELECT cluster_id, avg(m) AS t FROM (SELECT cluster_id, k, min(d) AS m FROM d GROUP BY 1, 2) GROUP BY 1), u AS (SELECT cluster_id, avg(m) AS u FROM (SELECT cluster_id, o, min(d) AS m FROM d GROUP BY 1, 2) GROUP BY 1) SELECT cluster_id, round(t+u,6) AS chamfer FROM t JOIN u USING (cluster_id)")
def chamfer_pairs(spark, sf_dir):
    pts = A.cluster_points(spark, sf_dir).withColumn("k", c("point_id"))
    return r6(C.chamfer(pts.filter("point_id % 2 = 0"), pts.filter("point_id % 2 = 1"), "cluster_id"), "chamfer")


# ---- labels ---------------------------------------------------------------------------------------


@query("SELECT p_partkey AS id, CASE WHEN f = 'hot' THEN 'cold' ELSE f END AS name FROM (SELECT p_partkey, split_part(trim(lower(p_name)), ' ', 1) AS f, lower(p_name) AS low FROM part) WHERE low NOT LIKE '%old%' AND (CASE WHEN f = 'hot' THEN 'cold' ELSE f END) IN ('red', 'blue', 'cold')")
def gps_clean(spark, sf_dir):
    parts = A.read(spark, sf_dir, "part").select(c("p_partkey").alias("id"), c("p_name").alias("name"))
    return L.clean_names(parts, "name", species=("red", "blue", "cold"), disqualify=("old",), typos={"hot": "cold"})


def _utm_sql() -> str:
    n = (1 / 298.257223563) / (2 - 1 / 298.257223563)
    radius = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    k = 2 * math.sqrt(n) / (1 + n)
    east = "eta" + "".join(f" + {a!r}::DOUBLE*cos({2 * j}*xi)*sinh({2 * j}*eta)" for j, a in enumerate(alpha, 1))
    north = "xi" + "".join(f" + {a!r}::DOUBLE*sin({2 * j}*xi)*cosh({2 * j}*eta)" for j, a in enumerate(alpha, 1))
    return f"WITH g AS (SELECT point_id AS id, radians(35.3+y/100) AS phi, radians(x/100) AS lam FROM v_cluster_points), t AS (SELECT id, lam, sinh(atanh(sin(phi)) - {k!r}::DOUBLE*atanh({k!r}::DOUBLE*sin(phi))) AS t FROM g), e AS (SELECT id, atan2(t, cos(lam)) AS xi, atanh(sin(lam)/sqrt(1+t*t)) AS eta FROM t) SELECT id, round(500000 + {0.9996 * radius!r}::DOUBLE*({east}), 3) AS easting, round({0.9996 * radius!r}::DOUBLE*({north}), 3) AS northing FROM e"


@query(_utm_sql())
def latlon_to_utm(spark, sf_dir):
    pts = A.cluster_points(spark, sf_dir).select(c("point_id").alias("id"), (c("x") / 100 - 111).alias("lon"), (F.lit(35.3) + c("y") / 100).alias("lat"))
    east, north = utm(c("lon"), c("lat"))
    return pts.select("id", F.round(east, 3).alias("easting"), F.round(north, 3).alias("northing"))


@query("SELECT DISTINCT gps_id FROM v_near")
def coverage_filter(spark, sf_dir):
    return L.covered(A.gps(spark, sf_dir), A.centres(spark, sf_dir), 0.15).select("gps_id")


@query("SELECT gps_id, file, round(1-exp(-(distance*distance)/(2*0.1*0.1)),6) AS cost FROM v_near")
def gaussian_cost(spark, sf_dir):
    near = pairs_within(A.gps(spark, sf_dir), A.centres(spark, sf_dir), 0.15, l_xy=("gx", "gy"), r_xy=("x_pos", "y_pos"))
    return near.select("gps_id", "file", F.round(L.gaussian_cost(c("distance"), 0.1), 6).alias("cost"))


@query("SELECT count(*) AS labels, count(*) FILTER (n = 1) AS perfect, count(*) FILTER (n = 0) AS none, count(*) FILTER (n > 1) AS multiple, round(count(*) FILTER (n = 1)/count(*), 6) AS score FROM v_counts")
def matching_score(spark, sf_dir):
    return r6(L.matching_score(A.gps(spark, sf_dir), A.centres(spark, sf_dir), 0.15), "score")


@query("SELECT gps_id, n, CASE n WHEN 0 THEN 'none' WHEN 1 THEN 'perfect' ELSE 'multiple' END AS quality FROM v_counts")
def match_quality(spark, sf_dir):
    return L.match_counts(A.gps(spark, sf_dir), A.centres(spark, sf_dir), 0.15)


@query("SELECT gps_id, file, round(distance,6) AS distance, printf('%03d/cluster_%d_%.2fm.ply', gps_id, file, distance) AS path FROM v_near JOIN v_counts USING (gps_id) WHERE n >= 2")
def multimatch(spark, sf_dir):
    return r6(L.multimatches(A.gps(spark, sf_dir), A.centres(spark, sf_dir), 0.15), "distance")


@query("SELECT DISTINCT file FROM v_near")
def nearest_peak_filter(spark, sf_dir):
    peaks = A.gps(spark, sf_dir).toDF("peak_id", "px", "py")
    return L.nearest_within(A.centres(spark, sf_dir), peaks, 0.15).select("file")


@query()
def hungarian(spark, sf_dir):
    return r6(L.match_labels(A.gps(spark, sf_dir), A.centres(spark, sf_dir), max_distance=0.5, sigma=0.5), "label_distance")


@query("SELECT p_partkey AS file, f || '_' || (row_number() OVER (PARTITION BY f ORDER BY p_partkey) - 1) AS file_name FROM (SELECT p_partkey, split_part(p_name, ' ', 1) AS f FROM part) WHERE f <> 'old'")
def labeled_filenames(spark, sf_dir):
    first = F.split_part(c("p_name"), F.lit(" "), F.lit(1))
    rows = A.read(spark, sf_dir, "part").select(c("p_partkey").alias("file"), F.when(first == "old", "unknown").otherwise(first).alias("Name"))
    return L.labelled_names(rows)


@query("SELECT doc_id, regexp_replace(text, '[<>:\"/\\\\|?*]', '_', 'g') AS name FROM documents")
def safe_filenames(spark, sf_dir):
    return A.read(spark, sf_dir, "documents").select("doc_id", L.safe_name(F.col("text")).alias("name"))


@query("SELECT radius, count(*) FILTER (n = 1) AS perfect, round(count(*) FILTER (n = 1)/count(*), 6) AS score FROM (SELECT radius, g.gps_id, count(t.file) AS n FROM (VALUES (0.10::DOUBLE), (0.15::DOUBLE)) r(radius) CROSS JOIN v_gps g LEFT JOIN v_centres t ON sqrt((gx-x_pos)*(gx-x_pos)+(gy-y_pos)*(gy-y_pos)) <= radius GROUP BY 1, 2) GROUP BY 1")
def sweep_scores(spark, sf_dir):
    from .pipeline import sweep

    run = lambda p: L.matching_score(A.gps(spark, sf_dir), A.centres(spark, sf_dir), p["radius"])
    return r6(sweep([{"radius": 0.10}, {"radius": 0.15}], run).select("radius", "perfect", "score"), "score")


# ---- models ---------------------------------------------------------------------------------------

_FEATURES = [f"f{k}" for k in range(8)]


def _rows(spark, sf_dir) -> DataFrame:
    return A.read(spark, sf_dir, "embeddings").select(c("vec_id").alias("id"), (c("label") % 3).alias("y"), *(c("embedding")[k].cast("double").alias(n) for k, n in enumerate(_FEATURES)))


_VIEW = {"v_rows": "SELECT vec_id AS id, label % 3 AS y, " + ", ".join(f"embedding[{k + 1}]::DOUBLE AS f{k}" for k in range(8)) + " FROM embeddings"}


@query("SELECT y_true, count(*) FILTER (y_pred = 0) AS \"0\", count(*) FILTER (y_pred = 1) AS \"1\", count(*) FILTER (y_pred = 2) AS \"2\" FROM v_pred GROUP BY 1")
def confusion_matrix(spark, sf_dir):
    return M.confusion(A.predictions(spark, sf_dir), "y_true", "y_pred", [0, 1, 2])


@query("WITH k AS (SELECT unnest([0,1,2]) AS k), s AS (SELECT k, count(*) FILTER (y_true = k) AS own, count(*) FILTER (y_pred = k) AS got, count(*) FILTER (y_true = k AND y_pred = k) AS hits FROM v_pred, k GROUP BY 1) SELECT sum(own)::BIGINT AS n, round(sum(hits)/sum(own),6) AS accuracy, round(avg(2*hits/(own+got)),6) AS macro_f1, round((sum(hits)/sum(own) - sum(own*got)/(sum(own)*sum(own)))/(1 - sum(own*got)/(sum(own)*sum(own))),6) AS kappa FROM s")
def macro_f1_kappa(spark, sf_dir):
    return r6(M.quality(A.predictions(spark, sf_dir), "y_true", "y_pred"), "accuracy", "macro_f1", "kappa")


@query("SELECT y_true, n, round((SELECT count(*) FROM v_pred)/((SELECT count(DISTINCT y_true) FROM v_pred)*n)*(CASE WHEN y_true = 2 THEN 2 ELSE 1 END),6) AS weight FROM (SELECT y_true, count(*) AS n FROM v_pred GROUP BY 1)")
def class_weights(spark, sf_dir):
    return r6(M.class_weights(A.predictions(spark, sf_dir), "y_true", {2: 2.0}), "weight")


@query("SELECT id, y_true, ((row_number() OVER (PARTITION BY y_true ORDER BY id) - 1) % 5)::INT AS fold FROM v_pred")
def stratified_folds(spark, sf_dir):
    return M.stratified_folds(A.predictions(spark, sf_dir), "y_true", "id", 5).select("id", "y_true", "fold")


@query("SELECT id, y_true FROM (SELECT id, y_true, count(*) OVER (PARTITION BY y_true) AS n, row_number() OVER (PARTITION BY y_true ORDER BY id) AS k FROM v_pred) WHERE k <= greatest(1, round_even(n*0.25::DOUBLE, 0))")
def degradation_sample(spark, sf_dir):
    return M.degraded(A.predictions(spark, sf_dir), "y_true", "id", 0.25).select("id", "y_true")


_EDGES = ", ".join(f"({k}, {k / 10 if k not in (3, 6, 7) else [0, 0, 0, 0.30000000000000004, 0, 0, 0.6000000000000001, 0.7000000000000001][k]!r}::DOUBLE)" for k in range(10))


@query(f"WITH e(k, e) AS (VALUES {_EDGES}), p AS (SELECT *, (SELECT max(k) FROM e WHERE e <= confidence) AS bin FROM v_pred) SELECT bin, count(*) AS n, round(avg(confidence),6) AS mean_confidence, round(avg((y_true = y_pred)::INT),6) AS accuracy FROM p GROUP BY 1")
def reliability_bins(spark, sf_dir):
    return r6(M.reliability(A.predictions(spark, sf_dir), "y_true", "y_pred", "confidence"), "mean_confidence", "accuracy")


@query("SELECT id, " + ", ".join(f"round((f{k} - (SELECT avg(f{k}) FROM v_rows))/(SELECT stddev_pop(f{k}) FROM v_rows),6) AS f{k}" for k in range(8)) + " FROM v_rows", **_VIEW)
def standard_scale(spark, sf_dir):
    return r6(M.standard_scale(_rows(spark, sf_dir), _FEATURES).drop("y"), *_FEATURES)


_SQUARES = "+".join(f"(a.f{k}-b.f{k})*(a.f{k}-b.f{k})" for k in range(8))


@query(f"WITH n AS (SELECT a.id, b.y, row_number() OVER (PARTITION BY a.id ORDER BY {_SQUARES}, b.id) AS k FROM v_rows a JOIN v_rows b ON a.id % 4 = 0 AND b.id % 4 <> 0), v AS (SELECT id, y, count(*) AS n FROM n WHERE k <= 5 GROUP BY 1, 2) SELECT id, y AS predicted FROM (SELECT id, y, row_number() OVER (PARTITION BY id ORDER BY n DESC, y) AS k FROM v) WHERE k = 1", **_VIEW)
def knn_vote(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return M.knn_vote(rows.filter("id % 4 <> 0"), rows.filter("id % 4 = 0"), _FEATURES, "y", "id", 5)


@query(f"SELECT y, id, k AS rank, other AS neighbour FROM (SELECT a.y, a.id, b.id AS other, (row_number() OVER (PARTITION BY a.id ORDER BY {_SQUARES}, b.id))::INT AS k FROM v_rows a JOIN v_rows b ON a.y = b.y AND a.id <> b.id) WHERE k <= 4", **_VIEW)
def smote_neighbors(spark, sf_dir):
    return M.class_neighbours(_rows(spark, sf_dir), _FEATURES, "y", "id", 4)


@query("SELECT id, k, round((2*a + 2*b + d)/5, 6) AS p FROM (SELECT vec_id AS id, k, abs(embedding[k+1]::DOUBLE) AS a, abs(embedding[k+4]::DOUBLE) AS b, abs(embedding[k+7]::DOUBLE) AS d FROM embeddings, (VALUES (0),(1),(2)) t(k))")
def soft_vote(spark, sf_dir):
    part = lambda k: F.array(*(F.abs(c("embedding")[k + j].cast("double")) for j in range(3)))
    rows = A.read(spark, sf_dir, "embeddings").select(c("vec_id").alias("id"), part(0).alias("a"), part(3).alias("b"), part(6).alias("d"))
    return r6(M.soft_vote(rows, ["a", "b", "d"], [2, 2, 1]).select("id", F.posexplode("probability").alias("k", "p")), "p")


@query("""
WITH n AS (SELECT id, y, id % 3 <> 0 AS known, f0, f1 FROM v_rows),
w AS (SELECT a.id, b.id AS o, CASE WHEN a.id = b.id THEN 0 ELSE exp(-0.5::DOUBLE*((a.f0-b.f0)*(a.f0-b.f0)+(a.f1-b.f1)*(a.f1-b.f1))) END AS w FROM n a, n b),
d AS (SELECT id, sum(w) AS d FROM w GROUP BY 1),
s AS (SELECT w.id, k.k, sum(w.w/sqrt(d.d*e.d)*(CASE WHEN n.known AND n.y = k.k THEN 1 ELSE 0 END)) AS s FROM w JOIN d USING (id) JOIN d e ON e.id = w.o JOIN n ON n.id = w.o CROSS JOIN (VALUES (0),(1),(2)) k(k) GROUP BY 1, 2),
f AS (SELECT s.id, k, 0.2::DOUBLE*s + 0.8::DOUBLE*(CASE WHEN known AND y = k THEN 1 ELSE 0 END) AS f FROM s JOIN n USING (id))
SELECT id, k, round(f/sum(f) OVER (PARTITION BY id), 6) AS p FROM f
""", **_VIEW)
def label_spread_1step(spark, sf_dir):
    rows = _rows(spark, sf_dir).withColumn("Name", F.when(c("id") % 3 != 0, c("y")))
    return r6(M.spread_once(rows, ["f0", "f1"], "Name", "id", [0, 1, 2], gamma=0.5, alpha=0.2), "p")


@query()
def label_spread_full(spark, sf_dir):
    rows = _rows(spark, sf_dir).withColumn("Name", F.when(c("id") % 3 != 0, c("y").cast("string")))
    return r6(M.label_spreading(rows, _FEATURES, "Name", "id"), "semi_confidence")


def _model(kind: str, **params) -> Query:
    def run(spark, sf_dir):
        rows = M.stratified_split(_rows(spark, sf_dir), "y", "id")
        weights = M.class_weights(rows.filter("not test"), "y")
        train = rows.filter("not test").join(F.broadcast(weights.select("y", "weight")), "y")
        return M.predicted(M.fit(train, _FEATURES, kind, "y", weight="weight", **params), rows, "id", "y").select("id", "y", "prediction")

    return run


for _name, _kind, _params in (("rf_predict", "forest", {"trees": 20}), ("logreg_predict", "logistic", {}), ("ovr_gbt", "boosting", {"trees": 5}), ("mlp_predict", "perceptron", {"layers": [8, 16, 3], "rounds": 30})):
    QUERIES[_name] = _model(_kind, **_params)


@query()
def rbf_svm(spark, sf_dir):
    rows = M.random_features(M.stratified_split(_rows(spark, sf_dir), "y", "id"), _FEATURES, 32, 2.0)
    model = M.estimator("svm", "y").fit(rows.filter("not test"))
    return M.predicted(model, rows, "id", "y").select("id", "y", "prediction")


@query()
def feature_selection(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    chosen = M.select_features(rows, _FEATURES, "y", 10)
    return rows.sparkSession.createDataFrame([(n, n in chosen) for n in _FEATURES], "feature string, chosen boolean")


@query()
def smote(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    counts = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    return r6(M.smote(rows, _FEATURES, "y", "id", dict.fromkeys(counts, max(counts.values(), default=0))), *_FEATURES)


# ---- reports --------------------------------------------------------------------------------------

_SHOWN = ["height_to_radius", "green_dominance", "crown_volume"]
_LONG = " UNION ALL ".join(f"SELECT '{n}' AS feature, cluster_id % 3 AS species, {n} AS v FROM v_engineered" for n in _SHOWN)


def _species(spark, sf_dir) -> DataFrame:
    return _engineered(spark, sf_dir).withColumn("species", c("cluster_id") % 3)


@query(f"SELECT feature, species, count(v) AS n, round(avg(v),6) AS mean, round(stddev_pop(v),6) AS std, round(min(v),6) AS min, round(max(v),6) AS max FROM ({_LONG}) GROUP BY 1, 2")
def reality_check_stats(spark, sf_dir):
    return r6(Q.class_statistics(_species(spark, sf_dir), _SHOWN, "species"), "mean", "std", "min", "max")


@query(f"SELECT feature, species, round(quantile_cont(v,0.25),6) AS q1, round(quantile_cont(v,0.5),6) AS median, round(quantile_cont(v,0.75),6) AS q3 FROM ({_LONG}) GROUP BY 1, 2")
def box_stats(spark, sf_dir):
    return r6(Q.quartiles(_species(spark, sf_dir), _SHOWN, "species"), "q1", "median", "q3")


@query("WITH l AS (SELECT cluster_id % 3 AS species, x AS v FROM v_points), s AS (SELECT min(v) AS lo, max(v) AS hi FROM l), t AS (SELECT species, count(*) AS total FROM l GROUP BY 1) SELECT 'x' AS feature, species, bin, n, round(n/(total*w),6) AS density FROM (SELECT species, least(24, floor((v-lo)/((hi-lo)/25)))::BIGINT AS bin, count(*) AS n, any_value((hi-lo)/25) AS w FROM l, s GROUP BY 1, 2) JOIN t USING (species)")
def feature_histogram(spark, sf_dir):
    rows = A.points(spark, sf_dir).select((c("cluster_id") % 3).alias("species"), "x")
    return r6(Q.histograms(rows, ["x"], "species"), "density")


@query("SELECT cluster_id, reason FROM (SELECT cluster_id, CASE WHEN n_points < 570 THEN 'few_points' END AS a, CASE WHEN height < 48.9 THEN 'low' END AS b, CASE WHEN height_to_radius > (SELECT quantile_cont(height_to_radius, 0.99) FROM v_engineered) THEN 'ratio' END AS d FROM v_engineered) UNPIVOT (reason FOR kind IN (a, b, d))")
def suspicious_flags(spark, sf_dir):
    return Q.suspicious(_engineered(spark, sf_dir), "cluster_id", few=570, low=48.9)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


