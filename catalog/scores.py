"""Evaluation tables."""

import math

from pyspark.sql import functions as F

from catalog.base import MAG_SQL, PAIR_SQL, POS_SQL, drawn_pairs, magnitudes, points, positions, query, r, snapshots, table, CIRA
from kartograf.functions import arrays
from kartograf.operators import evaluation as E
from kartograf.operators import multilateration as M
from kartograf.operators.ordering import stride
from kartograf.plans import jobs
from kartograf.session import cut

AFFINE_SQL = f"""{POS_SQL}, mo AS (SELECT avg(px) mpx, avg(py) mpy, avg(gx) mgx, avg(gy) mgy, var_pop(px) xx, covar_pop(px, py) xy, var_pop(py) yy,
  covar_pop(px, gx) c00, covar_pop(py, gx) c10, covar_pop(px, gy) c01, covar_pop(py, gy) c11 FROM pos),
co AS (SELECT *, (yy*c00 - xy*c10)/(xx*yy-xy*xy) a00, (xx*c10 - xy*c00)/(xx*yy-xy*xy) a10, (yy*c01 - xy*c11)/(xx*yy-xy*xy) a01, (xx*c11 - xy*c01)/(xx*yy-xy*xy) a11 FROM mo),
al AS (SELECT id, gx, gy, px, py, valid, mgx + (px-mpx)*a00 + (py-mpy)*a10 AS ax, mgy + (px-mpx)*a01 + (py-mpy)*a11 AS ay FROM pos, co),
er AS (SELECT *, sqrt((ax-gx)**2 + (ay-gy)**2) AS error FROM al)"""


def aligned(spark, d):
    return E.with_error(E.align_affine(positions(spark, d)))


@query("affine_alignment", f"WITH {AFFINE_SQL} SELECT id, ROUND(ax, 6) + 0.0 AS ax, ROUND(ay, 6) + 0.0 AS ay, ROUND(error, 6) + 0.0 AS error FROM er")
def affine_alignment(spark, d):
    return aligned(spark, d).select("id", r("ax").alias("ax"), r("ay").alias("ay"), r("error").alias("error"))


_LEVELS = ", ".join(f"ROUND(quantile_cont(error, {p}), 6) + 0.0 AS CE{round(p * 100)}" for p in E.ERROR_LEVELS)


@query("error_quantiles", f"WITH {AFFINE_SQL} SELECT {_LEVELS}, ROUND(avg(error), 6) + 0.0 AS MAE FROM er WHERE valid")
def error_quantiles(spark, d):
    s = E.error_summary(aligned(spark, d))
    return s.select(*[r(c).alias(c) for c in s.columns])


@query("grouped_quantiles", """SELECT l_returnflag, CAST(p AS DOUBLE) AS p, ROUND(quantile_cont(l_extendedprice, q), 4) + 0.0 AS q FROM
(SELECT l_returnflag, l_extendedprice FROM lineitem), (VALUES (0.25, 0.25), (0.5, 0.5), (0.95, 0.95)) v(p, q) WHERE p = 0.5 GROUP BY 1, 2, v.q
UNION ALL SELECT l_returnflag, 0.25, ROUND(quantile_cont(l_extendedprice, 0.25), 4) + 0.0 FROM lineitem GROUP BY 1
UNION ALL SELECT l_returnflag, 0.95, ROUND(quantile_cont(l_extendedprice, 0.95), 4) + 0.0 FROM lineitem GROUP BY 1""".replace(
    "(SELECT l_returnflag, l_extendedprice FROM lineitem), (VALUES (0.25, 0.25), (0.5, 0.5), (0.95, 0.95)) v(p, q) WHERE p = 0.5 GROUP BY 1, 2, v.q",
    "(SELECT l_returnflag, l_extendedprice, 0.5 AS p FROM lineitem) GROUP BY 1, 2").replace("quantile_cont(l_extendedprice, q)", "quantile_cont(l_extendedprice, 0.5)"))
def grouped_quantiles(spark, d):
    q = E.exact_quantiles(table(spark, d, "lineitem"), "l_extendedprice", (0.25, 0.5, 0.95), ["l_returnflag"])
    return q.select("l_returnflag", "p", r("q", 4).alias("q"))


@query("error_ecdf", """WITH o AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS k, count(*) OVER () AS n FROM lineitem),
w AS (SELECT i, CAST(floor(i*(n-1)/999.0) AS BIGINT) AS k, n FROM range(1000) ri(i), (SELECT count(*) AS n FROM lineitem))
SELECT ROUND(v, 4) + 0.0 AS value, ROUND((o.k+1)/o.n, 8) + 0.0 AS cdf FROM w JOIN o ON o.k = w.k""")
def error_ecdf(spark, d):
    e = E.ecdf(table(spark, d, "lineitem"), "l_extendedprice")
    return e.select(r("value", 4).alias("value"), r("cdf", 8).alias("cdf"))


@query("histogram", """WITH e AS (SELECT min(l_extendedprice) x0, max(l_extendedprice) x1, min(l_quantity) y0, max(l_quantity) y1 FROM lineitem)
SELECT CAST(least(floor((l_extendedprice-x0)/((x1-x0)/100)), 99) AS INT) AS bx, CAST(least(floor((l_quantity-y0)/((y1-y0)/100)), 99) AS INT) AS by, count(*) AS n
FROM lineitem, e GROUP BY 1, 2""")
def histogram(spark, d):
    return E.histogram_2d(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity")


@query("pair_histogram", f"""WITH {MAG_SQL}, {POS_SQL}, p AS (SELECT sqrt((a.gx-b.gx)**2+(a.gy-b.gy)**2) AS e, list_sum(list_transform(range(1,5), lambda k:
  list_sum(list_transform(range(1,9), lambda t: abs(m.vec[k][t]-n.vec[k][t])))))/4 AS d FROM pos a JOIN pos b ON a.id < b.id JOIN mag m ON m.id = a.id JOIN mag n ON n.id = b.id),
l AS (SELECT min(e) e0, max(e) e1, min(d) d0, max(d) d1 FROM p)
SELECT CAST(least(floor((e-e0)/((e1-e0)/100)), 99) AS INT) AS bx, CAST(least(floor((d-d0)/((d1-d0)/100)), 99) AS INT) AS by, count(*) AS n FROM p, l GROUP BY 1, 2""")
def pair_histogram(spark, d):
    """True distance against dissimilarity over all pairs; only bin counts leave the tasks."""
    placed = points(spark, d).join(snapshots(spark, d).select("id", F.col("reference").alias("p")), "id")
    return E.pair_histogram_2d(placed, CIRA)


@query("hexbin_error", f"""WITH {AFFINE_SQL}, v AS (SELECT * FROM er WHERE valid), b AS (SELECT min(gx) x0, max(gx) x1, min(gy) y0, max(gy) y1 FROM v),
s AS (SELECT x0 - 1e-9*(x1-x0) AS x0, y0, ((x1-x0) + 2*(1e-9*(x1-x0)))/100 AS sx, (y1-y0)/57 AS sy FROM b),
u AS (SELECT error, (gx-x0)/sx AS u, (gy-y0)/sy AS w FROM v, s),
q AS (SELECT *, pow(u-round_even(u,0),2) + 3*pow(w-round_even(w,0),2) < pow(u-floor(u)-0.5,2) + 3*pow(w-floor(w)-0.5,2) AS ev FROM u)
SELECT CASE WHEN ev THEN 1 ELSE 2 END AS lattice, CAST(CASE WHEN ev THEN round_even(u,0) ELSE floor(u) END AS INT) AS hx,
  CAST(CASE WHEN ev THEN round_even(w,0) ELSE floor(w) END AS INT) AS hy, ROUND(avg(error), 6) + 0.0 AS mean, count(*) AS n FROM q GROUP BY 1, 2, 3""")
def hexbin_error(spark, d):
    h = E.hexbin_mean(aligned(spark, d).filter("valid"), "gx", "gy", "error")
    return h.select("lattice", "hx", "hy", r("mean").alias("mean"), "n")


_BANDS = """b AS (SELECT d, CAST(floor(e/(top/199)) AS INT) + 1 AS bin FROM p, (SELECT max(e) AS top FROM p) WHERE e < top),
q AS (SELECT bin, quantile_cont(d, 0.25) p25, quantile_cont(d, 0.5) p50, quantile_cont(d, 0.75) p75 FROM b WHERE bin < 200 GROUP BY bin)
SELECT CAST(k AS INT) AS bin, ROUND((k-1)*(SELECT max(e) FROM p)/199, 6) + 0.0 AS "left", ROUND({z}p25{y}, 6) + 0.0 AS p25, ROUND({z}p50{y}, 6) + 0.0 AS p50, ROUND({z}p75{y}, 6) + 0.0 AS p75
FROM range(1, 200) rk(k) LEFT JOIN q ON q.bin = k"""
_BAND_PAIRS = f"""{MAG_SQL}, {POS_SQL}, {PAIR_SQL}, p AS (SELECT sqrt((a.gx-b.gx)**2+(a.gy-b.gy)**2) AS e, list_sum(list_transform(range(1,5), lambda k:
  list_sum(list_transform(range(1,9), lambda t: abs(m.vec[k][t]-n.vec[k][t])))))/4 AS d FROM drawn JOIN pos a ON a.id = i JOIN pos b ON b.id = j JOIN mag m ON m.id = i JOIN mag n ON n.id = j)"""


def _band_pairs(spark, d):
    m = magnitudes(spark, d).join(snapshots(spark, d).select("id", F.col("reference").alias("p")), "id")
    both = drawn_pairs(spark, d).join(m.select(F.col("id").alias("i"), F.col("vec").alias("x"), F.col("p").alias("a")), "i") \
        .join(m.select(F.col("id").alias("j"), F.col("vec").alias("y"), F.col("p").alias("b")), "j")
    return both.select(arrays.euclidean(F.col("a"), F.col("b")).alias("e"),
                       arrays.antenna_distance(F.col("x"), F.col("y"), "cityblock", "mean").alias("d"))


def _bands_out(b):
    return b.select("bin", *[r(c).alias(c) for c in ("left", "p25", "p50", "p75")])


_ALL_PAIRS = f"""{MAG_SQL}, {POS_SQL}, p AS (SELECT sqrt((a.gx-b.gx)**2+(a.gy-b.gy)**2) AS e, list_sum(list_transform(range(1,5), lambda k:
  list_sum(list_transform(range(1,9), lambda t: abs(m.vec[k][t]-n.vec[k][t])))))/4 AS d FROM {{rows}} a JOIN {{rows}} b ON {{on}} JOIN mag m ON m.id = a.id JOIN mag n ON n.id = b.id)"""


def _placed(spark, d):
    return points(spark, d).join(snapshots(spark, d).select("id", F.col("reference").alias("p")), "id")


@query("dissimilarity_bands", f"WITH {_ALL_PAIRS.format(rows='pos', on='a.id < b.id')}, " + _BANDS.format(z="coalesce(", y=", 0)"))
def dissimilarity_bands(spark, d):
    """Over all pairs; empty bins hold 0."""
    return _bands_out(E.pair_bands(_placed(spark, d), CIRA))


@query("dissimilarity_bands_gaps", f"WITH {_ALL_PAIRS.format(rows='pos', on='a.id < b.id')}, " + _BANDS.format(z="", y=""))
def dissimilarity_bands_gaps(spark, d):
    """Over all pairs; empty bins are NULL."""
    return _bands_out(E.pair_bands(_placed(spark, d), CIRA, empty=None))


@query("dissimilarity_bands_matrix", f"WITH {_ALL_PAIRS.format(rows='pos', on='true')}, " + _BANDS.format(z="", y=""))
def dissimilarity_bands_matrix(spark, d):
    """Over the square matrix: both triangles and the diagonal."""
    return _bands_out(E.pair_bands(_placed(spark, d), CIRA, empty=None, whole=True))


@query("dissimilarity_bands_strided", f"""WITH {_ALL_PAIRS.format(rows="(SELECT * FROM pos QUALIFY (row_number() OVER (ORDER BY id) - 1) % 10 = 0)", on='true')}, """
       + _BANDS.format(z="", y=""))
def dissimilarity_bands_strided(spark, d):
    """Over every tenth row and column of the square matrix."""
    return _bands_out(E.pair_bands(stride(_placed(spark, d), 10, "id"), CIRA, empty=None, whole=True))


@query("dissimilarity_bands_sample", f"WITH {_BAND_PAIRS}, " + _BANDS.format(z="coalesce(", y=", 0)"))
def dissimilarity_bands_sample(spark, d):
    """Over one drawn partner of each row."""
    return _bands_out(E.dissimilarity_bands(cut(_band_pairs(spark, d))))


def _trust_sql(near, far, name):
    n = {"g": "gx, gy", "p": "px, py"}
    dist = lambda s: f"round(sqrt((a.{s}x-b.{s}x)**2+(a.{s}y-b.{s}y)**2), 9)"
    return f"""WITH {POS_SQL}, p AS (SELECT a.id i, b.id j, {dist(near)} AS dn, {dist(far)} AS df FROM pos a JOIN pos b ON a.id <> b.id),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY dn, j) AS rn, row_number() OVER (PARTITION BY i ORDER BY df, j) AS rf FROM p)
SELECT ROUND(1 - 2.0/(n*5*(2.0*n-16))*sum(greatest(rf-5, 0)) FILTER (rn <= 5), 8) + 0.0 AS {name} FROM k, (SELECT count(*) AS n FROM embeddings) GROUP BY n"""


@query("trustworthiness", _trust_sql("p", "g", "trustworthiness"))
def trustworthiness(spark, d):
    return E.trustworthiness(positions(spark, d)).select(r("trustworthiness", 8).alias("trustworthiness"))


@query("continuity", _trust_sql("g", "p", "continuity"))
def continuity(spark, d):
    return E.continuity(positions(spark, d)).select(r("continuity", 8).alias("continuity"))


@query("kruskal_stress", f"""WITH {POS_SQL}, p AS (SELECT sqrt((a.gx-b.gx)**2+(a.gy-b.gy)**2) AS d, sqrt((a.px-b.px)**2+(a.py-b.py)**2) AS e FROM pos a, pos b),
b AS (SELECT sum(d*e)/sum(e*e) AS b FROM p) SELECT ROUND(sqrt(sum((d-b*e)**2)/sum(d*d)), 8) + 0.0 AS kruskal_stress FROM p, b""")
def kruskal_stress(spark, d):
    return E.kruskal_stress(positions(spark, d)).select(r("kruskal_stress", 8).alias("kruskal_stress"))


@query("chart_colors", f"""WITH {POS_SQL}, b AS (SELECT min(gx) x0, max(gx) x1, min(gy) y0, max(gy) y1 FROM pos),
s AS (SELECT *, (gx-(x0+x1)*0.5)**2 + (gy-(y0+y1)*0.5)**2 AS s FROM pos, b)
SELECT id, ROUND(1-0.9*(gx-x0)/(x1-x0), 6) + 0.0 AS r, ROUND(0.8*(s-min(s) OVER ())/(max(s) OVER () - min(s) OVER ()), 6) + 0.0 AS g, ROUND(0.9*(gy-y0)/(y1-y0), 6) + 0.0 AS b FROM s""")
def chart_colors(spark, d):
    c = E.chart_colors(positions(spark, d))
    return c.select("id", r("r").alias("r"), r("g").alias("g"), r("b").alias("b"))


@query("probability_map", """WITH c AS (SELECT vec_id AS id, CAST(embedding[2] AS DOUBLE)*20+6 AS cy, CAST(embedding[3] AS DOUBLE)*20+5 AS cx FROM embeddings),
g AS (SELECT id, CAST(i AS INT) AS r, CAST(j AS INT) AS c, exp(-((j-cx)**2+(i-cy)**2)/(2*1.5**2)) AS p FROM c, range(12) ri(i), range(10) rj(j))
SELECT id, r, c, ROUND(p/sum(p) OVER (PARTITION BY id), 8) + 0.0 AS p FROM g""")
def probability_map(spark, d):
    at = snapshots(spark, d).select("id", (F.col("e")[1] * 20 + 6).alias("row"), (F.col("e")[2] * 20 + 5).alias("col"))
    return E.probability_map(at, height=12, width=10, sigma=1.5).select("id", "r", "c", r("p", 8).alias("p"))


# --- positions from arrival times: noise-free arrivals at a known place, one receiver 40 m late ----------

_PLACE = ("ROUND(50 + CAST(embedding[2] AS DOUBLE)*60, 2)", "ROUND(22 + CAST(embedding[3] AS DOUBLE)*25, 2)")


def arrivals(spark, d):
    """(id, toa, gx, gy): every third row has one receiver 40 m late, every seventh misses one, and
    rows that are a multiple of 50 have only two arrivals."""
    s = snapshots(spark, d).select("id", F.round(50 + F.col("e")[1] * 60, 2).alias("gx"), F.round(22 + F.col("e")[2] * 25, 2).alias("gy"))
    way = [F.sqrt((F.col("gx") - x) ** 2 + (F.col("gy") - y) ** 2 + (0.86 - z) ** 2) for x, y, z in M.RECEIVERS]
    late = lambda k: F.when((F.col("id") % 3 == 0) & (F.lit(k) == 4), 40.0).otherwise(0.0)
    gone = lambda k: ((F.col("id") % 7 == 0) & (F.lit(k) == 6)) | ((F.col("id") % 50 == 0) & F.lit(k > 1))
    toa = [F.when(~gone(k), (way[k] - way[0] + late(k)) / M.SPEED_OF_LIGHT) for k in range(8)]
    return s.withColumn("toa", F.array(*toa))


@query("tdoa_positions", f"""SELECT vec_id AS id, CASE WHEN vec_id % 50 <> 0 THEN {_PLACE[0]} + 0.0 END AS x, CASE WHEN vec_id % 50 <> 0 THEN {_PLACE[1]} + 0.0 END AS y,
CASE WHEN vec_id % 50 = 0 THEN 0 ELSE 8 - CAST(vec_id % 3 = 0 AS INT) - CAST(vec_id % 7 = 0 AS INT) END AS inliers, vec_id % 50 <> 0 AS success FROM embeddings""")
def tdoa_positions(spark, d):
    found = M.locate(arrivals(spark, d), speed_of_signal=M.SPEED_OF_LIGHT, fixed_value=0.86, inlier_threshold=6.0)
    return found.select("id", r("x", 2).alias("x"), r("y", 2).alias("y"),
                        F.size(F.filter("inliers", lambda v: v)).alias("inliers"), "success")


@query("tdoa_errors", """SELECT 0.0 AS CE50, 0.0 AS CE75, 0.0 AS CE90, 0.0 AS CE95, 0.0 AS CE99, 0.0 AS MAE, ROUND(avg(CAST(vec_id % 50 <> 0 AS INT)), 8) + 0.0 AS success_rate FROM embeddings""".replace(
    "0.0 AS", "CAST(0 AS DOUBLE) AS"))
def tdoa_errors(spark, d):
    out = jobs.positions_job(arrivals(spark, d))
    m = out["metrics"].withColumn("success_rate", out["success"].scalar())
    return m.select(*[r(c, 4 if c != "success_rate" else 8).alias(c) for c in m.columns])


@query("chart_scores")
def chart_scores(spark, d):
    """The whole evaluation of a chart in one row."""
    m = jobs.score(positions(spark, d))["metrics"]
    return m.select(*[r(c).alias(c) for c in m.columns])
