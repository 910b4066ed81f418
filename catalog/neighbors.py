"""Pair distances, neighbour graphs, geodesics and paths."""

from pyspark.sql import functions as F

from catalog.base import (ANTENNAS, CIRA, CIRA_SQL, GRAPH_SQL, MAG_SQL, PAIR_SQL, PATH_SQL, TAPS, antenna_rows, drawn_pairs,
                          magnitudes, neighbor_graph, pick_sql, points, query, r, vectors)
from catalog.signals import SIGNATURE_SQL
from kartograf.functions import arrays
from kartograf.functions.scalars import pick
from kartograf.operators import graph, sampling
from kartograf.operators.pairs import Dissimilarity, nearest_neighbors
from kartograf.plans.jobs import metric_features

_FLAT = "list_transform(range(0,64), lambda k: abs(CAST(embedding[k+1] AS DOUBLE)))"
_Z = "list_zip(x, y)"
_METRIC_SQL = {
    "cityblock": f"list_sum(list_transform({_Z}, lambda z: abs(z[1]-z[2])))",
    "euclidean": f"sqrt(list_sum(list_transform({_Z}, lambda z: (z[1]-z[2])**2)))",
    "sqeuclidean": f"list_sum(list_transform({_Z}, lambda z: (z[1]-z[2])**2))",
    "cosine": "1 - list_dot_product(x, y)/sqrt(list_dot_product(x, x)*list_dot_product(y, y))",
    "correlation": "1 - list_dot_product(xc, yc)/sqrt(list_dot_product(xc, xc)*list_dot_product(yc, yc))",
    "chebyshev": f"list_max(list_transform({_Z}, lambda z: abs(z[1]-z[2])))",
    "canberra": f"list_sum(list_transform({_Z}, lambda z: abs(z[1]-z[2])/(abs(z[1])+abs(z[2]))))",
    "braycurtis": f"list_sum(list_transform({_Z}, lambda z: abs(z[1]-z[2])))/list_sum(list_transform({_Z}, lambda z: abs(z[1]+z[2])))",
    "minkowski": f"pow(list_sum(list_transform({_Z}, lambda z: pow(abs(z[1]-z[2]), 3))), 1.0/3)",
    "hamming": f"list_sum(list_transform({_Z}, lambda z: CASE WHEN z[1] = z[2] THEN 0.0 ELSE 1.0 END))/64",
    "jensenshannon": "sqrt(greatest(list_sum(list_transform(list_zip(list_transform(x, lambda v: v/list_sum(x)), list_transform(y, lambda v: v/list_sum(y))), "
                     "lambda z: z[1]*ln(2*z[1]/(z[1]+z[2])) + z[2]*ln(2*z[2]/(z[1]+z[2]))))/2, 0))",
}


@query("pair_metrics", f"""WITH {PAIR_SQL}, fl AS (SELECT vec_id AS id, {_FLAT} AS f FROM embeddings),
c AS (SELECT id, f, list_transform(f, lambda v: v - list_avg(f)) AS fc FROM fl),
p AS (SELECT i, j, a.f AS x, b.f AS y, a.fc AS xc, b.fc AS yc FROM drawn JOIN c a ON a.id = i JOIN c b ON b.id = j)
SELECT i, j, {', '.join(f'ROUND({sql}, 6) + 0.0 AS {name}' for name, sql in _METRIC_SQL.items())} FROM p""")
def pair_metrics(spark, d):
    """Every metric on a drawn partner per row."""
    flat = vectors(spark, d).select("id", F.transform("e", F.abs).alias("f"))
    pairs = drawn_pairs(spark, d).join(flat.select(F.col("id").alias("i"), F.col("f").alias("x")), "i") \
        .join(flat.select(F.col("id").alias("j"), F.col("f").alias("y")), "j")
    value = lambda m: arrays.METRICS[m](F.col("x"), F.col("y"), **({"p": 3.0} if m == "minkowski" else {}))
    return pairs.select("i", "j", *[r(value(m)).alias(m) for m in _METRIC_SQL])


@query("antenna_aggregations", f"""WITH {MAG_SQL}, {PAIR_SQL},
p AS (SELECT i, j, list_transform(range(1,5), lambda k: CASE WHEN a.ok[k] AND b.ok[k] THEN list_sum(list_transform(range(1,9), lambda t: abs(a.vec[k][t]-b.vec[k][t]))) END) AS l
  FROM drawn JOIN mag a ON a.id = i JOIN mag b ON b.id = j),
k AS (SELECT i, j, list_filter(l, lambda v: v IS NOT NULL) AS l FROM p)
SELECT i, j, ROUND(coalesce(list_sum(l), 0), 6) + 0.0 AS d_sum, ROUND(list_avg(l), 6) + 0.0 AS d_mean, ROUND(list_max(l), 6) + 0.0 AS d_max,
  ROUND(list_median(l), 6) + 0.0 AS d_median FROM k""")
def antenna_aggregations(spark, d):
    m = magnitudes(spark, d, masked=True)
    pairs = drawn_pairs(spark, d).join(m.select(F.col("id").alias("i"), F.col("vec").alias("x")), "i") \
        .join(m.select(F.col("id").alias("j"), F.col("vec").alias("y")), "j")
    return pairs.select("i", "j", *[r(arrays.antenna_distance(F.col("x"), F.col("y"), "cityblock", a)).alias(f"d_{a}")
                                    for a in arrays.ANTENNA_AGGREGATIONS])


@query("siamese_pairs", f"""WITH {MAG_SQL}, {PAIR_SQL} SELECT i, j, ROUND(list_sum(list_transform(range(1,5), lambda k:
  list_sum(list_transform(range(1,9), lambda t: abs(a.vec[k][t]-b.vec[k][t])))))/4, 6) + 0.0 AS target FROM drawn JOIN mag a ON a.id = i JOIN mag b ON b.id = j""")
def siamese_pairs(spark, d):
    """A random partner and its distance for every row; distances of the drawn pairs only."""
    m = magnitudes(spark, d)
    pairs = drawn_pairs(spark, d).join(m.select(F.col("id").alias("i"), F.col("vec").alias("x")), "i") \
        .join(m.select(F.col("id").alias("j"), F.col("vec").alias("y")), "j")
    return pairs.select("i", "j", r(arrays.antenna_distance(F.col("x"), F.col("y"), "cityblock", "mean")).alias("target"))


_STORED_SQL = f"""{MAG_SQL}, {PAIR_SQL}, ks AS (SELECT DISTINCT least(i,j) AS i, greatest(i,j) AS j FROM drawn WHERE i <> j),
st AS (SELECT i, j, ROUND(list_sum(list_transform(range(1,5), lambda k: list_sum(list_transform(range(1,9), lambda t: abs(a.vec[k][t]-b.vec[k][t])))))/4, 6) + 0.0 AS d
  FROM ks JOIN mag a ON a.id = i JOIN mag b ON b.id = j)"""


def _stored_distances(spark, d):
    """Distances of all drawn pairs, as a table of i < j."""
    m = magnitudes(spark, d)
    keyed = sampling.pair_key(drawn_pairs(spark, d).filter("i <> j")).select(F.col("low").alias("i"), F.col("high").alias("j")).distinct()
    both = keyed.join(m.select(F.col("id").alias("i"), F.col("vec").alias("x")), "i").join(m.select(F.col("id").alias("j"), F.col("vec").alias("y")), "j")
    return both.select("i", "j", r(arrays.antenna_distance(F.col("x"), F.col("y"), "cityblock", "mean")).alias("d"))


@query("stored_distance_lookup", f"""WITH {_STORED_SQL}
SELECT d.j AS i, d.i AS j, CASE WHEN d.i = d.j THEN 0 ELSE s.d END AS d FROM drawn d
LEFT JOIN st s ON s.i = least(d.i, d.j) AND s.j = greatest(d.i, d.j)""")
def stored_distance_lookup(spark, d):
    """Distances of the drawn pairs, asked the other way round, from a stored table."""
    turned = drawn_pairs(spark, d).select(F.col("j").alias("i"), F.col("i").alias("j"))
    return sampling.look_up_distances(turned, _stored_distances(spark, d)).select("i", "j", r("d").alias("d"))


@query("square_distances", f"WITH {_STORED_SQL} SELECT i, j, d FROM st UNION ALL SELECT j, i, d FROM st")
def square_distances(spark, d):
    return sampling.square(_stored_distances(spark, d))


@query("cira_neighbors", f"WITH {GRAPH_SQL.split(',' + chr(10) + 'edge')[0]} SELECT i AS src, j AS dst, ROUND(d, 9) + 0.0 AS d, CAST(rank AS INT) AS rank FROM knn")
def cira_neighbors(spark, d):
    """Flagship: tap magnitudes, mean city-block distance over antennas, 20 exact neighbours."""
    near = nearest_neighbors(points(spark, d), 20, CIRA)
    return near.select("src", "dst", r("d", 9).alias("d"), F.col("rank").cast("int").alias("rank"))


@query("masked_neighbors", f"""WITH {MAG_SQL},
p AS (SELECT a.id AS i, b.id AS j, list_filter(list_transform(range(1,5), lambda k: CASE WHEN a.ok[k] AND b.ok[k] THEN
  list_sum(list_transform(range(1,9), lambda t: abs(a.vec[k][t]-b.vec[k][t]))) END), lambda v: v IS NOT NULL) AS l FROM mag a JOIN mag b ON a.id <> b.id),
q AS (SELECT i, j, round(coalesce(list_median(l), 1e10), 9) AS d FROM p)
SELECT i AS src, j AS dst, ROUND(d, 9) + 0.0 AS d, CAST(row_number() OVER (PARTITION BY i ORDER BY d, j) AS INT) AS rank FROM q
QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) <= 10""")
def masked_neighbors(spark, d):
    near = nearest_neighbors(points(spark, d, masked=True), 10, Dissimilarity("cityblock", ANTENNAS, "median"))
    return near.select("src", "dst", r("d", 9).alias("d"), F.col("rank").cast("int").alias("rank"))


@query("cosine_neighbors", f"""WITH {MAG_SQL}, p AS (SELECT a.id AS i, b.id AS j, round(list_sum(list_transform(range(1,5), lambda k:
  1 - list_dot_product(a.vec[k], b.vec[k])/sqrt(list_dot_product(a.vec[k], a.vec[k])*list_dot_product(b.vec[k], b.vec[k])))), 9) AS d
FROM mag a JOIN mag b ON a.id <> b.id) SELECT i AS src, j AS dst, ROUND(d, 9) + 0.0 AS d, CAST(row_number() OVER (PARTITION BY i ORDER BY d, j) AS INT) AS rank
FROM p QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) <= 10""")
def cosine_neighbors(spark, d):
    near = nearest_neighbors(points(spark, d), 10, Dissimilarity("cosine", ANTENNAS, "sum"))
    return near.select("src", "dst", r("d", 9).alias("d"), F.col("rank").cast("int").alias("rank"))


@query("signature_neighbors", f"""WITH {SIGNATURE_SQL}, p AS (SELECT a.id AS i, b.id AS j, round(avg(abs(a.s - b.s)), 9) AS d FROM sig a JOIN sig b
  ON a.antenna = b.antenna AND a.id <> b.id GROUP BY a.id, b.id)
SELECT i AS src, j AS dst, ROUND(d, 9) + 0.0 AS d, CAST(row_number() OVER (PARTITION BY i ORDER BY d, j) AS INT) AS rank
FROM p QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) <= 10""")
def signature_neighbors(spark, d):
    f = metric_features(antenna_rows(spark, d), "signature", ANTENNAS, TAPS)
    near = nearest_neighbors(f, 10, Dissimilarity("cityblock", ANTENNAS, "mean"))
    return near.select("src", "dst", r("d", 9).alias("d"), F.col("rank").cast("int").alias("rank"))


@query("neighbor_graph", f"WITH {GRAPH_SQL} SELECT i AS src, j AS dst, ROUND(w, 9) + 0.0 AS w FROM edge")
def neighbor_graph_query(spark, d):
    return neighbor_graph(spark, d).select("src", "dst", r("w", 9).alias("w"))


@query("components", """WITH RECURSIVE e AS (SELECT DISTINCT c_custkey AS i, o_orderkey + 1000000000 AS j FROM customer JOIN orders ON o_custkey = c_custkey),
u AS MATERIALIZED (SELECT i, j FROM e UNION ALL SELECT j, i FROM e),
lab(id, c) USING KEY (id) AS (SELECT id, id FROM (SELECT i AS id FROM u UNION SELECT j FROM u)
  UNION (SELECT u.j, min(l.c) FROM lab l JOIN u ON u.i = l.id JOIN recurring.lab q ON q.id = u.j WHERE l.c < q.c GROUP BY u.j))
SELECT id, c AS component FROM lab""")
def components(spark, d):
    """Components of a graph of orders and their customers that falls into very many parts."""
    from catalog.base import table
    edges = table(spark, d, "orders").join(
        table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey").select(
        F.col("o_custkey").alias("src"), (F.col("o_orderkey") + 1000000000).alias("dst")).distinct()
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return graph.connected_components(nodes, edges)


@query("component_count", f"""WITH RECURSIVE {GRAPH_SQL.replace("<= 20", "<= 2")},
lab(id, c) USING KEY (id) AS (SELECT id, id FROM mag
  UNION (SELECT e.j, min(l.c) FROM lab l JOIN edge e ON e.i = l.id JOIN recurring.lab q ON q.id = e.j WHERE l.c < q.c GROUP BY e.j))
SELECT count(DISTINCT c) AS components, count(*) AS nodes FROM lab""")
def component_count(spark, d):
    """Parts into which the graph of the two nearest neighbours falls."""
    labels = graph.connected_components(vectors(spark, d).select("id"), neighbor_graph(spark, d, 2))
    return labels.agg(F.countDistinct("component").alias("components"), F.count("*").alias("nodes"))


@query("geodesic_pairs", f"WITH RECURSIVE {PATH_SQL}, {PAIR_SQL} SELECT DISTINCT i, j, ROUND(d, 9) + 0.0 AS d FROM drawn JOIN sp ON src = i AND dst = j")
def geodesic_pairs(spark, d):
    """Geodesic distance to the drawn partner of every row."""
    out = graph.geodesics_between(neighbor_graph(spark, d), drawn_pairs(spark, d))
    return out.select("i", "j", r("d", 9).alias("d"))


@query("geodesic_square", f"""WITH RECURSIVE {PATH_SQL.replace("<= 20", "<= 2")}
SELECT a.id AS i, count(s.d) AS reached, count(*) - count(s.d) AS unreached, ROUND(coalesce(sum(s.d), 0), 6) + 0.0 AS total
FROM mag a JOIN mag b ON a.id <> b.id LEFT JOIN sp s ON s.src = a.id AND s.dst = b.id GROUP BY a.id""")
def geodesic_square(spark, d):
    """Rows of the square matrix of a graph in several parts: pairs without a path lie at infinity."""
    far = graph.geodesics_from(neighbor_graph(spark, d, 2), vectors(spark, d).select("id"), keep_upper=True, unreached=True)
    both = sampling.square(far.select(F.col("src").alias("i"), F.col("dst").alias("j"), "d"))
    near = F.when(F.col("d") < float("inf"), F.col("d"))
    return both.groupBy("i").agg(F.count(near).alias("reached"), (F.count("*") - F.count(near)).alias("unreached"),
                                 r(F.coalesce(F.sum(near), F.lit(0.0))).alias("total"))


@query("geodesic_summary", f"WITH RECURSIVE {PATH_SQL} SELECT src, count(*) AS reached, ROUND(avg(d), 6) + 0.0 AS mean_d, ROUND(max(d), 9) + 0.0 AS max_d FROM sp WHERE src <> dst GROUP BY src")
def geodesic_summary(spark, d):
    """All-pairs geodesics folded to one row per source."""
    out = graph.geodesic_summary(neighbor_graph(spark, d), vectors(spark, d).select("id"))
    return out.select("src", "reached", r("mean_d").alias("mean_d"), r("max_d", 9).alias("max_d"))


_TARGETS = """tg AS (SELECT DISTINCT b.id FROM (SELECT {pick} AS at FROM (SELECT unnest(range(count(*) // 16)) AS k, count(*) AS n FROM embeddings)) a JOIN rowno b ON b.p = a.at)"""
TARGET_SQL = _TARGETS.format(pick=pick_sql("k", 3, "n"))


def _targets(spark, d):
    """One target for 16 rows, drawn from all rows."""
    from kartograf.operators.ordering import with_position
    rows = with_position(vectors(spark, d).select("id"), "id")
    n = rows.count()
    drawn = spark.range(n // 16).select(pick(F.col("id"), 3, n).alias("pos"))
    return rows.join(drawn, "pos").select("id").distinct()


@query("path_trees", f"""WITH RECURSIVE {PATH_SQL}, {PAIR_SQL}, {TARGET_SQL}
SELECT s.src AS target, s.dst AS node, CASE WHEN s.src = s.dst THEN -1 ELSE arg_min(e.i, q.d + e.w) END AS pred, ROUND(any_value(s.d), 9) + 0.0 AS d
FROM sp s JOIN tg ON tg.id = s.src LEFT JOIN edge e ON e.j = s.dst LEFT JOIN sp q ON q.src = s.src AND q.dst = e.i GROUP BY s.src, s.dst""")
def path_trees(spark, d):
    """Predecessor of every node towards each drawn target."""
    trees = graph.shortest_path_trees(neighbor_graph(spark, d), _targets(spark, d))
    return trees.select("target", "node", "pred", r("d", 9).alias("d"))


@query("longest_path", f"""WITH RECURSIVE {PATH_SQL}, {PAIR_SQL}, tg AS (SELECT DISTINCT vec_id AS id FROM embeddings),
pr AS MATERIALIZED (SELECT s.src AS t, s.dst AS v, CASE WHEN s.src = s.dst THEN -1 ELSE arg_min(e.i, q.d + e.w) END AS p
  FROM sp s JOIN tg ON tg.id = s.src LEFT JOIN edge e ON e.j = s.dst LEFT JOIN sp q ON q.src = s.src AND q.dst = e.i GROUP BY s.src, s.dst),
walk(t, v, n) AS (SELECT t, t, 1 FROM (SELECT DISTINCT t FROM pr) UNION ALL SELECT w.t, pr.v, w.n + 1 FROM walk w JOIN pr ON pr.t = w.t AND pr.p = w.v)
SELECT CAST(max(n) AS INT) AS nodes FROM walk""")
def longest_path(spark, d):
    """Most nodes on any shortest path, towards every row."""
    trees = graph.shortest_path_trees(neighbor_graph(spark, d), vectors(spark, d).select("id"))
    return spark.createDataFrame([(graph.longest_path_hops(trees),)], "nodes int")


@query("path_lengths", f"""WITH RECURSIVE {PATH_SQL}, {PAIR_SQL} SELECT i AS source, j AS target, ROUND(d, 9) + 0.0 AS length FROM drawn JOIN sp ON src = i AND dst = j""")
def path_lengths(spark, d):
    """Shortest path to the drawn partner, its length summed hop by hop along the nodes."""
    edges = neighbor_graph(spark, d)
    asked = drawn_pairs(spark, d).select(F.col("i").alias("path_id"), F.col("i").alias("source"), F.col("j").alias("target"))
    paths = graph.shortest_paths(edges, asked)
    hops = paths.select("source", "target", F.posexplode("nodes").alias("at", "src"), F.col("nodes").alias("_n")) \
        .withColumn("dst", F.get("_n", F.col("at") + 1)).drop("_n")
    summed = hops.join(edges, ["src", "dst"], "left").groupBy("source", "target").agg(F.sum(F.coalesce("w", F.lit(0.0))).alias("l"))
    return summed.select("source", "target", r("l", 9).alias("length"))


@query("contracted_trees", f"""WITH RECURSIVE {PATH_SQL}, {PAIR_SQL}, {TARGET_SQL},
pr AS MATERIALIZED (SELECT s.src AS t, s.dst AS v, CASE WHEN s.src = s.dst THEN -1 ELSE arg_min(e.i, q.d + e.w) END AS p, CAST(s.dst % 3 = 0 AS INT) AS c
  FROM sp s JOIN tg ON tg.id = s.src LEFT JOIN edge e ON e.j = s.dst LEFT JOIN sp q ON q.src = s.src AND q.dst = e.i GROUP BY s.src, s.dst),
run(t, v, p, c) AS (SELECT t, v, p, c FROM pr UNION ALL SELECT r.t, r.v, b.p, r.c FROM run r JOIN pr b ON b.t = r.t AND b.v = r.p WHERE r.c = 1 AND b.c = 1 AND b.p <> -1),
depth(t, v, n) AS (SELECT t, t, 0 FROM (SELECT DISTINCT t FROM pr) UNION ALL SELECT w.t, pr.v, w.n + 1 FROM depth w JOIN pr ON pr.t = w.t AND pr.p = w.v)
SELECT run.t AS target, run.v AS node, arg_min(run.p, coalesce(d.n, -1)) AS pred FROM run LEFT JOIN depth d ON d.t = run.t AND d.v = run.p GROUP BY run.t, run.v""")
def contracted_trees(spark, d):
    """Path trees with stretches of one hop kind contracted."""
    trees = graph.shortest_path_trees(neighbor_graph(spark, d), _targets(spark, d), together=True)
    kinds = trees.withColumn("choice", (F.col("node") % 3 == 0).cast("int"))
    return graph.contract_trees(kinds, 1, together=True).select("target", "node", "pred")
