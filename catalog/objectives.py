"""Training sets and objectives."""

from pyspark.sql import functions as F

from catalog.base import PAIR_SQL, POS_SQL, draw_sql, drawn_pairs, pick_sql, positions, query, r, seconds, table, vectors
from kartograf.functions import arrays
from kartograf.operators import gaussian as G
from kartograf.operators import losses, sampling
from kartograf.operators.graph import union_all

# slices of the vector stand for predictions, targets and embeddings
_S = lambda a, b: f"list_transform(embedding[{a}:{b}], lambda v: CAST(v AS DOUBLE)*10)"


def _slices(spark, d):
    part = lambda a, n: F.transform(F.slice("e", a, n), lambda v: v * 10)
    return vectors(spark, d).select("id", part(1, 2).alias("a"), part(3, 2).alias("b"), part(5, 2).alias("c"))


_ABC = f"abc AS (SELECT vec_id AS id, {_S(1, 2)} AS a, {_S(3, 4)} AS b, {_S(5, 6)} AS c FROM embeddings)"


@query("time_triplets", f"""WITH e AS (SELECT event_id AS id, epoch_us(ts)/1e6/60 AS t, row_number() OVER (ORDER BY event_id) - 1 AS p, count(*) OVER () AS n FROM events),
c AS (SELECT a.id, a.p, a.n, b.id AS k, b.p AS q, abs(b.t - a.t) AS dt FROM e a JOIN e b ON b.p BETWEEN a.p - 4 AND a.p + 4 AND b.p <> a.p),
g AS (SELECT id, p, n, list(k ORDER BY q) FILTER (dt <= 2.0) AS near, arg_min(k, [dt, q]) AS closest FROM c GROUP BY id, p, n),
s AS (SELECT *, CASE WHEN near IS NOT NULL THEN near[{pick_sql('p', 3, 'len(near)')} + 1] ELSE closest END AS positive, {pick_sql('p', 4, 'n')} AS at FROM g)
SELECT s.id AS anchor, positive, e.id AS negative FROM s JOIN e ON e.p = s.at""")
def time_triplets(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), (seconds() / 60).alias("ts"))
    return sampling.draw_triplets(rows, 2.0, 1.9, seed=3).select("anchor", "positive", "negative")


@query("sample_without_replacement", f"""SELECT event_id, user_id FROM events
  QUALIFY row_number() OVER (ORDER BY {draw_sql('event_id', 9)}) <= CAST(floor(count(*) OVER ()*0.2) AS BIGINT)""")
def sample_without_replacement(spark, d):
    return sampling.sample_exact(table(spark, d, "events"), 0.2, "event_id", 9).select("event_id", "user_id")


@query("mse_loss", f"WITH {_ABC} SELECT ROUND(avg(((a[1]-b[1])**2 + (a[2]-b[2])**2)/2), 8) + 0.0 AS loss FROM abc")
def mse_loss(spark, d):
    return losses.mse_loss(_slices(spark, d), "a", "b").select(r("loss", 8).alias("loss"))


@query("huber_loss", f"""WITH {_ABC}, x AS (SELECT abs(unnest([a[1]-b[1], a[2]-b[2]])) AS x FROM abc)
SELECT ROUND(avg(CASE WHEN x <= 1 THEN 0.5*x*x ELSE x-0.5 END), 8) + 0.0 AS loss FROM x""")
def huber_loss(spark, d):
    return losses.huber_loss(_slices(spark, d), "a", "b").select(r("loss", 8).alias("loss"))


@query("siamese_loss", f"WITH {_ABC} SELECT ROUND(avg((sqrt((a[1]-b[1])**2+(a[2]-b[2])**2) - abs(c[1]))**2), 8) + 0.0 AS loss FROM abc")
def siamese_loss(spark, d):
    rows = _slices(spark, d).withColumn("target", F.abs(F.col("c")[0]))
    return losses.distance_loss(rows, "a", "b", "target").select(r("loss", 8).alias("loss"))


@query("triplet_loss", f"""WITH {_ABC} SELECT ROUND(avg(greatest(sqrt((a[1]-b[1]+1e-6)**2+(a[2]-b[2]+1e-6)**2) - sqrt((a[1]-c[1]+1e-6)**2+(a[2]-c[2]+1e-6)**2) + 1, 0)), 8) + 0.0 AS loss FROM abc""")
def triplet_loss(spark, d):
    return losses.triplet_loss(_slices(spark, d), "a", "b", "c").select(r("loss", 8).alias("loss"))


@query("kl_loss", f"WITH {_ABC} SELECT ROUND(-0.5*avg(1+b[1]-a[1]**2-exp(b[1]) + 1+b[2]-a[2]**2-exp(b[2])), 8) + 0.0 AS loss FROM abc")
def kl_loss(spark, d):
    return losses.kl_loss(_slices(spark, d), "a", "b").select(r("loss", 8).alias("loss"))


@query("uncertainty_loss", f"""WITH {_ABC}, m AS (SELECT avg(((a[1]-c[1])**2 + (a[2]-c[2])**2)/2) AS m FROM abc)
SELECT ROUND(avg((b[1] + m*exp(-b[1]) + b[2] + m*exp(-b[2]))/2), 8) + 0.0 AS loss FROM abc, m""")
def uncertainty_loss(spark, d):
    return losses.uncertainty_loss(_slices(spark, d), "a", "b", "c").select(r("loss", 8).alias("loss"))


_WORDS = [[x - 1.5, y - 1.0] for x in range(4) for y in range(3)]
_WORD_SQL = "w AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {w[0]}, {w[1]})" for i, w in enumerate(_WORDS)) + ") v(i, wx, wy))"
_CODE_SQL = f"{_ABC}, {_WORD_SQL}, q AS (SELECT id, min((a[1]-wx)**2+(a[2]-wy)**2) AS d, arg_min(i, [(a[1]-wx)**2+(a[2]-wy)**2, i]) AS code FROM abc, w GROUP BY id)"


@query("nearest_codeword", f"WITH {_CODE_SQL} SELECT id, CAST(code AS INT) AS code, ROUND(d, 6) + 0.0 AS code_d FROM q")
def nearest_codeword(spark, d):
    return losses.nearest_code(_slices(spark, d), "a", _WORDS).select("id", "code", r("code_d").alias("code_d"))


@query("codebook_loss", f"WITH {_CODE_SQL} SELECT ROUND(1.25*avg(d/2), 8) + 0.0 AS loss FROM q")
def codebook_loss(spark, d):
    return losses.codebook_loss(_slices(spark, d), "a", _WORDS).select(r("loss", 8).alias("loss"))


def _regularizer(kind):
    term = "CASE WHEN abs(d-dt) <= 1 THEN 0.5*(d-dt)**2 ELSE abs(d-dt)-0.5 END" if kind == "FRD" else "greatest(d-dt, 0)**2"
    sql = f"""WITH e AS (SELECT event_id AS id, event_id // 1024 AS batch, epoch_us(ts)/1e6/3600 AS t, value/10 AS x, CAST(user_id AS DOUBLE)/10 AS y FROM events),
p AS (SELECT a.batch, abs(a.t-b.t) AS dt, sqrt((a.x-b.x)**2+(a.y-b.y)**2) AS d FROM e a JOIN e b ON a.batch = b.batch AND a.id < b.id AND abs(a.t-b.t) <= 1.5)
SELECT batch, count(*) AS pairs, ROUND(avg({term}), 6) + 0.0 AS loss FROM p GROUP BY batch"""

    @query(f"time_regularizer_{kind.lower()}", sql)
    def run(spark, d):
        rows = table(spark, d, "events").select(
            F.floor(F.col("event_id") / 1024).alias("batch"), (seconds() / 3600).alias("ts"),
            F.array(F.col("value") / 10, F.col("user_id").cast("double") / 10).alias("z"))
        return losses.time_regularization(rows, kind, 1.5).select("batch", "pairs", r("loss").alias("loss"))


_regularizer("FRD")
_regularizer("MRD")


# --- uncertain dissimilarities ----------------------------------------------------------------------------

_MEAN = "CASE WHEN d = 0 THEN 0 WHEN d > 2.0 THEN NULL ELSE d*0.2 - 0.1 END"


@query("linear_dissimilarity", f"""WITH {PAIR_SQL}, {POS_SQL}, p AS (SELECT i, j, sqrt((a.gx-b.gx)**2+(a.gy-b.gy)**2)/10 AS d FROM drawn JOIN pos a ON a.id = i JOIN pos b ON b.id = j),
m AS (SELECT *, {_MEAN} AS m FROM p) SELECT i, j, ROUND(m, 6) + 0.0 AS mean, ROUND(CASE WHEN m = 0 THEN 0 ELSE m*0.1 END, 6) + 0.0 AS variance, m IS NULL AS saturated FROM m""")
def linear_dissimilarity(spark, d):
    at = positions(spark, d)
    pairs = drawn_pairs(spark, d).join(at.select(F.col("id").alias("i"), F.col("gx").alias("ax"), F.col("gy").alias("ay")), "i") \
        .join(at.select(F.col("id").alias("j"), F.col("gx").alias("bx"), F.col("gy").alias("by")), "j")
    way = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2) / 10
    m = G.linear_mean(way, 0.2, -0.1, 2.0)
    v = G.linear_variance(m, 0.1)
    finite = lambda c: F.when(c != float("inf"), r(c))
    return pairs.select("i", "j", finite(m).alias("mean"), finite(v).alias("variance"), (m == float("inf")).alias("saturated"))


@query("smallest_choice", f"WITH {_ABC} SELECT id, CASE WHEN a[1] <= b[1] AND a[1] <= c[1] THEN 0 WHEN b[1] <= c[1] THEN 1 ELSE 2 END AS choice FROM abc")
def smallest_choice(spark, d):
    s = _slices(spark, d)
    return s.select("id", G.smallest_choice([F.col("a")[0], F.col("b")[0], F.col("c")[0]]).alias("choice"))


def _walks(spark, d):
    """Paths of line items: the parts of an order by ship date.  Orders of one item have no hop.

    The time is that of shipping, a hop is as long as the price it starts from, and its kind is the
    larger of discount and tax.
    """
    li = table(spark, d, "lineitem")
    step = F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax")
    items = li.groupBy(F.col("l_orderkey").alias("path_id")).agg(F.sort_array(F.collect_list(step)).alias("s")).filter(F.size("s") > 1)
    last = lambda i: i == F.size("s") - 1
    full = lambda s, i: F.struct(
        i.alias("i"), s["l_partkey"].alias("node"), (F.datediff(s["l_shipdate"], F.lit("1992-01-01").cast("date")) * 0.5).alias("ts"),
        F.when(~last(i), (s["l_discount"] > s["l_tax"]).cast("int")).alias("choice"), F.when(~last(i), s["l_extendedprice"] / 9973).alias("d"))
    return items.select("path_id", F.transform("s", full).alias("steps"))


_WALK_SQL = """li AS (SELECT l_orderkey AS path_id, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) - 1 AS hops, l_partkey AS node,
  date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE))*0.5 AS ts, CAST(l_discount > l_tax AS INT) AS c, l_extendedprice/9973.0 AS w FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax)),
st AS (SELECT path_id, i, hops, node, ts, CASE WHEN i < hops THEN c END AS choice, CASE WHEN i < hops THEN w END AS d FROM li WHERE hops > 0)"""

def _nodes():
    return F.transform("steps", lambda s: s["node"])


def _largest():
    return F.array_max(F.transform("steps", lambda s: s["d"]))


@query("path_contraction", f"""WITH {_WALK_SQL}, k AS (SELECT *, lag(choice) OVER (PARTITION BY path_id ORDER BY i) AS before FROM st),
c AS (SELECT * FROM k WHERE NOT (coalesce(before, 0) = 1 AND coalesce(choice, 0) = 1))
SELECT path_id, CAST(row_number() OVER (PARTITION BY path_id ORDER BY i) - 1 AS INT) AS at, node FROM c""")
def path_contraction(spark, d):
    c = G.contract_steps(_walks(spark, d))
    return c.select("path_id", F.posexplode(F.transform("steps", lambda s: s["node"])).alias("at", "node"))


@query("path_statistics", f"""WITH {_WALK_SQL}, k AS (SELECT *, lag(choice) OVER (PARTITION BY path_id ORDER BY i) AS before FROM st),
c AS (SELECT * FROM k WHERE NOT (coalesce(before, 0) = 1 AND coalesce(choice, 0) = 1)),
h AS (SELECT *, abs(lead(ts) OVER (PARTITION BY path_id ORDER BY i) - ts) AS dt FROM c),
s AS (SELECT path_id, count(*) - 1 AS hops, sum(CASE WHEN choice = 1 THEN dt ELSE 0 END) AS span, sum(CASE WHEN choice = 0 THEN d*0.2 - 0.1 ELSE 0 END) AS lin FROM h GROUP BY path_id)
SELECT path_id, CAST(hops AS INT) AS hops, ROUND(span*1.0 + lin, 6) + 0.0 AS mean, ROUND(span*span*0.2 + lin*0.1, 6) + 0.0 AS variance FROM s""")
def path_statistics(spark, d):
    model = G.GaussianModel(0.2, -0.1, 0.1, None, 1.0, 0.2)
    p = G.path_statistics(G.contract_steps(_walks(spark, d)), model)
    return p.select("path_id", "hops", r("mean").alias("mean"), r("variance").alias("variance"))


@query("path_thinning", f"""WITH {_WALK_SQL}, l AS (SELECT path_id, any_value(hops) AS h, CAST(floor(least(greatest(max(d)/2.0, 1), any_value(hops), 5)) AS INT) AS l FROM st GROUP BY path_id),
k AS (SELECT path_id, k, CASE WHEN k = l THEN h ELSE CAST(floor(k*(h/l)) AS INT) END AS i FROM l, range(6) rk(k) WHERE k <= l)
SELECT k.path_id, CAST(k AS INT) AS at, node FROM k JOIN st ON st.path_id = k.path_id AND st.i = k.i""")
def path_thinning(spark, d):
    thin = _walks(spark, d).select("path_id", G.thin_path(_nodes(), _largest(), F.lit(2.0), 5).alias("nodes"))
    return thin.select("path_id", F.posexplode("nodes").alias("at", "node"))


@query("path_losses", f"""WITH {_WALK_SQL}, z AS (SELECT path_id, i, p_retailprice/1000 AS x, p_size/50.0 AS y FROM st JOIN part ON p_partkey = st.node),
top AS (SELECT path_id, max(d) AS m FROM st GROUP BY path_id),
g AS (SELECT *, sqrt((lead(x) OVER w - x)**2 + (lead(y) OVER w - y)**2 + 1e-6) AS step, first_value(x) OVER f AS xa, first_value(y) OVER f AS ya, last_value(x) OVER f AS xb, last_value(y) OVER f AS yb
  FROM z WINDOW w AS (PARTITION BY path_id ORDER BY i), f AS (PARTITION BY path_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
p AS (SELECT path_id, sum(step) + greatest(16 - count(step), 0)*1e-3 AS len, sum(greatest(step - sqrt((xa-xb)**2+(ya-yb)**2+1e-6), 0)) AS tri FROM g GROUP BY path_id)
SELECT ROUND(avg((len - m)**2/(0.25 + 1e-6)), 6) + 0.0 AS geodesic, ROUND(sum(tri), 6) + 0.0 AS triangle FROM p JOIN top USING (path_id)""")
def path_losses(spark, d):
    paths = _walks(spark, d).select("path_id", _nodes().alias("nodes"), _largest().alias("mean"), F.lit(0.25).alias("variance"))
    at = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 1000).alias("x"), (F.col("p_size") / 50).alias("y"))
    out = losses.path_losses(paths, at, width=16)
    return out.select(r("geodesic").alias("geodesic"), r("triangle").alias("triangle"))
