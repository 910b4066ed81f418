"""How the given tables stand for recordings, in Spark and as SQL text.

* ``embeddings`` is the channel tensor: element ``r*32 + a*8 + t`` is channel r, antenna a, tap t.
  Antenna a of row v is valid unless (v + a) is a multiple of 5.  Elements 1-4, times 100, are the
  reference and the predicted position in metres.
* ``events`` is the time series: one series per user, two taps, invalid when the type is ``error``.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kartograf.operators import sampling
from kartograf.operators.graph import undirected
from kartograf.operators.pairs import Dissimilarity, features, nearest_neighbors
from kartograf.session import cut, ship

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}

ANTENNAS, TAPS = 4, 8
CIRA = Dissimilarity("cityblock", ANTENNAS, "mean")


def query(name: str, sql: str | None = None):
    def add(run):
        def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            ship(spark)
            return run(spark, sf_dir)

        shipped.__name__ = name
        shipped.__doc__ = run.__doc__
        QUERIES[name] = (shipped, sql)
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(value, digits: int = 6):
    """Rounded, with negative zero made zero, so that engines can be compared."""
    return F.round(value if not isinstance(value, str) else F.col(value), digits) + F.lit(0.0)


def seconds(ts: str = "ts"):
    return F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1e6)


def vectors(spark, d) -> DataFrame:
    """(id, e ARRAY<DOUBLE>, label)"""
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("e"), "label")


def snapshots(spark, d) -> DataFrame:
    """Wide snapshots: id, cir, valid_mask, reference, interp_diff."""
    e = F.col("e")
    channel = lambda c: F.array(*[F.slice(e, c * 32 + a * TAPS + 1, TAPS) for a in range(ANTENNAS)])
    return vectors(spark, d).select(
        "id", F.array(channel(0), channel(1)).alias("cir"),
        F.array(*[(F.col("id") + a) % 5 != 0 for a in range(ANTENNAS)]).alias("valid_mask"),
        F.array(e[1] * 100, e[2] * 100).alias("reference"),
        F.array(F.abs(e[5]) * 5, F.abs(e[6]) * 5).alias("interp_diff"),
        F.array(*[e[8 + a] * 10 for a in range(ANTENNAS)]).alias("toa"), "e", "label")


def timed_snapshots(spark, d) -> DataFrame:
    """Snapshots with the time of the event of the same number."""
    ev = table(spark, d, "events").select(F.col("event_id").alias("id"), seconds().alias("ts"))
    return snapshots(spark, d).join(ev, "id")


def antenna_rows(spark, d) -> DataFrame:
    """(id, antenna, valid, re, im)"""
    s = snapshots(spark, d)
    zipped = F.arrays_zip(s.cir[0].alias("re"), s.cir[1].alias("im"), s.valid_mask.alias("valid"), s.toa.alias("toa"))
    return s.select("id", F.posexplode(zipped).alias("antenna", "z")).select(
        "id", "antenna", "z.valid", "z.toa", "z.re", "z.im")


def per_tap(df: DataFrame, *columns: str) -> DataFrame:
    """(id, antenna, tap, column...) from tap arrays."""
    zipped = F.arrays_zip(*[F.col(c) for c in columns])
    return df.select("id", "antenna", F.posexplode(zipped).alias("tap", "z")).select(
        "id", "antenna", "tap", *[r(F.col(f"z.{c}")).alias(c) for c in columns])


def event_rows(spark, d) -> DataFrame:
    """Events as antenna rows: the series is the user, two taps, time in hours."""
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), (seconds() / 3600.0).alias("ts"), F.col("user_id").alias("antenna"),
        (F.col("event_type") != "error").alias("valid"),
        F.array(F.col("value") - 20.1237, F.col("event_id") % 7 - 3.1).alias("re"),
        F.array(F.col("event_id") % 11 - 5.25, F.col("value") / 10.0 + 0.01).alias("im"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("toa"))


def magnitudes(spark, d, masked: bool = False) -> DataFrame:
    """(id, vec ARRAY<ARRAY<DOUBLE>>) of tap magnitudes; masked antennas are NULL."""
    s = snapshots(spark, d)
    mag = F.zip_with(s.cir[0], s.cir[1], lambda x, y: F.zip_with(x, y, lambda a, b: F.sqrt(a * a + b * b)))
    if masked:
        mag = F.zip_with(mag, s.valid_mask, lambda m, ok: F.when(ok, m))
    return s.select("id", mag.alias("vec"))


def points(spark, d, masked: bool = False) -> DataFrame:
    return features(magnitudes(spark, d, masked), "vec", "id", ANTENNAS, TAPS)


def positions(spark, d) -> DataFrame:
    """(id, gx, gy, px, py, valid)"""
    e = F.col("e")
    return vectors(spark, d).select(
        "id", (e[1] * 100).alias("gx"), (e[2] * 100).alias("gy"), (e[3] * 100).alias("px"), (e[4] * 100).alias("py"),
        (F.abs(e[5]) * 5 + F.abs(e[6]) * 5 < 1).alias("valid"))


def neighbor_graph(spark, d, k: int = 20) -> DataFrame:
    """Undirected neighbour graph of the magnitudes, written once."""
    near = nearest_neighbors(points(spark, d), k, CIRA)
    return cut(undirected(near.select("src", "dst", F.col("d").alias("w"))))


def drawn_pairs(spark, d, seed: int = 7) -> DataFrame:
    return sampling.draw_pairs(vectors(spark, d).select("id"), seed)


# --- the same as SQL ---------------------------------------------------------------------------------

TAP_SQL = """tap AS (SELECT vec_id AS id, CAST(a AS INT) AS antenna, CAST(t AS INT) AS tap,
  CAST(embedding[a*8+t+1] AS DOUBLE) AS re, CAST(embedding[32+a*8+t+1] AS DOUBLE) AS im,
  (vec_id + a) % 5 <> 0 AS valid, CAST(embedding[9+a] AS DOUBLE)*10 AS toa
  FROM embeddings, range(4) ra(a), range(8) rt(t))"""

POS_SQL = """pos AS (SELECT vec_id AS id, CAST(embedding[2] AS DOUBLE)*100 AS gx, CAST(embedding[3] AS DOUBLE)*100 AS gy,
  CAST(embedding[4] AS DOUBLE)*100 AS px, CAST(embedding[5] AS DOUBLE)*100 AS py,
  abs(CAST(embedding[6] AS DOUBLE))*5 + abs(CAST(embedding[7] AS DOUBLE))*5 < 1 AS valid FROM embeddings)"""

EVENT_SQL = """ev AS (SELECT event_id AS id, epoch_us(ts)/1e6/3600.0 AS ts, user_id AS antenna, event_type <> 'error' AS valid,
  value - 20.1237 AS re0, CAST(event_id % 7 AS DOUBLE) - 3.1 AS re1, CAST(event_id % 11 AS DOUBLE) - 5.25 AS im0, value/10.0 + 0.01 AS im1,
  CASE WHEN event_type <> 'error' THEN value END AS toa FROM events)"""

MAG_SQL = """mag AS (SELECT vec_id AS id, list_transform(range(0,4), lambda a: list_transform(range(0,8), lambda t:
  sqrt(CAST(embedding[a*8+t+1] AS DOUBLE)**2 + CAST(embedding[32+a*8+t+1] AS DOUBLE)**2))) AS vec,
  list_transform(range(0,4), lambda a: (vec_id + a) % 5 <> 0) AS ok FROM embeddings)"""


def draw_sql(key: str, seed: int) -> str:
    return f"CAST('0x' || substr(md5(CAST(CAST({key} AS BIGINT) AS VARCHAR) || ':{seed}'), 1, 15) AS BIGINT)"


def pick_sql(key: str, seed: int, n: str) -> str:
    return f"{draw_sql(key, seed)} % ({n})"


PAIR_SQL = f"""rowno AS (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) - 1 AS p, count(*) OVER () AS n FROM embeddings),
drawn AS (SELECT a.id AS i, b.id AS j FROM (SELECT id, {pick_sql('p', 7, 'n - 1')} AS at FROM rowno) a JOIN rowno b ON b.p = a.at)"""

CIRA_SQL = f"""{MAG_SQL}, cira AS (SELECT a.id AS i, b.id AS j, list_sum(list_transform(range(1,5), lambda k:
  list_sum(list_transform(range(1,9), lambda t: abs(a.vec[k][t] - b.vec[k][t])))))/4 AS d FROM mag a JOIN mag b ON a.id <> b.id)"""

GRAPH_SQL = f"""{CIRA_SQL},
knn AS (SELECT i, j, round(d, 9) AS d, row_number() OVER (PARTITION BY i ORDER BY round(d, 9), j) AS rank FROM cira
  QUALIFY row_number() OVER (PARTITION BY i ORDER BY round(d, 9), j) <= 20),
edge AS MATERIALIZED (SELECT i, j, min(d) AS w FROM (SELECT i, j, d FROM knn UNION ALL SELECT j, i, d FROM knn) GROUP BY i, j)"""

PATH_SQL = f"""{GRAPH_SQL},
sp(src, dst, d) USING KEY (src, dst) AS (SELECT id, id, CAST(0 AS DOUBLE) FROM mag
  UNION (SELECT s.src, e.j, min(s.d + e.w) FROM sp s JOIN edge e ON s.dst = e.i
    LEFT JOIN recurring.sp q ON q.src = s.src AND q.dst = e.j WHERE q.d IS NULL OR s.d + e.w < q.d GROUP BY s.src, e.j))"""
