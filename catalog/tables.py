"""Sources, projections, filters, strides and keys."""

from pyspark.sql import functions as F

from catalog.base import (POS_SQL, TAP_SQL, antenna_rows, drawn_pairs, per_tap, points, query, r, seconds, snapshots, table,
                          vectors, PAIR_SQL, MAG_SQL)
from kartograf.functions import arrays, scalars
from kartograf.operators import ordering, sampling
from kartograf.operators import snapshots as S
from kartograf.operators.pairs import Dissimilarity, distance_audit
from kartograf.sources import results, takes


@query("merge_takes", """WITH t AS (SELECT o_orderkey, o_totalprice, o_orderdate, o_custkey,
  CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS take FROM orders WHERE o_orderstatus IN ('P','F','O'))
SELECT row_number() OVER (ORDER BY take, o_orderkey) - 1 AS id, CAST(take AS INT) AS take, o_orderkey,
  ROUND(CASE WHEN o_custkey % 3 <> 0 THEN o_totalprice END, 4) AS toa FROM t""")
def merge_takes(spark, d):
    orders = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), "o_orderkey", "o_orderstatus", F.array("o_totalprice").alias("toa"),
        F.array(F.col("o_custkey") % 3 != 0).alias("valid_mask"))
    parts = [orders.filter(F.col("o_orderstatus") == s).drop("o_orderstatus").withColumn("take", F.lit(p))
             for p, s in enumerate("PFO")]
    merged = takes.merge_takes(parts)
    return merged.select("id", "take", "o_orderkey", F.round(F.get("toa", F.lit(0)), 4).alias("toa"))


@query("stride_sample", """SELECT event_id, user_id, ROUND(value, 6) + 0.0 AS value FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS p
FROM events) WHERE p % 10 = 0""")
def stride_sample(spark, d):
    return ordering.stride(table(spark, d, "events"), 10, "event_id").select("event_id", "user_id", r("value").alias("value"))


@query("dynamic_stride", """SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS p, count(*) OVER () AS n
FROM orders) WHERE p % greatest(n // 5000, 1) = 0""")
def dynamic_stride(spark, d):
    return ordering.stride_to(table(spark, d, "orders"), 5000, "o_orderkey").select("o_orderkey", "o_custkey")


@query("row_positions", """SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events""")
def row_positions(spark, d):
    return ordering.with_position(table(spark, d, "events").select("event_id", "user_id"), "event_id", ["user_id"])


@query("reference_filter", f"WITH {POS_SQL} SELECT id, ROUND(gx, 6) + 0.0 AS gx, ROUND(gy, 6) + 0.0 AS gy FROM pos WHERE valid")
def reference_filter(spark, d):
    s = snapshots(spark, d).filter(S.reference_valid(F.col("interp_diff")))
    return s.select("id", r(F.col("reference")[0]).alias("gx"), r(F.col("reference")[1]).alias("gy"))


@query("antenna_filter", f"""WITH {TAP_SQL} SELECT id, antenna, tap, ROUND(re, 6) + 0.0 AS re, ROUND(im, 6) + 0.0 AS im FROM tap WHERE antenna IN (0, 2, 3)""")
def antenna_filter(spark, d):
    return per_tap(S.keep_antennas(antenna_rows(spark, d), [3, 0, 2]), "re", "im")


@query("relative_time", "SELECT event_id, ROUND(epoch_us(ts)/1e6 - min(epoch_us(ts)/1e6) OVER (), 4) + 0.0 AS ts FROM events")
def relative_time(spark, d):
    rows = table(spark, d, "events").select("event_id", seconds().alias("ts"))
    return S.relative_time(rows).select("event_id", r("ts", 4).alias("ts"))


@query("hide_invalid", f"WITH {TAP_SQL} SELECT id, antenna, ROUND(CASE WHEN valid THEN toa END, 6) + 0.0 AS toa FROM tap WHERE tap = 0")
def hide_invalid(spark, d):
    a = antenna_rows(spark, d)
    return a.select("id", "antenna", r(S.blank_invalid(F.col("toa"), F.col("valid"))).alias("toa"))


@query("zero_invalid", f"WITH {TAP_SQL} SELECT id, antenna, tap, ROUND(CASE WHEN valid THEN re ELSE 0 END, 6) + 0.0 AS re FROM tap")
def zero_invalid(spark, d):
    a = antenna_rows(spark, d)
    return per_tap(a.withColumn("re", S.zero_invalid(F.col("re"), F.col("valid"))), "re")


@query("replace_missing", "SELECT event_id, ROUND(CASE WHEN event_type = 'error' THEN 0 ELSE value END, 6) + 0.0 AS value FROM events")
def replace_missing(spark, d):
    e = table(spark, d, "events")
    broken = F.when(F.col("event_type") == "error", float("nan")).otherwise(F.col("value"))
    return e.select("event_id", r(arrays.replace_missing(broken)).alias("value"))


@query("optional_column", "SELECT event_id, ROUND(value, 6) + 0.0 AS value, CAST(NULL AS DOUBLE) AS toa, CAST(value AS FLOAT) AS value32 FROM events")
def optional_column(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", r("value").alias("value"), S.optional(e, "toa", "double").alias("toa"),
                    F.col("value").cast("float").alias("value32"))


@query("flatten_features", "SELECT vec_id AS id, CAST(k AS INT) AS k, ROUND(CAST(embedding[k+1] AS DOUBLE), 6) + 0.0 AS v FROM embeddings, range(64) rk(k)")
def flatten_features(spark, d):
    flat = F.flatten(F.flatten("cir"))
    return snapshots(spark, d).select("id", F.posexplode(flat).alias("k", "v")).select("id", "k", r("v").alias("v"))


@query("data_shape", "SELECT CAST(2 AS INT) AS channels, CAST(4 AS INT) AS antennas, CAST(8 AS INT) AS taps, count(*) AS n FROM embeddings")
def data_shape(spark, d):
    return snapshots(spark, d).select(*S.shape(F.col("cir"))).groupBy("channels", "antennas", "taps").agg(F.count("*").alias("n"))


@query("cache_keys", "SELECT vec_id AS id, sha256('{\"label\": ' || label || ', \"seed\": ' || vec_id || '}') AS key FROM embeddings")
def cache_keys(spark, d):
    text = F.concat(F.lit('{"label": '), F.col("label"), F.lit(', "seed": '), F.col("id"), F.lit("}"))
    return vectors(spark, d).select("id", results.cache_key_column(text).alias("key"))


@query("condensed_index", f"""WITH {PAIR_SQL}, k AS (SELECT i, j, least(i, j) AS lo, greatest(i, j) AS hi, (SELECT count(*) FROM embeddings) AS n FROM drawn)
SELECT i, j, CASE WHEN i <> j THEN CAST(n*lo - lo*(lo+1)//2 + hi - lo - 1 AS BIGINT) END AS idx FROM k""")
def condensed_index(spark, d):
    n = vectors(spark, d).count()
    p = sampling.pair_key(drawn_pairs(spark, d))
    return p.select("i", "j", F.when(F.col("i") != F.col("j"), scalars.condensed_index(F.col("low"), F.col("high"), n)).alias("idx"))


@query("distance_audit", f"""WITH {MAG_SQL}, p AS (SELECT len(list_filter(range(1,5), lambda k: a.ok[k] AND b.ok[k])) AS known
FROM mag a JOIN mag b ON a.id < b.id) SELECT count(*) AS pairs, count(*) FILTER (known = 0) AS nans, CAST(0 AS BIGINT) AS infs FROM p""")
def audit(spark, d):
    """Pairs without a common antenna, over all pairs; only counts leave the tasks."""
    return distance_audit(points(spark, d, masked=True), Dissimilarity("cityblock", 4, "mean"))


@query("training_schedule", """SELECT p_partkey AS run, CAST(round_even(round_even((p_size*60)/3000.0*3500+500, 0)/200.0, 0)*200 AS BIGINT) AS batch_rows,
ROUND(pow((p_size*60)/3000.0, 0.15)*(1.0-20.0)+20.0, 6) + 0.0 AS hop_limit FROM part""")
def training_schedule(spark, d):
    """Schedules at the step that each part's size stands for."""
    step = F.col("p_size") * 60
    return table(spark, d, "part").select(F.col("p_partkey").alias("run"), scalars.batch_rows(step, 3000, 500, 4000).alias("batch_rows"),
                                    r(scalars.hop_length_limit(step, 3000, 1.0, 20.0)).alias("hop_limit"))
