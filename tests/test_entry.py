"""The registered queries: contract, plans, and a spot check against their SQL."""

import contextlib
import io

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, compare

SMALL = "/root/testdata/sf0.001"


def plan(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.oracle_sql()) > 90


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["src", "dst", "d", "rank"] and df.count() == 500 * 20


@pytest.mark.parametrize("name", ["iq_to_abs", "norm_max_set", "gap_segments", "kernel_average_phase", "signature_scalar", "error_quantiles",
                                  "hexbin_error", "path_statistics", "triplet_loss", "tdoa_positions", "merge_takes"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = entry.queries()[name](spark, SMALL).toPandas()
    assert compare(got, con.execute(entry.oracle_sql()[name]).fetch_df()) == ""


@pytest.mark.parametrize("name", ["merge_takes", "kernel_average", "arrival_median_filter", "cira_neighbors", "siamese_pairs", "time_triplets",
                                  "kruskal_stress", "geodesic_pairs", "hexbin_error"])
def test_plans_have_no_cartesian_product(spark, name):
    text = plan(entry.queries()[name](spark, SMALL))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scan_reads_only_what_is_used(spark):
    text = plan(entry.queries()["stride_sample"](spark, SMALL))
    reads = [line for line in text.splitlines() if "ReadSchema" in line]
    assert reads and all("props" not in line and "event_type" not in line for line in reads)


def test_copies_are_limited_before_the_shuffle(spark):
    from kartograf.operators.ordering import with_position
    from pyspark.sql import Window as W, functions as F

    df = spark.range(10).select("id", F.array((F.col("id") % 3).cast("double")).alias("f"))
    w = W.partitionBy(F.xxhash64("f"), "f").orderBy("id")
    assert "WindowGroupLimit" in plan(df.withColumn("m", F.row_number().over(w)).filter("m <= 3"))
    assert with_position(df, "id").count() == 10
