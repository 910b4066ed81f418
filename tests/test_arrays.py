import numpy as np
import pytest
from pyspark.sql import functions as F

from kartograf.functions import arrays, scalars
from kartograf.operators.pairs import Dissimilarity

RNG = np.random.default_rng(0)


@pytest.fixture(scope="module")
def vectors(spark):
    x, y = RNG.random((12, 6)) + 0.1, RNG.random((12, 6)) + 0.1
    x[0, 2] = y[0, 2]
    rows = [(i, x[i].tolist(), y[i].tolist()) for i in range(12)]
    return x, y, spark.createDataFrame(rows, "id bigint, x array<double>, y array<double>")


@pytest.mark.parametrize("metric", list(arrays.METRICS))
def test_column_and_block_metrics_agree(vectors, metric):
    x, y, df = vectors
    params = {"p": 3.0} if metric == "minkowski" else {}
    got = df.select("id", arrays.METRICS[metric](F.col("x"), F.col("y"), **params).alias("d")).toPandas().sort_values("id")
    want = np.diag(Dissimilarity(metric, 1, "sum", params).between(x, y))
    np.testing.assert_allclose(got["d"], want, atol=1e-12)


def test_known_distances(vectors):
    x, y, _ = vectors
    np.testing.assert_allclose(Dissimilarity("cityblock").between(x, y)[1, 2], np.abs(x[1] - y[2]).sum())
    u, v = x[1] - x[1].mean(), y[2] - y[2].mean()
    np.testing.assert_allclose(Dissimilarity("correlation").between(x, y)[1, 2], 1 - u @ v / np.linalg.norm(u) / np.linalg.norm(v))
    p, q = x[1] / x[1].sum(), y[2] / y[2].sum()
    m = (p + q) / 2
    np.testing.assert_allclose(Dissimilarity("jensenshannon").between(x, y)[1, 2],
                               np.sqrt(((p * np.log(p / m)).sum() + (q * np.log(q / m)).sum()) / 2))


def test_aggregations_skip_missing_antennas():
    a = np.array([[1.0, 2.0, np.nan, np.nan, 3.0, 5.0]])
    b = np.array([[2.0, 4.0, 7.0, 8.0, 3.0, 9.0]])
    got = {k: Dissimilarity("cityblock", 3, k).between(a, b)[0, 0] for k in ("sum", "mean", "max", "median")}
    assert got == {"sum": 7.0, "mean": 3.5, "max": 4.0, "median": 3.5}
    blank = np.full((1, 6), np.nan)
    assert Dissimilarity("cityblock", 3, "sum").between(blank, b)[0, 0] == 0
    assert np.isnan(Dissimilarity("cityblock", 3, "mean").between(blank, b)[0, 0])


@pytest.mark.parametrize("bins", [6, 9, 4])
def test_transform_matches_fft(vectors, bins):
    x, y, df = vectors
    got = df.select("id", arrays.dft(F.col("x"), F.col("y"), 6, bins).alias("z")).select("id", "z.*").toPandas().sort_values("id")
    want = np.fft.fft(x + 1j * y, n=bins)
    np.testing.assert_allclose(np.stack(got["re"]) + 1j * np.stack(got["im"]), want, atol=1e-9)


def test_whole_delay_is_rotation_and_delay_back_is_identity(vectors):
    x, y, df = vectors
    got = df.select("id", arrays.delay_taps(F.col("x"), F.col("y"), F.lit(2.0), 6)["re"].alias("re")).toPandas().sort_values("id")
    np.testing.assert_allclose(np.stack(got["re"]), np.roll(x, 2, axis=1), atol=1e-9)
    once = df.select("id", F.slice("x", 1, 5).alias("x"), F.slice("y", 1, 5).alias("y"))
    for delay in (0.3, 1.7):
        there = once.select("id", arrays.delay_taps(F.col("x"), F.col("y"), F.lit(delay), 5).alias("z")).select("id", "z.*")
        back = there.select("id", arrays.delay_taps(F.col("re"), F.col("im"), F.lit(-delay), 5)["re"].alias("x"))
        np.testing.assert_allclose(np.stack(back.toPandas().sort_values("id")["x"]), x[:, :5], atol=1e-9)


def test_transforms_keep_missing_antennas_and_taps(spark):
    rows = [(1, [[1.0, 2.0, 3.0], None], [[0.5, 0.0, -1.0], None], 1.0), (2, [[1.0, None, 3.0], [4.0, 5.0, 6.0]], [[0.0, 0.0, 0.0], [1.0, 1.0, 1.0]], None),
            (3, None, None, 0.5), (4, [[7.0, 8.0, 9.0]], [[0.0, 0.0, 0.0]], 0.5)]
    df = spark.createDataFrame(rows, "id int, x array<array<double>>, y array<array<double>>, delay double").repartition(2)
    got = {r["id"]: r["z"] for r in df.select("id", arrays.dft_rows(F.col("x"), F.col("y"), 3, 5).alias("z")).collect()}
    want = np.fft.fft(np.array([1 + 0.5j, 2, 3 - 1j]), n=5)
    np.testing.assert_allclose(np.array(got[1]["re"][0]) + 1j * np.array(got[1]["im"][0]), want, atol=1e-12)
    assert got[1]["re"][1] is None and got[2]["re"][0] == [None] * 5 and got[3]["re"] is None and len(got[4]["im"]) == 1
    np.testing.assert_allclose(np.array(got[2]["im"][1]), np.fft.fft(np.array([4, 5, 6]) + 1j, n=5).imag, atol=1e-12)
    first = df.select("id", F.get("x", F.lit(0)).alias("x"), F.get("y", F.lit(0)).alias("y"), "delay")
    moved = {r["id"]: r["z"] for r in first.select("id", arrays.delay_taps(F.col("x"), F.col("y"), F.col("delay"), 3).alias("z")).collect()}
    assert moved[2] is None and moved[3] is None
    np.testing.assert_allclose(moved[1]["re"], [3.0, 1.0, 2.0], atol=1e-12)
    assert first.limit(0).select(arrays.dft(F.col("x"), F.col("y"), 3).alias("z")).count() == 0


def test_condensed_index_counts_the_upper_triangle(spark):
    n = 4
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]
    df = spark.createDataFrame(pairs, "i bigint, j bigint")
    got = [r[0] for r in df.orderBy("i", "j").select(scalars.condensed_index(F.col("i"), F.col("j"), n)).collect()]
    assert got == list(range(6))


def test_learning_rates():
    assert scalars.cosine_with_warmup(0, 1.0, 0.1, 5, 50) == pytest.approx(0.1)
    assert scalars.cosine_with_warmup(5, 1.0, 0.1, 5, 50) == pytest.approx(1.0)
    assert scalars.cosine_with_warmup(50, 1.0, 0.1, 5, 50) == pytest.approx(0.0)
