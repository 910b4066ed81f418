import numpy as np
import pytest
from pyspark.sql import functions as F

from kartograf.operators import ordering, series

RNG = np.random.default_rng(3)


def rows(spark, values, valid=None, ts=None, im=None):
    n = len(values)
    valid = valid if valid is not None else [True] * n
    ts = ts if ts is not None else list(range(n))
    data = [(i, float(ts[i]), 0, bool(valid[i]), [float(values[i])]) for i in range(n)]
    return spark.createDataFrame(data, "id bigint, ts double, antenna int, valid boolean, re array<double>")


def test_positions_and_segments_do_not_depend_on_chunks(spark):
    n = 300
    user = RNG.integers(0, 4, n)
    user[50:250] = 1  # one series holds most rows
    ts = np.cumsum(RNG.exponential(1.0, n))
    df = spark.createDataFrame([(i * 7, int(user[i]), float(ts[i])) for i in range(n)], "id bigint, u int, ts double").repartition(5)
    got = ordering.with_segments(df, "id", "ts", 2.5, ["u"], rows_per_chunk=23).toPandas()
    assert len(got) == n
    for u, part in got.sort_values("id").groupby("u"):
        t = part["ts"].to_numpy()
        assert (part["pos"].to_numpy() == np.arange(len(t))).all()
        seg = np.concatenate([[0], np.cumsum(np.diff(t) > 2.5)])
        assert (part["seg"].to_numpy() == seg).all()
        start = np.searchsorted(seg, seg)
        assert (part["seg_start"].to_numpy() == start).all()
        assert (part["seg_len"].to_numpy() == np.bincount(seg)[seg]).all()
    again = ordering.with_position(df, "id", ["u"], "p", rows_per_chunk=40).toPandas().set_index("id")["p"]
    assert (got.set_index("id")["pos"] == again.loc[got["id"]].to_numpy()).all()


def test_gap_must_be_exceeded(spark):
    df = rows(spark, [0] * 5, ts=[0, 1, 2, 2.5, 5])
    got = [r["seg"] for r in ordering.with_segments(df, "id", "ts", 1.0, ["antenna"]).orderBy("id").collect()]
    assert got == [0, 0, 0, 0, 1]


def test_stride(spark):
    df = spark.range(0, 100, 3)
    got = sorted(r["id"] for r in ordering.stride(df, 5, "id", rows_per_chunk=7).collect())
    assert got == list(range(0, 100, 15))


def test_even_kernel_reaches_ahead(spark):
    got = series.kernel_moving_average(rows(spark, [1, 3, 5]), 1, 2, max_time_diff=None).orderBy("id").collect()
    assert [r["re"][0] for r in got] == [2.0, 4.0, 5.0]


def test_mask_is_skipped(spark):
    got = series.kernel_moving_average(rows(spark, [1, 99, 5], [True, False, True]), 1, 3).orderBy("id").collect()
    assert [r["re"][0] for r in got] == [1.0, 3.0, 5.0]
    assert all(r["valid"] for r in got)


@pytest.mark.parametrize("mode,k", [("mean", 4), ("mean", 7), ("exponential", 5), ("exponential", 6)])
def test_smoothing_matches_convolution_over_blocks(spark, mode, k):
    n = 90
    x, ok = RNG.normal(size=n), RNG.random(n) > 0.3
    df = rows(spark, x, ok)
    out = series.kernel_moving_average(df, 1, k, mode=mode, max_time_diff=None, rows_per_chunk=17, rows_per_block=11)
    got = np.array([r["re"][0] if r["re"] else np.nan for r in out.orderBy("id").collect()])
    raw = np.ones(k) if mode == "mean" else (1 - 2 / (k + 1)) ** np.arange(k)
    before = (k - 1) // 2
    want = np.full(n, np.nan)
    for i in range(n):
        top = weight = 0.0
        for o in range(k):
            j = i - before + o
            if 0 <= j < n and ok[j]:
                top, weight = top + raw[o] * x[j], weight + raw[o]
        if weight:
            want[i] = top / weight
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_constant_signal_is_kept_with_its_phase(spark):
    df = rows(spark, [3.0] * 20).withColumn("im", F.array(F.lit(-4.0)))
    for out in (series.kernel_moving_average(df, 1, 6, 3), series.temporal_moving_average(df, 1, 5.0, 3.0, "exponential", sampling_frequency=1.0)):
        got = out.collect()
        assert len(got) == 20
        for r in got:
            assert r["re"][0] == pytest.approx(3.0) and r["im"][0] == pytest.approx(-4.0)


def test_phase_is_averaged_on_the_circle(spark):
    angle = np.deg2rad([179.0, -179.0])
    df = spark.createDataFrame([(i, float(i), 0, True, [float(np.cos(a))], [float(np.sin(a))]) for i, a in enumerate(angle)],
                               "id bigint, ts double, antenna int, valid boolean, re array<double>, im array<double>")
    first = series.kernel_moving_average(df, 1, 2, max_time_diff=None).orderBy("id").first()
    assert first["re"][0] == pytest.approx(-1.0) and abs(first["im"][0]) < 1e-9


def scalar_rows(spark, values, ts=None):
    ts = ts if ts is not None else range(len(values))
    data = [(i, float(t), 0, None if v is None else float(v)) for i, (v, t) in enumerate(zip(values, ts))]
    return spark.createDataFrame(data, "id bigint, ts double, antenna int, toa double")


def test_interpolation(spark):
    df = ordering.with_segments(scalar_rows(spark, [None, 1, None, 3, None]), "id", "ts", None, ["antenna"])
    for block in (100, 2, 1):
        got = [r["toa"] for r in series.interpolate(df, "toa", ["antenna", "seg"], block).orderBy("id").collect()]
        assert got == [1.0, 1.0, 2.0, 3.0, 3.0]
    empty = ordering.with_segments(scalar_rows(spark, [None, None]), "id", "ts", None, ["antenna"])
    assert [r["toa"] for r in series.interpolate(empty, "toa", ["antenna", "seg"]).collect()] == [None, None]


@pytest.mark.parametrize("kind,k", [("mean", 5), ("mean", 6), ("median", 4), ("median", 7), ("mean", 31)])
def test_filters_mirror_the_edges(spark, kind, k):
    n = 12
    x = RNG.normal(size=n)
    out = series.tdoa_filter(scalar_rows(spark, x), k, None, kind, rows_per_block=5)
    got = np.array([r["toa"] for r in out.orderBy("id").collect()])
    mirror = lambda p: (lambda r: r if r < n else 2 * n - 1 - r)(p % (2 * n))
    before = (k - 1) // 2 if kind == "mean" else k // 2
    windows = [[x[mirror(i - before + o)] for o in range(k)] for i in range(n)]
    want = [np.mean(w) if kind == "mean" else sorted(w)[k // 2] for w in windows]
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_displacement_is_a_prefix_sum(spark):
    ts = np.cumsum(RNG.random(50))
    df = spark.createDataFrame([(i, float(t)) for i, t in enumerate(ts)], "id bigint, ts double")
    got = series.cumulative_displacement(df, 2.0, rows_per_chunk=8).orderBy("id").toPandas()["displacement"]
    np.testing.assert_allclose(got, 2 * (ts - ts[0]), atol=1e-9)


def test_acceleration_matches_differences(spark):
    n = 64
    p, ts = RNG.normal(size=(n, 2)), np.cumsum(RNG.random(n) + 0.1)
    df = spark.createDataFrame([(i, float(ts[i]), float(p[i, 0]), float(p[i, 1])) for i in range(n)], "id bigint, ts double, x double, y double")
    got = series.accelerations(df, 3, 1, rows_per_chunk=10, rows_per_block=4).orderBy("id").toPandas()["acceleration_sq"]
    q, t = p[1::3], ts[1::3]
    v = np.diff(q, axis=0) / np.diff(t)[:, None]
    a = np.diff(v, axis=0) / np.diff(t)[:-1, None]
    np.testing.assert_allclose(got, (a ** 2).sum(axis=1), rtol=1e-9)
