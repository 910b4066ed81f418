"""Folds over pairs look at a pair's values as seldom and as few at once as they can."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kartograf.operators import evaluation as E
from kartograf.operators import pairs
from kartograf.operators.gaussian import thin_path, with_hops
from kartograf.operators.pairs import Dissimilarity


@pytest.fixture
def here(monkeypatch, spark):
    """Cells are folded in this process, so that calls can be counted; gives the sizes of the distance matrices."""
    def fold(df, run, schema, rows_per_block=0):
        rows = df.toPandas().sort_values("id")
        return spark.createDataFrame(run(rows, rows, True), schema)

    sizes, real = [], Dissimilarity.between
    monkeypatch.setattr(E, "fold_pairs", fold)
    monkeypatch.setattr(Dissimilarity, "between", lambda self, x, y: (sizes.append(len(x) * len(y)), real(self, x, y))[1])
    return sizes


def placed(spark, n):
    rng = np.random.default_rng(8)
    rows = [(i, f.tolist(), p.tolist()) for i, (f, p) in enumerate(zip(rng.random((n, 3)), rng.random((n, 2))))]
    return spark.createDataFrame(rows, "id bigint, f array<double>, p array<double>")


def test_bands_sort_only_values_near_a_wanted_rank(spark, here, monkeypatch):
    seen, real = [], E._Cells.count
    monkeypatch.setattr(E._Cells, "count", lambda self, bins, values, *rest: (seen.append(len(values)), real(self, bins, values, *rest))[1])
    E.pair_bands(placed(spark, 600), Dissimilarity("cityblock"), edges=10)
    assert sum(seen) < 600 * 599 // 2 / 10


def test_histogram_and_stress_hold_few_distances_at_once(spark, here):
    n = 1100
    got = E.pair_histogram_2d(placed(spark, n), Dissimilarity("cityblock"), bins=7)
    assert got.agg(F.sum("n")).first()[0] == n * (n - 1) // 2
    p = placed(spark, n).select("id", *[F.col("f")[k].alias(c) for k, c in enumerate(("gx", "gy", "px"))], F.col("p")[0].alias("py"))
    assert 0 < E.kruskal_stress(p).first()[0] < 1
    assert max(here) <= 512 * 512


def test_audit_meets_patterns_not_rows(spark, monkeypatch):
    met, real = [], pairs.fold_pairs
    monkeypatch.setattr(pairs, "fold_pairs", lambda df, *rest: (met.append(df.count()), real(df, *rest))[1])
    x = np.random.default_rng(1).normal(size=(400, 4))
    x[::3, :2], x[::5, 2:], x[7, 0], x[11, 3], x[13:15, 1], x[20:22] = np.nan, np.nan, np.inf, -np.inf, np.inf, 1e308
    x[21, 0] = -1e308
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, f array<double>")
    above = np.triu_indices(400, 1)
    for metric, joined in (("cityblock", "mean"), ("cityblock", "sum"), ("euclidean", "median"), ("sqeuclidean", "max"), ("chebyshev", "mean")):
        m = Dissimilarity(metric, 2, joined)
        d = m.between(x, x)[above]
        a = pairs.distance_audit(df, m).first()
        assert (a["pairs"], a["nans"], a["infs"]) == (d.size, np.isnan(d).sum(), np.isinf(d).sum())
    assert max(met) < 20


def test_few_thresholds_are_counted_without_rounding_all(monkeypatch):
    rng = np.random.default_rng(2)
    names = rng.permutation(300)
    for d in (rng.integers(0, 5, 300).astype(float), rng.random(300), rng.random(300) * 1e-8, np.full(300, 1e10)):
        asked = rng.choice(300, 6, replace=False)
        own, dst = np.round(d[asked], 9), names[asked]
        by = np.lexsort((dst, own))
        itself = np.array([4, 9])
        want = [sum((v, n) < (t, m) for v, n in zip(np.delete(np.round(d, 9), itself), np.delete(names, itself))) for t, m in zip(own[by], dst[by])]
        assert pairs._nearer(d.copy(), names, itself, own[by], dst[by]).tolist() == want
        monkeypatch.setattr(pairs, "ASKS", 2)
        assert pairs._nearer(d.copy(), names, itself, own[by], dst[by]).tolist() == want
        monkeypatch.undo()


def test_thinned_path_reads_its_nodes_once(spark):
    df = spark.createDataFrame([([5, 6, 7, 8, 9], 3.0), ([1], 2.0), (None, 1.0), ([1, 2, 3], None)], "n array<int>, m double")
    out = df.select(thin_path(F.reverse("n"), F.sqrt(F.col("m") * F.col("m")), F.lit(1.0), 4).alias("t"))
    assert [r["t"] for r in out.collect()] == [[9, 8, 7, 5], [1], None, [3, 1]]
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("reverse(") == 1 and plan.upper().count("SQRT(") == 1


def test_graph_and_rows_are_not_broadcast(spark):
    points = spark.createDataFrame([(i, float(i), [float(i % 3)]) for i in range(9)], "id bigint, ts double, f array<double>")
    edges = spark.createDataFrame([(i, i + 1, 1, 0.5) for i in range(8)], "src bigint, dst bigint, choice int, d double")
    paths = spark.createDataFrame([(1, [0, 1, 2]), (2, [5])], "path_id bigint, nodes array<bigint>")
    hops = with_hops(paths, edges, points)
    assert "BroadcastHashJoin" not in hops._jdf.queryExecution().executedPlan().toString()
    assert {r["path_id"]: [(s["node"], s["choice"]) for s in r["steps"]] for r in hops.collect()} == {1: [(0, 1), (1, 1), (2, None)], 2: [(5, None)]}
