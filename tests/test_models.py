"""Sampling, positions, scores, learners, uncertain paths and reductions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kartograf.operators import evaluation as E
from kartograf.operators import gaussian as G
from kartograf.operators import losses, multilateration as M, networks as N, reduction as R, sampling
from kartograf.operators import snapshots as S
from kartograf.operators.pairs import Dissimilarity

RNG = np.random.default_rng(11)


# --- sampling ---------------------------------------------------------------------------------------


def test_draws_reach_far_and_seeds_share_nothing(spark):
    from kartograf.functions.scalars import pick

    n = 1 << 40
    got = np.array([list(r) for r in spark.range(2000).select(*[pick(F.col("id"), s, n) for s in (1, 2)], pick(F.col("id"), 1, 2048), pick(F.col("id"), 2, 2048)).collect()])
    assert (got[:, :2] > 1 << 31).mean() > 0.99 and (got[:, 0] == got[:, 1]).sum() == 0
    assert (got[:, 2] == got[:, 3]).mean() < 0.01 and np.bincount((got[:, 3] - got[:, 2]) % 2048).max() < 12


def test_pairs_never_draw_the_last_row_and_repeat(spark):
    df = spark.range(0, 200, 2)
    a = {r["i"]: r["j"] for r in sampling.draw_pairs(df, 4, rows_per_chunk=13).collect()}
    b = {r["i"]: r["j"] for r in sampling.draw_pairs(df.repartition(7), 4).collect()}
    assert a == b and len(a) == 100 and max(a.values()) < 198 and len(set(a.values())) > 50


def test_triplets(spark):
    ts = [0.0, 1.0, 1.5, 9.0, 20.0, 20.5]
    df = spark.createDataFrame(list(enumerate(ts)), "id bigint, ts double")
    got = {r["anchor"]: r for r in sampling.draw_triplets(df, 2.0, 1.0, rows_per_chunk=3, rows_per_block=2).collect()}
    assert got[0]["positive"] in (1, 2) and got[1]["positive"] in (0, 2)
    assert got[3]["positive"] == 2  # nothing within two seconds: the nearest in time among two rows on each side
    assert got[4]["positive"] == 5 and all(0 <= r["negative"] <= 5 for r in got.values())
    alone = sampling.draw_triplets(df.limit(1), 2.0, 1.0).first()
    assert alone["positive"] == alone["anchor"]


def test_exact_sample(spark):
    df = spark.range(1000)
    s = [r["id"] for r in sampling.sample_exact(df, 0.2357, rows_per_chunk=90).collect()]
    assert len(s) == 235 == len(set(s)) and 400 < np.mean(s) < 600


def test_mask_keeps_at_least_k(spark):
    df = spark.range(50).select("id", F.array(F.array_repeat(F.array(F.lit(1.0)), 6)).alias("inputs"),
                                F.array(*[F.lit(a != 2) for a in range(6)]).alias("valid_mask"))
    masks = [r["valid_mask"] for r in S.drop_antennas_to(df, 2, 1).collect()]
    assert all(sum(m) >= 2 and not m[2] for m in masks) and len({tuple(m) for m in masks}) > 5
    none = S.drop_antennas_to(df, 5, 1).first()["valid_mask"]
    assert sum(none) == 5
    extra = S.drop_antennas_to(df.withColumn("inputs2", F.col("inputs")), 3, 1, "thin").first()
    assert extra["thin"] is not None and sum(extra["thin2"]) >= 3


# --- positions ---------------------------------------------------------------------------------------


def test_positions_survive_a_late_receiver_and_missing_ones(spark):
    place = np.c_[RNG.uniform(20, 80, 40), RNG.uniform(10, 35, 40), np.full(40, 0.86)]
    way = np.linalg.norm(place[:, None] - np.array(M.RECEIVERS)[None], axis=2)
    toa = (way - way[:, :1]) / 3e8
    toa[:15, 4] += 40 / 3e8
    toa[20, 2:] = np.nan
    df = spark.createDataFrame([(i, [None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(toa)],
                               "id bigint, toa array<double>")
    got = M.locate(df, speed_of_signal=3e8, fixed_value=0.86, inlier_threshold=6).orderBy("id").collect()
    for i, r in enumerate(got):
        if i == 20:
            assert not r["success"] and r["x"] is None and not any(r["inliers"])
        else:
            assert abs(r["x"] - place[i, 0]) < 1e-4 and abs(r["y"] - place[i, 1]) < 1e-4 and r["inliers"][4] == (i >= 15)
    assert M.success_rate(M.locate(df, speed_of_signal=3e8)).first()[0] == pytest.approx(39 / 40)


def test_position_stream(spark, tmp_path):
    from kartograf.streaming.positions import position_stream

    way = np.linalg.norm(np.array([50.0, 20.0, 0.86]) - np.array(M.RECEIVERS), axis=1)
    rows = [(i, [float(v) for v in (way - way[0]) / 3e8]) for i in range(4)]
    spark.createDataFrame(rows, "id bigint, toa array<double>").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id bigint, toa array<double>").parquet(str(tmp_path / "in"))
    query = position_stream(stream, fixed_value=0.86).writeStream.format("memory").queryName("located").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("located").filter("abs(x - 50) < 1e-3 and abs(y - 20) < 1e-3").count() == 4


# --- scores ------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def chart(spark):
    g = RNG.normal(size=(120, 2)) * [30, 10]
    p = g @ np.array([[0.4, -0.3], [0.2, 0.9]]) + [5, -2]
    noisy = g + RNG.normal(size=g.shape) * 4
    rows = [(i, *map(float, (*g[i], *p[i], *noisy[i])), True) for i in range(120)]
    return g, noisy, spark.createDataFrame(rows, "id bigint, gx double, gy double, px double, py double, nx double, ny double, valid boolean").persist()


def test_affine_map_is_undone(chart):
    e = E.with_error(E.align_affine(chart[2])).agg(F.max("error")).first()[0]
    assert e < 1e-9


def test_stress_ignores_scale_and_matches_matrix(chart, spark):
    g, noisy, df = chart
    same = E.kruskal_stress(df.withColumn("px", F.col("gx") * 3).withColumn("py", F.col("gy") * 3)).first()[0]
    assert same < 1e-6
    d = np.linalg.norm(g[:, None] - g[None], axis=2)
    e = np.linalg.norm(noisy[:, None] - noisy[None], axis=2)
    b = (d * e).sum() / (e * e).sum()
    got = E.kruskal_stress(df, pred=("nx", "ny"), rows_per_block=37).first()[0]
    assert got == pytest.approx(np.sqrt(((d - b * e) ** 2).sum() / (d * d).sum()), abs=1e-9)


def test_trust_of_a_perfect_chart_and_symmetry(chart):
    df = chart[2]
    assert E.trustworthiness(df.withColumn("px", F.col("gx") + 1).withColumn("py", F.col("gy"))).first()[0] == 1.0
    a = E.trustworthiness(df, pred=("nx", "ny"), rows_per_block=50).first()[0]
    b = E.continuity(df, truth=("nx", "ny"), pred=("gx", "gy")).first()[0]
    assert a == pytest.approx(b) and 0.8 < a < 1


def test_bands_drop_the_largest_and_fill_gaps(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.4, 3.0), (10.0, 7.0), (199.0, 9.0)], "e double, d double")
    got = {r["bin"]: r for r in E.dissimilarity_bands(df).collect()}
    assert len(got) == 199 and got[1]["p50"] == 2.0 and got[11]["p50"] == 7.0 and got[199]["p50"] == 0.0
    assert E.dissimilarity_bands(df, empty=None).filter("p50 is null").count() == 197


# --- learners ----------------------------------------------------------------------------------------


def gradient_error(model, batch):
    params = model.start(0)
    _, grads = model.loss(params, batch, np.random.default_rng(5))
    worst = 0.0
    for p, g in zip(params, grads):
        at = tuple(RNG.integers(0, d) for d in p.shape)
        kept = p[at]
        values = []
        for h in (1e-6, -1e-6):
            p[at] = kept + h
            values.append(model.loss(params, batch, np.random.default_rng(5))[0])
        p[at] = kept
        worst = max(worst, abs((values[0] - values[1]) / 2e-6 - g[at]))
    return worst


X = RNG.normal(size=(20, 6))
SMALL = N.MLP(6, (8, 7, 5), 2, True, 0.2)
BACK = N.MLP(2, (8, 7), 6)
TS = np.arange(20) / 10


@pytest.mark.parametrize("model,batch", [
    (N.Model("fingerprint", SMALL), {"x": X, "target": X[:, :2]}),
    (N.Model("fingerprint", N.MLP(6, (8, 7), 4), options={"uncertainty": True}), {"x": X, "target": X[:, :2]}),
    (N.Model("siamese", SMALL, criterion="HuberLoss"), {"x": X, "x2": X[::-1].copy(), "target": np.abs(X[:, 0])}),
    (N.Model("siamese", N.MLP(6, (8,), 2)), {"x": X, "x2": X[::-1].copy(), "target": np.abs(X[:, 0])}),
    (N.Model("triplet", N.MLP(6, (8, 7), 2)), {"x": X, "x_positive": X[::-1].copy(), "x_negative": np.roll(X, 3, 0)}),
    (N.Model("autoencoder", SMALL, BACK), {"x": X, "ts": TS}),
    (N.Model("autoencoder", SMALL, BACK), {"x": X, "ts": TS, "mask": (X > -1).astype(float)}),
    (N.Model("autoencoder", SMALL, BACK, options={"regularization": "FRD"}), {"x": X, "ts": TS}),
    (N.Model("autoencoder", SMALL, BACK, options={"regularization": "MRD", "regularization_weight": 2.0}), {"x": X, "ts": TS}),
    (N.Model("autoencoder", N.MLP(6, (8, 7), 4), BACK, options={"variant": "vae", "beta": 0.3, "regularization": "FRD"}), {"x": X, "ts": TS}),
    (N.Model("paths", N.MLP(6, (8, 7), 2), options={"triangle_penalty_weight": 0.1, "acceleration_weight": 0.1}),
     {"nodes": X, "count": np.array([5, 8, 7]), "mean": np.array([1.0, 2, 3]), "variance": np.array([0.1, 0.2, 0.3]),
      "motion": RNG.normal(size=(4, 3, 6)), "dt": RNG.random((4, 2)) + 0.5}),
])
def test_gradients(model, batch):
    assert gradient_error(model, batch) < 1e-5


@pytest.mark.parametrize("workers", [1, 3])
def test_training_lowers_the_loss_and_predicts(spark, workers):
    x = RNG.normal(size=(300, 4))
    y = np.c_[x[:, 0] - x[:, 1], x[:, 2]]
    rows = spark.createDataFrame([(i, x[i].tolist(), y[i].tolist()) for i in range(300)], "id bigint, x array<double>, target array<double>")
    model = N.Model("fingerprint", N.MLP(4, (16, 8), 2, norm=False))
    epochs = 8 * workers  # partitions step side by side: the same number of steps in sequence
    t = N.train(model, rows, epochs, 32, 0.01, 3, workers, "CosineWithWarmupLR", {"warmup_epochs": 1, "T_max": epochs})
    assert t.history[-1] < 0.4 * t.history[0]
    got = t.predict(rows).orderBy("id").toPandas()
    assert np.mean((got[["x", "y"]].to_numpy() - y) ** 2) < 0.5
    again = N.train(model, rows, 2, 32, 0.01, 3, workers).history
    assert again == N.train(model, rows, 2, 32, 0.01, 3, workers).history


def test_path_loss_by_hand(spark):
    paths = spark.createDataFrame([(1, [0, 1, 2], 2.5, 0.5)], "path_id bigint, nodes array<bigint>, mean double, variance double")
    at = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 1.0, 1.0)], "id bigint, x double, y double")
    got = losses.path_losses(paths, at).first()
    step = np.sqrt(1 + 1e-6)
    assert got["geodesic"] == pytest.approx((2 * step - 2.5) ** 2 / (0.5 + 1e-6)) and got["triangle"] == 0.0


# --- uncertain dissimilarities ---------------------------------------------------------------------------


def test_realised_graph_is_the_exact_graph_of_the_drawn_lengths(spark):
    n, base = 60, Dissimilarity("cityblock")
    x, ts = RNG.random((n, 3)), np.arange(n) * 0.5
    model = G.GaussianModel(0.2, -0.01, 0.1, 2.0, 0.05, 0.001, 0.1)
    pts = spark.createDataFrame([(i, float(ts[i]), x[i].tolist()) for i in range(n)], "id bigint, ts double, f array<double>")
    packed = np.c_[np.arange(n), ts, x]
    d = G.Realization(base, model, 9).between(packed, packed)
    np.testing.assert_array_equal(d, d.T)
    got = {}
    for r in G.realized_graph(pts, base, model, 9, 5).collect():
        got.setdefault(r["src"], set()).add(r["dst"])
        assert r["w"] == pytest.approx(d[r["src"], r["dst"]])
    for i in range(n):
        assert got[i] == set(sorted((j for j in range(n) if j != i), key=lambda j: d[i, j])[:5])
    z = G.pair_normal(np.arange(400)[:, None], np.arange(400, 800)[None], 3)
    assert abs(z.mean()) < 0.02 and abs(z.std() - 1) < 0.02


def test_draws_of_a_realisation_stay_in_the_cache(monkeypatch):
    """Pairs are drawn in squares of bounded size, with the values of one draw over all pairs."""
    base, model = Dissimilarity("cityblock"), G.GaussianModel(0.2, -0.01, 0.1, 2.0, 0.05, 0.001, 0.1)
    rows = np.c_[RNG.permutation(2500), RNG.random((2500, 4))]
    x, y, draw, drawn = rows[:70], rows, G.Realization(base, model, 9), G.pair_normal
    i, j = np.broadcast_arrays(x[:, :1], y[None, :, 0])
    want = np.minimum(*draw.kinds(base.between(x[:, 2:], y[:, 2:]), x[:, 1:2] - y[None, :, 1], i, j))
    sizes = []
    monkeypatch.setattr(G, "pair_normal", lambda i, j, seed: sizes.append(np.broadcast(i, j).size) or drawn(i, j, seed))
    np.testing.assert_array_equal(draw.between(x, y), want)
    assert sum(sizes) == want.size and max(sizes) <= 32 * 1024


def test_drawn_paths_join_source_and_target(spark):
    n = 80
    ts = np.arange(n) * 1.0
    pts = spark.createDataFrame([(i, float(ts[i]), [float(np.cos(i / 9)), float(np.sin(i / 9))]) for i in range(n)], "id bigint, ts double, f array<double>")
    model = G.GaussianModel(1.0, 0.0, 0.01, 0.5, 0.11, 1e-5, 0.1)
    asked = G.path_requests(pts, 2, 200, 200, 20, 2, 5)
    assert asked.count() == 400 and asked.filter("source = target").count() == 0
    assert asked.select("target", "realization").distinct().groupBy("realization").count().filter("count > 10").count() == 0
    few = asked.limit(40).persist()
    got = {r["path_id"]: r for r in G.draw_paths(pts, Dissimilarity("euclidean"), model, few, 2, 6, True, 1).collect()}
    for a in few.collect():
        r = got[a["path_id"]]
        assert r["nodes"][0] == a["source"] and r["nodes"][-1] == a["target"] and r["hops"] == len(r["nodes"]) - 1
        assert not any(x == y == G.VELOCITY for x, y in zip(r["choices"], r["choices"][1:]))
        assert r["mean"] > 0 and r["variance"] > 0


# --- reductions ------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def sheet(spark):
    n, own = 200, np.random.default_rng(7)
    u, w = own.uniform(0, 3, n), own.uniform(0, 1, n)
    x = np.c_[np.cos(u), np.sin(u), w, w * 0.5]
    pts = spark.createDataFrame([(i, x[i].tolist()) for i in range(n)], "id bigint, f array<double>").repartition(4).persist()
    truth = spark.createDataFrame([(i, float(u[i]), float(w[i])) for i in range(n)], "id bigint, gx double, gy double").persist()
    return x, pts, truth


def judged(chart, truth):
    joined = chart.withColumnsRenamed({"x": "px", "y": "py"}).join(truth, "id").persist()
    assert joined.count() == 200
    return E.with_error(E.align_affine(joined)).agg(F.avg("error")).first()[0], E.trustworthiness(joined).first()[0]


def test_pca_matches_svd(spark, sheet):
    x, pts, _ = sheet
    got = R.PrincipalComponents().fit(pts).transform(pts).orderBy("id").toPandas()[["x", "y"]].to_numpy()
    c = x - x.mean(axis=0)
    want = c @ np.linalg.svd(c, full_matrices=False)[2][:2].T
    np.testing.assert_allclose(np.abs(got), np.abs(want), atol=1e-9)


def test_isomap_unrolls(spark, sheet):
    error, trust = judged(R.isomap(sheet[1], 10, Dissimilarity("euclidean"), rounds=3, columns_per_block=64), sheet[2])
    assert error < 0.12 and trust > 0.97


def test_separate_parts_are_bridged(spark):
    x = [[0.0], [1.0], [2.0], [10.0], [11.0], [12.5]]
    pts = spark.createDataFrame(list(enumerate(x)), "id bigint, f array<double>")
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (3, 4, 1.0), (4, 5, 1.5)], "src bigint, dst bigint, w double")
    got = {tuple(sorted((r["src"], r["dst"]))): r["w"] for r in R.bridge_components(pts, edges, Dissimilarity("cityblock")).collect()}
    assert got == {(0, 1): 1.0, (1, 2): 1.0, (3, 4): 1.0, (4, 5): 1.5, (2, 3): 8.0}


def test_tsne_and_umap_keep_neighbourhoods(spark, sheet):
    assert judged(R.tsne(sheet[1], 15, n_iter=6), sheet[2])[1] > 0.9
    assert judged(R.umap(sheet[1], 10, 0.1, Dissimilarity("cityblock"), n_epochs=10), sheet[2])[1] > 0.85


def test_curve_parameters():
    a, b = R.curve_parameters(0.1)
    assert a == pytest.approx(1.577, abs=0.01) and b == pytest.approx(0.895, abs=0.01)


def test_umap_in_one_task_is_the_layout_of_the_joins(spark, sheet, monkeypatch):
    monkeypatch.setattr(R, "spectral_start", lambda w, ids, seed: ids.selectExpr("id", "id % 7 * 1.5d x", "id % 5 * 1.5d y"))
    whole = R.umap(sheet[1], 8, 0.1, Dissimilarity("cityblock"), n_epochs=3).toPandas().set_index("id").sort_index()
    monkeypatch.setattr(R, "EDGES_IN_A_TASK", 0)
    joined = R.umap(sheet[1], 8, 0.1, Dissimilarity("cityblock"), n_epochs=3).toPandas().set_index("id").sort_index()
    np.testing.assert_allclose(whole, joined, atol=1e-9)


def test_chart_umap_takes_all_its_epochs(spark, monkeypatch):
    from catalog import charts

    asked = []
    monkeypatch.setattr(charts, "points", lambda *a: spark.range(1))
    monkeypatch.setattr(charts.reduction, "umap", lambda *a, **k: (asked.append((len(a), k)), spark.range(1).selectExpr("id", "0d x", "0d y"))[1])
    charts.chart_umap(spark, "")
    assert asked == [(3, {})]


def test_isomap_of_many_rows_writes_no_matrix(spark, sheet, monkeypatch):
    kept = R.isomap(sheet[1], 8, Dissimilarity("cityblock"), rounds=1).toPandas().set_index("id").sort_index()
    written, real = [], R.cut
    monkeypatch.setattr(R, "KEPT_BYTES", 0, raising=False)
    monkeypatch.setattr(R, "cut", lambda df, *a: (written.append(df.columns), real(df, *a))[1])
    anew = R.isomap(sheet[1], 8, Dissimilarity("cityblock"), rounds=1).toPandas().set_index("id").sort_index()
    np.testing.assert_allclose(anew, kept, atol=1e-9)
    assert not any("s" in columns for columns in written)
