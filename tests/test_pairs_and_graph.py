import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from kartograf.operators import geodesics, graph, losses
from kartograf.operators.pairs import (Dissimilarity, condensed_distances, distance_audit, nearest_neighbors, ranks_among_all)
from kartograf.operators.quantiles import ecdf, exact_quantiles
from kartograf.operators.shells import lay_shells

RNG = np.random.default_rng(5)


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id bigint, f array<double>").repartition(3)


def brute(d, k):
    return {i: sorted((d[i, j], j) for j in range(len(d)) if j != i)[:k] for i in range(len(d))}


def collected(df):
    out = {}
    for r in df.orderBy("src", "rank").collect():
        out.setdefault(r["src"], []).append((r["d"], r["dst"]))
    return out


@pytest.mark.parametrize("options", [{"prune": False}, {"prune": True, "rows_per_block": 30, "pivots": 6}, {"prune": False, "rows_per_block": 40}])
def test_neighbors_are_exact_with_a_third_of_copies(spark, options):
    x = RNG.normal(size=(150, 6))
    x[40:90] = x[3]
    m = Dissimilarity("cityblock", 2, "mean")
    got = collected(nearest_neighbors(frame(spark, x), 4, m, **options))
    assert got == brute(np.round(m.between(x, x), 9), 4)


def test_neighbors_with_missing_antennas(spark):
    x = RNG.normal(size=(80, 6))
    x[::3, :3] = np.nan
    x[5] = np.nan
    m = Dissimilarity("cityblock", 2, "median")
    d = np.round(np.nan_to_num(m.between(x, x), nan=1e10), 9)
    assert collected(nearest_neighbors(frame(spark, x), 3, m, rows_per_block=25)) == brute(d, 3)


@pytest.mark.parametrize("metric, aggregation", [("cosine", "sum"), ("correlation", "mean"), ("sqeuclidean", "max"), ("canberra", "sum"),
                                                 ("jensenshannon", "mean"), ("chebyshev", "median"), ("braycurtis", "sum")])
def test_neighbors_through_shells_are_exact(spark, metric, aggregation):
    x = np.abs(RNG.normal(size=(160, 6))) + np.repeat(RNG.normal(size=(8, 6)) ** 2 * 9, 20, axis=0)
    x[30:70] = x[3]
    x[80:120] = x[80] * (1 + np.arange(40) * 1e-7)[:, None]
    m = Dissimilarity(metric, 2, aggregation)
    d = np.round(m.between(x, x), 9)
    got = collected(nearest_neighbors(frame(spark, x), 5, m, prune=m.obeys_triangle, rows_per_block=12))
    for src, want in brute(d, 5).items():
        assert [v for v, _ in got[src]] == pytest.approx([v for v, _ in want], abs=2e-9)
    if metric == "canberra":  # no matrix product in it: ties are the same bit by bit
        assert got == brute(d, 5)


def test_undefined_rows_stop_pruning(spark):
    x = RNG.normal(size=(60, 6))
    x[4], x[9, :3] = 0, 0
    m = Dissimilarity("cosine", 2, "sum")
    d = np.round(np.nan_to_num(m.between(x, x), nan=1e10), 9)
    got = collected(nearest_neighbors(frame(spark, x), 3, m, prune=True, rows_per_block=10))
    for src, want in brute(d, 3).items():
        assert [v for v, _ in got[src]] == pytest.approx([v for v, _ in want], abs=2e-9)
    assert nearest_neighbors(frame(spark, x).limit(0), 3, m, prune=True).count() == 0


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_rows_visit_few_chunks_of_clustered_data(spark, metric):
    x = np.repeat(RNG.normal(size=(20, 8)) * 50, 50, axis=0) + RNG.normal(size=(1000, 8))
    m = Dissimilarity(metric)
    points = frame(spark, x).withColumnRenamed("id", "vid")
    laid = lay_shells(points, m, 5, 20)
    held = laid.points.groupBy("_chunk").count().toPandas()
    assert held["count"].sum() == 1000 and held["count"].max() <= 40 and laid.chunks >= len(held)
    kth = np.partition(m.between(x, x), 5, axis=1)[:, 5]
    bounded = laid.points.select("vid", "f").join(spark.createDataFrame([(i, float(v)) for i, v in enumerate(kth)], "vid bigint, _bound double"), "vid")
    visits = laid.visits(bounded, m, 1e-9).toPandas()
    assert len(visits) < 1000 * laid.chunks / 5
    home = laid.points.select("vid", "_chunk").toPandas().set_index("vid")["_chunk"]
    visited = set(zip(visits["query"], visits["_chunk"]))
    for i, near in enumerate(np.argsort(m.between(x, x), axis=1)[:, :6]):
        assert all((i, home[j]) in visited for j in near)


def test_condensed_distances_and_audit(spark):
    x = RNG.normal(size=(70, 4))
    x[2], x[3, :2] = np.nan, np.nan
    m = Dissimilarity("euclidean", 2, "mean")
    d = m.between(x, x)
    got = condensed_distances(frame(spark, x), m, rows_per_block=16).toPandas()
    assert len(got) == 70 * 69 // 2 and (got["i"] < got["j"]).all() and not got.duplicated(["i", "j"]).any()
    np.testing.assert_allclose(got["d"].astype(float), d[got["i"], got["j"]], atol=1e-12)
    a = distance_audit(frame(spark, x), m, rows_per_block=16).first()
    assert (a["pairs"], a["nans"], a["infs"]) == (2415, 69, 0)


def test_ranks(spark):
    x = RNG.normal(size=(60, 2))
    m = Dissimilarity("euclidean")
    d = m.between(x, x)
    pairs = spark.createDataFrame([(i, (i * 7 + 1) % 60) for i in range(60) if i != (i * 7 + 1) % 60], "src bigint, dst bigint")
    for r in ranks_among_all(frame(spark, x), pairs, m, rows_per_block=20).collect():
        line = np.delete(d[r["src"]], r["src"])
        assert r["nearer"] == (line < d[r["src"], r["dst"]]).sum()


def test_ranks_of_many_thresholds_with_ties(spark):
    x = RNG.integers(0, 4, size=(90, 2)).astype(float)
    x[20:50] = x[7]
    m = Dissimilarity("euclidean")
    d = np.round(m.between(x, x), 9)
    asked = [(0, j) for j in range(1, 90)] + [(7, j) for j in range(30, 60)] + [(60, 3), (60, 3), (61, 89)]
    pairs = spark.createDataFrame(asked, "src bigint, dst bigint")
    got = {(r["src"], r["dst"]): r["nearer"] for r in ranks_among_all(frame(spark, x), pairs, m, rows_per_block=25).collect()}
    assert set(got) == set(asked)
    for (s, t), nearer in got.items():
        assert nearer == sum((d[s, j], j) < (d[s, t], t) for j in range(90) if j != s)
    assert ranks_among_all(frame(spark, x), pairs.limit(0), m).count() == 0


@pytest.mark.parametrize("rows_per_block", [8192, 20])
@pytest.mark.parametrize("kind", ["FRD", "MRD"])
def test_time_band_in_batches_of_any_size(spark, kind, rows_per_block):
    ts = np.sort(RNG.uniform(0, 60, 400)).round(2)
    ts[100:160] = ts[100]  # one moment with many rows
    z = RNG.normal(size=(400, 2)) * 2
    z[110:150] = z[110]  # and copies
    batch = np.where(np.arange(400) < 330, 1, 2)
    rows = [(int(b), float(t), [float(v) for v in p]) for b, t, p in zip(batch, ts, z)]
    rows += [(1, None, [0.0, 0.0]), (1, 3.0, None), (3, 5.0, [1.0, 1.0]), (4, None, None), (None, 1.0, [0.0, 0.0]), (None, 1.5, [3.0, 4.0])]
    df = spark.createDataFrame(rows, "batch bigint, ts double, z array<double>").repartition(4)
    got = {r["batch"]: r for r in losses.time_regularization(df, kind, 1.5, rows_per_block=rows_per_block).collect()}
    assert set(got) == {1, 2, 3, 4, None} and got[3]["pairs"] == got[4]["pairs"] == 0 and got[3]["loss"] == 0 and got[None]["pairs"] == 1
    for b in (1, 2):
        at = np.flatnonzero(batch == b)
        i, j = np.triu_indices(len(at), 1)
        dt = np.abs(ts[at[i]] - ts[at[j]])
        d = np.linalg.norm(z[at[i]] - z[at[j]], axis=1)[dt <= 1.5]
        r = np.abs(d - dt[dt <= 1.5])
        want = np.where(r <= 1, r * r / 2, r - 0.5) if kind == "FRD" else np.maximum(d - dt[dt <= 1.5], 0) ** 2
        assert got[b]["pairs"] == len(d) and got[b]["loss"] == pytest.approx(want.mean(), rel=1e-9)


def test_quantiles_per_group_with_a_hot_value(spark):
    g = RNG.integers(0, 3, 3000)
    v = np.round(RNG.normal(size=3000), 3)
    v[:1200] = 0.25
    g[:1000] = 0
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, v)], "g int, v double")
    got = exact_quantiles(df, "v", (0.0, 0.33, 0.5, 0.99, 1.0), ["g"]).collect()
    assert len(got) == 15
    for r in got:
        assert r["q"] == pytest.approx(np.quantile(v[g == r["g"]], r["p"]), abs=1e-12)
    few = spark.createDataFrame([(x,) for x in (1.0, 2.0, 4.0, 8.0)], "v double")
    assert {r["p"]: r["q"] for r in exact_quantiles(few, "v", (0.5, 0.9)).collect()} == pytest.approx({0.5: 3.0, 0.9: 6.8})


def test_ecdf_is_thinned_by_rank(spark):
    v = RNG.normal(size=2500)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    got = ecdf(df, "v", 100).orderBy("cdf").toPandas()
    at = np.linspace(0, 2499, 100).astype(int)
    np.testing.assert_allclose(got["value"], np.sort(v)[at])
    np.testing.assert_allclose(got["cdf"], (at + 1) / 2500)
    assert ecdf(df.limit(10), "v", 100).count() == 10


def dijkstra(arcs, source):
    dist, heap = {}, [(0.0, source)]
    while heap:
        d, u = heapq.heappop(heap)
        if u in dist:
            continue
        dist[u] = d
        for v, w in arcs.get(u, []):
            heapq.heappush(heap, (d + w, v))
    return dist


@pytest.fixture(scope="module")
def network(spark):
    e = {}
    for i in range(40):
        for j in RNG.integers(0, 40, 3):
            if i != j and (i < 30) == (j < 30):  # two parts
                e[i, int(j)] = float(RNG.random() + 0.01)
    arcs = {}
    for (i, j), w in e.items():
        arcs.setdefault(i, []).append((j, w))
        arcs.setdefault(j, []).append((i, w))
    edges = spark.createDataFrame([(i, j, w) for (i, j), w in e.items()], "src bigint, dst bigint, w double").persist()
    return arcs, edges


@pytest.fixture(params=["one block", "small blocks", "small passes"])
def bound(request, monkeypatch):
    if request.param != "one block":
        monkeypatch.setattr(geodesics, "NODES", 7)
        monkeypatch.setattr(geodesics, "SOURCES", 3)
    if request.param == "small passes":
        monkeypatch.setattr(geodesics, "PASS_BYTES", 40 * 20 * 12)


def test_geodesics(spark, network, bound):
    arcs, edges = network
    nodes = spark.range(40)
    want = {i: dijkstra(arcs, i) for i in range(40)}
    got = graph.geodesics_from(edges, nodes, keep_upper=True).toPandas()
    assert len(got) == sum(j > i for i in want for j in want[i])
    np.testing.assert_allclose(got["d"], [want[r.src][r.dst] for r in got.itertuples()], atol=1e-12)
    every = graph.geodesics_from(edges, nodes, unreached=True).toPandas()
    assert len(every) == len(arcs) ** 2 and all(d == pytest.approx(want[i].get(j, np.inf)) for i, j, d in every.itertuples(index=False))
    assert graph.geodesics_from(edges, spark.createDataFrame([(99,)], "id bigint")).count() == 0
    pairs = spark.createDataFrame([(i, (i * 11 + 5) % 40) for i in range(40)] + [(99, 3), (98, 98)], "i bigint, j bigint")
    for r in graph.geodesics_between(edges, pairs).collect():
        if r["i"] == 98:
            assert r["d"] == 0.0
        else:
            assert r["d"] == pytest.approx(want[r["i"]][r["j"]]) if r["j"] in want.get(r["i"], {}) else r["d"] is None
    for r in graph.geodesic_summary(edges, nodes).collect():
        others = [v for k, v in want[r["src"]].items() if k != r["src"]]
        assert r["reached"] == len(others)
        if others:
            assert r["max_d"] == pytest.approx(max(others)) and r["mean_d"] == pytest.approx(np.mean(others))


def test_trees_and_paths(spark, network, bound):
    arcs, edges = network
    want = dijkstra(arcs, 4)
    trees = graph.shortest_path_trees(edges, spark.createDataFrame([(4,)], "id bigint")).persist()
    got = {r["node"]: r for r in trees.collect()}
    assert set(got) == set(want) and got[4]["pred"] == -1
    for v, r in got.items():
        assert r["d"] == pytest.approx(want[v])
        if v != 4:
            assert want[v] == pytest.approx(want[r["pred"]] + min(w for u, w in arcs[v] if u == r["pred"]))
    assert graph.longest_path_hops(trees) == max(r["hops"] for r in got.values()) + 1
    asked = spark.createDataFrame([(v, v, 4) for v in range(40)], "path_id bigint, source bigint, target bigint")
    found = {r["path_id"]: r["nodes"] for r in graph.shortest_paths(edges, asked).collect()}
    assert set(found) == set(want)
    for v, nodes in found.items():
        assert nodes[0] == v and nodes[-1] == 4
        assert all(got[a]["pred"] == b for a, b in zip(nodes, nodes[1:]))


def test_components_of_long_chains(spark):
    chain = [(i, i + 1, 1.0) for i in range(60)] + [(100, 101, 1.0)]
    edges = spark.createDataFrame(chain, "src bigint, dst bigint, w double")
    nodes = spark.createDataFrame([(i,) for i in [*range(61), 100, 101, 500]], "id bigint")
    got = {r["id"]: r["component"] for r in graph.connected_components(nodes, edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 500: 500}


def test_contraction_follows_stretches_of_one_kind(spark):
    chain = [(0, i, i - 1, int(i not in (3,))) for i in range(7)]
    trees = spark.createDataFrame(chain, "target bigint, node bigint, pred bigint, choice int")
    got = {r["node"]: r["pred"] for r in graph.contract_trees(trees, 1).collect()}
    # the hop that leaves node 3 is of another kind: 6,5,4 reach 3, and 2 reaches the root
    assert got == {0: -1, 1: 0, 2: 0, 3: 2, 4: 3, 5: 3, 6: 3}


@pytest.mark.parametrize("whole", [False, True])
@pytest.mark.parametrize("parts", [2, 128])
def test_bands_over_all_pairs(spark, whole, parts):
    """Against the percentiles of all pairs, with ties, equal places, a missing feature and values far apart."""
    from kartograf.operators.evaluation import pair_bands

    rng = np.random.default_rng(4)
    f, p = np.round(rng.normal(size=(60, 3)), 1), np.round(rng.random((60, 2)), 1)
    f[7], f[8], p[9] = np.nan, 1e6, p[10]
    df = spark.createDataFrame([(i, f[i].tolist(), p[i].tolist()) for i in range(60)], "id bigint, f array<double>, p array<double>")
    metric = Dissimilarity("cityblock", 1, "mean")
    d = np.nan_to_num(metric.between(f, f), nan=1e10)
    e = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
    keep = np.ones((60, 60), bool) if whole else np.triu(np.ones((60, 60), bool), 1)
    d, e = d[keep], e[keep]
    bins = np.floor(e / (e.max() / 19)).astype(int) + 1
    got = {r["bin"]: r for r in pair_bands(df, metric, edges=20, empty=None, whole=whole, rows_per_block=17, parts=parts).collect()}
    assert sorted(got) == list(range(1, 20))
    for b in range(1, 20):
        own = d[(bins == b) & (e < e.max())]
        assert got[b]["left"] == pytest.approx((b - 1) * e.max() / 19)
        for name, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)):
            assert got[b][name] == (pytest.approx(np.quantile(own, q)) if len(own) else None)
    same = df.withColumn("p", F.array(F.lit(1.0), F.lit(2.0)))
    assert [r["p50"] for r in pair_bands(same, metric, edges=5).collect()] == [0.0] * 4
    assert pair_bands(df.limit(0), metric).count() == 0
