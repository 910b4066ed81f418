"""Graphs of one block: no matrix is written, and ways are those of fewest hops and smallest nodes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kartograf.operators import geodesics, graph


def grid(side):
    arcs = [(r * side + c, r2 * side + c2, 1.0) for r in range(side) for c in range(side) for r2, c2 in ((r + 1, c), (r, c + 1)) if r2 < side and c2 < side]
    return [*arcs, *[(v, u, w) for u, v, w in arcs]]


def test_lengths_hops_and_ties_of_one_block(monkeypatch):
    side = 6
    arcs = np.array([(u, v, w) for u, v, w in sorted(grid(side), key=lambda a: (a[1], a[0]))], geodesics._ARC)
    for at_once in (1, 50, 1 << 20):
        monkeypatch.setattr(geodesics, "AT_ONCE", at_once)
        whole = geodesics._Whole(np.arange(side * side) * 10, arcs)
        sources = np.array([0, 8, 35, 8])
        d = whole.lengths(sources)
        hops, pred = whole.ways(d, sources)
        for s, source in enumerate(sources):
            for v in range(side * side):
                far = abs(v // side - source // side) + abs(v % side - source % side)
                assert d[v, s] == far == hops[v, s]
                before = [u for u, to, _ in grid(side) if to == v and d[u, s] == far - 1]
                assert pred[v, s] == (min(before) * 10 if far else -1)
    alone = geodesics._Whole(np.array([5]), np.empty(0, geodesics._ARC))
    assert alone.lengths(np.array([0])).tolist() == [[0.0]]


@pytest.mark.parametrize("ask", ["pairs", "summary", "trees", "paths"])
def test_no_matrix_of_a_small_graph_is_written(spark, monkeypatch, ask):
    written = []
    real = geodesics.cut
    monkeypatch.setattr(geodesics, "cut", lambda df, *a: (written.append(df.columns), real(df, *a))[1])
    edges = spark.createDataFrame(grid(5), "src bigint, dst bigint, w double")
    nodes = spark.range(25)
    if ask == "pairs":
        pairs = spark.createDataFrame([(i, 24 - i) for i in range(25)], "i bigint, j bigint")
        assert {r["i"]: r["d"] for r in graph.geodesics_between(edges, pairs).collect()}[0] == 8.0
    elif ask == "summary":
        assert {r["src"]: r["max_d"] for r in graph.geodesic_summary(edges, nodes).collect()}[12] == 4.0
    elif ask == "trees":
        assert graph.longest_path_hops(graph.shortest_path_trees(edges, nodes)) == 9
    else:
        asked = spark.createDataFrame([(0, 0, 24), (1, 3, 3)], "path_id bigint, source bigint, target bigint")
        assert {r["path_id"]: len(r["nodes"]) for r in graph.shortest_paths(edges, asked).collect()} == {0: 9, 1: 1}
    assert not any({"data", "pred", "dst"} & set(columns) for columns in written)


def test_contraction_deals_a_tree_out_once(spark):
    """One shuffle of the trees, whatever the length of the stretches."""
    trees = spark.createDataFrame([(t, i, i - 1, 1) for t in (0, 7) for i in range(40)], "target bigint, node bigint, pred bigint, choice int")
    out = graph.contract_trees(trees, 1)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert {r["pred"] for r in out.filter("node > 0").collect()} == {0}


def test_ways_of_many_hops_take_few_rounds(monkeypatch):
    """Blocks of heads in order of their arcs, each pulled slice by slice: hubs settle first."""
    rng = np.random.default_rng(3)
    n, edges = 400, {}
    for v in range(1, n):
        for u in {int(v * rng.random() ** 2) for _ in range(4)}:
            edges[u, v] = edges[v, u] = float(rng.integers(1, 9))
    arcs = np.array([(u, v, w) for (u, v), w in sorted(edges.items(), key=lambda e: (e[0][1], e[0][0]))], geodesics._ARC)
    want = np.full((n, n), np.inf)
    want[arcs["u"], arcs["v"]] = arcs["w"]
    np.fill_diagonal(want, 0)
    for k in range(n):
        want = np.minimum(want, want[:, k, None] + want[None, k])
    whole, rounds = geodesics._Whole(np.arange(n), arcs), []
    real = whole._pulled
    monkeypatch.setattr(whole, "_pulled", lambda d: (rounds.append(1), real(d))[1])
    d = whole.lengths(np.arange(n))
    count = len(rounds)
    assert (d == want).all() and count < whole.ways(d, np.arange(n))[0].max()
    d = whole.lengths(np.arange(3))
    hops, pred = whole.ways(d, np.arange(3))
    for s in range(3):
        for v in range(n):
            before = [u for u in range(n) if (u, v) in edges and d[u, s] + edges[u, v] == d[v, s]]
            assert v == s or pred[v, s] == min(u for u in before if hops[u, s] == min(hops[x, s] for x in before))


def test_square_reads_its_table_once(spark):
    from kartograf.operators import sampling

    far = spark.createDataFrame([(0, 1, 2.0), (0, 2, None)], "i bigint, j bigint, d double").mapInPandas(lambda rows: rows, "i bigint, j bigint, d double")
    both = sampling.square(far)
    assert both._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1
    assert {tuple(r) for r in both.collect()} == {(0, 1, 2.0), (1, 0, 2.0), (0, 2, None), (2, 0, None)}


@pytest.mark.parametrize("nodes", [1 << 17, 7])
def test_trees_that_stand_together_are_contracted_without_a_shuffle(spark, monkeypatch, nodes):
    monkeypatch.setattr(geodesics, "NODES", nodes)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")  # a tree comes in several batches
    try:
        edges = spark.createDataFrame(grid(4), "src bigint, dst bigint, w double")
        kinds = graph.shortest_path_trees(edges, spark.range(9), together=True).withColumn("choice", (F.col("node") % 3 == 0).cast("int")).persist()
        out = graph.contract_trees(kinds, 1, together=True)
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
        want = {tuple(r) for r in graph.contract_trees(kinds, 1).collect()}
        assert len(want) == 9 * 16 and {tuple(r) for r in out.collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")


def test_longest_path_takes_every_row_as_a_target(spark, monkeypatch, tmp_path):
    from catalog import neighbors

    asked = []
    real = graph.shortest_path_trees
    monkeypatch.setattr(neighbors.graph, "shortest_path_trees", lambda e, t, *a: (asked.append(sorted(r["id"] for r in t.collect())), real(e, t, *a))[1])
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=64).tolist(), 0) for i in range(40)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert neighbors.longest_path(spark, str(tmp_path)).first()["nodes"] >= 2
    assert asked == [list(range(40))]
