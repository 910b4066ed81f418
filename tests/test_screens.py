"""Screened neighbours are the plain ones, and distances in squares are those of whole rows."""

import numpy as np
import pytest

from kartograf.operators import pairs
from kartograf.operators.pairs import Dissimilarity


@pytest.mark.parametrize("kind", ["drawn", "rounded", "crowded", "far"])
@pytest.mark.parametrize("metric, joined", [("cityblock", "mean"), ("cityblock", "sum"), ("cityblock", "median"), ("cosine", "sum"), ("correlation", "mean"), ("euclidean", "sum")])
def test_nearest_of_a_block(monkeypatch, kind, metric, joined):
    rng = np.random.default_rng(3)
    x = rng.random((700, 12))
    if kind == "rounded":
        x = np.round(x, 1)
    if kind == "crowded":
        x[:300] = x[0] + rng.normal(size=(300, 12)) * 1e-7
    if kind == "far":
        x[4] *= 1000
    if joined == "median":
        x[::3, :4], x[5] = np.nan, np.nan
    m = Dissimilarity(metric, 3, joined)
    monkeypatch.setattr(pairs, "CACHE", (16, 50))
    monkeypatch.setattr(pairs, "COLUMNS", 90)
    d = np.round(np.nan_to_num(m.between(x, x), nan=1e10), 9)
    for k in (1, 9):
        got = [(r, c, v) for part in pairs._nearest_in(x, x, k, m, 9) for r, c, v in zip(*part)]
        want = [(r, c, d[r, c]) for r in range(len(x)) for c in np.argsort(d[r], kind="stable")[:k]]
        assert got == want


def test_no_cell_holds_all_distances_of_many_rows(monkeypatch):
    """A tile of rows meets a bounded number of columns at a time, screened or not."""
    most = []
    real = Dissimilarity.between
    monkeypatch.setattr(Dissimilarity, "between", lambda self, x, y: (most.append(len(x) * len(y)), real(self, x, y))[1])
    x = np.random.default_rng(1).random((9000, 4))
    for joined in ("mean", "median"):
        assert sum(len(r) for r, _, _ in pairs._nearest_in(x[:600], x, 5, Dissimilarity("cityblock", 2, joined), 9)) == 3000
    assert max(most) <= pairs.CACHE[0] * 4 * pairs.COLUMNS


def test_rows_meet_blocks_not_chunks(spark):
    """Where bounds skip nothing, a row is compared once with each block, so few partial neighbours are shuffled."""
    x = np.random.default_rng(2).normal(size=(600, 12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, f array<double>")
    out = pairs.nearest_neighbors(df, 3, Dissimilarity("cityblock"), rows_per_block=16)
    d = np.round(np.abs(x[:, None] - x[None]).sum(axis=2), 9)
    np.fill_diagonal(d, np.inf)
    got = {(r["src"], r["rank"]): r["dst"] for r in out.collect()}
    assert got == {(i, n + 1): j for i in range(600) for n, j in enumerate(np.argsort(d[i], kind="stable")[:3])}
    assert "_bound" not in out._jdf.queryExecution().analyzed().toString()
