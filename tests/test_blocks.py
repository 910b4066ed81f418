"""Moving windows over blocks against plain NumPy."""

import time

import numpy as np
import pytest

from kartograf.operators import blocks

RNG = np.random.default_rng(3)


@pytest.mark.parametrize("length", [1, 2, 3, 7, 50, 200])
@pytest.mark.parametrize("ratio", [1.0, 0.6, 0.0])
def test_decayed_sums(length, ratio):
    x = RNG.normal(size=(120, 2))
    padded = np.concatenate([x, np.zeros((length, 2))])
    want = [sum((ratio**j if j else 1.0) * padded[i + j] for j in range(length)) for i in range(120)]
    np.testing.assert_allclose(blocks.decayed(x, length, ratio), want, atol=1e-12)
    assert len(blocks.decayed(x[:0], length, ratio)) == 0


def test_windows_end_with_their_block():
    block = np.repeat([0, 1, 2, 3], [5, 1, 9, 4])
    x = RNG.normal(size=(len(block), 1))
    windows = blocks.Windows(block, 6)
    for before, after in ((0, 0), (2, 3), (3, 0), (0, 6)):
        want = [x[[j for j in range(i - before, i + after + 1) if 0 <= j < len(block) and block[j] == block[i]]].sum() for i in range(len(block))]
        np.testing.assert_allclose(windows.total(x, before, after)[:, 0], want, atol=1e-12)
    want = [sum(0.7 ** abs(i - j) * x[j, 0] for j in range(len(block)) if block[j] == block[i] and abs(i - j) <= 3) for i in range(len(block))]
    np.testing.assert_allclose(windows.centred(x, 3, 0.7)[:, 0], want, atol=1e-12)


@pytest.mark.parametrize("before, after, at", [(0, 0, 0), (5, 4, 5), (3, 3, 3), (40, 39, 10)])
def test_running_medians(before, after, at):
    block = np.repeat([0, 1, 2], [30, 1, 80])
    x = np.round(RNG.normal(size=len(block)), 1)
    x[RNG.random(len(block)) < 0.1] = np.nan
    got = blocks.medians(x, block, before, after, at)
    for i in range(len(block)):
        own = sorted(x[j] for j in range(max(0, i - before), min(len(block), i + after + 1)) if block[j] == block[i] and not np.isnan(x[j]))
        assert got[i] == own[at] if at < len(own) else np.isnan(got[i])


def test_cost_does_not_grow_with_the_window():
    x = RNG.normal(size=(400_000, 2))

    def seconds(length):
        best = 9.0
        for _ in range(3):
            start = time.perf_counter()
            blocks.decayed(x, length)
            best = min(best, time.perf_counter() - start)
        return best

    assert seconds(2_000) < 4 * seconds(20)


def test_blocks_longer_than_a_read_are_whole(spark):
    """Windows over one block of 120,000 rows, which comes in many Arrow batches, beside small ones; other columns stay as they are."""
    import pyarrow as pa
    from pyspark.sql import functions as F
    from pyspark.sql.types import DoubleType

    df = spark.range(121_000).select("id", F.when(F.col("id") < 120_000, 0).otherwise(F.col("id")).alias("g"),
                                     F.when(F.col("id") % 3 > 0, F.array(F.lit(None).cast("string"), F.lit("x"))).alias("kept"), (F.col("id") % 11).cast("double").alias("x"))

    def work(table, block):
        x = table.column("x").to_numpy()[:, None]
        return [pa.array(blocks.Windows(block, 20).total(x, 10, 10)[:, 0])]

    got = blocks.over_blocks(df, ["g"], "id", F.col("id") % 2 == 0, work, [("s", DoubleType())]).orderBy("id").collect()
    x = np.arange(121_000) % 11
    assert [r["id"] for r in got] == list(range(0, 121_000, 2))
    assert all(r["s"] == (x[max(0, r["id"] - 10):min(r["id"] + 11, 120_000)].sum() if r["id"] < 120_000 else x[r["id"]]) for r in got)
    assert all(r["kept"] == ([None, "x"] if r["id"] % 3 else None) for r in got)
