"""Training objectives as aggregations over tables of predictions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartograf.functions.arrays import euclidean, mean, sqeuclidean, total
from kartograf.operators.pairs import ROWS_PER_BLOCK
from kartograf.session import cut


def squared_error(a: Column, b: Column) -> Column:
    return (a - b) * (a - b)


def huber(a: Column, b: Column, delta: float = 1.0) -> Column:
    r = F.abs(a - b)
    return F.when(r <= delta, 0.5 * r * r).otherwise(delta * (r - 0.5 * delta))


def mse_loss(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mean over all elements of two array columns."""
    return df.agg(F.avg(mean(F.zip_with(a, b, squared_error))).alias("loss"))


def huber_loss(df: DataFrame, a: str, b: str, delta: float = 1.0) -> DataFrame:
    return df.agg(F.avg(mean(F.zip_with(a, b, lambda x, y: huber(x, y, delta)))).alias("loss"))


def distance_loss(df: DataFrame, left: str, right: str, target: str, criterion: str = "MSE") -> DataFrame:
    """Chart distance of two embeddings against a given distance."""
    d = euclidean(F.col(left), F.col(right))
    term = squared_error(d, F.col(target)) if criterion == "MSE" else huber(d, F.col(target))
    return df.agg(F.avg(term).alias("loss"))


def triplet_loss(df: DataFrame, anchor: str, positive: str, negative: str, margin: float = 1.0,
                 eps: float = 1e-6) -> DataFrame:
    """Mean of max(|a-p| - |a-n| + margin, 0); ``eps`` is added to every coordinate difference."""

    def apart(x, y):
        return F.sqrt(total(F.zip_with(x, y, lambda a, b: (a - b + eps) * (a - b + eps))))

    gap = apart(F.col(anchor), F.col(positive)) - apart(F.col(anchor), F.col(negative)) + margin
    return df.agg(F.avg(F.greatest(gap, F.lit(0.0))).alias("loss"))


def kl_loss(df: DataFrame, mu: str, log_var: str) -> DataFrame:
    term = F.zip_with(mu, log_var, lambda m, s: 1 + s - m * m - F.exp(s))
    return df.agg((-0.5 * F.avg(total(term))).alias("loss"))


def uncertainty_loss(df: DataFrame, mu: str, log_var: str, target: str) -> DataFrame:
    """Mean of log-variance plus error over variance; the error is the mean over the whole batch."""
    parts = df.agg(F.avg(mean(F.zip_with(mu, target, squared_error))).alias("m"),
                   F.avg(mean(F.col(log_var))).alias("s"),
                   F.avg(mean(F.transform(log_var, lambda v: F.exp(-v)))).alias("i"))
    return parts.select((F.col("s") + F.col("m") * F.col("i")).alias("loss"))


def nearest_code(df: DataFrame, z: str, codebook) -> DataFrame:
    """Number and distance of the nearest codeword (the first of equals): ``code``, ``code_d``."""
    words = F.array(*[F.array(*[F.lit(float(v)) for v in word]) for word in codebook])
    ranked = F.transform(words, lambda w, i: F.struct(sqeuclidean(F.col(z), w).alias("d"), i.alias("i")))
    best = F.array_min(ranked)
    return df.withColumn("_best", best).withColumn("code", F.col("_best.i")) \
        .withColumn("code_d", F.col("_best.d")).drop("_best")


def codebook_loss(df: DataFrame, z: str, codebook, commitment_cost: float = 0.25) -> DataFrame:
    """Codebook plus commitment term: (1 + cost) x mean squared distance to the codeword."""
    coded = nearest_code(df, z, codebook)
    return coded.agg(((1.0 + commitment_cost) * F.avg(F.col("code_d") / F.size(z))).alias("loss"))


def time_regularization(df: DataFrame, kind: str, max_time_diff: float, batch: str = "batch", ts: str = "ts",
                        z: str = "z", rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Chart distance against time difference for pairs of one batch within ``max_time_diff``.

    FRD: Huber of (distance, time difference).  MRD: squared excess of distance over time.  A batch may be of any
    size: see ``time_band``.  Rows without a time or a position are in no pair; a batch without pairs has loss 0.
    Returns (``batch``, ``pairs``, ``loss``).
    """
    if kind not in ("FRD", "MRD"):
        raise ValueError("kind must be 'FRD' or 'MRD'")

    def fold(d: np.ndarray, dt: np.ndarray) -> np.ndarray:
        return _penalties(d, dt, kind)

    rows = df.select(F.col(batch).cast("bigint").alias("batch"), F.col(ts).cast("double").alias("ts"), F.col(z).cast("array<double>").alias("z"))
    found = time_band(rows, max_time_diff, fold, rows_per_block)
    return found.select("batch", "pairs", F.when(F.col("pairs") == 0, 0.0).otherwise(F.col("total") / F.col("pairs")).alias("loss"))


def time_band(rows: DataFrame, reach: float, fold: Callable, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Sum of ``fold(distances, time differences)`` over the pairs of each batch within ``reach``: (``batch``, ``pairs``, ``total``).

    Equal rows (``batch``, ``ts``, ``z``) are counted first and weigh their product, so that copies do not meet.  A
    batch larger than a block is cut into time buckets of at least twice the reach, each with the rows of the next one
    that its own can reach (the halo); a bucket that is still larger is a grid of blocks.  A cell is one bounded task
    and enumerates only pairs inside the band.
    """
    usable = F.col("ts").isNotNull() & ~F.isnan("ts") & F.col("z").isNotNull()
    known = rows.select("batch", F.when(usable, F.col("ts")).alias("ts"), F.when(usable, F.col("z")).alias("z"))
    counted = cut(known.groupBy("batch", "ts", "z").agg(F.count("*").alias("w")))
    sizes = counted.groupBy("batch").agg(F.count("*").alias("_n"), F.min("ts").alias("_from"), F.max("ts").alias("_to"))
    large = sizes.filter(F.col("_n") > rows_per_block).select(
        F.col("batch").alias("_batch"), "_from",
        F.greatest(F.lit(2.0 * reach), (F.col("_to") - F.col("_from")) * rows_per_block / F.col("_n")).alias("_width"))
    placed = counted.join(large, F.col("batch").eqNullSafe(F.col("_batch")), "left")
    step = F.coalesce(F.try_divide(F.col("ts") - F.col("_from"), F.col("_width")), F.lit(0.0))
    bucket = F.floor(step)
    # a little more than the reach, so that rounding loses no pair; cells compare exactly
    halo = F.col("_batch").isNotNull() & ((step - bucket) * F.col("_width") <= reach * 1.01) & (bucket > 0)
    spread = F.when(halo, F.array(bucket, bucket - 1)).otherwise(F.array(bucket))
    placed = placed.select("batch", "ts", "z", "w", bucket.alias("_own"), F.explode(spread).alias("_bucket")).withColumn(
        "home", F.col("_own") == F.col("_bucket")).drop("_own")
    placed = cut(placed)
    crowded = placed.groupBy("batch", "_bucket").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * rows_per_block)
    crowded = crowded.select(F.col("batch").alias("_b"), F.col("_bucket").alias("_k"), F.ceil(F.col("n") / rows_per_block).alias("_blocks"))
    gridded = placed.join(crowded, F.col("batch").eqNullSafe(F.col("_b")) & (F.col("_bucket") == F.col("_k")), "left")
    gridded = gridded.withColumn("_blocks", F.coalesce("_blocks", F.lit(1).cast("bigint"))) \
        .withColumn("block", F.pmod(F.xxhash64("ts", "z"), F.col("_blocks"))) \
        .withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)))
    cells = gridded.select("batch", "_bucket", F.least("block", "_other").alias("_low"), F.greatest("block", "_other").alias("_high"),
                           "block", "home", "ts", "z", "w")

    def cell(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        low, high = key[2:]
        part = part[part["ts"].notna()].sort_values("ts", kind="stable")
        left = part[part["block"] == low]
        right = left if low == high else part[part["block"] == high]
        pairs, total = 0, 0.0
        if low == high:  # copies of one row: no distance, no time between them
            w = left.loc[left["home"], "w"].to_numpy(np.int64)
            twins = w * (w - 1) // 2
            pairs = int(twins.sum())
            total = float(twins.sum() * fold(np.zeros(1), np.zeros(1))[0]) if pairs else 0.0
        if len(left) and len(right):
            t, other = left["ts"].to_numpy(), right["ts"].to_numpy()
            near, far = np.stack(left["z"]), np.stack(right["z"])
            wl, wr, hl, hr = (side[c].to_numpy() for c in ("w", "home") for side in (left, right))
            slack = reach * 1e-6 + np.abs(t) * 1e-12
            begin = np.arange(1, len(t) + 1) if low == high else np.searchsorted(other, t - reach - slack, side="left")
            end = np.maximum(np.searchsorted(other, t + reach + slack, side="right"), begin)
            for i, j in _ranges(begin, end):
                dt = np.abs(t[i] - other[j])
                keep = (dt <= reach) & (hl[i] | hr[j])
                i, j, dt = i[keep], j[keep], dt[keep]
                weight = wl[i] * wr[j]
                pairs += int(weight.sum())
                total += float((weight * fold(np.linalg.norm(near[i] - far[j], axis=1), dt)).sum())
        return pd.DataFrame({"batch": pd.array([None if pd.isna(key[0]) else int(key[0])], "Int64"), "pairs": [pairs], "total": [total]})

    sums = cells.groupBy("batch", "_bucket", "_low", "_high").applyInPandas(cell, "batch bigint, pairs bigint, total double")
    return sums.groupBy("batch").agg(F.sum("pairs").alias("pairs"), F.sum("total").alias("total"))


def _ranges(begin: np.ndarray, end: np.ndarray, at_once: int = 1_000_000):
    """Row i with each of begin[i] .. end[i] - 1, in pieces of about ``at_once`` pairs."""
    size = end - begin
    piece = (np.cumsum(size) - size) // at_once
    for rows in np.split(np.arange(len(size)), np.flatnonzero(np.diff(piece)) + 1):
        n = size[rows]
        if n.sum():
            yield np.repeat(rows, n), np.repeat(begin[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())


def pair_gaps(z: np.ndarray, ts: np.ndarray, max_time_diff: float):
    """Distances and time differences of the pairs within reach, and their row numbers."""
    i, j = np.triu_indices(len(z), 1)
    dt = np.abs(ts[i] - ts[j])
    near = dt <= max_time_diff
    i, j, dt = i[near], j[near], dt[near]
    return np.linalg.norm(z[i] - z[j], axis=1), dt, i, j


def _penalties(d: np.ndarray, dt: np.ndarray, kind: str) -> np.ndarray:
    if kind == "FRD":
        r = np.abs(d - dt)
        return np.where(r <= 1, 0.5 * r * r, r - 0.5)
    return np.maximum(d - dt, 0) ** 2


def path_losses(paths: DataFrame, positions: DataFrame, width: int | None = None) -> DataFrame:
    """Geodesic misfit and triangle penalty of chart positions along paths: one row.

    ``paths`` has (``path_id``, ``nodes``, ``mean``, ``variance``), ``positions`` (``id``, ``x``, ``y``).
    Steps are sqrt(|d|^2 + 1e-6).  With ``width`` every path counts as padded to that many steps by
    repeating its target, as fixed-size batches do.
    """
    steps = paths.select("path_id", "mean", "variance", F.posexplode("nodes").alias("at", "id")).join(positions, "id")
    line = steps.groupBy("path_id").agg(F.first("mean").alias("mean"), F.first("variance").alias("variance"),
                                        F.sort_array(F.collect_list(F.struct("at", "x", "y"))).alias("p"))

    def length(a, b):
        return F.sqrt((a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2 + 1e-6)

    n = F.size("p")
    line = line.withColumn("_steps", F.zip_with(F.slice("p", 1, n - 1), F.slice("p", 2, n - 1), length))
    line = line.withColumn("_ends", length(F.col("p")[0], F.element_at("p", -1)))
    pad = F.lit(0.0) if width is None else F.greatest(F.lit(width) - F.size("_steps"), F.lit(0)) * 1e-3
    miss = total(F.col("_steps")) + pad - F.col("mean")
    excess = total(F.transform("_steps", lambda s: F.greatest(s - F.col("_ends"), F.lit(0.0))))
    return line.agg(F.avg(miss * miss / (F.col("variance") + 1e-6)).alias("geodesic"), F.sum(excess).alias("triangle"))


def acceleration_loss(accelerations: DataFrame, variance: float = 1.7) -> DataFrame:
    return accelerations.agg(F.coalesce(F.avg(F.col("acceleration_sq") / variance), F.lit(0.0)).alias("loss"))
