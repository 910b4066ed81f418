"""Positions from time differences of arrival.

Every row tries all triples of its usable receivers that contain the first one, keeps the fit with
most inliers (then the least mean residual, then the first), and refits on the inliers.  Rows are
independent: Spark spreads them, and inside a task a batch of rows is solved at once.  The same
function maps a streaming DataFrame.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPEED_OF_LIGHT = 299_792_458.0

# Receiver positions of the measured site in metres (x, y, z).
RECEIVERS = [
    [15.690, 11.341, 3.875],
    [35.004, 9.973, 6.212],
    [57.143, 11.853, 5.627],
    [89.658, 9.890, 5.672],
    [60.456, 22.993, 6.505],
    [62.589, 33.680, 6.880],
    [35.558, 36.878, 7.399],
    [15.846, 32.012, 3.826],
]

SCHEMA = "id bigint, x double, y double, z double, inliers array<boolean>, success boolean"


def _fit(receivers, rd, use, fixed_dim, fixed_value, rounds=20, tolerance=1e-6):
    """Damped Gauss-Newton for many rows: receivers (m, 3), rd and use (rows, m)."""
    free = [d for d in range(receivers.shape[1]) if d != fixed_dim]
    rows = np.arange(len(rd))
    first = use.argmax(axis=1)
    others = use.copy()
    others[rows, first] = False
    pos = (use[:, :, None] * receivers[None]).sum(axis=1) / use.sum(axis=1)[:, None]
    pos[:, fixed_dim] = fixed_value
    going = np.ones(len(rd), bool)
    for _ in range(rounds):
        away = pos[:, None, :] - receivers[None]
        dist = np.sqrt((away ** 2).sum(axis=2))
        miss = np.where(others, rd - (dist - dist[rows, first][:, None]), 0.0)
        going &= ~(np.sqrt((miss ** 2).sum(axis=1)) < tolerance)
        if not going.any():
            break
        unit = away / (dist + 1e-10)[:, :, None]
        jac = np.where(others[:, :, None], unit - unit[rows, first][:, None, :], 0.0)[:, :, free]
        a = np.einsum("rmi,rmj->rij", jac, jac) + 1e-8 * np.eye(2)
        b = np.einsum("rmi,rm->ri", jac, miss)
        det = a[:, 0, 0] * a[:, 1, 1] - a[:, 0, 1] * a[:, 1, 0]
        step = np.stack([a[:, 1, 1] * b[:, 0] - a[:, 0, 1] * b[:, 1],
                         a[:, 0, 0] * b[:, 1] - a[:, 1, 0] * b[:, 0]], axis=1) / det[:, None]
        pos[:, free] += np.where(going[:, None], step, 0.0)
    return pos


def solve(toas: np.ndarray, receivers: np.ndarray, speed: float, fixed_dim: int, fixed_value: float,
          threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, inlier masks and success flags of a batch of rows (rows, receivers)."""
    n, m = toas.shape
    valid = ~np.isnan(toas)
    rd = np.where(valid, toas, 0.0) * speed
    first = valid.argmax(axis=1)
    usable = valid.sum(axis=1) >= 3
    best_count, best_miss = np.zeros(n, int), np.full(n, np.inf)
    best_pos, best_in = np.full((n, 3), np.nan), np.zeros((n, m), bool)
    with np.errstate(all="ignore"):
        for j, k in combinations(range(1, m), 2):
            rows = np.flatnonzero(usable & valid[:, j] & valid[:, k] & (first < j))
            if not len(rows):
                continue
            use = np.zeros((len(rows), m), bool)
            use[:, [j, k]] = True
            use[np.arange(len(rows)), first[rows]] = True
            pos = _fit(receivers, rd[rows], use, fixed_dim, fixed_value)
            dist = np.sqrt(((pos[:, None, :] - receivers[None]) ** 2).sum(axis=2))
            # the measured differences are used as they are: they must be relative to the first receiver
            miss = np.abs(rd[rows] - (dist - dist[np.arange(len(rows)), first[rows]][:, None]))
            inside = (miss < threshold) & valid[rows]
            count = inside.sum(axis=1)
            mean = np.where(count > 0, np.where(inside, miss, 0).sum(axis=1) / np.maximum(count, 1), np.inf)
            better = (count > best_count[rows]) | ((count == best_count[rows]) & (mean < best_miss[rows]))
            won = rows[better]
            best_count[won], best_miss[won] = count[better], mean[better]
            best_pos[won], best_in[won] = pos[better], inside[better]
        refit = np.flatnonzero(best_count >= 3)
        if len(refit):
            best_pos[refit] = _fit(receivers, rd[refit], best_in[refit], fixed_dim, fixed_value)
    success = best_count > 0
    return np.where(success[:, None], best_pos, np.nan), best_in & success[:, None], success


def locate(df: DataFrame, receivers=RECEIVERS, speed_of_signal: float = 3e8, fixed_dim: int = 2,
           fixed_value: float = 1.5, inlier_threshold: float = 2.0) -> DataFrame:
    """Positions for rows of (``id``, ``toa`` ARRAY<DOUBLE> relative to the first usable receiver).

    A row with fewer than three arrivals, or no acceptable fit, keeps a NULL position and
    ``success`` false; it never fails the job.  The receiver table is a constant of a few rows.
    """
    fixed = np.asarray(receivers, dtype=np.float64)

    def run(batches):
        for rows in batches:
            toas = np.array([[np.nan if v is None else v for v in row] for row in rows["toa"]], dtype=np.float64)
            if not len(toas):
                continue
            pos, inside, success = solve(toas, fixed, speed_of_signal, fixed_dim, fixed_value, inlier_threshold)
            yield pd.DataFrame({"id": rows["id"], "x": pos[:, 0], "y": pos[:, 1], "z": pos[:, 2],
                                "inliers": list(inside), "success": success})

    out = df.select(F.col("id").cast("bigint").alias("id"), F.col("toa").cast("array<double>").alias("toa")) \
        .mapInPandas(run, SCHEMA)
    for c in ("x", "y", "z"):
        out = out.withColumn(c, F.when(F.col("success"), F.col(c)))
    return out


def success_rate(positions: DataFrame) -> DataFrame:
    return positions.agg(F.avg(F.col("success").cast("double")).alias("success_rate"))
