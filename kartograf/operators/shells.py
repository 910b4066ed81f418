"""Chunks of a metric space: rows by nearest pivot, split into shells of distance to it, and which chunks can hold a near row.

With about the square root of the rows as pivots, placing and routing cost n * sqrt(n) distances.  The driver holds the
pivots and three numbers per chunk: sqrt(n) vectors and n / ``rows_per_block`` + sqrt(n) numbers, never the rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartograf.session import cut

#: A crowded pivot has at most so many shells; what a shell holds beyond a block is split by hash.
SHELLS = 64
CELLS_AT_ONCE = 500_000


@dataclass(frozen=True)
class Shells:
    """``points`` (``vid``, ``f``, ``_chunk``, ``_reach``) and the chunks' extents, numbered by pivot, shell and part."""

    points: DataFrame
    centers: np.ndarray
    first: np.ndarray  # first chunk of each pivot, and the number of chunks at the end
    low: np.ndarray
    high: np.ndarray

    @property
    def chunks(self) -> int:
        return len(self.low)

    def visits(self, bounded: DataFrame, metric, slack: float) -> DataFrame:
        """(``_chunk``, ``query``): the chunks that can hold a row within ``_bound`` of a row of ``bounded`` (``vid``, ``f``, ``_bound``).

        A row at distance q of a pivot is at least q - high and low - q from the rows of a chunk between low and high.
        Pivots are tried first, then the shells of those that pass.
        """
        centers, first, low, high = self.centers, self.first, self.low, self.high
        count = np.diff(first)
        inner, outer = np.full(len(count), np.inf), np.full(len(count), -np.inf)
        np.minimum.at(inner, np.repeat(np.arange(len(count)), count), low)
        np.maximum.at(outer, np.repeat(np.arange(len(count)), count), high)

        def route(batches):
            step = max(1, CELLS_AT_ONCE // len(centers))
            for whole in batches:
                for a in range(0, len(whole), step):
                    rows = whole.iloc[a:a + step]
                    q = metric.bent(metric.between(stacked(rows["f"]), centers))
                    reach = metric.bent(rows["_bound"].to_numpy() + slack) * (1 + 1e-9) + metric.blur
                    r, p = np.nonzero((q - outer <= reach[:, None]) & (inner - q <= reach[:, None]))
                    for b in range(0, len(r), 65536):
                        i, at = r[b:b + 65536], p[b:b + 65536]
                        n = count[at]
                        i, own = np.repeat(i, n), np.repeat(q[i, at], n)
                        chunk = np.repeat(first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
                        near = (own - high[chunk] <= reach[i]) & (low[chunk] - own <= reach[i])
                        yield pd.DataFrame({"_chunk": chunk[near], "query": rows["vid"].to_numpy()[i[near]]})

        return bounded.mapInPandas(route, "_chunk bigint, query bigint")


def stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def lay_shells(points: DataFrame, metric, k: int, rows_per_block: int, pivots: int | None = None) -> Shells:
    """Place distinct rows (``vid``, ``f``).  ``_reach`` bounds a row's k-th distance by its distances to the pivots, which are rows."""
    n = points.count()
    sample = points.orderBy(F.xxhash64("vid"), "vid").limit(pivots or max(16, isqrt(n))).toPandas()
    centers = stacked(sample["f"])

    def place(batches):
        step = max(1, CELLS_AT_ONCE // len(centers))
        for whole in batches:
            for a in range(0, len(whole), step):
                rows = whole.iloc[a:a + step]
                d = metric.between(stacked(rows["f"]), centers)
                reach = np.partition(d, k, axis=1)[:, k] if len(centers) > k else np.full(len(rows), np.inf)
                yield rows.assign(_pivot=d.argmin(axis=1), _dp=metric.bent(d.min(axis=1)), _reach=reach)

    placed = cut(points.mapInPandas(place, "vid bigint, f array<double>, _pivot int, _dp double, _reach double"))
    per_pivot = placed.groupBy("_pivot").agg(F.count("*").alias("n"))
    crowded = per_pivot.filter(F.col("n") > rows_per_block)
    steps = [s / SHELLS for s in range(1, SHELLS)]
    grades = placed.join(crowded, "_pivot").groupBy("_pivot").agg(F.first("n").alias("n"), F.percentile_approx("_dp", steps).alias("q"))
    edges = {}
    for row in grades.collect():
        shells = min(SHELLS, -(-row["n"] // rows_per_block))
        edges[row["_pivot"]] = np.unique([row["q"][s * SHELLS // shells - 1] for s in range(1, shells)])

    def shell(batches):
        for rows in batches:
            pivot, dp = rows["_pivot"].to_numpy(), rows["_dp"].to_numpy()
            number = np.zeros(len(rows), np.int64)
            for p in np.unique(pivot):
                if p in edges:
                    number[pivot == p] = np.searchsorted(edges[p], dp[pivot == p], side="left")
            yield rows.assign(_shell=number)

    shelled = placed.mapInPandas(shell, "vid bigint, f array<double>, _pivot int, _dp double, _reach double, _shell bigint")
    shelled = cut(shelled)
    extent = shelled.groupBy("_pivot", "_shell").agg(F.count("*").alias("n"), F.min("_dp").alias("lo"), F.max("_dp").alias("hi")) \
        .toPandas().sort_values(["_pivot", "_shell"])
    parts = -(-extent["n"].to_numpy(np.int64) // (2 * rows_per_block))
    start = np.cumsum(parts) - parts
    layout = {key: (int(s), int(m)) for key, s, m in zip(zip(extent["_pivot"], extent["_shell"]), start, parts)}

    def number(batches):
        for rows in batches:
            at = np.array([layout[key] for key in zip(rows["_pivot"], rows["_shell"])], np.int64).reshape(-1, 2)
            yield rows[["vid", "f", "_reach"]].assign(_chunk=at[:, 0] + rows["_part"].to_numpy(np.int64) % at[:, 1])

    chunked = shelled.withColumn("_part", F.pmod(F.xxhash64("vid"), F.lit(1 << 40))) \
        .mapInPandas(number, "vid bigint, f array<double>, _reach double, _chunk bigint")
    per = np.zeros(len(centers), np.int64)
    np.add.at(per, extent["_pivot"].to_numpy(np.int64), parts)
    return Shells(chunked, centers, np.concatenate([[0], np.cumsum(per)]), np.repeat(extent["lo"].to_numpy(), parts),
                  np.repeat(extent["hi"].to_numpy(), parts))
