"""Exact k-means on whole numbers, with a vantage-point tree over the centroids.

Components become floor(256 * x), so that distances, sums and ties are exact.  Each round builds the tree
of the centroids, sends it to all tasks (its size is that of ``k`` centroids) and reads the vectors once.
A vector opens tree nodes in the order of the least distance that they can hold, and stops at the first
that lies beyond its best one; nodes at just that distance are opened, since they may hold a smaller
number.  Tasks return a sum and a count per centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from kartograf.llm.base import stored

CENTROIDS = 40
ROUNDS = 5
COMPONENTS = 64
SCALE = 256
BUCKET = 4  # centroids of a leaf
MOST = np.iinfo(np.int64).max


class VantageTree:
    """Nodes over numbered centroids: a vantage point, two children, and the range of distances from the point in each."""

    def __init__(self, centroids: np.ndarray, bucket: int = BUCKET):
        self.centroids = centroids.astype(np.int64)
        self.nodes: list[tuple] = []  # ("leaf", numbers) or ("point", number, [(child, nearest, farthest), ...])
        if len(centroids):
            self._build(np.arange(len(centroids)), bucket)

    def _build(self, own: np.ndarray, bucket: int) -> int:
        at = len(self.nodes)
        self.nodes.append(("leaf", own))
        if len(own) > bucket:
            squares = ((self.centroids[own][:, None] - self.centroids[own][None]) ** 2).sum(axis=2)
            best = int(np.sqrt(squares).var(axis=1).argmax())  # tells the others apart best
            away, rest = np.sqrt(np.delete(squares[best], best)), np.delete(own, best)
            near = away <= np.median(away)
            parts = [(away[m], rest[m]) for m in (near, ~near) if m.any()]
            self.nodes[at] = ("point", int(own[best]), [(self._build(r, bucket), float(a.min()), float(a.max())) for a, r in parts])
        return at

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of each row's nearest centroid; of equally near ones the smallest number."""
        n = len(rows)
        best, squared = np.full(n, -1, dtype=np.int64), np.full(n, MOST)
        if not self.nodes:
            return best, squared
        open_ = np.full((n, len(self.nodes)), np.inf)
        open_[:, 0] = 0.0
        active = np.arange(n)

        def offer(at: np.ndarray, number: int) -> np.ndarray:
            d = ((rows[at] - self.centroids[number]) ** 2).sum(axis=1)
            better = (d < squared[at]) | ((d == squared[at]) & (number < best[at]))
            best[at[better]], squared[at[better]] = number, d[better]
            return d

        while len(active):
            pick = open_[active].argmin(axis=1)
            # roots are rounded: a node within their error of the best distance is opened too
            inside = open_[active, pick] <= np.sqrt(squared[active].astype(np.float64)) * (1 + 1e-9) + 1e-6
            active, pick = active[inside], pick[inside]
            for k in np.unique(pick).tolist():
                at = active[pick == k]
                open_[at, k] = np.inf
                kind, what, *children = self.nodes[k]
                if kind == "leaf":
                    for number in what.tolist():
                        offer(at, number)
                else:
                    away = np.sqrt(offer(at, what).astype(np.float64))
                    for child, low, high in children[0]:
                        open_[at, child] = np.maximum(np.maximum(away - high, low - away), 0.0)
        return best, squared


def _rows(column: pd.Series, dim: int) -> np.ndarray:
    return np.concatenate([np.asarray(v, dtype=np.int64) for v in column]).reshape(-1, dim) if len(column) else np.zeros((0, dim), dtype=np.int64)


def _summed(tree: VantageTree, dim: int):
    """Per task and centroid: how many vectors are nearest to it, and their sum."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(tree.centroids)
        sums, counts = np.zeros((k, dim), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            rows = _rows(batch["q"], dim)
            own, _ = tree.nearest(rows)
            np.add.at(sums, own, rows)
            counts += np.bincount(own, minlength=k)
        some = np.flatnonzero(counts)
        yield pd.DataFrame({"cluster": some.astype(np.int32), "n": counts[some], "sums": list(sums[some])})

    return run


def _assigned(tree: VantageTree, dim: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own, squared = tree.nearest(_rows(batch["q"], dim))
            yield batch[["id"]].assign(cluster=own.astype(np.int32), distance=squared)

    return run


def whole_vectors(vectors: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """(id as text, q): vectors of ``dim`` finite components as whole numbers."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("string").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    fine = (F.size(v) == dim) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.floor(F.lit(float(SCALE)) * F.col("x"))
    most = int((MOST // dim) ** 0.5 / 2)  # squared distances fit 64 bits
    q = F.transform(v, lambda c: F.when(F.abs(c) <= most / SCALE, F.floor(c * float(SCALE))).otherwise(
        F.raise_error(F.lit(f"a component beyond {most // SCALE} has no exact distance in 64 bits")).cast("bigint")))
    return rows.filter(F.coalesce(fine, F.lit(False))).select("id", q.alias("q"))


def exact_clusters(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS,
                   dim: int = COMPONENTS, seed: int = 2) -> DataFrame:
    """(id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row per vector kept.

    Kept are vectors of exactly ``dim`` components, none NULL or non-finite; components beyond about
    4 * 10^5 raise an error, as their distances would not fit 64 bits.  Centroids start as the ``k``
    vectors with the smallest SHA-256 of ``seed:id``; vectors with a NULL id are assigned, but start no
    centroid; of rows with one id the smaller vector goes first.  With fewer vectors than ``k``, fewer
    centroids.  Equally near centroids: the smallest number.  Empty clusters keep their centroid.
    Repeated rows are vectors like others.  An empty table gives no rows.  Other columns are not read.
    """
    spark = vectors.sparkSession
    kept = stored(whole_vectors(vectors, id_col, vec_col, dim), "whole")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id")), 256)
    first = kept.filter("id IS NOT NULL").orderBy(name, "q").limit(k).select("q").collect()
    centroids = np.array([r["q"] for r in first], dtype=np.int64).reshape(-1, dim)
    if not len(centroids):
        return kept.filter("false").select(F.col("id").cast(vectors.schema[id_col].dataType).alias(id_col), F.lit(0).alias("cluster"), *[
            F.lit(0).cast("bigint").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    for _ in range(rounds):
        tasks = kept.select("q").mapInPandas(_summed(VantageTree(centroids), dim), "cluster int, n bigint, sums array<bigint>")
        # exact past 64 bits: a sum of whole decimals
        total = [F.sum(F.col("sums")[j].cast("decimal(20,0)")).alias(f"s{j}") for j in range(dim)]
        for row in tasks.groupBy("cluster").agg(F.sum("n").alias("n"), *total).collect():
            centroids[row["cluster"]] = [int(row[f"s{j}"]) // row["n"] for j in range(dim)]
    found = stored(kept.mapInPandas(_assigned(VantageTree(centroids), dim), "id string, cluster int, distance bigint"), "assigned")
    inertia = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    whole = sum(inertia.values())
    facts = spark.createDataFrame([Row(_cluster=c, cluster_inertia=s, inertia=whole, centroid_sha256=digest[c]) for c, s in sorted(inertia.items())],
                                  "_cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    # a row per centroid
    return found.join(F.broadcast(facts), F.col("cluster") == F.col("_cluster")).select(
        F.col("id").cast(vectors.schema[id_col].dataType).alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
