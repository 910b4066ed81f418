"""Scores of a chart against reference positions, and the tables behind the plots."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartograf.operators.pairs import (Dissimilarity, MISSING_DISTANCE, ROWS_PER_BLOCK, flat, fold_pairs, nearest_neighbors,
                                       ranks_among_all, squares)
from kartograf.operators.quantiles import ecdf, exact_quantiles
from kartograf.session import scalars

__all__ = ["ecdf", "exact_quantiles"]

EUCLIDEAN = Dissimilarity("euclidean")
FIRST = 1024  # parts of a bin that are counted first
ERROR_LEVELS = (0.5, 0.75, 0.9, 0.95, 0.99)


def align_affine(df: DataFrame, pred=("px", "py"), truth=("gx", "gy"), out=("ax", "ay")) -> DataFrame:
    """Least-squares affine map from prediction to truth, fitted on all rows and applied.

    One aggregation yields the means and second moments; the 2x2 system is solved for two numbers
    per output and goes back as literals.
    """
    (px, py), (gx, gy) = pred, truth
    m = df.agg(
        *[F.avg(c).alias(f"m_{i}") for i, c in enumerate((px, py, gx, gy))],
        F.var_pop(px).alias("xx"), F.covar_pop(px, py).alias("xy"), F.var_pop(py).alias("yy"),
        *[F.covar_pop(p, g).alias(f"c_{i}{j}") for i, p in enumerate((px, py)) for j, g in enumerate((gx, gy))],
    ).first()
    if m["xx"] is None:
        return df.withColumn(out[0], F.lit(None).cast("double")).withColumn(out[1], F.lit(None).cast("double"))
    moments = np.array([[m["xx"], m["xy"]], [m["xy"], m["yy"]]])
    cross = np.array([[m["c_00"], m["c_01"]], [m["c_10"], m["c_11"]]])
    coef = np.linalg.lstsq(moments, cross, rcond=None)[0]
    for j, name in enumerate(out):
        df = df.withColumn(name, F.lit(m[f"m_{2 + j}"]) + (F.col(px) - F.lit(m["m_0"])) * F.lit(float(coef[0, j]))
                           + (F.col(py) - F.lit(m["m_1"])) * F.lit(float(coef[1, j])))
    return df


def with_error(df: DataFrame, pred=("ax", "ay"), truth=("gx", "gy"), name: str = "error") -> DataFrame:
    dx, dy = F.col(pred[0]) - F.col(truth[0]), F.col(pred[1]) - F.col(truth[1])
    return df.withColumn(name, F.sqrt(dx * dx + dy * dy))


def error_summary(df: DataFrame, error: str = "error", valid: str | None = "valid") -> DataFrame:
    """One row: CE50, CE75, CE90, CE95, CE99 and MAE over the valid rows."""
    used = df.filter(F.col(valid)) if valid else df
    q = exact_quantiles(used, error, ERROR_LEVELS).groupBy().agg(
        *[F.max(F.when(F.abs(F.col("p") - p) < 1e-9, F.col("q"))).alias(f"CE{round(p * 100)}") for p in ERROR_LEVELS])
    return q.withColumn("MAE", used.agg(F.avg(error)).scalar())


def _points(df: DataFrame, columns, id: str) -> DataFrame:
    return df.select(F.col(id).cast("bigint").alias("id"), F.array(*[F.col(c).cast("double") for c in columns]).alias("f"))


def trustworthiness(df: DataFrame, truth=("gx", "gy"), pred=("px", "py"), k: int = 5, id: str = "id",
                    rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """How far chart neighbours are from being neighbours in truth: one row, 1 is perfect.

    Neighbours come from the exact neighbour join; only for those n x k pairs is the rank in the
    other space counted, so no full ranking of all pairs is built.
    """
    n = df.count()
    near = nearest_neighbors(_points(df, pred, id), k, EUCLIDEAN, rows_per_block=rows_per_block)
    ranked = ranks_among_all(_points(df, truth, id), near, EUCLIDEAN, rows_per_block)
    over = F.greatest(F.col("nearer") + 1 - k, F.lit(0))
    scale = 2.0 / (n * k * (2.0 * n - 3.0 * k - 1.0))
    return ranked.agg((1.0 - F.sum(over) * scale).alias("trustworthiness"))


def continuity(df: DataFrame, truth=("gx", "gy"), pred=("px", "py"), k: int = 5, id: str = "id",
               rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    swapped = trustworthiness(df, pred, truth, k, id, rows_per_block)
    return swapped.withColumnRenamed("trustworthiness", "continuity")


def kruskal_stress(df: DataFrame, truth=("gx", "gy"), pred=("px", "py"), id: str = "id",
                   rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Scale-free misfit of all pair distances: one row.

    Each grid cell returns three sums; with b = sum(de)/sum(ee), the squared misfit is
    sum(dd) - sum(de)^2/sum(ee).
    """
    rows = _points(df, (*truth, *pred), id)

    def sums(left, right, same):
        de = ee = dd = 0.0
        for (x,), (y,), above in squares(left, right, same, ("f",)):
            d = flat(EUCLIDEAN.between(x[:, :2], y[:, :2]), above)
            e = flat(EUCLIDEAN.between(x[:, 2:], y[:, 2:]), above)
            de, ee, dd = de + float(d @ e), ee + float(e @ e), dd + float(d @ d)
        return pd.DataFrame({"de": [de], "ee": [ee], "dd": [dd]})

    total = fold_pairs(rows, sums, "de double, ee double, dd double", rows_per_block).agg(
        F.sum("de").alias("de"), F.sum("ee").alias("ee"), F.sum("dd").alias("dd"))
    left = F.col("dd") - F.try_divide(F.col("de") * F.col("de"), F.col("ee"))
    return total.select(F.sqrt(F.greatest(F.try_divide(left, F.col("dd")), F.lit(0.0))).alias("kruskal_stress"))


def dissimilarity_bands(pairs: DataFrame, d: str = "d", distance: str = "e", edges: int = 200,
                        empty: float | None = 0.0) -> DataFrame:
    """Quartiles of dissimilarity in equal bins of true distance: (``bin``, ``left``, ``p25``, ``p50``, ``p75``).

    ``edges`` points from 0 to the largest distance bound 199 half-open bins; the largest distance
    itself falls outside.  Empty bins hold ``empty``.
    """
    step = F.col("_top") / (edges - 1)
    binned = pairs.withColumn("_top", pairs.agg(F.max(distance)).scalar()).withColumn(
        "bin", F.floor(F.try_divide(F.col(distance), step)).cast("int") + 1)
    binned = binned.filter((F.col("bin") < edges) & (F.col(distance) < F.col("_top"))).select("bin", d)
    q = exact_quantiles(binned, d, (0.25, 0.5, 0.75), ["bin"]).groupBy("bin").agg(
        *[F.max(F.when(F.col("p") == p, F.col("q"))).alias(name) for p, name in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))])
    every = pairs.agg(F.max(distance).alias("_top")).select(F.explode(F.sequence(F.lit(1), F.lit(edges - 1))).alias("bin"), "_top")
    filled = [F.coalesce(c, F.lit(empty).cast("double")).alias(c) for c in ("p25", "p50", "p75")]
    return every.join(q, "bin", "left").select("bin", ((F.col("bin") - 1) * F.col("_top") / (edges - 1)).alias("left"), *filled)


def _box(df: DataFrame, x: str, y: str):
    """Extremes of two columns as a struct (x0, x1, y0, y1)."""
    return scalars(df, x0=F.min(x), x1=F.max(x), y0=F.min(y), y1=F.max(y))


def histogram_2d(df: DataFrame, x: str, y: str, bins: int = 100) -> DataFrame:
    """Counts in a bins x bins grid between the extremes, the last bins closed: (``bx``, ``by``, ``n``)."""
    df = df.withColumn("_ends", _box(df, x, y))

    def place(c, axis):
        lo, hi = F.col(f"_ends.{axis}0"), F.col(f"_ends.{axis}1")
        return F.least(F.floor((F.col(c) - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int")

    return df.groupBy(place(x, "x").alias("bx"), place(y, "y").alias("by")).agg(F.count(F.lit(1)).alias("n"))


def _both(left: pd.DataFrame, right: pd.DataFrame, same: bool, metric: Dissimilarity):
    """True distances and dissimilarities of the pairs of a cell, a square at a time; undefined dissimilarities are 1e10."""
    for (f, p), (g, q), above in squares(left, right, same, ("f", "p")):
        d = flat(metric.between(f, g), above)
        if not np.isfinite(d.sum()):
            d = np.nan_to_num(d, nan=MISSING_DISTANCE)
        yield flat(EUCLIDEAN.between(p, q), above), d


def pair_histogram_2d(df: DataFrame, metric: Dissimilarity, bins: int = 100,
                      rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """``histogram_2d`` of true distance against dissimilarity over all pairs, folded in the grid.

    ``df`` has ``id``, ``f`` and the position ``p`` ARRAY<DOUBLE>.  Undefined dissimilarities count
    as 1e10.  A first fold finds the extremes, a second one counts.
    """

    def extremes(left, right, same):
        ends = [(e.min(), e.max(), d.min(), d.max()) for e, d in _both(left, right, same, metric) if e.size]
        if not ends:
            return pd.DataFrame({"e0": [], "e1": [], "d0": [], "d1": []})
        e0, e1, d0, d1 = zip(*ends)
        return pd.DataFrame({"e0": [min(e0)], "e1": [max(e1)], "d0": [min(d0)], "d1": [max(d1)]})

    lim = fold_pairs(df, extremes, "e0 double, e1 double, d0 double, d1 double", rows_per_block).agg(
        F.min("e0").alias("e0"), F.max("e1").alias("e1"), F.min("d0").alias("d0"), F.max("d1").alias("d1")).first()

    def place(v, low, high):
        v = v - low
        v /= (high - low) / bins
        return np.minimum(v.astype(np.int32), bins - 1)

    def count(left, right, same):
        n = np.zeros(bins * bins, np.int64)
        for e, d in _both(left, right, same, metric):
            key = place(e, lim["e0"], lim["e1"])
            key *= bins
            key += place(d, lim["d0"], lim["d1"])
            n += np.bincount(key, minlength=len(n))
        bx, by = np.divmod(np.flatnonzero(n), bins)
        return pd.DataFrame({"bx": bx, "by": by, "n": n[n > 0]})

    counted = fold_pairs(df, count, "bx int, by int, n bigint", rows_per_block)
    return counted.groupBy("bx", "by").agg(F.sum("n").alias("n"))


class _Cells:
    """Intervals of values inside bins, disjoint within a bin, each to be counted in ``parts`` equal parts."""

    def __init__(self, cells: list[tuple[int, float, float]], parts: int):
        cells = sorted(cells)
        self.parts = parts
        self.bins = np.array([b for b, _, _ in cells], np.int64)
        self.low = np.array([lo for _, lo, _ in cells])
        self.high = np.array([hi for _, _, hi in cells])
        self.at = {b: (int(np.searchsorted(self.bins, b)), int(np.searchsorted(self.bins, b, side="right"))) for b in set(self.bins.tolist())}

    def count(self, bins: np.ndarray, values: np.ndarray, weight: int, total: dict) -> None:
        """Adds (weight, least, largest) of the values that fall into each part of each cell."""
        order = np.argsort(bins, kind="stable")
        bins, values = bins[order], values[order]
        for b, (first, last) in self.at.items():
            own = values[np.searchsorted(bins, b):np.searchsorted(bins, b, side="right")]
            cell = first + np.searchsorted(self.low[first:last], own, side="right") - 1
            inside = (cell >= first) & (own <= self.high[np.maximum(cell, first)])
            own, cell = own[inside], cell[inside]
            if not len(own):
                continue
            width = np.where(self.high[cell] > self.low[cell], self.high[cell] - self.low[cell], 1.0)
            part = np.minimum((own - self.low[cell]) / width * self.parts, self.parts - 1).astype(np.int64)
            key = cell * self.parts + part
            by = np.argsort(key, kind="stable")
            key, own = key[by], own[by]
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.append(start, len(key))) * weight
            for k, n, lo, hi in zip(key[start].tolist(), sizes.tolist(), np.minimum.reduceat(own, start).tolist(), np.maximum.reduceat(own, start).tolist()):
                had = total.get(k)
                total[k] = (n, lo, hi) if had is None else (had[0] + n, min(had[1], lo), max(had[2], hi))


def pair_bands(df: DataFrame, metric: Dissimilarity, edges: int = 200, levels=(0.25, 0.5, 0.75), empty: float | None = 0.0,
               whole: bool = False, rows_per_block: int = ROWS_PER_BLOCK, parts: int = 512) -> DataFrame:
    """``dissimilarity_bands`` over all pairs, without a list of them: (``bin``, ``left``, ``p25``, ``p50``, ``p75``).

    ``df`` has ``id``, ``f`` and the position ``p`` ARRAY<DOUBLE>.  Pairs are i < j, or with ``whole``
    the square matrix: both triangles and the diagonal.  Undefined dissimilarities count as 1e10.

    Quantiles are exact, by refinement: the grid of pairs is computed anew in every pass, and tasks
    return counts and extremes of parts of the cells that still hold a wanted rank.  A rank is known
    once its cell holds one value or it is the first or last in it.  The first pass counts every bin in
    ``FIRST`` parts by one running number per pair; later ones look only at values whose first part holds a
    wanted rank, and narrow a cell ``parts`` times, so passes grow with the logarithm of the pairs.  No more
    than bins x ``FIRST`` or bins x ranks x ``parts`` counts reach the driver.
    """

    def met(left, right, same):
        """(distance, dissimilarity, weight) of the pairs of a cell, a square at a time."""
        for e, d in _both(left, right, same, metric):
            if e.size:
                yield e, d, 2 if whole else 1
        if same and whole:
            for a in range(0, len(left), 256):
                (f, p), (_, _), _ = next(squares(left.iloc[a:a + 256], left.iloc[a:a + 256], True, ("f", "p")))
                d = np.nan_to_num(np.diagonal(metric.between(f, f)), nan=MISSING_DISTANCE)
                yield np.diagonal(EUCLIDEAN.between(p, p)), d, 1

    def extremes(left, right, same):
        ends = [(e.max(), d.min(), d.max()) for e, d, _ in met(left, right, same)]
        return pd.DataFrame({"e1": [max(v[0] for v in ends)], "d0": [min(v[1] for v in ends)], "d1": [max(v[2] for v in ends)]} if ends else {"e1": [], "d0": [], "d1": []})

    spark = df.sparkSession
    ends = fold_pairs(df, extremes, "e1 double, d0 double, d1 double", rows_per_block).agg(
        F.max("e1").alias("e1"), F.min("d0").alias("d0"), F.max("d1").alias("d1")).first()
    top = ends["e1"]
    names = [f"p{round(100 * p)}" for p in levels]
    schema = "bin int, left double, " + ", ".join(f"{c} double" for c in names)
    if top is None:
        return spark.createDataFrame([], schema)
    step = top / (edges - 1)

    low, width = ends["d0"], (ends["d1"] - ends["d0"]) or 1.0
    first = FIRST

    def placed(e, d):
        """Bin (from 0) and first part of a pair as one number; pairs in no bin come last."""
        bins = e / step
        bins[~(e < top)] = edges - 1
        key = np.minimum(bins.astype(np.int32), edges - 1)
        part = d - low
        part /= width
        part *= first
        key *= first
        key += np.minimum(part.astype(np.int32), first - 1)
        return key

    def collected(run) -> dict[int, tuple[int, float, float]]:
        folded = fold_pairs(df, run, "k bigint, n bigint, lo double, hi double", rows_per_block).groupBy("k").agg(
            F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).toPandas()
        return {k: v for k, *v in zip(*[folded[c].tolist() for c in ("k", "n", "lo", "hi")])}

    def dense(left, right, same):
        n, lo, hi = np.zeros(edges * first, np.int64), np.full(edges * first, np.inf), np.full(edges * first, -np.inf)
        for e, d, weight in met(left, right, same):
            key = placed(e, d)
            n += weight * np.bincount(key, minlength=len(n))
            np.minimum.at(lo, key, d)
            np.maximum.at(hi, key, d)
        at = np.flatnonzero(n[:(edges - 1) * first])
        return pd.DataFrame({"k": at, "n": n[at], "lo": lo[at], "hi": hi[at]})

    def counted(cells: _Cells, open_: np.ndarray) -> dict[int, tuple[int, float, float]]:
        def run(left, right, same):
            total: dict = {}
            for e, d, weight in met(left, right, same):
                key = placed(e, d)
                near = np.flatnonzero(open_[key])
                cells.count(key[near] // first + 1, d[near], weight, total)
            return pd.DataFrame([(k, *v) for k, v in total.items()], columns=["k", "n", "lo", "hi"])

        return collected(run)

    known: dict[tuple[int, int], float] = {}
    wanted: dict[tuple[int, float, float], list[tuple[int, int]]] = {}  # cell to (rank in it, rank in its bin)
    cells, sizes = _Cells([(b, ends["d0"], ends["d1"]) for b in range(1, edges)] if top > 0 else [], first), {}
    found = collected(dense) if top > 0 else {}
    for k, (n, _, _) in found.items():
        b = int(cells.bins[k // first])
        sizes[b] = sizes.get(b, 0) + n
    for b, n in sizes.items():
        ranks = {f(p * (n - 1)) for p in levels for f in (math.floor, math.ceil)}
        wanted[(b, ends["d0"], ends["d1"])] = [(r, r) for r in sorted(ranks)]
    while wanted:
        after: dict[tuple[int, float, float], list[tuple[int, int]]] = {}
        by_cell: dict[int, list[tuple[int, tuple]]] = {}
        for k in sorted(found):
            by_cell.setdefault(k // cells.parts, []).append((k, found[k]))
        for c, split in by_cell.items():
            b = int(cells.bins[c])
            asked, below = wanted.get((b, float(cells.low[c]), float(cells.high[c])), []), 0
            for _, (n, lo, hi) in split:
                for rank, name in asked:
                    at = rank - below
                    if 0 <= at < n:
                        if at == 0 or at == n - 1 or lo == hi:
                            known[b, name] = lo if at == 0 else hi
                        else:
                            after.setdefault((b, lo, hi), []).append((at, name))
                below += n
        wanted = after
        if wanted:
            cells = _Cells(list(wanted), parts)
            open_ = np.zeros(edges * first, bool)
            open_[placed((cells.bins - 0.5) * step, cells.low)] = True
            found = counted(cells, open_)
    rows = []
    for b in range(1, edges):
        n, line = sizes.get(b, 0), []
        for p in levels:
            if not n:
                line.append(empty)
                continue
            at = p * (n - 1)
            low, high = known[b, math.floor(at)], known[b, math.ceil(at)]
            line.append(low + (high - low) * (at - math.floor(at)))
        rows.append((b, (b - 1) * top / (edges - 1), *line))
    return spark.createDataFrame(rows, schema)


def hexbin_mean(df: DataFrame, x: str, y: str, value: str, gridsize: int = 100) -> DataFrame:
    """Mean value per hexagon: (``lattice``, ``hx``, ``hy``, ``cx``, ``cy``, ``mean``, ``n``).

    Two rectangular lattices, the second shifted by half a cell; a point belongs to the nearer
    centre, y counted three times because the cells are flatter than wide.
    """
    nx, ny = gridsize, int(gridsize / 3 ** 0.5)
    df = df.withColumn("_e", _box(df, x, y))
    pad = 1e-9 * (F.col("_e.x1") - F.col("_e.x0"))
    df = df.withColumn("_x0", F.col("_e.x0") - pad).withColumn("_y0", F.col("_e.y0")) \
        .withColumn("_sx", (F.col("_e.x1") - F.col("_e.x0") + 2 * pad) / nx) \
        .withColumn("_sy", (F.col("_e.y1") - F.col("_e.y0")) / ny)
    u, v = (F.col(x) - F.col("_x0")) / F.col("_sx"), (F.col(y) - F.col("_y0")) / F.col("_sy")
    df = df.withColumn("_u", u).withColumn("_v", v)
    u, v = F.col("_u"), F.col("_v")
    d1 = (u - F.rint(u)) ** 2 + 3.0 * (v - F.rint(v)) ** 2
    d2 = (u - F.floor(u) - 0.5) ** 2 + 3.0 * (v - F.floor(v) - 0.5) ** 2
    even = d1 < d2
    df = df.withColumn("lattice", F.when(even, 1).otherwise(2)) \
        .withColumn("hx", F.when(even, F.rint(u)).otherwise(F.floor(u)).cast("int")) \
        .withColumn("hy", F.when(even, F.rint(v)).otherwise(F.floor(v)).cast("int"))
    shift = F.when(F.col("lattice") == 2, 0.5).otherwise(0.0)
    df = df.withColumn("cx", (F.col("hx") + shift) * F.col("_sx") + F.col("_x0")) \
        .withColumn("cy", (F.col("hy") + shift) * F.col("_sy") + F.col("_y0"))
    return df.groupBy("lattice", "hx", "hy").agg(F.first("cx").alias("cx"), F.first("cy").alias("cy"),
                                                 F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))


def chart_colors(df: DataFrame, x: str = "gx", y: str = "gy") -> DataFrame:
    """Colour of each point by its true position: red falls with x, blue grows with y, green with
    the squared distance from the middle of the bounding box."""
    df = df.withColumn("_b", _box(df, x, y))
    cx, cy = (F.col("_b.x0") + F.col("_b.x1")) * 0.5, (F.col("_b.y0") + F.col("_b.y1")) * 0.5
    df = df.withColumn("_s", (F.col(x) - cx) ** 2 + (F.col(y) - cy) ** 2)
    df = df.withColumn("_t", scalars(df, low=F.min("_s"), high=F.max("_s")))
    unit = lambda c, lo, hi: F.try_divide(F.col(c) - F.col(lo), F.col(hi) - F.col(lo))
    return df.withColumn("r", 1 - 0.9 * unit(x, "_b.x0", "_b.x1")).withColumn("g", 0.8 * unit("_s", "_t.low", "_t.high")) \
        .withColumn("b", 0.9 * unit(y, "_b.y0", "_b.y1")).drop("_b", "_s", "_t")


def probability_map(df: DataFrame, row: str = "row", col: str = "col", height: int = 64, width: int = 64,
                    sigma: float = 1.0, normalize: bool = True) -> DataFrame:
    """Gaussian grid around each point: (``id``, ``r``, ``c``, ``p``).  The sum that normalises it is
    the product of two one-dimensional sums, so it is found in the row and needs no shuffle."""
    bell = lambda at: (lambda i: F.exp(-((i - at) ** 2) / (2.0 * sigma * sigma)))
    df = df.withColumn("_h", F.transform(F.sequence(F.lit(0), F.lit(height - 1)), bell(F.col(row)))) \
        .withColumn("_w", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), bell(F.col(col))))
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    scale = F.when(add("_h") * add("_w") > 0, 1.0 / (add("_h") * add("_w"))).otherwise(1.0) if normalize else F.lit(1.0)
    df = df.withColumn("_scale", scale).select("id", "_w", "_scale", F.posexplode("_h").alias("r", "_ph"))
    return df.select("id", "r", "_scale", "_ph", F.posexplode("_w").alias("c", "_pw")) \
        .select("id", "r", "c", (F.col("_ph") * F.col("_pw") * F.col("_scale")).alias("p"))
