"""Work over pairs of rows: distances, folds over all pairs, exact nearest neighbours.

Rows are (``id`` BIGINT, ``f`` ARRAY<DOUBLE>): the flattened (antenna, tap) features, NaN where an
antenna is missing.  All-pairs work is laid out as a grid: rows are hashed into B blocks, each row is
sent to the B cells of its block's row and column, and every cell is one bounded task that compares
two blocks with NumPy.  Folds return only their totals, so no list of pairs is ever shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import isqrt
from typing import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kartograf.operators.shells import lay_shells
from kartograf.session import cut

MISSING_DISTANCE = 1e10
ROWS_PER_BLOCK = 8192
TILE = 1024
CACHE = (32, 1024)  # rows and columns that are compared at once: 256 kB of distances
COLUMNS = 8192  # that are compared with a tile of rows at once
WIDE = 8  # times the rows of a block where all blocks meet
CELLS_A_CORE = 4
LINES = 64  # sources whose ranks are counted at once
ASKS = 32  # thresholds of a source that are compared one by one
BROADCAST_CHUNKS = 1_000_000


@dataclass(frozen=True)
class Dissimilarity:
    """A metric per antenna and the rule that joins the antennas."""

    metric: str = "cityblock"
    antennas: int = 1
    aggregation: str = "sum"
    params: dict = field(default_factory=dict)

    @property
    def obeys_triangle(self) -> bool:
        """Whether ``bent`` distances of rows that ``fit`` obey the triangle inequality."""
        if self.aggregation == "median" and self.antennas > 1 or self.metric == "minkowski" and self.params.get("p", 2.0) < 1:
            return False
        return self.metric in _STRAIGHT or self.metric in _SQUARED

    def bent(self, d):
        """Distances in the space where the triangle inequality holds: cosine and correlation are half the squared distance of
        unit vectors, so their root is searched as euclidean."""
        return np.sqrt(np.maximum(d, 0)) if self.metric in _SQUARED else d

    @property
    def blur(self) -> float:
        """What rounding can add to a bent distance."""
        return 1e-6 if self.metric in _SQUARED else 1e-8

    def fit(self, x: np.ndarray) -> np.ndarray:
        """Rows whose distances are defined on every antenna."""
        x = x.reshape(len(x), self.antennas, -1)
        good = np.isfinite(x).all(axis=(1, 2))
        with np.errstate(all="ignore"):
            if self.metric == "cosine":
                good &= (np.linalg.norm(x, axis=2) > 0).all(axis=1)
            if self.metric == "correlation":
                good &= (np.linalg.norm(x - x.mean(axis=2, keepdims=True), axis=2) > 1e-9 * np.linalg.norm(x, axis=2)).all(axis=1)
            if self.metric == "jensenshannon":
                good &= (x >= 0).all(axis=(1, 2)) & (x.sum(axis=2) > 0).all(axis=1)
        return good

    def between(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Distance matrix of feature rows x (n, A*T) and y (m, A*T); NaN where undefined."""
        x = x.reshape(len(x), self.antennas, -1)
        y = y.reshape(len(y), self.antennas, -1)
        with np.errstate(all="ignore"):
            if self.aggregation in ("sum", "mean") and np.isfinite(x).all() and np.isfinite(y).all():
                out = _METRICS[self.metric](x[:, 0], y[:, 0], **self.params)
                for a in range(1, self.antennas):
                    out += _METRICS[self.metric](x[:, a], y[:, a], **self.params)
                if not np.isnan(out).any():  # no antenna to leave out
                    return out / self.antennas if self.aggregation == "mean" else out
            per = np.stack([_METRICS[self.metric](x[:, a], y[:, a], **self.params) for a in range(self.antennas)])
            if self.antennas == 1 and self.aggregation != "sum":
                return per[0]
            if self.aggregation == "sum":
                return np.nansum(per, axis=0)
            if self.aggregation == "mean":
                known = (~np.isnan(per)).sum(axis=0)
                return np.nansum(per, axis=0) / known
            if self.aggregation == "max":
                return np.fmax.reduce(per, axis=0)
            if self.aggregation == "median":
                ordered = np.sort(per, axis=0)  # NaN last
                known = (~np.isnan(per)).sum(axis=0)
                low = np.take_along_axis(ordered, np.maximum((known - 1) // 2, 0)[None], 0)[0]
                high = np.take_along_axis(ordered, np.minimum(known // 2, self.antennas - 1)[None], 0)[0]
                return np.where(known > 0, (low + high) / 2, np.nan)
        raise ValueError(f"unknown aggregation {self.aggregation!r}")

    def along(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """City-block, cosine and correlation distances of rows x that fit to the rows y beside them, summed or averaged."""
        x, y = x.reshape(len(x), self.antennas, -1), y.reshape(len(y), self.antennas, -1)
        if self.metric == "correlation":
            x, y = x - x.mean(axis=2, keepdims=True), y - y.mean(axis=2, keepdims=True)
        out = None
        for a in range(self.antennas):
            if self.metric == "cityblock":  # tap by tap, to the last bit what ``between`` gives
                own = np.zeros(len(x))
                for t in range(x.shape[2]):
                    own += np.abs(x[:, a, t] - y[:, a, t])
            else:
                own = 1.0 - np.einsum("rt,rt->r", x[:, a], y[:, a]) / (np.linalg.norm(x[:, a], axis=1) * np.linalg.norm(y[:, a], axis=1))
            out = own if out is None else out + own
        return out / self.antennas if self.aggregation == "mean" else out


def _rounded(d: np.ndarray, decimals: int) -> np.ndarray:
    return np.round(np.nan_to_num(d, nan=MISSING_DISTANCE), decimals)


def _by_tap(term):
    """Sum a per-tap term without building an (n, m, taps) array, in squares that stay in the cache."""

    def run(x, y, **params):
        out = np.zeros((len(x), len(y)))
        columns = np.ascontiguousarray(y.T)
        for a in range(0, len(x), CACHE[0]):
            for b in range(0, len(y), CACHE[1]):
                part, left, right = out[a:a + CACHE[0], b:b + CACHE[1]], x[a:a + CACHE[0]], columns[:, b:b + CACHE[1]]
                for t in range(x.shape[1]):
                    part += term(left[:, t, None], right[t][None], **params)
        return out

    return run


def _cityblock(x, y):
    out = np.zeros((len(x), len(y)))
    columns = np.ascontiguousarray(y.T)
    room = np.empty((min(CACHE[0], len(x)), min(CACHE[1], len(y))))
    for a in range(0, len(x), CACHE[0]):
        for b in range(0, len(y), CACHE[1]):
            part, left, right = out[a:a + CACHE[0], b:b + CACHE[1]], x[a:a + CACHE[0]], columns[:, b:b + CACHE[1]]
            gap = room[:part.shape[0], :part.shape[1]]
            for t in range(x.shape[1]):
                np.subtract(left[:, t, None], right[t][None], out=gap)
                np.abs(gap, out=gap)
                part += gap
    return out


def _sqeuclidean(x, y):
    out = np.zeros((len(x), len(y)))
    columns = np.ascontiguousarray(y.T)
    room = np.empty((min(CACHE[0], len(x)), min(CACHE[1], len(y))))
    for a in range(0, len(x), CACHE[0]):
        for b in range(0, len(y), CACHE[1]):
            part, left, right = out[a:a + CACHE[0], b:b + CACHE[1]], x[a:a + CACHE[0]], columns[:, b:b + CACHE[1]]
            gap = room[:part.shape[0], :part.shape[1]]
            for t in range(x.shape[1]):
                to = gap if t else part
                np.subtract(left[:, t, None], right[t][None], out=to)
                np.multiply(to, to, out=to)
                if t:
                    part += gap
    return out


def _euclidean(x, y):
    out = _sqeuclidean(x, y)
    return np.sqrt(out, out=out)


def _chebyshev(x, y):
    out = np.zeros((len(x), len(y)))
    for t in range(x.shape[1]):
        out = np.maximum(out, np.abs(x[:, t, None] - y[None, :, t]))
    return out


def _cosine(x, y):
    return 1.0 - (x @ y.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None])


def _jensenshannon(x, y):
    p, q = x / x.sum(axis=1, keepdims=True), y / y.sum(axis=1, keepdims=True)

    def term(a, b):
        m = (a + b) / 2
        return np.where(a == 0, 0.0, a * np.log(a / m)) + np.where(b == 0, 0.0, b * np.log(b / m))

    return np.sqrt(np.maximum(_by_tap(term)(p, q) / 2, 0))


_METRICS: dict[str, Callable] = {
    "cityblock": _cityblock,
    "sqeuclidean": _sqeuclidean,
    "euclidean": _euclidean,
    "chebyshev": _chebyshev,
    "minkowski": lambda x, y, p=2.0: _by_tap(lambda a, b: np.abs(a - b) ** p)(x, y) ** (1 / p),
    "cosine": _cosine,
    "correlation": lambda x, y: _cosine(x - x.mean(axis=1, keepdims=True), y - y.mean(axis=1, keepdims=True)),
    "canberra": _by_tap(lambda a, b: np.where((a == 0) & (b == 0), 0.0, np.abs(a - b) / (np.abs(a) + np.abs(b)))),
    "braycurtis": lambda x, y: _METRICS["cityblock"](x, y) / _by_tap(lambda a, b: np.abs(a + b))(x, y),
    "hamming": lambda x, y: _by_tap(lambda a, b: np.where(np.isnan(a + b), np.nan, a != b))(x, y) / x.shape[1],
    "jensenshannon": _jensenshannon,
}
_STRAIGHT = {"cityblock", "euclidean", "chebyshev", "minkowski", "canberra", "hamming", "jensenshannon"}
_SQUARED = {"sqeuclidean", "cosine", "correlation"}
_BY_PATTERN = {"cityblock", "euclidean", "sqeuclidean", "chebyshev"}  # undefined or infinite only by features that are so, or huge
HUGE = 1e100


def features(df: DataFrame, column: str = "vec", id: str = "id", antennas: int | None = None,
             taps: int | None = None) -> DataFrame:
    """Flatten ARRAY<ARRAY<DOUBLE>> (antenna, tap) to ``f``; a NULL antenna becomes NaN taps."""
    if antennas is None:
        return df.select(F.col(id).cast("bigint").alias("id"), F.col(column).cast("array<double>").alias("f"))
    blank = F.array_repeat(F.lit(float("nan")), taps)
    filled = F.flatten(F.transform(column, lambda a: F.coalesce(a, blank)))
    return df.select(F.col(id).cast("bigint").alias("id"), F.transform(
        filled, lambda v: F.coalesce(v, F.lit(float("nan")))).alias("f"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 1))


def _tasks(df: DataFrame, cells: int) -> int:
    """Enough partitions for the cells; given as a number, so that AQE does not merge small inputs
    of long-running tasks."""
    spark = df.sparkSession
    ready = max(spark.sparkContext.defaultParallelism * 2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(1, min(cells, ready))


def fold_pairs(df: DataFrame, fold: Callable, schema: str, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Run ``fold(left, right, same)`` once for every pair of blocks and union what it returns.

    ``left``/``right`` are pandas frames of rows; ``same`` says that both are the same block, where
    only pairs above the diagonal count.  Each unordered pair of rows is met exactly once.  A row is
    copied B = n / rows_per_block times, the least that lets all pairs meet in bounded tasks.
    """
    n = df.count()
    blocks = max(-(-n // rows_per_block), min(4, -(-n // 128)), 1)
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    laid = df.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    laid = laid.withColumn("_cell", F.least("_own", "_other") * blocks + F.greatest("_own", "_other")).drop("_other")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        low, high = divmod(int(key[0]), blocks)
        rows = rows.sort_values("id", kind="stable")
        left = rows[rows["_own"] == low]
        return fold(left, left if low == high else rows[rows["_own"] == high], low == high)

    cells = blocks * (blocks + 1) // 2
    return laid.repartition(_tasks(df, cells), "_cell").groupBy("_cell").applyInPandas(run, schema)


def tiles(left: pd.DataFrame, right: pd.DataFrame, same: bool, tile: int = TILE):
    """Sub-blocks of a cell with the mask of pairs that count."""
    for a in range(0, len(left), tile):
        for b in range(a if same else 0, len(right), tile):
            x, y = left.iloc[a:a + tile], right.iloc[b:b + tile]
            keep = np.triu(np.ones((len(x), len(y)), bool), 1) if same and a == b else np.ones((len(x), len(y)), bool)
            yield x, y, keep


def squares(left: pd.DataFrame, right: pd.DataFrame, same: bool, columns: tuple[str, ...], tile: int = 512):
    """Sub-blocks of a cell as matrices of the columns, and whether only pairs above the diagonal count."""
    x = [_matrix(left[c]) for c in columns]
    y = x if same else [_matrix(right[c]) for c in columns]
    for a in range(0, len(left), tile):
        for b in range(a if same else 0, len(right), tile):
            yield [m[a:a + tile] for m in x], [m[b:b + tile] for m in y], same and a == b


def flat(d: np.ndarray, above: bool) -> np.ndarray:
    """Distances of the pairs that count."""
    return d[np.triu_indices(len(d), 1)] if above else d.ravel()


def condensed_distances(df: DataFrame, metric: Dissimilarity, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """All unordered pairs (``i`` < ``j``, ``d``): the distance file that training jobs read.

    The result itself has n(n-1)/2 rows; use it only to write that file.  Folds, nearest neighbours
    and drawn pairs do not need it.
    """

    def emit(left, right, same):
        out = []
        for x, y, keep in tiles(left, right, same):
            d = metric.between(_matrix(x["f"]), _matrix(y["f"]))
            r, c = np.nonzero(keep)
            i, j = x["id"].to_numpy()[r], y["id"].to_numpy()[c]
            out.append(pd.DataFrame({"i": np.minimum(i, j), "j": np.maximum(i, j), "d": d[r, c]}))
        return pd.concat(out) if out else pd.DataFrame({"i": [], "j": [], "d": []})

    pairs = fold_pairs(df, emit, "i bigint, j bigint, d double", rows_per_block)
    return pairs.withColumn("d", F.nanvl("d", F.lit(None).cast("double")))


def distance_audit(df: DataFrame, metric: Dissimilarity, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """How many of all pair distances are undefined or infinite: one row (pairs, nans, infs).

    Where finite features of ordinary size can give only finite distances (city-block, euclidean, squared and Chebyshev),
    rows count by which of their features are missing, infinite or huge: such patterns meet instead of rows, each pair
    of them with the number of its pairs of rows.
    """
    if type(metric) is Dissimilarity and metric.metric in _BY_PATTERN:
        def plain(v):
            return F.when(v.isNull() | F.isnan(v), float("nan")).when(F.abs(v) > HUGE, v).otherwise(0.0)

        rows = df.groupBy(F.transform("f", plain).alias("f")).agg(F.count(F.lit(1)).alias("n"))
        rows = rows.select(F.xxhash64("f").alias("id"), "f", "n")
    else:
        rows = df.select("id", "f", F.lit(1).cast("bigint").alias("n"))

    def count(left, right, same):
        pairs = nans = infs = 0
        for (f, n), (g, m), above in squares(left, right, same, ("f", "n")):
            n, m = n.astype(np.int64), m.astype(np.int64)
            many = np.multiply.outer(n, m)
            if above:
                many = np.triu(many, 1)
                np.fill_diagonal(many, n * (n - 1) // 2)
            d = metric.between(f, g)
            pairs, nans, infs = pairs + int(many.sum()), nans + int(many[np.isnan(d)].sum()), infs + int(many[np.isinf(d)].sum())
        return pd.DataFrame({"pairs": [pairs], "nans": [nans], "infs": [infs]})

    counted = fold_pairs(rows, count, "pairs bigint, nans bigint, infs bigint", rows_per_block)
    return counted.agg(*[F.sum(c).alias(c) for c in ("pairs", "nans", "infs")])


class _Screen:
    """City-block distances of finite rows in whole numbers of 16 bits, each off by no more than ``slack``.

    Features become levels, few enough that the sum of all of them fits; |a - b| is 2 max(a, b) - a - b.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray):
        low, high, width = min(x.min(), y.min()), max(x.max(), y.max()), x.shape[1]
        self.levels = 65535 // width
        self.step = (high - low) / self.levels
        # what rounding to decimals can add is less than a level
        self.works = bool(np.isfinite(self.step) and self.step > 1e-7 and abs(low) + abs(high) < 1e6 * (high - low) and self.levels > 15)
        self.slack = width + 2
        if self.works:
            level = lambda z: np.rint((z - low) / self.step).astype(np.uint16)
            self.x, self.y = level(x), np.ascontiguousarray(level(y).T)
            self.sx, self.sy = self.x.sum(axis=1, dtype=np.int32), self.y.sum(axis=0, dtype=np.int32)

    def between(self, a: int, b: int, c: int, d: int) -> np.ndarray:
        """Levels between rows a to b of x and c to d of y."""
        x, out = self.x[a:b], np.zeros((b - a, d - c), np.uint16)
        room = np.empty_like(out)
        for t in range(x.shape[1]):
            np.maximum(x[:, t, None], self.y[t, c:d][None], out=room)
            out += room
        far = out.astype(np.int32)
        far *= 2
        far -= self.sx[a:b, None]
        far -= self.sy[None, c:d]
        return far

    def candidates(self, a: int, b: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows (from 0) and columns among which the k nearest of rows a to b are, ties included."""
        m, step = self.y.shape[1], 2 * CACHE[1]
        first = np.concatenate([self.between(a, b, c, min(c + step, m)) for c in range(0, min(2 * step, m), step)], axis=1)
        if first.shape[1] <= k:
            return np.repeat(np.arange(b - a), m), np.tile(np.arange(m), b - a)
        reach = np.partition(first, k - 1, axis=1)[:, k - 1] + 2 * self.slack
        found = []
        for c in range(0, m, step):
            far = first[:, c:c + step] if c < first.shape[1] else self.between(a, b, c, min(c + step, m))
            r, at = np.divmod(np.flatnonzero(far <= reach[:, None]), far.shape[1])
            found.append((r, at + c, far[r, at]))
        r, at, far = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((far, r))
        r, at, far = r[order], at[order], far[order]
        begins = np.searchsorted(r, np.arange(b - a))
        near = far <= (far[begins + k - 1] + 2 * self.slack)[r]
        return r[near], at[near]


class _Angles(_Screen):
    """Cosine distances, summed over antennas, of rows that fit as one product of unit vectors, less a constant."""

    def __init__(self, x: np.ndarray, y: np.ndarray, metric: Dissimilarity, decimals: int):
        def unit(z):
            z = z.reshape(len(z), metric.antennas, -1)
            if metric.metric == "correlation":
                z = z - z.mean(axis=2, keepdims=True)
            return (z / np.linalg.norm(z, axis=2, keepdims=True)).reshape(len(z), -1)

        self.x, self.y = unit(x), unit(y).T
        self.works = bool(np.isfinite(self.x).all() and np.isfinite(self.y).all())
        self.slack = metric.antennas * (10.0 ** -decimals + 1e-12)

    def between(self, a: int, b: int, c: int, d: int) -> np.ndarray:
        return -(self.x[a:b] @ self.y[:, c:d])


def _screen(x: np.ndarray, y: np.ndarray, k: int, metric: Dissimilarity, decimals: int) -> _Screen | None:
    """A quick bound on the distances, where one is known and defined for all rows."""
    if type(metric) is not Dissimilarity or metric.aggregation not in ("sum", "mean") or len(y) <= 4 * k:
        return None
    if metric.metric not in ("cityblock", "cosine", "correlation") or not (metric.fit(x).all() and metric.fit(y).all()):
        return None
    found = _Screen(x, y) if metric.metric == "cityblock" else _Angles(x, y, metric, decimals)
    return found if found.works else None


def _nearest_in(x: np.ndarray, y: np.ndarray, k: int, metric: Dissimilarity, decimals: int):
    """Row, column and distance of the k nearest rows of y for each row of x; of equal distances the earliest columns."""
    screen = _screen(x, y, k, metric, decimals)
    tile, room = CACHE[0] * 4, 10.0 ** (1 - decimals)
    for a in range(0, len(x), tile):
        part = x[a:a + tile]
        if screen:
            r, c = screen.candidates(a, a + len(part), k)
            d = metric.along(part[r], y[c])
        else:
            found, reach = [], np.inf
            for b in range(0, len(y), COLUMNS):
                far = np.nan_to_num(metric.between(part, y[b:b + COLUMNS]), nan=MISSING_DISTANCE)
                if far.shape[1] > k and b == 0:
                    reach = np.partition(far, k - 1, axis=1)[:, k - 1:k] + room
                r, c = np.divmod(np.flatnonzero(far <= reach), far.shape[1])
                found.append((r, c + b, far[r, c]))
            r, c, d = (np.concatenate(z) for z in zip(*found))
        d = np.round(d, decimals)
        order = np.lexsort((c, d, r))
        r, c, d = r[order], c[order], d[order]
        near = np.arange(len(r)) - np.searchsorted(r, r) < k
        yield r[near] + a, c[near], d[near]


def _any_unfit(points: DataFrame, metric: Dissimilarity) -> bool:
    def look(batches):
        for rows in batches:
            yield pd.DataFrame({"unfit": [bool((~metric.fit(_matrix(rows["f"]))).any())] if len(rows) else []})

    return bool(points.select("f").mapInPandas(look, "unfit boolean").agg(F.max("unfit")).first()[0])


def nearest_neighbors(df: DataFrame, k: int, metric: Dissimilarity, prune: bool | None = None,
                      rows_per_block: int = ROWS_PER_BLOCK, pivots: int | None = None,
                      decimals: int = 9) -> DataFrame:
    """Exact k nearest neighbours of every row, itself excluded: (``src``, ``dst``, ``d``, ``rank``).

    1. Equal feature rows are joined into one (with their k+1 smallest ids), so a large group of
       copies costs one comparison instead of its square.
    2. Rows go to the nearest of sqrt(n) pivots; crowded pivots are split into shells of distance.
    3. A first pass inside chunks, and the pivots themselves, bound each row's k-th distance.  By the
       triangle inequality a row then visits only chunks that can hold something nearer (the median of
       antennas, Bray-Curtis, and tables with undefined distances visit all).  The bound only skips
       work; results are exact.  Visits are lists of ids; vectors join them last.
    4. Where bounds skip little, as a 64th of the rows shows, all blocks meet instead, a row is sent once to each.
       City-block distances are then screened in 16-bit levels, and what can be among the nearest is compared exactly.
    Equal distances (at ``decimals``) are ordered by id.  Undefined distances count as 1e10.
    """
    spark = df.sparkSession
    df = df.select(F.col("id").cast("bigint").alias("id"), "f").withColumn("_h", F.xxhash64("f"))
    members = W.partitionBy("_h", "f").orderBy("id")
    firsts = df.withColumn("_m", F.row_number().over(members)).filter(F.col("_m") <= k + 1)
    groups = firsts.groupBy("_h", "f").agg(F.min("id").alias("vid"), F.sort_array(F.collect_list("id")).alias("ids"))
    groups = cut(groups)
    copies = df.count()
    n = groups.count()
    points = groups.select("vid", "f")
    maybe = prune is None
    if maybe:
        prune = metric.obeys_triangle and n > 4 * rows_per_block
    prune = prune and n > 0 and not _any_unfit(points, metric)
    # where all blocks meet: enough cells for all cores, blocks of bounded size
    square = max(-(-n // (WIDE * rows_per_block)), min(isqrt(CELLS_A_CORE * spark.sparkContext.defaultParallelism) + 1, -(-n // 128)), 1)

    def kth_inside(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        f = _matrix(rows["f"])
        own = np.flatnonzero(rows["_ask"].to_numpy())
        bound = rows["_reach"].to_numpy()[own]
        if len(rows) > k:
            for a in range(0, len(own), TILE):
                # k+1 counts the row itself at distance zero
                near = _rounded(metric.between(f[own[a:a + TILE]], f), decimals)
                bound[a:a + TILE] = np.fmin(bound[a:a + TILE], np.partition(near, k, axis=1)[:, k])
        return rows[["vid", "f"]].iloc[own].assign(_bound=bound)

    def visited(laid, ask):
        bounded = laid.points.withColumn("_ask", ask).repartition(_tasks(df, laid.chunks), "_chunk").groupBy("_chunk") \
            .applyInPandas(kth_inside, "vid bigint, f array<double>, _bound double")
        return laid.visits(bounded, metric, 10.0 ** -decimals)

    if prune:
        laid = lay_shells(points, metric, k, rows_per_block, pivots)
        if maybe:  # whether bounds skip enough, by the visits of some rows; the answer is the same either way
            some = F.pmod(F.xxhash64("vid", F.lit(1)), F.lit(64)) == 0
            prune = visited(laid, some).count() <= 4 * square * max(points.filter(some).count(), 1)
    if prune:
        chunks, points = laid.chunks, laid.points
        visits = cut(visited(laid, F.lit(True)))
        load = visits.groupBy("_chunk").agg(F.count("*").alias("n"))
        load = load.select("_chunk", F.ceil(F.col("n") / (4 * rows_per_block)).alias("_parts"))
    else:
        chunks = square
        points = points.withColumn("_chunk", F.pmod(F.xxhash64("vid"), F.lit(chunks)))
        every = F.sequence(F.lit(0).cast("bigint"), F.lit(chunks - 1).cast("bigint"))
        visits = points.select(F.explode(every).alias("_chunk"), F.col("vid").alias("query"), F.col("f").alias("q"))
        load = spark.range(chunks).select(F.col("id").alias("_chunk"), F.lit(square).cast("bigint").alias("_parts"))
    if chunks <= BROADCAST_CHUNKS:
        load = F.broadcast(load)  # one row per chunk
    asked = visits.join(load, "_chunk").withColumn("_part", F.pmod(F.xxhash64("query"), F.col("_parts"))).drop("_parts")
    if prune:
        asked = asked.join(groups.select(F.col("vid").alias("query"), F.col("f").alias("q")), "query")
    held = points.select("_chunk", "vid", "f").join(load, "_chunk").withColumn(
        "_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1))).drop("_parts")
    cells = _tasks(df, chunks * 8) if prune else min(2 * square * square, max(_tasks(df, 1 << 20), 2000))

    def compare(key: tuple, queries: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(base):
            base = base.sort_values("vid")
            x, asking = _matrix(queries["q"]), queries["query"].to_numpy()
            y, names = _matrix(base["f"]), base["vid"].to_numpy()
            for r, c, d in _nearest_in(x, y, k + 1, metric, decimals):  # the row itself is among them
                out.append(pd.DataFrame({"vid": asking[r], "other": names[c], "d": d}))
        return pd.concat(out) if out else pd.DataFrame({"vid": [], "other": [], "d": []})

    near = asked.repartition(cells, "_chunk", "_part").groupBy("_chunk", "_part").cogroup(
        held.repartition(cells, "_chunk", "_part").groupBy("_chunk", "_part")
    ).applyInPandas(compare, "vid bigint, other bigint, d double")

    if n == copies:  # no copies: groups are the rows themselves
        ranked = near.filter("vid <> other")
        order = W.partitionBy("vid").orderBy("d", "other")
        return ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k) \
            .select(F.col("vid").alias("src"), F.col("other").alias("dst"), "d", "rank")
    order = W.partitionBy("vid").orderBy("d", "other")
    best = near.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k + 1)
    spread = best.join(groups.select(F.col("vid").alias("other"), "ids"), "other") \
        .select("vid", "d", F.explode("ids").alias("dst"))
    order = W.partitionBy("vid").orderBy("d", "dst")
    spread = spread.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k + 1)
    lists = spread.groupBy("vid").agg(F.sort_array(F.collect_list(F.struct("d", "dst"))).alias("near"))
    lists = cut(lists.join(groups.select("vid", "_h", "f"), "vid").drop("vid"))
    # vectors with more than a thousandth of all rows are at most 1000: their lists are broadcast,
    # so that a large group of copies is not gathered by the join
    often = df.groupBy("_h").agg(F.count("*").alias("n")).filter(F.col("n") > max(copies // 1000, 1000))
    hot = F.col("_h").isin([row["_h"] for row in often.collect()])
    own = df.filter(hot).join(F.broadcast(lists.filter(hot)), ["_h", "f"]).unionByName(
        df.filter(~hot).join(lists.filter(~hot), ["_h", "f"]))
    own = own.select(F.col("id").alias("src"), F.posexplode(
        F.slice(F.filter("near", lambda e: e["dst"] != F.col("id")), 1, k)).alias("rank", "e"))
    return own.select("src", F.col("e.dst").alias("dst"), F.col("e.d").alias("d"), (F.col("rank") + 1).alias("rank"))


def ranks_among_all(df: DataFrame, thresholds: DataFrame, metric: Dissimilarity,
                    rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """For given pairs (``src``, ``dst``), how many rows are nearer to src than dst is.

    Ties (at 9 decimals) are ordered by id and src itself is not counted, so nearest = 0.  A source goes once to
    each block of rows with all it asks (sources that ask much, in pieces of about ``rows_per_block``): its
    distances are taken once and compared with its thresholds, many of them sorted and by search, so the work does not
    grow with their number.  Each cell returns one partial count per pair; counts are then summed.
    """
    n = df.count()
    blocks = max(-(-n // rows_per_block), min(4, -(-n // 128)), 1)
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    base = df.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("_q", every)
    left = df.select(F.col("id").alias("src"), F.col("f").alias("fs"))
    right = df.select(F.col("id").alias("dst"), F.col("f").alias("fd"))

    def measure(batches):
        for p in batches:
            a, b = _matrix(p["fs"]), _matrix(p["fd"])
            # pairs in small squares, of which the diagonal counts
            own = [np.diagonal(metric.between(a[i:i + 16], b[i:i + 16])) for i in range(0, len(p), 16)]
            own = np.concatenate(own) if own else np.zeros(0)
            yield pd.DataFrame({"src": p["src"], "dst": p["dst"], "own": np.round(np.nan_to_num(own, nan=MISSING_DISTANCE), 9)})

    asked = thresholds.select("src", "dst").join(left, "src").join(right, "dst")
    asked = cut(asked.mapInPandas(measure, "src bigint, dst bigint, own double"))
    most = asked.groupBy("src").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    piece = F.pmod(F.xxhash64("dst"), F.lit(max(-(-most // rows_per_block), 1)))
    lists = asked.groupBy("src", piece.alias("_piece")).agg(F.sort_array(F.collect_set(F.struct("own", "dst"))).alias("asks"))
    lists = lists.select("src", "_piece", F.col("asks.own").alias("own"), F.col("asks.dst").alias("dst")).join(left, "src")
    lists = lists.withColumn("_q", F.pmod(F.xxhash64("src", "_piece"), F.lit(blocks)).cast("int")).withColumn("_b", every)

    def count(key: tuple, lines: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(lines) or not len(rows):
            return pd.DataFrame({"src": [], "dst": [], "nearer": []})
        names, y = rows["id"].to_numpy(), _matrix(rows["f"])
        order, counts = np.argsort(names, kind="stable"), []
        for a in range(0, len(lines), LINES):
            part = lines.iloc[a:a + LINES]
            near = metric.between(_matrix(part["fs"]), y)
            if not np.isfinite(near.sum()):
                near = np.nan_to_num(near, nan=MISSING_DISTANCE)
            begins, ends = (np.searchsorted(names, part["src"].to_numpy(), side, sorter=order) for side in ("left", "right"))
            for d, i, j, own, dst in zip(near, begins, ends, part["own"], part["dst"]):
                counts.append(_nearer(d, names, order[i:j], np.asarray(own), np.asarray(dst)))
        sizes = [len(c) for c in counts]
        return pd.DataFrame({"src": np.repeat(lines["src"].to_numpy(), sizes), "dst": np.concatenate(list(lines["dst"])),
                             "nearer": np.concatenate(counts)})

    tasks = _tasks(df, blocks * blocks)
    partial = lists.repartition(tasks, "_b", "_q").groupBy("_b", "_q").cogroup(
        base.repartition(tasks, "_b", "_q").groupBy("_b", "_q")
    ).applyInPandas(count, "src bigint, dst bigint, nearer bigint")
    return partial.groupBy("src", "dst").agg(F.sum("nearer").alias("nearer"))


def _nearer(d: np.ndarray, names: np.ndarray, itself: np.ndarray, own: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """How many of (d at 9 decimals, name) come before each threshold (own, dst), rows ``itself`` left out.

    Few thresholds are compared as they are; only what rounding could move, or what is equal, is rounded and compared by name.
    """
    if len(own) > ASKS or not np.isfinite(own).all():
        return _among(np.round(np.delete(d, itself), 9), np.delete(names, itself), own, dst)
    d[itself] = np.nan  # before and after nothing
    out = np.empty(len(own), np.int64)
    for k, (t, name) in enumerate(zip(own.tolist(), dst.tolist())):
        room = 2e-9 + 1e-15 * t
        out[k] = np.count_nonzero(d < t - room)
        if np.count_nonzero(d <= t + room) > out[k]:
            level = np.flatnonzero((d >= t - room) & (d <= t + room))
            exact = np.round(d[level], 9)
            out[k] += np.count_nonzero((exact < t) | ((exact == t) & (names[level] < name)))
    return out


def _among(d: np.ndarray, names: np.ndarray, own: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """How many of (d, name) come before each threshold (own, dst); thresholds are sorted."""
    at = np.searchsorted(own, d, side="left")
    level = np.flatnonzero((at < len(own)) & (own[np.minimum(at, len(own) - 1)] == d))
    level = level[np.argsort(at[level], kind="stable")]
    starts, begins = np.unique(at[level], return_index=True)
    for s, rows in zip(starts, np.split(level, begins[1:])):  # equal distances: before those thresholds whose id is larger
        end = np.searchsorted(own, own[s], side="right")
        at[rows] += np.searchsorted(dst[s:end], names[rows], side="right")
    return np.cumsum(np.bincount(at, minlength=len(own) + 1))[:len(own)]
