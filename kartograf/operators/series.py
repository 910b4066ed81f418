"""Gap-aware smoothing, interpolation and filtering of antenna series.

Input is *antenna-long*: one row per (snapshot, antenna) with ``id``, ``ts``, ``antenna``,
``valid`` and the tap arrays ``re``/``im`` (or the scalar ``toa``).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType

from kartograf.functions.arrays import replace_missing
from kartograf.operators import blocks
from kartograf.operators.ordering import ROWS_PER_CHUNK, framed, with_position, with_segments


def kernel_weights(size: int, mode: str) -> list[float]:
    """Weights over the footprint, oldest row first."""
    if mode == "mean":
        return [1.0 / size] * size
    if mode == "exponential":
        # the convolution flips the kernel, so the oldest row in the footprint weighs most
        alpha = 2.0 / (size + 1)
        raw = [alpha * (1 - alpha) ** n for n in range(size)]
        return [v / sum(raw) for v in raw]
    raise ValueError(f"no such kernel: {mode}")


def footprint(size: int) -> tuple[int, int]:
    """Rows before and after the centre that a convolution of ``size`` covers."""
    return (size - 1) // 2, size // 2


def _polar(df: DataFrame, taps: int, values=("re", "im")) -> DataFrame:
    re, im = values
    df = df.withColumn(re, F.transform(re, lambda v: replace_missing(v)))
    df = df.withColumn(im, F.transform(im, lambda v: replace_missing(v)))
    df = df.withColumn("_mag", F.zip_with(re, im, lambda a, b: F.hypot(a, b)))
    # cos and sin of the phase; a zero tap has phase zero
    df = df.withColumn("_cos", F.zip_with(re, "_mag", lambda a, m: F.when(m == 0, 1.0).otherwise(a / m)))
    return df.withColumn("_sin", F.zip_with(im, "_mag", lambda b, m: F.when(m == 0, 0.0).otherwise(b / m)))


def _means(columns: list[str], taps: int, total, ratio: float | None):
    """Window means of tap arrays; NULL where the window holds no valid row.

    ``total`` sums a matrix over the windows.  Plain means skip missing taps; weighted ones (``ratio``)
    divide by the weights of the valid rows, and a missing tap leaves its mean missing.
    """

    def work(table: pa.Table, windows: blocks.Windows, valid: np.ndarray) -> list[pa.Array]:
        out, none = [], _empty(windows, valid, total)
        for c in columns:
            x = blocks.matrix(table.column(c), taps)
            ok = valid[:, None] & ~np.isnan(x)
            summed = total(windows, np.where(ok, x, 0.0))
            with np.errstate(all="ignore"):
                if ratio is None:
                    count = np.rint(total(windows, ok.astype(np.float64)))
                    mean = np.where(count > 0, summed / count, np.nan)
                else:
                    gone = (valid[:, None] & np.isnan(x)).astype(np.float64)
                    mean = summed / total(windows, valid[:, None].astype(np.float64))
                    if gone.any():
                        mean = np.where(total(windows, gone) > 0, np.nan, mean)
            out.append(blocks.lists(mean, none))
        return out

    return work


def _empty(windows: blocks.Windows, valid: np.ndarray, total) -> np.ndarray:
    return total(windows, valid[:, None].astype(np.float64))[:, 0] <= 0


def _back_to_cartesian(df: DataFrame) -> DataFrame:
    phase = F.zip_with("_sin_p", "_cos_p", lambda s, c: F.atan2(s, c))
    df = df.withColumn("_phase", phase)
    df = df.withColumn("re", F.zip_with("_mag_m", "_phase", lambda m, p: m * F.cos(p)))
    return df.withColumn("im", F.zip_with("_mag_m", "_phase", lambda m, p: m * F.sin(p)))


def kernel_moving_average(df: DataFrame, taps: int, kernel_size_mag: int, kernel_size_phase: int | None = None,
                          mode: str = "mean", min_valid_samples: int = 1, max_time_diff: float | None = 1,
                          honor_mask: bool = True, rows_per_chunk: int = ROWS_PER_CHUNK,
                          rows_per_block: int | None = None) -> DataFrame:
    """Smooth magnitude and phase separately over a fixed number of rows inside gap-free segments.

    Even kernels reach one row further ahead than back.  Output is valid where both windows hold
    at least ``min_valid_samples`` valid rows.  ``honor_mask=False`` takes every row as valid.
    A single-channel signal (no ``im`` column) is smoothed as a magnitude.
    """
    kernel_size_phase = kernel_size_phase or kernel_size_mag
    columns = [c for c in df.columns if c not in ("re", "im", "valid")]
    single = "im" not in df.columns
    df = df.withColumn("valid", F.col("valid") if honor_mask else F.lit(True))
    df = with_segments(df, "id", "ts", max_time_diff, ["antenna"], rows_per_chunk)
    keys = ["antenna", "seg"]
    if single:
        df = df.withColumn("_mag", F.transform("re", lambda v: replace_missing(v)))
    else:
        df = _polar(df, taps)
    bm, am = footprint(kernel_size_mag)
    bp, ap = footprint(kernel_size_phase)
    if mode not in ("mean", "exponential"):
        raise ValueError(f"no such kernel: {mode}")
    laid, _, home = framed(df, keys, max(bm, bp), max(am, ap), "seg_start", rows_per_block=rows_per_block)
    parts = []
    for names, size, before, after in ((["_mag"], kernel_size_mag, bm, am), (["_cos", "_sin"], kernel_size_phase, bp, ap))[: 1 if single else 2]:
        ratio = None if mode == "mean" else 1.0 - 2.0 / (size + 1)
        parts.append((_means(names, taps, lambda w, x, b=before, a=after, q=ratio: w.total(x, b, a, 1.0 if q is None else q), ratio), before, after))
    reach = max(bm, bp) + max(am, ap)

    def work(table: pa.Table, block: np.ndarray) -> list[pa.Array]:
        windows = blocks.Windows(block, reach)
        valid = pc.fill_null(table.column("valid").combine_chunks(), False).to_numpy(zero_copy_only=False)
        counts = [pa.array(np.rint(windows.total(valid[:, None].astype(np.float64), b, a)[:, 0]).astype(np.int64)) for _, b, a in parts]
        return counts + [column for means, _, _ in parts for column in means(table, windows, valid)]

    doubles = ArrayType(DoubleType())
    new = [("_n_m", LongType()), ("_n_p", LongType())][: len(parts)] + [("_mag_m", doubles), ("_cos_p", doubles), ("_sin_p", doubles)][: 1 if single else 3]
    out = blocks.over_blocks(laid, [*keys, "_block"], "pos", home, work, new)
    out = out.withColumn("re", F.col("_mag_m")) if single else _back_to_cartesian(out)
    enough = F.least("_n_m", "_n_p") if not single else F.col("_n_m")
    out = out.withColumn("valid", enough >= min_valid_samples)
    return out.select(*columns, "seg", "pos", "valid", "re", *([] if single else ["im"]))


def temporal_moving_average(df: DataFrame, taps: int, window_seconds: float = 0.1,
                            window_seconds_phase: float | None = 0.03, mode: str = "normal",
                            alpha: float | None = None, alpha_phase: float | None = None,
                            sampling_frequency: float = 100.0, drift_margin: float = 1.15,
                            honor_mask: bool = True, rows_per_chunk: int = ROWS_PER_CHUNK,
                            rows_per_block: int | None = None) -> DataFrame:
    """Centred moving average over the row count that a window in seconds stands for.

    A row whose own antenna is invalid stays missing; gaps in time do not split the series.
    """
    if window_seconds_phase is None:
        window_seconds_phase = window_seconds
    alpha_phase = alpha_phase if alpha_phase is not None else alpha
    columns = [c for c in df.columns if c not in ("re", "im", "valid")]
    df = df.withColumn("valid", F.col("valid") if honor_mask else F.lit(True))
    df = with_position(df, "id", ["antenna"], "pos", rows_per_chunk).withColumn("_zero", F.lit(0))
    df = _polar(df, taps)

    def half(seconds):
        return math.ceil(seconds * sampling_frequency * drift_margin) // 2

    def decay(a, seconds):
        a = a if a is not None else 2.0 / (seconds + 1.0)
        return math.exp(-a / sampling_frequency)

    hm, hp = half(window_seconds), half(window_seconds_phase)
    exponential = mode == "exponential"
    laid, _, home = framed(df, ["antenna"], max(hm, hp), max(hm, hp), "_zero", rows_per_block=rows_per_block)
    parts = []
    for names, half_, ratio in ((["_mag"], hm, decay(alpha, window_seconds)), (["_cos", "_sin"], hp, decay(alpha_phase, window_seconds_phase))):
        if exponential:
            parts.append(_means(names, taps, lambda w, x, h=half_, q=ratio: w.centred(x, h, q), ratio))
        else:
            parts.append(_means(names, taps, lambda w, x, h=half_: w.total(x, h, h), None))

    def work(table: pa.Table, block: np.ndarray) -> list[pa.Array]:
        windows = blocks.Windows(block, 2 * max(hm, hp))
        valid = pc.fill_null(table.column("valid").combine_chunks(), False).to_numpy(zero_copy_only=False)
        return [column for means in parts for column in means(table, windows, valid)]

    new = [(c, ArrayType(DoubleType())) for c in ("_mag_m", "_cos_p", "_sin_p")]
    out = _back_to_cartesian(blocks.over_blocks(laid, ["antenna", "_block"], "pos", home, work, new))
    for c in ("re", "im"):
        out = out.withColumn(c, F.when(F.col("valid"), F.col(c)))
    return out.select(*columns, "pos", "valid", "re", "im")


def interpolate(df: DataFrame, value: str, keys, rows_per_block: int = ROWS_PER_CHUNK) -> DataFrame:
    """Fill missing values linearly by row position inside each series.

    Edges hold the nearest value; a series without any value stays missing.  ``df`` carries a
    dense ``pos`` per series.
    """
    keys = list(keys)
    df = df.withColumn("_block", F.floor(F.col("pos") / rows_per_block))
    group = [*keys, "_block"]
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("pos").alias("p"), F.col(value).alias("v")))
    df = df.withColumn("_known", known)
    parts = df.groupBy(*group).agg(F.max("_known").alias("_tail"), F.min("_known").alias("_head"))
    over = W.partitionBy(*keys).orderBy("_block")
    carried = parts.select(
        *group,
        F.last("_tail", True).over(over.rowsBetween(W.unboundedPreceding, -1)).alias("_from"),
        F.first("_head", True).over(over.rowsBetween(1, W.unboundedFollowing)).alias("_to"),
    )
    w = W.partitionBy(*group).orderBy("pos")
    df = (
        df.withColumn("_prev", F.last("_known", True).over(w.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("_next", F.first("_known", True).over(w.rowsBetween(0, W.unboundedFollowing)))
        .join(carried, group)
    )
    a, b = F.coalesce("_prev", "_from"), F.coalesce("_next", "_to")
    inside = a["v"] + (b["v"] - a["v"]) * F.try_divide((F.col("pos") - a["p"]).cast("double"),
                                                       (b["p"] - a["p"]).cast("double"))
    filled = F.coalesce(F.col(value), F.when(a.isNull(), b["v"]).when(b.isNull(), a["v"]).otherwise(inside))
    return df.withColumn(value, filled).drop("_block", "_known", "_prev", "_next", "_from", "_to")


def mirror_pad(df: DataFrame, before: int, after: int) -> DataFrame:
    """Extend each segment by its mirror image (edge value repeated), adding ``padded``.

    ``padded`` counts from the segment's start; the rows of the segment itself are 0..n-1.  The
    image repeats with period 2n, so short segments may be mirrored several times.
    """
    r, n = F.col("pos") - F.col("seg_start"), F.col("seg_len")

    def images(base):
        lowest = F.ceil((-before - base) / (2 * n)).cast("bigint")
        highest = F.floor((n - 1 + after - base) / (2 * n)).cast("bigint")
        return F.when(lowest <= highest, F.transform(F.sequence(lowest, highest), lambda m: base + m * 2 * n)) \
            .otherwise(F.array().cast("array<bigint>"))

    return df.withColumn("padded", F.explode(F.concat(images(r), images(-1 - r))))


def tdoa_filter(df: DataFrame, kernel_size: int, max_time_diff: float | None = None, filter_type: str = "mean",
                keys=("antenna",), value: str = "toa", rows_per_chunk: int = ROWS_PER_CHUNK,
                rows_per_block: int = 100_000) -> DataFrame:
    """Interpolate, then box-mean or median filter each segment with mirrored edges.

    The even mean window reaches one row further ahead, the even median window one row further
    back, and the median is the upper one.
    """
    if filter_type not in ("mean", "median"):
        raise ValueError(f"no such filter: {filter_type}")
    columns = df.columns
    keys = [*keys, "seg"]
    df = with_segments(df, "id", "ts", max_time_diff, keys[:-1], rows_per_chunk)
    df = interpolate(df, value, keys)
    if filter_type == "mean":
        before, after = footprint(kernel_size)
    else:
        before, after = kernel_size // 2, (kernel_size - 1) // 2
    padded = mirror_pad(df, before, after)
    padded = padded.withColumn("_lowest", F.lit(-before))
    laid, _, home = framed(padded, keys, before, after, "_lowest", "padded", rows_per_block)

    def work(table: pa.Table, block: np.ndarray) -> list[pa.Array]:
        x = pc.cast(table.column(value).combine_chunks(), pa.float64()).to_numpy(zero_copy_only=False)
        if filter_type == "median":
            out = blocks.medians(x, block, before, after, kernel_size // 2)
        else:
            known, windows = ~np.isnan(x[:, None]), blocks.Windows(block, before + after)
            count = np.rint(windows.total(known.astype(np.float64), before, after)[:, 0])
            with np.errstate(all="ignore"):
                out = np.where(count > 0, windows.total(np.where(known, x[:, None], 0.0), before, after)[:, 0] / count, np.nan)
        return [pa.array(out, mask=np.isnan(out))]

    own = home & (F.col("padded") == F.col("pos") - F.col("seg_start"))
    kept = blocks.over_blocks(laid, [*keys, "_block"], "padded", own, work, [("_filtered", DoubleType())])
    return kept.withColumn(value, F.col("_filtered")).select(*columns, "seg", "pos")


def cumulative_displacement(df: DataFrame, velocity: float, order: str = "id", ts: str = "ts",
                            rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Distance travelled since the first row at constant speed: a prefix sum of speed x time step."""
    df = with_position(df, order, (), "pos", rows_per_chunk)
    df = df.withColumn("_block", F.floor(F.col("pos") / rows_per_chunk))
    w = W.partitionBy("_block").orderBy("pos")
    df = df.withColumn("_step", F.coalesce(F.col(ts) - F.lag(ts).over(w), F.lit(0.0)) * velocity)
    df = df.withColumn("_run", F.sum("_step").over(w.rowsBetween(W.unboundedPreceding, 0)))
    parts = df.groupBy("_block").agg(F.sum("_step").alias("_sum"), F.min_by(ts, "pos").alias("_first"),
                                     F.max_by(ts, "pos").alias("_last"))
    over = W.partitionBy(F.lit(0)).orderBy("_block")
    enter = F.coalesce((F.col("_first") - F.lag("_last").over(over)) * velocity, F.lit(0.0))
    carried = parts.withColumn("_enter", enter).select(
        "_block",
        (F.col("_enter") + F.coalesce(F.sum(F.col("_sum") + F.col("_enter")).over(
            over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))).alias("_before"),
    )
    return df.join(carried, "_block").withColumn("displacement", F.col("_run") + F.col("_before")) \
        .drop("_block", "_step", "_run", "_before")


def accelerations(df: DataFrame, reduction: int = 10, offset: int = 0, order: str = "id", ts: str = "ts",
                  x: str = "x", y: str = "y", rows_per_chunk: int = ROWS_PER_CHUNK,
                  rows_per_block: int = 100_000) -> DataFrame:
    """Squared acceleration at every ``reduction``-th position of a trajectory.

    Velocity is a difference quotient (time step at least 1e-8); the change of velocity is divided
    by the earlier time step.  Rows where either step is not above 1e-8 are left out.
    """
    df = with_position(df, order, (), "_row", rows_per_chunk)
    df = df.filter((F.col("_row") >= offset) & ((F.col("_row") - offset) % reduction == 0))
    df = df.withColumn("pos", F.floor((F.col("_row") - offset) / reduction)).withColumn("_zero", F.lit(0))
    laid, _, home = framed(df, [], 1, 1, "_zero", rows_per_block=rows_per_block)
    w = W.partitionBy("_block").orderBy("pos")
    dt1, dt2 = F.col(ts) - F.lag(ts).over(w), F.lead(ts).over(w) - F.col(ts)
    laid = laid.withColumn("_dt1", dt1).withColumn("_dt2", dt2)
    for c in (x, y):
        v1 = (F.col(c) - F.lag(c).over(w)) / F.greatest(dt1, F.lit(1e-8))
        v2 = (F.lead(c).over(w) - F.col(c)) / F.greatest(dt2, F.lit(1e-8))
        laid = laid.withColumn(f"_a_{c}", (v2 - v1) / F.greatest(dt1, F.lit(1e-8)))
    out = laid.filter(home & (F.col("_dt1") > 1e-8) & (F.col("_dt2") > 1e-8))
    return out.select(F.col(order), (F.col(f"_a_{x}") ** 2 + F.col(f"_a_{y}") ** 2).alias("acceleration_sq"))
