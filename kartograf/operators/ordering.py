"""Row order as data.

Order-sensitive work (gaps, moving windows, interpolation, strides) needs a row position, and a
window over a whole series would put that series into one task.  So every series is cut into
*chunks* of consecutive rows at approximate quantiles of its order column.  Windows run inside
chunks; one small summary row per chunk carries what later chunks must know.  The cuts only
balance the work: results do not depend on where they fall.  No group is ever larger than a
chunk, however many rows a single series holds.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROWS_PER_CHUNK = 500_000


def _cuts(df: DataFrame, order: str, rows_per_chunk: int) -> list[float]:
    """Cut points of the order column: one number per chunk."""
    chunks = -(-df.count() // rows_per_chunk)
    if chunks <= 1:
        return []
    points = [i / chunks for i in range(1, chunks)]
    picked = df.agg(F.percentile_approx(F.col(order).cast("double"), points, 10_000)).first()[0] or []
    return sorted(set(picked))


def _with_chunk(df: DataFrame, order: str, cuts: list[float]) -> DataFrame:
    """Add the number of the chunk of consecutive rows that a row belongs to."""
    bucketizer = Bucketizer(splits=[float("-inf"), *cuts, float("inf")],
                            inputCol="_order", outputCol="_bucket")
    bucketed = bucketizer.transform(df.withColumn("_order", F.col(order).cast("double")))
    return bucketed.withColumn("_chunk", F.col("_bucket").cast("int")).drop("_order", "_bucket")


def with_position(df: DataFrame, order: str, keys=(), position: str = "pos",
                  rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Dense 0-based row position per series in ``order`` (a unique numeric column)."""
    keys = list(keys)
    cuts = _cuts(df, order, rows_per_chunk)
    if not cuts:  # the whole table is no larger than one chunk
        w = W.partitionBy(*(keys or [F.lit(0)])).orderBy(order)
        return df.withColumn(position, F.row_number().over(w).cast("bigint") - 1)
    chunked = _with_chunk(df, order, cuts)
    group = [*keys, "_chunk"]
    sizes = chunked.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*(keys or [F.lit(0)])).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inner = F.row_number().over(W.partitionBy(*group).orderBy(order)).cast("bigint")
    return (
        chunked.withColumn("_rank", inner)
        .join(offsets, group)
        .withColumn(position, F.col("_rank") - 1 + F.col("_offset"))
        .drop("_rank", "_offset", "_chunk")
    )


def with_segments(df: DataFrame, order: str, ts: str, max_gap: float | None, keys=(),
                  rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Split every series where the time step exceeds ``max_gap`` (strictly).

    Adds ``pos`` (dense position in the series), ``seg`` (0-based segment number), ``seg_start``
    (position of the segment's first row) and ``seg_len``.  A backward jump in time is no gap.
    """
    keys = list(keys)
    gap = F.lit(float("inf") if max_gap is None else float(max_gap))
    cuts = _cuts(df, order, rows_per_chunk)
    if not cuts:  # the whole table is no larger than one chunk
        w = W.partitionBy(*(keys or [F.lit(0)])).orderBy(order)
        split = F.coalesce((F.col(ts) - F.lag(ts).over(w) > gap).cast("int"), F.lit(0))
        placed = df.withColumn("pos", F.row_number().over(w).cast("bigint") - 1).withColumn("_break", split)
        placed = placed.withColumn("seg", F.sum("_break").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("bigint"))
        whole = W.partitionBy(*keys, "seg")
        return placed.withColumn("seg_start", F.min("pos").over(whole)) \
            .withColumn("seg_len", F.count(F.lit(1)).over(whole)).drop("_break")
    group = [*keys, "_chunk"]
    chunked = _with_chunk(df, order, cuts)
    w = W.partitionBy(*group).orderBy(order)
    inner = (
        chunked.withColumn("_rank", F.row_number().over(w).cast("bigint"))
        .withColumn("_break", F.coalesce((F.col(ts) - F.lag(ts).over(w) > gap).cast("int"), F.lit(0)))
        .withColumn("_breaks", F.sum("_break").over(w.rowsBetween(W.unboundedPreceding, 0)))
    )
    edges = inner.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_break").alias("_inside"),
        F.min_by(ts, order).alias("_first"), F.max_by(ts, order).alias("_last"),
    )
    over_chunks = W.partitionBy(*(keys or [F.lit(0)])).orderBy("_chunk")
    earlier = over_chunks.rowsBetween(W.unboundedPreceding, -1)
    edges = (
        edges.withColumn("_enter", F.coalesce(
            (F.col("_first") - F.lag("_last").over(over_chunks) > gap).cast("int"), F.lit(0)))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .withColumn("_before", F.col("_enter") + F.coalesce(
            F.sum(F.col("_inside") + F.col("_enter")).over(earlier), F.lit(0)))
        .select(*group, "_offset", "_before")
    )
    placed = (
        inner.join(edges, group)
        .withColumn("pos", F.col("_rank") - 1 + F.col("_offset"))
        .withColumn("seg", (F.col("_breaks") + F.col("_before")).cast("bigint"))
        .drop("_rank", "_break", "_breaks", "_offset", "_before")
    )
    # segment extent: partial extents per (segment, chunk), joined back chunk by chunk
    parts = placed.groupBy(*group, "seg").agg(F.min("pos").alias("_min"), F.count(F.lit(1)).alias("_n"))
    whole = W.partitionBy(*keys, "seg")
    extents = parts.select(*group, "seg", F.min("_min").over(whole).alias("seg_start"),
                           F.sum("_n").over(whole).alias("seg_len"))
    return placed.join(extents, [*group, "seg"]).drop("_chunk")


def stride(df: DataFrame, k: int, order: str, keys=(), rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Systematic sample: rows 0, k, 2k, ... in ``order``."""
    if k == 1:
        return df
    numbered = with_position(df, order, keys, "_pos", rows_per_chunk)
    return numbered.filter(F.col("_pos") % k == 0).drop("_pos")


def stride_to(df: DataFrame, rows: int, order: str) -> DataFrame:
    """Stride chosen so that about ``rows`` rows are left: k = max(n // rows, 1)."""
    return stride(df, max(df.count() // rows, 1), order)


def framed(df: DataFrame, keys, before: int, after: int, first: str, position: str = "pos",
           rows_per_block: int | None = None):
    """Lay rows out for windows of ``before``/``after`` neighbouring rows.

    Returns the frame, the matching window, and the predicate that keeps each row's home copy.
    Blocks of consecutive positions are shuffled instead of whole series; a row near a block edge
    is copied to the neighbours whose windows reach it.  Apply the window functions, then filter.
    """
    size = max(rows_per_block or 100_000, before + after + 1)
    p = F.col(position)
    lowest = F.floor(F.greatest(p - after, F.col(first)) / size)
    highest = F.floor((p + before) / size)
    laid = df.withColumn("_block", F.explode(F.sequence(lowest, highest)))
    w = W.partitionBy(*keys, "_block").orderBy(position).rowsBetween(-before, after)
    return laid, w, F.col("_block") == F.floor(p / size)
