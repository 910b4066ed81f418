"""Training sets: random pairs, time-constrained triplets, samples without replacement.

Draws are hashes of the row position, so a sample does not depend on partitioning or retries.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartograf.functions.scalars import draw, pick
from kartograf.operators.ordering import ROWS_PER_CHUNK, framed, with_position


def draw_pairs(df: DataFrame, seed: int = 0, order: str = "id", rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """A random partner for every row: (``i``, ``j``).  The last row is never drawn."""
    rows = with_position(df.select(order), order, (), "pos", rows_per_chunk)
    n = rows.count()
    drawn = rows.withColumn("_at", pick(F.col("pos"), seed, max(n - 1, 1)))
    partner = rows.select(F.col("pos").alias("_at"), F.col(order).alias("j"))
    return drawn.join(partner, "_at").select(F.col(order).alias("i"), "j")


def pair_key(pairs: DataFrame) -> DataFrame:
    """Key of a symmetric pair table: (``low``, ``high``)."""
    return pairs.withColumn("low", F.least("i", "j")).withColumn("high", F.greatest("i", "j"))


def look_up_distances(pairs: DataFrame, condensed: DataFrame) -> DataFrame:
    """Distances of given pairs from a stored table of i<j; zero on the diagonal."""
    stored = condensed.select(F.col("i").alias("low"), F.col("j").alias("high"), "d")
    return pair_key(pairs).join(stored, ["low", "high"], "left").select(
        "i", "j", F.when(F.col("i") == F.col("j"), F.lit(0.0)).otherwise(F.col("d")).alias("d"))


def square(condensed: DataFrame) -> DataFrame:
    """Both directions of a stored table of i<j, without the diagonal; the table is read once."""
    turned = F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "d")
    return condensed.select(F.inline(F.array(F.struct("i", "j", "d"), turned)))


def draw_triplets(df: DataFrame, time_range: float, recording_frequency: float, seed: int = 0, order: str = "id",
                  ts: str = "ts", rows_per_chunk: int = ROWS_PER_CHUNK, rows_per_block: int = 100_000) -> DataFrame:
    """For every anchor a positive near in time and a random negative.

    Positives lie within ceil(range x frequency) rows and ``time_range`` seconds (inclusive); where
    none does, the nearest in time among those rows; where there are no rows, the anchor itself.
    Negatives are drawn from all rows.
    """
    reach = math.ceil(time_range * recording_frequency)
    rows = with_position(df.select(order, ts), order, (), "pos", rows_per_chunk).withColumn("_zero", F.lit(0))
    n = rows.count()
    laid, w, home = framed(rows, [], reach, reach, "_zero", rows_per_block=rows_per_block)
    near = F.collect_list(F.struct(F.col("pos").alias("p"), F.col(ts).alias("t"), F.col(order).alias("k"))).over(w)
    laid = laid.withColumn("_near", near).filter(home)
    others = F.transform(F.filter("_near", lambda c: c["p"] != F.col("pos")), lambda c: F.struct(
        F.abs(c["t"] - F.col(ts)).alias("dt"), c["p"].alias("p"), c["k"].alias("k")))
    laid = laid.withColumn("_others", others)
    laid = laid.withColumn("_inside", F.filter("_others", lambda c: c["dt"] <= time_range))
    chosen = F.get(F.col("_inside"), pick(F.col("pos"), seed, F.size("_inside")).cast("int"))
    positive = F.when(F.size("_inside") > 0, chosen["k"]).otherwise(
        F.coalesce(F.array_min("_others")["k"], F.col(order)))
    drawn = laid.select(F.col(order).alias("anchor"), positive.alias("positive"),
                        pick(F.col("pos"), seed + 1, n).alias("_at"))
    return drawn.join(rows.select(F.col("pos").alias("_at"), F.col(order).alias("negative")), "_at").drop("_at")


def sample_exact(df: DataFrame, fraction: float, key: str = "id", seed: int = 0,
                 rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Exactly int(n x fraction) rows without replacement: the first in the order of a draw from their key."""
    hashed = df.withColumn("_hash", draw(F.col(key), seed))
    kept = int(hashed.count() * fraction)
    return with_position(hashed, "_hash", (), "_at", rows_per_chunk).filter(F.col("_at") < kept).drop("_hash", "_at")
