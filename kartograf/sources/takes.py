"""Recordings and splits as Parquet folders.

A *take* is one folder ``take<N>`` holding Parquet files at any depth and, optionally, a
``description.json`` with ``additional_info.cir_res`` (tap period) and ``additional_info.ru_ids``.
A *split* is takes joined in a given order, with a ``metadata`` JSON folder next to the rows.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kartograf.operators.ordering import with_position
from kartograf.operators.graph import union_all

TAKE_FIELDS = {
    # stored name -> name in a split
    "CIR": "cir", "antenna_mask": "valid_mask", "timestamp": "ts", "reference": "reference", "toa": "toa",
    "interpolation_diff": "interp_diff",
}


def read_take(spark: SparkSession, base: str, take: int) -> DataFrame:
    """Rows of one take; an absent folder is an error."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{base}/take{take}")
    named = [F.col(c).alias(TAKE_FIELDS.get(c, c)) for c in rows.columns]
    return rows.select(*named).withColumn("take", F.lit(take))


def read_description(spark: SparkSession, base: str, take: int) -> dict:
    """``cir_res`` and ``ru_ids`` of a take, as far as its description has them."""
    text = spark.read.text(f"{base}/take{take}/description.json", wholetext=True).first()
    info = json.loads(text[0]).get("additional_info", {}) if text else {}
    return {k: info[k] for k in ("cir_res", "ru_ids") if k in info}


def merge_takes(takes: list[DataFrame], order: str = "id", optimized: bool = False) -> DataFrame:
    """Append takes in list order (one may occur twice), hide invalid arrival times, renumber rows.

    Rows keep their order within a take; ``id`` becomes the position in the whole split.
    ``optimized`` stores signals as floats instead of doubles; time stays a double.
    """
    merged = union_all([t.withColumn("take_pos", F.lit(p)) for p, t in enumerate(takes)])
    if "toa" in merged.columns:
        merged = merged.withColumn("toa", F.zip_with("toa", "valid_mask", lambda v, ok: F.when(ok, v)))
    if optimized:
        shrink = {"cir": "array<array<array<float>>>", "reference": "array<float>", "toa": "array<float>",
                  "interp_diff": "array<float>"}
        for c, kind in shrink.items():
            if c in merged.columns:
                merged = merged.withColumn(c, F.col(c).cast(kind))
    placed = with_position(merged, order, ["take_pos"], "_in_take")
    sizes = placed.groupBy("take_pos").agg(F.count(F.lit(1)).alias("_n")).collect()
    starts, at = {}, 0
    for row in sorted(sizes, key=lambda r: r["take_pos"]):
        starts[row["take_pos"]], at = at, at + row["_n"]
    start = F.coalesce(*[F.when(F.col("take_pos") == p, F.lit(v)) for p, v in starts.items()], F.lit(0))
    return placed.withColumn("id", (F.col("_in_take") + start).cast("bigint")).drop("_in_take", "take_pos")


def write_split(df: DataFrame, path: str, metadata: dict) -> None:
    df.write.mode("errorifexists").parquet(f"{path}/fp")
    _write_json(df.sparkSession, metadata, f"{path}/metadata")


def read_split(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    text = spark.read.text(f"{path}/metadata").first()
    return spark.read.parquet(f"{path}/fp"), json.loads(text[0])


def write_distances(snapshots: DataFrame, pairs: DataFrame, path: str, gen_params: dict, metadata: dict | None = None) -> None:
    """The distance file: strided rows, the pair table (i<j, d) and how it was made."""
    write_split(snapshots, path, metadata or {})
    pairs.write.mode("errorifexists").parquet(f"{path}/cc_dist")
    _write_json(snapshots.sparkSession, gen_params, f"{path}/gen_params")


def read_distances(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/cc_dist")


def _write_json(spark: SparkSession, content: dict, path: str) -> None:
    line = spark.createDataFrame([(json.dumps(content, sort_keys=True),)], "value string")
    line.coalesce(1).write.mode("errorifexists").text(path)
