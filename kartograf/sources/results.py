"""Where results go: predictions, metrics, seeds, and results remembered under their parameters."""

from __future__ import annotations

import hashlib
import json
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_predictions(df: DataFrame, path: str) -> None:
    """Aligned predictions with truth, time and validity; the folder must be new."""
    df.write.mode("errorifexists").parquet(f"{path}/predictions")


def write_metrics(metrics: DataFrame, path: str) -> None:
    """One JSON row of scores."""
    metrics.coalesce(1).write.mode("errorifexists").json(f"{path}/metrics")


def scalars(spark: SparkSession, rows: list[tuple[str, int, float]]) -> DataFrame:
    """Logged scalars: (``tag``, ``step``, ``value``)."""
    return spark.createDataFrame(rows, "tag string, step int, value double")


def remember_seed(spark: SparkSession, seed: int | None, path: str) -> int:
    """The configured seed, or a fresh one in [0, 65535] that is written down."""
    if seed is not None:
        return seed
    seed = random.randint(0, 65535)
    spark.createDataFrame([(str(seed),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/seed")
    return seed


def cache_key(params: dict) -> str:
    """SHA-256 of the parameters as JSON with sorted keys."""
    return hashlib.sha256(json.dumps(params, sort_keys=True).encode()).hexdigest()


def cache_key_column(json_text: Column) -> Column:
    return F.sha2(json_text, 256)


def remembered(spark: SparkSession, folder: str, params: dict, make) -> DataFrame:
    """Result of ``make()`` for these parameters, computed once and kept as a table."""
    path = f"{folder}/{cache_key(params)}"
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    there = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(files)
    if not there:
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
