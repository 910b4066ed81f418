"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str | None = None, app: str = "kartograf", **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
        # a round's files go once the driver holds no reference to them
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors' Python workers, once per context."""
    context = spark.sparkContext
    if not getattr(context, "_kartograf_shipped", False):
        package = os.path.dirname(os.path.abspath(__file__))
        base = os.path.join(tempfile.mkdtemp(prefix="kartograf-"), "kartograf")
        context.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(package), os.path.basename(package)))
        context._kartograf_shipped = True
    return spark


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and go on from the files.

    The folder is the cluster's own (``spark.checkpoint.dir``).  Only where a session names
    none, as in tests on one machine, a temporary one is set.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        alone = context.master.startswith("local") and not context.master.startswith("local-cluster")
        if configured is None and not alone:
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="kartograf-"))
    return df.checkpoint(eager)


def scalars(df: DataFrame, **aggregates: Column) -> Column:
    """Aggregates of a whole table as one struct column: an uncorrelated scalar subquery."""
    return df.agg(F.struct(*[value.alias(name) for name, value in aggregates.items()]).alias("s")).scalar()
