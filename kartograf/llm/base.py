"""What the text operators share: written tables, lower-casing, digests of whole columns."""

from __future__ import annotations

import string
import tempfile
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kartograf.session import ship


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session on one machine that names none gets a temporary one.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        alone = context.master.startswith("local") and not context.master.startswith("local-cluster")
        if configured is None and not alone:
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="kartograf-"))
    return context.getCheckpointDir()


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and go on from the files.

    Lineage ends here: a lost executor costs a re-read, and random partitionings upstream cannot
    give two readers different rows.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete the files of tables that ``stored`` wrote and nothing reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def bucketed(df: DataFrame, key: str, name: str = "table") -> DataFrame:
    """``stored`` in buckets of ``key``, as many as a shuffle has partitions: a join by the key moves the other side only.

    Rows are written where they are.  The table's name leaves the catalog at once; its files are what is read.
    """
    spark = df.sparkSession
    unique = f"{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("compression", "zstd").option("path", f"{shared_folder(spark)}/{unique}").bucketBy(buckets, key).saveAsTable(unique)
    rows = spark.table(unique)
    rows.schema  # resolved while the name is known
    spark.sql(f"DROP TABLE {unique}")
    return rows


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


#: Stands for a NULL id inside tasks, where a column with NULLs would become one of floating numbers.
NO_ID = -(1 << 63)


def solid(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID))


def hollow(id_col: str = "id") -> Column:
    return F.nullif(F.col(id_col), F.lit(NO_ID))


def typed(rows: list[tuple], columns: list[str], numbers: set[str]) -> pd.DataFrame:
    """A frame whose named columns are whole numbers with gaps, all digits kept."""
    return pd.DataFrame({c: pd.array([r[i] for r in rows], dtype="Int64") if c in numbers else pd.Series([r[i] for r in rows], dtype=object)
                         for i, c in enumerate(columns)}, columns=columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepared(spark: SparkSession) -> SparkSession:
    """A session whose workers have this package and whose Arrow batches hold few long texts."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return ship(spark)
