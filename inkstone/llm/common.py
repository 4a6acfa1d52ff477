"""What the training-data operators share: reading tables, the shared folder, settled intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may do without the setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if spark.conf.get("inkstone.local.shared", None) is None:
        spark.conf.set("inkstone.local.shared", tempfile.mkdtemp(prefix="spark-inkstone-"))
    return spark.conf.get("inkstone.local.shared")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Writes df once to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    return settle_at(df, new_path(df.sparkSession, name), compression)


def settle_at(df: DataFrame, path: str, compression: str | None = None) -> DataFrame:
    """The same at a path of its own, over what an earlier attempt left there."""
    df.write.parquet(path, mode="overwrite", compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def beside_row(docs: DataFrame, **helpers: Column) -> DataFrame:
    """Every row of docs as one struct, row, and helper columns of its own beside it: names in docs can't clash with them.
    select("row.*") gives the columns back as they were."""
    return docs.select(F.struct("*").alias("row"), *(c.alias(name) for name, c in helpers.items()))


def _file_system(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, name: str) -> bool:
    """Whether a file or folder is there, in any store that Spark reads."""
    files, path = _file_system(spark, name)
    return files.exists(path)


def delete(spark: SparkSession, name: str) -> None:
    """Deletes a folder, in any store that Spark reads."""
    files, path = _file_system(spark, name)
    files.delete(path, True)


def discard(df: DataFrame) -> None:
    """Deletes the files of a settled table that no later step reads."""
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        delete(df.sparkSession, name)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)
