"""Intermediate tables: written once to the folder that driver and executors share, read as often as needed."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; only a local master may do without that setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{found.rstrip('/') if found else tempfile.mkdtemp(prefix='spark-inkstone-')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """df as a written table, for what several steps read: it is computed once, and a lost executor costs a read."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, name: str) -> bool:
    """Whether a file or folder is there, in any store that Spark reads."""
    files, path = _file_system(spark, name)
    return files.exists(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a settled table that no later step reads."""
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        files, path = _file_system(df.sparkSession, name)
        files.delete(path, True)


def uri(spark: SparkSession, name: str) -> str:
    """A folder's full address, as Spark shows it in front of its files' names."""
    files, path = _file_system(spark, name)
    found = path.makeQualified(files.getUri(), files.getWorkingDirectory()).toString()
    return found.rstrip("/")
