"""The folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a temporary folder on a single machine,
    as in tests, and one in the warehouse on a cluster, if the warehouse is in a shared store; a machine's own folder is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and sc.master.startswith("local"):
            given = tempfile.mkdtemp(prefix="plazaflow-")
        if not given:
            warehouse = spark.conf.get("spark.sql.warehouse.dir")
            if ":" not in warehouse or warehouse.startswith("file:"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            given = f"{warehouse}/checkpoints"
        sc.setCheckpointDir(given)
    return sc.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again."""
    folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder in compressed columns and read again: for records with long texts, which in a checkpoint
    take the space that they have in memory, and of which a reader of few columns would read all. Rows may come in another order
    and in other partitions."""
    path = f"{folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store it is."""
    store, where = _at(spark, path)
    return store.exists(where)


def names(spark: SparkSession, path: str) -> list[str]:
    """What is in a folder, by name; nothing of a folder that isn't there."""
    store, where = _at(spark, path)
    return sorted(f.getPath().getName() for f in store.listStatus(where)) if store.exists(where) else []


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, in whatever store it is."""
    store, where = _at(spark, path)
    store.delete(where, True)
