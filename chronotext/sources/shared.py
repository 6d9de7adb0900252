"""The folder that the driver and all executors share, and what is written there."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. A local master without it uses a folder of the warehouse; a cluster without it raises an error."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_chronotext"  # one machine, as in tests
        sc.setCheckpointDir(at)
    return str(at).rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/chronotext/{name}-{uuid.uuid4().hex}"


def materialized(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: computed once, without lineage, there for every executor."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """(Hadoop's file system of the path, the path) through the driver's JVM."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet files of a folder, or a single file, as a stream."""
    # a file stream reads a folder; a single file is named by its glob
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path if path.endswith("*") else f"{path}*")


def drained(stream: DataFrame, name: str = "stream") -> DataFrame:
    """All rows that a stream gives until its sources are exhausted; they land in the shared folder and are read back."""
    spark = stream.sparkSession
    at = fresh_path(spark, name)
    q = stream.writeStream.format("parquet").outputMode("append").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def with_conf(spark: SparkSession, conf: dict[str, str], run: Callable):
    """run() under settings that are put back afterwards."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        return run()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
