"""What the operators share: the shared working folder, table materialisation and word rules."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space; bytes.split() has the same rule.
WORD_SPLIT = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Without it nothing can be written that survives an executor."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_chronotext"  # one machine, as in tests
        sc.setCheckpointDir(at)
    return str(at)


def trim() -> None:
    """Give freed memory back: a worker lives on after its task, and its executor's memory is counted with it."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library, which has no such call
    pa.default_memory_pool().release_unused()


def trimmed(of: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that gives its memory back at its end."""

    def rows(batches):
        try:
            yield from of(batches)
        finally:
            trim()

    return rows


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/chronotext/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors, computes once."""
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._chronotext = path
    return out


def located(df: DataFrame, name: str) -> tuple[DataFrame, Column]:
    """(df, or a copy of it in the shared folder, and the place of each row: its file and its number there), which stays the same however often
    df is read. Frames that don't come straight from Parquet files are written first."""
    place = lambda d: F.struct(d.metadataColumn("_metadata")["file_path"].alias("file"), d.metadataColumn("_metadata")["row_index"].alias("row"))
    try:
        df.select(place(df)).schema
    except AnalysisException:
        df = materialize(df, name)
    return df, place(df)


def picked(df: DataFrame, place: Column, chosen: DataFrame) -> DataFrame:
    """Those rows of a located df whose places (file, row) are among the chosen ones. What is sent to the executors is a bit for each row (4 KB
    for each begun 32768 rows of a file), so that the rows themselves are not shuffled."""
    at = chosen.groupBy("file", F.bitmap_bucket_number("row").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("row")).alias("bits"))
    bit = F.bitmap_bit_position(place["row"])
    byte = F.conv(F.hex(F.substring(at["bits"], (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    mine = (place["file"] == at["file"]) & (F.bitmap_bucket_number(place["row"]) == at["bucket"])
    return df.join(F.broadcast(at), mine & (F.getbit(byte, (bit % 8).cast("int")) == 1), "left_semi")


def release(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more; other frames are left alone. Shuffle files of frames that are gone go with them,
    once the driver's JVM has collected its garbage."""
    gc.collect()
    for df in tables:
        if path := getattr(df, "_chronotext", None):
            jvm = df.sparkSession.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    SparkSession.active().sparkContext._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """Evaluate value once and hand it to body, as a one-element transform: Catalyst can't inline it twice."""
    return F.transform(F.array(value), body)[0]
