"""The progress channel: what running queries have done, in a table that others read while they run."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from chronotext.sources.shared import file_system

# Least seconds between two rows of a query, and after how many without one it counts as stale.
LEAST_INTERVAL, STALE_AFTER = 2.0, 180.0
SCHEMA = "query string, name string, state string, batch long, rows long, updated_at double"


class Throttle:
    """Lets a key through once in an interval; forced calls always."""

    def __init__(self, interval: float = LEAST_INTERVAL, clock: Callable[[], float] = time.monotonic):
        self.interval, self.clock, self.last = interval, clock, {}

    def passes(self, key: str, force: bool = False) -> bool:
        now = self.clock()
        if not force and now - self.last.get(key, -1e18) < self.interval:
            return False
        self.last[key] = now
        return True


class ProgressChannel(StreamingQueryListener):
    """Writes one small file for each query below root and replaces it as the query goes on: rows so far, the last micro-batch, when. The first and
    the last state of a query are always written, those between at most one in an interval."""

    def __init__(self, spark: SparkSession, root: str, throttle: Throttle | None = None, wall: Callable[[], float] = time.time):
        self.spark, self.root, self.throttle, self.wall = spark, root.rstrip("/"), throttle or Throttle(), wall
        self.rows: dict[str, int] = {}
        self.batch: dict[str, int] = {}
        self.names: dict[str, str | None] = {}

    def write(self, query: str, state: str) -> None:
        row = {"query": query, "name": self.names.get(query), "state": state, "batch": self.batch.get(query, -1), "rows": self.rows.get(query, 0), "updated_at": self.wall()}
        fs, at = file_system(self.spark, f"{self.root}/{query}.json")
        _, aside = file_system(self.spark, f"{self.root}/_{query}.new")  # readers skip names with an underscore
        out = fs.create(aside, True)
        try:
            out.write(bytearray(json.dumps(row).encode()))
        finally:
            out.close()
        options = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
        array = self.spark.sparkContext._gateway.new_array(options, 1)
        array[0] = options.OVERWRITE
        self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), fs.getConf()).rename(fs.makeQualified(aside), fs.makeQualified(at), array)

    def onQueryStarted(self, event) -> None:
        self.names[str(event.id)] = event.name
        self.throttle.passes(str(event.id), force=True)
        self.write(str(event.id), "running")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        key = str(p.id)
        if p.batchId > self.batch.get(key, -1):
            self.rows[key] = self.rows.get(key, 0) + p.numInputRows
            self.batch[key] = p.batchId
        if self.throttle.passes(key):
            self.write(key, "running")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.write(str(event.id), "failed" if event.exception else "done")


def read_progress(spark: SparkSession, root: str, now: float, stale_after: float = STALE_AFTER) -> DataFrame:
    """query, name, state, batch, rows, updated_at, age_sec, stale: a running query that has told nothing for too long is stale."""
    rows = spark.read.schema(SCHEMA).json(root)
    age = F.greatest(F.lit(0.0), F.lit(float(now)) - F.col("updated_at"))
    return rows.withColumn("age_sec", F.round(age, 1)).withColumn("stale", (F.col("state") == "running") & (age > stale_after))
