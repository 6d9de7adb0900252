"""Several tables made visible at once: written aside as a version, then named by one pointer file.

Readers follow the pointer, so they see all tables of one version or all of another. A failure before the pointer is replaced leaves
the old version as it was; what was written aside is not referred to, and goes with ``prune``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronotext.sources.shared import file_system

POINTER = "CURRENT"


def _text(spark: SparkSession, path: str) -> str | None:
    fs, at = file_system(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def _replace(spark: SparkSession, path: str, text: str) -> None:
    """The file has the old text or the new one at any time: it is written beside and renamed over."""
    fs, at = file_system(spark, path)
    _, aside = file_system(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(aside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    jvm = spark.sparkContext._jvm
    option = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = option.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), fs.getConf()).rename(fs.makeQualified(aside), fs.makeQualified(at), options)


def version(spark: SparkSession, root: str) -> str | None:
    """The version that the pointer names; None before the first."""
    return _text(spark, f"{root.rstrip('/')}/{POINTER}")


def publish(root: str, tables: dict[str, DataFrame], guards: tuple[Callable[[dict[str, DataFrame]], None], ...] = (), expected: str | None = None) -> str:
    """Writes the tables as a new version of root and makes them visible together. Tables that are not given stay as they are in the version before. The
    guards see the tables as written and raise to refuse them. expected: the version that the caller has read; if the pointer
    has moved on since, the new version is refused (there is no lock: of two writers at the same moment the last wins)."""
    spark = next(iter(tables.values())).sparkSession
    root, name = root.rstrip("/"), uuid.uuid4().hex
    before = version(spark, root)
    parts = dict(line.split("\t") for line in (before or "").splitlines())
    for table, df in tables.items():
        at = f"{root}/versions/{name}/{table}"
        df.write.parquet(at)
        parts[table] = f"versions/{name}/{table}"
    new = {t: spark.read.parquet(f"{root}/{p}") for t, p in parts.items()}
    for guard in guards:
        guard(new)
    if expected is not None and version(spark, root) != expected:
        raise RuntimeError("another version was published meanwhile")
    text = "".join(f"{t}\t{p}\n" for t, p in sorted(parts.items()))
    _replace(spark, f"{root}/{POINTER}", text)
    return text


def current(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the version that the pointer names; empty before the first."""
    text = version(spark, root)
    return {t: spark.read.parquet(f"{root.rstrip('/')}/{p}") for t, p in (line.split("\t") for line in (text or "").splitlines())}


def prune(spark: SparkSession, root: str) -> int:
    """Deletes versions that the pointer does not name; returns how many. Only for when no publisher and no reader of an old version is at work."""
    root = root.rstrip("/")
    named = {line.split("\t")[1].split("/")[1] for line in (version(spark, root) or "").splitlines()}
    fs, at = file_system(spark, f"{root}/versions")
    gone = [f.getPath() for f in (fs.listStatus(at) if fs.exists(at) else []) if f.getPath().getName() not in named]
    for path in gone:
        fs.delete(path, True)
    return len(gone)
