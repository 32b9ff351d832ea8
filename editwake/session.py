"""The session, and the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: What Spark reads as one split unless told otherwise.
SPLIT_BYTES = 128 << 20
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def make_session(name: str = "editwake", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    cores = cpus or os.cpu_count() or 4
    builder = SparkSession.builder.appName(name).master(f"local[{cores}]")
    local = {"spark.sql.shuffle.partitions": str(cores), "spark.driver.memory": "8g"}
    for key, value in (SETTINGS | local | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only in local mode, where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        root = "file://" + tempfile.mkdtemp(prefix="editwake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application, so that executors need no copy of it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="editwake-")) / "editwake-package.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(here.rglob("*.py")):
            out.write(path, path.relative_to(here.parent).as_posix())
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath, jvm.org.apache.hadoop.fs.Path


def remove(spark: SparkSession, path: str) -> None:
    fs, hpath, _ = _fs(spark, path)
    fs.delete(hpath, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, hpath, _ = _fs(spark, path)
    return fs.exists(hpath)


def listing(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in path; none where it isn't there."""
    fs, hpath, _ = _fs(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(hpath)] if fs.exists(hpath) else []


def rename(spark: SparkSession, source: str, target: str) -> None:
    """One atomic step on HDFS and local disks. Nothing is replaced: an existing target is an error."""
    fs, hpath, path_of = _fs(spark, source)
    target_path = path_of(target)
    if fs.exists(target_path) or not fs.rename(hpath, target_path):
        raise OSError(f"could not rename {source} to {target}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, hpath, _ = _fs(spark, path)
    out = fs.create(hpath, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, hpath, _ = _fs(spark, path)
    if not fs.exists(hpath):
        return None
    stream = fs.open(hpath)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


_MARK = "CURRENT-"


def publish(spark: SparkSession, folder: str, number: int, text: str) -> None:
    """Makes version `number` of a folder valid: its mark is written aside and appears under its name by one rename.

    A mark is never replaced and no valid mark is taken away before a later one is there, so a program that dies at any
    point leaves the last valid version readable. Two writers of the same number: the second one fails.
    """
    aside = f"{folder}/.mark-{uuid.uuid4().hex}"
    write_text(spark, aside, text)
    try:
        rename(spark, aside, f"{folder}/{_MARK}{number:012d}")
    except OSError:
        remove(spark, aside)
        raise
    for name in listing(spark, folder):
        if name.startswith(_MARK) and int(name[len(_MARK) :]) < number - 1:
            remove(spark, f"{folder}/{name}")


def published(spark: SparkSession, folder: str) -> tuple[int, str] | None:
    """The highest valid version of a folder with its text."""
    marks = sorted((x for x in listing(spark, folder) if x.startswith(_MARK)), reverse=True)
    return (int(marks[0][len(_MARK) :]), read_text(spark, f"{folder}/{marks[0]}") or "") if marks else None


_made: dict[str, SparkSession] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the program ends."""
    path = f"{shared_root(spark)}/editwake/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def stage(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Cuts lineage: writes df to the shared folder and reads it back, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


def widened(df: DataFrame) -> DataFrame:
    """A table of fewer files than there are cores and smaller than one split, spread over the cores; any other as it is.

    Such a table would be one task, which matters where each row costs much (parsing, patterns, tokens). Only files and
    the optimizer's estimate are looked at, so nothing is run and a table of any size beyond stays unshuffled.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < SPLIT_BYTES and len(df.inputFiles()) < cores else df


@atexit.register
def _sweep() -> None:
    for path, spark in list(_made.items()):
        try:
            remove(spark, path)
        except Exception:  # the JVM is gone: the folder's owner cleans up
            return
