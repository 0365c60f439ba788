"""Session settings, folders for intermediate results, and the one way in which plans cut their lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "loomgraph", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; conf adds to or overrides the settings."""
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC"} | conf
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()


#: Folders made inside swept(), by nesting.
_MADE: list[list[str]] = []


def folder(spark: SparkSession, label: str) -> str:
    """A new folder's name below spark.checkpoint.dir, which all executors share.

    Only a master local[...], as in tests, may have the setting unset; it then gets a temporary folder.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if base is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="loomgraph-"))
        base = context.getCheckpointDir()
    path = f"{base.rstrip('/')}/loomgraph-{label}-{uuid.uuid4().hex}"
    if _MADE:
        _MADE[-1].append(path)
    return path


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, the folders that operators made inside; results that are still to be read must be written by then."""
    _MADE.append([])
    try:
        yield
    finally:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in _MADE.pop():
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


@contextmanager
def fleeting(spark: SparkSession) -> Iterator[None]:
    """Has Spark remove the shuffle files of what runs inside as soon as it has run; else they stay until the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """df computed once, written as Parquet into a shared folder and read back: lineage ends there, sizes are known, and filters and
    columns still reach the scan. Its shuffle files go at once."""
    schema, path = df.schema, folder(df.sparkSession, "cut")
    with fleeting(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def release(df: DataFrame) -> None:
    """Removes the folder of a df from cut() that no later plan reads."""
    spark = df.sparkSession
    for path in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        if "/loomgraph-cut-" in path:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
