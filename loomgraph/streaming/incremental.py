"""Incremental parsing of arriving source files with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import make_id
from ..sources import extract, files

SOURCE = "path string, modificationTime timestamp, length long, content binary"


def parsed_stream(spark: SparkSession, folder: str, repo: str) -> DataFrame:
    """Fact records of each source file that arrives below folder, once per arrival."""
    raw = spark.readStream.format("binaryFile").schema(SOURCE).option("recursiveFileLookup", True).load(folder)
    rows = raw.select("path", F.decode("content", "UTF-8").alias("content")).withColumn("language", files.language(F.col("path"))).filter("language is not null")
    return extract.facts(rows.withColumn("id", make_id(F.lit(repo), F.col("path"))))


def run(spark: SparkSession, folder: str, repo: str, checkpoint: str, sink: Callable[[dict[str, DataFrame], int], None]):
    """Gives sink the fact tables of each micro-batch; a batch that is repeated after a failure has the same number."""

    def each(batch: DataFrame, number: int) -> None:
        sink(extract.tables(batch), number)

    return parsed_stream(spark, folder, repo).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
