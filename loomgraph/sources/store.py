"""Stored tables and incremental runs: versions are written beside each other and swapped by a pointer file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import MIGRATIONS, SCHEMA_VERSION, TABLES


def differing(now: DataFrame, held: DataFrame) -> DataFrame:
    """Files of now (path, content_hash) with added (held has none such) and changed (its hash differs, or it is new)."""
    old = held.select("path", F.col("content_hash").alias("_held"), F.lit(True).alias("_known"))
    rows = now.join(old, "path", "left")
    return rows.withColumn("added", F.col("_known").isNull()).withColumn("changed", ~F.col("content_hash").eqNullSafe(F.col("_held"))).drop("_held", "_known")


def stale(held: DataFrame, now: DataFrame) -> DataFrame:
    """Held files that now lacks, all of them when now is empty."""
    return held.join(now.select("path"), "path", "left_anti")


def upsert(held: DataFrame, new: DataFrame, key: str, keep: list[str] | None = None) -> DataFrame:
    """held with new's rows in place of those that share their key; columns of keep stay as they were held."""
    if keep:
        old = held.select(key, *[F.col(c).alias(f"_{c}") for c in keep])
        new = new.join(old, key, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in keep}).drop(*[f"_{c}" for c in keep])
    return held.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def without_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    """rows of any table with file_id, without those of files (id)."""
    return rows.join(files.select(F.col("id").alias("file_id")), "file_id", "left_anti")


class Store:
    """Tables below a folder. A run writes the tables it changed in a folder of its own, then one row to `versions` that says, for each
    table, which folder holds it: readers see all of a run or nothing, and tables that a run left alone are not written again."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def _latest(self) -> tuple[int, int, dict[str, int]]:
        """The last run's number, its schema's version, and which run wrote each table."""
        path = f"{self.folder}/versions"
        if not self._exists(path):
            return 0, SCHEMA_VERSION, {}
        row = self.spark.read.schema("version int, schema_version int, tables map<string,int>").parquet(path).orderBy(F.desc("version")).limit(1).collect()
        return (row[0]["version"], row[0]["schema_version"] or 1, row[0]["tables"] or {}) if row else (0, SCHEMA_VERSION, {})

    def version(self) -> int:
        return self._latest()[0]

    def read(self, name: str) -> DataFrame:
        _, made_by, held = self._latest()
        if name not in held:
            return self.spark.createDataFrame([], TABLES[name])
        return migrated(self.spark.read.schema(TABLES[name]).parquet(f"{self.folder}/v{held[name]}/{name}"), name, made_by)

    def write(self, tables: dict[str, DataFrame]) -> int:
        """tables as a new version, beside those that it leaves as they are."""
        last, _, held = self._latest()
        version = last + 1
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.folder}/v{version}/{name}")
        row = [(version, SCHEMA_VERSION, {**held, **dict.fromkeys(tables, version)})]
        self.spark.createDataFrame(row, "version int, schema_version int, tables map<string,int>").coalesce(1).write.mode("append").parquet(f"{self.folder}/versions")
        return version


def migrated(df: DataFrame, name: str, made_by: int) -> DataFrame:
    """df of a store whose schema had version made_by, with the values that later versions give to columns it lacked."""
    for version in sorted(v for v in MIGRATIONS if v > made_by):
        for column, value in MIGRATIONS[version].get(name, {}).items():
            df = df.withColumn(column, F.coalesce(F.col(column), F.expr(value)))
    return df
