"""JSON and JSON lines, reports, the index's metadata and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A document of JSON a file: an object is a row, an array a row for each member."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def read_map(spark: SparkSession, path: str, field: str, kind: str = "bigint") -> DataFrame:
    """key, value of an object that is used as a map, such as a vocabulary's tokens."""
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.from_json("value", f"`{field}` map<string, {kind}>").alias("j"))
    return parsed.select(F.explode(F.col("j").getField(field)).alias("key", "value"))


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_report(rows: DataFrame, path: str, order: str, line: str) -> None:
    """A report's lines in order as one text file. Reports are of bounded length: one partition holds one."""
    rows.orderBy(order).select(F.col(line).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_metadata(path: str, manifest: DataFrame, vocabulary: DataFrame, glossary: DataFrame) -> dict[str, int]:
    """Replaces the metadata of an index, then counts what was written; refuses unless there is one manifest and all of the rest."""
    spark, found = manifest.sparkSession, {}
    for name, rows in (("manifest", manifest), ("vocabulary", vocabulary), ("glossary", glossary)):
        want = rows.count()
        rows.write.mode("overwrite").parquet(f"{path}/{name}")
        found[name] = spark.read.parquet(f"{path}/{name}").count()
        if found[name] != want or (name == "manifest" and want != 1):
            raise ValueError(f"{name}: {found[name]} rows written of {want}")
    return found


def create_collection(spark: SparkSession, table: str, schema: str, path: str, buckets: int = 64) -> None:
    """The table of points, clustered by the fields that searches filter by; nothing happens if it is there."""
    spark.sql(f"create table if not exists {table} ({schema}) using parquet clustered by (source_type, standard_no) into {buckets} buckets location '{path}'")
