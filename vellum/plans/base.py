"""Where queries register themselves with the SQL of their oracle, and where their tables and built indexes come from."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

known: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
sql_of: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        known[f.__name__] = f
        if sql:
            sql_of[f.__name__] = sql
        return f

    return keep


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local master without one (tests) gets a temporary folder, any other is told."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="vellum-")
        atexit.register(shutil.rmtree, where, True)
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_built: dict[tuple, object] = {}


def version(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] = ("documents", "benchmark", "embeddings")) -> int:
    """A number for the files of some tables as they are: names, lengths and times of change, no contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load([f"{sf_dir}/{t}.parquet" for t in tables])
    return files.select(F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()[0] or 0


def once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[str], object]):
    """What `build` makes in a folder, made once for a session and a set of tables, as an index is; again when the tables' files change."""
    key = (spark.sparkContext.applicationId, sf_dir, version(spark, sf_dir), name)
    if key not in _built:
        _built[key] = build(new_folder(spark, name))
    return _built[key]
