"""What the operators of this subpackage share: scratch tables, word patterns, columns that may be missing."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Where it is unset, a local master (tests) gets a new temporary one, and any other is told."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="vellum-")
        atexit.register(shutil.rmtree, where, True)
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: While a table is written: shuffle files go when the write ends, as what it wrote is read instead; and texts
#: reach Python a thousand rows at a time, so that long ones do not add up.
CLEANUP, ROWS_AT_ONCE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def writing(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in (CLEANUP, ROWS_AT_ONCE)}
    spark.conf.set(CLEANUP, "true")
    spark.conf.set(ROWS_AT_ONCE, str(rows))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def modest_batches(spark: SparkSession) -> None:
    """What an operator returns is run by its caller, under the session's settings: where these still send 10,000 rows to Python at once, as is usual for short rows, a thousand whole texts are enough."""
    if spark.conf.get(ROWS_AT_ONCE) == "10000":
        spark.conf.set(ROWS_AT_ONCE, "1000")


class Scratch:
    """Tables of one run in the shared folder: they cut lineage and outlive executors. They go when the program ends, as a result may be read until then."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.conf = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", spark._jsc.hadoopConfiguration()
        atexit.register(self._remove)
        modest_batches(spark)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        with writing(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing will read again."""
        for name in names:
            self._delete(f"{self.root}/{name}")

    def _delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.conf).delete(where, True)

    def _remove(self) -> None:
        with contextlib.suppress(Exception):  # the JVM may be gone
            self._delete(self.root)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches as views of some rows each: what Python makes of their texts is then small, however many rows the engine sends at once."""
    for batch in batches:
        for start in range(0, len(batch), rows):
            yield batch.slice(start, rows)


def quoted(name: str) -> str:
    """A column's name as a reference to it, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def text_or_empty(df: DataFrame, column: str = "text") -> Column:
    return F.coalesce(df[column].cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
