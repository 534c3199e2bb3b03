"""Shared plumbing: the shared folder, lineage cuts, size estimates, word rules."""

from __future__ import annotations

import io
import math
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch

#: Fixed value: the white space that separates words in every contract.
WORD = r"[^\x20\x09-\x0D]+"

_SHIPPED: set[str] = set()
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that their Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root, archive = Path(__file__).resolve().parents[1], io.BytesIO()
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        path = f"{fresh_path(spark, 'code')}/{root.name}.zip"
        target = hadoop_path(spark, path)
        out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
        out.write(archive.getvalue())
        out.close()
        spark.sparkContext.addPyFile(path)
        # Texts are long: batches of the default number of rows would take too much of a worker's memory.
        if spark.conf.get(ARROW_ROWS) == "10000":
            spark.conf.set(ARROW_ROWS, "2000")
        _SHIPPED.add(app)


def fresh_path(spark: SparkSession, name: str) -> str:
    return scratch(spark, name)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._trendloom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables written by ``materialize`` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_trendloom_path", None)
        if path:
            target = hadoop_path(df.sparkSession, path)
            target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(df: DataFrame) -> None:
    """Shuffle files that nothing reads any more go now, not when the driver happens to collect its garbage."""
    df.sparkSession.sparkContext._jvm.System.gc()


def hadoop_path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def size_hint(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes of ``df``: file sizes, without running a job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts_for(size: int, each: int, least: int = 1) -> int:
    return max(least, math.ceil(size / each))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def doc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod ``modulus``; a null doc_id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus).cast("int")
