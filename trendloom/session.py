"""Session factory with the settings that the library assumes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
#: Applications whose part of the shared folder has been made.
_MADE: set[str] = set()


def session(app: str = "trendloom", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """UTC, adaptive execution with skew splitting; partitions are coalesced at run time, so the count may be generous."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions)) if shuffle_partitions else b
    return (b.master(master) if master else b).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; in local mode a temporary one where it is unset."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        folder = tempfile.mkdtemp(prefix="trendloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _LOCAL.append(f"file://{folder}")
    return _LOCAL[0]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the application's part of the shared folder, which goes when the application ends."""
    app = spark.sparkContext.applicationId
    folder = f"{shared_folder(spark)}/trendloom/{app}"
    if app not in _MADE:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _MADE.add(app)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut: written as a table in the shared folder and read back."""
    path = scratch(df.sparkSession, "cut")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows to a partition where ``parts`` deals them out.
PART_ROWS = 1 << 19


def parts(spark: SparkSession, rows: int) -> int:
    """Partitions for so many rows, so that a task's rows stay the same however large the table is.

    Adaptive execution joins partitions of a shuffle up to 64 MB as they are compressed: of short names these are millions
    of rows, and a gigabyte where a task hashes them. A number given to ``repartition`` is kept.
    """
    return max(spark.sparkContext.defaultParallelism, -(-rows // PART_ROWS))


def unique(df: DataFrame, n: int | None = None, *keys: str) -> DataFrame:
    """Distinct rows, in ``n`` partitions, those of equal keys (if given) in one."""
    return (df.repartition(n, *(keys or df.columns)) if n else df).distinct()


def apart(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that meets the other one by sorted partitions and is never sent whole through the driver.

    Catalyst takes the bytes of a column's files for its size in memory. What repeats (the list of candidates of all questions that ask for
    the same) or runs on (names by number) is a small part of that in a file, so tables far beyond the limit for broadcasts would be broadcast.
    """
    return df.hint("merge")


def spread(df: DataFrame, limit: int = 64 << 20) -> DataFrame:
    """A small input over all cores: a file of one row group is one task's, whatever is done with its rows.

    Inputs beyond ``limit`` bytes, as Catalyst estimates them, have row groups enough and are not moved.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = min(df.sparkSession.sparkContext.defaultParallelism, max(1, size >> 18))  # 256 KB to a part at the least
    return df.repartition(parts) if size <= limit else df
