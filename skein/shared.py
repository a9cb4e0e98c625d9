"""Tables in the folder that all executors share, and joins with sides of a checked size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: dict[str, str] = {}

#: Rows of a table that may be broadcast.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where the setting is absent and everything runs on this machine (tests), a
    temporary folder is made, once per session; on a cluster that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _OWN_DIRS:
        _OWN_DIRS[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="skein-shared-")
    return _OWN_DIRS[context.applicationId]


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of ``path``, and the path in its form."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def list_names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files and folders in ``folder``, wherever it lies."""
    files, target = file_system(spark, folder)
    return sorted(s.getPath().getName() for s in files.listStatus(target))


def read_text(spark: SparkSession, path: str) -> str:
    """One small file as text."""
    return "".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return the written table.

    Cuts the lineage so that losing an executor costs only unfinished tasks, and
    so that a table used twice is computed once. Removed by ``release``, or when the
    driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skein-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, target = file_system(spark, path)
    files.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table made by ``stage`` that nothing reads any more."""
    path = getattr(df, "_staged_at", None)
    if path:
        files, target = file_system(df.sparkSession, path)
        files.delete(target, True)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has ``most`` rows at the most.

    A larger one stays as it is: Spark joins it by a shuffle, whose skewed partitions
    adaptive execution splits. ``df`` must be cheap to read, such as a staged table.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def once(df: DataFrame, key: str) -> DataFrame:
    """``df`` with one row for each ``key``, of repeated ones the least by its columns' hash.

    Only keys are shuffled, and the rows of keys that occur more than once.
    """
    repeated = small(stage(df.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("__key")))
    same = df[key].eqNullSafe(repeated["__key"])
    names = [c for c in df.columns if c != key]
    several = df.join(repeated, same, "left_semi").groupBy(key).agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias("__row")).select(key, "__row.*")
    return df.join(repeated, same, "left_anti").unionByName(several)
