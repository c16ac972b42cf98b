"""Session helpers: settings the operators rely on and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Over all shuffle partitions by ``key``, where AQE would join them for their few bytes.

    The key is hashed first: a plain repartition by a key the rows are grouped by already
    would be planned away.
    """
    return df.repartition(shuffle_partitions(df.sparkSession), F.xxhash64(key))


_local_roots: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under the cluster's shared checkpoint folder.

    Where the session names none, under the user's folder of the default file system if that is
    shared; this machine's temporary folder serves only a session that runs in one process.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or _default_root(spark)
    return f"{root.rstrip('/')}/shelfmark-{uuid.uuid4().hex}"


def _default_root(spark: SparkSession) -> str:
    jvm = spark._jvm.org.apache.hadoop.fs
    system = jvm.FileSystem.get(spark._jsc.hadoopConfiguration())
    if system.getUri().getScheme() != "file":
        return f"{system.getHomeDirectory().toString()}/shelfmark-scratch"
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return _local_roots.setdefault(context.applicationId, tempfile.mkdtemp(prefix="shelfmark-"))


def drop_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A scratch folder that goes when the block ends; what is read from it must be used up by then."""
    path = scratch_dir(spark)
    try:
        yield path
    finally:
        drop_folder(spark, path)


def written(df: DataFrame, path: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as parquet and return the table read back, so later stages start from files."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """An intermediate table written to the shared scratch folder.

    It is computed once, survives lost executors, and the size of its files tells the
    planner whether a join may broadcast it.
    """
    return written(df, scratch_dir(df.sparkSession))
