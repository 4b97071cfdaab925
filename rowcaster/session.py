"""Session helpers: the shared folder and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def current() -> SparkSession:
    """The session at hand; threads of a pool have no active one of their own."""
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    named = tempfile.mkdtemp(prefix="rowcaster-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for paths in _recorders:
        paths.append(path)
    return path


_recorders: list[list[str]] = []


@contextmanager
def recorded() -> Iterator[list[str]]:
    """Collects the paths made inside, for a job that removes its intermediate tables at its end."""
    paths: list[str] = []
    _recorders.append(paths)
    try:
        yield paths
    finally:
        _recorders[:] = [p for p in _recorders if p is not paths]


def remove(spark: SparkSession, path: str) -> None:
    """Remove a path of this library's own making, if it is there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, name: str, partition_by: str | None = None, codec: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts lineage and survives the loss of executors. ``partition_by`` lets later
    filters on that column skip whole folders.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write if codec is None else df.write.option("compression", codec)
    if partition_by is not None:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(_nullable_order(df, partition_by)).parquet(path)


def _nullable_order(df: DataFrame, partition_by: str | None):
    from pyspark.sql.types import StructType

    fields = [f for f in df.schema.fields if f.name != partition_by]
    if partition_by is not None:
        fields.append(df.schema[partition_by])
    return StructType(fields)
