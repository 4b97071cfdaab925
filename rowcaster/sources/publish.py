"""Artifacts of a job as one version: written aside, listed in a manifest, published by one rename.

A version is a folder ``v=<number>`` below the job's output, with all its parts and a manifest
of their paths, lengths and checksums. Until the rename nothing of it is seen, so a job that
stops halfway leaves the version before it as it was. Readers take the last complete version.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..session import remove
from .artifacts import exists, load_json, save_json

MANIFEST = "manifest"
CHECKED_BYTES = 64 << 20  # longer files are listed by their length alone
KEPT = 3  # versions that stay


def _system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def versions(spark: SparkSession, output: str) -> list[int]:
    """Numbers of the complete versions, ascending."""
    system, target = _system(spark, output)
    if not system.exists(target):
        return []
    names = [re.fullmatch(r"v=(\d+)", s.getPath().getName()) for s in system.listStatus(target)]
    return sorted(int(m[1]) for m in names if m and exists(spark, f"{output}/{m[0]}/{MANIFEST}"))


def version_path(output: str, number: int) -> str:
    return f"{output}/v={number:06d}"


def latest(spark: SparkSession, output: str) -> str:
    """The folder of the last complete version; ``output`` itself where nothing was published in versions."""
    found = versions(spark, output)
    return version_path(output, found[-1]) if found else output


def list_parts(spark: SparkSession, folder: str) -> dict[str, dict]:
    """Length and checksum of every file below a folder, by its relative path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = _system(spark, folder)[1].toUri().getPath().rstrip("/") + "/"
    checked = files.where(F.col("length") <= CHECKED_BYTES).select("path", "length", F.sha2("content", 256).alias("sha256"))
    rest = files.where(F.col("length") > CHECKED_BYTES).select("path", "length", F.lit(None).cast("string").alias("sha256"))
    rows = checked.unionByName(rest).collect()  # a line for each file of a model and its reports
    return {r["path"].split(root, 1)[1]: {"length": r["length"], "sha256": r["sha256"]} for r in rows}


def damaged(spark: SparkSession, folder: str) -> list[str]:
    """Parts of a version that are not as its manifest has them."""
    wanted = load_json(spark, f"{folder}/{MANIFEST}")["parts"]
    found = list_parts(spark, folder)
    return sorted(p for p, about in wanted.items() if found.get(p) != about)


@contextmanager
def publishing(spark: SparkSession, output: str) -> Iterator[str]:
    """The folder to write a new version to; leaving the block publishes it, an error removes it."""
    draft = f"{output}/.draft-{uuid.uuid4().hex}"
    try:
        yield draft
        save_json(spark, {"parts": list_parts(spark, draft)}, f"{draft}/{MANIFEST}")
        found = versions(spark, output)
        system, source = _system(spark, draft)
        number = found[-1] + 1 if found else 1
        target = _system(spark, version_path(output, number))[1]
        if system.exists(target) or not system.rename(source, target):
            raise OSError(f"{target} could not be published; another job may have taken its number")
    except BaseException:
        remove(spark, draft)
        raise
    for number in versions(spark, output)[:-KEPT]:
        remove(spark, version_path(output, number))
