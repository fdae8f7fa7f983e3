"""Files of any store that Spark can reach: list, get and put, through Hadoop's file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def listed(spark: SparkSession, path: str, suffix: str = "", folders: bool = False) -> list[str]:
    """Paths of the files (or folders) in a folder whose names end with suffix, sorted; empty if there is no such folder."""
    system, target = _system(spark, path)
    found = system.listStatus(target) if system.exists(target) else []
    return sorted(s.getPath().toString() for s in found if s.isDirectory() == folders and s.getPath().getName().endswith(suffix))


def fetched(spark: SparkSession, path: str, local: str) -> str:
    """Copies a file of the store to a local path."""
    system, target = _system(spark, path)
    system.copyToLocalFile(False, target, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(local), True)
    return local


def stored(spark: SparkSession, local: str, path: str) -> str:
    """Copies a local file to a path of the store."""
    system, target = _system(spark, path)
    system.copyFromLocalFile(False, True, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(local), target)
    return path


def unique_names(paths: list[str]) -> dict[str, str]:
    """For each path the shortest tail of its parts, joined by -, that no other path shares."""
    parts = {p: p.strip("/").split("/") for p in paths}
    out = {}
    for p, own in parts.items():
        n = next((k for k in range(1, len(own) + 1) if sum(o[-k:] == own[-k:] for o in parts.values()) == 1), len(own))
        out[p] = "-".join(own[-n:])
    return out
