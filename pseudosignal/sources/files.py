"""Folders of results in whatever store the cluster uses."""

from __future__ import annotations

import time

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(context._jsc.hadoopConfiguration())


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders; those that are not there are no error."""
    for path in paths:
        place, store = _place(spark, path)
        store.delete(place, True)


def subfolders(spark: SparkSession, path: str) -> dict[str, float]:
    """Names of the folders in a folder, with their age in hours; none if it does not exist."""
    place, store = _place(spark, path)
    if not store.exists(place):
        return {}
    return {
        found.getPath().getName(): (time.time() - found.getModificationTime() / 1000) / 3600
        for found in store.listStatus(place)
        if found.isDirectory()
    }


def files_of(spark: SparkSession, path: str, suffix: str = "") -> list[str]:
    """Names of the files in a folder that end in ``suffix``; none if it does not exist."""
    place, store = _place(spark, path)
    if not store.exists(place):
        return []
    names = [f.getPath().getName() for f in store.listStatus(place) if f.isFile()]
    return [name for name in names if name.endswith(suffix)]


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes below a folder; 0 if it does not exist."""
    place, store = _place(spark, path)
    return store.getContentSummary(place).getLength() if store.exists(place) else 0
