"""Versions of a folder of immutable files: a manifest per version, put in place by one rename that fails if the version is there already."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(Exception):
    """Another writer has committed since the version that this write began from."""


def _place(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current(spark: SparkSession, path: str) -> int:
    """The newest version; 0 where nothing was committed."""
    place, fs = _place(spark, f"{path}/versions")
    if not fs.exists(place):
        return 0
    return max((int(s.getPath().getName()) for s in fs.listStatus(place) if s.getPath().getName().isdigit()), default=0)


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """What was committed as the version (the newest if none is given); empty for version 0. Later commits change nothing in it."""
    version = current(spark, path) if version is None else version
    if version == 0:
        return {}
    place, fs = _place(spark, f"{path}/versions/{version:012d}")
    source = fs.open(place)
    try:
        return json.loads(bytes(source.readAllBytes()).decode())
    finally:
        source.close()


def commit(spark: SparkSession, path: str, base: int, content: dict) -> int:
    """Commits ``content`` as version base + 1; Conflict if another writer was first. Readers see the version before or this one, never a part."""
    jvm = spark.sparkContext._jvm
    place, fs = _place(spark, f"{path}/versions/{base + 1:012d}")
    draft, _ = _place(spark, f"{path}/versions/.{uuid.uuid4().hex}")
    fs.mkdirs(place.getParent())
    out = fs.create(draft, False)
    out.write(json.dumps(content).encode())
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(draft, place, options)
    except Exception as e:
        fs.delete(draft, False)
        if "FileAlreadyExists" in str(e):
            raise Conflict(f"{path}: version {base + 1} is there already") from e
        raise
    return base + 1


def delete(spark: SparkSession, path: str) -> None:
    place, fs = _place(spark, path)
    fs.delete(place, True)
