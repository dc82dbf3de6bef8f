"""What the training-data operators share: tables, folds, shared-folder staging."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the result contracts: space and the five ASCII controls from tab on.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

#: Bytes of ASCII letters in lower case, of digits and of all characters beyond ASCII as they are; every other byte is a space.
_ALNUM = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()

_own_folder: dict[str, str] = {}
#: Folders written since each open ``cleared`` block began, innermost last.
_written: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset on one machine (a local
    master, as in tests) a temporary one is made once per application; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.partition("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = "file://" + tempfile.mkdtemp(prefix="cordage-")
        spark.sparkContext.setCheckpointDir(_own_folder[app])
    return _own_folder[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/cordage/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again: later steps read the
    files, so neither a lost executor nor a second use computes it anew."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    for block in _written:
        block.append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes what was staged inside the block when it ends, but for the paths that the block takes out of the list."""
    paths: list[str] = []
    _written.append(paths)
    try:
        yield paths
    finally:
        _written.remove(paths)
    for path in paths:
        delete(spark, path)


def release() -> None:
    """Gives memory that this Python process no longer uses back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, after which the Python worker gives unused memory back: a worker serves many tasks and stages, and what one held at its
    peak would otherwise stay with it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return task


def fold(doc_id: Column) -> Column:
    """crc32 of the id's text, modulo 3. Null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def held_out(doc_id: Column) -> Column:
    """True where labels must not be learned from; a null id is never learned from."""
    return F.coalesce(fold(doc_id) == 1, F.lit(True))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def plain_terms(text: str | None) -> list[bytes]:
    """The UTF-8 bytes of the maximal runs of ASCII letters (A-Z as a-z), ASCII digits and characters beyond ASCII."""
    return (text or "").encode("utf-8", "replace").translate(_ALNUM).split()


def whole_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
