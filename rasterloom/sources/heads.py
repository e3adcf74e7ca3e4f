"""Parts of files, read by range: the work does not grow with what the files hold behind them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from rasterloom.sources.listing import one_slash

Read = Callable[[int, int], bytes]  # (offset, bytes) of one file; fewer bytes at its end
Open = Callable[[str], Read]


def open_ranges(path: str) -> Read:
    """Reads ranges of a file of a local, mounted or object store that ``pyarrow`` knows."""
    if path.startswith("file:") or path.startswith("/"):
        store, name = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    else:
        store, name = fs.FileSystem.from_uri(path)
    file = store.open_input_file(name)
    return lambda at, n: file.read_at(n, at) if n > 0 else b""


def _reachable(files: DataFrame) -> bool:
    """Whether all stores that the files lie in can be read by range; there are as many rows as stores."""
    stores = files.select(F.regexp_extract("path", "^[^:/]*:/+[^/]*|^", 0).alias("store"), "path").groupBy("store").agg(F.min("path").alias("path"))
    for row in stores.collect():
        if not row["path"].startswith(("file:", "/")):
            try:
                fs.FileSystem.from_uri(row["path"])
            except (ValueError, OSError, NotImplementedError):
                return False
    return True


def from_ranges(spark: SparkSession, path: str, take: Callable[[Read], bytes | int | None], kind: str, opener: Open | None = None) -> DataFrame:
    """(path, length, found) of every file with a byte: what ``take`` makes of ranges of it, of the SQL type ``kind``.

    Files are listed by Spark and opened by the tasks. In a store that cannot be read by range, Spark reads them whole.
    """
    files = spark.read.format("binaryFile").load(path)
    arrow = {"binary": pa.binary(), "int": pa.int32()}[kind]
    if opener is None and not _reachable(files.select("path")):

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held = [c.as_py() for c in batch.column("content")]
                found = pa.array([take(lambda at, n, c=c: c[at : at + max(n, 0)]) for c in held], arrow)
                yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("length"), found], names=["path", "length", "found"])

        return files.select("path", "length", "content").mapInArrow(whole, f"path string, length long, found {kind}")
    start = opener or open_ranges

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([take(start(p)) for p in batch.column("path").to_pylist()], arrow)
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("length"), found], names=["path", "length", "found"])

    return files.select("path", "length").mapInArrow(ranged, f"path string, length long, found {kind}")


def file_heads(spark: SparkSession, path: str, size: int, opener: Open | None = None) -> DataFrame:
    """(path, length, content) of every file with a byte; ``content`` is its first ``size`` bytes."""
    heads = from_ranges(spark, path, lambda read: read(0, size), "binary", opener)
    return heads.select(one_slash(F.col("path")).alias("path"), "length", F.col("found").alias("content"))
