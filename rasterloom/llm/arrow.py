"""Arrow batches inside tasks: slices of bounded size, byte views, and columns that meet the caller's own."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructType

SLICE_BYTES = 2 << 20


def without(df: DataFrame, schema: str | list[str]) -> DataFrame:
    """``df`` less the columns that an operator is about to add; names compare without case, as in Spark."""
    names = StructType.fromDDL(schema).names if isinstance(schema, str) else schema
    taken = {name.lower() for name in names}
    return df.drop(*[name for name in df.columns if name.lower() in taken])


def aside(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns under names that no operator uses, and those names by the old ones."""
    own = {name: f"_llm_own_{i}" for i, name in enumerate(df.columns)}
    return df.toDF(*own.values()), own


def back(df: DataFrame, own: dict[str, str]) -> DataFrame:
    """The columns that were set aside, under their old names, and no others."""
    return df.select(*(F.col(name).alias(old) for old, name in own.items()))


def with_text(df: DataFrame, text: str) -> tuple[DataFrame, str]:
    """``df`` with the text as a string, and that column's name: its own if it is a string already, which saves a copy."""
    if text in df.columns and isinstance(df.schema[text].dataType, StringType):
        return df, text
    return df.withColumn("_llm_text", F.col(text).cast("string")), "_llm_text"


def tidy() -> None:
    """Give memory that a task no longer needs back to the system: workers live on and serve other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def ddl(df: DataFrame, added: str) -> StructType:
    """Schema of ``df`` followed by the added columns."""
    return StructType([*df.schema.fields, *StructType.fromDDL(added).fields])


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about ``most`` bytes; a longer text is a run of its own."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another (null: none), and where each text starts; one offset more than texts."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def extended(batch: pa.RecordBatch, schema: pa.Schema, added: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with further columns, typed as ``schema`` says."""
    arrays = [*batch.columns, *(array.cast(schema.field(name).type) for name, array in added.items())]
    return pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *added])
