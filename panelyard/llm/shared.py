"""What several corpus operators need: the shared folder, tables that cut lineage, slices of Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from panelyard.sources.folders import delete_folder, new_folder

#: Bytes of text that one numpy step works on; bounds a worker's memory whatever Spark's batch size.
SLICE_BYTES = 2 << 20


class Tables:
    """Tables of one run, in a folder of their own within the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.n = spark, new_folder(spark, name), 0

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written once and read back: later reads survive lost executors and repeat no work."""
        self.n += 1
        path = f"{self.folder}/{self.n:02d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Deletes the tables; nothing may be left to read from them."""
        delete_folder(self.spark, self.folder)


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of its own in the shared folder."""
    return Tables(df.sparkSession, name).kept(df, name)


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.StringArray]]:
    """Pieces of the batches holding about ``most`` bytes of text (one row at least), with that column; null text is empty."""
    for batch in batches:
        give_back()  # what the last batch took
        texts = batch.column(column)
        if batch.num_rows == 0:
            continue
        if not pa.types.is_string(texts.type):
            texts = texts.cast(pa.string())
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        row = 0
        while row < batch.num_rows:
            base = ends[row - 1] if row else 0
            stop = max(row + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(row, stop - row), pc.fill_null(texts.slice(row, stop - row), "")
            row = stop
    give_back()  # the worker lives on for other stages


def give_back() -> None:
    """Returns freed memory to the system: Arrow's pool and the C library keep it otherwise, in every worker for itself."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
        trim(0)


def raw(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes laid end to end, and where each begins (one more than texts)."""
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = texts.buffers()
    at = np.frombuffer(where, np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]
