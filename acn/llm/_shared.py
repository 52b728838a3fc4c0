"""Shared storage, text constants and Arrow helpers of the corpus operators."""

from __future__ import annotations

import gc
import re
import time
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialise, new_path  # noqa: F401  the operators take them from here

#: A word is a run of characters outside this ASCII white space; bytes.split() splits at the same six.
WHITE = "\t\n\x0b\x0c\r "
WORD = r"[^\x20\x09-\x0D]+"


def on_one_machine(spark: SparkSession) -> bool:
    return bool(re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master))


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def has_files(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table made by materialise(), once nothing reads it any more."""
    for folder in {x.rpartition("/")[0] for x in df.inputFiles()}:
        remove_folder(df.sparkSession, folder)


def open_folder(folder: str) -> tuple[pafs.FileSystem, str]:
    """For tasks that read or write files of their own: a local or mounted folder, or a store that pyarrow knows."""
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of finished jobs: it does so some time after the driver's garbage is collected. On one machine they
    can wait."""
    for _ in range(0 if on_one_machine(spark) else 2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bytes_of(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Parts of batches, for callers that make Python objects of them: a batch of long texts or sets is large."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def table_batch(names: list[str], types: list[pa.DataType], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of an operator's own that df doesn't have; Spark compares them without case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        out.append(name)
    return out


SMALL = 200_000  # rows of two numbers that may be sent to every task, after they are counted


def few(rows: DataFrame) -> DataFrame:
    """rows of two numbers, sent to every task where they are counted to be few."""
    return F.broadcast(rows) if rows.count() <= SMALL else rows


def text_key(column: str):
    """64 bits of a text, which tell apart rows that repeat a doc_id or have none; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("")))


def pair_hash(*columns, seed: int = 0):
    """A seeded 64-bit order for sampling; the same on every run and engine restart."""
    return F.xxhash64(F.lit(seed), *columns)
