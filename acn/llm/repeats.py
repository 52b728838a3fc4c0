"""Which hashes of a document stand in another document too: an exchange of packed arrays, shared by the operators that look for repeats.

Each task gathers its documents' hashes in chunks and sends a chunk's distinct hashes to buckets by range, four bytes each. A hash that
several documents of a chunk hold goes once for all of them, so a hot hash sends as many entries as there are chunks. Buckets
return the documents whose hash came from another chunk too; the chunk joins them to its own names.

48 bits of a hash are sorted and 32 of them, with the bucket, are compared: a collision lets through a hash that stands in one
document only, and never holds one back. Callers compare what is let through by its contents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import has_files, new_path, table_batch

DOCUMENTS, HASHES = 60_000, 1_500_000  # in a chunk
SEVERAL = 0xFFFF  # in place of the document, where several of a chunk hold a hash
NAMED, KNOWN = -1, -2  # in place of the bucket
PACK = ["bucket", "chunk", "a", "b"]
PACK_TYPES = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
PACK_FIELDS = [T.StructField(n, t()) for n, t in zip(PACK, [T.LongType, T.LongType, T.BinaryType, T.BinaryType], strict=True)]
_U = np.uint64


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins, in sorted arrays that aren't empty."""
    fresh = np.ones(len(keys[0]), bool)
    fresh[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(fresh)


def pieces(cut: np.ndarray, n: int) -> list[tuple[int, int]]:
    return list(zip(cut.tolist(), [*cut[1:].tolist(), n], strict=True))


def split(bucket: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[list[bytes]]]:
    """Columns packed by bucket; nothing of nothing."""
    if not len(bucket):
        return bucket, [[] for _ in columns]
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    cut = runs(bucket)
    return bucket[cut], [[c[a:b].tobytes() for a, b in pieces(cut, len(bucket))] for c in columns]


def identity(h: np.ndarray, buckets: int) -> np.ndarray:
    """What is compared of 64-bit hashes: the bucket above, 32 bits below."""
    return ((((h >> _U(32)) * _U(buckets)) >> _U(32) << _U(32)) | (h >> _U(16) & _U(0xFFFFFFFF))).astype(np.int64)


def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows sorted by the first column, a list for each of its values."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
            if row[0] != key:
                if rows:
                    yield key, rows
                key, rows = row[0], []
            rows.append(row[1:])
    if rows:
        yield key, rows


class Chunks:
    """Gathers a task's hashes; packs() are columns of PACK. Documents without hashes need no row of their chunk."""

    def __init__(self, buckets: int):
        self.buckets, self.number = buckets, TaskContext.get().partitionId() << 24
        self._empty()

    def _empty(self) -> None:
        self.ids, self.keys, self.needs, self.held, self.size = [], [], [], [], 0

    def full(self, documents: int) -> bool:
        """Whether so many more documents ask for packs() first."""
        return len(self.ids) + documents > DOCUMENTS or self.size > HASHES

    def add(self, ids: list[int], keys: list[int], needs: list[int], h: np.ndarray, own: np.ndarray) -> None:
        """Documents (doc_id, key, the number of repeated hashes they need to matter), and hashes with the place of their document among them."""
        if len(h):
            self.held.append(h & ~_U(0xFFFF) | (own + len(self.ids)).astype(_U))
            self.size += len(h)
        self.ids += ids
        self.keys += keys
        self.needs += needs

    def packs(self) -> list | None:
        if not self.size:
            self._empty()
            return None
        both = np.sort(np.concatenate(self.held))
        both = both[np.r_[True, both[1:] != both[:-1]]]
        h, own = both & ~_U(0xFFFF), (both & _U(0xFFFF)).astype(np.uint16)
        cut = runs(h)
        count = np.diff(np.r_[cut, len(h)])
        known = np.repeat(count > 1, count)
        named = identity(h[cut], self.buckets)
        where, (low, doc) = split(named >> 32, named.astype(np.uint32), np.where(count > 1, np.uint16(SEVERAL), own[cut]))
        names = np.array([self.keys, self.ids, self.needs], np.int64)
        columns = [[*where.tolist(), NAMED, KNOWN], [self.number] * (len(where) + 2), [*low, names.tobytes(), identity(h[known], self.buckets).tobytes()], [*doc, b"", own[known].tobytes()]]
        self.number += 1
        self._empty()
        return columns


def _parted(batches: Iterator[pa.RecordBatch], column: int, through: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The packs; rows whose column is null or negative are put aside whole."""
    for batch in batches:
        aside = pc.fill_null(pc.less(batch.column(column), 0), True)
        if pc.any(aside).as_py():
            through.append(batch.filter(aside))
            batch = batch.filter(pc.invert(aside))
        yield batch.select(PACK)


def _repeated_batches(names: list[str], types: list[pa.DataType]):
    """Rows sorted by bucket; packs become rows (chunk, bucket, a: whole identities, b) of the documents whose hash stands in another
    chunk, all other rows pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        through: list[pa.RecordBatch] = []
        for bucket, rows in by_key(_parted(batches, 0, through)):
            yield from through
            through.clear()
            low = np.concatenate([np.frombuffer(x[1], np.uint32) for x in rows])
            own = np.concatenate([np.frombuffer(x[2], np.uint16).astype(np.int64) + (x[0] << 16) for x in rows])
            order = np.argsort(low)
            low, own = low[order], own[order]
            cut = runs(low)
            count = np.diff(np.r_[cut, len(low)])
            stays = np.repeat(count > 1, count) & (own & 0xFFFF != SEVERAL)
            if stays.any():
                chunk, (docs, hashes) = split(own[stays] >> 16, (own[stays] & 0xFFFF).astype(np.uint16), low[stays].astype(np.int64) + (bucket << 32))
                m = len(chunk)
                yield table_batch([*PACK, *names], [*PACK_TYPES, *types], [[bucket] * m, chunk, hashes, docs, *[[None] * m for _ in names]])
        yield from through

    return run


def _document_batches(names: list[str], types: list[pa.DataType]):
    """Rows sorted by chunk -> the documents' rows, hashes null, and (doc_id, key, hashes in ascending order) of those with as many repeated
    hashes as they need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        through: list[pa.RecordBatch] = []

        def passed() -> Iterator[pa.RecordBatch]:
            for batch in through:
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.nulls(batch.num_rows, pa.binary())], [*names, "hashes"])
            through.clear()

        by_chunk = (b.select(["chunk", "bucket", "a", "b"]) for b in _parted(batches, 1, through))
        for _, rows in by_key(by_chunk):
            yield from passed()
            keys, ids, needs = np.frombuffer(next(x[1] for x in rows if x[0] == NAMED), np.int64).reshape(3, -1)
            found = [x for x in rows if x[0] != NAMED]
            own = np.concatenate([np.frombuffer(x[2], np.uint16) for x in found]).astype(np.int64)
            hashes = np.concatenate([np.frombuffer(x[1], np.int64) for x in found])
            enough = (np.bincount(own, minlength=len(ids)) >= needs)[own]
            own, hashes = own[enough], hashes[enough]
            order = np.lexsort((hashes, own))
            where, (packed,) = split(own[order], hashes[order])
            if m := len(where):
                yield table_batch([*names, "hashes"], [*types, pa.binary()], [ids[where], keys[where], *[[None] * m for _ in names[2:]], packed])
        yield from passed()

    return run


def repeated_hashes(rows: DataFrame, fields: list[tuple[str, T.DataType, pa.DataType]], name: str) -> tuple[DataFrame, DataFrame]:
    """Rows of PACK and the named fields (doc_id, key and more), each either a pack or a document -> (documents, repeated): the documents'
    fields; and doc_id, key, hashes (identities, in ascending order) of documents with as many repeated hashes as they need."""
    names, kinds, types = (list(x) for x in zip(*fields, strict=True))
    own = [T.StructField(n, t) for n, t in zip(names, kinds, strict=True)]
    ordered = rows.select(*PACK, *names)
    each = F.xxhash64("doc_id", "key")  # copies of one text spread by doc_id
    dealt = ordered.repartition(F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(F.coalesce("chunk", each))).sortWithinPartitions("bucket")
    repeated = dealt.mapInArrow(_repeated_batches(names, types), T.StructType([*PACK_FIELDS, *own]))
    together = repeated.repartition(F.coalesce("chunk", each)).sortWithinPartitions("chunk", "bucket")
    found = together.mapInArrow(_document_batches(names, types), T.StructType([*own, T.StructField("hashes", T.BinaryType())]))
    path = new_path(rows.sparkSession, name)
    found.withColumn("kind", F.col("hashes").isNotNull().cast("int")).write.partitionBy("kind").parquet(path)
    read = lambda kind, schema: rows.sparkSession.read.schema(schema).parquet(f"{path}/kind={kind}") if has_files(rows.sparkSession, f"{path}/kind={kind}") else rows.sparkSession.createDataFrame([], schema)
    return read(0, T.StructType(own)), read(1, T.StructType([*own[:2], T.StructField("hashes", T.BinaryType())]))
