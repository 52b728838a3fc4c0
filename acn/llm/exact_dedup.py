"""Exact dedup with Patricia-trie owners.

Texts are equal when identical after deleting the six ASCII white-space characters. Each scan task inserts the full byte
strings of its rows into a compressed radix trie; a terminal keeps the row that stays (most code points in the original
text, then smallest doc_id) and the rows that share it, so one text leaves a task once, however many copies it saw there. A
trie above its budget of memory, nodes and rows counted, spills its largest subtree: the terminals below one first byte are
written out and dropped. A text whose length and hash no other terminal has is a group of its own; the others meet in
partitions by length and content hash, sorted so that equal keys are neighbours, where a trie per key finds the owner of each
byte string. Members learn their owner by a join on their task's terminal, never through one group.

Defined results: null counts as empty; repeated rows of the document that stays are flagged alike by owners(), and keep_first()
keeps one of them; rows equal in code points and doc_id are told apart by their text's hash; an empty table gives an empty one;
further columns are ignored by owners() and kept by keep_first().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import WHITE, bytes_of, few, fresh_names, materialise, text_key

TRIE_BYTES = 192 << 20
NODE_BYTES, ROW_BYTES = 420, 160  # what a node, and a row at a terminal, take in memory beside the bytes of the text
OUT_BYTES = 8 << 20


class _Node:
    __slots__ = ("children", "edge", "value")

    def __init__(self, edge: bytes, value=None):
        self.edge, self.value, self.children = edge, value, {}


class RadixTrie:
    """Byte strings in a compressed trie; every edge is the longest unbranched run of bytes."""

    def __init__(self):
        self.root, self.held, self.below = _Node(b""), 0, {}

    def at(self, key: bytes) -> _Node:
        """The terminal of key, made if it isn't there."""
        node, i, n = self.root, 0, len(key)
        while i < n:
            child = node.children.get(key[i])
            if child is None:
                child = node.children[key[i]] = _Node(key[i:])
                self.grown(key, n - i + NODE_BYTES)
                return child
            edge = child.edge
            if key.startswith(edge, i):
                node, i = child, i + len(edge)
                continue
            low, high = 1, min(len(edge), n - i)  # the common run ends between them
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if edge[:mid] == key[i : i + mid] else (low, mid - 1)
            fork = node.children[key[i]] = _Node(edge[:low])
            child.edge = edge[low:]
            fork.children[child.edge[0]] = child
            self.grown(key, NODE_BYTES)
            node, i = fork, i + low
        return node

    def grown(self, key: bytes, n: int) -> None:
        """Counts n more bytes under key's first byte; the empty key is counted at the root."""
        first = key[0] if key else None
        self.held += n
        self.below[first] = self.below.get(first, 0) + n

    def terminals(self, node: _Node, prefix: tuple[bytes, ...] = ()) -> Iterator[tuple[bytes, object]]:
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            prefix = (*prefix, node.edge)
            if node.value is not None:
                yield b"".join(prefix), node.value
            stack.extend((x, prefix) for x in node.children.values())

    def spill(self) -> Iterator[tuple[bytes, object]]:
        """Yields and drops the subtree of the first byte that holds most."""
        first = max(self.below, key=self.below.get)
        self.held -= self.below.pop(first)
        if first is None:
            value, self.root.value = self.root.value, None
            yield b"", value
        else:
            yield from self.terminals(self.root.children.pop(first))


def _rank(code_points: int, doc_id: int | None, key: int) -> tuple:
    return -code_points, doc_id is None, doc_id or 0, key


_LONG = T.LongType()
_LOCAL = T.StructType([*(T.StructField(n, _LONG) for n in ("doc_id", "key", "owner", "n_bytes", "hash")), T.StructField("sha256", T.StringType()), *(T.StructField(n, _LONG) for n in ("best_cp", "best_id", "best_key", "members")), T.StructField("bytes", T.BinaryType())])
_LOCAL_TYPES = [*[pa.int64()] * 5, pa.string(), *[pa.int64()] * 4, pa.binary()]


def _local_owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, key) -> a row per document; the first of each terminal carries the text and the best row of the terminal."""
    number = TaskContext.get().partitionId() << 40
    trie, rows, size = RadixTrie(), [], 0
    white = WHITE.encode()

    def flush() -> pa.RecordBatch:
        nonlocal rows, size
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _LOCAL_TYPES, strict=True)], _LOCAL.names)
        rows, size = [], 0
        return batch

    def take(terminals) -> Iterator[pa.RecordBatch]:
        nonlocal number, size
        for text, (best, members) in terminals:
            number += 1
            digest = hashlib.sha256(text).digest()
            rows.append((*members[0], number, len(text), int.from_bytes(digest[:8], "big", signed=True), digest.hex(), -best[0], None if best[1] else best[2], best[3], len(members), text))
            size += len(text) + 64 * len(members)
            for at in range(1, len(members), 50_000):
                rows.extend((*m, number, *[None] * 8) for m in members[at : at + 50_000])
                if len(rows) > 50_000:
                    yield flush()
            if size > OUT_BYTES and rows:
                yield flush()

    for batch in batches:
        for doc_id, text, key in zip(batch.column(0).to_pylist(), bytes_of(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            text = text or b""
            bare = text.translate(None, white)
            node = trie.at(bare)
            best = _rank(len(text.decode("utf-8", "replace")), doc_id, key)
            trie.grown(bare, ROW_BYTES)
            if node.value is None:
                node.value = [best, [(doc_id, key)]]
            else:
                node.value[0] = min(node.value[0], best)
                node.value[1].append((doc_id, key))
            while trie.held > TRIE_BYTES:
                yield from take(trie.spill())
    yield from take(trie.terminals(trie.root))
    if rows:
        yield flush()


_OWNER = T.StructType([T.StructField("owner", _LONG), T.StructField("keep_id", _LONG), T.StructField("keep_key", _LONG), T.StructField("group_size", _LONG), T.StructField("text_sha256", T.StringType()), T.StructField("keeper", _LONG)])
_OWNER_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]


def _global_owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (n_bytes, hash): a trie for each key; out: each local owner's group."""
    key, trie = None, RadixTrie()
    out: list[tuple] = []

    def close() -> None:
        for _, (best, owners, members, sha) in trie.terminals(trie.root):
            keep_id = None if best[1] else best[2]
            out.extend((o, keep_id, best[3], members, sha, best[4]) for o in owners)

    def batch_of() -> pa.RecordBatch:
        nonlocal out
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _OWNER_TYPES, strict=True)], _OWNER.names)
        out = []
        return batch

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns - 1)]
        for owner, n_bytes, hashed, sha, cp, best_id, best_key, members, text in zip(*columns, bytes_of(batch.column(batch.num_columns - 1)), strict=True):
            if (n_bytes, hashed) != key:
                close()
                key, trie = (n_bytes, hashed), RadixTrie()
                if len(out) > 20_000:
                    yield batch_of()
            node, best = trie.at(text), (*_rank(cp, best_id, best_key), owner)
            if node.value is None:
                node.value = [best, [owner], members, sha]
            else:
                node.value[0] = min(node.value[0], best)
                node.value[1].append(owner)
                node.value[2] += members
    close()
    if out:
        yield batch_of()


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(local, groups): local rows of _LOCAL, and each local owner's row of _OWNER."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key("text").alias("key"))
    local = materialise(rows.mapInArrow(_local_owners, _LOCAL), "dedup-local")
    heads = local.filter(F.col("bytes").isNotNull()).select("owner", "n_bytes", "hash", "sha256", "best_cp", "best_id", "best_key", "members", "bytes")
    ends = materialise(heads.groupBy("n_bytes", "hash").agg(F.count("*").alias("n")).filter("n > 1").select("n_bytes", "hash"), "dedup-keys")
    several = few(ends)
    met = heads.join(several, ["n_bytes", "hash"], "left_semi").select(*heads.columns).repartition("n_bytes", "hash").sortWithinPartitions("n_bytes", "hash").mapInArrow(_global_owners, _OWNER)
    alone = heads.join(several, ["n_bytes", "hash"], "left_anti").select("owner", F.col("best_id").alias("keep_id"), F.col("best_key").alias("keep_key"), F.col("members").alias("group_size"), F.col("sha256").alias("text_sha256"), F.col("owner").alias("keeper"))
    return local, met.union(alone)


def owners(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per input row, the dropped ones too."""
    local, groups = _grouped(docs)
    placed = local.select("doc_id", "key", "owner").join(groups, "owner")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("key") == F.col("keep_key"))
    return placed.select("doc_id", "keep_id", "group_size", stays.alias("kept"), "text_sha256")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows with equal doc_id and text, one."""
    own_id, own_key, stays, place = fresh_names(docs, "own_id", "own_key", "stays", "place")
    local, groups = _grouped(docs)
    members = local.select("doc_id", "key", "owner").join(groups.filter("group_size > 1"), "owner")
    first = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("key") == F.col("keep_key"))
    copied = materialise(members.groupBy(F.col("doc_id").alias(own_id), F.col("key").alias(own_key)).agg(F.max(first).alias(stays)), "dedup-copies")
    joined = docs.join(few(copied), F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)) & (text_key("text") == F.col(own_key)), "left")
    one = Window.partitionBy(own_id, own_key).orderBy(stays)  # rows of equal doc_id and text
    again = joined.filter(F.col(stays)).withColumn(place, F.row_number().over(one)).filter(F.col(place) == 1)
    return joined.filter(F.col(stays).isNull()).select(*docs.columns).union(again.select(*docs.columns))


ORACLE = r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
n as (select doc_id, length(t) cp, sha256(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) h from d)
select doc_id, first_value(doc_id) over (partition by h order by cp desc, doc_id) keep_id, count(*) over (partition by h) group_size,
       row_number() over (partition by h order by cp desc, doc_id) = 1 kept, h text_sha256 from n
"""
