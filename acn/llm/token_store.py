"""Token-id output as a content-addressed store.

A store is a folder of three Parquet tables:
* chunks (digest, n_tokens, width, ids): each distinct chunk once, under the SHA-256 of its bytes;
* recipes (uid, seq, digest): which chunks, in order, make each document;
* manifest (position, doc_id, uid, start, n_tokens, n_chunks, root) in ascending doc_id order, written by a range partitioning:
  root is the Merkle root over the document's chunk digests, start the number of ids of all documents before it;
* nodes (level, node, digest): the Merkle tree above the document roots, FAN children a node, up to one root.

Ids are cut where a rolling hash over the last 16 of them has MASK's bits set, at least MIN and at most MAX ids apart, so equal
passages give equal chunks wherever they stand. Ids take two bytes while the vocabulary has at most 65,536 of them, else four.

Words between white space tokenise independently under these tokenizers (they lower-case), so each worker keeps the ids of words
it has seen and puts a batch of texts together from them; new words are encoded in one go, parted by a control character. Texts
that hold a special token or that character are encoded whole. Where the tokenizer leaves words of lower-case ASCII letters in one
piece and unchanged, as these do (a few are tried when it is loaded), its model is asked directly for such words.

Defined results: null text is empty and yields the end id alone; null doc_id sorts first; rows of one doc_id are documents of
their own, in the order of their contents; an empty table gives an empty store; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import discard, materialise, new_path, release, table_batch

MASK, MIN, MAX, SPAN = 0x1FF, 64, 4096, 16
FAN = 256
CACHE = 700_000
MARK = "\x01"
TAIL = ".,;:!?"
PROBES = [*"abcdefghijklmnopqrstuvwxyz", "the", "lazydogs", "quickbrownfoxesjumped", "zzxqkvjwpyh", "information", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"]


class WordEncoder:
    """Ids of texts as little-endian bytes, by way of a cache of words that is emptied when full."""

    def __init__(self, path: str, width: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.type = Tokenizer.from_file(path), np.dtype(f"<u{width}")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        mark = self._ids(MARK)
        self.mark = mark[0] if len(mark) == 1 else None
        self.words: dict[str, bytes] = {}
        self.model, self.kind = self.tokenizer.model, "H" if width == 2 else "I"
        self.plain = all(self._ids(w) == [x.id for x in self.model.tokenize(w)] for w in PROBES)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, words: list[str]) -> None:
        if self.plain:
            letters = [w for w in words if w.isascii() and w.isalpha()]
            split = self.model.tokenize
            self.words.update((w, array(self.kind, [x.id for x in split(w)]).tobytes()) for w in letters)
            words = [w for w in words if not (w.isascii() and w.isalpha())]
        for i in range(0, len(words), 64):
            some = words[i : i + 64]
            ids = np.array(self.tokenizer.encode_batch_fast([f" {MARK} ".join(some)], add_special_tokens=False)[0].ids, self.type)
            ends = np.flatnonzero(ids == self.mark)
            data, size = ids.tobytes(), self.type.itemsize
            at = [0, *((ends + 1) * size).tolist()]
            to = [*(ends * size).tolist(), len(data)]
            self.words.update(zip(some, map(data.__getitem__, map(slice, at, to)), strict=True))

    def _known(self, words: list[str]) -> None:
        """Learns the ids of words not seen before."""
        if len(self.words) > CACHE:
            self.words = {w: x for w in words if (x := self.words.get(w)) is not None}
        new = [w for w in words if w not in self.words]
        # ASCII letters and the marks behind them are tokens apart; other letters may change when lower-cased and take a mark along
        ends = {w: core for w in new if (core := w.rstrip(TAIL)) != w and core.isascii() and core.isalpha()}
        if fresh := {ends.get(w, w) for w in new}.union(w[len(core) :] for w, core in ends.items()).difference(self.words):
            self._learn(list(fresh))
        self.words.update((w, self.words[core] + self.words[w[len(core) :]]) for w, core in ends.items())

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, end_id behind each, and where each begins (with the end of the last)."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = pc.match_substring_regex(texts, "|".join(map(re.escape, [MARK, *self.special]))) if self.mark is not None else pa.array([True] * len(texts))
        words = pc.ascii_split_whitespace(pc.ascii_lower(pc.if_else(odd, "", texts)))  # it lower-cases all letters itself
        coded = words.flatten().dictionary_encode()
        known = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # many times as fast as to_pylist()
        self._known(known)
        wholes = [np.array(self._ids(x), self.type).tobytes() for x in texts.filter(odd).to_pylist()]
        pool = [*map(self.words.__getitem__, known), np.array([end_id], self.type).tobytes(), *wholes]
        lengths = np.fromiter(map(len, pool), np.int64, len(pool)) // self.type.itemsize
        starts = np.r_[0, lengths.cumsum()]
        # a text's words, for an odd one its whole, then the end id
        counts = np.diff(words.offsets.to_numpy())
        is_odd = odd.to_numpy(zero_copy_only=False)
        at = np.r_[0, counts.cumsum()]
        order = np.insert(coded.indices.to_numpy().astype(np.int64), at[1:], len(known))
        ends = at[1:] + np.arange(len(counts))
        if wholes:
            order[(at[:-1] + np.arange(len(counts)))[is_odd]] = len(known) + 1 + np.arange(len(wholes))  # in place of the one empty word
        sizes = lengths[order]
        before = np.r_[0, sizes.cumsum()]
        ids = np.frombuffer(b"".join(pool), self.type)[np.repeat(starts[order] - before[:-1], sizes) + np.arange(before[-1])]
        return ids, np.r_[0, before[ends + 1]]


_encoders: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, width: int) -> WordEncoder:
    """One for each worker process."""
    if (path, width) not in _encoders:
        _encoders[path, width] = WordEncoder(path, width)
    return _encoders[path, width]


def cut_marks(ids: np.ndarray) -> np.ndarray:
    """Ends of possible chunks: positions after an id where the hash of the last SPAN ids has MASK's bits set."""
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    factor, step = 0xBF58476D1CE4E5B9, 1
    while step < SPAN:
        more = h.copy()
        more[step:] += h[:-step] * np.uint64(factor)
        h, factor, step = more, factor * factor % (1 << 64), 2 * step
    return np.flatnonzero((h >> np.uint64(40)) & np.uint64(MASK) == MASK) + 1


def chunk_ends(marks: np.ndarray, n: int) -> list[int]:
    """Ends of the chunks of a document of n ids. Marks closer than MIN to the last end are passed over."""
    out, last = [], 0
    for m in [*marks.tolist(), n]:
        while m - last > MAX:
            last += MAX
            out.append(last)
        if m - last >= MIN or m == n:
            if m > last:
                out.append(m)
            last = m
    return out


def merkle_root(digests: list[bytes]) -> bytes:
    """Binary tree; an odd node is carried up unchanged."""
    while len(digests) > 1:
        digests = [hashlib.sha256(b"".join(digests[i : i + 2])).digest() if i + 1 < len(digests) else digests[i] for i in range(0, len(digests), 2)]
    return digests[0] if digests else hashlib.sha256(b"").digest()


_PIECES = T.StructType([T.StructField("uid", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("seq", T.IntegerType()), T.StructField("digest", T.BinaryType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("n_total", T.LongType()), T.StructField("n_chunks", T.IntegerType()), T.StructField("root", T.BinaryType()), T.StructField("ids", T.BinaryType())])
_PIECE_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]


def _cut(path: str, width: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, uid = encoder(path, width), TaskContext.get().partitionId() << 40
        sent: set[bytes] = set()
        for batch in batches:
            for low in range(0, batch.num_rows, 2500):
                part = batch.slice(low, 2500)
                ids, begin = coder.encode(part.column(1), end_id)
                whole = memoryview(ids.tobytes())
                marks = cut_marks(ids)
                first = np.searchsorted(marks, begin, "right")
                rows: list[tuple] = []
                for k, (doc_id, at, to) in enumerate(zip(part.column(0).to_pylist(), begin[:-1].tolist(), begin[1:].tolist(), strict=True)):
                    uid, n = uid + 1, to - at
                    ends = chunk_ends(marks[first[k] : first[k + 1]] - at, n)
                    chunks = [bytes(whole[(at + a) * width : (at + b) * width]) for a, b in zip([0, *ends], ends, strict=False)]
                    digests = [hashlib.sha256(c).digest() for c in chunks]
                    root = merkle_root(digests)
                    for seq, (digest, chunk) in enumerate(zip(digests, chunks, strict=True)):
                        rows.append((uid, doc_id, seq, digest, len(chunk) // width, n, len(chunks), root, None if digest in sent else chunk))
                        if len(sent) > 200_000:
                            sent.clear()
                        sent.add(digest)
                if rows:
                    yield table_batch(_PIECES.names, _PIECE_TYPES, list(zip(*rows, strict=True)))

    return run


def write_store(docs: DataFrame, tokenizer: str, end_id: int = 1, vocabulary: int = 1 << 16, path: str | None = None) -> str:
    """Encodes whole texts, appends end_id to each and writes the store; returns its folder."""
    spark = docs.sparkSession
    path = path or new_path(spark, "token-store")
    width = 2 if vocabulary <= 1 << 16 else 4
    pieces = materialise(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_cut(tokenizer, width, end_id), _PIECES), "token-pieces", "zstd")
    (
        pieces.filter(F.col("ids").isNotNull()).groupBy("digest").agg(F.first("n_tokens").alias("n_tokens"), F.first("ids").alias("ids"))
        .select("digest", "n_tokens", F.lit(width).alias("width"), "ids").write.option("compression", "zstd").parquet(f"{path}/chunks")
    )
    pieces.select("uid", "seq", "digest").write.parquet(f"{path}/recipes")
    release(spark)
    ranged = pieces.filter("seq = 0").select("doc_id", "root", "uid", "n_total", "n_chunks").repartitionByRange(F.col("doc_id"), F.col("root"))
    order = ["doc_id", "root", "uid"]
    dealt = materialise(ranged.withColumn("part", F.spark_partition_id()), "token-order")
    sums = dealt.groupBy("part").agg(F.sum("n_total").alias("ids"), F.count("*").alias("docs"))  # a row per partition
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("part", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("ids0"), F.coalesce(F.sum("docs").over(earlier), F.lit(0)).alias("docs0"))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    manifest = dealt.join(offsets, "part").select(
        (F.col("docs0") + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1).alias("position"), "doc_id", "uid",
        (F.col("ids0") + F.coalesce(F.sum("n_total").over(inside), F.lit(0))).alias("start"), F.col("n_total").alias("n_tokens"), "n_chunks", "root",
    )
    manifest.write.parquet(f"{path}/manifest")
    discard(pieces)
    release(spark)
    level, nodes = 0, spark.read.parquet(f"{path}/manifest").select(F.col("position").alias("node"), F.col("root").alias("digest"))
    while True:
        children = F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda x: F.hex(x["digest"]))
        up = nodes.groupBy(F.floor(F.col("node") / FAN).alias("up")).agg(F.unhex(F.sha2(F.concat_ws("", children), 256)).alias("digest"))
        level += 1
        up.select(F.lit(level).alias("level"), F.col("up").alias("node"), "digest").write.mode("append").parquet(f"{path}/nodes")
        nodes = spark.read.parquet(f"{path}/nodes").filter(F.col("level") == level).select("node", "digest")
        if nodes.limit(2).count() < 2:
            return path


_DOCS = T.StructType([T.StructField("position", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("whole", T.BooleanType())])
_DOC_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]


def _join_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (uid, seq), the manifest's first: each document's ids as little-endian 32-bit integers, held against its root."""
    own, parts, digests, out, size = None, [], [], [], 0

    def close() -> None:
        nonlocal size
        if own is not None:
            position, doc_id, start, n_tokens, root = own
            ids = b"".join(parts)
            size += len(ids)
            out.append((position, doc_id, start, n_tokens, ids, merkle_root(digests) == root and len(ids) == 4 * n_tokens))

    for batch in batches:
        for seq, width, ids, *manifest in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
            if seq < 0:
                close()
                own, parts, digests = manifest, [], []
                if size > 8 << 20:
                    yield table_batch(_DOCS.names, _DOC_TYPES, list(zip(*out, strict=True)))
                    out, size = [], 0
                continue
            parts.append(np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes())
            digests.append(hashlib.sha256(ids).digest())
    close()
    if out:
        yield table_batch(_DOCS.names, _DOC_TYPES, list(zip(*out, strict=True)))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """position, doc_id, start, n_tokens, ids (little-endian 32-bit integers) and whole, of each document in the store: whole is false
    where the digests of the chunks read don't give the manifest's Merkle root, or the number of ids differs."""
    table = {x: spark.read.parquet(f"{path}/{x}") for x in ("chunks", "recipes", "manifest")}
    rows = table["recipes"].join(table["chunks"].select("digest", "width", "ids"), "digest").select("uid", "seq", "width", "ids")
    heads = table["manifest"].select("uid", F.lit(-1).alias("seq"), "position", "doc_id", "start", "n_tokens", "root")
    columns = ["seq", "width", "ids", "position", "doc_id", "start", "n_tokens", "root"]
    every = rows.unionByName(heads, allowMissingColumns=True)
    return every.repartition("uid").sortWithinPartitions("uid", "seq").select(*columns).mapInArrow(_join_chunks, _DOCS)


def store_digest(read: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of what read_store() gives; a document that isn't whole stops the query."""
    ids = F.when(F.col("whole"), F.col("ids")).otherwise(F.raise_error(F.lit("a document doesn't match its manifest")).cast("binary"))
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32(ids).alias("ids_crc32"))
