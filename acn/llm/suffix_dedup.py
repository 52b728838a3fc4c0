"""Suffix-array dedup: removes every byte that lies in a 50-byte string which also starts in a document of smaller doc_id.

Column-wise construction over all suffixes of a corpus takes as many rounds as its longest text has bytes. Only strings of LENGTH
bytes matter, so the collection that is built column by column is one of short contexts, dealt by content:

1. Winnowing marks anchors: in every LENGTH-byte string, the GRAM-byte grams of least hash among its SLIDE grams. Equal strings
   have equal anchors at equal places, so a string that repeats shows as an anchor that repeats.
2. Anchors go to hash buckets as packed arrays; those that stand in one document only are dropped. An anchor that several
   documents of a chunk hold goes once for all of them. Hashes only choose here: a collision lets more anchors through.
3. Documents with anchors left give, for each, its context: the anchor's bytes with SIDE bytes before and behind. A chunk of
   texts sends each distinct context once, with the places of its least doc_id alone: all other places in the chunk are
   covered by that document, wholly, and are turned into spans at once. So what a hot anchor sends grows with the chunks.
4. Each task lays the contexts of its buckets down column-wise in a sequential file in the shared folder and builds their
   collection: a round inserts one symbol per context in front of its suffix. The symbols of the column, read in the order of
   the suffixes behind them, are the round's part of the collection's Burrows-Wheeler transform; a stable counting sort of it
   gives the order of the new suffixes, and range minima of the common prefixes give theirs. The orders of the columns are
   not merged into one: equal strings have their anchors at equal places, so a suffix finds its like in its own column.
   Neighbours whose common prefix reaches LENGTH bytes hold the same string; the least doc_id of each such run is its first
   owner, and places of larger doc_id are marked.
5. Spans come together by document, and only documents with spans are cut.

Nothing is sampled, and strings are compared byte by byte. A document is told by its doc_id and 64 bits of its text: two different
texts of one doc_id share them with odds of 1 in 2^64, and no others can be mixed up.

Defined results: null text is empty; texts under LENGTH bytes never change; rows of equal doc_id don't remove each
other's bytes; null doc_id counts as the largest; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import bytes_of, discard, materialise, new_path, open_folder, release, remove_folder, table_batch, text_key
from .repeats import DOCUMENTS, PACK, PACK_FIELDS, PACK_TYPES, Chunks, by_key, identity, pieces, repeated_hashes, runs

LENGTH, GRAM, SLIDE, SIDE = 50, 26, 25, 24  # GRAM + SLIDE - 1 = LENGTH = GRAM + SIDE
WIDTH, ROW = SIDE + GRAM + SIDE, 80  # bytes of a context, and of its row in memory
PER_BUCKET = 50_000
PORTION = 300_000  # contexts in one collection, but for a bucket that has more
BLOCK = 1 << 19  # bytes of text hashed at a time
LAST = (1 << 63) - 1
NO_BYTE = 0xFF  # not in UTF-8; stands beyond a text's ends
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_POWER = {m: pow(_BASE, m, 1 << 64) for m in (1, 2, 4, 8)}


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all GRAM-byte grams, by doubling: 2, 4, 8, 16, then 16 + 8 + 2."""
    h = {1: (data.astype(_U) + _U(1)) * _U(0xD6E8FEB86659FD93)}
    for m in (1, 2, 4, 8):
        h[2 * m] = h[m][:-m] * _U(_POWER[m]) + h[m][m:]
    n = len(data) - GRAM + 1
    out = (h[16][:n] * _U(_POWER[8]) + h[8][16 : 16 + n]) * _U(_POWER[2]) + h[2][24 : 24 + n]
    out ^= out >> _U(31)
    out *= _U(0xBF58476D1CE4E5B9)
    out ^= out >> _U(29)
    return out


def _slide(x: np.ndarray, better) -> np.ndarray:
    """better over every SLIDE consecutive values."""
    for m in (1, 2, 4, 8):
        x = better(x[:-m], x[m:])
    return better(x[: -(SLIDE - 16)], x[SLIDE - 16 :])


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the grams that are least in some LENGTH-byte string; ties all count."""
    if len(data) < LENGTH:
        return np.empty(0, np.int64), np.empty(0, _U)
    h = gram_hashes(data)
    least = _slide(h, np.minimum)
    pad = np.zeros(SLIDE - 1, _U)
    at = np.flatnonzero(_slide(np.concatenate([pad, least, pad]), np.maximum) == h)
    return at, h[at]


def _blocks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    start, size = 0, 0
    for i, x in enumerate(texts):
        size += len(x)
        if size >= BLOCK or i == len(texts) - 1:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0


def block_anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, position in the joined block, hash) of the anchors of several texts, the block's bytes and the texts' starts."""
    joined = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
    at, h = anchors(joined)
    text = np.searchsorted(starts, at, "right") - 1
    inside = (at + GRAM <= starts[text + 1]) & (starts[text + 1] - starts[text] >= LENGTH)
    return text[inside], at[inside], h[inside], joined, starts


_NAMES, _TYPES = ["doc_id", "key", "n_bytes", "sha256"], [pa.int64(), pa.int64(), pa.int64(), pa.string()]
_KINDS = [T.LongType(), T.LongType(), T.LongType(), T.StringType()]
_SCHEMA = T.StructType([*(T.StructField(n, t) for n, t in zip(_NAMES, _KINDS, strict=True)), *PACK_FIELDS])


def _anchor_batches(buckets: int):
    """(doc_id, text, key) -> a row per document, and packs of anchors."""
    names, types = [*_NAMES, *PACK], [*_TYPES, *PACK_TYPES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks(buckets)

        def flushed() -> Iterator[pa.RecordBatch]:
            if columns := chunks.packs():
                yield table_batch(names, types, [*[[None] * len(columns[0])] * 4, *columns])

        for batch in batches:
            doc_ids = [LAST if x is None else x for x in batch.column(0).to_pylist()]
            texts = [x or b"" for x in bytes_of(batch.column(1))]
            own = batch.column(2).to_pylist()
            m = batch.num_rows
            if m:
                yield table_batch(names, types, [batch.column(0), own, [len(x) for x in texts], [hashlib.sha256(x).hexdigest() for x in texts], *[[None] * m] * 4])
            for start, some in _blocks(texts):
                for a in range(0, len(some), DOCUMENTS):
                    part = some[a : a + DOCUMENTS]
                    if chunks.full(len(part)):
                        yield from flushed()
                    text, _, h, _, _ = block_anchors(part)
                    at = slice(start + a, start + a + len(part))
                    chunks.add(doc_ids[at], own[at], [1] * len(part), h, text)
        yield from flushed()

    return run


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays, column by column, with entropy coding: contexts are text without repeats, which the shuffle's own codec can't shrink."""
    data = b"".join(x.tobytes() for x in arrays)
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


_PLACE = np.dtype([("context", "<u4"), ("doc_id", "<i8"), ("key", "<i8"), ("at", "<u4")])
_SPAN = np.dtype([("doc_id", "<i8"), ("key", "<i8"), ("start", "<u4"), ("end", "<u4")])


def unpacked(data: bytes, n: int, kind: np.dtype) -> np.ndarray:
    """n records of a structured type, packed column by column."""
    raw, at, out = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True), 0, np.empty(n, kind)
    for name in kind.names:
        out[name] = np.frombuffer(raw, kind[name], n, at)
        at += n * kind[name].itemsize
    return out


def packed_records(x: np.ndarray) -> bytes:
    return packed(*(x[name] for name in x.dtype.names))


def unpacked_contexts(data: bytes, n: int) -> np.ndarray:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    out = np.zeros((n, ROW), np.uint8)
    out[:, :WIDTH] = np.frombuffer(raw, np.uint8).reshape(n, WIDTH)
    return out


def _fingerprints(rows: np.ndarray) -> np.ndarray:
    words = np.ascontiguousarray(rows).view(_U)
    out = np.zeros(len(rows), _U)
    for i in range(words.shape[1]):
        out = (out ^ words[:, i]) * _U(0x9FB21C651E98DF25)
        out ^= out >> _U(32)
    return out


def distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, same): the first place of each distinct row of bytes, and for each row its number among them. Rows are brought together by
    64 bits and then compared byte by byte; where the 64 bits mislead, by their bytes."""
    _, first, same = np.unique(_fingerprints(rows), return_index=True, return_inverse=True)
    words = np.ascontiguousarray(rows).view(_U)
    if not (words[first][same] == words).all():
        _, first, same = np.unique(np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").ravel(), return_index=True, return_inverse=True)
    return first, same


def merged_spans(spans: np.ndarray) -> np.ndarray:
    """Maximal spans: those of one document that overlap or touch are one."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["start"], spans["key"], spans["doc_id"]))]
    number = np.zeros(len(spans), np.int64)
    number[runs(spans["doc_id"], spans["key"])] = 1
    number = np.cumsum(number) << 32
    reach = np.maximum.accumulate(number + spans["end"])
    cut = np.flatnonzero(np.r_[True, number[1:] + spans["start"][1:] > reach[:-1]])
    out = spans[cut]
    out["end"] = reach[np.r_[cut[1:], len(spans)] - 1] & 0xFFFFFFFF
    return out


_CONTEXTS = "bucket long, n long, contexts binary, m long, places binary"
_CONTEXT_NAMES, _CONTEXT_TYPES = ["bucket", "n", "contexts", "m", "places"], [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]


def _context_batches(buckets: int):
    """(doc_id, key, hashes, text) -> (bucket, n, contexts, m, places): each context once for a chunk, with the places of its least doc_id.
    Rows without contexts hold spans in place of places: what the least doc_id's context covers in the chunk's other documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flushed() -> pa.RecordBatch:
            contexts, anchor, places, before, behind = (np.concatenate(x) for x in zip(*held, strict=True))
            first, same = distinct_rows(contexts)
            least = np.full(len(first), LAST)
            np.minimum.at(least, same, places["doc_id"])
            covered = places["doc_id"] > least[same]
            spans = np.empty(int((whole := covered & (before + behind >= SIDE)).sum()), _SPAN)
            spans["doc_id"], spans["key"] = places["doc_id"][whole], places["key"][whole]
            spans["start"], spans["end"] = places["at"][whole] - before[whole], places["at"][whole] + GRAM + behind[whole]
            spans = merged_spans(spans)
            contexts, bucket = contexts[first], anchor[first] >> 32
            order = np.argsort(bucket, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            contexts, bucket = contexts[order], bucket[order]
            places = places[~covered]
            places["context"] = rank[same[~covered]]
            places = places[np.argsort(places["context"], kind="stable")]
            cut = runs(bucket)
            ends = np.r_[cut[1:], len(bucket)]
            low, high = np.searchsorted(places["context"], cut), np.searchsorted(places["context"], ends)
            out = []
            for a, b, c, d in zip(cut.tolist(), ends.tolist(), low.tolist(), high.tolist(), strict=True):
                own = places[c:d].copy()
                own["context"] -= a
                out.append((int(bucket[a]), b - a, packed(contexts[a:b, :WIDTH]), d - c, packed_records(own)))
            if len(spans):
                deal = spans["key"] % buckets
                spans = spans[np.argsort(deal, kind="stable")]
                out += [(int(spans["key"][a] % buckets), 0, None, b - a, packed_records(spans[a:b])) for a, b in pieces(runs(np.sort(deal)), len(spans))]
            return table_batch(_CONTEXT_NAMES, _CONTEXT_TYPES, list(zip(*out, strict=True)))

        for batch in batches:
            ids, keys, wanted = (batch.column(i).to_pylist() for i in range(3))
            texts = [x or b"" for x in bytes_of(batch.column(3))]
            for start, some in _blocks(texts):
                text, at, h, joined, starts = block_anchors(some)
                h = identity(h, buckets)
                good = np.zeros(len(h), bool)
                for i, (a, b) in enumerate(zip(np.searchsorted(text, np.arange(len(some))), np.searchsorted(text, np.arange(len(some)), "right"), strict=True)):
                    if b > a:
                        own = np.frombuffer(wanted[start + i], np.int64)
                        place = np.minimum(np.searchsorted(own, h[a:b]), len(own) - 1)
                        good[a:b] = own[place] == h[a:b]
                text, at, h = text[good], at[good], h[good]
                if not len(h):
                    continue
                padded = np.concatenate([np.full(SIDE, NO_BYTE, np.uint8), joined, np.full(SIDE, NO_BYTE, np.uint8)])
                before, behind = np.minimum(at - starts[text], SIDE), np.minimum(starts[text + 1] - at - GRAM, SIDE)
                steps = np.arange(WIDTH)
                contexts, places = np.zeros((len(h), ROW), np.uint8), np.zeros(len(h), _PLACE)
                contexts[:, :WIDTH] = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[at]
                short = np.flatnonzero((before < SIDE) | (behind < SIDE))
                outside = (steps < (SIDE - before[short])[:, None]) | (steps >= (SIDE + GRAM + behind[short])[:, None])
                contexts[short, :WIDTH] = np.where(outside, NO_BYTE, contexts[short, :WIDTH])
                places["doc_id"], places["key"], places["at"] = np.array(ids[start : start + len(some)], np.int64)[text], np.array(keys[start : start + len(some)], np.int64)[text], at - starts[text]
                held.append((contexts, h, places, before, behind))
                size += len(h)
                if size > 400_000:
                    yield flushed()
                    held, size = [], 0
        if held:
            yield flushed()

    return run


class SymbolFile:
    """Contexts laid down column-wise in one sequential file: block after block of rows, each column by column."""

    def __init__(self, folder: str):
        self.store, base = open_folder(folder)
        self.store.create_dir(base, recursive=True)
        self.path, self.blocks, self.size = f"{base}/{uuid.uuid4().hex}", [], 0
        self.out = self.store.open_output_stream(self.path, compression=None)
        self.read = None

    def append(self, rows: np.ndarray) -> None:
        self.out.write(np.ascontiguousarray(rows[:, :WIDTH].T).tobytes())
        self.blocks.append((self.size * WIDTH, len(rows)))
        self.size += len(rows)

    def column(self, c: int) -> np.ndarray:
        if self.read is None:
            self.out.close()
            self.read = self.store.open_input_file(self.path)
        return np.concatenate([np.frombuffer(self.read.read_at(n, at + c * n), np.uint8) for at, n in self.blocks])

    def close(self) -> None:
        (self.read or self.out).close()
        self.store.delete_file(self.path)


def _range_minima(v: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min of v[low..high], both included, by minima over powers of two."""
    level = np.log2(high - low + 1).astype(np.int8)
    out = np.empty(len(low), v.dtype)
    for k in range(int(level.max(initial=-1)) + 1):
        if k:
            v = np.minimum(v[: -(1 << k - 1)], v[1 << k - 1 :])
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(v[low[at]], v[high[at] - (1 << k) + 1])
    return out


def columns_built(column, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each column, the last first: its number, the order of the n suffixes that begin in it, and how long a prefix each shares with the
    one before it in order."""
    order, common = np.arange(n, dtype=np.int32), np.zeros(n, np.uint8)
    for c in range(WIDTH - 1, -1, -1):
        transform = column(c)[order]  # the symbols to insert, in the order of the suffixes behind them
        step = np.argsort(transform, kind="stable")
        x, y = step[:-1], step[1:]
        same = np.flatnonzero(transform[x] == transform[y])
        grown = np.zeros(n, np.uint8)
        grown[same + 1] = 1 + _range_minima(common, x[same] + 1, y[same])
        order, common = order[step], grown
        yield c, order, common


def marked_spans(column, owner: np.ndarray, before: np.ndarray, behind: np.ndarray, at: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Spans of places (each of context `at`) that hold a string which also stands in a context of smaller owner. The marked strings of a
    place all reach over its anchor, so what they cover is one span."""
    first, last = np.full(len(places), -1), np.full(len(places), -1)
    doc_id = places["doc_id"]
    for c, order, common in columns_built(column, len(owner)):
        m = SIDE - c  # bytes before the anchor; SIDE - m behind it
        if m < 0:
            continue
        cut = np.flatnonzero(np.r_[True, common[1:] < LENGTH])
        least = np.empty(len(owner), np.int64)
        least[order] = np.repeat(np.minimum.reduceat(owner[order], cut), np.diff(np.r_[cut, len(owner)]))
        least[(m > before) | (SIDE - m > behind)] = LAST  # the string would leave the text
        marked = least[at] < doc_id
        last[marked] = m
        first[marked & (first < 0)] = m
    good = first >= 0
    out = np.empty(int(good.sum()), _SPAN)
    out["doc_id"], out["key"] = doc_id[good], places["key"][good]
    out["start"], out["end"] = places["at"][good] - last[good], places["at"][good] - first[good] + LENGTH
    return out


def _mark_batches(folder: str, doc_buckets: int):
    """(bucket, n, contexts, m, places) sorted by bucket -> (bucket by document, n, spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        portion: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # contexts, owners, places of a bucket
        size = waiting = 0

        def flushed() -> pa.RecordBatch:
            spans = merged_spans(np.concatenate(held))
            bucket = spans["key"] % doc_buckets
            spans = spans[np.argsort(bucket, kind="stable")]
            bucket = np.sort(bucket)
            cut = runs(bucket)
            parts = pieces(cut, len(spans))
            return table_batch(["bucket", "n", "spans"], [pa.int64(), pa.int64(), pa.binary()], [bucket[cut], [b - a for a, b in parts], [packed_records(spans[a:b]) for a, b in parts]])

        def closed() -> None:
            nonlocal waiting, size
            symbols = SymbolFile(folder)
            try:
                shift, owners, places, before, behind = 0, [], [], [], []
                for contexts, owner, own in portion:
                    symbols.append(contexts)
                    own["context"] += np.uint32(shift)
                    shift += len(contexts)
                    owners.append(owner)
                    places.append(own)
                    before.append((contexts[:, :SIDE] != NO_BYTE).sum(axis=1, dtype=np.uint8))
                    behind.append((contexts[:, SIDE + GRAM : WIDTH] != NO_BYTE).sum(axis=1, dtype=np.uint8))
                portion.clear()
                places = np.concatenate(places)
                spans = marked_spans(symbols.column, np.concatenate(owners), np.concatenate(before), np.concatenate(behind), places["context"].astype(np.int64), places)
            finally:
                symbols.close()
            held.append(spans)
            size, waiting = size + len(spans), 0

        for _, rows in by_key(batches):
            known = [unpacked(x[3], x[2], _SPAN) for x in rows if not x[0]]
            held += known
            size += sum(map(len, known))
            rows = [x for x in rows if x[0]]
            if rows:
                contexts = np.concatenate([unpacked_contexts(x[1], x[0]) for x in rows])
                places = [unpacked(x[3], x[2], _PLACE) for x in rows]
                for p, shift in zip(places, np.cumsum([0, *(x[0] for x in rows)]), strict=False):
                    p["context"] += np.uint32(shift)
                places = np.concatenate(places)
                first, same = distinct_rows(contexts)
                places["context"] = same[places["context"]]
                owner = np.full(len(first), LAST)
                np.minimum.at(owner, places["context"], places["doc_id"])
                portion.append((contexts[first], owner, places))
                waiting += len(first)
                if waiting > PORTION:
                    closed()
            if size > 300_000:
                yield flushed()
                held, size = [], 0
        if portion:
            closed()
        if size:
            yield flushed()

    return run


def _span_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, n, spans) sorted by bucket -> (doc_id, key, starts, ends) of the maximal removed spans of each document."""
    for _, rows in by_key(batches):
        spans = merged_spans(np.concatenate([unpacked(x[1], x[0], _SPAN) for x in rows]))
        cut = runs(spans["doc_id"], spans["key"])
        start, end = spans["start"].astype(np.int64), spans["end"].astype(np.int64)
        columns = [spans["doc_id"][cut], spans["key"][cut], *([x[a:b].tobytes() for a, b in pieces(cut, len(spans))] for x in (start, end))]
        yield table_batch(["doc_id", "key", "starts", "ends"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()], columns)


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, key, text, starts, ends) -> what is left of each document."""
    names = ["own_id", "key", "n_removed", "n_spans", "kept", "starts", "ends"]
    types = [*[pa.int64()] * 4, pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    for batch in batches:
        rows = []
        for doc_id, key, text, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), bytes_of(batch.column(2)), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            a, b = np.frombuffer(a, np.int64).tolist(), np.frombuffer(b, np.int64).tolist()
            left = b"".join(text[x:y] for x, y in zip([0, *b], [*a, len(text)], strict=True))
            rows.append((doc_id, key, len(text) - len(left), len(a), left, a, b))
        if rows:
            yield table_batch(names, types, list(zip(*rows, strict=True)))


def removed_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, cuts): documents (doc_id, key, n_bytes, sha256), a row per input row; cuts (own_id, key, n_removed, n_spans, kept,
    starts, ends) of those that lose bytes, kept being the bytes left and own_id the doc_id, LAST for null."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key("text").alias("key"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(64, size // (SLIDE // 2) // PER_BUCKET)
    scanned = texts.mapInArrow(_anchor_batches(buckets), _SCHEMA)
    documents, wanted = repeated_hashes(scanned, list(zip(_NAMES, _KINDS, _TYPES, strict=True)), "anchors")
    release(spark)
    own = texts.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), "key", "text")
    chosen = materialise(wanted.dropDuplicates(["doc_id", "key"]).join(own, ["doc_id", "key"]).select("doc_id", "key", "hashes", "text"), "anchor-texts", "zstd")
    discard(wanted)
    release(spark)
    folder = new_path(spark, "symbols")
    contexts = chosen.mapInArrow(_context_batches(buckets), _CONTEXTS).repartition("bucket").sortWithinPartitions("bucket")
    marks = contexts.mapInArrow(_mark_batches(folder, buckets), "bucket long, n long, spans binary").repartition("bucket").sortWithinPartitions("bucket")
    spans = materialise(marks.mapInArrow(_span_batches, "doc_id long, key long, starts binary, ends binary"), "removed-spans")
    remove_folder(spark, folder)
    release(spark)
    once = chosen.select("doc_id", "key", "text").join(spans, ["doc_id", "key"]).dropDuplicates(["doc_id", "key"])
    cut = once.select("doc_id", "key", "text", "starts", "ends").mapInArrow(_cut_batches, "own_id long, key long, n_removed long, n_spans long, kept binary, starts array<long>, ends array<long>")
    cuts = materialise(cut, "cuts", "zstd")
    discard(chosen)
    discard(spans)
    release(spark)
    return documents, cuts


def removal_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256, one row per input row."""
    documents, cuts = removed_spans(docs)
    own = cuts.select("own_id", F.col("key").alias("own_key"), "n_removed", "n_spans", F.sha2("kept", 256).alias("cut_sha256"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    joined = documents.join(own, (F.coalesce("doc_id", F.lit(LAST)) == F.col("own_id")) & (F.col("key") == F.col("own_key")), "left")
    return joined.select("doc_id", "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("cut_sha256", "sha256").alias("kept_sha256"))
