"""Benchmark decontamination over a distributed positional inverted index.

build_index() cuts the training texts in segments of SEGMENT bytes of whole documents. A segment's words are numbered in a row, and
each of its terms has one row: (segment, term, n, positions), the positions as gaps of 7-bit groups. One more row under the empty
term holds the position at which each document begins; further rows give the documents themselves. Every word of every text is stored.

A search cuts each test item in windows of n consecutive words (an item of fewer, but not none, is one window). Terms get their
frequencies from the index; a piece of an item goes to the segments that hold the rarest term of one of its windows, if none of that
window's terms is absent everywhere. There the lists are intersected from the rarest term on: its positions, shifted by its
place in the window, are starts; each next list keeps those that it also holds, shifted by its own place.

phrase_matches() gives the stretches of words that an item's windows cover; near_matches() the places where all terms of a window stand,
in any order, within a number of words of one document.

Nothing is collected: a segment and a block of BLOCK_WORDS words of items meet in one task. A frequent term has a row in each segment,
and no task takes more than segments hold. Frequencies are sums with map-side combine.

Defined results: null text or text without words has no words and no match; rows that repeat a doc_id are documents of their own; rows
that repeat an item_id are one item, whose windows are those of all its rows, and null counts as the empty id; empty tables give empty
tables (documents without items: no hit); further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import few, materialise
from .word_arrays import byte_slices, texts_of, word_arrays

SEGMENT = 8 << 20
PIECE = 512
BLOCK_WORDS = 2_000_000
STARTS = 2_000_000  # starts that are intersected at once

INDEX = "segment long, term string, n int, positions binary, ordinal int, doc_id long"
_INDEX_TYPES = [pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.int32(), pa.int64()]
_INDEX_NAMES = ["segment", "term", "n", "positions", "ordinal", "doc_id"]


def pack_gaps(gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below 2^35 as 7-bit groups, the last of each without the high bit; and how many bytes each takes."""
    sizes = 1 + sum((gaps >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    at = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    for k in range(5):
        here = np.flatnonzero(sizes > k)
        out[at[here] + k] = gaps[here] >> 7 * k & 127 | np.where(sizes[here] > k + 1, 128, 0)
    return out, sizes


def unpack_gaps(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data < 128)
    begins = np.r_[0, ends[:-1] + 1]
    out = np.zeros(len(ends), np.int64)
    for k in range(5):
        here = np.flatnonzero(ends - begins >= k)
        out[here] |= (data[begins[here] + k] & np.int64(127)) << 7 * k
    return out


def _segment(number: int, doc_ids: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
    words, counts = word_arrays(texts_of(texts))
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    lengths = np.bincount(codes, minlength=len(coded.dictionary)).astype(np.int64)
    heads = np.cumsum(lengths) - lengths
    gaps = np.diff(order, prepend=0)
    gaps[heads] = order[heads]
    firsts = np.cumsum(counts) - counts
    data, sizes = pack_gaps(np.concatenate([gaps, np.diff(firsts, prepend=0)]))
    ends = np.cumsum(np.append(np.add.reduceat(sizes[: len(order)], heads), sizes[len(order) :].sum())) if len(order) else np.array([sizes.sum()])
    positions = pa.Array.from_buffers(pa.binary(), len(lengths) + 1, [None, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(data)])
    terms = pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.array([""], pa.string())])
    no = lambda k, kind: pa.nulls(k, kind)
    k, d = len(terms), len(counts)
    yield pa.RecordBatch.from_arrays([pa.array(np.full(k, number)), terms, pa.array(np.append(lengths, d).astype(np.int32)), positions, no(k, pa.int32()), no(k, pa.int64())], _INDEX_NAMES)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(d, number)), no(d, pa.string()), pa.array(counts.astype(np.int32)), no(d, pa.binary()), pa.array(np.arange(d, dtype=np.int32)), doc_ids.cast(pa.int64())], _INDEX_NAMES
    )


def _index_batches(segment_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for part in byte_slices(batches, 1, segment_bytes):
            yield from _segment(number, part.column(0), part.column(1))
            number += 1

    return run


def build_index(docs: DataFrame, segment_bytes: int = SEGMENT) -> DataFrame:
    """The index of docs (doc_id, text), written to the shared folder: rows of INDEX. Rows with a term are postings, rows with an
    ordinal are documents, n their number of words."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialise(rows.mapInArrow(_index_batches(segment_bytes), INDEX), "positional-index", "zstd")


def _piece_batches(n: int):
    names, types = ["piece", "item_id", "size", "words"], [pa.int64(), pa.string(), pa.int32(), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = TaskContext.get().partitionId() << 40
        for part in byte_slices(batches, 1, 1 << 20):
            words, counts = word_arrays(texts_of(part.column(1)))
            ids, rows, low = part.column(0).to_pylist(), [], 0
            for item_id, count in zip(ids, counts.tolist(), strict=True):
                size = min(n, count)
                for at in range(0, count - size + 1 if count else 0, PIECE):
                    rows.append((piece, item_id, size, words[low + at : low + min(at + PIECE + size - 1, count)].to_pylist()))
                    piece += 1
                low += count
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return run


def _anchor_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each piece the rarest term of each of its windows, unless one of the window's terms is absent."""
    names, types = ["piece", "anchor"], [pa.int64(), pa.string()]
    for batch in batches:
        rows: list[tuple] = []
        for piece, size, words, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            seen = np.lib.stride_tricks.sliding_window_view(np.array(n), size)
            rarest = seen.argmin(axis=1) + np.arange(len(seen))
            rows += [(piece, w) for w in {words[i] for i in rarest[seen.min(axis=1) > 0].tolist()}]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


class _Lists:
    """The posting lists of a segment, laid end to end: key = code * reach + position ascends."""

    def __init__(self, postings: pa.Table):
        terms, n = postings.column("term").to_pylist(), postings.column("n").to_numpy().astype(np.int64)
        data = np.frombuffer(b"".join(postings.column("positions").to_pylist()), np.uint8)
        gaps = unpack_gaps(data)
        heads = np.cumsum(n) - n
        sums = np.cumsum(gaps)
        full = n > 0
        positions = sums - np.repeat(sums[heads[full]] - gaps[heads[full]], n[full])
        own = terms.index("")
        self.firsts = positions[heads[own] : heads[own] + n[own]]
        self.codes = {t: i for i, t in enumerate(terms) if t}
        self.n, self.heads, self.positions = n, heads, positions
        self.reach = int(positions.max(initial=0)) + PIECE + 2
        self.keys = np.repeat(np.arange(len(n)), n) * self.reach + positions
        if own < len(n) - 1:  # its positions may repeat, for empty documents; they ascend all the same
            assert self.keys.size == 0 or bool((np.diff(self.keys) >= 0).all())

    def has(self, codes: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """Whether each list holds its position."""
        at = np.searchsorted(self.keys, codes * self.reach + positions)
        return (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == codes * self.reach + positions)

    def next(self, codes: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """The first position of each list from the given one on; a far one if there is none."""
        at = np.searchsorted(self.keys, codes * self.reach + positions)
        key = self.keys[np.minimum(at, len(self.keys) - 1)]
        return np.where((at < len(self.keys)) & (key // self.reach == codes), key - codes * self.reach, 1 << 40)

    def starts(self, windows: np.ndarray, column: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, position) of the list of column[i] of each window, in parts of about STARTS."""
        codes = windows[np.arange(len(windows)), column]
        total = np.cumsum(self.n[codes])
        low = 0
        while low < len(windows):
            high = max(low + 1, int(np.searchsorted(total, STARTS + (total[low - 1] if low else 0), "right")))
            n = self.n[codes[low:high]]
            which = np.repeat(np.arange(low, high), n)
            inside = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            yield which, self.positions[self.heads[codes[which]] + inside]
            low = high


def _phrases(lists: _Lists, windows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """window, start and length of each place where a window's words stand in a row."""
    size = windows.shape[1]
    order = np.argsort(lists.n[windows], axis=1, kind="stable")
    for which, at in lists.starts(windows, order[:, 0]):
        at = at - order[which, 0]
        which, at = which[at >= 0], at[at >= 0]
        for r in range(1, size):
            if not len(at):
                break
            place = order[which, r]
            held = lists.has(windows[which, place], at + place)
            which, at = which[held], at[held]
        yield which, at, np.full(len(at), size)


def _nearby(within: int):
    def run(lists: _Lists, windows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """window, start and length of each stretch of at most `within` words that begins with one of the window's terms and holds all."""
        size = windows.shape[1]
        rarest = windows[np.arange(len(windows)), lists.n[windows].argmin(axis=1)]
        for column in range(size):
            again = (windows[:, :column] == windows[:, column : column + 1]).any(axis=1)  # a term that stands twice gives its starts once
            for which, at in lists.starts(windows, np.full(len(windows), column)):
                keep = ~again[which] & (lists.next(rarest[which], at) - at < within)
                which, at = which[keep], at[keep]
                end = at.copy()
                for r in range(size):
                    end = np.maximum(end, lists.next(windows[which, r], at))
                    close = end - at < within
                    which, at, end = which[close], at[close], end[close]
                yield which, at, end - at + 1

    return run


def _union(owner: np.ndarray, at: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal stretches of each owner's intervals [at, to)."""
    order = np.lexsort((at, owner))
    owner, at, to = owner[order], at[order], to[order]
    shift = int(to.max(initial=0)) + 1
    low, high = owner * shift + at, np.maximum.accumulate(owner * shift + to)
    new = np.r_[True, low[1:] > high[:-1]][: len(low)]
    begin = np.flatnonzero(new)
    last = np.r_[begin[1:], len(low)] - 1
    return owner[begin], at[begin], (high[last[: len(begin)]] - owner[begin] * shift)


_MATCH = "segment long, ordinal int, item_id string, at int, length int"
_MATCH_NAMES, _MATCH_TYPES = ["segment", "ordinal", "item_id", "at", "length"], [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32()]


def _match_group(find, join: bool):
    def run(key: tuple, postings: pa.Table, pieces: pa.Table) -> pa.Table:
        found: list[list] = [[], [], [], [], []]
        if postings.num_rows and pieces.num_rows:
            lists = _Lists(postings)
            ids = pieces.column("item_id").combine_chunks().dictionary_encode()
            names = ids.dictionary.to_pylist()
            rows = list(zip(ids.indices.to_pylist(), pieces.column("size").to_pylist(), pieces.column("words").to_pylist(), strict=True))
            for size in sorted({r[1] for r in rows}):
                grids, owners = [], []
                for item, own, words in rows:
                    if own == size:
                        grid = np.lib.stride_tricks.sliding_window_view(np.array([lists.codes.get(w, -1) for w in words], np.int64), size)
                        grids.append(grid[(grid >= 0).all(axis=1)])
                        owners.append(np.full(len(grids[-1]), item))
                windows, which_of = np.unique(np.concatenate(grids), axis=0, return_inverse=True)
                if not len(windows):
                    continue
                pairs = np.unique(np.column_stack([which_of.reshape(-1), np.concatenate(owners)]), axis=0)  # each window's items
                low = np.searchsorted(pairs[:, 0], np.arange(len(windows)))
                many = np.diff(np.append(low, len(pairs)))
                for which, at, length in find(lists, windows):
                    doc = np.searchsorted(lists.firsts, at, "right") - 1
                    same = np.searchsorted(lists.firsts, at + length - 1, "right") - 1 == doc
                    which, at, length, doc = which[same], at[same], length[same], doc[same]
                    n = many[which]
                    item = pairs[np.repeat(low[which], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), 1]
                    at, length, doc = np.repeat(at, n), np.repeat(length, n), np.repeat(doc, n)
                    if join and len(at):
                        owner, at, to = _union(item * len(lists.firsts) + doc, at, at + length)
                        item, doc, length = owner // len(lists.firsts), owner % len(lists.firsts), to - at
                    if len(at):
                        for c, x in zip(found, (np.full(len(at), key[0].as_py()), doc, [names[i] for i in item.tolist()], at - lists.firsts[doc], length), strict=True):
                            c.append(x)
        columns = [pa.concat_arrays([pa.array(x, t) for x in c]) if c else pa.array([], t) for c, t in zip(found, _MATCH_TYPES, strict=True)]
        return pa.Table.from_arrays(columns, _MATCH_NAMES)

    return run


def _search(index: DataFrame, items: DataFrame, n: int, find, join: bool) -> DataFrame:
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text"))
    pieces = materialise(rows.mapInArrow(_piece_batches(n), "piece long, item_id string, size int, words array<string>"), "item-pieces")
    postings = index.filter("term is not null").select("segment", "term", "n", "positions")
    test_terms = few(pieces.select(F.explode("words").alias("term")).distinct())
    # the rarest term of each window
    known = few(materialise(postings.select("term", "n").join(test_terms, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n")), "test-terms"))
    placed = pieces.select("piece", "size", F.posexplode("words").alias("at", "term")).join(known, "term", "left")
    listed = placed.groupBy("piece", "size").agg(F.array_sort(F.collect_list(F.struct("at", "term", F.coalesce("n", F.lit(0)).alias("n")))).alias("w"))
    anchors = listed.select("piece", "size", "w.term", "w.n").mapInArrow(_anchor_batches, "piece long, anchor string")
    # the segments to which each piece goes
    routes = postings.select("segment", F.col("term").alias("anchor")).join(few(materialise(anchors, "anchors")), "anchor").select("segment", "piece").distinct()
    blocks = max(1, -(-(pieces.select(F.sum(F.size("words"))).first()[0] or 0) // BLOCK_WORDS))
    block = F.pmod(F.xxhash64("piece"), F.lit(blocks)).cast("int")
    routed = routes.join(few(pieces), "piece").select(F.col("segment").alias("to"), block.alias("part"), "item_id", "size", "words")
    lists = postings.join(few(known.select("term").union(known.sparkSession.range(1).select(F.lit("")))), "term", "left_semi")
    dealt = lists.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return dealt.groupBy("segment", "block").cogroup(routed.groupBy("to", "part")).applyInArrow(_match_group(find, join), _MATCH)


def phrase_matches(index: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """segment, ordinal (the document's, as in the index), item_id, at, length: stretches of a document's words that windows of the
    item cover; stretches of one item and document may overlap."""
    return _search(index, items, n, _phrases, True)


def near_matches(index: DataFrame, items: DataFrame, n: int = 10, within: int = 20) -> DataFrame:
    """segment, ordinal, item_id, n_places, shortest, at: where all terms of one of the item's windows stand within so many words, in any
    order; the shortest such stretch, then the first."""
    found = _search(index, items, n, _nearby(within), False).distinct()
    first = F.min(F.struct("length", "at"))
    return found.groupBy("segment", "ordinal", "item_id").agg(F.countDistinct("at").alias("n_places"), first["length"].alias("shortest"), first["at"].alias("at"))


def contamination(index: DataFrame, matches: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit (words inside a match), n_items, items_sha256, contaminated: one row per document."""
    doc = ["segment", "ordinal"]
    earlier = Window.partitionBy(*doc).orderBy("at", "length").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max(F.col("at") + F.col("length")).over(earlier), F.lit(0))
    fresh = F.greatest(F.col("at") + F.col("length") - F.greatest("at", reached), F.lit(0))
    hits = matches.withColumn("fresh", fresh).groupBy(*doc).agg(F.sum("fresh").alias("hit"), F.array_sort(F.collect_set("item_id")).alias("items"))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return index.filter("ordinal is not null").select(*doc, "doc_id", "n").join(hits, doc, "left").select(
        "doc_id", F.col("n").cast("long").alias("n_words"), count(F.col("hit")).alias("n_hit"), count(F.size(F.coalesce("items", F.array().cast("array<string>")))).alias("n_items"),
        F.sha2(F.coalesce(F.concat_ws(",", "items"), F.lit("")), 256).alias("items_sha256"), F.col("hit").isNotNull().alias("contaminated"),
    )


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
with d as (select row_number() over () rid, doc_id, {_WORDS} w from documents),
i as (select coalesce(cast(item_id as varchar), '') item_id, w, least(len(w), 10) n from (select item_id, {_WORDS} w from benchmark) where len(w) > 0),
iw as (select distinct item_id, n, array_to_string(w[p : p + n - 1], ' ') k from (select *, unnest(generate_series(1, len(w) - n + 1)) p from i)),
dw as (select rid, n, p, array_to_string(w[p : p + n - 1], ' ') k from (select rid, w, n, unnest(generate_series(1, len(w) - n + 1)) p from d, (select distinct n from iw))),
h as (select rid, item_id, p, n from dw join iw using (n, k)),
c as (select rid, count(distinct q) n_hit from (select rid, unnest(generate_series(p, p + n - 1)) q from h) group by rid),
g as (select rid, count(*) n_items, string_agg(item_id, ',' order by item_id) items from (select distinct rid, item_id from h) group by rid)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
       sha256(coalesce(items, '')) items_sha256, n_hit is not null contaminated
from d left join c using (rid) left join g using (rid)
"""
