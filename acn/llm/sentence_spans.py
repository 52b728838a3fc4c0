"""Substring dedup over sliding sentence spans.

Texts are cut into sentences: after a run of . ! or ? (with closing quotes) before white space, and at line ends. Every run of
`run` consecutive sentences with at least `min_words` words is hashed after ASCII lower-casing and with white space as single
blanks. Runs join globally: a span found more than once keeps its first place, by (doc_id, position), and the sentences of its
other places are removed. Spans that overlap extend each other, so a repeated passage goes as a whole.

With `passage`, every whole sentence inside a repeated passage of that many words or more goes, wherever the passage begins and
ends: of the words from the sentence's start to the passage's end and those from the passage's start to the sentence's end, one
part or the other has half of passage + 1. So each sentence also gives the half's words from its start on and those up to its
end, or itself if it is longer. A passage without a whole sentence inside has nothing to remove. The rule that decides is thus: a
sentence goes where it and what follows it, or it and what goes before it, up to (passage + 2) // 2 words (26 for 51), stands at an
earlier place; a shorter repeat than `passage` may go, too, from that length on.

Hot spans: first places and counts are found by an aggregate with map-side combine; the join back is an equi-join in which
only spans with two places or more take part.

Defined results: null text has no sentences; without `passage`, texts with fewer than `run` sentences never change; rows that repeat a doc_id are
documents of their own if their texts differ, and count as one if not; an empty table gives an empty one; further columns are ignored by repeats() and kept by remove_repeats().
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import bytes_of, discard, fresh_names, materialise, release, table_batch

COUNTED = ["n_sentences", "n_removed", "n_words_removed"]
#: A sentence with the white space behind it.
SENTENCE = re.compile(rb"[^\n]*?(?:[.!?]+[\"')\]]*(?=[ \t\x0b\x0c\r])[ \t\x0b\x0c\r]*|\n\s*|$)", re.S)


def sentences(text: bytes | None) -> list[bytes]:
    """Pieces whose concatenation is the text."""
    return [x for x in SENTENCE.findall(text or b"") if x]


def _uid(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text) >> 1


def _span_batches(run: int, min_words: int, passage: int | None):
    half = None if passage is None else (passage + 2) // 2
    names, types = ["doc_id", "uid", "at", "span"], [pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 2000):
                part = batch.slice(low, 2000)
                columns: list[list[np.ndarray]] = [[], [], [], [], []]
                for doc_id, text in zip(part.column(0).to_pylist(), bytes_of(part.column(1)), strict=True):
                    pieces = [x.lower().split() for x in sentences(text)]
                    full = [i for i, x in enumerate(pieces) if x]
                    if not full or (half is None and len(full) < run):
                        continue
                    uid = _uid(text)
                    words = [w for i in full for w in pieces[i]]
                    flat = b" ".join(words)
                    begins = np.cumsum([0, *(len(w) + 1 for w in words)])  # of words in flat, and one past its end
                    ends = np.cumsum([len(pieces[i]) for i in full])
                    starts = np.r_[0, ends[:-1]]
                    first, last = starts[: max(len(full) - run + 1, 0)], ends[run - 1 :]
                    keep = np.flatnonzero(last - first >= min_words)
                    found = [(2 * keep, first[keep], last[keep], 0)]
                    if half is not None:
                        ahead, back = np.flatnonzero(starts + half <= len(words)), np.flatnonzero((ends >= half) & (ends - starts < half))
                        found += [(2 * ahead + 1, starts[ahead], np.maximum(starts[ahead] + half, ends[ahead]), 1), (2 * back + 1, ends[back] - half, ends[back], 2)]
                    for at, low_word, high_word, seed in found:
                        if not len(at):
                            continue
                        cuts = zip(begins[low_word].tolist(), (begins[high_word] - 1).tolist(), strict=True)
                        hashes = np.fromiter((xxhash.xxh3_64_intdigest(flat[x:y], seed=seed) for x, y in cuts), np.uint64, len(at)).view(np.int64)
                        for column, x in zip(columns, (np.full(len(at), doc_id or 0), np.full(len(at), doc_id is None), np.full(len(at), uid), at, hashes), strict=True):
                            column.append(x)
                if columns[0]:
                    ids, unknown, *rest = (np.concatenate(c) for c in columns)
                    yield table_batch(names, types, [pa.array(ids, mask=unknown), *rest])

    return spans


def repeated_spans(docs: DataFrame, run: int = 3, min_words: int = 15, passage: int | None = None) -> DataFrame:
    """doc_id, uid (of the text), at (the first sentence to remove among those with words) and n (how many), for the spans that
    aren't first of their kind."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("uid", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("span", T.LongType())])
    spans = materialise(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_span_batches(run, min_words, passage), schema), "spans")
    first = spans.groupBy("span").agg(F.min(F.struct("doc_id", "uid", "at")).alias("first"), F.count("*").alias("places")).filter("places > 1")
    later = F.struct("doc_id", "uid", "at") != F.col("first")
    n = F.when(F.col("at") % 2 == 0, run).otherwise(1)  # odd: a half around one sentence
    found = materialise(spans.join(first, "span").filter(later).select("doc_id", "uid", F.shiftright("at", 1).alias("at"), n.alias("n")), "span-repeats")
    discard(spans)
    release(docs.sparkSession)
    return found


def _remover(names: list[str], own_spans: str):
    text_at, spans_at = names.index("text"), names.index(own_spans)
    rest = [i for i in range(len(names)) if i not in (text_at, spans_at)]

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for text, spans in zip(bytes_of(batch.column(text_at)), batch.column(spans_at).to_pylist(), strict=True):
                pieces = sentences(text)
                full = [i for i, x in enumerate(pieces) if x.split()]
                uid = _uid(text) if spans else None
                gone = {i for x in spans or () if x["uid"] == uid for i in full[x["at"] : x["at"] + x["n"]]}
                texts.append(None if text is None else b"".join(x for i, x in enumerate(pieces) if i not in gone).decode("utf-8", "replace"))
                counts.append((len(full), len(gone), sum(len(pieces[i].split()) for i in gone)))
            added = [pa.array(texts, pa.string()), *(pa.array(c, pa.int64()) for c in (zip(*counts, strict=True) if counts else [[]] * 3))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), *added], [*(names[i] for i in rest), "text", *COUNTED])

    return remove


def remove_repeats(docs: DataFrame, run: int = 3, min_words: int = 15, passage: int | None = None) -> DataFrame:
    """docs without the sentences of later places, text as the last of its columns, then n_sentences, n_removed and n_words_removed, which
    take the place of any columns of these names; null doc_id comes first."""
    own, spans = fresh_names(docs, "own_id", "own_spans")
    found = repeated_spans(docs, run, min_words, passage).groupBy(F.col("doc_id").alias(own)).agg(F.collect_set(F.struct("uid", "at", "n")).alias(spans))
    plain = docs.drop(*COUNTED).withColumn("text", F.col("text").cast("string"))
    joined = plain.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(own)), "left").drop(own)
    schema = T.StructType([*(f for f in plain.schema.fields if f.name != "text"), T.StructField("text", T.StringType()), *(T.StructField(c, T.LongType()) for c in COUNTED)])
    return joined.mapInArrow(_remover(joined.columns, spans), schema)
