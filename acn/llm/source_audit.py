"""Source divergence audit: how far the term frequencies of each source lie from those of the other sources of its language.

Terms are runs of letters (any character beyond ASCII is one), A-Z lower-cased. A language keeps the terms that stand in MIN_DOCS
of its documents. With V kept terms, a group of N kept occurrences gives each kept term p = 1 + floor(1000000000 * (count + 5) / (N + 5 V)).
Two sources a and b differ by the sum over kept terms of |p_a - p_b|.

Most terms miss most sources, so the sums are put together from corrections. With z the p of a count of 0:
    sum |p_a - p_b| = V |z_a - z_b|
                    + over terms in a: |p_a - z_b| - |z_a - z_b|, and over those in b likewise
                    + over terms in both: |p_a - p_b| - |p_a - z_b| - |z_a - p_b| + |z_a - z_b|.
The first two come from the groups and from a histogram of each source's p. For the third each term is a row of its nonzero
counts in the order of sources, and equal rows become one with a multiplicity. Rows are inserted in frequent-pattern trees: a node
stands for a source with a count behind the same counts of all sources before it, and holds how many terms pass it. What a node and
one of its ancestors add to their pair of sources is worked out once, times the node's number, for all terms that share the path.

Rows are dealt by ranges of their paths, so that shared beginnings meet; a tree of NODES nodes is summed up and begun anew, for
sums don't depend on where rows fall. Words are counted inside scan tasks by language, source and term before they are shuffled, so that a
source with a third of all rows sends what another does. Whole numbers throughout.

Defined results: null text, lang and source count as ''; a group without terms has its rows with p of its zero counts; repeated rows
count as often as they stand; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import few, materialise
from .word_arrays import LETTER_WORDS, byte_slices, texts_of, word_arrays

MIN_DOCS, TOP = 30, 50
SLICE = 8 << 20
HELD = 1_000_000  # counts a scan task holds before it sends them on
NODES = 200_000

COUNTS = "lang string, source string, term string, count long, docs long"
_NAMES, _TYPES = ["lang", "source", "term", "count", "docs"], [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]


class _Counter:
    """Counts by group and term, each numbered in the order of arrival."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.terms: dict[str, int] = {}
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    @staticmethod
    def _numbers(known: dict, values: list) -> np.ndarray:
        return np.fromiter((known.setdefault(x, len(known)) for x in values), np.int64, len(values))

    def add(self, batch: pa.RecordBatch) -> None:
        words, counts = word_arrays(texts_of(batch.column(2)), LETTER_WORDS)
        group = self._numbers(self.groups, list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)))
        coded = words.dictionary_encode()
        vocabulary = max(len(coded.dictionary), 1)
        # each document's terms once, then each group's
        in_doc, count = np.unique(np.repeat(np.arange(len(counts)), counts) * vocabulary + coded.indices.to_numpy(), return_counts=True)
        term = self._numbers(self.terms, coded.dictionary.to_pylist())
        self._keep((group[in_doc // vocabulary] << 32) | (term[in_doc % vocabulary] if len(term) else 0), count, np.ones(len(count), np.int64))
        none = self.terms.setdefault("", len(self.terms))  # a group's documents
        self._keep((group << 32) | none, np.zeros(len(group), np.int64), np.ones(len(group), np.int64))

    def _keep(self, key: np.ndarray, count: np.ndarray, docs: np.ndarray) -> None:
        self.held.append(self._summed(key, count, docs))
        self.size += len(self.held[-1][0])
        if self.size > HELD:
            self.held = [self._summed(*(np.concatenate(c) for c in zip(*self.held, strict=True)))]
            self.size = len(self.held[0][0])

    @staticmethod
    def _summed(key: np.ndarray, count: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(key, kind="stable")
        key, heads = np.unique(key[order], return_index=True)
        return (key, np.add.reduceat(count[order], heads), np.add.reduceat(docs[order], heads)) if len(key) else (key, count, docs)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            key, count, docs = self._summed(*(np.concatenate(c) for c in zip(*self.held, strict=True)))
            langs, sources, terms = pa.array([x[0] for x in self.groups], pa.string()), pa.array([x[1] for x in self.groups], pa.string()), pa.array(list(self.terms), pa.string())
            for low in range(0, len(key), 50_000):
                some = slice(low, low + 50_000)
                group, term = pa.array(key[some] >> 32), pa.array(key[some] & 0xFFFFFFFF)
                yield pa.RecordBatch.from_arrays([langs.take(group), sources.take(group), terms.take(term), pa.array(count[some]), pa.array(docs[some])], _NAMES)
        self.__init__()


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counter = _Counter()
    for part in byte_slices(batches, 2, SLICE):
        counter.add(part)
        if counter.size > HELD // 2:
            yield from counter.rows()
    yield from counter.rows()


def term_rows(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, docs, total and row, the (source, count) of a kept term in the order of sources; under the empty term all sources of
    a lang, with counts of 0. Written to the shared folder."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    counted = docs.select(text("lang"), text("source"), text("text")).mapInArrow(_count_batches, COUNTS)
    # dealt once for both aggregates: a lang and term meet with one row for each source and scan task
    groups = counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    rows = groups.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("total"), F.array_sort(F.collect_list(F.struct("source", "count"))).alias("row"))
    return materialise(rows.filter((F.col("docs") >= min_docs) | (F.col("term") == "")), "term-rows")


def probability(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(1000000000 * (count + 5) / (n + 5 v)), exactly."""
    parts = (F.lit(1_000_000_000).cast("decimal(10,0)") * (count + 5).cast("decimal(20,0)"), F.greatest(n + 5 * v, F.lit(1)).cast("decimal(20,0)"))
    return 1 + F.call_function("div", *parts)


def source_groups(rows: DataFrame) -> DataFrame:
    """lang, source, n (kept occurrences), v (kept terms of the lang), lang_n and zero (p of a count of 0), a row for each group."""
    kept = rows.filter("term != ''")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    counts = kept.select("lang", F.explode("row").alias("r")).groupBy("lang", "r.source").agg(F.sum("r.count").alias("n"))
    every = rows.filter("term = ''").select("lang", F.explode("row.source").alias("source"))
    full = every.join(counts, ["lang", "source"], "left").join(few(langs), "lang", "left").na.fill(0, ["n", "v", "lang_n"])
    return materialise(full.withColumn("zero", probability(F.lit(0), F.col("n"), F.col("v"))), "source-groups")


class PatternTree:
    """A frequent-pattern tree of rows of (source, p, zero): parent, source, p, zero and number of each node."""

    def __init__(self):
        self.children: dict[tuple[int, int, int], int] = {}
        self.parent: list[int] = []
        self.entry: list[tuple[int, int, int]] = []
        self.number: list[int] = []

    def insert(self, row: list[tuple[int, int, int]], times: int) -> None:
        at = -1
        for source, p, zero in row:
            node = self.children.setdefault((at, source, p), len(self.parent))
            if node == len(self.parent):
                self.parent.append(at)
                self.entry.append((source, p, zero))
                self.number.append(0)
            self.number[node] += times
            at = node

    def pair_sums(self, sources: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys ancestor's source * sources + node's source, and what all nodes and their ancestors add to that pair."""
        totals = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not self.parent:
            return totals
        parent, number = np.array(self.parent), np.array(self.number)
        source, p, zero = (np.array(c) for c in zip(*self.entry, strict=True))
        node, up = np.flatnonzero(parent >= 0), parent[parent >= 0]
        while len(node):
            far = abs(p[up] - p[node]) - abs(p[up] - zero[node]) - abs(zero[up] - p[node]) + abs(zero[up] - zero[node])
            keys, which = np.unique(np.r_[totals[0], source[up] * sources + source[node]], return_inverse=True)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, which, np.r_[totals[1], far * number[node]])
            totals = keys, sums
            up = parent[up]
            node, up = node[up >= 0], up[up >= 0]
        return totals


def _tree_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, row, times) in order; gives (lang, a, b, value) for each tree."""
    tree, lang, numbers = PatternTree(), None, {}

    def done() -> pa.RecordBatch:
        keys, sums = tree.pair_sums(len(numbers))
        names = pa.array(list(numbers), pa.string())
        pair = [names.take(pa.array(keys // max(len(numbers), 1))), names.take(pa.array(keys % max(len(numbers), 1)))]
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), *pair, pa.array(sums)], ["lang", "a", "b", "value"])

    for batch in batches:
        for own, row, times in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if own != lang or len(tree.parent) > NODES:
                yield done()
                tree, lang, numbers = PatternTree(), own, {}
            tree.insert([(numbers.setdefault(x["source"], len(numbers)), x["p"], x["zero"]) for x in row], times)
    yield done()


def pair_divergence(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source of the lang), value: both directions of each pair."""
    all_groups = few(groups.select("lang", "source", "n", "v", "zero"))
    other = few(groups.select("lang", F.col("source").alias("b"), F.col("zero").alias("zero_b")))
    entry = F.struct("source", "count", probability(F.col("count"), F.col("n"), F.col("v")).alias("p"), "zero")
    entries = rows.filter("term != ''").select("lang", "term", F.explode("row").alias("r")).select("lang", "term", "r.source", "r.count").join(all_groups, ["lang", "source"])
    paths = materialise(
        entries.groupBy("lang", "term").agg(F.array_sort(F.collect_list(entry)).alias("row")).groupBy("lang", "row").agg(F.count("*").alias("times")), "term-paths"
    )
    zeros = groups.select("lang", F.col("source").alias("a"), "v", F.col("zero").alias("zero_a"))
    base = zeros.join(other, "lang").filter("a < b").select("lang", "a", "b", (F.col("v") * F.abs(F.col("zero_a") - F.col("zero_b"))).alias("value"))
    bars = paths.select("lang", "times", F.explode("row").alias("r")).groupBy("lang", F.col("r.source").alias("a"), "r.p", "r.zero").agg(F.sum("times").alias("times"))
    alone = bars.join(other, "lang").filter("a != b").select(
        "lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
        (F.col("times") * (F.abs(F.col("p") - F.col("zero_b")) - F.abs(F.col("zero") - F.col("zero_b")))).alias("value"),
    )
    begin = F.transform(F.slice("row", 1, 3), lambda x: F.struct(x["source"], x["count"]))  # ranges are drawn from short keys
    both = paths.repartitionByRange("lang", begin, F.xxhash64("row")).sortWithinPartitions("lang", "row").mapInArrow(_tree_batches, "lang string, a string, b string, value long")
    sums = base.unionByName(alone).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return sums.select("lang", ways.alias("w"), "value").select("lang", "w.source", "w.item", "value")


def term_excess(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (a kept term that the source has, with a larger p than in the whole lang), value."""
    own = few(groups.select("lang", "source", "n", "v", "lang_n"))
    entries = rows.filter("term != ''").select("lang", F.col("term").alias("item"), "total", F.explode("row").alias("r")).select("lang", "item", "total", "r.source", "r.count")
    p, q = (probability(F.col(a), F.col(b), F.col("v")) for a, b in (("count", "n"), ("total", "lang_n")))
    return entries.filter("count > 0").join(own, ["lang", "source"]).select("lang", "source", "item", (p - q).alias("value")).filter("value > 0")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: all other sources and the first `top` terms of each source."""
    rows = term_rows(docs, min_docs)
    groups = source_groups(rows)
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda df, part: df.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit(part))
    terms = ranked(term_excess(rows, groups), "term").filter(F.col("rank") <= top)
    return ranked(pair_divergence(rows, groups), "pair").unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


ORACLE = """
with d as (select row_number() over () rid, coalesce(lang, '') lang, coalesce(source, '') source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
w as (select rid, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) term from d),
k as (select lang, term, count(*) total from w group by lang, term having count(distinct rid) >= 30),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) c from w join k using (lang, term) group by lang, source, term),
l as (select lang, count(*) v, sum(total) n from k group by lang),
gn as (select g.lang, g.source, coalesce(sum(c.c), 0) n from g left join c on g.lang = c.lang and g.source = c.source group by g.lang, g.source),
p as (select gn.lang, gn.source, k.term, coalesce(c.c, 0) c, 1 + (cast(1000000000 as hugeint) * (coalesce(c.c, 0) + 5)) // (gn.n + 5 * l.v) p,
             1 + (cast(1000000000 as hugeint) * (k.total + 5)) // (l.n + 5 * l.v) q
      from gn join l on gn.lang = l.lang join k on k.lang = gn.lang left join c on c.lang = gn.lang and c.source = gn.source and c.term = k.term),
pv as (select a.lang, a.source, b.source item, sum(abs(a.p - b.p)) f from p a join p b on a.lang = b.lang and a.term = b.term and a.source != b.source group by all),
r as (select a.lang, a.source, 'pair' part, b.source item, coalesce(pv.f, 0) f from g a join g b on a.lang = b.lang and a.source != b.source
      left join pv on pv.lang = a.lang and pv.source = a.source and pv.item = b.source
      union all select lang, source, 'term', term, p - q from p where c > 0 and p > q),
o as (select *, row_number() over (partition by lang, source, part order by f desc, item) rank from r)
select lang, source, part, item, cast(f as bigint) as value, cast(rank as integer) as rank from o where part = 'pair' or rank <= 50
"""
