"""Quality rules: an isolation forest over rule statistics, with its threshold calibrated from labelled rows.

Statistics of each document (null text: no words, all zero):
n_words, word_chars (code points inside words), n_symbols (characters of SYMBOLS), n_lines and n_dup_lines
(lines with a word; those equal to an earlier one), n_repeat_words (words inside 3-word windows found at least
twice in the text). base_failed: fewer than 50 words, or more than half of the words inside repeated windows.

The forest is the usual one: each tree isolates a subsample by random splits, and rows that few splits isolate
are anomalous. It is fitted on `fit_rows` documents at most, those of lowest seeded hash among the rows that pass
the base rules (a bounded, documented sample); statistics, scores and calibration cover every row. The threshold
is read from a score histogram of all labelled rows, so that at most `good_loss` of the good ones are rejected.

Defined results: an empty table gives an empty one; without labels no row is rejected by the forest; repeated rows
are judged alike; further columns of the input are not read by quality_statistics() and are kept by keep_good().
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import bytes_of, fresh_names, materialise, pair_hash, release, table_batch, text_key

SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
FEATURES = ["f_word", "f_symbols", "f_symbol_share", "f_dup_lines", "f_repeats"]
#: Shares of repeated lines and words that are ordinary; only what exceeds them counts as odd.
MOST_DUP_LINES, MOST_REPEATS = 0.3, 0.2
BINS = 2000


def text_counts(text: bytes | None) -> tuple[int, ...]:
    """The COUNTS of one text, in order."""
    text = text or b""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeats = 0
    if len(set(windows)) < len(windows):
        seen = Counter(windows)
        hit = np.fromiter((seen[w] > 1 for w in windows), bool, len(windows))
        repeats = int((np.r_[hit, False, False] | np.r_[False, hit, False] | np.r_[False, False, hit]).sum())
    return len(words), len(b"".join(words).decode("utf-8", "replace")), len(text) - len(text.translate(None, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeats


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [text_counts(x) for x in bytes_of(batch.column(1))]
        columns = list(zip(*rows, strict=True)) or [[]] * len(COUNTS)
        yield table_batch(["doc_id", "key", *COUNTS], [pa.int64()] * 8, [batch.column(0), batch.column(2), *columns])


def _statistics(docs: DataFrame) -> DataFrame:
    """quality_statistics() with the text_key of each row."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key("text").alias("key"))
    return _with_features(keyed.mapInArrow(_count_batches, T.StructType([T.StructField(c, T.LongType()) for c in ["doc_id", "key", *COUNTS]])))


def quality_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, COUNTS, base_failed and the forest's features, one row per input row."""
    return _statistics(docs).drop("key")


def _with_features(rows: DataFrame) -> DataFrame:
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return rows.withColumns({
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "f_word": share("word_chars", "n_words"),
        "f_symbols": share("n_symbols", "n_words"),
        "f_symbol_share": share("n_symbols", "word_chars"),
        "f_dup_lines": F.greatest(share("n_dup_lines", "n_lines") - MOST_DUP_LINES, F.lit(0.0)),
        "f_repeats": F.greatest(share("n_repeat_words", "n_words") - MOST_REPEATS, F.lit(0.0)),
    })


@dataclass
class IsolationForest:
    """Trees as arrays of (feature, split, left, right, path length at a leaf); feature -1 marks a leaf."""

    trees: list[tuple[np.ndarray, ...]]
    subsample: int

    @staticmethod
    def average_path(n: float) -> float:
        """Mean path length of an unsuccessful search among n points."""
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    @classmethod
    def fit(cls, x: np.ndarray, n_trees: int = 100, subsample: int = 256, seed: int = 7) -> IsolationForest:
        rng = np.random.default_rng(seed)
        subsample = min(subsample, len(x))
        limit = math.ceil(math.log2(max(subsample, 2)))

        def grow(rows: np.ndarray, depth: int, nodes: list[list[float]]) -> int:
            at = len(nodes)
            nodes.append([-1, 0.0, 0, 0, depth + cls.average_path(len(rows))])
            low, high = rows.min(axis=0), rows.max(axis=0)
            varied = np.flatnonzero(high > low)
            if depth < limit and len(rows) > 1 and len(varied):
                f = int(rng.choice(varied))
                split = rng.uniform(low[f], high[f])
                left = rows[:, f] < split
                if left.any() and not left.all():
                    nodes[at][:2] = [f, split]
                    nodes[at][2] = grow(rows[left], depth + 1, nodes)
                    nodes[at][3] = grow(rows[~left], depth + 1, nodes)
            return at

        trees = []
        for _ in range(n_trees if len(x) else 0):
            nodes: list[list[float]] = []
            grow(x[rng.choice(len(x), subsample, replace=False)], 0, nodes)
            columns = np.array(nodes).T
            trees.append((columns[0].astype(np.int64), columns[1], columns[2].astype(np.int64), columns[3].astype(np.int64), columns[4]))
        return cls(trees, subsample)

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / average path): near 1 for anomalies; 0.5 without trees."""
        if not self.trees or not len(x):
            return np.full(len(x), 0.5)
        total = np.zeros(len(x))
        for feature, split, left, right, path in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                i, node = np.flatnonzero(inner), at[inner]
                at[i] = np.where(x[i, feature[node]] < split[node], left[node], right[node])
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / max(self.average_path(self.subsample), 1e-9))


def fit_forest(stats: DataFrame, fit_rows: int = 8192, n_trees: int = 100, subsample: int = 256, seed: int = 7) -> IsolationForest:
    """Fits on at most fit_rows rows that pass the base rules: those of lowest seeded hash."""
    sample = stats.filter(~F.col("base_failed")).select("doc_id", *FEATURES).orderBy(pair_hash("doc_id", *FEATURES, seed=seed), "doc_id").limit(fit_rows)
    x = np.array([tuple(r)[1:] for r in sample.collect()], float).reshape(-1, len(FEATURES))
    return IsolationForest.fit(x, n_trees, subsample, seed)


def score_rows(stats: DataFrame, forest: IsolationForest) -> DataFrame:
    """Adds score, from 0 to 1; the forest is a few hundred kilobytes whatever the input."""
    names = stats.columns

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(names.index(f)).to_numpy(zero_copy_only=False) for f in FEATURES])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forest.score(x))], [*names, "score"])

    return stats.mapInArrow(scored, T.StructType([*stats.schema.fields, T.StructField("score", T.DoubleType())]))


def calibrate(scored: DataFrame, labels: DataFrame, good_loss: float = 0.005) -> float:
    """The score above which a row is rejected: of the thresholds that lose at most good_loss of the good labelled rows,
    the one with the largest excess of bad over good rows rejected; infinity if none rejects more bad rows than good."""
    bins = (
        scored.filter(~F.col("base_failed")).select("doc_id", F.floor(F.col("score") * BINS).cast("int").alias("bin"))
        .join(labels.select("doc_id", F.col("quality").cast("int").alias("quality")), "doc_id")
        .groupBy("bin").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
        .collect()
    )
    good, bad = np.zeros(BINS + 2), np.zeros(BINS + 2)
    for row in bins:
        good[row["bin"]], bad[row["bin"]] = row["good"], row["bad"]
    lost, caught = good[::-1].cumsum()[::-1], bad[::-1].cumsum()[::-1]
    gain = np.where(lost <= good_loss * good.sum(), caught / max(bad.sum(), 1) - lost / max(good.sum(), 1), -1)
    best = int(gain.argmax())
    return best / BINS if gain[best] > 0 else math.inf


def _judged(docs: DataFrame, labels: DataFrame, fit_rows: int = 8192, good_loss: float = 0.005, seed: int = 7) -> DataFrame:
    """judge() with the text_key of each row."""
    stats = materialise(_statistics(docs), "quality-statistics")
    scored = score_rows(stats, fit_forest(stats, fit_rows, seed=seed))
    threshold = calibrate(scored, labels, good_loss)
    release(docs.sparkSession)
    kept = ~F.col("base_failed") & (F.lit(True) if math.isinf(threshold) else F.col("score") < threshold)
    return scored.select("doc_id", "key", *COUNTS, "base_failed", "score", kept.alias("kept"))


def judge(docs: DataFrame, labels: DataFrame, fit_rows: int = 8192, good_loss: float = 0.005, seed: int = 7) -> DataFrame:
    """doc_id, COUNTS, base_failed, score and kept, one row per input row."""
    return _judged(docs, labels, fit_rows, good_loss, seed).drop("key")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns. Each row is judged by its own text, whatever others have its doc_id."""
    bad_id, bad_key = fresh_names(docs, "bad_id", "bad_key")
    bad = _judged(docs, labels).filter("not kept").select(F.col("doc_id").alias(bad_id), F.col("key").alias(bad_key)).distinct()
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(bad_id)) & (text_key("text") == F.col(bad_key)), "left_anti")
