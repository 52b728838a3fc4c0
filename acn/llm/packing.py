"""Packing documents into token-budget batches with optimal length buckets.

Documents longer than max_length are cut into pieces of max_length words and a rest, so every word is packed. The global
histogram of piece lengths has at most max_length cells; dynamic programming over it chooses the bucket boundaries whose
total padding is least. A bucket of length L takes floor(token_budget / L) pieces a batch, in a seeded order. Pieces get
dense numbers inside a bucket from counts per hash shard, so a bucket with most of the rows is never ordered in one task.

Defined results: a document without words keeps one row, with n_tokens 0 and null bucket, batch and slot; repeated rows are
packed as often as they occur; an empty table gives an empty one; further columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialise, pair_hash
from .mixing import word_count

SHARDS = 4096


def optimal_boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """Upper lengths of at most `buckets` buckets that minimise sum(count * (upper - length)); ties: the fewest buckets."""
    lengths = np.array(sorted(histogram), np.int64)
    if not len(lengths):
        return []
    counts = np.array([histogram[x] for x in lengths.tolist()], np.int64)
    n = len(lengths)
    number, words = np.r_[0, counts.cumsum()], np.r_[0, (counts * lengths).cumsum()]
    best = lengths * number[1:] - words[1:]  # one bucket up to each length
    cuts: list[np.ndarray] = []
    for _ in range(1, min(buckets, n)):
        more, cut = best.copy(), np.full(n, -1)
        for j in range(1, n):
            cost = best[:j] + lengths[j] * (number[j + 1] - number[1 : j + 1]) - (words[j + 1] - words[1 : j + 1])
            k = int(cost.argmin())
            if cost[k] < more[j]:
                more[j], cut[j] = cost[k], k
        cuts.append(cut)
        if more[-1] == best[-1]:
            break
        best = more
    out, j = [int(lengths[-1])], n - 1
    for cut in reversed(cuts):
        if cut[j] >= 0:
            j = int(cut[j])
            out.append(int(lengths[j]))
    return out[::-1]


def pieces(docs: DataFrame, length: Column | None = None, max_length: int = 2048) -> DataFrame:
    """doc_id, piece, first_token, n_tokens: the whole document in pieces of max_length tokens at most."""
    n = F.col("_n")
    size = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (word_count(F.col("text").cast("string")) if length is None else length.cast("long")).alias("_n"))
    cut = size.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.floor((n - 1) / max_length), F.lit(0)).cast("long"))))
    return cut.select("doc_id", "piece", (F.col("piece") * max_length).alias("first_token"), F.least(n - F.col("piece") * max_length, F.lit(max_length)).cast("long").alias("n_tokens"))


def pack(docs: DataFrame, length: Column | None = None, max_length: int = 2048, buckets: int = 16, token_budget: int = 65536, seed: int = 1) -> DataFrame:
    """doc_id, piece, first_token, n_tokens, bucket (its padded length), batch and slot, one row per piece."""
    if token_budget < max_length:
        raise ValueError("token_budget must hold one piece of max_length")
    rows = materialise(pieces(docs, length, max_length), "pack-pieces")
    histogram = {r["n_tokens"]: r["count"] for r in rows.filter("n_tokens > 0").groupBy("n_tokens").count().collect()}  # max_length cells at most
    bounds = optimal_boundaries(histogram, buckets)
    bucket = F.element_at(F.filter(F.array(*map(F.lit, bounds)), lambda b: b >= F.col("n_tokens")), 1) if bounds else F.lit(None)
    keyed = rows.filter("n_tokens > 0").withColumn("bucket", bucket.cast("long")).withColumn("_draw", pair_hash("doc_id", "piece", seed=seed)).withColumn("_shard", F.pmod("_draw", F.lit(SHARDS)))
    counts = keyed.groupBy("bucket", "_shard").agg(F.count("*").alias("_count"))
    before = counts.withColumn("_before", F.sum("_count").over(Window.partitionBy("bucket").orderBy("_shard")) - F.col("_count")).drop("_count")
    number = F.row_number().over(Window.partitionBy("bucket", "_shard").orderBy("_draw", "doc_id", "piece")) - 1 + F.col("_before")
    per_batch = F.floor(F.lit(token_budget) / F.col("bucket"))
    placed = keyed.join(before, ["bucket", "_shard"]).withColumn("_at", number)
    columns = ["doc_id", "piece", "first_token", "n_tokens", "bucket"]
    packed = placed.select(*columns, F.floor(F.col("_at") / per_batch).cast("long").alias("batch"), (F.col("_at") % per_batch).cast("long").alias("slot"))
    empty = rows.filter("n_tokens = 0").select(*columns[:4], *(F.lit(None).cast("long").alias(c) for c in ("bucket", "batch", "slot")))
    return packed.unionByName(empty)
