"""Mixing sources to target weights by capped water-filling.

Sources share a budget of words by weight. A source is clamped at `max_epochs` times its size; what it can't use goes to
the others in proportion to their weights, until none is above its clamp. With r = clamp / weight in ascending order, the
clamped sources are a prefix of that order, so prefix sums over the table of sources give the water level at once.

A source with target f times its size repeats each document floor(f) times. The rest of the target is taken as whole
documents in a seeded order (md5 of seed and doc_id), up to the last document whose middle lies inside it: each source ends
within half a document of its target. The order is cut in 4096 hash buckets, whose sums are pre-aggregated; only the bucket
in which the target ends is numbered row by row, so no source, however hot, passes one task.

Defined results: null text or source counts as size 0 and as a source of its own, last in order; rows equal in doc_id,
source and size stand or fall together; an empty table gives an empty one; further columns are kept by mix().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import WORD, fresh_names, materialise

KEY = ["doc_id", "source", "size"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """source, source_size -> with weight 1 .. cycle, repeating in order of code points, null last."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    return sources.withColumn("weight", ((F.row_number().over(order) - 1) % cycle + 1).cast("double"))


def water_fill(sources: DataFrame, max_epochs: float = 3.0, budget_share: float = 1.0) -> DataFrame:
    """source, source_size, weight -> with target. One row per source: the only table that is ordered as a whole."""
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    levels = (
        sources.withColumn("cap", max_epochs * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("budget", budget_share * F.sum("source_size").over(everything))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        .withColumn("water", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(everything)["level"])
    )
    return levels.select("source", "source_size", "weight", F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("water") * F.col("weight"))).alias("target"))


def decide(docs: DataFrame, weights=cyclic_weights, max_epochs: float = 3.0, seed: int = 20, budget_share: float = 1.0) -> DataFrame:
    """doc_id, source, size, copies (rows like it), source_size, target, repeats (of each such row): one row for each KEY."""
    rows = materialise(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"))
        .groupBy(*KEY).agg(F.count("*").alias("copies"))
        .withColumn("draw", F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
        .withColumn("bucket", F.substring("draw", 1, 3)),
        "mix-sizes",
    )
    totals = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    plan = materialise(
        water_fill(weights(totals), max_epochs, budget_share)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + F.lit(1e-12))).otherwise(0).cast("long"))
        .withColumn("rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))),
        "mix-plan",
    )
    per_bucket = rows.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("copies")).alias("bucket_size"))
    start = per_bucket.withColumn("start", F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket")) - F.col("bucket_size"))
    near = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    plan, start = plan.withColumnRenamed("source", "s1"), start.withColumnRenamed("source", "s2").withColumnRenamed("bucket", "b2")
    placed = rows.join(start, near("source", "s2") & (F.col("bucket") == F.col("b2"))).join(plan, near("source", "s1")).drop("s1", "s2", "b2")
    ends_here = (F.col("start") <= F.col("rest")) & (F.col("rest") < F.col("start") + F.col("bucket_size"))
    amount = F.col("size") * F.col("copies")
    order = Window.partitionBy("source").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("start") + F.coalesce(F.sum(amount).over(order), F.lit(0)) + amount / 2
    last = placed.filter(ends_here).withColumn("more", ((F.col("size") > 0) & (middle < F.col("rest"))).cast("long"))
    others = placed.filter(~ends_here).withColumn("more", ((F.col("size") > 0) & (F.col("start") + F.col("bucket_size") <= F.col("rest"))).cast("long"))
    return others.unionByName(last).select(*KEY, "copies", "source_size", "target", (F.col("whole") + F.col("more")).alias("repeats"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs with each row repeated as often as the mix takes it; rows it doesn't take go."""
    own_id, own_source, own_size, repeats, number = fresh_names(docs, "own_id", "own_source", "own_size", "repeats", "number")
    plan = decide(docs, **options).filter("repeats > 0").select(*(F.col(c).alias(name) for c, name in zip([*KEY, "repeats"], (own_id, own_source, own_size, repeats), strict=True)))
    on = F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)) & F.col("source").cast("string").eqNullSafe(F.col(own_source))
    return (
        docs.join(plan, on & (word_count(F.col("text").cast("string")) == F.col(own_size)))
        .withColumn(number, F.explode(F.sequence(F.lit(1).cast("long"), F.col(repeats)))).select(*docs.columns)
    )


ORACLE = r"""
with d as (select doc_id, source, cast(case when text is null then 0 else len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) end as bigint) size from documents),
s as (select source, sum(size) source_size from d group by source),
w as (select *, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::double weight, 3.0::double * source_size cap from s),
l as (select *, cap / weight ratio, (sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0.0))
        / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) level from w),
t as (select *, case when (select count(*) from l where ratio > level) = 0 then cap
        else least(cap, weight * (select level from l where ratio > level order by ratio, level limit 1)) end target from l),
p as (select source, source_size, target, case when source_size > 0 then floor(target / source_size + 1e-12) else 0 end whole from t),
q as (select d.doc_id, d.size, p.source_size, p.target, p.whole, greatest(p.target - p.whole * p.source_size, 0.0) rest,
        coalesce(sum(d.size) over (partition by d.source order by md5('20|' || d.doc_id), d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0) start
      from d join p on d.source is not distinct from p.source)
select doc_id, size, cast(source_size as bigint) source_size, target, cast(size * (whole + case when start + size / 2.0 < rest then 1 else 0 end) as bigint) taken from q
"""
