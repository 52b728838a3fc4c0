"""Joins and set operations of closed intervals (chrom, start_pos, end_pos)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BIN = 1_000_000
#: Pieces of intervals, one a bin, that are counted and no more than this are sent to every task; beyond it, both sides are dealt by bin.
FEW = 50_000


def _bins(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    return df.withColumn("_bin", F.explode(F.sequence((F.col(start) / width).cast("bigint"), (F.col(end) / width).cast("bigint"))))


def assign_points_to_intervals(points: DataFrame, intervals: DataFrame, keys=("sample_id", "chrom"), closed: str = "both", strategy: str | None = None, bin_width: int = BIN) -> DataFrame:
    """points with the columns of each interval that holds them. closed="right" leaves the start out. Intervals are cut in bins, so that a
    point meets those of its own bin in an equi-join. Without a strategy the pieces are counted: few are sent to every task."""
    keys = list(keys)
    pieces = _bins(intervals, "start_pos", "end_pos", bin_width)
    strategy = strategy or ("broadcast" if pieces.count() <= FEW else "bins")
    inside = (F.col("pos") >= F.col("start_pos") if closed == "both" else F.col("pos") > F.col("start_pos")) & (F.col("pos") <= F.col("end_pos"))
    binned = points.withColumn("_bin", (F.col("pos") / bin_width).cast("bigint"))
    return binned.join(F.broadcast(pieces) if strategy == "broadcast" else pieces, [*keys, "_bin"]).filter(inside).drop("_bin")


def interval_overlap(a: DataFrame, b: DataFrame, keys=("chrom",), bin_width: int = BIN) -> DataFrame:
    """Pairs that share a base; b's columns other than the keys are prefixed with b_. A pair is given in the first bin that both reach."""
    keys = list(keys)
    other = b.select(*keys, *(F.col(c).alias(f"b_{c}") for c in b.columns if c not in keys))
    both = _bins(a, "start_pos", "end_pos", bin_width).join(_bins(other, "b_start_pos", "b_end_pos", bin_width), [*keys, "_bin"])
    first = F.greatest((F.col("start_pos") / bin_width).cast("bigint"), (F.col("b_start_pos") / bin_width).cast("bigint"))
    return both.filter((F.col("start_pos") <= F.col("b_end_pos")) & (F.col("b_start_pos") <= F.col("end_pos")) & (F.col("_bin") == first)).drop("_bin")


def interval_disjoin(iv: DataFrame, keys=("chrom",), bin_width: int = BIN) -> DataFrame:
    """The pieces between neighbouring boundaries that some interval covers: a sweep over +1 at starts and -1 behind ends, in two levels. The
    sums of bins are swept first, a row a bin, then each bin's boundaries from what it takes over, so that no task sweeps a chromosome."""
    keys = list(keys)
    edges = iv.select(*keys, F.col("start_pos").alias("at"), F.lit(1).alias("d")).union(iv.select(*keys, F.col("end_pos") + 1, F.lit(-1)))
    points = edges.groupBy(*keys, "at").agg(F.sum("d").alias("d")).withColumn("_bin", (F.col("at") / bin_width).cast("bigint"))
    along = Window.partitionBy(*keys).orderBy("_bin")
    before = F.sum("_d").over(along.rowsBetween(Window.unboundedPreceding, -1))
    bins = points.groupBy(*keys, "_bin").agg(F.sum("d").alias("_d"), F.min("at").alias("_first"))
    taken_over = bins.select(*keys, "_bin", F.coalesce(before, F.lit(0)).alias("_open"), F.lead("_first").over(along).alias("_later"))
    w = Window.partitionBy(*keys, "_bin").orderBy("at")
    swept = points.join(taken_over, [*keys, "_bin"]).withColumns({"depth": F.col("_open") + F.sum("d").over(w), "next": F.coalesce(F.lead("at").over(w), "_later")})
    return swept.filter("depth > 0 and next is not null").select(*keys, F.col("at").alias("start_pos"), (F.col("next") - 1).alias("end_pos"), "depth")


def interval_count_overlaps(a: DataFrame, b: DataFrame, keys=("chrom",), least: int = 1) -> DataFrame:
    """a's distinct intervals with the number of b's that overlap them, at least `least`."""
    keys = list(keys)
    pieces = a.select(*keys, "start_pos", "end_pos").distinct()
    pairs = interval_overlap(pieces, b.select(*keys, "start_pos", "end_pos"), keys)
    return pairs.groupBy(*keys, "start_pos", "end_pos").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def nearest_of(target: str, keys=("sample_id", "chrom")) -> Callable[[DataFrame], DataFrame]:
    """Adds _n to rows: of the structs in a column of targets, each with its pos, null in rows that are none, the one nearest to the row; ties go
    left. Two running sorts, one each way, of which the last leaves rows in order of position."""
    order = Window.partitionBy(*keys).orderBy("pos", F.col(target).isNull())
    turned = Window.partitionBy(*keys).orderBy(F.desc("pos"), F.col(target).isNull().desc())
    running = lambda w: F.last(target, True).over(w.rowsBetween(Window.unboundedPreceding, 0))  # noqa: E731  a frame that only grows at its end
    left = F.col("_a").isNull() | (F.col("_b").isNotNull() & (F.col("pos") - F.col("_b.pos") <= F.col("_a.pos") - F.col("pos")))
    best = F.when(left, F.col("_b")).otherwise(F.col("_a"))
    return lambda df: df.withColumn("_a", running(turned)).withColumn("_b", running(order)).withColumn("_n", best).drop("_a", "_b")


def nearest_join(points: DataFrame, targets: DataFrame, cols: list[str], keys=("sample_id", "chrom")) -> DataFrame:
    """points with near_pos and cols of the nearest target; ties go left. Two running sorts over both tables, one each way, no pairs."""
    keys = list(keys)
    own = F.struct("pos", *cols)
    both = points.select(*keys, "pos", F.struct(*points.columns).alias("_p"), F.lit(None).cast(targets.select(own.alias("t")).schema["t"].dataType).alias("_t")).unionByName(
        targets.select(*keys, "pos", F.lit(None).cast(points.select(F.struct(*points.columns).alias("p")).schema["p"].dataType).alias("_p"), own.alias("_t"))
    )
    near = nearest_of("_t", keys)
    return near(both).filter("_p is not null").select("_p.*", F.col("_n.pos").alias("near_pos"), *(F.col(f"_n.{c}").alias(c) for c in cols))


def segment_at_position(segments: DataFrame, chrom: str, pos: int) -> DataFrame:
    return segments.filter((F.col("chrom") == chrom) & (F.col("start_pos") <= pos) & (F.col("end_pos") >= pos))


def centromere_exclusion(df: DataFrame, geometry: DataFrame, dist: float = 5e5) -> DataFrame:
    """Points inside the covered range and farther than dist from the centromere. geometry has one row per chromosome."""
    joined = df.join(F.broadcast(geometry.select("chrom", F.col("start_pos").alias("_s"), "cen_left", "cen_right", F.col("end_pos").alias("_e"))), "chrom")
    inside = F.col("pos").between(F.col("_s"), F.col("_e"))
    return joined.filter(inside & ((F.col("pos") < F.col("cen_left") - dist) | (F.col("pos") > F.col("cen_right") + dist))).select(*df.columns)


def interval_merge_adjacent(iv: DataFrame, keys=("sample_id", "chrom", "arm")) -> DataFrame:
    """Union of intervals that overlap or touch."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("start_pos", "end_pos")
    reach = F.max("end_pos").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = iv.withColumn("_new", (reach.isNull() | (F.col("start_pos") > reach + 1)).cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "_run").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.count("*").alias("n")).drop("_run")


def arm_bounds(geometry: DataFrame) -> DataFrame:
    """chrom, arm, arm_start, arm_end: up to the centromere, and behind it."""
    p = geometry.select("chrom", F.lit("p").alias("arm"), F.col("start_pos").alias("arm_start"), F.col("cen_left").alias("arm_end"))
    return p.union(geometry.select("chrom", F.lit("q"), "cen_right", "end_pos"))


def split_by_arm(iv: DataFrame, geometry: DataFrame) -> DataFrame:
    """Intervals cut at the centromere; what lies in it or outside the chromosome's bounds goes."""
    cut = iv.join(F.broadcast(arm_bounds(geometry)), "chrom")
    cut = cut.withColumns({"start_pos": F.greatest("start_pos", "arm_start"), "end_pos": F.least("end_pos", "arm_end")})
    return cut.filter("start_pos <= end_pos").select(*iv.columns, "arm")


def complement_intervals(iv: DataFrame, geometry: DataFrame) -> DataFrame:
    """What merged intervals (sample_id, chrom, arm) leave of each arm; whole arms where a sample has none in it."""
    samples = iv.select("sample_id").distinct()
    arms = arm_bounds(geometry).join(samples, how="cross")
    edges = iv.select("sample_id", "chrom", "arm", "start_pos", "end_pos").unionByName(
        arms.select("sample_id", "chrom", "arm", (F.col("arm_start") - 1).alias("start_pos"), (F.col("arm_start") - 1).alias("end_pos"))
    )
    w = Window.partitionBy("sample_id", "chrom", "arm").orderBy("start_pos")
    gaps = edges.withColumn("_next", F.lead("start_pos").over(w)).join(F.broadcast(arm_bounds(geometry)), ["chrom", "arm"])
    return (
        gaps.select("sample_id", "chrom", "arm", (F.col("end_pos") + 1).alias("start_pos"), F.coalesce(F.col("_next") - 1, F.col("arm_end")).alias("end_pos"))
        .filter("start_pos <= end_pos")
    )
