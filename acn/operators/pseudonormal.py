"""Samples without a matched normal: long stretches without hets, and counts of a made-up normal for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.schemas import ACROCENTRIC
from .intervals import assign_points_to_intervals, centromere_exclusion
from .loci import COUNTS, LOCUS
from .segmentation import segment_logr
from .windows import KEYS, inter_het_distance, run_islands

NORMAL_DENSITY = 1e-4  # hets a base of a chromosome without loss, at least
HETEROCHROMATIN = 100_000  # bases behind the centromere
# What differs between the two kinds of input.
MODES = {"cell_line": {"min_gap": 1e5, "option": 1}, "germline": {"min_gap": 2e3, "option": 1}}


def with_arm(df: DataFrame, geometry: DataFrame) -> DataFrame:
    """Loci outside the centromere, with their arm."""
    joined = df.join(F.broadcast(geometry.select("chrom", "cen_left", "cen_right")), "chrom")
    arm = F.when(F.col("pos") <= F.col("cen_left"), "p").when(F.col("pos") >= F.col("cen_right"), "q")
    return joined.withColumn("arm", arm).filter("arm is not null").drop("cen_left", "cen_right")


def _runs(fitted: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Runs of equal fit: start_pos, end_pos, n and level, the mean of value."""
    runs = run_islands(fitted, "fit", keys=keys)
    bounds = F.min("pos").alias("start_pos"), F.max("pos").alias("end_pos"), F.count("*").alias("n"), F.avg(value).alias("level")
    return runs.groupBy(*keys, "run_id").agg(*bounds).drop("run_id")


def loh_by_het_gaps(hets: DataFrame, geometry: DataFrame, gamma: float = 1e5, kmin: int = 50, min_level: float = 0.001, min_snps: int = 2, dist: float = 5e5) -> DataFrame:
    """Segments of the scaled gap between hets by arm, farther than dist from the centromere; those of a mean above min_level are without
    heterozygosity. The column decision tells a whole lost chromosome (mean gap above 1% of the largest, fewer hets than NORMAL_DENSITY)
    from a partial loss. A chromosome whose regions span 90% of its hets at more than that density has lost nothing: it has no rows."""
    near = centromere_exclusion(inter_het_distance(hets), geometry, dist)
    span = F.col("_span")
    whole = (F.col("_gap") > 0.01) & (F.col("_n") < NORMAL_DENSITY * span)
    of_chrom = near.groupBy(*KEYS).agg(F.count("*").alias("_n"), (F.max("pos") - F.min("pos")).alias("_span"), F.avg("scaled_gap").alias("_gap"))
    segs = _runs(segment_logr(with_arm(near, geometry), "scaled_gap", gamma, kmin), "scaled_gap", [*KEYS, "arm"])
    segs = segs.filter((F.round("level", 3) > min_level) & (F.col("n") >= min_snps))
    covered = segs.groupBy(*KEYS).agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("_covered"))
    none = ~whole & (F.col("_covered") >= 0.9 * span) & (F.col("_n") > NORMAL_DENSITY * span)
    decided = of_chrom.join(covered, KEYS).filter(~none).select(*KEYS, F.when(whole, "whole").otherwise("partial").alias("decision"))
    return segs.join(decided, KEYS)


def loh_noise_filter(loh: DataFrame, geometry: DataFrame, max_size: float = 1e6) -> DataFrame:
    """Drops short regions that touch the centromere, longer ones that begin in the heterochromatin behind the centromeres of 1, 9 and 16,
    and all of the short arm of acrocentric chromosomes."""
    joined = loh.join(F.broadcast(geometry.select("chrom", "cen_left", "cen_right")), "chrom")
    touches = (F.col("start_pos") <= F.col("cen_right")) & (F.col("end_pos") >= F.col("cen_left"))
    size = F.col("end_pos") - F.col("start_pos")
    behind = (F.col("start_pos") > F.col("cen_left")) & (F.col("start_pos") < F.col("cen_right") + HETEROCHROMATIN)
    dense = F.col("chrom").isin("1", "9", "16") & behind & (size > max_size)
    short_arm = F.col("chrom").isin(ACROCENTRIC) & (F.col("end_pos") <= F.col("cen_left"))
    return joined.filter(~(touches & (size < max_size)) & ~dense & ~short_arm).select(*loh.columns)


def _loci_per_base(logr: DataFrame, geometry: DataFrame) -> DataFrame:
    """sample_id, _rate: a sample's loci by base of both arms of all chromosomes."""
    arms = F.sum(F.col("cen_left") - F.col("start_pos") + F.col("end_pos") - F.col("cen_right"))
    total = F.broadcast(geometry.agg(arms.alias("_bases"), F.lit(1).alias("_one")))  # one row
    return logr.groupBy("sample_id").agg(F.count("*").alias("_loci"), F.lit(1).alias("_one")).join(total, "_one").select("sample_id", (F.col("_loci") / F.col("_bases")).alias("_rate"))


def loh_by_logr_windows(hets: DataFrame, logr: DataFrame, loh: DataFrame, geometry: DataFrame, min_gap: float | None = None, gamma: float = 100, kmin: int = 5,
    low: float = -0.8, min_density: float = 0.5, min_snps: int = 10, mode: str = "cell_line", dist: float = 5e5) -> DataFrame:
    """Losses in what loh leaves, outside short arms of acrocentric chromosomes: each gap between neighbouring hets of min_gap or more, whose
    density of LogR loci is more than min_density times the sample's own, is segmented by itself. Cell lines need a mean and a median below
    low first. A loss goes from the first to the last run below low and holds min_snps loci; level is the mean of its runs' levels."""
    min_gap = MODES[mode]["min_gap"] if min_gap is None else min_gap
    w = Window.partitionBy(*KEYS).orderBy("pos")
    gaps = hets.select(*KEYS, "pos", F.lead("pos").over(w).alias("_end")).filter(F.col("_end") - F.col("pos") >= min_gap)
    gaps = with_arm(centromere_exclusion(gaps, geometry, dist), geometry).filter(~((F.col("arm") == "p") & F.col("chrom").isin(ACROCENTRIC)))
    lost = assign_points_to_intervals(gaps.select(*KEYS, "pos"), loh.select(*KEYS, "start_pos", "end_pos")).select(*KEYS, "pos")
    gaps = gaps.join(lost, [*KEYS, "pos"], "left_anti").select(*KEYS, "arm", (F.col("pos") + 1).alias("start_pos"), (F.col("_end") - 1).alias("end_pos"))
    points = assign_points_to_intervals(logr.select(*KEYS, "pos", "logr"), gaps)
    gap = [*KEYS, "arm", "start_pos", "end_pos"]
    of_gap = points.groupBy(*gap).agg(F.count("*").alias("_n"), F.avg("logr").alias("_mean"), F.percentile("logr", F.lit(0.5)).alias("_median"))
    of_gap = of_gap.join(_loci_per_base(logr, geometry), "sample_id").withColumn("density", F.col("_n") / (F.col("_rate") * (F.col("end_pos") - F.col("start_pos") + 2)))
    good = F.col("density") > min_density
    good = good & (F.col("_mean") < low) & (F.col("_median") < low) if mode == "cell_line" else good
    chosen = points.join(of_gap.filter(good).select(*gap, "density"), gap)
    own = chosen.withColumn("arm", F.concat_ws(":", "arm", "start_pos"))  # each gap is segmented by itself
    runs = _runs(segment_logr(own.select(*KEYS, "arm", "pos", "logr", "density"), "logr", gamma, kmin), "logr", [*KEYS, "arm"]).filter(F.col("level") < low)
    found = runs.groupBy(*KEYS, "arm").agg(F.min("start_pos").alias("_from"), F.max("end_pos").alias("_to"), F.avg("level").alias("level"))
    inside = own.join(found, [*KEYS, "arm"]).filter(F.col("pos").between(F.col("_from"), F.col("_to")))
    whole = inside.groupBy(*KEYS, "arm").agg(F.first("_from").alias("start_pos"), F.first("_to").alias("end_pos"), F.count("*").alias("n"),
        F.first("level").alias("level"), F.first("density").alias("density"))
    return whole.filter(F.col("n") >= min_snps).withColumn("arm", F.substring_index("arm", ":", 1))


def drop_undepleted(loh: DataFrame, logr: DataFrame, geometry: DataFrame, low: float = -0.8, min_density: float = 0.5) -> DataFrame:
    """Regions of loh with a mean LogR of at most low and at least min_density times the sample's density of loci."""
    region = [*KEYS, "start_pos", "end_pos"]
    seen = assign_points_to_intervals(logr.select(*KEYS, "pos", "logr"), loh.select(*region)).groupBy(*region).agg(F.count("*").alias("_n"), F.avg("logr").alias("_mean"))
    seen = seen.join(_loci_per_base(logr, geometry), "sample_id")
    dense = F.col("_n") >= min_density * F.col("_rate") * (F.col("end_pos") - F.col("start_pos"))
    return loh.join(seen.filter((F.col("_mean") <= low) & dense).select(*region), region, "left_semi")


def pseudo_normal_counts(counts: DataFrame, alleles: DataFrame, loh: DataFrame, step: int = 10, min_depth: int = 0, spike_ends: bool = False) -> DataFrame:
    """Counts in which every step-th locus of each region is a balanced het: its depth is split between both alleles, the odd read to the first.
    Regions are disjoint; loci outside them, and the others inside, keep their counts."""
    rows = counts.join(alleles, LOCUS, "left")
    inside = assign_points_to_intervals(rows.select("sample_id", *LOCUS), loh.select(*KEYS, "start_pos", "end_pos"))
    w = Window.partitionBy(*KEYS, "start_pos").orderBy("pos")
    n = F.row_number().over(w)
    last = F.count("*").over(Window.partitionBy(*KEYS, "start_pos"))
    chosen = inside.withColumns({"_n": n, "_last": last})
    pick = F.col("_n") % step == 1 % step
    pick = pick | (F.col("_n") == F.col("_last")) if spike_ends else pick
    rows = rows.join(chosen.filter(pick).select("sample_id", *LOCUS, F.lit(True).alias("_spike")), ["sample_id", *LOCUS], "left")
    depth = sum((F.col(c) for c in COUNTS[1:]), F.col(COUNTS[0]))
    spike = F.coalesce("_spike", F.lit(False)) & F.col("a0").isNotNull() & (depth >= min_depth)
    new = {c: F.when(spike, F.when(F.col("a0") == i, F.ceil(depth / 2)).when(F.col("a1") == i, F.floor(depth / 2)).otherwise(0)).otherwise(F.col(c)).cast("int") for i, c in enumerate(COUNTS, 1)}
    return rows.select("sample_id", *LOCUS, *(v.alias(c) for c, v in new.items()), spike.alias("spiked"))
