"""The tables behind the figures of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import cn_major_minor, cn_total, logr_to_cn
from .aggregates import coverage_normalised
from .calls import average_states
from .intervals import assign_points_to_intervals, segment_at_position
from .windows import KEYS, running_median, running_medians


def coverage_track(counts: DataFrame, k: int = 101, step: int = 100) -> DataFrame:
    """Normalised depths, smoothed and thinned."""
    return running_medians(coverage_normalised(counts), {"tumour_smooth": "tumour", "normal_smooth": "normal"}, k, step=step)


def total_cn_track(profile: DataFrame, logr: DataFrame, fit: DataFrame, k: int = 101) -> DataFrame:
    """Total copies by locus: smoothed LogR under the fit's ploidy, and the state of its segment."""
    rows = running_median(logr.select(*KEYS, "pos", "logr"), "logr", k, out="smooth").join(fit.select("sample_id", "rho", "psi"), "sample_id")
    rows = rows.withColumn("cn", logr_to_cn("rho", F.col("rho") * F.col("psi") + 2 * (1 - F.col("rho")), "smooth"))
    return assign_points_to_intervals(rows, profile.select(*KEYS, "start_pos", "end_pos", cn_total().alias("state_cn"))).select(*KEYS, "pos", "smooth", "cn", "state_cn")


def allele_ratio_track(baf_segmented: DataFrame, logr_segmented: DataFrame, step: int = 100, k: int = 101) -> DataFrame:
    """Coverage ratio by allele, from segmented BAF and LogR, and the smoothed ratio itself."""
    rows = baf_segmented.select(*KEYS, "pos", "baf_seg", "logr").join(logr_segmented.select(*KEYS, "pos", "logr_seg"), [*KEYS, "pos"])
    ratio = F.pow(F.lit(2.0), F.col("logr_seg"))
    rows = rows.withColumns({"major_ratio": F.col("baf_seg") * ratio, "minor_ratio": (1 - F.col("baf_seg")) * ratio, "ratio": F.exp("logr")})
    return running_medians(rows, {"ratio_smooth": "ratio"}, k, step=step)


def square_plot_points(profile: DataFrame, rho_psi: DataFrame, chrom: str, pos: int, gamma: float = 1.0) -> DataFrame:
    """The exact copies of one segment, and its states."""
    seg = segment_at_position(profile, chrom, pos).join(rho_psi.select("sample_id", "rho", "psi"), "sample_id")
    x, y = cn_major_minor("baf", "logr", "rho", F.col("rho") * F.col("psi") + 2 * (1 - F.col("rho")), gamma)
    exact = seg.select("sample_id", F.lit("exact").alias("kind"), x.alias("n_maj"), y.alias("n_min"), F.lit(1.0).alias("share"))
    first = seg.select("sample_id", F.lit("state 1"), "nMaj1", "nMin1", "frac1")
    second = seg.filter("nMaj2 is not null").select("sample_id", F.lit("state 2"), "nMaj2", "nMin2", "frac2")
    return exact.union(first).union(second)


def score_surface(scored: DataFrame, raw: bool = False) -> DataFrame:
    """The grid with its log score (raw for the log ratio) and a mark on the best point."""
    best = scored.groupBy("sample_id").agg(F.max("score").alias("_b"))
    height = F.col("score") if raw else F.when(F.col("score") > 0, F.ln("score"))
    return scored.join(best, "sample_id").select("sample_id", "i", "j", "psi", "rho", height.alias("height"), (F.col("score") == F.col("_b")).alias("is_best"))


def profile_lines(profile: DataFrame, loci: DataFrame) -> DataFrame:
    """First and last locus number of each segment, in order of the genome, with average and total heights."""
    number = F.try_to_number("chrom", F.lit("99")).cast("int")
    counts = loci.groupBy(*KEYS).agg(F.count("*").alias("_n"))
    start = counts.withColumn("_start", F.sum("_n").over(Window.partitionBy("sample_id").orderBy(number)) - F.col("_n"))
    numbered = loci.select(*KEYS, "pos").withColumn("_k", F.row_number().over(Window.partitionBy(*KEYS).orderBy("pos"))).join(start, KEYS).withColumn("locus", F.col("_start") + F.col("_k"))
    key = [*KEYS, "start_pos", "end_pos"]
    bounds = assign_points_to_intervals(numbered.select(*KEYS, "pos", "locus"), profile.select(*key),
        closed="right").groupBy(*key).agg(F.min("locus").alias("first_locus"), F.max("locus").alias("last_locus"))
    return average_states(profile).join(bounds, key).select(*key, "first_locus", "last_locus", "avg_major", "avg_minor", cn_total().alias("total_cn"))


def haplotype_band_points(df: DataFrame) -> DataFrame:
    """BAF and its mirror, and on which side the first haplotype lies."""
    return df.select(*KEYS, "pos", "baf", (1 - F.col("baf")).alias("mirror"), (F.col("baf") > 0.5).alias("upper"))


def segment_band_points(df: DataFrame) -> DataFrame:
    return df.select(*KEYS, "pos", "baf_phased", (1 - F.col("baf_phased")).alias("mirror"), "baf_seg", (1 - F.col("baf_seg")).alias("seg_mirror"))
