"""Aggregates over loci and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import cn_total, div
from ..storage import materialise
from .loci import match_counts, min_depth_filter, pick_allele_counts
from .windows import run_islands


def allele_choice() -> Column:
    """0 or 1 from the key's md5: the random allele of each locus, alike in every run and engine."""
    first = F.substring(F.md5(F.concat_ws("|", "sample_id", "chrom", F.col("pos").cast("string"))), 1, 1)
    return F.call_function("instr", F.lit("0123456789abcdef"), first) % 2


def baf_logr(tumour: DataFrame, normal: DataFrame, alleles: DataFrame, min_normal: int | None = 10) -> DataFrame:
    """BAF of a random allele in tumour and normal, and LogR of the coverage ratio against its mean over the sample.

    The mean is an aggregate joined back, so that no sample passes one task; ratios are written first, for both would match all counts."""
    kept = min_depth_filter(match_counts(tumour, normal, alleles), min_normal)
    t, n = F.col("t1") + F.col("t2"), F.col("n1") + F.col("n2")
    one = allele_choice() == 1
    rows = kept.select("sample_id", "chrom", "pos", div(F.when(one, F.col("t1")).otherwise(F.col("t2")), t).alias("baf"),
        div(F.when(one, F.col("n1")).otherwise(F.col("n2")), n).alias("normal_baf"), div(t, n).alias("ratio"))
    rows = materialise(rows, "ratios")
    means = rows.groupBy("sample_id").agg(F.avg("ratio").alias("mean_ratio"))
    return rows.join(means, "sample_id").select("sample_id", "chrom", "pos", "baf", "normal_baf", F.when(F.col("ratio") > 0, F.log2(F.col("ratio") / F.col("mean_ratio"))).alias("logr"))


def baf_logr_unpaired(counts: DataFrame, alleles: DataFrame) -> DataFrame:
    """BAF as alt over depth, and LogR of depth against its mean over the sample; loci without coverage go."""
    rows = pick_allele_counts(counts, alleles).filter("depth > 0")
    means = rows.groupBy("sample_id").agg(F.avg("depth").alias("mean_depth"))
    return rows.join(means, "sample_id").select("sample_id", "chrom", "pos", "depth", (F.col("alt") / F.col("depth")).alias("baf"), F.log2(F.col("depth") / F.col("mean_depth")).alias("logr"))


def covariate_correlations(df: DataFrame, covariates: list[str], value: str = "logr") -> DataFrame:
    """sample_id, covariate, r: absolute correlation with the value, over rows with all covariates; null where a column is constant."""
    whole = df.dropna(subset=[value, *covariates])
    def corr(c: str) -> Column:
        return F.when((F.stddev_pop(c) > 0) & (F.stddev_pop(value) > 0), F.abs(F.try_divide(F.covar_pop(c, value), F.stddev_pop(c) * F.stddev_pop(value))))
    wide = whole.groupBy("sample_id").agg(*(corr(c).alias(c) for c in covariates))
    pairs = ", ".join(f"'{c}', {c}" for c in covariates)
    return wide.selectExpr("sample_id", f"stack({len(covariates)}, {pairs}) as (covariate, r)")


def pick_covariates(corrs: DataFrame, short: list[str], long: list[str], replication: list[str]) -> DataFrame:
    """The best covariate of each of three lists, by sample."""
    best = lambda names: F.max_by("covariate", F.when(F.col("covariate").isin(names), F.col("r")))
    return corrs.groupBy("sample_id").agg(best(short).alias("short"), best(long).alias("long"), best(replication).alias("replication"))


def segment_means(df: DataFrame, value: str = "logr", run: str = "baf_seg") -> DataFrame:
    """One row per run of equal `run`: bounds, length and mean of the value."""
    return run_islands(df, run).groupBy("sample_id", "chrom", "run_id").agg(F.min("pos").alias("start_pos"), F.max("pos").alias("end_pos"), F.count("*").alias("n"), F.avg(value).alias("mean_value"))


def baf_summary(option: int, value: str = "baf_phased") -> Column:
    """1: median, 2: mean, 3: the median unless it is exactly 0 or 1, then the mean."""
    median, mean = F.percentile(value, F.lit(0.5)), F.avg(value)
    return {1: median, 2: mean, 3: F.when(median.isin(0.0, 1.0), mean).otherwise(median)}[option]


def segment_baf_summary(df: DataFrame, option: int = 3) -> DataFrame:
    return run_islands(df, "baf_seg").groupBy("sample_id", "chrom", "run_id").agg(F.min("pos").alias("start_pos"), F.max("pos").alias("end_pos"), baf_summary(option).alias("baf"))


def segment_info(df: DataFrame, pool: str = "value") -> DataFrame:
    """Runs of equal (baf_seg, logr_seg) in order of sample, chromosome and position: r, b, length, and size, mean and sd of the phased BAF.
    pool="value": over all loci of the sample whose baf_seg has that value; "run": over the run's own."""
    rows = df.filter("baf_seg is not null and logr_seg is not null")
    runs = run_islands(rows.withColumn("_both", F.struct("baf_seg", "logr_seg")), "_both")
    own = runs.groupBy("sample_id", "chrom", "run_id").agg(F.first("logr_seg").alias("r"), F.first("baf_seg").alias("b"), F.count("*").alias("length"),
        F.min("pos").alias("start_pos"), F.max("pos").alias("end_pos"), F.count("*").alias("size"), F.avg("baf_phased").alias("mean"), F.stddev_samp("baf_phased").alias("sd"))
    if pool == "run":
        return own
    pooled = rows.groupBy("sample_id", F.col("baf_seg").alias("b")).agg(F.count("*").alias("size"), F.avg("baf_phased").alias("mean"), F.stddev_samp("baf_phased").alias("sd"))
    return own.drop("size", "mean", "sd").join(pooled, ["sample_id", "b"])


def segments_collapse(df: DataFrame) -> DataFrame:
    return run_islands(df, "baf_seg").groupBy("sample_id", "chrom", "run_id").agg(F.min("pos").alias("start_pos"), F.max("pos").alias("end_pos"), F.first("baf_seg").alias("baf_seg")).drop("run_id")


def ploidy_weighted(profile: DataFrame, truncate_kb: bool = False) -> DataFrame:
    """Copies over both alleles, weighted by length: in bases, or in whole kilobases."""
    length = F.col("end_pos") - F.col("start_pos")
    length = F.floor(length / 1000) if truncate_kb else length
    return profile.groupBy("sample_id").agg(div(F.sum(cn_total() * length), F.sum(length)).alias("ploidy"))


def pga_is_clonal(profile: DataFrame) -> DataFrame:
    """Share of the altered genome that is clonal: 1 - subclonal over all that isn't 1+1 throughout; null where nothing is altered."""
    length = F.col("end_pos") - F.col("start_pos")
    diploid = (F.col("nMaj1") == 1) & (F.col("nMin1") == 1) & (F.col("frac1") == 1)
    return profile.groupBy("sample_id").agg((1 - div(F.sum(F.when(F.col("frac1") < 1, length).otherwise(0)), F.sum(F.when(~diploid, length).otherwise(0)))).alias("clonal_share"))


def mask_high_states(profile: DataFrame, max_state: int = 250) -> DataFrame:
    """Nulls the states of segments whose first state is above max_state."""
    high = (F.col("nMaj1") > max_state) | (F.col("nMin1") > max_state)
    return profile.withColumns({c: F.when(~high, F.col(c)) for c in ("nMaj1", "nMin1", "frac1", "nMaj2", "nMin2", "frac2") if c in profile.columns} | {"masked": high})


def masking_details(masked: DataFrame) -> DataFrame:
    return masked.groupBy("sample_id").agg(F.count_if("masked").alias("n_masked"), F.sum(F.when(F.col("masked"), F.col("end_pos") - F.col("start_pos")).otherwise(0)).alias("bases_masked"))


def coverage_normalised(counts: DataFrame) -> DataFrame:
    """Depths of tumour and normal over their median by sample."""
    rows = counts.select("sample_id", "chrom", "pos", (F.col("t1") + F.col("t2")).alias("t"), (F.col("n1") + F.col("n2")).alias("n"))
    medians = rows.groupBy("sample_id").agg(F.percentile("t", F.lit(0.5)).alias("mt"), F.percentile("n", F.lit(0.5)).alias("mn"))
    return rows.join(medians, "sample_id").select("sample_id", "chrom", "pos", div(F.col("t"), F.col("mt")).alias("tumour"), div(F.col("n"), F.col("mn")).alias("normal"))


def array_probe_centering(df: DataFrame) -> DataFrame:
    """LogR less its mean over the probes of its class (copy number or SNP), to 4 digits; a BAF of 2 is missing."""
    kind = F.when(F.col("probe_id").startswith("CN"), "cn").otherwise("snp")
    rows = df.withColumn("probe_class", kind)
    means = rows.groupBy("sample_id", "probe_class").agg(F.avg("tumour_lrr").alias("_mean"))
    return rows.join(means, ["sample_id", "probe_class"]).select("sample_id", "probe_id", "chrom", "pos", "probe_class",
        F.round(F.col("tumour_lrr") - F.col("_mean"), 4).alias("logr"), F.when(F.col("tumour_baf") != 2, F.col("tumour_baf")).alias("baf"))


def snp_density(hets: DataFrame) -> DataFrame:
    return hets.groupBy("sample_id", "chrom").agg(div(F.count("*"), F.max("pos") - F.min("pos")).alias("density"))


def best_by_score(df: DataFrame, score: str = "score", keys=("sample_id",), ties: str = "first", largest: bool = False) -> DataFrame:
    """The row of best score by key; ties by the order of (i, j), first or last."""
    sign = -1 if largest else 1
    place = F.struct((sign * F.col(score)).alias("s"), *((F.col(c) if ties == "first" else -F.col(c)).alias(c) for c in ("i", "j")))
    return df.groupBy(*keys).agg(F.min_by(F.struct(*(c for c in df.columns if c not in keys)), place).alias("b")).select(*keys, "b.*")


def profile_summary(profile: DataFrame) -> DataFrame:
    """Megabases of homozygous deletion, share of bases that are subclonal, and segments of 48 to 52% first state."""
    length = F.col("end_pos") - F.col("start_pos")
    gone = ((F.col("nMaj1") == 0) & (F.col("nMin1") == 0)) | ((F.col("nMaj2") == 0) & (F.col("nMin2") == 0))
    return profile.groupBy("sample_id").agg((F.sum(F.when(gone, length).otherwise(0)) / 1e6).alias("hom_del_mb"),
        div(F.sum(F.when(F.col("frac1") < 1, length).otherwise(0)), F.sum(length)).alias("subclonal_share"), F.count_if(F.col("frac1").between(0.48, 0.52)).alias("n_even"))
