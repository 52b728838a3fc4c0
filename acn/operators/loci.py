"""Filters and equi-joins of tables of loci."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import allele_letter_to_index, normalise_chrom, sv_end_from_alt, sv_end_from_info, sv_support
from ..sources.schemas import NONPAR_X

LOCUS = ["chrom", "pos"]
#: Keys of joins, the position first: it tells nearly all rows apart, and a sort that begins with it rarely has to compare text.
BY_POS = ["pos", "chrom"]
SAMPLE_BY_POS = [*BY_POS, "sample_id"]
COUNTS = ["count_a", "count_c", "count_g", "count_t"]


def with_normal_chrom(df: DataFrame) -> DataFrame:
    return df.withColumn("chrom", normalise_chrom("chrom"))


def min_depth_filter(counts: DataFrame, min_normal: int | None = 10) -> DataFrame:
    """Loci of normal depth at least min_normal and tumour depth at least 1; all of them if min_normal is None."""
    return counts if min_normal is None else counts.filter((F.col("n1") + F.col("n2") >= min_normal) & (F.col("t1") + F.col("t2") >= 1))


def het_snp_filter_counts(df: DataFrame, lo: float = 0.10, hi: float = 0.90, min_depth: int = 10) -> DataFrame:
    return df.filter(F.col("baf").between(lo, hi) & (F.col("depth") > min_depth))


def het_snp_filter_haplotype(haps: DataFrame) -> DataFrame:
    return haps.filter("hap1 <> hap2")


def het_snp_filter_array(df: DataFrame, lo: float = 0.3, hi: float = 0.7) -> DataFrame:
    return df.filter(F.col("normal_baf").between(lo, hi))


def drop_problem_loci(df: DataFrame, loci: DataFrame) -> DataFrame:
    return df.join(loci.select(*LOCUS), LOCUS, "left_anti")


def keep_listed_loci(df: DataFrame, loci: DataFrame) -> DataFrame:
    return df.join(loci.select(*LOCUS), LOCUS, "left_semi")


def finite_logr(df: DataFrame, value: str = "logr") -> DataFrame:
    """Rows with a finite value: null, NaN and infinities go."""
    v = F.col(value)
    return df.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def dedupe_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order, not just any."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def nonpar_x_filter(df: DataFrame, build: str) -> DataFrame:
    """Loci of X strictly between the pseudo-autosomal regions."""
    lo, hi = NONPAR_X[build]
    return df.filter((F.col("chrom") == "X") & (F.col("pos") > lo) & (F.col("pos") < hi))


def biallelic_snv_filter(vcf: DataFrame) -> DataFrame:
    """Phased heterozygous genotypes of one-base alleles."""
    return vcf.filter(F.col("gt").isin("0|1", "1|0") & (F.length("ref") == 1) & (F.length("alt") == 1))


def drop_singleton_segments(segments: DataFrame) -> DataFrame:
    return segments.filter("length > 1")


def strand_flip_alleles(df: DataFrame) -> DataFrame:
    """Complements both alleles of probes on the minus strand."""
    flip = lambda c: F.when(F.col("strand") == "-", F.translate(c, "ACGT", "TGCA")).otherwise(F.col(c))
    return df.withColumns({"allele_a": flip("allele_a"), "allele_b": flip("allele_b")})


def allele_count(allele):
    """The count of an allele coded 1 to 4."""
    return F.get(F.array(*COUNTS), (F.col(allele) if isinstance(allele, str) else allele) - 1)


def pick_allele_counts(counts: DataFrame, alleles: DataFrame) -> DataFrame:
    """Counts of a0 and a1 as ref and alt, and their sum as depth, at the loci of both tables."""
    joined = counts.join(alleles, BY_POS)
    return joined.select("sample_id", *LOCUS, allele_count("a0").alias("ref"), allele_count("a1").alias("alt"), (allele_count("a0") + allele_count("a1")).alias("depth"))


def match_counts(tumour: DataFrame, normal: DataFrame, alleles: DataFrame) -> DataFrame:
    """Counts of both alleles in tumour (t1, t2) and normal (n1, n2) at loci that all three have. Tumour and normal meet first, then the
    alleles once for both."""
    key = ["sample_id", *LOCUS]
    own = normal.select(*key, F.array(*COUNTS).alias("_n"))
    both = tumour.select(*key, F.array(*COUNTS).alias("_t")).join(own, SAMPLE_BY_POS).join(alleles.select(*LOCUS, "a0", "a1"), BY_POS)
    pick = lambda c, a: F.get(c, F.col(a) - 1)
    return both.select(*key, pick("_t", "a0").alias("t1"), pick("_t", "a1").alias("t2"), pick("_n", "a0").alias("n1"), pick("_n", "a1").alias("n2"))


def match_covariates(logr: DataFrame, gc: DataFrame, replication: DataFrame | None = None) -> DataFrame:
    out = logr.join(gc, LOCUS)
    return out if replication is None else out.join(replication, LOCUS)


def join_genotype_counts(panel: DataFrame, counts: DataFrame) -> DataFrame:
    """Panel loci with the counts of their alleles, given as letters."""
    rows = panel.withColumns({"a0": allele_letter_to_index("a0"), "a1": allele_letter_to_index("a1"), "ref_allele": F.col("a0"), "alt_allele": F.col("a1")})
    joined = rows.join(counts, LOCUS)
    return joined.select("sample_id", *LOCUS, "snp_id", "ref_allele", "alt_allele", allele_count("a0").alias("ref"), allele_count("a1").alias("alt"))


def orient_array_alleles(df: DataFrame) -> DataFrame:
    """Array alleles against the panel's: as they are, or swapped with 1 - BAF; others go."""
    same = (F.col("allele_a") == F.col("a0")) & (F.col("allele_b") == F.col("a1"))
    swapped = (F.col("allele_a") == F.col("a1")) & (F.col("allele_b") == F.col("a0"))
    return df.filter(same | swapped).withColumn("baf", F.when(same, F.col("baf")).otherwise(1 - F.col("baf")))


def sync_segments_with_logr(baf_segmented: DataFrame, logr: DataFrame) -> DataFrame:
    """Segmented BAF with the finite LogR of its loci; loci without one go."""
    rows = baf_segmented.drop("logr")
    rest = [c for c in rows.columns if c not in SAMPLE_BY_POS]
    return rows.join(finite_logr(logr.select("sample_id", *LOCUS, "logr")), SAMPLE_BY_POS).select("sample_id", *LOCUS, *rest, "logr")


def natural_join_samples(tracks: DataFrame, n_samples: int, value: str = "baf") -> DataFrame:
    """Loci that every sample has a value for, as an array in order of sample."""
    rows = tracks.filter(F.col(value).isNotNull()).groupBy(*LOCUS).agg(F.array_sort(F.collect_list(F.struct("sample_id", value))).alias("rows"))
    return rows.filter(F.size("rows") == n_samples).select(*LOCUS, F.transform("rows", lambda x: x[value]).alias("values"))


def common_loci(vcfs: DataFrame, n_samples: int) -> DataFrame:
    """Loci with the same alleles in all samples."""
    key = [*LOCUS, "ref", "alt"]
    return vcfs.groupBy(*key).agg(F.countDistinct("sample_id").alias("n")).filter(F.col("n") == n_samples).select(*key)


def union_breakpoints(svs: DataFrame, ends: str = "alt") -> DataFrame:
    """Both ends of each rearrangement, distinct and in order."""
    chrom, pos = (sv_end_from_alt("alt") if ends == "alt" else sv_end_from_info("info"))
    other = svs.select(chrom.alias("chrom"), pos.alias("pos")).filter("chrom is not null and pos is not null")
    return svs.select("chrom", F.col("pos").cast("bigint").alias("pos")).unionByName(other).distinct().orderBy("chrom", "pos")


def sv_support_filter(svs: DataFrame) -> DataFrame:
    return svs.filter(sv_support("info") > 0)


def panel_build(panel: DataFrame) -> DataFrame:
    """Resolved one-letter alleles, the first row of each locus, with allele codes 1 to 4."""
    good = panel.filter(F.col("a0").rlike("^[ACGT]$") & F.col("a1").rlike("^[ACGT]$") & (F.col("a0") != F.col("a1")))
    first = dedupe_first(good, LOCUS, ["snp_id"])
    return first.select(*LOCUS, "snp_id", "a0", "a1", allele_letter_to_index("a0").alias("i0"), allele_letter_to_index("a1").alias("i1"))


def pileup_allele_counts(bases: DataFrame, min_base_qual: int = 20, min_map_qual: int = 35) -> DataFrame:
    """Counts of each base at each locus, from bases of good quality."""
    good = bases.filter((F.col("base_qual") >= min_base_qual) & (F.col("map_qual") >= min_map_qual))
    each = [F.count_if(F.col("base") == x.upper()).alias(f"count_{x}") for x in "acgt"]
    return good.groupBy("sample_id", *LOCUS).agg(*each).withColumn("good_depth", sum((F.col(c) for c in COUNTS[1:]), F.col(COUNTS[0])))


def genome_order(df: DataFrame, geometry: DataFrame | None = None) -> DataFrame:
    """Natural order of chromosomes, then position."""
    number = F.when(F.col("chrom") == "X", 23).when(F.col("chrom") == "Y", 24).otherwise(F.try_to_number("chrom", F.lit("99")).cast("int"))
    return df.orderBy(number, "pos")


def replace_chrom_rows(profile: DataFrame, rows: DataFrame, chrom: str = "X") -> DataFrame:
    """profile with its rows of chrom replaced; columns that the new rows lack are null."""
    return profile.filter(F.col("chrom") != chrom).unionByName(rows, allowMissingColumns=True)


def count_reconciliation(parts: DataFrame, whole: DataFrame) -> DataFrame:
    """Loci of whole that parts lack, and rows that it has too often; empty if all is well."""
    missing = whole.join(parts, ["sample_id", *LOCUS], "left_anti").select("sample_id", *LOCUS, F.lit("missing").alias("fault"))
    extra = parts.groupBy("sample_id", *LOCUS).count().filter("count > 1").select("sample_id", *LOCUS, F.lit("repeated").alias("fault"))
    return missing.union(extra)
