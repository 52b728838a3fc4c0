"""Readers of the tab- and space-separated files of such analyses. All schemas are fixed; one bad row stops the read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import normalise_chrom
from . import schemas as S


def _read(spark: SparkSession, path: str, schema: str, sep: str = "\t", **options) -> DataFrame:
    return spark.read.options(sep=sep, mode="FAILFAST", **options).schema(schema).csv(path)


def read_allele_counts(spark: SparkSession, path: str, sample_id: str) -> DataFrame:
    return _read(spark, path, S.ALLELE_COUNTS, comment="#").select(F.lit(sample_id).alias("sample_id"), "*").withColumn("chrom", normalise_chrom("chrom"))


def read_track(spark: SparkSession, path: str, sample_id: str, value: str = "logr") -> DataFrame:
    return _read(spark, path, S.TRACK, header=True).select(F.lit(sample_id).alias("sample_id"), normalise_chrom("chrom").alias("chrom"), "pos", F.col("value").alias(value))


def read_gc_covariates(spark: SparkSession, path: str) -> DataFrame:
    """A row name, chromosome, position, the 12 windows and six columns that nothing uses; unread columns are pruned."""
    extra = ", ".join(f"x{i} double" for i in range(6))
    schema = f"row_name string, chrom string, pos bigint, {', '.join(f'{c} double' for c in S.GC_COLUMNS)}, {extra}"
    return _read(spark, path, schema, header=True).select(normalise_chrom("chrom").alias("chrom"), "pos", *S.GC_COLUMNS)


def read_replication(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, f"chrom string, pos bigint, {', '.join(f'{c} double' for c in S.REPLICATION_COLUMNS)}", header=True).withColumn("chrom", normalise_chrom("chrom"))


def read_baf_segmented(spark: SparkSession, path: str, sample_id: str) -> DataFrame:
    return _read(spark, path, S.BAF_SEGMENTED, header=True).select(F.lit(sample_id).alias("sample_id"), normalise_chrom("chrom").alias("chrom"), "pos", "baf", "baf_phased", "baf_seg")


def read_haplotypes(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, S.HAPLOTYPES, sep=" ")


def read_genotype_input(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, S.GENOTYPES, sep=" ")


def read_phased_vcf(spark: SparkSession, path: str) -> DataFrame:
    """VCF body with GT, PS and AD of its one sample, whatever their order in FORMAT."""
    rows = _read(spark, path, S.VCF, comment="#")
    keys, values = F.split("format", ":"), F.split("sample", ":")
    field = lambda k: F.when(F.array_position(keys, k) > 0, F.try_element_at(values, F.array_position(keys, k).cast("int")))
    depths = F.transform(F.split(field("AD"), ","), lambda x: x.try_cast("int"))
    return rows.select(normalise_chrom("chrom").alias("chrom"), "pos", "ref", "alt", field("GT").alias("gt"), field("PS").try_cast("bigint").alias("ps"), depths.alias("ad"))


def read_generic_table(spark: SparkSession, path: str, chrom_cols: tuple[int, ...] = (0,), sep: str = "\t", header: bool = True) -> DataFrame:
    """Types are inferred, chromosome columns stay strings, blanks in names become dots."""
    df = spark.read.options(sep=sep, header=header, inferSchema=True).csv(path)
    df = df.toDF(*(c.replace(" ", ".") for c in df.columns))
    return df.withColumns({f"`{df.columns[i]}`".strip("`"): F.col(f"`{df.columns[i]}`").cast("string") for i in chrom_cols})


def read_region_manifest(spark: SparkSession, path: str, is_male: bool, chrom: str | None = None) -> DataFrame:
    rows = _read(spark, path, S.REGIONS)
    rows = rows.filter("is_par = 1") if is_male else rows
    return rows if chrom is None else rows.filter(F.col("chrom") == chrom)


def chromosome_list(manifest: DataFrame, analysis: str = "paired") -> DataFrame:
    rows = manifest.select("chrom").distinct()
    return rows.filter(~F.col("chrom").isin("X", "Y")) if analysis in ("cell_line", "germline") else rows


def union_chromosome_files(spark: SparkSession, glob: str, schema: str, chrom_regex: str, sep: str = "\t") -> DataFrame:
    """All files of a pattern; the chromosome comes from the path where the schema has none."""
    rows = spark.read.options(sep=sep, mode="FAILFAST").schema(schema).csv(glob)
    return rows if "chrom" in rows.columns else rows.select(F.regexp_extract(F.col("_metadata.file_path"), chrom_regex, 1).alias("chrom"), *rows.columns)


def union_region_files(spark: SparkSession, glob: str, schema: str = S.HAPLOTYPES, sep: str = " ") -> DataFrame:
    """Output of all phasing regions in order of position."""
    return spark.read.options(sep=sep, mode="FAILFAST").schema(schema).csv(glob).orderBy("pos")


def load_rho_psi(rho_psi: DataFrame) -> DataFrame:
    return rho_psi.filter("method = 'FRAC_GENOME'").select("sample_id", "rho", F.col("psi").alias("psi_t"), F.col("distance").alias("goodness"))


def read_snp_array_lrr_baf(spark: SparkSession, path: str, probe_positions: DataFrame) -> DataFrame:
    """Columns 3 to 6 are the normal's LogR and BAF and the tumour's; loci come from the probe table."""
    rows = _read(spark, path, "probe_id string, name string, normal_lrr double, normal_baf double, tumour_lrr double, tumour_baf double", header=True)
    return rows.drop("name").join(probe_positions.select("probe_id", "chrom", "pos"), "probe_id")


def read_breakpoints(spark: SparkSession, path: str) -> DataFrame:
    """Prior breakpoints; columns may be named chromosome and position, or chr and pos."""
    rows = spark.read.options(sep="\t", header=True).csv(path)
    names = {c.lower(): c for c in rows.columns}
    pick = lambda *options: F.col(next(names[o] for o in options if o in names))
    return rows.select(normalise_chrom(pick("chromosome", "chr", "chrom")).alias("chrom"), pick("position", "pos").cast("bigint").alias("pos"))
