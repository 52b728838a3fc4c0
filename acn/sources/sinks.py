"""Writers. Tables go out as Parquet by sample and chromosome, or as tab-separated text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .schemas import SOLUTION_FIELDS, SOLUTIONS


def write_tracks(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    if fmt == "parquet":
        df.repartition("sample_id", "chrom").sortWithinPartitions("sample_id", "chrom", "pos").write.partitionBy("sample_id", "chrom").parquet(path)
    else:
        df.write.option("sep", "\t").option("header", True).csv(path)


def write_logr_segmented(df: DataFrame, path: str) -> None:
    write_tracks(df.select("sample_id", "chrom", "pos", "logr_seg"), path)


def write_baf_segmented(df: DataFrame, path: str) -> None:
    write_tracks(df.select("sample_id", "chrom", "pos", "baf", "baf_phased", "baf_seg"), path)


def profile_table(profile: DataFrame) -> DataFrame:
    """The short profile: bounds and the first solution."""
    return profile.select("sample_id", F.col("chrom").alias("chr"), F.col("start_pos").alias("startpos"), F.col("end_pos").alias("endpos"),
        *(F.col(c).alias(f"{c}_A") for c in ("nMaj1", "nMin1", "frac1", "nMaj2", "nMin2", "frac2")))


def profile_extended_table(profile: DataFrame) -> DataFrame:
    """All six solutions side by side: 7 columns and 6 times 10. Bootstrap columns are null where profile has none (bootstrap: map of option to
    sd_bs, lo, hi)."""
    boot = F.col("bootstrap") if "bootstrap" in profile.columns else F.lit(None).cast("map<int,struct<sd_bs:double,lo:double,hi:double>>")
    columns = [F.col("chrom").alias("chr"), F.col("start_pos").alias("startpos"), F.col("end_pos").alias("endpos"), F.col("baf").alias("BAF"), "pval", F.col("logr").alias("LogR"), "ntot"]
    for k, letter in enumerate(SOLUTIONS):
        s, b = F.get("solutions", F.lit(k)), F.try_element_at(boot, F.lit(k))
        extra = {"SDfrac_BS": b["sd_bs"], "frac1_0.025": b["lo"], "frac1_0.975": b["hi"]}
        for field in SOLUTION_FIELDS:
            base, _, rank = field.partition("_0")
            name = f"{base}_{letter}_0{rank}" if rank else field.replace("SDfrac_BS", "SDfrac") + f"_{letter}" + ("_BS" if field == "SDfrac_BS" else "")
            columns.append((extra[field] if field in extra else s[field]).alias(name))
    return profile.select("sample_id", *columns)


def _text(df: DataFrame, path: str) -> None:
    df.write.option("sep", "\t").option("header", True).option("nullValue", "NA").csv(path)


def write_profile(profile: DataFrame, path: str) -> None:
    _text(profile_table(profile), path)


def write_profile_extended(profile: DataFrame, path: str) -> None:
    _text(profile_extended_table(profile), path)


def write_rho_psi(rho_psi: DataFrame, path: str) -> None:
    _text(rho_psi, path)


def purity_ploidy_table(rho_psi: DataFrame, ploidy: DataFrame) -> DataFrame:
    """sample_id, purity, ploidy and psi of all cells."""
    return rho_psi.join(ploidy, "sample_id").select("sample_id", F.col("rho").alias("purity"), "ploidy", (F.col("rho") * F.col("psi_t") + 2 * (1 - F.col("rho"))).alias("psi"))


def write_purity_ploidy(summary: DataFrame, path: str) -> None:
    _text(summary, path)


def write_masking_details(details: DataFrame, path: str) -> None:
    _text(details, path)


def phased_vcf_lines(df: DataFrame) -> DataFrame:
    """VCF body lines with GT, PS and AD, in order inside each partition."""
    sample = F.concat_ws(":", "gt", F.coalesce(F.col("ps").cast("string"), F.lit(".")), F.concat_ws(",", F.col("ad_ref").cast("string"), F.col("ad_alt").cast("string")))
    line = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.lit("."), "ref", "alt", F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT:PS:AD"), sample)
    return df.select("sample_id", "chrom", "pos", line.alias("value"))


def write_phased_vcf(df: DataFrame, path: str) -> None:
    """One folder of lines per sample and chromosome."""
    phased_vcf_lines(df).repartition("sample_id", "chrom").sortWithinPartitions("sample_id", "chrom", "pos").select("sample_id", "chrom", "value").write.partitionBy("sample_id", "chrom").text(path)


def split_vcf_by_chrom(vcf: DataFrame, path: str) -> None:
    vcf.repartition("chrom").sortWithinPartitions("chrom", "pos").write.partitionBy("chrom").parquet(path)
