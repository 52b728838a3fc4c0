"""Genotypes, haplotypes, and phasing over several samples of a patient."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import allele_letter_to_index, div
from . import kernels
from .intervals import assign_points_to_intervals, interval_disjoin, nearest_of
from .loci import BY_POS, COUNTS, LOCUS, SAMPLE_BY_POS, allele_count, join_genotype_counts
from .windows import KEYS, groups, in_order, ordered, phase_evidence, phase_set_ids, phase_switches


def genotype_from_normal(panel: DataFrame, normal_counts: DataFrame, cut: float = 0.1) -> DataFrame:
    """One-hot genotypes of panel loci from the normal's BAF: up to cut hom-ref, from 1 - cut hom-alt, else het; no reads count as 0."""
    rows = join_genotype_counts(panel, normal_counts).withColumn("baf", F.coalesce(div(F.col("alt"), F.col("ref") + F.col("alt")), F.lit(0.0)))
    ref, alt = F.col("baf") <= cut, F.col("baf") >= 1 - cut
    return rows.select("sample_id", *LOCUS, "snp_id", "ref_allele", "alt_allele", ref.cast("int").alias("g0"), (~ref & ~alt).cast("int").alias("g1"), (alt & ~ref).cast("int").alias("g2"))


def genotype_from_array(df: DataFrame, cut: float | None = None) -> DataFrame:
    """Hets by array BAF from 0.3 to 0.7; with a cut, hom classes too, and what lies between goes."""
    het = F.col("normal_baf").between(0.3, 0.7)
    ref = F.lit(False) if cut is None else F.col("normal_baf") <= cut
    alt = F.lit(False) if cut is None else F.col("normal_baf") >= 1 - cut
    return df.select("sample_id", *LOCUS, ref.cast("int").alias("g0"), het.cast("int").alias("g1"), alt.cast("int").alias("g2")).filter("g0 + g1 + g2 > 0")


def genotypes_to_vcf_rows(gt: DataFrame) -> DataFrame:
    """VCF body rows of genotyped loci, with X for 23."""
    call = F.when(F.col("g0") == 1, "0/0").when(F.col("g1") == 1, "0/1").when(F.col("g2") == 1, "1/1")
    return gt.filter("g0 + g1 + g2 > 0").select("sample_id", F.when(F.col("chrom") == "23", "X").otherwise(F.col("chrom")).alias("chrom"), "pos",
        F.col("snp_id").alias("id"), F.col("ref_allele").alias("ref"), F.col("alt_allele").alias("alt"), call.alias("gt"))


def vcf_rows_to_haplotypes(vcf: DataFrame) -> DataFrame:
    """Phased genotypes as hap1 and hap2, with ids numbered by position."""
    bits = F.split("gt", r"\|")
    phased = vcf.filter(F.col("gt").contains("|"))
    n = F.row_number().over(ordered())
    return phased.select(*KEYS, F.concat(F.lit("snp"), n.cast("string")).alias("snpidx"), F.concat(F.lit("rs"), n.cast("string")).alias("rsidx"), "pos", "ref",
        "alt", F.get(bits, F.lit(0)).cast("int").alias("hap1"), F.get(bits, F.lit(1)).cast("int").alias("hap2"))


def phasing_regions(manifest: DataFrame, size: int = 5_000_000) -> DataFrame:
    """Regions of size bases, from just behind each manifest row's start to its end."""
    rows = manifest.select("chrom", F.col("start_pos").alias("_s"), F.col("end_pos").alias("_e")).withColumn("_n",
        F.explode(F.sequence(F.lit(0), (F.ceil((F.col("_e") - F.col("_s")) / size) - 1).cast("int"))))
    return rows.select("chrom", (F.col("_s") + F.col("_n") * size + 1).alias("start_pos"), F.least(F.col("_e"), F.col("_s") + (F.col("_n") + 1) * size).alias("end_pos"))


def haplotype_baf(counts: DataFrame, haps: DataFrame, min_counts: int = 1) -> DataFrame:
    """Share of reads on haplotype 1 at het loci with enough reads."""
    return baf_of_reads(with_reads(counts, haps.filter("hap1 <> hap2")), min_counts)


def with_reads(counts: DataFrame, haps: DataFrame, how: str = "inner") -> DataFrame:
    """Haplotypes with the reads of their two alleles, n_ref and n_alt."""
    ref, alt = allele_count(allele_letter_to_index("ref")), allele_count(allele_letter_to_index("alt"))
    rest = [c for c in haps.columns if c not in SAMPLE_BY_POS]
    rows = haps.join(counts.select("sample_id", *LOCUS, *COUNTS), SAMPLE_BY_POS, how)
    return rows.select("sample_id", *LOCUS, *rest, ref.alias("n_ref"), alt.alias("n_alt"))


def baf_of_reads(rows: DataFrame, min_counts: int = 1) -> DataFrame:
    """haplotype_baf() of haplotypes that come with their reads."""
    ref, alt = F.col("n_ref"), F.col("n_alt")
    rows = rows.filter("hap1 <> hap2").select("sample_id", *LOCUS, F.when(F.col("hap1") == 1, alt).otherwise(ref).alias("on1"), (ref + alt).alias("depth"))
    return rows.filter((F.col("depth") >= min_counts) & (F.col("depth") > 0)).select("sample_id", *LOCUS, (F.col("on1") / F.col("depth")).alias("baf"))


def haplotype_baf_array(df: DataFrame, haps: DataFrame) -> DataFrame:
    """Array BAF turned over where haplotype 1 has the alternative allele."""
    rows = df.join(haps.filter("hap1 <> hap2").select("sample_id", *LOCUS, "hap1"), SAMPLE_BY_POS)
    return rows.select("sample_id", *LOCUS, F.when(F.col("hap1") == 1, 1 - F.col("baf")).otherwise(F.col("baf")).alias("baf"))


def apply_external_haplotypes(haps: DataFrame, external: DataFrame) -> DataFrame:
    """Haplotypes rewritten by external phase blocks (sample_id, chrom, pos, hap1, ps). Het loci between follow the nearest external one;
    neighbouring blocks are turned so that the inferred phase runs through: a running exclusive or of the flips at block borders."""
    het = F.coalesce(F.col("hap1") != F.col("hap2"), F.lit(False))
    columns = [*KEYS, "pos", *(c for c in haps.columns if c not in SAMPLE_BY_POS)]
    known = external.groupBy(*SAMPLE_BY_POS).agg(F.min(F.struct(F.col("hap1").alias("e1"), "ps")).alias("_e"))
    target = F.when(F.col("_e").isNotNull(), F.struct("pos", (F.col("hap1") != F.col("_e.e1")).cast("int").alias("off"), F.col("_e.ps").alias("ps")))
    near = nearest_of("_t", KEYS)(haps.filter(het).join(known, SAMPLE_BY_POS, "left").select(*columns, target.alias("_t")))
    near = near.select(*columns, F.col("_n.off").alias("_off"), F.col("_n.ps").alias("_ps"))
    w = ordered()
    border = F.col("_ps") != F.lag("_ps").over(w)
    jump = F.when(border & (F.col("_off") != F.lag("_off").over(w)), 1).otherwise(0)
    turned = near.withColumn("_j", jump).withColumn("_flip", F.coalesce((F.sum("_j").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_off")) % 2, F.lit(0)))
    new = {"hap1": F.when(F.col("_flip") == 1, F.col("hap2")).otherwise(F.col("hap1")), "hap2": F.when(F.col("_flip") == 1, F.col("hap1")).otherwise(F.col("hap2"))}
    return turned.select(*(new[c].alias(c) if c in new else c for c in columns)).unionByName(haps.filter(~het).select(*columns))


def phased_genotypes(counts: DataFrame, haps: DataFrame, baf_segmented: DataFrame, include_homozygous: bool = False) -> DataFrame:
    """Genotypes with phase set and read depths of loci in segmented BAF (baf_phased, baf_seg). The first allele is the one that baf_phased
    counts, the segment's upper side: 1 where that is the share of alternative reads. | where the segment is imbalanced, else /. With
    include_homozygous all loci come, those outside segments with their haplotypes."""
    return genotypes_of_reads(with_reads(counts, haps), baf_segmented, include_homozygous)


def genotypes_of_reads(rows: DataFrame, baf_segmented: DataFrame, include_homozygous: bool = False) -> DataFrame:
    """phased_genotypes() of haplotypes that come with their reads."""
    rows = rows if include_homozygous else rows.filter("hap1 <> hap2")
    sets = phase_set_ids(baf_segmented.select("sample_id", *LOCUS, "baf_phased", "baf_seg")).select("sample_id", *LOCUS, "ps", "baf_phased", "baf_seg")
    rows = rows.join(sets, SAMPLE_BY_POS, "left" if include_homozygous else "inner")
    ref, alt = F.col("n_ref"), F.col("n_alt")
    upper = F.coalesce(F.abs(F.col("baf_phased") - div(alt, ref + alt)) < 1e-5, F.lit(False)).cast("int")
    sure = F.coalesce(F.greatest(F.col("baf_seg"), 1 - F.col("baf_seg")) > 0.525, F.lit(True))
    own = F.concat(upper.cast("string"), F.when(sure, "|").otherwise("/"), (1 - upper).cast("string"))
    gt = F.when(F.col("baf_phased").isNull(), F.concat(F.col("hap1").cast("string"), F.lit("|"), F.col("hap2").cast("string"))).otherwise(own)
    return rows.select("sample_id", *LOCUS, "ref", "alt", gt.alias("gt"), "ps", ref.alias("ad_ref"), alt.alias("ad_alt"))


def multisample_phasing(phased: DataFrame, max_lag: int = 100, balanced_weight: float = 0.25, patient: str = "patient_id") -> DataFrame:
    """Joint haplotype bit by locus, from the votes of up to max_lag loci before it (those of phase_switches() and phase_evidence()). Loci are
    those of all of a patient's samples; without a column patient, all samples are one's. The vote is a recursion along one patient's
    chromosome, so these are the groups."""
    of = [patient] if patient in phased.columns else []
    n = phased.groupBy(*of).agg(F.count_distinct("sample_id").alias("_of")) if of else phased.agg(F.count_distinct("sample_id").alias("_of"))
    rows = phased.join(n, of) if of else phased.join(F.broadcast(n), how="cross")  # n is one row without of
    rows = rows.select(*of, "sample_id", *LOCUS, "bit", "phased", F.col("ps").cast("double").alias("ps"), F.col("_of").cast("int").alias("_of"))

    def work(batches):
        for key, slices in groups(batches, [*of, "chrom"]):
            names, columns = {}, []
            for b in slices:
                own = b.column("sample_id").dictionary_encode()
                codes = np.array([names.setdefault(c, len(names)) for c in own.dictionary.to_pylist()], np.int32)[own.indices.to_numpy(zero_copy_only=False)]
                columns.append((codes, *(b.column(c).to_numpy(zero_copy_only=False) for c in ("pos", "bit", "phased", "ps"))))
                types, all_ = [b.schema.field(k).type for k in (*of, "chrom")], b.column("_of")[0].as_py()
            sample, at, bits, sure, sets = (np.concatenate(c) for c in zip(*columns))
            del columns
            one = np.r_[True, (at[1:] != at[:-1]) | (sample[1:] != sample[:-1])]  # a sample's first row of a locus
            first = np.r_[True, at[one][1:] != at[one][:-1]]
            one[one] = (np.diff(np.r_[np.flatnonzero(first), len(first)]) == all_)[np.cumsum(first) - 1]  # loci of all samples
            if not one.any():
                continue
            wide = (-1, all_)
            pos = at[one].reshape(wide)[:, 0]
            bits, sure, sets = bits[one].astype(np.int8).reshape(wide), sure[one].astype(bool).reshape(wide), sets[one].astype(float, copy=False).reshape(wide)
            del sample, at, one, first
            vote = kernels.phase_vote(bits, sure, sets, max_lag, balanced_weight)
            for k in range(0, len(pos), 100_000):
                n = len(pos[k : k + 100_000])
                keys = [pa.array([v] * n, t) for v, t in zip(key, types)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(pos[k : k + n]), pa.array(vote[k : k + n].astype(np.int32))], names=[*of, "chrom", "pos", "bit"])

    schema = ", ".join([*(f"{k} {phased.schema[k].dataType.simpleString()}" for k in of), "chrom string, pos long, bit int"])
    return in_order(rows, [*of, "chrom"], ["pos", "sample_id"], work, schema)


def _of_patient(df: DataFrame) -> list[str]:
    return [c for c in ("patient_id",) if c in df.columns]


def imbalanced_regions(profiles: DataFrame, min_samples: int = 2) -> DataFrame:
    """Pieces of the genome in which several samples of a patient are imbalanced, with those samples. Without a column patient_id all samples
    are one patient's."""
    keys = [*_of_patient(profiles), "chrom"]
    odd = profiles.filter((F.col("nMaj1") != F.col("nMin1")) | (F.col("nMaj2") != F.col("nMin2"))).select(*keys, "sample_id", "start_pos", "end_pos")
    pieces = interval_disjoin(odd, keys).drop("depth").select(*keys, F.col("start_pos").alias("pos"), F.col("end_pos").alias("_end"))
    held = assign_points_to_intervals(pieces, odd, keys)
    found = held.groupBy(*keys, F.col("pos").alias("start_pos"), F.col("_end").alias("end_pos")).agg(F.array_sort(F.collect_set("sample_id")).alias("samples"))
    return found.filter(F.size("samples") >= min_samples)


def mirrored_imbalance(regions: DataFrame, phased: DataFrame, joint: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Share of each sample's loci that agree with the joint haplotype in each region; mirrored where a patient's samples differ by more than
    threshold. Regions, loci and joint haplotype carry patient_id, or none of them does."""
    of = _of_patient(regions)
    rows = phased.join(joint.select(*of, *LOCUS, F.col("bit").alias("joint_bit")), [*BY_POS, *of])
    inside = assign_points_to_intervals(rows, regions, [*of, "chrom"]).filter(F.expr("array_contains(samples, sample_id)"))
    region = [*of, "chrom", "start_pos", "end_pos"]
    share = inside.groupBy(*region, "sample_id").agg(F.avg((F.col("bit") == F.col("joint_bit")).cast("double")).alias("agree"), F.count("*").alias("n"))
    spread = share.groupBy(*region).agg((F.max("agree") - F.min("agree")).alias("spread"), F.array_sort(F.collect_list(F.struct("sample_id", "agree"))).alias("by_sample"))
    return spread.withColumn("mirrored", F.col("spread") > threshold)
