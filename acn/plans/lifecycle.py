"""Whole analyses. Sample by sample the reference's files become tables; a cohort is one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates, calls, fit, intervals, loci, phasing, pseudonormal, regression, segmentation, windows
from ..sources.readers import load_rho_psi
from ..storage import materialise

#: Reads a locus needs for its haplotype BAF in a run.
MIN_COUNTS = 10
REGION = ["sample_id", "chrom", "arm", "start_pos", "end_pos"]
#: What the three kinds of analysis set apart: BAF summary, penalties and minimum runs, and the ranges of ploidy and purity.
MODES = {
    "paired": {"baf_option": 3, "phase_gamma": 1, "phase_kmin": 1, "gamma": 10, "kmin": 3, "ploidy": (1.6, 4.8), "rho": (0.1, 1.0)},
    "cell_line": {"baf_option": 1, "phase_gamma": 1, "phase_kmin": 2, "gamma": 20, "kmin": 3, "ploidy": (1.6, 4.8), "rho": (0.99, 1.01)},
    "germline": {"baf_option": 1, "phase_gamma": 3, "phase_kmin": 1, "gamma": 3, "kmin": 3, "ploidy": (1.5, 2.5), "rho": (0.99, 1.01)},
}


def tracks(tumour: DataFrame, normal: DataFrame, alleles: DataFrame, **covariates) -> DataFrame:
    """Counts -> BAF and LogR, corrected where covariates are given (those of corrected())."""
    return corrected(aggregates.baf_logr(tumour, normal, alleles), **covariates)


def corrected(rows: DataFrame, covariates: DataFrame | None = None, short: list[str] | None = None, long: list[str] | None = None, replication: list[str] | None = None) -> DataFrame:
    """rows with the residual LogR of a fit on GC content in a short and a long window, and on replication timing, each the most
    correlated of its kind in each sample; unchanged without covariates."""
    if covariates is None:
        return rows
    joined = materialise(loci.match_covariates(loci.finite_logr(rows), covariates), "tracks")
    return regression.correct_logr(joined, short, long, replication).withColumn("logr", F.col("residual")).drop("residual")


def segments_of(baf_segmented: DataFrame, logr: DataFrame) -> DataFrame:
    """Segmented BAF and LogR -> segments with the moments that the fits need. LogR is averaged over each run of equal baf_seg, so that
    separate segments of equal BAF keep their own. Runs with LogR are written, for the means, the segments and the moments by value all read them."""
    synced = materialise(loci.sync_segments_with_logr(windows.run_islands(baf_segmented, "baf_seg"), logr), "synced")
    means = synced.groupBy("sample_id", "chrom", "run_id").agg(F.avg("logr").alias("logr_seg"))
    return aggregates.segment_info(synced.join(means, ["sample_id", "chrom", "run_id"]).drop("run_id"))


def paired(
    tumour: DataFrame, normal: DataFrame, alleles: DataFrame, haplotypes: DataFrame, mode: str = "paired", breakpoints: DataFrame | None = None, preset: DataFrame | None = None,
    males: DataFrame | None = None, build: str = "hg38", **covariates,
) -> dict[str, DataFrame]:
    """Counts and haplotypes -> segmented BAF, fit and profile of every sample. covariates are those of tracks(): with them, LogR is
    corrected for GC content and replication. Tables are written after tracks, segmentation and calls,
    the points from which a run can go on; a preset (sample_id, rho, psi) skips the coarse grid. males and build are refit()'s."""
    m = MODES[mode]
    logr = materialise(loci.finite_logr(tracks(tumour, normal, alleles, **covariates)), "logr")
    baf = phasing.haplotype_baf(tumour, haplotypes, MIN_COUNTS)
    segmented = materialise(segmentation.segment_phased_baf(baf, breakpoints, m["gamma"], m["phase_gamma"], m["kmin"], m["phase_kmin"], baf_option=m["baf_option"]), "segmented")
    return refit(segmented, logr, preset, mode, males, breakpoints, build) | {"logr": logr, "baf_segmented": segmented}


def losses(hets: DataFrame, logr: DataFrame, geometry: DataFrame, mode: str = "cell_line") -> DataFrame:
    """Regions without heterozygosity of samples without a normal: by long gaps between hets, then by low LogR inside single gaps of what is
    left. In germlines the former need low LogR too. Regions that overlap are one."""
    found = pseudonormal.loh_noise_filter(pseudonormal.loh_by_het_gaps(hets, geometry), geometry).select(*REGION)
    found = materialise(found, "losses")
    low = pseudonormal.loh_by_logr_windows(hets, logr, found, geometry, mode=mode).select(*REGION)
    found = pseudonormal.drop_undepleted(found, logr, geometry) if mode == "germline" else found
    return materialise(intervals.interval_merge_adjacent(found.unionByName(low)).select(*REGION), "losses")


def unmatched(counts: DataFrame, alleles: DataFrame, geometry: DataFrame, mode: str = "cell_line", **covariates) -> dict[str, DataFrame]:
    """Counts of samples without a normal -> LogR of the sample, its losses, and counts of a normal that is heterozygous inside them, from
    which genotypes are made for phasing. Losses are looked for in LogR as counted; covariates, those of corrected(), correct the LogR that is returned."""
    rows = materialise(aggregates.baf_logr_unpaired(counts, alleles), "unpaired")
    logr = loci.finite_logr(rows).select("sample_id", "chrom", "pos", "logr")
    hets = loci.het_snp_filter_counts(rows).select("sample_id", "chrom", "pos")
    lost = losses(hets, logr, geometry, mode)
    normal = materialise(pseudonormal.pseudo_normal_counts(counts, alleles, lost).drop("spiked"), "pseudo-normal")
    return {"logr": corrected(logr, **covariates).select("sample_id", "chrom", "pos", "logr"), "losses": lost, "normal": normal}


def without_normal(
    counts: DataFrame, alleles: DataFrame, haplotypes: DataFrame, geometry: DataFrame, mode: str = "cell_line", breakpoints: DataFrame | None = None,
    preset: DataFrame | None = None, males: DataFrame | None = None, build: str = "hg38", **covariates,
) -> dict[str, DataFrame]:
    """unmatched(), then segmentation, fit and profile of the samples from their own LogR and the haplotypes that the made-up normal gave."""
    m, found = MODES[mode], unmatched(counts, alleles, geometry, mode, **covariates)
    logr = materialise(found["logr"], "logr")
    baf = phasing.haplotype_baf(counts, haplotypes, MIN_COUNTS)
    segmented = materialise(segmentation.segment_phased_baf(baf, breakpoints, m["gamma"], m["phase_gamma"], m["kmin"], m["phase_kmin"], baf_option=m["baf_option"]), "segmented")
    return refit(segmented, logr, preset, mode, males, breakpoints, build) | found | {"logr": logr, "baf_segmented": segmented}


def multisample(
    tumour: DataFrame, normal: DataFrame, alleles: DataFrame, haplotypes: DataFrame, patients: DataFrame, mode: str = "paired", breakpoints: DataFrame | None = None,
    preset: DataFrame | None = None, males: DataFrame | None = None, build: str = "hg38", **covariates,
) -> dict[str, DataFrame]:
    """Several samples of each patient, in two passes. patients: patient_id, sample_id. Each sample is phased and segmented alone; what their
    imbalanced segments say about the haplotypes is put together by patient, and the samples' haplotypes are rewritten by it; BAF is made anew
    and segmented with breaks that a patient's samples share. After every sample's fit and profile come the regions in which samples of a patient are
    imbalanced, and whether towards opposite haplotypes. A patient with one sample keeps its own segments."""
    m = MODES[mode]
    logr = materialise(loci.finite_logr(tracks(tumour, normal, alleles, **covariates)), "logr")
    settings = (breakpoints, m["gamma"], m["phase_gamma"], m["kmin"], m["phase_kmin"])
    reads = materialise(phasing.with_reads(tumour, haplotypes, "left"), "reads")  # a haplotype meets its counts once in the whole run
    alone = materialise(segmentation.segment_phased_baf(phasing.baf_of_reads(reads, MIN_COUNTS), *settings, baf_option=m["baf_option"]), "alone")
    several = patients.groupBy("patient_id").agg(F.count_distinct("sample_id").alias("n")).filter("n > 1").select("patient_id")
    members = materialise(patients.select("patient_id", "sample_id").distinct().join(several, "patient_id"), "members")
    reads, own = (df.join(members, "sample_id", "left_semi") for df in (reads, alone))
    bits = materialise(phase_bits(phasing.genotypes_of_reads(reads, own), members), "phase-bits")
    joint = materialise(phasing.multisample_phasing(bits), "joint-haplotype")
    known = members.join(joint, "patient_id").select("sample_id", "chrom", "pos", F.col("bit").alias("hap1"), F.lit(1).alias("ps"))  # one phase set a chromosome
    rewritten = materialise(phasing.apply_external_haplotypes(reads, known), "haplotypes")
    baf = phasing.baf_of_reads(rewritten, MIN_COUNTS).join(members, "sample_id")
    shared = segmentation.segment_phased_baf_multisample(baf, breakpoints, baf_option=m["baf_option"]).drop("patient_id")
    segmented = materialise(shared.unionByName(alone.join(members, "sample_id", "left_anti").select(*shared.columns)), "segmented")
    out = refit(segmented, logr, preset, mode, males, breakpoints, build) | {"logr": logr, "baf_segmented": segmented, "joint": joint, "haplotypes": rewritten.drop("n_ref", "n_alt")}
    regions = materialise(phasing.imbalanced_regions(out["profile"].join(members, "sample_id")), "imbalanced-regions")
    return out | {"regions": regions, "mirrored": phasing.mirrored_imbalance(regions, bits, joint)}


def phase_bits(genotypes: DataFrame, patients: DataFrame) -> DataFrame:
    """Phased genotypes as patient_id, sample_id, chrom, pos, bit (the first allele), phased and ps."""
    bit, phased = F.substring("gt", 1, 1).cast("int"), F.substring("gt", 2, 1) == "|"
    return genotypes.join(patients, "sample_id").select("patient_id", "sample_id", "chrom", "pos", bit.alias("bit"), phased.alias("phased"), "ps")


def several_samples(baf: DataFrame, logr: DataFrame, breakpoints: DataFrame | None = None, preset: DataFrame | None = None) -> dict[str, DataFrame]:
    """Phased BAF (with patient_id) and LogR of several samples of each patient -> shared breaks, then every sample's fit and profile."""
    segmented = segmentation.segment_phased_baf_multisample(baf, breakpoints)
    segmented = materialise(segmented.drop("patient_id"), "segmented")
    return refit(segmented, logr, preset) | {"baf_segmented": segmented}


def refit(
    baf_segmented: DataFrame, logr: DataFrame, preset: DataFrame | None = None, mode: str = "paired", males: DataFrame | None = None, breakpoints: DataFrame | None = None, build: str = "hg38",
) -> dict[str, DataFrame]:
    """From segmented tracks on: fit, profile (with the bootstrap of subclonal fractions), ploidy, clonal share and suggestions for another fit.
    males (sample_id): samples whose X is called from LogR alone and takes the place of X in their profile."""
    m = MODES[mode]
    segs = materialise(segments_of(baf_segmented, logr), "segments")
    rho_psi = materialise(fit.fit_copy_number(segs, preset, min_ploidy=m["ploidy"][0], max_ploidy=m["ploidy"][1], min_rho=m["rho"][0], max_rho=m["rho"][1]), "rho-psi")
    used = load_rho_psi(rho_psi)
    profile = materialise(calls.call_profile(baf_segmented, logr, used, baf_option=m["baf_option"]), "profile")
    ploidy = materialise(aggregates.ploidy_weighted(profile), "ploidy")
    if males is not None:
        profile = materialise(calls.male_x(profile, logr, used, ploidy, males, breakpoints, build), "profile-x")
    suggestions = windows.refit_suggestions(profile, used)
    return {"rho_psi": rho_psi, "profile": profile, "ploidy": ploidy, "clonal_share": aggregates.pga_is_clonal(profile), "refit_suggestions": suggestions}
