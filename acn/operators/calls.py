"""Copy-number calls of one or two states a segment, merging of segments, and the X chromosome of males."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import candidate_edges, cn_major_minor, cn_total_major, cn_total_minor, expected_baf, psi_from_psit, rescue_negative_minor, rho_psi_from_segment, t_statistic, two_state_fraction
from ..functions.stats import one_sample_t
from ..sources.schemas import MALE_X, X_CENTROMERE
from ..storage import materialise
from . import merging
from .aggregates import mask_high_states
from .intervals import FEW, assign_points_to_intervals, interval_overlap, segment_at_position
from .loci import finite_logr
from .segmentation import segment_logr
from .windows import KEYS, groups, in_order, run_islands


def segment_switchpoints(baf_segmented: DataFrame) -> DataFrame:
    """Segments: runs of equal baf_seg, with bounds, level on the upper side and the moments of their phased BAF."""
    runs = run_islands(baf_segmented, "baf_seg").groupBy(*KEYS, "run_id").agg(F.min("pos").alias("start_pos"), F.max("pos").alias("end_pos"),
        F.first("baf_seg").alias("_b"), F.count("baf_phased").alias("n"), F.avg("baf_phased").alias("mean"), F.stddev_samp("baf_phased").alias("sd"))
    return runs.withColumn("baf", F.greatest(F.col("_b"), 1 - F.col("_b"))).drop("_b")


def segment_logr_mean(segments: DataFrame, logr: DataFrame) -> DataFrame:
    """Adds logr: the mean finite LogR of all loci inside the closed bounds; 0 where there is none."""
    key = [*KEYS, "start_pos", "end_pos"]
    inside = assign_points_to_intervals(finite_logr(logr).select(*KEYS, "pos", "logr"), segments.select(*key))
    means = inside.groupBy(*key).agg(F.avg("logr").alias("logr"))
    return segments.drop("logr").join(means, key, "left").withColumn("logr", F.coalesce("logr", F.lit(0.0)))


def call_segments(segments: DataFrame, rho_psi: DataFrame, gamma: float = 1.0, sig: float = 0.05, max_dist: float = 0.01, cn_cap: float = 1000) -> DataFrame:
    """segments (baf, logr, n, mean, sd) with ntot, t, pval and solutions: the clonal state, or six two-state options with fractions.

    rho_psi has psi of all cells. An option with a negative copy number is null and comes last."""
    rows = segments.join(rho_psi.select("sample_id", "rho", "psi"), "sample_id")
    major, minor = cn_major_minor("baf", "logr", "rho", "psi", gamma)
    rows = rows.withColumns({"_x": major, "_y": minor}).filter("_y is not null")
    lifted, low = rescue_negative_minor("_x", "_y", "baf", cn_cap)
    rows = rows.withColumns({"_major": lifted, "_minor": low}).withColumn("ntot", F.col("_major") + F.col("_minor"))
    floor, ceil = (lambda c: F.floor(c).cast("double")), (lambda c: F.ceil(c).cast("double"))
    edges = candidate_edges(expected_baf("rho", ceil("_major"), ceil("_minor")), expected_baf("rho", floor("_major"), floor("_minor")), "baf", "ntot", floor("_minor"), floor("_major"))
    rows = rows.withColumn("_edges", edges)
    first = F.get("_edges", F.lit(0))
    l1, l2 = expected_baf("rho", first["m1"], first["n1"]), expected_baf("rho", first["m2"], first["n2"])
    near = l2.isNull() | (F.abs(l1 - F.col("baf")) <= F.abs(l2 - F.col("baf")))
    rows = rows.withColumns({"_level": F.when(near, l1).otherwise(l2), "_maj": F.when(near, first["m1"]).otherwise(first["m2"]), "_min": F.when(near, first["n1"]).otherwise(first["n2"])})
    rows = rows.withColumns({"t": t_statistic("n", "mean", "sd", "_level"), "pval": one_sample_t("n", "mean", "sd", "_level", -1.0)})
    rows = rows.withColumn("pval", F.when(F.abs(F.col("baf") - F.col("_level")) < max_dist, 1.0).when(F.col("sd").isNull() | (F.col("sd") == 0), 0.0).otherwise(F.col("pval")))
    se = F.col("sd") / F.sqrt("n")

    def option(e):
        tau = lambda l: two_state_fraction(l, "rho", e["m1"], e["n1"], e["m2"], e["n2"])
        here = tau(F.col("baf"))
        spread = (F.abs(tau(F.col("baf") + se) - here) + F.abs(tau(F.col("baf") - se) - here)) / 2
        return F.struct(e["m1"].alias("nMaj1"), e["n1"].alias("nMin1"), here.alias("frac1"), e["m2"].alias("nMaj2"), e["n2"].alias("nMin2"), (1 - here).alias("frac2"), spread.alias("SDfrac"))

    possible = F.concat(F.filter("_edges", lambda e: e["m1"].isNotNull()), F.filter("_edges", lambda e: e["m1"].isNull()))
    empty = F.lit(None).cast("double")
    clonal = F.array(F.struct(F.col("_maj").alias("nMaj1"), F.col("_min").alias("nMin1"), F.lit(1.0).alias("frac1"), empty.alias("nMaj2"), empty.alias("nMin2"),
        empty.alias("frac2"), empty.alias("SDfrac")))
    rows = rows.withColumn("solutions", F.when(F.col("pval") <= sig, F.transform(possible, option)).otherwise(clonal))
    a = F.get("solutions", F.lit(0))
    states = {c: a[c] for c in ("nMaj1", "nMin1", "frac1", "nMaj2", "nMin2", "frac2")}
    return rows.withColumns(states).drop("_x", "_y", "_major", "_minor", "_edges", "_level", "_maj", "_min", "rho", "psi")


def call_subclones(baf_segmented: DataFrame, logr: DataFrame, rho_psi: DataFrame, gamma: float = 1.0, sig: float = 0.05, max_dist: float = 0.01, cn_cap: float = 1000) -> DataFrame:
    """Segments of segmented BAF with their calls; rho_psi: sample_id, rho, psi_t."""
    fit = rho_psi.select("sample_id", "rho", psi_from_psit("rho", "psi_t").alias("psi"))
    segments = materialise(segment_switchpoints(baf_segmented), "switchpoints")  # counted, met with LogR and given their means
    return call_segments(segment_logr_mean(segments, logr), fit, gamma, sig, max_dist, cn_cap)


def bootstrap_fraction_ci(baf_segmented: DataFrame, calls: DataFrame, rho_psi: DataFrame, n: int = 1000, seed: int = 0) -> DataFrame:
    """sd, lower and upper 2.5% rank of each option's fraction over n resamples of the segment's BAF. A segment is resampled once for all its
    options, with random numbers seeded by its key, so that reruns agree."""
    key = [*KEYS, "start_pos", "end_pos"]
    options = F.transform("solutions", lambda s, k: F.struct(k.alias("option"), s["nMaj1"].alias("m1"), s["nMin1"].alias("n1"), s["nMaj2"].alias("m2"), s["nMin2"].alias("n2")))
    written = materialise(calls.select(*key, "frac1", "solutions"), "opened")  # before the filter, which would work frac1 out anew
    opened = written.filter("frac1 < 1").select(*key, F.filter(options, lambda s: s["m1"].isNotNull()).alias("options"))
    inside = assign_points_to_intervals(baf_segmented.filter("baf_phased is not null").select(*KEYS, "pos", "baf_phased"), opened.select(*key).distinct())
    values = inside.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "baf_phased"))), lambda x: x["baf_phased"]).alias("baf_values"))  # the loci of one segment
    rows = opened.join(values, key).join(rho_psi.select("sample_id", "rho"), "sample_id").select(*key, "rho", "options", "baf_values")

    def work(batches):
        for p in batches:
            out = []
            for one in p.itertuples():
                text = f"{seed}|{one.sample_id}|{one.chrom}|{one.start_pos}"
                rng = np.random.default_rng(int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "big"))
                x, rho = np.asarray(one.baf_values, float), one.rho
                some = max(1, 1_000_000 // len(x))  # resamples drawn at once; the stream of numbers is that of one after another
                means = np.concatenate([x[rng.integers(0, len(x), (min(some, n - k), len(x)))].mean(axis=1) for k in range(0, n, some)])
                for o in one.options:
                    with np.errstate(divide="ignore", invalid="ignore"):
                        tau = np.sort((1 - rho + rho * o["m2"] - 2 * means * (1 - rho) - means * rho * (o["n2"] + o["m2"])) / (means * rho * (o["n1"] + o["m1"]) - means * rho * (o["n2"] + o["m2"]) - rho * o["m1"] + rho * o["m2"]))
                    out.append((one.sample_id, one.chrom, one.start_pos, one.end_pos, o["option"], float(tau.std(ddof=1)), float(tau[max(int(n * 0.025) - 1, 0)]), float(tau[int(n * 0.975) - 1])))
            yield pd.DataFrame(out, columns=[*key, "option", "sd_bs", "lo", "hi"])

    return rows.mapInPandas(work, "sample_id string, chrom string, start_pos long, end_pos long, option int, sd_bs double, lo double, hi double")


def with_bootstrap(calls: DataFrame, baf_segmented: DataFrame, rho_psi: DataFrame, n: int = 1000, seed: int = 0) -> DataFrame:
    """calls with bootstrap, a map of each option of two states to its sd_bs, lo and hi; null for clonal segments."""
    key = [*KEYS, "start_pos", "end_pos"]
    found = bootstrap_fraction_ci(baf_segmented, calls, rho_psi, n, seed)
    maps = found.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("option", F.struct("sd_bs", "lo", "hi")))).alias("bootstrap"))  # six options at most
    return calls.join(maps, key, "left")


def merge_segments(calls: DataFrame, baf_segmented: DataFrame, logr: DataFrame, rho_psi: DataFrame, baf_option: int = 3, max_gap: int = 3_000_000,
    gamma: float = 1.0, sig: float = 0.05, psi_mode: str = "consistent") -> DataFrame:
    """Greedy merging inside each sample's chromosome, shortest first, with the nearer neighbour first: segments at most max_gap apart join
    when both are clonal with one state, or when they lie in one square and neither BAF nor LogR differ (Welch, more than 10 values each).
    Returns sample_id, chrom, start_pos, end_pos, baf, logr. rho_psi: sample_id, rho, psi_t; psi_mode="compat" puts psi of all cells in the
    formulas that expect the tumour's."""
    fit = rho_psi.withColumn("_psi", F.col("psi_t") if psi_mode == "consistent" else psi_from_psit("rho", "psi_t")).select("sample_id", "rho", "_psi")
    null = lambda t: F.lit(None).cast(t)
    segs = calls.join(fit, "sample_id").select(*KEYS, F.lit(0).alias("kind"), F.col("start_pos").alias("pos"), "end_pos", F.col("baf").alias("v"),
        F.col("logr").alias("w"), "nMaj1", "nMin1", "frac1", "rho", "_psi")
    point = lambda df, k, c: df.filter(F.col(c).isNotNull()).select(*KEYS, F.lit(k).alias("kind"), "pos", null("bigint").alias("end_pos"), F.col(c).alias("v"), *(null("double").alias(x) for x in ("w", "nMaj1", "nMin1", "frac1", "rho", "_psi")))
    rows = segs.unionByName(point(baf_segmented, 1, "baf_phased")).unionByName(point(finite_logr(logr), 2, "logr"))

    def work(batches):
        for (sample, chrom), slices in groups(batches, KEYS):
            found, tracks = [], {1: [], 2: []}
            for b in slices:
                kind, pos, v = (b.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "pos", "v"))
                if kind[0] == 0:
                    found.append(b.filter(pa.array(kind == 0)).to_pandas())
                for k in tracks:
                    tracks[k].append((pos[kind == k], v[kind == k].astype(float)))
            if not found:
                continue
            s = pd.concat(found)
            whole = lambda k: [np.concatenate(x) for x in zip(*tracks.pop(k))]
            baf, ratio = (merging.Track(*whole(k), k == 1) for k in (1, 2))
            own = s[["pos", "end_pos", "v", "w", "nMaj1", "nMin1", "frac1"]].to_numpy(float).tolist()
            merged = merging.merge(own, baf, ratio, float(s["rho"].iloc[0]), float(s["_psi"].iloc[0]), baf_option, max_gap, gamma, sig)
            start, end, level, depth = zip(*(m[:4] for m in merged))
            yield pa.RecordBatch.from_arrays([pa.array([sample] * len(merged)), pa.array([chrom] * len(merged)), pa.array([int(x) for x in start]), pa.array([int(x) for x in end]),
                pa.array(level, pa.float64(), from_pandas=True), pa.array(depth, pa.float64(), from_pandas=True)], names=["sample_id", "chrom", "start_pos", "end_pos", "baf", "logr"])

    return in_order(rows, KEYS, ["kind", "pos"], work, "sample_id string, chrom string, start_pos long, end_pos long, baf double, logr double")


def average_states(profile: DataFrame) -> DataFrame:
    return profile.withColumns({"avg_major": cn_total_major(), "avg_minor": cn_total_minor()})


def apply_segments(baf_segmented: DataFrame, segments: DataFrame) -> DataFrame:
    """Segmented BAF with baf_seg from the segments that hold its loci."""
    placed = assign_points_to_intervals(baf_segmented.drop("baf_seg"), segments.select(*KEYS, "start_pos", "end_pos", F.col("baf").alias("baf_seg")))
    return placed.drop("start_pos", "end_pos")


def call_profile(baf_segmented: DataFrame, logr: DataFrame, rho_psi: DataFrame, max_state: int = 250, gamma: float = 1.0, sig: float = 0.05, max_dist: float = 0.01,
    baf_option: int = 3, draws: int = 1000) -> DataFrame:
    """Calls, merging, calls on what was merged, their bootstrap, and masking."""
    first = materialise(call_subclones(baf_segmented, logr, rho_psi, gamma, sig, max_dist), "calls")
    merged = materialise(merge_segments(first, baf_segmented, logr, rho_psi, baf_option, gamma=gamma), "merged")
    again = materialise(call_subclones(apply_segments(baf_segmented, merged), logr, rho_psi, gamma, sig, max_dist), "calls")
    return mask_high_states(with_bootstrap(again, baf_segmented, rho_psi, draws) if draws else again, max_state)


def suggest_refit(profile: DataFrame, chrom: str, pos: int, n_maj: float, n_min: float, gamma: float = 1.0) -> DataFrame:
    """Purity and ploidy if the segment at a place had a given state."""
    rho, psi, psi_t = rho_psi_from_segment("baf", "logr", F.lit(float(n_maj)), F.lit(float(n_min)), gamma)
    return segment_at_position(profile, chrom, pos).select("sample_id", "chrom", "start_pos", "end_pos", rho.alias("rho"), psi.alias("psi"), psi_t.alias("psi_t"))


def logr_calibration_x(profile: DataFrame, ploidy: DataFrame) -> DataFrame:
    """sample_id, shift, sd_max, sd_loss from clonal autosomal segments. shift brings the mean LogR of 1+1 to 0; with at most one of these the
    genome counts as doubled: shift is that of 2+0, else from the ploidy, and 2+2 stands for 1+1. sd_max is the largest spread among it, 2+1,
    3+1 and 4+1, at least 0.05; sd_loss the spread of 1+0, with at most one of these of all without minor copies, else sd_max."""
    clonal = F.col("frac1") == 1
    state = lambda a, b: clonal & (F.col("nMaj1") == a) & (F.col("nMin1") == b)
    own = lambda f, s: f(F.when(s, F.col("logr")))
    named = {"11": state(1, 1), "22": state(2, 2), "21": state(2, 1), "31": state(3, 1), "41": state(4, 1), "20": state(2, 0), "10": state(1, 0), "no": clonal & (F.col("nMin1") == 0)}
    rows = profile.groupBy("sample_id").agg(
        *(own(F.count, v).alias(f"n{k}") for k, v in named.items()), *(own(F.stddev_samp, v).alias(f"s{k}") for k, v in named.items()), *(own(F.avg, named[k]).alias(f"m{k}") for k in ("11", "20")),
    )
    doubled = F.col("n11") <= 1
    spread = [F.coalesce(F.when(doubled, F.col("s22")).otherwise(F.col("s11")), F.lit(0.0)), *(F.coalesce(f"s{k}", F.lit(0.0)) for k in ("21", "31", "41"))]
    shift = F.when(~doubled, -F.col("m11")).when(F.col("n20") > 0, -F.col("m20")).otherwise(-F.log2(2 / F.col("ploidy")))
    rows = rows.join(ploidy.select("sample_id", "ploidy"), "sample_id").select("*", shift.alias("shift"), F.greatest(*spread, F.lit(0.05)).alias("sd_max"))
    loss = F.when(F.col("n10") > 1, F.col("s10")).when(F.col("nno") > 1, F.col("sno")).otherwise(F.col("sd_max"))
    return rows.select("sample_id", "shift", "sd_max", loss.alias("sd_loss"))


def rank_matching_x(segs: DataFrame) -> DataFrame:
    """Adds cn: one more than the number of copies x >= 2 whose expected LogR log2(purity x + 1 - purity) lies below logr; exact ties stay under."""
    x = (F.pow(F.lit(2.0), F.col("logr")) - (1 - F.col("purity"))) / F.col("purity")
    below = F.ceil(x) - 1  # the largest whole number under x
    return segs.withColumn("cn", (F.greatest(below, F.lit(1)) + 1).cast("int"))


def call_x_segments(segs: DataFrame, calibration: DataFrame, purity: DataFrame) -> DataFrame:
    """Male X segments (sample_id, start_pos, end_pos, n, logr) -> kind, cn, is_clonal (null without a change), ccf and two-state rows.

    The sign of the mean LogR tells gains from losses, and its size, with the offset added, whether there is a change. Copies of gains are
    ranked among the levels log2(purity x + 1 - purity): up to 5 copies, the nearer level is clonal if it is as near as the largest spread over the
    level, at two digits; beyond, always. Losses have 0 copies; those of 95% of cells are clonal."""
    rows = segs.join(calibration, "sample_id").join(purity.select("sample_id", "purity"), "sample_id")
    rows = rank_matching_x(rows.withColumn("raw_logr", F.col("logr")).withColumn("logr", F.col("logr") + F.col("shift")))
    p, v, sd = F.col("purity"), F.col("logr"), F.col("sd_max")
    kind = F.when((F.col("raw_logr") >= 0) & (v > 1.96 * sd), "gain").when((F.col("raw_logr") < 0) & (v < -1.96 * sd), "loss").otherwise("none")
    level = lambda x: F.log2(p * x + 1 - p)
    two = lambda x: F.round(x, 2)
    low, high, rank = level(F.col("cn") - 1), level(F.col("cn").cast("double")), F.col("cn") - 1
    nearer_low = F.abs(v - low) < F.abs(v - high)
    near_low, near_high = two(v - low) <= two(sd / low), two(high - v) < two(sd / high)
    first = two(high - v) <= two(sd / high)  # rank 1 has no level below
    clonal_gain = F.when(rank == 1, first).when(rank >= 5, True).when(nearer_low, near_low).otherwise(near_high)
    copies = F.when((rank > 1) & nearer_low & clonal_gain, F.col("cn") - 1).otherwise(F.col("cn")).cast("double")
    none_left = F.greatest(F.when(p < 1, F.log2(F.when(p < 1, 1 - p).otherwise(1.0))).otherwise(F.log2(F.lit(0.01))), F.log2(F.lit(0.01)))
    lost = (1 - F.pow(F.lit(2.0), v)) / p
    clonal_loss = (two(F.abs(none_left - v)) < two(F.abs(F.col("sd_loss") / none_left))) | (lost >= 0.95)
    rows = rows.withColumns({"kind": kind, "_clonal_gain": clonal_gain, "_copies": copies, "_clonal_loss": clonal_loss})
    gain, loss = F.col("kind") == "gain", F.col("kind") == "loss"
    share = (F.pow(F.lit(2.0), v) - (p * (F.col("_copies") - 1) + 1 - p)) / p
    rows = rows.withColumns({"is_clonal": F.when(gain, F.col("_clonal_gain")).when(loss, F.col("_clonal_loss")), "cn": F.when(gain, F.col("_copies")).when(loss, 0.0).otherwise(1.0)})
    mixed = ~F.coalesce("is_clonal", F.lit(True))
    rows = rows.withColumn("ccf", F.when(mixed & gain, share).when(mixed & loss, lost).otherwise(1.0))
    swap, other = mixed & (F.col("ccf") <= 0.5), F.when(gain, F.col("cn") - 1).otherwise(1.0)
    return rows.withColumns({
        "nMaj1": F.when(swap, other).otherwise(F.col("cn")), "nMin1": F.lit(0.0), "frac1": F.when(swap, 1 - F.col("ccf")).otherwise(F.col("ccf")),
        "nMaj2": F.when(mixed, F.when(swap, F.col("cn")).otherwise(other)).otherwise(0.0), "nMin2": F.lit(0.0),
            "frac2": F.when(mixed, F.when(swap, F.col("ccf")).otherwise(1 - F.col("ccf"))).otherwise(0.0),
    }).drop("_clonal_gain", "_copies", "_clonal_loss")


def x_segments(logr: DataFrame, breakpoints: DataFrame | None = None, build: str = "hg38", gamma: float = 1000, kmin: int = 100) -> DataFrame:
    """Segments of the LogR of X between the pseudo-autosomal regions, by arm and in pieces between breakpoints (chrom, pos) that lie inside a
    sample's loci: sample_id, chrom, arm, start_pos, end_pos, n, logr. With breakpoints on X the last locus belongs to no piece."""
    low, high = MALE_X[build]
    left, right = X_CENTROMERE[build]
    x = finite_logr(logr).filter((F.col("chrom") == "X") & (F.col("pos") > low) & (F.col("pos") < high)).select("sample_id", "chrom", "pos", "logr")
    x = x.withColumn("arm", F.when(F.col("pos") < (left + right) / 2, "p").otherwise("q"))
    if breakpoints is None:
        pieces = x.withColumn("piece", F.lit(0))
    else:
        ends = x.groupBy("sample_id").agg(F.min("pos").alias("_first"), F.max("pos").alias("_last"))
        on_x = breakpoints.filter(F.col("chrom").isin("X", "chrX")).select("pos").distinct()
        cuts = ends.join(F.broadcast(on_x) if on_x.count() <= FEW else on_x, (F.col("pos") > F.col("_first")) & (F.col("pos") < F.col("_last")))
        marks = cuts.select("sample_id", "pos", F.lit(0).alias("_locus")).unionByName(x.select("sample_id", "pos", F.lit(1).alias("_locus"), "arm", "logr", "chrom"), allowMissingColumns=True)
        w = Window.partitionBy("sample_id").orderBy("pos", "_locus").rowsBetween(Window.unboundedPreceding, 0)
        counted = marks.withColumn("piece", F.sum(1 - F.col("_locus")).over(w)).filter("_locus = 1").join(ends, "sample_id")
        none = on_x.isEmpty()
        pieces = counted.filter(F.lit(none) | (F.col("pos") < F.col("_last"))).select("sample_id", "chrom", "pos", "logr", "arm", "piece")
    fitted = segment_logr(pieces.withColumn("arm", F.concat_ws(":", "arm", F.col("piece").cast("string"))), "logr", gamma, kmin)
    runs = run_islands(fitted, "fit", keys=[*KEYS, "arm"]).groupBy(*KEYS, "arm", "run_id").agg(F.min("pos").alias("start_pos"), F.max("pos").alias("end_pos"),
        F.count("*").alias("n"), F.avg("logr").alias("logr"))
    return runs.select(*KEYS, F.substring("arm", 1, 1).alias("arm"), "start_pos", "end_pos", "n", "logr")


def male_x(profile: DataFrame, logr: DataFrame, rho_psi: DataFrame, ploidy: DataFrame, males: DataFrame, breakpoints: DataFrame | None = None, build: str = "hg38") -> DataFrame:
    """The profile with the X of male samples (sample_id) called from LogR alone. Short changed segments at the centromere go; neighbours of an
    arm with equal mean copies join, with the first's states."""
    left, right = X_CENTROMERE[build]
    own = lambda df: df.join(males.select("sample_id").distinct(), "sample_id", "left_semi")
    autosomes = own(profile).filter(F.col("chrom") != "X")
    called = call_x_segments(x_segments(own(logr), breakpoints, build), logr_calibration_x(autosomes, ploidy), rho_psi.select("sample_id", F.col("rho").alias("purity")))
    short = (F.col("kind") != "none") & (F.col("end_pos") < F.col("start_pos") + 1_000_000)
    at_centre = ((F.col("arm") == "p") & (F.col("end_pos") > left - 1_000_000)) | ((F.col("arm") == "q") & (F.col("end_pos") < right + 1_000_000))
    mean = (F.col("nMaj1") + F.col("nMin1")) * F.col("frac1") + (F.col("nMaj2") + F.col("nMin2")) * F.col("frac2")
    kept = called.filter(~(short & at_centre)).withColumn("mean_cn", mean)
    w = Window.partitionBy("sample_id", "arm").orderBy("start_pos")
    new = F.coalesce((F.abs(F.col("mean_cn") - F.lag("mean_cn").over(w)) > 0.01).cast("int"), F.lit(0))
    runs = kept.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    states = ["nMaj1", "nMin1", "frac1", "nMaj2", "nMin2", "frac2", "kind", "is_clonal"]
    first = F.min_by(F.struct(*states), "start_pos").alias("_s")
    merged = runs.groupBy("sample_id", "chrom", "arm", "_run").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"),
        (F.sum(F.col("logr") * F.col("n")) / F.sum("n")).alias("logr"), F.sum("n").alias("n"), first)
    rows = merged.select("sample_id", "chrom", "start_pos", "end_pos", "logr", "n", *(F.col(f"_s.{c}").alias(c) for c in states[:6]))
    others = profile.join(males.select("sample_id").distinct().withColumn("chrom", F.lit("X")), ["sample_id", "chrom"], "left_anti")
    return others.unionByName(rows.select(*(c for c in rows.columns if c in profile.columns)), allowMissingColumns=True)


def locus_overlay(segments: DataFrame, loci: DataFrame) -> DataFrame:
    return interval_overlap(segments, loci)
