"""Purity and ploidy: score grids over segments, and the choice among their optima.

segments: sample_id, b (BAF), r (LogR), length, and size, mean, sd where clonality is tested."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import cn_alleles, div, expected_baf, nearest_edge, psi_t_from_cn, rescue_negative_minor, rho_psi_from_segment, t_statistic
from ..functions.stats import binomial_ln_pmf, one_sample_t
from ..storage import materialise
from . import grids

SMALLER_BETTER = {0: True, 1: False, 2: False, 3: False}
CLONAL_SMALLER_BETTER = {0: False, 1: True, 2: True, 3: True, 4: False}
CAP = 1000.0


def rho_psi_grid(spark, min_psi: float = 1.0, max_psi: float = 5.4, min_rho: float = 0.07, max_rho: float = 1.03, d_psi: float = 0.05, d_rho: float = 0.01) -> DataFrame:
    """i, j, psi, rho: points from 1, psi by row."""
    steps = lambda lo, hi, d: round((hi - lo) / d) + 1
    psi = spark.range(1, steps(min_psi, max_psi, d_psi) + 1).select(F.col("id").cast("int").alias("i"), F.round(F.lit(min_psi) + (F.col("id") - 1) * d_psi, 6).alias("psi"))
    rho = spark.range(1, steps(min_rho, max_rho, d_rho) + 1).select(F.col("id").cast("int").alias("j"), F.round(F.lit(min_rho) + (F.col("id") - 1) * d_rho, 6).alias("rho"))
    return psi.join(F.broadcast(rho), how="cross")


def score_grid_ascat(grid: DataFrame, segments: DataFrame, metric: int = 1, gamma: float = 1.0, uninformative: float = 0.51) -> DataFrame:
    """sample_id, i, j, psi, rho, score. Metrics: 0 squared distance of the minor allele from whole numbers (least is best); 1 the same turned
    round; 2 both alleles; 3 as 2, homozygous deletions weighing more. Which allele is minor is decided by their sums at the point."""
    out = ["sum_a", "sum_b", "if_a", "if_b"]
    parts = grids.score(grid, segments, lambda s, psi, rho: grids.ascat_sums(s, psi, rho, metric, gamma, uninformative), np.add, ["b", "r", "length"], out)
    sums = parts.groupBy("sample_id", "i", "j", "psi", "rho").agg(*(F.sum(c).alias(c) for c in out))
    return sums.select("sample_id", "i", "j", "psi", "rho", F.when(F.col("sum_a") < F.col("sum_b"), F.col("if_a")).otherwise(F.col("if_b")).alias("score"))


def local_minima(scored: DataFrame, radius: int = 3, score: str = "score") -> DataFrame:
    """Strict minima of their (2 radius + 1)-squared neighbourhood; points that near the border don't count. A sample's grid, of
    fixed size, is a group."""

    def work(p: pd.DataFrame) -> pd.DataFrame:
        return p[grids.strict_minima(p["i"].to_numpy(int), p["j"].to_numpy(int), p[score].to_numpy(float), radius)]

    return scored.groupBy("sample_id").applyInPandas(work, scored.schema)


def grid_point_stats(grid: DataFrame, segments: DataFrame, gamma: float = 1.0) -> DataFrame:
    """Ploidy, share of zero copies, the same outside BAF 0.5, and the score's theoretical maximum, at each point of a grid (or of its
    candidates, which carry sample_id)."""
    out = ["copies", "known", "whole", "zero", "zero_odd", "odd"]
    parts = grids.score(grid, segments, lambda s, psi, rho: grids.point_sums(s, psi, rho, gamma), np.add, ["b", "r", "length"], out)
    share = lambda top, below: F.when(F.sum("known") > 0, div(F.sum(top), F.sum(below)))
    return parts.groupBy("sample_id", "i", "j", "psi", "rho").agg(share("copies", "whole").alias("ploidy"), share("zero", "whole").alias("percent_zero"),
        F.coalesce(share("zero_odd", "odd"), F.lit(0.0)).alias("percent_zero_odd"), (0.25 * F.sum("whole")).alias("most"))


def select_ascat_optimum(scored: DataFrame, segments: DataFrame, metric: int = 1, min_ploidy: float = 1.6, max_ploidy: float = 4.8, min_rho: float = 0.1,
    min_goodness: float = 63, gamma: float = 1.0, allow_pure: bool = True) -> DataFrame:
    """sample_id, psi, rho, ploidy, goodness: the best local optimum that passes the filters. Where none does and allow_pure holds, points with
    rho over 1 are blocked and the test for zero copies is left out. The last of equal scores wins; rho is at most 1. No optimum: null."""
    smaller = SMALLER_BETTER[metric]
    signed = scored.withColumn("m", F.col("score") if smaller else -F.col("score")).select("sample_id", "i", "j", "psi", "rho", "m")

    def work(p: pd.DataFrame) -> pd.DataFrame:
        turns = []
        for turn in (1, 2) if allow_pure else (1,):
            m = p["m"].to_numpy(float) if turn == 1 else np.where(p["rho"] > 1, 1e20, p["m"])
            turns.append(p.assign(m=m, turn=turn)[grids.strict_minima(p["i"].to_numpy(int), p["j"].to_numpy(int), m, 3)])
        return pd.concat(turns)

    minima = signed.groupBy("sample_id").applyInPandas(work, "sample_id string, i int, j int, psi double, rho double, m double, turn int")
    minima = materialise(minima, "local-minima")  # a few rows a sample
    point = ["sample_id", "i", "j", "psi", "rho"]
    s = minima.join(grid_point_stats(minima.select(*point).distinct(), segments, gamma), point)
    s = s.withColumn("goodness", 100 * (1 - F.col("m") / F.col("most")) if smaller else -100 * F.col("m") / F.col("most"))
    inside = (F.col("ploidy") > min_ploidy) & (F.col("ploidy") < max_ploidy)
    some_zero = F.col("ploidy").between(min_ploidy, max_ploidy) & ((F.col("percent_zero") > 0.01) | (F.col("percent_zero_odd") > 0.1))
    good = (F.col("rho") >= min_rho) & (F.col("goodness") >= min_goodness) & F.when(F.col("turn") == 1, some_zero).otherwise(inside)
    order = F.struct(F.col("turn"), F.col("m"), -F.col("i"), -F.col("j"))
    best = s.filter(good).groupBy("sample_id").agg(F.min_by(F.struct("psi", F.least("rho", F.lit(1.0)).alias("rho"), "ploidy", "goodness"), order).alias("b"))
    return segments.select("sample_id").distinct().join(best, "sample_id", "left").select("sample_id", "b.*")


def refine_bounds(optimum: DataFrame, min_psi: float = 1.0, max_psi: float = 5.4, min_rho: float = 0.1, max_rho: float = 1.0) -> DataFrame:
    """The second grid's bounds: a tenth of the range of psi, and of rho itself, round the optimum, moved inside the limits."""

    def around(c: str, width: Column, lo: float, hi: float) -> tuple[Column, Column]:
        low = F.when(F.col(c) - width / 2 < lo, F.lit(lo)).when(F.col(c) + width / 2 > hi, F.lit(hi) - width).otherwise(F.col(c) - width / 2)
        return low, low + width

    psi = around("psi", F.lit(0.1 * (max_psi - min_psi)), min_psi, max_psi)
    rho = around("rho", 0.1 * F.col("rho"), min_rho, max_rho)
    return optimum.select("sample_id", psi[0].alias("psi_min"), psi[1].alias("psi_max"), rho[0].alias("rho_min"), rho[1].alias("rho_max"))


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns that what stands above reads: by way of a generator, since plain projections are merged into one and then
    compute a nested expression again wherever it is used."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def _state_columns(rows: DataFrame, gamma: float, cap: float = CAP) -> DataFrame:
    """Adds n_major, n_minor (rescued), shift, edge (states of first preference), nMaj, nMin and level (the closer of the two)."""
    n_a, n_b = cn_alleles("b", F.coalesce("r", F.lit(0.0)), "rho", "psi", gamma)
    rows = _once(_once(rows, _a=n_a, _b=n_b), _major=F.greatest("_a", "_b"), _minor=F.least("_a", "_b"))
    major, minor = rescue_negative_minor("_major", "_minor", "b", cap)
    rows = _once(rows, n_major=major, n_minor=minor).withColumn("shift", F.col("n_major") - F.col("_major"))
    rows = _once(rows, edge=nearest_edge("rho", "b", "n_major", "n_minor"))  # the first of the candidate edges
    l1, l2 = expected_baf("rho", F.col("edge.m1"), F.col("edge.n1")), expected_baf("rho", F.col("edge.m2"), F.col("edge.n2"))
    pick = lambda x, y: F.when(first | (l2.isNull()), x).otherwise(y)
    rows = _once(rows, _l1=l1, _l2=l2)
    l1, l2 = F.col("_l1"), F.col("_l2")
    first = F.abs(l1 - F.col("b")) <= F.abs(l2 - F.col("b"))
    return _once(rows, **{"level": pick(l1, l2), "nMaj": pick(F.col("edge.m1"), F.col("edge.m2")), "nMin": pick(F.col("edge.n1"), F.col("edge.n2"))}).drop("_a", "_b", "_major", "_minor", "_l1", "_l2")


def segment_is_clonal(segments: DataFrame, rho_psi: DataFrame | None = None, sig: float = 0.05, max_dist: float = 0.01, gamma: float = 1.0) -> DataFrame:
    """Adds t, pval, is_clonal and balanced to segments (with rho and psi, or joined with them): whether one state explains the BAF."""
    rows = _state_columns(segments if rho_psi is None else segments.join(rho_psi.select("sample_id", "rho", "psi"), "sample_id"), gamma)
    rows = rows.withColumns({"t": t_statistic("size", "b", "sd", "level"), "pval": one_sample_t("size", "b", "sd", "level", max_dist)})
    rows = rows.withColumn("pval", F.when(F.col("sd") == 0, 0.0).otherwise(F.col("pval")))
    return rows.withColumns({"is_clonal": F.coalesce((F.col("pval") > sig) & (F.col("shift") < 1), F.lit(False)), "balanced": F.col("nMaj") == F.col("nMin")})


def segment_standardised_error(segments: DataFrame, rho_psi: DataFrame | None = None, gamma: float = 1.0) -> DataFrame:
    """Adds t_error: the t statistic of the mean against the closest of the square's four corners; null for segments without spread."""
    rows = segments if rho_psi is None else segments.join(rho_psi.select("sample_id", "rho", "psi"), "sample_id")
    all_copies = F.col("psi") * F.pow(F.lit(2.0), F.coalesce("r", F.lit(0.0)) / gamma)
    lifted = lambda n: F.when((n < 0) | n.isNull(), 0.01).otherwise(n)
    rows = rows.withColumns({"_x": lifted((F.col("rho") - 1 + F.col("b") * all_copies) / F.col("rho")), "_y": lifted((F.col("rho") - 1 + (1 - F.col("b")) * all_copies) / F.col("rho"))})
    up, down = (lambda c: F.ceil(c).cast("double")), (lambda c: F.floor(c).cast("double"))
    corners = [(down("_x"), up("_y")), (up("_x"), up("_y")), (down("_x"), down("_y")), (up("_x"), down("_y"))]
    level = lambda a, c: div(1 - F.col("rho") + F.col("rho") * a, 2 - 2 * F.col("rho") + F.col("rho") * (a + c))
    levels = F.array(*(F.struct(F.abs(level(*c) - F.col("b")).alias("d"), F.lit(i).alias("i"), level(*c).alias("l")) for i, c in enumerate(corners)))
    best = F.array_min(F.filter(levels, lambda x: x["d"].isNotNull()))["l"]
    return rows.withColumn("t_error", F.when((F.col("size") > 0) & (F.col("sd") != 0), t_statistic("size", "mean", "sd", best))).drop("_x", "_y")


def segment_ln_likelihood_ratio(segments: DataFrame, rho_psi: DataFrame | None = None, read_depth: float = 30, gamma: float = 1.0) -> DataFrame:
    """Adds ln_ratio: log of the likelier of the nearest edge's two binomial levels over the other; 0 where either can't be."""
    rows = segments if rho_psi is None else segments.join(rho_psi.select("sample_id", "rho", "psi"), "sample_id")
    all_copies = F.col("psi") * F.pow(F.lit(2.0), F.coalesce("r", F.lit(0.0)) / gamma)
    x, y = (F.col("rho") - 1 + F.col("b") * all_copies) / F.col("rho"), (F.col("rho") - 1 + (1 - F.col("b")) * all_copies) / F.col("rho")
    rows = _once(rows, _x=x, _y=y)
    major, minor = rescue_negative_minor("_x", "_y", "b", CAP)
    rows = _once(_once(rows, _major=major, _minor=minor), _e=nearest_edge("rho", "b", "_major", "_minor"))
    n = F.round(F.col("size") * read_depth).cast("double")
    k = F.greatest(F.lit(0.0), F.least(n, F.round(F.col("mean") * F.col("size") * read_depth).cast("double")))
    inside = lambda p: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(p, F.lit(0.0))))
    l1, l2 = expected_baf("rho", F.col("_e.m1"), F.col("_e.n1")), expected_baf("rho", F.col("_e.m2"), F.col("_e.n2"))
    rows = rows.withColumns({"_p": binomial_ln_pmf(k, n, inside(l1)), "_q": binomial_ln_pmf(k, n, inside(l2))})  # logs: a probability near the least double has few digits
    good = l1.isNotNull() & l2.isNotNull() & (F.col("_p") > grids.LEAST_LOG) & (F.col("_q") > grids.LEAST_LOG)
    return rows.withColumn("ln_ratio", F.when(good, F.abs(F.col("_p") - F.col("_q"))).otherwise(0.0)).drop("_x", "_y", "_major", "_minor", "_e", "_p", "_q")


def score_grid_clonal(grid: DataFrame, segments: DataFrame, metric: int = 0, gamma: float = 1.0, sig: float = 0.05, max_dist: float = 0.01,
    uninformative: float = 0.51, read_depth: float = 30) -> DataFrame:
    """sample_id, i, j, psi, rho, score and ref (the longest clonal unbalanced segment: b, r, nMaj, nMin, length). Metrics: 0 clonal share of the
    genome (largest is best), 1 mean squared t, 2 mean squared difference of level and mean BAF, 3 the same by length, 4 sum of log ratios.
    grid: points for all samples, bounds by sample (as refine_bounds() gives them), or a few points for each sample."""
    place = -F.col("start_pos" if "start_pos" in segments.columns else "seg_id")
    informative = segments.filter(F.col("b") > uninformative).withColumn("place", place.cast("double"))
    out = ["top", "below", "longest", "place", "b", "r", "n_maj", "n_min"]

    def sums(s, psi, rho):
        return np.concatenate(grids.clonal_sums(s, psi, rho, metric, gamma, sig, max_dist, read_depth, CAP))

    def add(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        later = (y[2] > x[2]) | ((y[2] == x[2]) & (y[3] > x[3]))
        return np.concatenate([x[:2] + y[:2], np.where(later, y[2:], x[2:])])

    limits = lambda s: {**s, "limit": grids.critical_t(s["size"] - 1, sig)}  # noqa: E731  a batch's at once
    parts = grids.score(grid, informative, sums, add, ["b", "r", "length", "size", "mean", "sd", "place"], out, prepare=limits)
    ref = F.struct("b", "r", F.col("n_maj").alias("nMaj"), F.col("n_min").alias("nMin"), F.col("longest").alias("length"))
    total = F.sum("top") if metric == 4 else div(F.sum("top"), F.sum("below"))
    found = F.max_by(F.when(F.col("longest") > 0, ref), F.struct("longest", "place"))
    return parts.groupBy("sample_id", "i", "j", "psi", "rho").agg(F.coalesce(total, F.lit(0.0)).alias("score"), found.alias("ref"))


def centroid_optimum(scored: DataFrame, smaller: bool = False) -> DataFrame:
    """The best points' median place, and of them the one nearest to it (the last of ties); n_best of them."""
    sign = 1 if smaller else -1
    best = scored.groupBy("sample_id").agg(F.min(sign * F.col("score")).alias("_best"))
    tied = scored.join(best, "sample_id").filter(sign * F.col("score") == F.col("_best"))
    centre = tied.groupBy("sample_id").agg(F.percentile("i", F.lit(0.5)).alias("_ci"), F.percentile("j", F.lit(0.5)).alias("_cj"), F.count("*").alias("n_best"))
    d = (F.col("i") - F.col("_ci")) * (F.col("i") - F.col("_ci")) + (F.col("j") - F.col("_cj")) * (F.col("j") - F.col("_cj"))
    near = tied.join(centre, "sample_id").withColumn("_d", d)
    kept = [c for c in scored.columns if c != "sample_id"]
    return near.groupBy("sample_id").agg(F.min_by(F.struct(*kept, "n_best"), F.struct("_d", (-F.col("i")).alias("x"), (-F.col("j")).alias("y"))).alias("b")).select("sample_id", "b.*")


def reference_segment_solution(optimum: DataFrame, gamma: float = 1.0, segments: DataFrame | None = None, clonal_metric: int = 0, min_ploidy: float = 1.6,
    max_ploidy: float = 4.8, min_rho: float = 0.1, max_rho: float = 1.0) -> DataFrame:
    """rho and psi that make the optimum's reference segment exactly its state, null where that rho isn't above 0; without such a segment the
    sample has no tumour: rho 1, psi 2. With segments, also ploidy (all segments' at that point; 2 without a reference), distance (the clonal metric there;
    1 without a reference, infinite without a rho) and is_better: whether the point lies inside the limits and its distance beats the optimum's score."""
    rho, _, psi_t = rho_psi_from_segment("ref.b", "ref.r", "ref.nMaj", "ref.nMin", gamma)
    none, good = F.col("ref").isNull(), rho > 0
    kept = [] if segments is None else [F.col("score").alias("_grid")]
    ref = optimum.select("sample_id", F.when(none, 1.0).when(good, rho).alias("rho"), F.when(none, 2.0).when(good, psi_t).alias("psi"), (~none).alias("has_reference"), *kept)
    if segments is None:
        return ref
    ref = materialise(ref, "reference-fit")  # a row a sample, behind a grid
    points = ref.filter("has_reference and rho is not null").select("sample_id", F.lit(1).alias("i"), F.lit(1).alias("j"), "psi", "rho")
    scored = score_grid_clonal(points, segments, clonal_metric, gamma).select("sample_id", "score")
    ploidy = F.when(F.col("has_reference"), F.col("ploidy")).otherwise(2.0)
    distance = F.when(~F.col("has_reference"), 1.0).when(F.col("rho").isNull(), float("inf")).otherwise(F.coalesce("score", F.lit(0.0)))
    better = F.col("distance") < F.col("_grid") if CLONAL_SMALLER_BETTER[clonal_metric] else F.col("distance") > F.col("_grid")
    inside = F.col("psi").between(min_ploidy, max_ploidy) & F.col("rho").between(min_rho, max_rho)
    found = ref.join(mean_ploidy(segments, points, gamma), "sample_id", "left").join(scored, "sample_id", "left").withColumns({"ploidy": ploidy, "distance": distance})
    return found.select("sample_id", "rho", "psi", "has_reference", "ploidy", "distance", F.coalesce(inside & better, F.lit(False)).alias("is_better"))


def mean_ploidy(segments: DataFrame, points: DataFrame, gamma: float = 1.0) -> DataFrame:
    """sample_id, ploidy: both alleles' unrounded copies at each sample's point (rho, psi), weighted by length."""
    n_a, n_b = cn_alleles("b", "r", "rho", "psi", gamma)
    rows = segments.select("sample_id", "b", "r", "length").join(points.select("sample_id", "rho", "psi"), "sample_id")
    return rows.groupBy("sample_id").agg(div(F.sum((n_a + n_b) * F.col("length")), F.sum("length")).alias("ploidy"))


def recalc_psi_t(segments: DataFrame, rho_psi: DataFrame, include_subclonal: bool = False, sig: float = 0.05, max_dist: float = 0.01, gamma: float = 1.0) -> DataFrame:
    """Tumour ploidy by sample, each segment's from its state and LogR, weighted by length; the fit's own psi where no segment counts."""
    rows = segment_is_clonal(drop_short(segments), rho_psi, sig, max_dist, gamma)
    rows = rows if include_subclonal else rows.filter("is_clonal")
    own = psi_t_from_cn(F.col("nMaj") + F.col("nMin"), "r", "rho", gamma)
    found = rows.groupBy("sample_id").agg(div(F.sum(own * F.col("length")), F.sum("length")).alias("_psi"))
    return rho_psi.join(found, "sample_id", "left").select("sample_id", "rho", F.coalesce("_psi", "psi").alias("psi_t"))


def drop_short(segments: DataFrame) -> DataFrame:
    return segments.filter("length > 1")


def fit_copy_number(segments: DataFrame, preset: DataFrame | None = None, metric: int = 1, clonal_metric: int = 0, gamma: float = 1.0, min_ploidy: float = 1.6,
    max_ploidy: float = 4.8, min_rho: float = 0.1, max_rho: float = 1.0, min_goodness: float = 63, mirrored_baf: bool = False) -> DataFrame:
    """sample_id, method, rho, psi, ploidy, distance, is_best: the coarse optimum (ASCAT), the refined grid's (FRAC_GENOME; psi is the tumour's
    from clonal segments, ploidy all segments' at the point) and its reference segment's (REF_SEG). distance is the clonal metric. REF_SEG is best
    where its point lies inside the limits of ploidy and purity and its distance beats the grid's; a sample without a reference segment counts as
    rho 1, psi 2 and distance 1, a reference without a rho as infinitely far. A preset (sample_id, rho, psi) takes the coarse grid's place. With
    mirrored_baf the coarse grid sees 1 - b: it then weighs all segments alike under metric 0, and nothing changes under the others but which of two alleles
    with equal sums counts."""
    spark, segments = segments.sparkSession, materialise(segments, "fit-segments")  # read by each of the steps
    if preset is None:
        grid = rho_psi_grid(spark, max(min_ploidy - 0.6, 0), max_ploidy + 0.6, max(min_rho - 0.03, 0.05), max_rho + 0.03)
        seen = segments.withColumn("b", 1 - F.col("b")) if mirrored_baf else segments
        coarse = select_ascat_optimum(score_grid_ascat(grid, seen, metric, gamma), seen, metric, min_ploidy, max_ploidy, min_rho, min_goodness, gamma)
    else:
        coarse = preset.select("sample_id", "psi", "rho", F.col("psi").alias("ploidy"), F.lit(None).cast("double").alias("goodness"))
    coarse = materialise(coarse.filter("psi is not null"), "coarse-fit")
    smaller, used = CLONAL_SMALLER_BETTER[clonal_metric], drop_short(segments)
    bounds = refine_bounds(coarse, min_ploidy, max_ploidy, min_rho, max_rho)
    best = materialise(centroid_optimum(score_grid_clonal(bounds, used, clonal_metric, gamma), smaller), "fine-fit")
    pure = best.withColumn("rho", F.least("rho", F.lit(1.0)))
    grid_fit = (
        pure.join(recalc_psi_t(segments, pure.select("sample_id", "rho", "psi"), gamma=gamma).select("sample_id", "psi_t"), "sample_id")
        .join(mean_ploidy(used, best, gamma), "sample_id").select("sample_id", "rho", F.col("psi_t").alias("psi"), "ploidy", F.col("score").alias("distance"))
    )
    # the reference segment's point, scored like the grid's
    ref_fit = reference_segment_solution(best, gamma, used, clonal_metric, min_ploidy, max_ploidy, min_rho, max_rho)
    contest = ref_fit.select("sample_id", F.col("is_better").alias("won"))
    none = F.lit(None).cast("double")
    rows = [
        coarse.select("sample_id", F.lit("ASCAT").alias("method"), "rho", "psi", "ploidy", none.alias("distance"), F.lit(None).cast("boolean").alias("is_best")),
        grid_fit.join(contest, "sample_id").select("sample_id", F.lit("FRAC_GENOME").alias("method"), "rho", "psi", "ploidy", "distance", (~F.col("won")).alias("is_best")),
        ref_fit.join(contest, "sample_id").select("sample_id", F.lit("REF_SEG").alias("method"), "rho", "psi", "ploidy", "distance", F.col("won").alias("is_best")),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])
