"""Known truth: tracks built from a chosen purity, ploidy and states must give them back."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from acn.operators import calls, fit, intervals, windows

RHO, PSI_T = 0.7, 2.4


def levels(maj, mnr, share=1.0, other=(1, 1)):
    from math import log2

    total = share * (maj + mnr) + (1 - share) * sum(other)
    major = share * maj + (1 - share) * other[0]
    baf = (1 - RHO + RHO * major) / (2 - 2 * RHO + RHO * total)
    return baf, log2((2 - 2 * RHO + RHO * total) / (2 - 2 * RHO + RHO * PSI_T))


@pytest.fixture(scope="module")
def segments(spark):
    states = [(1, 1, 400), (2, 1, 300), (2, 0, 150), (1, 0, 200), (3, 1, 120), (2, 2, 100)]
    rows = [("s1", i, *levels(a, b), n, n, levels(a, b)[0], 0.02) for i, (a, b, n) in enumerate(states)]
    return spark.createDataFrame(rows, "sample_id string, seg_id int, b double, r double, length int, size int, mean double, sd double")


def test_fit_returns_purity(spark, segments):
    got = {r["method"]: r for r in fit.fit_copy_number(segments, metric=1).collect()}
    assert got["FRAC_GENOME"]["rho"] == pytest.approx(RHO, abs=0.02)
    assert got["FRAC_GENOME"]["psi"] == pytest.approx(PSI_T, abs=0.08)


def test_mirrored_baf_swaps_the_alleles(spark, segments):
    grid = fit.rho_psi_grid(spark, 1.5, 3.5, 0.3, 1.0, 0.25, 0.1)
    scores = lambda df, m: {(r["i"], r["j"]): r["score"] for r in fit.score_grid_ascat(grid, df, m).collect()}
    turned = segments.withColumn("b", 1 - F.col("b"))
    assert scores(segments, 1) == pytest.approx(scores(turned, 1)) and scores(segments, 0) != pytest.approx(scores(turned, 0))
    got = [{r["method"]: (r["rho"], r["psi"]) for r in fit.fit_copy_number(segments, mirrored_baf=m).collect()} for m in (False, True)]
    assert got[0] == got[1]


def test_reference_segment_against_the_grid(spark, segments):
    """The reference segment wins where the grid misses the truth, and only inside the limits."""

    def fitted(segs, rho, **limits):
        preset = spark.createDataFrame([("s1", rho, PSI_T)], "sample_id string, rho double, psi double")
        return {r["method"]: r for r in fit.fit_copy_number(segs, preset, **limits).collect()}

    # round 0.6 the window ends at 0.63, where the 2+1 segment is just close enough to be clonal and to be the reference
    long = segments.withColumn("length", F.when(F.col("seg_id") == 1, 900).otherwise(F.col("length")))
    got = fitted(long, 0.6)
    assert got["REF_SEG"]["is_best"] and not got["FRAC_GENOME"]["is_best"] and got["ASCAT"]["is_best"] is None and got["ASCAT"]["distance"] is None
    assert got["REF_SEG"]["rho"] == pytest.approx(RHO, abs=1e-6) and got["REF_SEG"]["psi"] == pytest.approx(PSI_T, abs=1e-6)
    assert got["REF_SEG"]["distance"] == 1.0 > got["FRAC_GENOME"]["distance"] > 0 and got["ASCAT"]["ploidy"] == PSI_T
    n_all = {0: 2, 1: 3, 2: 2, 3: 1, 4: 4, 5: 4}
    lengths = {r["seg_id"]: r["length"] for r in long.collect()}
    assert got["REF_SEG"]["ploidy"] == pytest.approx(sum(n_all[i] * n for i, n in lengths.items()) / sum(lengths.values()), abs=1e-6)
    # the grid holds the truth: no distance is better than its own
    got = fitted(long, RHO)
    assert got["FRAC_GENOME"]["is_best"] and not got["REF_SEG"]["is_best"] and got["FRAC_GENOME"]["distance"] == got["REF_SEG"]["distance"] == 1.0
    # better, but outside the limits
    got = fitted(long, 0.6, max_rho=0.65)
    assert got["FRAC_GENOME"]["is_best"] and not got["REF_SEG"]["is_best"] and got["REF_SEG"]["distance"] == 1.0
    # no clonal segment: no reference, so no tumour
    noise = segments.withColumns({"b": F.lit(0.53), "mean": F.lit(0.53), "sd": F.lit(0.0001)})
    got = fitted(noise, RHO)
    assert (got["REF_SEG"]["rho"], got["REF_SEG"]["psi"], got["REF_SEG"]["ploidy"], got["REF_SEG"]["distance"], got["REF_SEG"]["is_best"]) == (1.0, 2.0, 2.0, 1.0, True)


def test_minima_against_all_neighbours():
    from acn.operators import grids

    rng = np.random.default_rng(2)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(3, 30), np.arange(5, 27), indexing="ij"))
    for radius in (1, 3):
        m = rng.integers(0, 40, len(i)).astype(float)
        m[rng.integers(0, len(i), 5)] = np.nan
        near = (np.abs(i[:, None] - i) <= radius) & (np.abs(j[:, None] - j) <= radius) & ~np.eye(len(i), dtype=bool)
        inside = (i >= 3 + radius) & (i <= 29 - radius) & (j >= 5 + radius) & (j <= 26 - radius)
        want = inside & ~np.isnan(m) & ~(near & (m[None, :] <= m[:, None])).any(axis=1)
        assert (grids.strict_minima(i, j, m, radius) == want).all() and want.any()


def test_subclonal_fraction_is_found(spark):
    rows = []
    for s, (maj, mnr, share) in enumerate([(1, 1, 1.0), (2, 1, 0.3), (2, 1, 1.0)]):
        b, r = levels(maj, mnr, share)
        rows += [("s1", "1", s * 10_000_000 + i * 1000, b + 0.001 * (-1) ** i, b, r) for i in range(200)]
    df = spark.createDataFrame(rows, "sample_id string, chrom string, pos long, baf_phased double, baf_seg double, logr double")
    rho = spark.createDataFrame([("s1", RHO, PSI_T)], "sample_id string, rho double, psi_t double")
    got = calls.call_subclones(df, df, rho).orderBy("start_pos").collect()
    assert [(g["nMaj1"], g["nMin1"]) for g in (got[0], got[2])] == [(1, 1), (2, 1)] and got[0]["frac1"] == 1
    shares = {(got[1]["nMaj1"], got[1]["nMin1"]): got[1]["frac1"], (got[1]["nMaj2"], got[1]["nMin2"]): got[1]["frac2"]}
    assert shares[2.0, 1.0] == pytest.approx(0.3, abs=0.01) and shares[1.0, 1.0] == pytest.approx(0.7, abs=0.01)
    merged = calls.merge_segments(calls.call_subclones(df, df, rho), df, df, rho).collect()
    assert len(merged) == 3  # gaps above 3 Mb keep them apart


def test_interval_strategies_agree(spark):
    p = spark.range(2000).select(F.lit("s").alias("sample_id"), F.lit("1").alias("chrom"), (F.col("id") * 7919 % 5_000_000).alias("pos"))
    iv = spark.range(50).select(F.lit("s").alias("sample_id"), F.lit("1").alias("chrom"), (F.col("id") * 97_003).alias("start_pos"), (F.col("id") * 97_003 + 1_500_000).alias("end_pos"))
    a, b = (intervals.assign_points_to_intervals(p, iv, strategy=s) for s in ("broadcast", "bins"))
    assert a.count() == b.count() > 0 and a.exceptAll(b.select(*a.columns)).count() == 0
    pieces = intervals.interval_disjoin(iv).agg(F.sum(F.col("end_pos") - F.col("start_pos") + 1)).first()[0]
    assert pieces == 49 * 97_003 + 1_500_001


def test_empty_tables(spark):
    e = spark.createDataFrame([], "sample_id string, chrom string, pos long, logr double, baf_seg double")
    assert windows.run_islands(e, "baf_seg").count() == 0
    assert windows.running_median(e, "logr", 5).count() == 0
    assert windows.big_gap_split(e).count() == 0


def test_spline_correction_by_sample(spark):
    """Residuals of each sample against least squares in numpy, in one job for all of them."""
    from acn.operators import regression

    rng = np.random.default_rng(4)
    rows, want = [], {}
    for s, n in (("a", 300), ("b", 200), ("c", 80)):
        x, z = rng.uniform(0.3, 0.7, n), rng.uniform(0.2, 0.6, n) if s != "c" else np.repeat([0.25, 0.5], n // 2)
        y = np.sin(8 * x) + z * z + rng.normal(0, 0.05, n)
        basis = [np.ones(n)]
        for v in (x, z):
            k = np.quantile(v, [0, 0.25, 0.5, 0.75, 1])
            basis.append(v)
            if len(set(k)) > 2:
                cube = lambda u: np.maximum(u, 0) ** 3
                d = [(cube(v - k[i]) - cube(v - k[4])) / (k[4] - k[i]) if k[4] > k[i] else 0 * v for i in range(4)]
                basis += [d[i] - d[3] for i in range(3)]
        b = np.column_stack(basis)
        residual = y - b @ np.linalg.lstsq(b, y, rcond=None)[0]
        for i in range(n):
            rows.append((s, "1", i, float(y[i]), float(x[i]), float(z[i])))
            want[s, i] = residual[i]
    df = spark.createDataFrame(rows, "sample_id string, chrom string, pos long, logr double, gc double, wide double")
    got = {(r["sample_id"], r["pos"]): r["residual"] for r in regression.gc_replication_correct(df, "gc", "wide").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    picked = {(r["sample_id"], r["pos"]): r["residual"] for r in regression.correct_logr(df, ["gc"], ["wide"]).collect()}
    assert all(abs(picked[k] - want[k]) < 1e-6 for k in want)
