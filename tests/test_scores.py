"""Clonal scores, tests of segments, smoothed tracks and intervals of fractions against plain Python."""

import math

import numpy as np
import pytest

from acn.functions import stats
from acn.operators import calls, fit, kernels, segmentation, tables
from acn.sources import sinks

GRID = [(i, j, 1.6 + 0.4 * i, 0.3 + 0.15 * j) for i in range(4) for j in range(4)]


def segment_rows():
    rng = np.random.default_rng(8)
    rows = []
    for s in ("a", "b"):
        for k in range(12):
            b = float(rng.choice([0.5, 0.55, 0.62, 0.667, 0.75, 0.9])) + float(rng.normal(0, 0.003))
            n = int(rng.integers(2, 400))
            rows.append((s, k, b, float(rng.normal(0, 0.3)), n * 3, n, b + float(rng.normal(0, 0.002)), 0.0 if k == 5 else 0.03))
    return rows


@pytest.fixture(scope="module")
def segments(spark):
    return spark.createDataFrame(segment_rows(), "sample_id string, seg_id int, b double, r double, length int, size int, mean double, sd double")


def level(rho, maj, mnr):
    return 0.5 if maj == mnr == 0 else (1 - rho + rho * maj) / (2 - 2 * rho + rho * (maj + mnr))


def copies(b, r, rho, psi, other=False):
    """Major and minor copies of a segment, with psi of the tumour or (other) of all cells."""
    every = (psi if other else (1 - rho) * 2 + rho * psi) * 2**r
    x, y = (rho - 1 + b * every) / rho, (rho - 1 + (1 - b) * every) / rho
    return (x, y) if other else (max(x, y), min(x, y))


def lifted(major, minor, b):
    if minor >= 0:
        return major, minor
    up = major + b * (0.01 - minor) / (1 - b)
    return (1000.0 if up < 0 else up), 0.01


def edge(rho, b, major, minor):
    """The side of the unit square that a segment is nearest to."""
    y, x = math.floor(major), math.floor(minor)
    low = major + minor < x + y + 1
    if b > level(rho, y, x):
        return ((y, x), (y + 1, x)) if low else ((y + 1, x), (y + 1, x + 1))
    if b > level(rho, math.ceil(major), math.ceil(minor)):
        return ((y, x), (y, x + 1)) if low else ((y + 1, x), (y + 1, x + 1))
    return ((y, x), (y, x + 1)) if low else ((y, x + 1), (y + 1, x + 1))


def clonal(seg, rho, psi):
    _, _, b, r, _, n, _, sd = seg
    major, minor = copies(b, r, rho, psi)
    high, small = lifted(major, minor, b)
    one, two = edge(rho, b, high, small)
    state = one if abs(level(rho, *one) - b) <= abs(level(rho, *two) - b) else two
    d = abs(b - level(rho, *state))
    p = 0.0 if sd == 0 else 1.0 if d < 0.01 else float(stats.t_two_tailed(np.array([d * math.sqrt(n) / sd]), np.array([n - 1.0]))[0])
    return p > 0.05 and high - major < 1, state, p


def t_error(seg, rho, psi):
    _, _, b, r, _, n, mean, sd = seg
    if sd == 0:
        return None
    x, y = (0.01 if v < 0 else v for v in copies(b, r, rho, psi, other=True))
    corners = [(f(x), g(y)) for f, g in ((math.floor, math.ceil), (math.ceil, math.ceil), (math.floor, math.floor), (math.ceil, math.floor))]
    levels = [(1 - rho + rho * m) / (2 - 2 * rho + rho * (m + k)) for m, k in corners]
    return (mean - min(levels, key=lambda v: abs(v - b))) * math.sqrt(n) / sd


def log_pmf(k, n, p):
    if p in (0.0, 1.0):
        return 0.0 if k == n * p else -math.inf
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log(1 - p)


def ln_ratio(seg, rho, psi):
    _, _, b, r, _, n, mean, _ = seg
    one, two = edge(rho, b, *lifted(*copies(b, r, rho, psi, other=True), b))
    half_up = lambda v: math.floor(v + 0.5)
    reads, hits = half_up(n * 30), half_up(mean * n * 30)
    p, q = (math.exp(log_pmf(hits, reads, min(max(level(rho, *s), 0.0), 1.0))) for s in (one, two))
    return abs(math.log(p) - math.log(q)) if p > 0 and q > 0 else 0.0


@pytest.mark.parametrize("metric", [0, 1, 4])
def test_clonal_scores(spark, segments, metric):
    grid = spark.createDataFrame(GRID, "i int, j int, psi double, rho double")
    got = {(r["sample_id"], r["i"], r["j"]): r for r in fit.score_grid_clonal(grid, segments, metric).collect()}
    assert len(got) == 2 * len(GRID)
    for sample in ("a", "b"):
        segs = [s for s in segment_rows() if s[0] == sample and s[2] > 0.51]
        for i, j, psi, rho in GRID:
            if metric == 0:
                want = sum(s[4] for s in segs if clonal(s, rho, psi)[0]) / sum(s[4] for s in segs)
            elif metric == 1:
                errors = [t for s in segs if (t := t_error(s, rho, psi)) is not None]
                want = sum(t * t for t in errors) / len(errors)
            else:
                want = sum(ln_ratio(s, rho, psi) for s in segs)
            assert got[sample, i, j]["score"] == pytest.approx(want, rel=1e-6, abs=1e-9)
            if metric == 0:
                unbalanced = [s for s in segs if clonal(s, rho, psi)[0] and len(set(clonal(s, rho, psi)[1])) == 2]
                ref = max(unbalanced, key=lambda s: (s[4], -s[1]), default=None)
                assert (got[sample, i, j]["ref"] is None) == (ref is None)
                assert ref is None or got[sample, i, j]["ref"]["b"] == ref[2]


def test_clonality_of_segments(spark, segments):
    """p-values and states of single segments."""
    rho_psi = spark.createDataFrame([("a", 0.6, 2.4), ("b", 0.8, 3.1)], "sample_id string, rho double, psi double")
    at = {"a": (0.6, 2.4), "b": (0.8, 3.1)}
    rows = {(r["sample_id"], r["seg_id"]): r for r in fit.segment_is_clonal(segments, rho_psi).collect()}
    for s in segment_rows():
        good, state, p = clonal(s, *at[s[0]])
        r = rows[s[0], s[1]]
        assert (r["is_clonal"], (r["nMaj"], r["nMin"])) == (good, state) and r["pval"] == pytest.approx(p, rel=1e-6, abs=1e-12)
    own = lambda s, rho: ((rho * sum(clonal(s, *at[s[0]])[1]) + 2 - 2 * rho) / 2 ** s[3] - 2 * (1 - rho)) / rho
    for r in fit.recalc_psi_t(segments, rho_psi).collect():
        rho, psi = at[r["sample_id"]]
        chosen = [s for s in segment_rows() if s[0] == r["sample_id"] and clonal(s, rho, psi)[0]]
        want = sum(own(s, rho) * s[4] for s in chosen) / sum(s[4] for s in chosen) if chosen else psi
        assert r["psi_t"] == pytest.approx(want)


def test_reference_segment_gives_its_state(spark):
    rho, psi_t, state = 0.7, 2.4, (2, 1)
    b, r = level(rho, *state), math.log2((2 - 2 * rho + rho * 3) / (2 - 2 * rho + rho * psi_t))
    ref = "struct<b:double,r:double,nMaj:double,nMin:double>"
    rows = spark.createDataFrame([("a", (b, r, 2.0, 1.0)), ("b", None)], f"sample_id string, ref {ref}")
    got = {x["sample_id"]: x for x in fit.reference_segment_solution(rows).collect()}
    assert (got["a"]["rho"], got["a"]["psi"]) == pytest.approx((rho, psi_t)) and got["a"]["has_reference"]
    assert (got["b"]["rho"], got["b"]["psi"], got["b"]["has_reference"]) == (1, 2, False)


def test_reference_segment_is_rated(spark):
    """Its point's ploidy over all segments, its clonal share there, and whether that beats the grid's: rho and psi alone were given."""
    rho, psi_t = 0.7, 2.4
    places = [("a", 2, 1, 100), ("a", 2, 0, 50), ("a", 1, 1, 30)]
    r = lambda n: math.log2((2 - 2 * rho + rho * n) / (2 - 2 * rho + rho * psi_t))
    rows = [(s, k, level(rho, x, y), r(x + y), n, n, level(rho, x, y), 0.01) for k, (s, x, y, n) in enumerate(places)]
    rows.append(("a", 9, 0.615, r(3), 20, 20, 0.615, 1e-4))  # no state explains this one
    rows += [("b", 0, 0.6, 0.0, 10, 10, 0.6, 0.01), ("c", 0, 0.6, 0.0, 10, 10, 0.6, 0.01)]
    segs = spark.createDataFrame(rows, "sample_id string, seg_id long, b double, r double, length long, size long, mean double, sd double")
    ref = "struct<b:double,r:double,nMaj:double,nMin:double>"
    best = spark.createDataFrame([("a", 0.5, (rows[0][2], rows[0][3], 2.0, 1.0)), ("b", 0.5, None), ("c", 0.5, (0.6, 0.0, 0.0, 2.0))], f"sample_id string, score double, ref {ref}")
    got = {x["sample_id"]: x for x in fit.reference_segment_solution(best, segments=segs).collect()}
    copies = lambda b, r: 2**r * (2 - 2 * rho + rho * psi_t) / rho - 2 * (1 - rho) / rho  # noqa: E731  of both alleles
    want = sum(copies(x[2], x[3]) * x[4] for x in rows[:4]) / 200
    assert (got["a"]["rho"], got["a"]["psi"], got["a"]["ploidy"]) == pytest.approx((rho, psi_t, want))
    assert got["a"]["distance"] == pytest.approx(150 / 170) and got["a"]["is_better"]  # the balanced one isn't informative
    assert tuple(got["b"][c] for c in ("rho", "psi", "ploidy", "distance", "is_better")) == (1, 2, 2, 1, True)
    assert tuple(got["c"][c] for c in ("rho", "psi", "ploidy", "distance", "is_better")) == (None, None, None, math.inf, False)


def track(values, half):
    return kernels.running_median(np.asarray(values, float), half)


def test_smoothed_tracks(spark):
    rng = np.random.default_rng(1)
    logr, seg = rng.normal(0, 0.2, 41), np.repeat([0.1, -0.2], [20, 21])
    locus = [("a", "1", 100 * i) for i in range(41)]
    baf = spark.createDataFrame([(*k, 0.6, float(v)) for k, v in zip(locus, logr)], "sample_id string, chrom string, pos long, baf_seg double, logr double")
    lev = spark.createDataFrame([(*k, float(v)) for k, v in zip(locus, seg)], "sample_id string, chrom string, pos long, logr_seg double")
    got = tables.allele_ratio_track(baf, lev, step=7, k=5).orderBy("pos").collect()
    assert [r["pos"] for r in got] == [100 * i for i in range(0, 41, 7)]
    assert [r["ratio_smooth"] for r in got] == pytest.approx(track(np.exp(logr), 2)[::7].tolist())
    assert [r["major_ratio"] + r["minor_ratio"] for r in got] == pytest.approx((2.0 ** seg[::7]).tolist())

    profile = spark.createDataFrame([("a", "1", 0, 1950, 2.0, 1.0, 0.4, 1.0, 1.0, 0.6), ("a", "1", 2000, 4000, 1.0, 1.0, 1.0, None, None, None)],
        "sample_id string, chrom string, start_pos long, end_pos long, nMaj1 double, nMin1 double, frac1 double, nMaj2 double, nMin2 double, frac2 double")
    fitted = spark.createDataFrame([("a", 0.8, 2.5)], "sample_id string, rho double, psi double")
    got = tables.total_cn_track(profile, baf, fitted, k=5).orderBy("pos").collect()
    smooth = track(logr, 2)
    assert [r["cn"] for r in got] == pytest.approx([((0.8 * 2.5 + 0.4) * 2**v - 0.4) / 0.8 for v in smooth])
    assert [r["state_cn"] for r in got] == pytest.approx([2.4] * 20 + [2.0] * 21)


def test_coverage_track(spark):
    rng = np.random.default_rng(3)
    t, n = rng.integers(10, 60, 30), rng.integers(10, 60, 30)
    rows = [("a", "1", 10 * i, int(t[i]) // 2, int(t[i]) - int(t[i]) // 2, int(n[i]) // 2, int(n[i]) - int(n[i]) // 2) for i in range(30)]
    df = spark.createDataFrame(rows, "sample_id string, chrom string, pos long, t1 int, t2 int, n1 int, n2 int")
    got = tables.coverage_track(df, k=5, step=4).orderBy("pos").collect()
    assert [r["tumour_smooth"] for r in got] == pytest.approx(track(t / np.median(t), 2)[::4].tolist())
    assert [r["normal_smooth"] for r in got] == pytest.approx(track(n / np.median(n), 2)[::4].tolist())


def test_bootstrap_brackets_the_fraction(spark):
    rho, share = 0.7, 0.3
    mixed = (1 - rho + rho * (share * 2 + (1 - share))) / (2 - 2 * rho + rho * (share * 3 + (1 - share) * 2))
    rng = np.random.default_rng(5)
    rows = [("a", "1", s * 10_000_000 + i * 1000, float(b + rng.normal(0, 0.01)), b, float(r)) for s, (b, r) in enumerate([(mixed, 0.05), (0.5, -0.1)]) for i in range(300)]
    df = spark.createDataFrame(rows, "sample_id string, chrom string, pos long, baf_phased double, baf_seg double, logr double")
    rho_psi = spark.createDataFrame([("a", rho, 2.3)], "sample_id string, rho double, psi_t double")
    called = calls.call_subclones(df, df, rho_psi)
    first, again = (sorted(map(tuple, calls.bootstrap_fraction_ci(df, called, rho_psi, n=400).collect())) for _ in range(2))
    boot = {r["start_pos"]: r["bootstrap"] for r in calls.with_bootstrap(called, df, rho_psi, 400).collect()}
    assert {k: (b["sd_bs"], b["lo"], b["hi"]) for k, b in boot[0].items()} == {r[4]: r[5:] for r in first} and boot[10_000_000] is None
    assert first == again and first and {r[2] for r in first} == {0}
    f = called.filter("start_pos = 0").first()["frac1"]
    _, _, _, _, option, sd, lo, hi = first[0]
    assert option == 0 and lo < f < hi and sd == pytest.approx((hi - lo) / 3.92, rel=0.3)


def test_candidates_hold_the_breaks(spark):
    x = np.repeat([0.0, 1.0, 0.4], [120, 90, 110]) + np.random.default_rng(2).normal(0, 0.05, 320)
    df = spark.createDataFrame([("a", "1", i, float(v)) for i, v in enumerate(x)], "sample_id string, chrom string, pos long, v double")
    marked = {r["pos"] for r in segmentation.pcf_candidates(df, "v", 5).filter("mark").collect()}
    assert {119, 209} <= marked and len(marked) < 160
    for op in (segmentation.pcf_fast(df, "v", 5, 1.0), segmentation.pcf_exact(df, "v", 1.0)):
        fitted = [r["fit"] for r in op.orderBy("pos").collect()]
        assert fitted == pytest.approx(np.repeat([x[:120].mean(), x[120:210].mean(), x[210:].mean()], [120, 90, 110]).tolist())


def test_segment_logr_by_arm(spark):
    rng = np.random.default_rng(7)
    rows = [("a", "1", i, "p" if i < 100 else "q", float((0.5 if i >= 150 else 0.0) + rng.normal(0, 0.02))) for i in range(200)] + [("a", "1", 500, "q", None)]
    df = spark.createDataFrame(rows, "sample_id string, chrom string, pos long, arm string, logr double")
    got = segmentation.segment_logr(df, "logr", 10, 5).orderBy("pos").toPandas()
    assert len(got) == 200
    runs = got.groupby(["arm", "fit"], sort=False).pos.agg(["min", "max"]).values.tolist()
    assert runs == [[0, 99], [100, 149], [150, 199]]


def test_legacy_segments_take_the_mean(spark):
    rng = np.random.default_rng(4)
    b = np.where(np.repeat(rng.integers(0, 2, 10), 40) == 1, 0.72, 0.28) + rng.normal(0, 0.02, 400)
    df = spark.createDataFrame([("a", "1", 20_000 * i, float(v)) for i, v in enumerate(b)], "sample_id string, chrom string, pos long, baf double")
    got = segmentation.segment_phased_baf_legacy(df).toPandas()
    assert got.baf_seg.nunique() == 1 and got.baf_seg.iloc[0] == pytest.approx(got.baf_phased.mean())
    assert ((got.baf_phased - got.baf).abs().lt(1e-12) | (got.baf_phased + got.baf - 1).abs().lt(1e-12)).all()


def test_binomial_tests(spark):
    rows = [(3.0, 10.0, 0.5), (7.0, 10.0, 0.5), (0.0, 5.0, 0.2), (12.0, 40.0, 0.3)]
    df = spark.createDataFrame(rows, "k double, n double, p double")
    got = df.select("*", stats.binomial_pmf("k", "n", "p").alias("pmf"), stats.binomial_two_tailed("k", "n", "p").alias("two")).collect()
    for r in got:
        k, n, p = int(r["k"]), int(r["n"]), r["p"]
        mass = [math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)]
        low = sum(mass[: k + 1])
        assert r["pmf"] == pytest.approx(mass[k]) and r["two"] == pytest.approx(2 * min(low, 1 - low))


def test_extended_profile_has_all_solutions(spark, tmp_path):
    """67 columns a segment; solutions beyond those found, and bootstrap columns without a bootstrap, are NA."""
    option = "struct<nMaj1:double,nMin1:double,frac1:double,nMaj2:double,nMin2:double,frac2:double,SDfrac:double>"
    schema = f"sample_id string, chrom string, start_pos long, end_pos long, baf double, pval double, logr double, ntot double, solutions array<{option}>, bootstrap map<int,struct<sd_bs:double,lo:double,hi:double>>"
    rows = [
        ("a", "1", 1, 9, 0.6, 0.0, 0.1, 2.3, [(2.0, 1.0, 0.3, 1.0, 1.0, 0.7, 0.02), (2.0, 1.0, 0.4, 2.0, 0.0, 0.6, 0.03)], {0: (0.01, 0.28, 0.32)}),
        ("a", "2", 1, 9, 0.5, 1.0, 0.0, 2.0, [(1.0, 1.0, 1.0, None, None, None, None)], None),
    ]
    path = str(tmp_path / "profile")
    sinks.write_profile_extended(spark.createDataFrame(rows, schema), path)
    got = {r["chr"]: r for r in spark.read.option("sep", "\t").option("header", True).csv(path).collect()}
    first, second = got["1"].asDict(), got["2"].asDict()
    assert len(first) == 1 + 7 + 6 * 10
    assert (first["nMaj1_A"], first["frac1_A"], first["SDfrac_A"], first["SDfrac_A_BS"], first["frac1_A_0.025"], first["frac1_A_0.975"]) == ("2.0", "0.3", "0.02", "0.01", "0.28", "0.32")
    assert (first["frac2_B"], first["SDfrac_B"], first["frac1_B_0.025"], first["nMaj1_C"]) == ("0.6", "0.03", "NA", "NA")
    assert (second["frac1_A"], second["nMaj2_A"], second["nMaj1_B"]) == ("1.0", "NA", "NA")


def test_states_of_male_x(spark):
    """Segments built from a purity and copies give them back, with the share of a mixture."""
    purity, log = 0.8, lambda x: math.log2(0.8 * x + 0.2)
    levels = [(log(1), "none"), (log(2), "gain"), (log(1.3), "gain"), (log(1.8), "gain"), (log(0), "loss"), (log(0.4), "loss"), (log(2.5), "gain"), (log(7.2), "gain")]
    segs = spark.createDataFrame([("a", k, k, 50, v) for k, (v, _) in enumerate(levels)], "sample_id string, start_pos int, end_pos int, n int, logr double")
    calibration = spark.createDataFrame([("a", 0.0, 0.05, 0.05)], "sample_id string, shift double, sd_max double, sd_loss double")
    rho = spark.createDataFrame([("a", purity)], "sample_id string, purity double")
    got = calls.call_x_segments(segs, calibration, rho).orderBy("start_pos").collect()
    assert [r["kind"] for r in got] == [k for _, k in levels]
    assert [r["is_clonal"] for r in got] == [None, True, False, False, True, False, False, True]
    assert [(got[k]["nMaj1"], got[k]["frac1"]) for k in (0, 1, 4, 7)] == [(1, 1), (2, 1), (0, 1), (7, 1)]
    mixed = lambda r: {r["nMaj1"]: pytest.approx(r["frac1"]), r["nMaj2"]: pytest.approx(r["frac2"])}
    assert mixed(got[2]) == {2: 0.3, 1: 0.7} and mixed(got[3]) == {2: 0.8, 1: 0.2} and mixed(got[5]) == {0: 0.6, 1: 0.4} and mixed(got[6]) == {3: 0.5, 2: 0.5}
    assert all(r["frac1"] >= 0.5 - 1e-9 for r in got)


def test_calibration_of_doubled_genomes(spark):
    """Without 1+1 the offset comes from 2+0, then from the ploidy; 2+2 gives the spread."""
    state = lambda s, a, b, v: (s, float(a), float(b), 1.0, v)
    rows = [state("a", 1, 1, v) for v in (-0.1, -0.3)] + [state("a", 1, 0, v) for v in (-1.0, -1.4)]
    rows += [state("b", 2, 2, v) for v in (0.1, 0.5)] + [state("b", 2, 0, -0.4), state("b", 3, 0, -0.2)] + [state("c", 2, 2, 0.0), state("c", 1, 1, 0.0)]
    profile = spark.createDataFrame(rows, "sample_id string, nMaj1 double, nMin1 double, frac1 double, logr double")
    ploidy = spark.createDataFrame([("a", 2.0), ("b", 4.0), ("c", 4.0)], "sample_id string, ploidy double")
    got = {r["sample_id"]: (r["shift"], r["sd_max"], r["sd_loss"]) for r in calls.logr_calibration_x(profile, ploidy).collect()}
    sd = lambda *v: float(np.std(v, ddof=1))
    assert got["a"] == pytest.approx((0.2, sd(-0.1, -0.3), sd(-1.0, -1.4))) and got["b"] == pytest.approx((0.4, sd(0.1, 0.5), sd(-0.4, -0.2)))
    assert got["c"] == pytest.approx((1.0, 0.05, 0.05))


def test_male_x_takes_its_place_in_the_profile(spark):
    """A gain of 80% purity on the long arm of one male; the female keeps its X."""
    rng, rows = np.random.default_rng(3), []
    for s in ("m", "f"):
        for i, pos in enumerate(range(3_000_000, 155_000_000, 100_000)):
            rows.append((s, "X", pos, float((math.log2(1.8) if s == "m" and 90_000_000 <= pos < 130_000_000 else 0.0) + rng.normal(0, 0.03))))
    logr = spark.createDataFrame(rows, "sample_id string, chrom string, pos long, logr double")
    auto = [(s, str(c), 1, 9, float(v), 1.0, 1.0, 1.0, None, None, None) for s in "mf" for c,
        v in ((1, 0.01), (2, -0.01), (3, 0.0))] + [(s, "X", 1, 9, 0.0, 1.0, 1.0, 1.0, None, None, None) for s in "mf"]
    names = "sample_id string, chrom string, start_pos long, end_pos long, logr double, nMaj1 double, nMin1 double, frac1 double, nMaj2 double, nMin2 double, frac2 double"
    profile, fit_ = spark.createDataFrame(auto, names), spark.createDataFrame([("m", 0.8, 2.0), ("f", 0.8, 2.0)], "sample_id string, rho double, ploidy double")
    cuts = spark.createDataFrame([("chrX", 90_000_000), ("X", 129_950_000), ("1", 5)], "chrom string, pos long")
    for breakpoints in (None, cuts):
        out = calls.male_x(profile, logr, fit_, fit_, spark.createDataFrame([("m",)], "sample_id string"), breakpoints).collect()
        own = sorted((r["start_pos"], r["end_pos"], r["nMaj1"], r["nMin1"], r["frac1"]) for r in out if (r["sample_id"], r["chrom"]) == ("m", "X"))
        assert [(r["nMaj1"], r["nMin1"]) for r in out if (r["sample_id"], r["chrom"]) == ("f", "X")] == [(1.0, 1.0)] and len(out) == 7 + len(own)
        assert [x[2:] for x in own] == [(1.0, 0.0, 1.0), (1.0, 0.0, 1.0), (2.0, 0.0, 1.0), (1.0, 0.0, 1.0)]
        assert own[0][0] == 3_000_000 and abs(own[2][0] - 90_000_000) <= 200_000 and abs(own[2][1] - 129_900_000) <= 200_000
