"""Operators of samples without a normal, of several samples, and of pieces of the genome, against planted truth."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from acn.operators import phasing, pseudonormal, segmentation, windows
from acn.plans import lifecycle

KEYS = "sample_id string, chrom string, pos long"
LENGTH, CEN = 40_000_000, (15_000_000, 17_000_000)


@pytest.fixture(scope="module")
def geometry(spark):
    rows = [(c, 1, *CEN, LENGTH) for c in ("1", "2", "13")]
    return spark.createDataFrame(rows, "chrom string, start_pos long, cen_left long, cen_right long, end_pos long")


def het_rows(sample, chrom, lost=(), sparse=400_000, every=2_000, empty=CEN):
    """Hets at equal steps but for the empty range, fewer inside lost ones."""
    inside = lambda p: any(a <= p < b for a, b in lost)
    return [(sample, chrom, p) for p in range(every, LENGTH, every) if not empty[0] < p < empty[1] and (not inside(p) or p % sparse == 0)]


def test_long_gaps_between_hets(spark, geometry):
    lost = [(20_000_000, 32_000_000)]
    rows = het_rows("a", "1", lost) + het_rows("a", "2") + het_rows("b", "1", [(0, LENGTH)], sparse=200_000)
    got = pseudonormal.loh_by_het_gaps(spark.createDataFrame(rows, KEYS), geometry, gamma=1, kmin=5).collect()
    a = [r for r in got if r["sample_id"] == "a"]
    assert [(r["chrom"], r["arm"], r["decision"]) for r in a] == [("1", "q", "partial")]
    assert abs(a[0]["start_pos"] - 20_000_000) <= 800_000 and abs(a[0]["end_pos"] - 32_000_000) <= 800_000
    b = [r for r in got if r["sample_id"] == "b"]  # hets all over, but too few of them
    assert b and {r["decision"] for r in b} == {"whole"}


def test_even_gaps_are_no_loss(spark, geometry):
    """Every gap is the largest one: all levels are 1, and the chromosome is dense."""
    assert pseudonormal.loh_by_het_gaps(spark.createDataFrame(het_rows("a", "2", empty=(0, 0)), KEYS), geometry, gamma=1, kmin=5).count() == 0
    assert pseudonormal.loh_by_het_gaps(spark.createDataFrame([], KEYS), geometry).count() == 0


def test_noise_filter(spark, geometry):
    rows = [
        ("a", "1", "p", 14_900_000, 15_000_000), ("a", "1", "q", 17_050_000, 19_000_000), ("a", "2", "q", 17_050_000, 19_000_000),
        ("a", "13", "p", 1_000_000, 9_000_000), ("a", "13", "q", 20_000_000, 29_000_000),
    ]
    df = spark.createDataFrame(rows, "sample_id string, chrom string, arm string, start_pos long, end_pos long")
    assert sorted((r["chrom"], r["start_pos"]) for r in pseudonormal.loh_noise_filter(df, geometry).collect()) == [("13", 20_000_000), ("2", 17_050_000)]


@pytest.fixture(scope="module")
def depths(spark):
    """LogR every 10 kb; a loss in one gap between hets, one with few low loci, and a gap of normal depth."""
    gaps = [(20_000_000, 20_600_000), (25_000_000, 25_600_000), (30_000_000, 30_600_000)]
    hets = [("a", "1", p) for p in range(50_000, LENGTH, 50_000) if not any(a < p < b for a, b in gaps)]
    rng = np.random.default_rng(2)
    logr = []
    for p in range(5_000, LENGTH, 10_000):
        low = 20_000_000 < p < 20_600_000 or 25_000_000 < p < 25_050_000
        logr.append(("a", "1", p, float((-1.2 if low else 0.0) + rng.normal(0, 0.02))))
    # other chromosomes bring the sample's density of loci to that of this one
    logr += [("a", c, p, 0.0) for c in ("2", "13") for p in range(5_000, LENGTH, 10_000)]
    return spark.createDataFrame(hets, KEYS), spark.createDataFrame(logr, KEYS + ", logr double")


@pytest.mark.parametrize("mode", ["cell_line", "germline"])
def test_low_depth_inside_gaps(spark, geometry, depths, mode):
    hets, logr = depths
    none = spark.createDataFrame([], "sample_id string, chrom string, arm string, start_pos long, end_pos long")
    find = lambda loh: pseudonormal.loh_by_logr_windows(hets, logr, loh, geometry, min_gap=1e5, gamma=1, mode=mode).collect()
    got = find(none)
    assert [(r["chrom"], r["arm"], r["start_pos"], r["end_pos"], r["n"]) for r in got] == [("1", "q", 20_005_000, 20_595_000, 60)]
    assert got[0]["level"] == pytest.approx(-1.2, abs=0.02) and got[0]["density"] == pytest.approx(1, abs=0.1)
    assert find(spark.createDataFrame([("a", "1", "q", 19_000_000, 21_000_000)], none.schema)) == []


def test_undepleted_regions_go(spark, geometry, depths):
    loh = spark.createDataFrame([("a", "1", "q", 20_005_000, 20_595_000), ("a", "1", "q", 30_000_000, 31_000_000), ("b", "1", "q", 1, 5)],
        "sample_id string, chrom string, arm string, start_pos long, end_pos long")
    assert [r["start_pos"] for r in pseudonormal.drop_undepleted(loh, depths[1], geometry).collect()] == [20_005_000]


def test_run_without_a_normal(spark, geometry):
    """From counts to a normal that is heterozygous inside the loss."""
    rng, counts = np.random.default_rng(9), []
    for p in range(2_000, LENGTH, 2_000):
        if CEN[0] < p < CEN[1]:
            continue
        lost = 20_000_000 <= p < 30_000_000 and p % 100_000
        a = 30 if lost else int(rng.binomial(60, 0.5))
        counts.append(("a", "1", p, a, 0 if lost else 60 - a, 0, 0))
    counts = spark.createDataFrame(counts, KEYS + ", count_a int, count_c int, count_g int, count_t int")
    alleles = counts.select("chrom", "pos", F.lit(1).alias("a0"), F.lit(2).alias("a1"))
    got = lifecycle.unmatched(counts, alleles, geometry)
    lost = got["losses"].collect()
    assert len(lost) == 1 and abs(lost[0]["start_pos"] - 20_000_000) <= 200_000 and abs(lost[0]["end_pos"] - 30_000_000) <= 200_000
    normal, ends = got["normal"], (lost[0]["start_pos"], lost[0]["end_pos"])
    assert normal.count() == counts.count()
    inside = normal.filter(F.col("pos").between(*ends))
    spiked = inside.filter("count_a = count_c").count()
    assert spiked >= inside.count() // 11
    outside = ~F.col("pos").between(*ends)
    assert normal.filter(outside).exceptAll(counts.filter(outside).select(*normal.columns)).count() == 0


def test_small_chunks_join_until_none_is_left(spark):
    sizes = [("1", 30, 0), ("1", 250, 5_000_000), ("1", 80, 10_000_000), ("1", 90, 12_000_000), ("1", 300, 30_000_000), ("2", 210, 0), ("X", 50, 0)]
    rows = [("a", c, s + i * 10) for c, n, s in sizes for i in range(n)] + [("b", "1", 7)]
    got = windows.genome_chunks(spark.createDataFrame(rows, KEYS)).orderBy("sample_id", "chunk", "chrom").collect()
    assert [(r["sample_id"], r["chunk"], r["chrom"], r["start_pos"], r["n"]) for r in got] == [
        ("a", 0, "1", 0, 450), ("a", 1, "1", 30_000_000, 300), ("a", 2, "2", 0, 210), ("a", 2, "X", 0, 50), ("b", 0, "1", 7, 1),
    ]


def test_several_samples_break_at_gaps(spark):
    """Both sides of a gap of 5 Mb are pieces of their own; loci that a sample lacks take no part."""
    rng, rows = np.random.default_rng(6), []
    for sample, levels in (("x", (0.5, 0.62)), ("y", (0.7, 0.74))):
        for k, level in enumerate(levels):
            rows += [("p", sample, "1", k * 6_000_000 + i * 10_000, float(level + rng.normal(0, 0.004))) for i in range(100)]
    rows += [("p", "x", "1", 55, 0.9), ("p", "y", "1", 65, None), ("p", "x", "1", 65, 0.1)]
    df = spark.createDataFrame(rows, "patient_id string, sample_id string, chrom string, pos long, baf double")
    got = segmentation.segment_phased_baf_multisample(df, gamma=1e6).toPandas()
    assert len(got) == 400 and set(got.columns) >= {"baf_phased", "baf_seg"}
    level = got.assign(late=got.pos >= 6_000_000).groupby(["sample_id", "late"]).baf_seg.agg(["nunique", "mean"])
    assert (level["nunique"] == 1).all()
    assert level["mean"].tolist() == pytest.approx([0.5, 0.62, 0.7, 0.74], abs=0.01)


def test_joint_phase_of_each_patient(spark):
    """The recursion over phase_switches() and phase_evidence() in plain Python, for patients of three and of two samples."""
    rng, rows = np.random.default_rng(12), []
    for patient, samples in (("p", "abc"), ("q", "de")):
        for s in samples:
            rows += [(patient, s, "1", 10 * i, int(rng.integers(0, 2)), bool(rng.random() < 0.8), None if rng.random() < 0.1 else 10 * (i // 20)) for i in range(60)]
    rows.append(("q", "d", "1", 15, 1, True, 0))  # the other sample lacks it
    df = spark.createDataFrame(rows, KEYS.replace("sample_id", "patient_id string, sample_id") + ", bit int, phased boolean, ps long")
    got = {(r["patient_id"], r["pos"]): r["bit"] for r in phasing.multisample_phasing(df, 7).collect()}
    for patient in "pq":
        own = df.filter((F.col("patient_id") == patient) & (F.col("pos") % 10 == 0)).drop("patient_id")
        switch = {(r["sample_id"], r["pos"], r["lag"]): r["switch"] for r in windows.phase_switches(own, 7).collect()}
        sure = {(r["sample_id"], r["pos"], r["lag"]): r["evidence"] for r in windows.phase_evidence(own, 7).collect()}
        first = [r[4] for r in rows if r[0] == patient and r[3] == 0]
        h = [round(sum(first) / len(first))]
        for i in range(1, 60):
            k = min(7, i)
            vote = sum((k + 1 - lag) / (k * (k + 1) / 2) * abs(h[i - lag] - switch[s, 10 * i, lag]) * sure[s, 10 * i, lag] for s in {x[0] for x in switch} for lag in range(1, k + 1))
            h.append(round(vote + 1e-12))
        assert [got[patient, 10 * i] for i in range(60)] == h
    assert len(got) == 120


def test_covariates_correct_the_returned_logr(spark, geometry):
    """A depth that follows GC content leaves no trace in LogR; losses are the same."""
    rng, counts, gc = np.random.default_rng(4), [], []
    for p in range(2_000, LENGTH, 4_000):
        share = float(rng.uniform(0.3, 0.6))
        depth = int(rng.poisson(60 * 2 ** (3 * (share - 0.45))))
        a = int(rng.binomial(depth, 0.5))
        counts.append(("a", "1", p, a, depth - a, 0, 0))
        gc.append(("1", p, share, float(rng.uniform(0.3, 0.6))))
    counts = spark.createDataFrame(counts, KEYS + ", count_a int, count_c int, count_g int, count_t int")
    alleles = counts.select("chrom", "pos", F.lit(1).alias("a0"), F.lit(2).alias("a1"))
    covariates = spark.createDataFrame(gc, "chrom string, pos long, gc_1kb double, gc_100kb double")
    raw = lifecycle.unmatched(counts, alleles, geometry)
    fair = lifecycle.unmatched(counts, alleles, geometry, covariates=covariates, short=["gc_1kb"], long=["gc_100kb"], replication=[])
    r = lambda got: got["logr"].join(covariates, ["chrom", "pos"]).agg(F.corr("logr", "gc_1kb")).first()[0]
    assert r(raw) > 0.6 and abs(r(fair)) < 0.02
    assert sorted(map(tuple, raw["losses"].collect())) == sorted(map(tuple, fair["losses"].collect()))
