"""Whole runs on simulated samples give back the purity and the states that they were made from."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from acn.plans import lifecycle

STATES = [(1, 1), (2, 1), (2, 0), (1, 1), (1, 0), (3, 1)]  # one a chromosome
RHO = {"x": 0.7, "y": 0.55}


def simulated(sample, loci=250):
    """Rows of phased BAF and LogR, 20 kb apart."""
    rho, rng = RHO[sample], np.random.default_rng(ord(sample))
    psi_t = float(np.mean([sum(s) for s in STATES]))
    rows = []
    for c, (maj, mnr) in enumerate(STATES, 1):
        total = 2 - 2 * rho + rho * (maj + mnr)
        baf, logr = (1 - rho + rho * maj) / total, np.log2(total / (2 - 2 * rho + rho * psi_t))
        rows += [("p", sample, str(c), 20_000 * (i + 1), float(baf + rng.normal(0, 0.01)), float(logr + rng.normal(0, 0.05))) for i in range(loci)]
    return rows


def test_several_samples_of_a_patient(spark):
    df = spark.createDataFrame(simulated("x") + simulated("y"), "patient_id string, sample_id string, chrom string, pos long, baf double, logr double")
    # a preset near the truth: without one, the doubled genome (purity rho / (2 - rho)) fits tracks without subclones as well
    preset = spark.createDataFrame([(s, v + 0.02, 2.2) for s, v in RHO.items()], "sample_id string, rho double, psi double")
    got = lifecycle.several_samples(df.drop("logr"), df.select("sample_id", "chrom", "pos", "logr"), preset=preset)
    fits = {r["sample_id"]: r["rho"] for r in got["rho_psi"].filter("is_best").collect()}
    assert fits == {s: pytest.approx(v, abs=0.03) for s, v in RHO.items()}
    profile = got["profile"].filter("frac1 = 1").select("sample_id", "chrom", F.col("nMaj1").cast("int"), F.col("nMin1").cast("int")).collect()
    assert sorted(map(tuple, profile)) == sorted((s, str(c), *state) for s in RHO for c, state in enumerate(STATES, 1))
    mean = float(np.mean([sum(s) for s in STATES]))
    assert [r["ploidy"] for r in got["ploidy"].collect()] == pytest.approx([mean, mean], abs=0.1)
    assert got["clonal_share"].count() == 2


def test_paired_run_from_counts(spark):
    """Counts, alleles and haplotypes of one sample -> its purity."""
    rng, tumour, normal, haps = np.random.default_rng(3), [], [], []
    rho = 0.7
    for c, (maj, mnr) in enumerate(STATES, 1):
        for i in range(250):
            pos, total = 20_000 * (i + 1), 2 - 2 * rho + rho * (maj + mnr)
            depth = int(rng.poisson(60 * total))
            a = int(rng.binomial(depth, (1 - rho + rho * maj) / total))
            tumour.append(("x", str(c), pos, depth - a, a, 0, 0))
            n = int(rng.binomial(100, 0.5))
            normal.append(("x", str(c), pos, n, 100 - n, 0, 0))
            haps.append(("x", str(c), pos, "A", "C", 1, 0))
    counts = "sample_id string, chrom string, pos long, count_a int, count_c int, count_g int, count_t int"
    tumour, normal = spark.createDataFrame(tumour, counts), spark.createDataFrame(normal, counts)
    haps = spark.createDataFrame(haps, "sample_id string, chrom string, pos long, ref string, alt string, hap1 int, hap2 int")
    alleles = haps.select("chrom", "pos", F.lit(1).alias("a0"), F.lit(2).alias("a1"))
    got = lifecycle.paired(tumour, normal, alleles, haps)
    assert got["rho_psi"].filter("is_best").first()["rho"] == pytest.approx(rho, abs=0.03)
    assert got["profile"].select("chrom").distinct().count() == len(STATES)


def test_separate_segments_of_equal_baf_keep_their_logr(spark):
    """LogR is averaged by run, not by value."""
    rows = [("x", "1", 100 * (i + 1), 0.5, 0.5 if i < 20 or i >= 40 else 0.8, -1.0 if i < 20 else 0.3 if i < 40 else 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "sample_id string, chrom string, pos long, baf_phased double, baf_seg double, logr double")
    got = lifecycle.segments_of(df.drop("logr"), df.select("sample_id", "chrom", "pos", "logr")).orderBy("start_pos").collect()
    assert [(r["b"], r["r"], r["length"]) for r in got] == [(0.5, pytest.approx(-1.0), 20), (0.8, pytest.approx(0.3), 20), (0.5, pytest.approx(1.0), 20)]


#: sample -> states of chromosomes 1 to 4, and for each which haplotype (0 or 1) has the larger number.
COHORT = {
    ("p", "x"): [((1, 1), 0), ((2, 1), 0), ((2, 0), 0), ((3, 1), 1)],
    ("p", "y"): [((1, 1), 0), ((2, 1), 1), ((2, 0), 0), ((2, 1), 1)],
    ("q", "v"): [((2, 1), 0), ((2, 1), 0), ((1, 1), 0), ((2, 0), 1)],
    ("q", "w"): [((2, 1), 0), ((2, 1), 0), ((2, 0), 0), ((2, 0), 1)],
    ("r", "u"): [((1, 1), 0), ((2, 1), 0), ((2, 0), 0), ((1, 1), 1)],
}


def cohort(spark, rho=0.75, loci=260):
    """Counts of tumours and normals, alleles, and haplotypes whose phase switches every 65 loci; the true first haplotype of each patient is random."""
    rng = np.random.default_rng(12)
    true = {(p, c): rng.integers(0, 2, loci) for p, _ in COHORT for c in range(1, 5)}
    tumour, normal, haps = [], [], []
    for (patient, sample), chroms in COHORT.items():
        psi_t = float(np.mean([sum(s) for s, _ in chroms]))
        for c, ((maj, mnr), side) in enumerate(chroms, 1):
            total = 2 - 2 * rho + rho * (maj + mnr)
            for i in range(loci):
                pos, bit = 20_000 * (i + 1), int(true[patient, c][i])
                on_side = (1 - rho + rho * maj) / total
                alt_share = on_side if (bit == 1) == (side == 0) else 1 - on_side
                depth = int(rng.poisson(90 * total / 2 / (1 - rho + rho * psi_t / 2)))
                alt = int(rng.binomial(depth, alt_share))
                tumour.append((sample, str(c), pos, depth - alt, alt, 0, 0))
                n = int(rng.binomial(100, 0.5))
                normal.append((sample, str(c), pos, n, 100 - n, 0, 0))
                guess = bit ^ (i // 65 % 2)
                haps.append((sample, str(c), pos, "A", "C", guess, 1 - guess))
    counts = "sample_id string, chrom string, pos long, count_a int, count_c int, count_g int, count_t int"
    haps = spark.createDataFrame(haps, "sample_id string, chrom string, pos long, ref string, alt string, hap1 int, hap2 int")
    alleles = haps.select("chrom", "pos", F.lit(1).alias("a0"), F.lit(2).alias("a1")).distinct()
    return spark.createDataFrame(tumour, counts), spark.createDataFrame(normal, counts), alleles, haps, true


def test_samples_of_two_patients_with_mirrored_gains(spark):
    tumour, normal, alleles, haps, true = cohort(spark)
    patients = spark.createDataFrame(list(COHORT), "patient_id string, sample_id string")
    preset = spark.createDataFrame([(s, 0.75, float(np.mean([sum(x) for x, _ in c]))) for (_, s), c in COHORT.items()], "sample_id string, rho double, psi double")
    got = lifecycle.multisample(tumour, normal, alleles, haps, patients, preset=preset)
    # the joint haplotype is the true one or its opposite along a whole imbalanced chromosome
    for (patient, chrom), own in true.items():
        bits = {r["pos"]: r["bit"] for r in got["joint"].filter(f"patient_id = '{patient}' and chrom = '{chrom}'").collect()}
        if patient != "r" and (patient, chrom) not in {("p", 1)}:
            same = np.mean([bits[20_000 * (i + 1)] == own[i] for i in range(len(own)) if 20_000 * (i + 1) in bits])
            assert max(same, 1 - same) > 0.98
    assert got["joint"].filter("patient_id = 'r'").count() == 0
    mirrored = {(r["patient_id"], r["chrom"]) for r in got["mirrored"].filter("mirrored").collect()}
    seen = {(r["patient_id"], r["chrom"]) for r in got["regions"].collect()}
    assert mirrored == {("p", "2")}
    assert seen == {("p", "2"), ("p", "3"), ("p", "4"), ("q", "1"), ("q", "2"), ("q", "4")}
    profile = {(r["sample_id"], r["chrom"]): (r["nMaj1"], r["nMin1"]) for r in got["profile"].filter("frac1 = 1").collect()}
    assert profile == {(s, str(c)): state for (_, s), chroms in COHORT.items() for c, (state, _) in enumerate(chroms, 1)}


def test_patients_of_one_table_give_what_each_gives_alone(spark):
    from acn.operators import phasing, windows

    rng = np.random.default_rng(5)
    rows = [(p, f"{p}{s}", c, 1000 * i, int(rng.integers(0, 2)), float(i // 7 + s), bool(rng.random() < 0.9)) for p in "pq" for s in range(3) for c in ("1", "2") for i in range(40)]
    bits = spark.createDataFrame(rows, "patient_id string, sample_id string, chrom string, pos long, bit int, ps double, phased boolean")
    states = [(p, f"{p}{s}", c, int(a), int(a + rng.integers(3000, 30000)), float(rng.integers(1, 3)), 1.0) for p in "pq" for s in range(3) for c in ("1", "2") for a in rng.integers(0, 30000, 4)]
    profile = spark.createDataFrame(states, "patient_id string, sample_id string, chrom string, start_pos long, end_pos long, nMaj1 double, nMin1 double")
    profile = profile.withColumns({"nMaj2": F.lit(None).cast("double"), "nMin2": F.lit(None).cast("double")})

    def everything(profile, bits):
        joint = phasing.multisample_phasing(bits)
        regions = phasing.imbalanced_regions(profile)
        return [sorted(map(tuple, x.collect()), key=str) for x in (regions, phasing.mirrored_imbalance(regions, bits, joint), windows.phase_evidence(bits, 5))]

    both = everything(profile, bits)
    parts = [everything(profile.filter(f"patient_id = '{p}'"), bits.filter(f"patient_id = '{p}'")) for p in "pq"]
    assert both == [sorted(a + b, key=str) for a, b in zip(*parts, strict=True)] and all(both)
    assert {r[0] for r in both[0]} == {"p", "q"} and len(both[0]) > 4


def test_pieces_of_intervals_do_not_depend_on_bins(spark):
    from acn.operators import intervals

    rng = np.random.default_rng(1)
    iv = spark.createDataFrame([(str(i % 2), int(a), int(a + rng.integers(0, 4_000_000))) for i, a in enumerate(rng.integers(0, 9_000_000, 200))], "chrom string, start_pos long, end_pos long")
    one, two, three = (sorted(map(tuple, intervals.interval_disjoin(iv, bin_width=w).collect())) for w in (10**9, 1_000_000, 37_000))
    assert one == two == three and len(one) > 300
    cover = [(c, a, b, sum(r["start_pos"] <= a and r["end_pos"] >= b for r in iv.collect() if r["chrom"] == c)) for c, a, b, _ in one]
    assert cover == one


def test_a_male_and_a_female_in_one_run(spark):
    """Autosomes as planted; the male's X, one copy and two on the long arm, from LogR alone; the female's as an autosome."""
    rng, rho, tumour, normal, haps = np.random.default_rng(21), 0.7, [], [], []
    states = {"1": (1, 1), "2": (2, 1), "3": (1, 0), "4": (1, 1)}
    for s in ("m", "f"):
        psi_t = float(np.mean([sum(v) for v in states.values()]))
        for chrom, (maj, mnr) in states.items():
            for i in range(250):
                total = 2 - 2 * rho + rho * (maj + mnr)
                depth, n = int(rng.poisson(120 * total / (2 - 2 * rho + rho * psi_t))), int(rng.poisson(100))
                a = int(rng.binomial(depth, (1 - rho + rho * maj) / total))
                tumour.append((s, chrom, 20_000 * (i + 1), depth - a, a, 0, 0))
                normal.append((s, chrom, 20_000 * (i + 1), n // 2, n - n // 2, 0, 0))
                haps.append((s, chrom, 20_000 * (i + 1), "A", "C", 1, 0))
        for pos in range(3_000_000, 155_000_000, 250_000):
            copies = (2 if pos > 62_000_000 else 1) if s == "m" else 2
            own = 1 if s == "m" else 2
            depth, n = int(rng.poisson(120 * (own * (1 - rho) + rho * copies) / (2 - 2 * rho + rho * psi_t))), int(rng.poisson(50 * own))
            a = int(rng.binomial(depth, 0.5)) if s == "f" else depth
            tumour.append((s, "X", pos, depth - a, a, 0, 0))
            normal.append((s, "X", pos, n // 2 if s == "f" else 0, n - n // 2 if s == "f" else n, 0, 0))
            if s == "f":
                haps.append((s, "X", pos, "A", "C", 1, 0))
    counts = "sample_id string, chrom string, pos long, count_a int, count_c int, count_g int, count_t int"
    tumour, normal = spark.createDataFrame(tumour, counts), spark.createDataFrame(normal, counts)
    haps = spark.createDataFrame(haps, "sample_id string, chrom string, pos long, ref string, alt string, hap1 int, hap2 int")
    alleles = tumour.select("chrom", "pos", F.lit(1).alias("a0"), F.lit(2).alias("a1")).distinct()
    preset = spark.createDataFrame([(s, rho, 2.0) for s in "mf"], "sample_id string, rho double, psi double")
    got = lifecycle.paired(tumour, normal, alleles, haps, preset=preset, males=spark.createDataFrame([("m",)], "sample_id string"))
    rows = got["profile"].collect()
    states_of = lambda s, c: [(r["nMaj1"], r["nMin1"], r["frac1"]) for r in sorted(rows, key=lambda r: r["start_pos"]) if (r["sample_id"], r["chrom"]) == (s, c)]
    assert states_of("m", "X") == [(1, 0, 1), (2, 0, 1)] and states_of("f", "X") == [(1, 1, 1)]
    for s in "mf":
        for chrom, (maj, mnr) in states.items():
            assert {x[:2] for x in states_of(s, chrom) if x[2] == 1} == {(maj, mnr)}
    asked = {r["sample_id"]: r for r in got["refit_suggestions"].filter("rank = 1").collect()}
    assert asked["m"]["rho"] == pytest.approx(rho, abs=0.05) and not asked["m"]["outside_purity"] and asked["m"]["rho_diff"] < 0.05
