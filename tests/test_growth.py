"""Steps whose time or memory grew too fast with tables."""

import numpy as np
import pytest

import __spark_entry__ as entry
from acn.operators import kernels


def test_blocks_searched_at_once_give_what_each_gives():
    """Each block of a long chromosome was searched by itself, cell after cell in Python."""
    for seed in range(12):
        rng = np.random.default_rng(seed)
        kmin, columns, blocks = int(rng.integers(1, 8)), int(rng.integers(1, 4)), []
        for n in (int(v) for v in rng.integers(1, 300, 9)):
            x = np.repeat(rng.normal(0, 0.3, (n // 30 + 1, columns)), 30, 0)[:n] + rng.normal(0, 0.1, (n, columns))
            mark = rng.random(n) < 0.4
            mark[-1] = True
            blocks.append(kernels._cells(x, mark)[1])
        for got, moments in zip(kernels.potts_blocks(blocks, kmin, 0.2), blocks):
            assert got.tolist() == kernels.potts(*moments, kmin, 0.2).tolist()


def test_planted_cohort_is_made_once(spark):
    """Filters on its counts became conditions of the view's cross join; every table computed the cohort again."""
    plan = entry.queries()["segment_phased_baf_planted"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "events.parquet" not in plan


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_running_medians_leave_slice_by_slice(spark):
    """A chromosome came as one frame. Medians are those of the whole group wherever batches end, nulls keep their rows."""
    from acn.operators import windows

    rng = np.random.default_rng(3)
    for half in (1, 2, 7, 30):
        for n in (1, 2, 3, 50, 300):
            x = np.where(rng.random(n) < 0.2, np.nan, rng.integers(0, 30, n))
            known = ~np.isnan(x)
            want, got = kernels.running_median(x[known], half), np.full(n, np.nan)
            cuts = np.unique(np.r_[0, rng.integers(0, n, 9), n])
            smoother = windows._Smoother(half)
            for a, b in zip(cuts, cuts[1:]):
                at, medians = smoother.add(x[a:b], b == n)
                got[at] = medians
            assert np.array_equal(got[known], want) and np.isnan(got[~known]).all()
            assert len(smoother.x) <= max(n, 2 * half + 3)
    rows = [(s, "1", p, None if p % 9 == 0 else float(p * 7 % 31), float(p * 5 % 17)) for s in "ab" for p in range(700 if s == "a" else 30)]
    df = spark.createDataFrame(rows, "sample_id string, chrom string, pos long, x double, y double").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        made = windows.running_medians(df, {"mx": "x", "my": "y"}, 41, step=10)
        got = {(r["sample_id"], r["pos"]): (r["mx"], r["my"]) for r in made.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroupsInPandas" not in _plan(made)
    want = {}
    for s in "ab":
        own = [r for r in rows if r[0] == s]
        known = [r for r in own if r[3] is not None]
        mx = dict(zip((r[2] for r in known), kernels.running_median(np.array([r[3] for r in known]), 20).tolist()))
        my = kernels.running_median(np.array([r[4] for r in own]), 20).tolist()
        want |= {(s, r[2]): (mx.get(r[2]), my[r[2]]) for r in own if r[2] % 10 == 0}
    assert got == want


def test_switches_of_a_locus_are_one_array(spark):
    """A window frame collected a hundred bits anew for each locus. Lags go on over the borders of batches; a missing bit has no switch."""
    from acn.operators import windows

    rows = [(s, "1", p, None if p == 40 else p * p % 7 % 2) for s in "ab" for p in range(90)]
    df = spark.createDataFrame(rows, "sample_id string, chrom string, pos long, bit int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        made = windows.phase_switches(df, 11)
        got = {(r["sample_id"], r["pos"], r["lag"]): r["switch"] for r in made.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "collect_list" not in _plan(made) and made.schema["switch"].dataType == df.schema["bit"].dataType
    bit = {(s, p): b for s, _, p, b in rows}
    off = lambda a, b: None if a is None or b is None else abs(a - b)
    assert got == {(s, p, lag): off(bit[s, p], bit[s, p - lag]) for s, p in bit for lag in range(1, min(p, 11) + 1)}


def test_counts_meet_their_alleles_once(spark):
    """Tumour and normal each met the alleles, so that a locus listed twice gave four rows, two of which paired different alleles."""
    from acn.operators import aggregates, loci

    counts = lambda k: spark.createDataFrame([("s", "1", p, *(k * (p + i) for i in range(4))) for p in (10, 20)], "sample_id string, chrom string, pos long, count_a int, count_c int, count_g int, count_t int")
    alleles = spark.createDataFrame([("1", 10, 1, 2), ("1", 10, 3, 4), ("1", 20, 2, 1)], "chrom string, pos long, a0 int, a1 int")
    got = loci.match_counts(counts(1), counts(3), alleles)
    assert sorted(tuple(r) for r in got.collect()) == [("s", "1", 10, 10, 11, 30, 33), ("s", "1", 10, 12, 13, 36, 39), ("s", "1", 20, 21, 20, 63, 60)]
    ratios = aggregates.baf_logr(counts(1), counts(3), alleles)
    # the counts are not matched again for the mean
    assert "count_a" not in _plan(ratios) and all(abs(r["logr"]) < 1e-9 for r in ratios.collect())


def test_joint_phase_and_haplotypes_read_their_tables_once(spark):
    """Loci of all samples were counted and met again; external blocks met the haplotypes three times, segments their own imbalanced loci twice."""
    from acn.operators import phasing, windows

    rows = [(k, "1", p, p // 10 * (k != "b") % 2, p > 40, 1) for k in "abc" for p in range(10, 90, 10) if (k, p) != ("c", 30)]
    phased = spark.createDataFrame([("p", *r) for r in rows if r[0] != "c"] + [("q", *r) for r in rows if r[0] == "c"], "patient_id string, sample_id string, chrom string, pos long, bit int, phased boolean, ps long")
    joint = phasing.multisample_phasing(phased)
    assert "LeftSemi" not in _plan(joint) and {(r["patient_id"], r["pos"]) for r in joint.collect()} == {(r["patient_id"], r["pos"]) for r in phased.collect()}
    shared = phasing.multisample_phasing(phased.drop("patient_id"))
    assert sorted(r["pos"] for r in shared.collect()) == [10, 20, 40, 50, 60, 70, 80]
    haps = spark.createDataFrame([("s", "1", p, "A", "C", p // 10 % 2, 1 - p // 10 % 2 if p != 30 else 1) for p in range(10, 60, 10)], "sample_id string, chrom string, pos long, ref string, alt string, hap1 int, hap2 int")
    external = spark.createDataFrame([("s", "1", 20, 1, 1), ("s", "1", 20, 1, 1), ("s", "1", 50, 1, 1)], "sample_id string, chrom string, pos long, hap1 int, ps long")
    made = phasing.apply_external_haplotypes(haps, external)
    assert _plan(made).count("Join ") == 1
    assert sorted((r["pos"], r["hap1"], r["hap2"]) for r in made.collect()) == [(10, 0, 1), (20, 1, 0), (30, 1, 1), (40, 0, 1), (50, 1, 0)]
    levels = spark.createDataFrame([("s", "1", p, v) for p, v in zip(range(10, 90, 10), [0.5, 0.7, 0.7, 0.5, 0.7, 0.8, None, 0.5])], "sample_id string, chrom string, pos long, baf_seg double")
    sets = windows.phase_set_ids(levels)
    assert "Union" not in _plan(sets)
    assert [r["ps"] for r in sets.orderBy("pos").collect()] == [20, 20, 20, 20, 20, 60, 60, 60]


def test_segments_read_their_runs_once_written(spark):
    """Means, segments and moments by value each made the runs again and met LogR again: ten windows."""
    from acn.plans import lifecycle

    rows = [("s", "1", p, 0.6 + p % 2 * 0.02, 0.6 if p < 50 or p > 90 else 0.5, 0.1 * (p > 90)) for p in range(10, 140)]
    df = spark.createDataFrame(rows, "sample_id string, chrom string, pos long, baf_phased double, baf_seg double, logr double")
    made = lifecycle.segments_of(df.drop("logr"), df.select("sample_id", "chrom", "pos", "logr"))
    assert _plan(made).count("Window [") <= 2 and _plan(made).count("Join ") <= 3
    got = sorted((r["start_pos"], r["end_pos"], r["length"], r["size"], round(r["r"], 6)) for r in made.collect())
    assert got == [(10, 49, 40, 89, 0.0), (50, 90, 41, 41, 0.0), (91, 139, 49, 89, 0.1)]


def test_calls_read_their_segments_written(spark):
    """Counting the segments' pieces, meeting LogR and joining the means each made the runs of all loci again."""
    from acn.operators import calls

    rows = [("s", "1", p, 0.6 + p % 2 * 0.02, 0.6 if p < 50 else 0.5, 0.0) for p in range(10, 140)]
    df = spark.createDataFrame(rows, "sample_id string, chrom string, pos long, baf_phased double, baf_seg double, logr double")
    fit = spark.createDataFrame([("s", 0.7, 2.1)], "sample_id string, rho double, psi_t double")
    made = calls.call_subclones(df, df, fit)
    assert "Window [" not in _plan(made)
    assert sorted((r["start_pos"], r["end_pos"], r["n"]) for r in made.collect()) == [(10, 49, 40), (50, 139, 90)]
