"""What only larger tables show: growth of kernels, ties and extremes."""

import math
import time

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from acn.operators import fit, kernels


def seconds(f, *args):
    t = time.process_time()
    f(*args)
    return time.process_time() - t


def test_exact_segmentation_grows_with_its_input():
    """Four times as many values took sixteen times as long."""
    n = 40_000
    x = np.where(np.arange(n) // 100 % 2, 0.4, 0.0) + np.random.default_rng(0).normal(0, 0.1, n)
    assert seconds(kernels.pcf_exact_ends, x, 5, 0.05) < 8 * seconds(kernels.pcf_exact_ends, x[: n // 4], 5, 0.05)


@pytest.mark.parametrize("seed", range(5))
def test_pruned_programme_finds_the_best_runs(seed):
    rng = np.random.default_rng(seed)
    x = np.repeat(rng.normal(0, 0.4, (8, 2)), 5, 0) + rng.normal(0, 0.1, (40, 2))
    kmin, gamma, n = 3, 0.2, 40
    cost = lambda a, b: float(((x[a:b] - x[a:b].mean(axis=0)) ** 2).sum())
    best = [math.inf] * (n + 1)
    for j in range(kmin, n + 1):
        best[j] = min([cost(0, j), *(best[i] + cost(i, j) + gamma for i in range(kmin, j - kmin + 1))])
    ends = kernels.potts(np.ones(n), x, x**2, kmin, gamma)
    starts = np.r_[0, ends[:-1]]
    assert sum(map(cost, starts, ends)) + gamma * (len(ends) - 1) == pytest.approx(best[n])


def test_segment_info_rounds_halfway_means_up(spark, monkeypatch):
    """The mean of two neighbours of six digits lies halfway; a sum a last bit short of it was rounded down."""
    from acn.queries import core

    values = next(v for v in ([round(a, 6), round(a + 1e-6, 6)] for a in np.arange(0.6, 0.9, 1e-3).tolist()) if sum(v) / 2 < round(v[0] + 5e-7, 7))
    df = spark.createDataFrame([("s", "1", i, v, 0.7, v, 0.1) for i, v in enumerate(values)], "sample_id string, chrom string, pos long, baf double, baf_seg double, baf_phased double, logr double")
    monkeypatch.setattr(core, "view", lambda *_: df)
    assert core.QUERIES["segment_info"](spark, "").first()["mean"] == values[1]


def test_log_ratio_of_the_least_probabilities(spark):
    """Near the least double a probability has a few bits, its logarithm has all."""
    rows = [("s", k, 0.7, 0.0, 50, 50, 0.7 + k / 500, 0.05) for k in range(-140, 140)]
    segs = spark.createDataFrame(rows, "sample_id string, seg_id long, b double, r double, length long, size long, mean double, sd double")
    at = spark.createDataFrame([("s", 0.73, 2.15)], "sample_id string, rho double, psi double")
    got = {r["seg_id"]: r["ln_ratio"] for r in fit.segment_ln_likelihood_ratio(segs, at).collect()}
    # between two levels the log of the ratio is a straight line in the number of reads
    ks = [k for k in sorted(got) if got[k] > 0]
    signed = np.array([got[k] for k in ks])
    reads = np.array([math.floor((0.7 + k / 500) * 1500 + 0.5) for k in ks], float)
    step = np.diff(signed) / np.diff(reads)
    assert (~np.isclose(np.abs(step), np.median(np.abs(step)), rtol=1e-6)).sum() <= 1  # where the likelier level changes


def test_grid_scores_are_dealt_over_tasks(spark):
    """Small ranges of segments were put together in a few tasks, though each segment stands for thousands of points."""
    rows = [("s", 0.5 + k / 10_000, 0.0, 100 + k) for k in range(4000)]
    segs = spark.createDataFrame(rows, "sample_id string, b double, r double, length long").repartition(8)
    few = fit.rho_psi_grid(spark, 2.0, 2.1, 0.7, 0.72)
    for scored, kernel in ((fit.score_grid_ascat(few, segs), "ascat"), (fit.grid_point_stats(few, segs), "stats")):
        plan = scored._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan and "mapInArrow" in plan or "MapInArrow" in plan and "REPARTITION_BY_NUM" in plan, kernel


def test_grid_point_stats_by_hand(spark):
    segs = spark.createDataFrame([("s", 0.6, 0.1, 3), ("s", 0.5, -0.2, 5), ("s", None, 0.0, 2), ("t", None, 0.0, 2)], "sample_id string, b double, r double, length long")
    got = {(r["sample_id"], r["i"], r["j"]): r for r in fit.grid_point_stats(fit.rho_psi_grid(spark, 2.0, 2.0, 0.7, 0.7), segs).collect()}
    n = lambda b, r: ((0.7 - 1 - (b - 1) * 2**r * (0.6 + 1.4)) / 0.7, (0.7 - 1 + b * 2**r * (0.6 + 1.4)) / 0.7)
    one, two = n(0.6, 0.1), n(0.5, -0.2)
    assert got["s", 1, 1]["ploidy"] == pytest.approx((3 * sum(one) + 5 * sum(two)) / 10)
    assert got["s", 1, 1]["most"] == 2.5 and got["s", 1, 1]["percent_zero"] == 0 and got["t", 1, 1]["ploidy"] is None


def test_knots_are_exact_without_holding_a_sample_in_a_task(spark):
    """Percentiles held every value of a sample in one task; bounds and counts give the same numbers."""
    from pyspark.sql import functions as F

    from acn.operators import regression

    shares = [0.0, 0.25, 0.5, 0.75, 1.0]
    rows = spark.range(30_001).selectExpr("if(id % 5 = 0, 't', 's') as sample_id", "round(sin(id) * sin(id), 4) as a", "cast(least(id % 9, 3) as double) as b", "id * id / 7 as c").repartition(7)
    rows = rows.union(spark.createDataFrame([("one", 1.0, 2.0, 3.0), ("two", 1.0, 2.0, 3.0), ("two", 4.0, 2.0, 9.0)], rows.schema))
    want = {r[0]: r[1:] for r in rows.groupBy("sample_id").agg(*(F.percentile(c, F.array(*map(F.lit, shares))) for c in "abc")).collect()}
    made = regression.exact_percentiles(rows, ["sample_id"], ["a", "b", "c"], shares)
    assert {r[0]: r[1:] for r in made.select("sample_id", "k0", "k1", "k2").collect()} == want
    fitted = regression.gc_replication_correct(rows.withColumn("logr", F.col("a") + F.col("c") / 1e8), "a", "b", "c")
    assert "percentile(" not in fitted._jdf.queryExecution().optimizedPlan().toString()


def test_joined_pieces_against_a_plain_loop():
    """Pieces were lists of lists, some 800 bytes each; arrays of numbers give the same chunks."""
    from acn.operators import windows

    def plain(chrom, start, end, n, least):
        pieces = [[chrom[i], start[i], chrom[i], end[i], n[i], [i]] for i in range(len(n))]
        size = lambda i: pieces[i][4] + (i == 0) - (i == len(pieces) - 1)

        def join(borders):
            out = []
            for i, p in enumerate(pieces):
                if i - 1 in borders:
                    out[-1] = [*out[-1][:2], *p[2:4], out[-1][4] + p[4], out[-1][5] + p[5]]
                else:
                    out.append(p)
            return out

        def border(i):
            before, own, after = pieces[i - 1 : i + 2]
            left, right = before[2] == own[0], own[2] == after[0]
            return i if right and (own[1] - before[3] > after[1] - own[3] or not left) else i - 1

        while len(pieces) > 1 and size(0) < least:
            pieces = join({0})
        while len(pieces) > 1 and size(len(pieces) - 1) < least:
            pieces = join({len(pieces) - 2})
        while len(pieces) > 1 and (small := [i for i in range(len(pieces)) if size(i) < least]):
            pieces = join({border(i) for i in small})
        return [k for k, p in enumerate(pieces) for _ in p[5]]

    for seed in range(300):
        rng = np.random.default_rng(seed)
        m = int(rng.integers(1, 40))
        chrom, n = np.sort(rng.integers(0, 5, m)), rng.integers(1, 12, m)
        start = np.cumsum(rng.integers(5, 30, m))
        end = start + rng.integers(0, 4, m)
        assert windows._join_small(chrom, start, end, n, 10).tolist() == plain(chrom.tolist(), start.tolist(), end.tolist(), n.tolist(), 10), seed


def test_ranks_take_little_memory():
    """A level took 8 bytes a value."""
    x = np.random.default_rng(0).normal(size=100_000)
    ranks = kernels.Ranks(x)
    assert sum(v.nbytes for level in ranks.levels for v in level if hasattr(v, "nbytes")) < 17 * len(x)
    assert ranks.one(100, 90_000, 44_950) == np.sort(x[100:90_000])[44_950] == ranks.nth([100], [90_000], [44_950])[0]


def test_phase_evidence_meets_by_locus(spark):
    """Each of a locus's 100 lags was a row of the shuffle in which samples meet."""
    from acn.operators import windows

    rows = [(s, "1", p, p // 7, (p + k) % 5 > 0) for k, s in enumerate("ab") for p in range(20 - 3 * k)]
    made = windows.phase_evidence(spark.createDataFrame(rows, "sample_id string, chrom string, pos long, ps long, phased boolean"), 4)
    assert not [x for x in made._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x and "lag" in x]
    got = {(r["sample_id"], r["pos"], r["lag"]): r["evidence"] for r in made.collect()}
    own = {(s, p): (ps, phased) for s, _, p, ps, phased in rows}
    weight = lambda s, p, lag: 1.0 if all(own[s, q][1] for q in range(p - lag, p + 1)) and own[s, p][0] == own[s, p - lag][0] else 0.25
    want = {(s, p, lag): weight(s, p, lag) for s, p in own for lag in range(1, min(p, 4) + 1)}
    assert got == {(s, p, lag): v / sum(want.get((t, p, lag), 0.0) for t in "ab") for (s, p, lag), v in want.items()}


def test_joint_phase_takes_its_loci_batch_by_batch(spark):
    """A patient's chromosome came as one frame with its names in every row. A repeated row of a sample counts once."""
    from acn.operators import phasing

    rows = [(q, s, "1", p, p * (k + 2) % 2, p % 9 > 0, float(p // 40)) for q in "xy" for k, s in enumerate("ab") for p in range(300)]
    df = spark.createDataFrame(rows + rows[:5], "patient_id string, sample_id string, chrom string, pos long, bit int, phased boolean, ps double")
    made = phasing.multisample_phasing(df, 10)
    assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().optimizedPlan().toString()
    grid = [np.array([[r[i] for r in rows[:300]], [r[i] for r in rows[300:600]]]).T for i in (4, 5, 6)]
    want = kernels.phase_vote(*grid, 10, 0.25).tolist()
    got = {q: [r["bit"] for r in made.filter(made.patient_id == q).orderBy("pos").collect()] for q in "xy"}
    assert got == {"x": want, "y": want}


def test_segmentation_takes_its_rows_batch_by_batch(spark):
    """A patient's chromosome came as one frame with its names in every row, and was turned to a wide one and copied."""
    from acn.operators import segmentation

    rng = np.random.default_rng(4)
    n = 400
    side = np.where(np.arange(n) // 40 % 2, 1, -1)
    own = {s: np.clip(0.5 + side * np.where(np.arange(n) < 150, 0.0, 0.2 + 0.05 * k) + rng.normal(0, 0.03, n), 0.01, 0.99) for k, s in enumerate("ba")}
    rows = [(q, q + s, "1", 100 * i, float(v), k) for q in "xy" for k, s in enumerate("ba") for i, v in enumerate(own[s]) if (q, s, i % 7) != ("y", "a", 0)]
    df = spark.createDataFrame(rows, "patient_id string, sample_id string, chrom string, pos long, baf double, extra int").repartition(5)
    made = segmentation.segment_phased_baf_multisample(df)
    alone = segmentation.segment_phased_baf(df.drop("patient_id"))
    for one in (made, alone):
        assert "FlatMapGroupsInPandas" not in one._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["patient_id"], r["sample_id"], r["pos"]): r for r in made.collect()}
    given = {r[:2] + (r[3],): r for r in rows}
    assert len(got) == 2 * n + 2 * sum(i % 7 != 0 for i in range(n))  # loci of all of a patient's samples
    for key, r in got.items():
        assert (r["baf"], r["extra"]) == given[key][4:] and r["baf_phased"] in (r["baf"], 1 - r["baf"])
    breaks = {s: [p for p in range(1, n) if got["x", "x" + s, 100 * p]["baf_seg"] != got["x", "x" + s, 100 * p - 100]["baf_seg"]] for s in "ab"}
    assert breaks["a"] == breaks["b"] and len(breaks["a"]) == 1 and abs(breaks["a"][0] - 150) < 5
    phased, run = kernels.two_pass(own["a"], 10, 3, 3, 3)
    level = pd.Series(phased).groupby(run).transform("median").tolist()
    assert [(r["baf_phased"], r["baf_seg"]) for r in alone.filter("sample_id = 'xa'").orderBy("pos").collect()] == list(zip(phased.tolist(), level))


def test_votes_take_little_memory():
    """Steps on the way to the votes took 50 bytes a locus and sample, twice what is kept."""
    import tracemalloc

    rng = np.random.default_rng(5)
    n = 200_000
    sets = np.repeat(np.arange(n // 50), 50)[:, None] + np.zeros((1, 4))
    sets[rng.random((n, 4)) < 0.01] = np.nan
    bits, phased = rng.integers(0, 2, (n, 4)).astype(np.int8), rng.random((n, 4)) > 0.1
    tracemalloc.start()
    vote = kernels.phase_vote(bits, phased, sets, 20, 0.25)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 35 * n * 4 and set(vote.tolist()) <= {0, 1}
