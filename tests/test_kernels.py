"""The kernels against brute force and their own properties."""

import itertools
import math

import numpy as np
import pytest

from acn.functions import stats
from acn.operators import kernels as k
from acn.operators import merging


def brute(x, kmin, gamma):
    n, best = len(x), (math.inf, None)
    for breaks in range(n // kmin):
        for cuts in itertools.combinations(range(kmin, n), breaks):
            ends = np.array([*cuts, n])
            if (np.diff(np.r_[0, ends]) >= kmin).all():
                best = min(best, (k.objective(x, ends, gamma), tuple(ends)))
    return best


@pytest.mark.parametrize("seed", range(6))
def test_exact_fit_is_the_best_partition(seed):
    rng = np.random.default_rng(seed)
    x = np.repeat(rng.normal(0, 1, 3), [4, 3, 5]) + rng.normal(0, 0.2, 12)
    assert k.objective(x, k.pcf_exact_ends(x, 2, 0.3), 0.3) == pytest.approx(brute(x, 2, 0.3)[0])


def test_fast_fit_is_near_the_exact_one():
    rng = np.random.default_rng(3)
    x = np.repeat([0.5, 0.8, 0.6, 0.5], [80, 60, 90, 70]) + rng.normal(0, 0.05, 300)
    exact, fast = (k.objective(x, f(x, 5, 0.1), 0.1) for f in (k.pcf_exact_ends, k.pcf_fast_ends))
    assert exact <= fast <= exact * 1.05


def test_fast_fit_of_a_long_track():
    x = np.repeat([0.0, 1.0, 0.3], [7000, 6000, 7000]) + np.random.default_rng(1).normal(0, 0.1, 20000)
    assert k.pcf_fast_ends(x, 5, 1.0).tolist() == pytest.approx([7000, 13000, 20000], abs=3)


def test_two_passes_undo_phase_switches():
    rng = np.random.default_rng(5)
    b = np.where(np.repeat(rng.integers(0, 2, 20), 30) == 1, 0.7, 0.3) + rng.normal(0, 0.03, 600)
    phased, run = k.two_pass(b, 10, 3, 3, 3)
    assert run.max() == 0 and phased.mean() == pytest.approx(0.7, abs=0.01)
    assert len(k.two_pass(b[:10], 10, 3, 3, 3)[0]) == 10


def test_running_median_ends():
    assert k.running_median(np.array([5.0, 1, 2, 3, 9]), 1).tolist() == [2, 2, 2, 3, 5]
    assert k.running_median(np.array([4.0, 1]), 2).tolist() == [4, 1]


def test_tails():
    assert stats.t_two_tailed(np.array([2.228139, 1.959964]), np.array([10.0, 1e7])) == pytest.approx([0.05, 0.05], abs=1e-5)
    assert stats.binomial_cdf(np.array([3.0]), np.array([10.0]), 0.5) == pytest.approx([sum(math.comb(10, i) for i in range(4)) / 1024])
    assert np.exp(stats.binomial_log_pmf([4.0], [9.0], [0.3]))[0] == pytest.approx(math.comb(9, 4) * 0.3**4 * 0.7**5)


def test_vote_follows_sure_evidence():
    """Of two samples that disagree on a switch, the one phased in one set outweighs the other."""
    bits = np.array([[0, 0], [0, 0], [1, 0], [1, 0]])
    phased = np.array([[True, False]] * 4)
    assert k.phase_vote(bits, phased, np.array([[1.0, np.nan]] * 4), 100, 0.25).tolist() == [0, 0, 1, 1]
    assert k.phase_vote(bits, ~phased, np.array([[np.nan, 1.0]] * 4), 100, 0.25).tolist() == [0, 0, 0, 0]


def test_order_statistics_of_stretches():
    rng = np.random.default_rng(4)
    for x in (rng.integers(0, 9, 200).astype(float), rng.normal(0, 1, 333), np.array([2.0])):
        ranks = k.Ranks(x)
        for low, high in np.sort(rng.integers(0, len(x) + 1, (100, 2)), axis=1):
            if high > low:
                want = np.sort(x[low:high])
                assert [ranks.one(int(low), int(high), i) for i in range(high - low)] == want.tolist()
                assert ranks.nth(np.full(high - low, low), np.full(high - low, high), np.arange(high - low)).tolist() == want.tolist()


def test_running_median_of_any_width():
    x = np.random.default_rng(7).normal(0, 1, 1000)
    for half in (1, 2, 50, 499, 5000):
        got = k.running_median(x, half)
        h = [min(half, i, len(x) - 1 - i) for i in range(len(x))]
        assert got[1:-1].tolist() == [np.median(x[i - n : i + n + 1]) for i, n in enumerate(h)][1:-1]


def slow_vote(bits, phased, sets, max_lag, weight):
    h = [int(np.round(bits[0].mean()))]
    for p in range(1, len(bits)):
        back, total = min(max_lag, p), 0.0
        for lag in range(1, back + 1):
            e = [1.0 if phased[p - lag : p + 1, s].all() and sets[p, s] == sets[p - lag, s] else weight for s in range(bits.shape[1])]
            votes = sum(abs(h[p - lag] - abs(bits[p, s] - bits[p - lag, s])) * e[s] for s in range(bits.shape[1]))
            total += votes / sum(e) * (back + 1 - lag) / (back * (back + 1) / 2)
        h.append(int(np.round(total + 1e-12)))
    return h


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_votes_in_blocks(block):
    rng = np.random.default_rng(block)
    for samples in (1, 2, 3):
        bits, phased = rng.integers(0, 2, (90, samples)), rng.random((90, samples)) < 0.9
        sets = np.where(rng.random((90, samples)) < 0.1, np.nan, rng.integers(0, 3, (90, samples)).cumsum(axis=0) // 40)
        assert k.phase_vote(bits, phased, sets, 20, 0.25, block).tolist() == slow_vote(bits, phased, sets, 20, 0.25)


def slow_merge(segs, tracks, rho, psi, option, max_gap, sig):
    """Looks at all segments again after every step."""
    flat = lambda x: bool((x == x[0]).all())
    mean = lambda x: float(x[0]) if flat(x) else float(x.mean())
    inside = lambda t, s: tracks[t][1][(tracks[t][0] >= s[0]) & (tracks[t][0] <= s[1])]

    def square(s):
        every = 2 ** s[3] * ((1 - rho) * 2 + rho * psi)
        return round((rho - 1 - (s[2] - 1) * every) / rho), round((rho - 1 + s[2] * every) / rho)

    def differ(x, y):
        vx, vy = (0.0 if flat(v) else v.var(ddof=1) / len(v) for v in (x, y))
        if vx + vy == 0:
            return mean(x) != mean(y)
        df = (vx + vy) ** 2 / (vx**2 / (len(x) - 1) + vy**2 / (len(y) - 1))
        return stats.t_two_tailed((x.mean() - y.mean()) / np.sqrt(vx + vy), df) < sig

    def alike(a, b):
        if a[4:6] == b[4:6] and a[6] == b[6] == 1:
            return True
        if all(x != y for x, y in zip(square(a), square(b), strict=True)):
            return False
        pairs = [(inside(t, a), inside(t, b)) for t in ("logr", "baf")]
        return all(len(x) > 10 and len(y) > 10 for x, y in pairs) and not any(differ(x, y) for x, y in pairs)

    segs, closed = [list(s) for s in segs], [False] * (len(segs) - 1)
    while not all(closed):
        i = min((k for k in range(len(segs)) if not all(closed[max(k - 1, 0) : k + 1])), key=lambda k: (segs[k][1] - segs[k][0], k))
        for b in sorted((b for b in (i - 1, i) if 0 <= b < len(closed)), key=lambda b: max(0, segs[b + 1][0] - segs[b][1] - 1)):
            if closed[b]:
                continue
            left, right = segs[b], segs[b + 1]
            if right[0] - left[1] - 1 > max_gap or not alike(left, right):
                closed[b] = True
                continue
            new = [left[0], right[1], 0.0, 0.0, *(right if b == i else left)[4:]]
            x, y = inside("baf", new), inside("logr", new)
            new[2], new[3] = k.summary(x, option) if len(x) else (right if b == i else left)[2], float(y.mean()) if len(y) else 0.0
            segs[b : b + 2] = [new]
            del closed[b]
            closed[max(b - 1, 0) : b + 1] = [False] * len(closed[max(b - 1, 0) : b + 1])
            break
    return segs


@pytest.mark.parametrize("seed", range(12))
def test_heap_merges_like_rescanning(seed):
    rng = np.random.default_rng(seed)
    n, loci = 40, 6 + 4 * (seed % 6)
    pos = {t: np.sort(rng.choice(n * 100_000, n * loci * f, replace=False)) for t, f in (("baf", 1), ("logr", 2))}
    state = np.repeat(rng.integers(0, 4, n), 2)[:n]
    baf = np.clip(0.5 + 0.1 * state[pos["baf"] // 100_000] + rng.normal(0, 0.03, n * loci), 0, 1)
    tracks = {"baf": (pos["baf"], np.round(baf, 1) if seed % 3 == 0 else baf), "logr": (pos["logr"], 0.2 * state[pos["logr"] // 100_000] + rng.normal(0, 0.2, 2 * n * loci))}
    segs = [[j * 100_000 + rng.integers(1, 20_000), (j + 1) * 100_000 - rng.integers(1, 20_000), 0.5 + 0.1 * s + rng.normal(0, 0.01), 0.2 * s, float(1 + s // 2),
        float(s % 2), float(rng.choice([1.0, 0.7]))] for j, s in enumerate(state.tolist())]
    for option, gap in ((1, 25_000), (2, 3_000_000), (3, 3_000_000)):
        got = merging.merge(segs, merging.Track(*tracks["baf"]), merging.Track(*tracks["logr"], False), 0.7, 2.3, option, gap, 1.0, 0.05)
        want = slow_merge(segs, tracks, 0.7, 2.3, option, gap, 0.05)
        assert len(got) == len(want) < n and np.allclose(got, want, atol=1e-9)
