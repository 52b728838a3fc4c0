"""Numpy kernels of the ordered dynamic programmes; each works on one chromosome or piece."""

from __future__ import annotations

import numpy as np

BLOCK, STEP, TOGETHER = 5000, 4000, 32
FLOOR_SD, FEW = 0.09, 50


class Ranks:
    """Order statistics of any stretch of a fixed array: a wavelet matrix over ranks. For each bit, from the highest, it tells how many
    ranks before each place have the bit unset, and the ranks are then parted by it. A level is a bit a place, with a count each 64."""

    def __init__(self, x: np.ndarray):
        self.sorted, ranks = np.unique(x, return_inverse=True)
        ranks = ranks.astype(np.int32)
        self.levels: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        for bit in range(max(len(self.sorted) - 1, 1).bit_length() - 1, -1, -1):
            unset = (ranks >> bit & 1) == 0
            packed = np.packbits(unset, bitorder="little")
            words = np.zeros(len(ranks) // 64 + 1, "<u8")
            words.view(np.uint8)[: len(packed)] = packed
            counts = np.r_[0, np.bitwise_count(words).cumsum(dtype=np.int64)[:-1]]
            self.levels.append((bit, words, counts, int(unset.sum())))
            ranks = np.r_[ranks[unset], ranks[~unset]]

    def nth(self, low, high, k) -> np.ndarray:
        """The k-th smallest, from 0, of each stretch [low, high)."""
        low, high, k = (np.array(v) for v in (low, high, k))
        rank = np.zeros(np.broadcast(low, high, k).shape, np.int64)
        for bit, words, counts, zeros in self.levels:
            a, b = (counts[i >> 6] + np.bitwise_count(words[i >> 6] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))) for i in (low, high))
            right = k >= b - a
            low, high = np.where(right, zeros + low - a, a), np.where(right, zeros + high - b, b)
            k, rank = np.where(right, k - (b - a), k), rank | right.astype(np.int64) << bit
        return self.sorted[rank]

    def one(self, low: int, high: int, k: int) -> float:
        """nth() of one stretch."""
        rank = 0
        for bit, words, counts, zeros in self.levels:
            a, b = (int(counts[i >> 6]) + (int(words[i >> 6]) & (1 << (i & 63)) - 1).bit_count() for i in (low, high))
            if k < b - a:
                low, high = a, b
            else:
                low, high, k, rank = zeros + low - a, zeros + high - b, k - (b - a), rank | 1 << bit
        return float(self.sorted[rank])


def running_median(x: np.ndarray, half: int) -> np.ndarray:
    """Centred medians with shrinking windows and Tukey's rule at both ends; the same time whatever the width."""
    n = len(x)
    half = min(half, ((n if n % 2 else n - 1) - 1) // 2) if n else 0
    if half < 1 or n < 3:
        return x.astype(float).copy()
    ranks, out = Ranks(x), np.empty(n)
    for start in range(0, n, 100_000):  # a search of all places at once takes a dozen arrays of their number
        i = np.arange(start, min(start + 100_000, n))
        h = np.minimum(half, np.minimum(i, n - 1 - i))
        out[i] = ranks.nth(i - h, i + h + 1, h)
    out[0] = np.median([x[0], out[1], 3 * out[1] - 2 * out[2]])
    out[-1] = np.median([x[-1], out[-2], 3 * out[-2] - 2 * out[-3]])
    return out


def robust_sd(x: np.ndarray, half: int = 25) -> float:
    """1.4826 MAD of the residual from the running median, over values other than 0; NaN where none is left."""
    x = x[x != 0]
    if not len(x):
        return np.nan
    d = x - running_median(x, half)
    return float(1.4826 * np.median(np.abs(d - np.median(d))))


def potts(counts: np.ndarray, sums: np.ndarray, squares: np.ndarray, kmin: int, gamma: float) -> np.ndarray:
    """Ends (in cells) of the runs that minimise squared error + gamma per break, with at least kmin values a run.
    sums and squares may have several columns, which share their breaks. Ties go to the earliest break; one run only wins if cheaper.
    Breaks that a later one beats whatever follows are left out of the search, so that its time grows with the number of values times the
    length of runs, not with the square of the values."""
    n = len(counts)
    c = np.r_[0, np.cumsum(counts)].astype(float)
    s = np.vstack([np.zeros((1, sums.shape[1])), np.cumsum(sums, axis=0)])
    q = np.r_[0, np.cumsum(squares.sum(axis=1))]
    best, back = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    if c[n] < 2 * kmin:
        return np.array([n])
    usable = np.searchsorted(c, c - kmin, "right") - 1  # the last break that leaves kmin values; negative for none
    margin = 1e-9 * (1 + q)  # far above what the sums lose by rounding
    one = s.shape[1] == 1
    s = s[:, 0] if one else s
    open_, alive, beaten, seen = np.zeros(0, int), np.ones(n + 1, bool), {}, 0
    for j in range(1, n + 1):
        if c[j] < kmin:
            continue
        best[j] = q[j] - (s[j] * s[j] if one else (s[j] ** 2).sum()) / c[j]
        if usable[j] > seen:
            new = np.arange(seen + 1, usable[j] + 1)
            seen = int(usable[j])
            for k in new.tolist():
                if (lost := beaten.pop(k, None)) is not None:
                    alive[lost] = False
            open_ = np.concatenate((open_, new[np.isfinite(best[new])]))
            open_ = open_[alive[open_]]
        i = open_
        if not len(i):
            continue
        d = s[j] - s[i]
        cost = best[i] + (q[j] - q[i]) - (d * d if one else (d * d).sum(axis=1)) / (c[j] - c[i])
        k = int(cost.argmin())
        if cost[k] + gamma <= best[j]:
            best[j], back[j] = cost[k] + gamma, i[k]
        # a break at j beats these for every end that leaves it kmin values
        if len(lost := i[cost > best[j] + margin[j]]):
            beaten[j] = lost
    out, j = [], n
    while j > 0:
        out.append(j)
        j = back[j]
    return np.array(out[::-1])


def potts_blocks(blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]], kmin: int, gamma: float) -> list[np.ndarray]:
    """potts() of many blocks (counts, sums, squares) of like size at once. A step takes the next cell of every block against all breaks
    before it, so that numpy is called once for all blocks; short blocks are filled up behind their end."""
    sizes = [len(counts) for counts, _, _ in blocks]
    m, columns = max(sizes), blocks[0][1].shape[1]
    c, q, *s = np.zeros((2 + columns, len(blocks), m + 1))
    for b, (counts, sums, squares) in enumerate(blocks):
        for total, x in ((c, counts), (q, squares.sum(axis=1)), *((s[k], sums[:, k]) for k in range(columns))):
            total[b, 1 : sizes[b] + 1] = np.cumsum(x)
            total[b, sizes[b] + 1 :] = total[b, sizes[b]]
    best, back = np.full(c.shape, np.inf), np.zeros(c.shape, int)
    rows = np.arange(len(blocks))
    for j in range(1, m + 1):
        at = slice(j, j + 1)
        square = sum(x[:, j] ** 2 for x in s)
        one = np.where(c[:, j] >= kmin, q[:, j] - square / np.maximum(c[:, j], 1), np.inf)
        room = c[:, at] - c[:, :j]
        d = s[0][:, at] - s[0][:, :j]
        d *= d
        for x in s[1:]:
            d += (x[:, at] - x[:, :j]) ** 2
        near = max(0, j - max(kmin, 1))  # cells hold a value or more: only breaks from here on can leave fewer than kmin
        with np.errstate(divide="ignore", invalid="ignore"):
            d /= room
        cost = q[:, at] - q[:, :j]
        cost += best[:, :j]
        cost -= d
        cost[:, near:][room[:, near:] < kmin] = np.inf
        k = cost.argmin(axis=1)
        low = cost[rows, k] + gamma
        split = (low <= one) & np.isfinite(low)
        best[:, j], back[:, j] = np.where(split, low, one), np.where(split, k, 0)
    out = []
    for b, n in enumerate(sizes):
        ends, j = [], n
        while j > 0:
            ends.append(j)
            j = int(back[b, j])
        out.append(np.array(ends[::-1]) if c[b, n] >= 2 * kmin else np.array([n]))
    return out


def fitted(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Run means, value by value."""
    starts = np.r_[0, ends[:-1]]
    return np.repeat(np.add.reduceat(x, starts) / (ends - starts), ends - starts)


def objective(x: np.ndarray, ends: np.ndarray, gamma: float) -> float:
    return float(((x - fitted(x, ends)) ** 2).sum() + gamma * (len(ends) - 1))


def pcf_exact_ends(x: np.ndarray, kmin: int, gamma: float) -> np.ndarray:
    x = np.asarray(x, float)
    return potts(np.ones(len(x)), x[:, None], (x**2)[:, None], kmin, gamma)


def _peaks(score: np.ndarray, share: float, near: float, total: int) -> np.ndarray:
    """Whether a score is close to the largest within 3 places and in the top share."""
    padded = np.pad(score, 3, constant_values=-np.inf)
    top = np.lib.stride_tricks.sliding_window_view(padded, 7).max(axis=1)
    tops = score[score >= near * top]
    keep = min(0.8, share * total / max(len(tops), 1))
    return (score > np.quantile(tops, 1 - keep)) & (score > near * top) if len(tops) else np.zeros(len(score), bool)


def candidates(x: np.ndarray, kmin: int, share1: float, share2: float, share3: float = 0.02, near: float = 0.9) -> np.ndarray:
    """Marks on values behind which a break may lie: peaks of a wide and a narrow high-pass filter and of a filter for runs of kmin,
    and all places near either end; the last value is always marked."""
    n = len(x)
    mark = np.zeros(n, bool)
    xc = np.r_[0, np.cumsum(x)]

    def high_pass(width: int) -> np.ndarray:
        i = np.arange(n - 6 * width + 1)
        core = np.abs(4 * xc[i + 3 * width] - xc[i] - xc[i + width] - xc[i + 5 * width] - xc[i + 6 * width])
        return np.r_[np.zeros(3 * width - 1), core, np.zeros(3 * width)]

    wide = 8
    if n < 6 * wide + 7:
        mark[:] = True
    else:
        mark |= _peaks(high_pass(wide), share1, near, n)
        narrow = high_pass(1)
        mark |= narrow > np.quantile(narrow[2:-3], 1 - share2)
        if kmin > 1 and n > 3 * kmin + 7:
            i = np.arange(n - 3 * kmin + 1)
            bump = np.abs(3 * (xc[i + 2 * kmin] - xc[i + kmin]) - (xc[i + 3 * kmin] - xc[i]))
            hit = np.flatnonzero(_peaks(bump, share3, near, len(bump)))
            mark[hit + kmin - 1] = True
            mark[hit + 2 * kmin - 1] = True
        edge = max(3 * wide - 1, kmin)
        mark[kmin - 1 : edge] = True
        mark[n - edge - 1 : n - kmin] = True
    mark[: kmin - 1] = False
    mark[n - kmin : n - 1] = False
    mark[n - 1] = True
    return mark


def _cells(x: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """x: values by column -> where cells between marks end, and their counts, sums and squares."""
    cells = np.flatnonzero(mark) + 1
    starts = np.r_[0, cells[:-1]]
    return cells, (cells - starts, np.add.reduceat(x, starts, axis=0), np.add.reduceat(x**2, starts, axis=0))


def _on_marks(x: np.ndarray, mark: np.ndarray, kmin: int, gamma: float) -> np.ndarray:
    """x: values by column -> ends of runs, breaks only behind marks."""
    cells, moments = _cells(x, mark)
    return cells[potts(*moments, kmin, gamma) - 1]


def pcf_fast_ends(x: np.ndarray, kmin: int, gamma: float) -> np.ndarray:
    """The same objective over marked breaks. Long inputs are thinned first: blocks that overlap keep the marks which a block's own
    best fit uses, so that the last pass is short."""
    x = np.asarray(x, float)
    x = x[:, None] if x.ndim == 1 else x
    n = len(x)
    if n < 2 * kmin:
        return np.array([n])
    share = (0.15, 0.15) if n < 1000 else (0.12, 0.05)
    mark = np.any([candidates(x[:, j], kmin, *share) for j in range(x.shape[1])], axis=0)
    if n >= 15000:
        kept = np.zeros(n, bool)
        for some in np.split(np.arange(0, n, STEP), np.arange(TOGETHER, -(-n // STEP), TOGETHER)):
            found = []
            for a in some.tolist():
                own = mark[a : a + BLOCK].copy()
                own[-1] = True
                found.append((a, *_cells(x[a : a + BLOCK], own)))
            for (a, cells, _), ends in zip(found, potts_blocks([moments for _, _, moments in found], kmin, gamma)):
                kept[a + cells[ends - 1] - 1] = True
                kept[a + cells[-1] - 1] = True
        mark = (kept & mark) | kept
        mark[: kmin - 1] = False
        mark[n - kmin : n - 1] = False
        mark[-1] = True
    return _on_marks(x, mark, kmin, gamma)


def two_pass(b: np.ndarray, gamma: float, phase_gamma: float, kmin: int, phase_kmin: int, no_segmentation: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(phased BAF, run of each value): a first fit finds on which side of 0.5 each haplotype block lies, b is turned over accordingly,
    and a second fit gives the segments."""
    n = len(b)
    sd = robust_sd(np.minimum(b, 1 - b))
    sd = max(0.0 if np.isnan(sd) else sd, FLOOR_SD)
    first = np.full(n, b.mean()) if n < FEW else fitted(b, pcf_fast_ends(b, phase_kmin, phase_gamma * sd))
    phased = np.where(first > 0.5, b, 1 - b)
    ends = np.array([n]) if n < FEW or no_segmentation else pcf_fast_ends(phased, kmin, gamma * sd)
    return phased, np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))


def summary(values: np.ndarray, option: int) -> float:
    """1: median, 2: mean, 3: median unless 0 or 1, then mean."""
    median = float(np.median(values))
    return float(values.mean()) if option == 2 or option == 3 and median in (0.0, 1.0) else median


def phase_vote(bits: np.ndarray, phased: np.ndarray, sets: np.ndarray, max_lag: int, balanced_weight: float, block: int = 4096) -> np.ndarray:
    """The joint haplotype: each locus by the votes of those up to max_lag before it, nearer ones weighing more. A sample's vote is what its
    bits say about a switch; it counts fully where all loci between are phased and both ends share a set, else balanced_weight, as a share of
    the samples' sum. bits, phased, sets: (loci, samples), NaN for no set, bits 0 or 1. The samples' share s of votes for a switch is made for a block of loci
    and all lags at once; a locus then votes s, or 1 - s where its own joint bit is 1, so the recursion is one inner product a locus."""
    n, of = bits.shape
    # one number a locus and sample: those of two loci are equal where all between are phased and both share a set
    names = np.unique(sets)
    here, back_run = np.empty((of, n), np.int64), np.full((of, max_lag + n), -2)
    for k in range(of):  # sample by sample: all at once, the steps between take several times the memory of what is kept
        known = phased[:, k] & ~np.isnan(sets[:, k])
        here[k] = np.cumsum(~phased[:, k])
        here[k] *= len(names)
        here[k] += np.searchsorted(names, sets[:, k])
        back_run[k, max_lag:][known] = here[k, known]
        here[k, ~known] = -1
    bit = np.ascontiguousarray(bits.T.astype(np.int8, copy=False))
    back_bit = np.concatenate((np.zeros((of, max_lag), np.int8), bit), axis=1)
    h = np.zeros(n + max_lag)  # from the lags before the first locus on
    h[max_lag] = np.round(bits[0].mean())
    lags = np.arange(max_lag, 0, -1)  # windows run towards the locus
    window = np.lib.stride_tricks.sliding_window_view
    for start in range(1, n, block):
        p = np.arange(start, min(start + block, n))
        count = np.uint8 if of < 256 else np.int32
        odd, sure, both = (np.zeros((len(p), max_lag), count) for _ in range(3))
        for k in range(of):
            other = window(back_bit[k, start : p[-1] + max_lag], max_lag) != bit[k, p, None]
            same = window(back_run[k, start : p[-1] + max_lag], max_lag) == here[k, p, None]
            odd += other
            sure += same
            both += other & same
        share = (both + balanced_weight * (odd - both)) / (sure + balanced_weight * (of - sure))
        k = np.minimum(max_lag, p)[:, None]
        weight = np.maximum(k + 1 - lags, 0) / (k * (k + 1) / 2)
        turn = weight * share
        base = (turn.sum(axis=1) + 1e-12).tolist()
        turn *= -2
        turn += weight
        for row, at in enumerate(p.tolist()):
            h[at + max_lag] = base[row] + turn[row].dot(h[at : at + max_lag]) > 0.5
    h = h[max_lag:]
    return h.astype(int)
