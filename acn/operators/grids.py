"""Kernels of the score grids: segments against the points of a grid, as arrays, in tiles.

Segments stream through scan tasks in ranges of samples. A task holds the sums of one sample's points at a time and sends them on when the
sample ends, so a sample of any size is spread over tasks and their sums are added by Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import _lgamma, t_two_tailed

TILE = 30_000  # cells of segments and points held at once: its arrays stay in a core's cache
LEAST_LOG = -745.13  # below it the exponential is 0
BOUNDS = ["psi_min", "psi_max", "rho_min", "rho_max"]

Points = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # i, j, psi, rho


def ratio(a, b):
    """NaN where b is 0."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(b != 0, a / b, np.nan)


def level(rho, n_maj, n_min):
    """BAF of a state; 0.5 where no copy is left."""
    return np.where((n_maj == 0) & (n_min == 0), 0.5, ratio(1 - rho + rho * n_maj, 2 - 2 * rho + rho * (n_maj + n_min)))


def rescue(major, minor, b, cap):
    """Lifts a negative minor to 0.01 and the major along the line of equal BAF."""
    lifted = major + ratio(b * (0.01 - minor), 1 - b)
    return np.where(minor < 0, np.where((b == 1) | (lifted < 0), cap, lifted), major), np.where(minor < 0, 0.01, minor)


def edge(rho, b, major, minor):
    """m1, n1, m2, n2: the side of the unit square that the segment is nearest to."""
    x, y = np.floor(minor), np.floor(major)
    low = major + minor < x + y + 1
    above3, above2 = b > level(rho, y, x), b > level(rho, np.ceil(major), np.ceil(minor))
    lower = ~above3 & ~above2
    return y + (~low & ~lower), x + (~low & lower), y + (~low | above3), x + (~low | ~above3)


def closest_state(rho, b, major, minor):
    """level, major and minor of the end of that side whose BAF is closer."""
    m1, n1, m2, n2 = edge(rho, b, major, minor)
    l1, l2 = level(rho, m1, n1), level(rho, m2, n2)
    first = (np.abs(l1 - b) <= np.abs(l2 - b)) | np.isnan(l2)
    return np.where(first, l1, l2), np.where(first, m1, m2), np.where(first, n1, n2)


_critical: dict[tuple[float, float], float] = {}


def critical_t(df: np.ndarray, sig: float) -> np.ndarray:
    """The t below which the two-tailed p is above sig, by degrees of freedom; -1 where there are none."""
    new = np.array([d for d in np.unique(df[df > 0]) if (d, sig) not in _critical])
    if len(new):
        low, high = np.zeros(len(new)), np.ones(len(new))
        while (open_ := t_two_tailed(high, new) > sig).any():
            high = np.where(open_, 2 * high, high)
        for _ in range(60):
            middle = (low + high) / 2
            above = t_two_tailed(middle, new) > sig
            low, high = np.where(above, middle, low), np.where(above, high, middle)
        _critical.update(zip(((d, sig) for d in new.tolist()), high.tolist(), strict=True))
    return np.array([_critical[d, sig] if d > 0 else -1.0 for d in df.tolist()])


def ascat_sums(s: dict[str, np.ndarray], psi: np.ndarray, rho: np.ndarray, metric: int, gamma: float, uninformative: float) -> np.ndarray:
    """Four rows by point: sums of either allele's copies, and the score if either is minor."""
    b, r, length = (s[c][:, None] for c in ("b", "r", "length"))
    every = 2.0 ** (r / gamma) * ((1 - rho) * 2 + rho * psi)
    n_a, n_b = (rho - 1 - (b - 1) * every) / rho, (rho - 1 + b * every) / rho
    off_a, off_b = (np.abs(n - np.maximum(np.rint(n), 0)) for n in (n_a, n_b))
    if metric == 0:
        weight = length * np.where(b <= uninformative, 0.05, 1.0)
        terms = off_a**2 * weight, off_b**2 * weight
    elif metric == 1:
        terms = (0.5 - off_a) ** 2 * length, (0.5 - off_b) ** 2 * length
    else:
        gone = (n_a < 0.5) & (n_b < 0.5) & (n_a >= 0) & (n_b >= 0)
        both = 0.5 * ((0.5 - off_a) ** 2 + (0.5 - off_b) ** 2) * length * (np.where(gone, 8.0, 1.0) if metric == 3 else 1.0)
        terms = both, both
    return np.stack([np.nansum(x, axis=0) for x in (n_a, n_b, *terms)])


def clonal_sums(s: dict[str, np.ndarray], psi: np.ndarray, rho: np.ndarray, metric: int, gamma: float, sig: float, max_dist: float, read_depth: float, cap: float) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of the score by point, and of each point's longest clonal, unbalanced segment its length, minus its place, b, r,
    nMaj and nMin (minus infinity where there is none)."""
    r0 = np.nan_to_num(s["r"])[:, None]
    b, r, length, size, mean, sd = (s[c][:, None] for c in ("b", "r", "length", "size", "mean", "sd"))
    every = 2.0 ** (r0 / gamma) * ((1 - rho) * 2 + rho * psi)
    n_a, n_b = (rho - 1 - (b - 1) * every) / rho, (rho - 1 + b * every) / rho
    first, second = np.maximum(n_a, n_b), np.minimum(n_a, n_b)
    major, minor = rescue(first, second, b, cap)
    at, n_maj, n_min = closest_state(rho, b, major, minor)
    limit = (s["limit"] if "limit" in s else critical_t(s["size"] - 1, sig))[:, None]
    near = np.abs(b - at) < max_dist
    with np.errstate(divide="ignore", invalid="ignore"):
        close = np.abs((b - at) * np.sqrt(size) / sd) < limit
    clonal = (near | (close & ~np.isnan(sd))) & ~(sd == 0) & (major - first < 1)
    ones = np.ones_like(clonal, float)
    if metric == 0:
        top, below = np.where(clonal, length, 0.0), length * ones
    elif metric == 1:
        top, below = _squared_errors(b, r0, size, mean, sd, rho, psi, gamma)
    elif metric == 2:
        top, below = (b - mean) ** 2 * ones, ones
    elif metric == 3:
        top, below = length * (b - mean) ** 2 * ones, length * ones
    else:
        top, below = _log_ratios(b, r0, size, mean, rho, psi, gamma, read_depth, cap), ones
    candidate = np.where(clonal & (n_maj != n_min), length, -np.inf)
    longest = candidate.max(axis=0)
    pick = np.where(candidate == longest, s["place"][:, None], -np.inf).argmax(axis=0)
    p = np.arange(len(psi))
    ref = np.stack([longest, s["place"][pick], s["b"][pick], s["r"][pick], n_maj[pick, p], n_min[pick, p]])
    return np.stack([np.nansum(top, axis=0), np.nansum(below, axis=0)]), ref


def _squared_errors(b, r, size, mean, sd, rho, psi, gamma):
    every = psi * 2.0 ** (r / gamma)
    lifted = lambda n: np.where((n < 0) | np.isnan(n), 0.01, n)
    x, y = lifted((rho - 1 + b * every) / rho), lifted((rho - 1 + (1 - b) * every) / rho)
    corner = lambda a, c: ratio(1 - rho + rho * a, 2 - 2 * rho + rho * (a + c))
    levels = np.stack([corner(np.floor(x), np.ceil(y)), corner(np.ceil(x), np.ceil(y)), corner(np.floor(x), np.floor(y)), corner(np.ceil(x), np.floor(y))])
    far = np.where(np.isnan(levels), np.inf, np.abs(levels - b))
    best = np.take_along_axis(levels, far.argmin(axis=0)[None], axis=0)[0]
    good = (size > 0) & (sd != 0) & ~np.isnan(sd) & ~np.isnan(best)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(good, (mean - best) * np.sqrt(size) / sd, 0.0)
    return t * t, good.astype(float)


def _log_ratios(b, r, size, mean, rho, psi, gamma, read_depth, cap):
    every = psi * 2.0 ** (r / gamma)
    major, minor = rescue((rho - 1 + b * every) / rho, (rho - 1 + (1 - b) * every) / rho, b, cap)
    m1, n1, m2, n2 = edge(rho, b, major, minor)
    half_up = lambda v: np.floor(v + 0.5)
    n = half_up(size * read_depth)
    k = np.clip(half_up(mean * size * read_depth), 0, n)
    ways = _lgamma(n + 1) - _lgamma(k + 1) - _lgamma(n - k + 1)

    def log_pmf(l):
        p = np.clip(np.nan_to_num(l), 0, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            return ways + np.where(k == 0, 0.0, k * np.log(p)) + np.where(n == k, 0.0, (n - k) * np.log1p(-p))

    l1, l2 = level(rho, m1, n1), level(rho, m2, n2)
    one, two = log_pmf(l1), log_pmf(l2)
    good = ~np.isnan(l1) & ~np.isnan(l2) & (one > LEAST_LOG) & (two > LEAST_LOG)
    with np.errstate(invalid="ignore"):
        return np.where(good, np.abs(one - two), 0.0)


def point_sums(s: dict[str, np.ndarray], psi: np.ndarray, rho: np.ndarray, gamma: float) -> np.ndarray:
    """Six rows by point: copies by length, segments that have any, length, copies of 0 by length, the same outside BAF 0.5, and the length there."""
    b, r, length = (s[c][:, None] for c in ("b", "r", "length"))
    every = 2.0 ** (r / gamma) * ((1 - rho) * 2 + rho * psi)
    n_a, n_b = (rho - 1 - (b - 1) * every) / rho, (rho - 1 + b * every) / rho
    zero = ((np.rint(n_a) == 0).astype(float) + (np.rint(n_b) == 0)) * length
    odd = np.where(b == 0.5, 0.0, 1.0)
    whole = np.nansum(length) * np.ones(len(psi))
    copies = (n_a + n_b) * length
    return np.stack([np.nansum(copies, axis=0), (~np.isnan(copies)).sum(axis=0), whole, np.nansum(zero, axis=0), np.nansum(zero * odd, axis=0), np.nansum(length * odd) * np.ones(len(psi))])


def refined_axes(low_psi: float, high_psi: float, low_rho: float, high_rho: float, steps: int) -> Points:
    """steps + 1 points each way inside the bounds."""
    k = np.arange(steps + 1)
    i, j = np.repeat(k, steps + 1), np.tile(k, steps + 1)
    return i + 1, j + 1, low_psi + (high_psi - low_psi) * i / steps, low_rho + (high_rho - low_rho) * j / steps


def _tiles(s: dict[str, np.ndarray], points: int) -> Iterator[dict[str, np.ndarray]]:
    rows = max(1, TILE // max(points, 1))
    for low in range(0, len(s["b"]), rows):
        yield {c: x[low : low + rows] for c, x in s.items()}


def score(grid: DataFrame, segments: DataFrame, sums: Callable, add: Callable, columns: list[str], out: list[str], steps: int = 100, prepare: Callable | None = None) -> DataFrame:
    """sample_id, i, j, psi, rho and `out`, of each task and sample: sums(segments, psi, rho) gives an array with a row for each of out, and
    add(a, b) puts two together. grid: points for all samples, of fixed size; bounds by sample (BOUNDS), between which points lie at
    `steps` steps each way; or a few points for each sample (with sample_id). prepare(segments) may add columns before
    the tiles are cut."""
    segments = segments.select("sample_id", *columns)
    fixed = None
    if "psi_min" in grid.columns:
        segments = segments.join(grid.select("sample_id", *BOUNDS), "sample_id")
    elif "sample_id" in grid.columns:
        own = grid.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("i", "j", "psi", "rho"))).alias("points"))
        segments = segments.join(own, "sample_id")
    else:
        fixed = tuple(np.array(c) for c in zip(*((p["i"], p["j"], p["psi"], p["rho"]) for p in grid.select("i", "j", "psi", "rho").collect()), strict=True))
    names = segments.columns

    def points_of(row: dict) -> Points:
        if fixed is not None:
            return fixed
        if "psi_min" in row:
            return refined_axes(*(row[c] for c in BOUNDS), steps)
        return tuple(np.array([p[c] for p in row["points"]]) for c in ("i", "j", "psi", "rho"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample, points, held = None, None, None

        def done() -> pa.RecordBatch:
            i, j, psi, rho = points
            own = [pa.array([sample] * len(i), pa.string()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(psi, pa.float64()), pa.array(rho, pa.float64())]
            return pa.RecordBatch.from_arrays([*own, *(pa.array(x) for x in held)], ["sample_id", "i", "j", "psi", "rho", *out])

        for batch in batches:
            ids = np.array(batch.column(0).to_pylist(), object)
            for low in np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]][: len(ids)]).tolist():
                high = low + 1
                while high < len(ids) and ids[high] == ids[low]:
                    high += 1
                if held is not None and ids[low] != sample:
                    yield done()
                    held = None
                if held is None:
                    sample, points = ids[low], points_of({c: batch.column(names.index(c))[low].as_py() for c in names})
                own = {c: batch.column(names.index(c)).slice(low, high - low).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns}
                for tile in _tiles(prepare(own) if prepare else own, len(points[2])):
                    found = sums(tile, points[2], points[3])
                    held = found if held is None else add(held, found)
        if held is not None:
            yield done()

    # a number of ranges is named, since a few bytes a segment stand for much work: left to themselves, small ranges are put together in a few tasks
    ranges = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = segments.repartitionByRange(ranges, "sample_id", F.xxhash64(*columns)).sortWithinPartitions("sample_id")
    return ranged.mapInArrow(run, "sample_id string, i int, j int, psi double, rho double, " + ", ".join(f"{c} double" for c in out))


def strict_minima(i: np.ndarray, j: np.ndarray, m: np.ndarray, radius: int) -> np.ndarray:
    """Which points are the only ones to reach the minimum of their square, and not within radius of the border. First along rows,
    then along columns, each minimum with the number of points that reach it."""
    if not len(i):
        return np.zeros(0, bool)
    x, y = i - i.min(), j - j.min()
    full = np.full((x.max() + 1 + 2 * radius, y.max() + 1 + 2 * radius), np.inf)
    full[x + radius, y + radius] = np.where(np.isnan(m), np.inf, m)
    rows = np.lib.stride_tricks.sliding_window_view(full, 2 * radius + 1, axis=1)
    low = rows.min(axis=2)
    count = (rows == low[..., None]).sum(axis=2)
    squares = np.lib.stride_tricks.sliding_window_view(low, 2 * radius + 1, axis=0)
    least = squares.min(axis=2)
    reached = ((squares == least[..., None]) * np.lib.stride_tricks.sliding_window_view(count, 2 * radius + 1, axis=0)).sum(axis=2)
    inside = (x >= radius) & (x <= x.max() - radius) & (y >= radius) & (y <= y.max() - radius)
    return inside & np.isfinite(m) & (m == least[x, y]) & (reached[x, y] == 1)
