"""Ordered operators: each window is one sample's chromosome."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import div, refit_position
from . import kernels

KEYS = ["sample_id", "chrom"]


def ordered(keys=None, order: str = "pos"):
    return Window.partitionBy(*(keys or KEYS)).orderBy(order)


def in_order(df: DataFrame, keys: list[str], order: list[str], work, schema) -> DataFrame:
    """work over Arrow batches that hold each group of keys whole and in order, one group after another. Unlike a grouped map, a task needn't
    hold a group: runs() gives it slice by slice."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(work, schema)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The slices of batches in order of keys, each of one group, with the group's key."""
    for b in batches:
        if b.num_rows:
            codes = np.column_stack([b.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for k in keys])
            starts = np.r_[0, np.flatnonzero((codes[1:] != codes[:-1]).any(axis=1)) + 1, b.num_rows].tolist()
            for low, high in zip(starts, starts[1:]):
                yield tuple(b.column(k)[low].as_py() for k in keys), b.slice(low, high - low)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, Iterator[pa.RecordBatch]]]:
    """Each group's key with its slices."""
    for key, slices in groupby(runs(batches, keys), itemgetter(0)):
        yield key, (b for _, b in slices)


def run_islands(df: DataFrame, value: str, order: str = "pos", keys=None) -> DataFrame:
    """Adds run_id: neighbours in order with equal values share one, from 1."""
    w = ordered(keys, order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    return df.withColumn("_new", new).withColumn("run_id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def inter_het_distance(hets: DataFrame) -> DataFrame:
    """Adds gap (to the next locus; the last repeats the one before it) and scaled_gap (over the chromosome's largest)."""
    w = ordered()
    gap = F.coalesce(F.lead("pos").over(w) - F.col("pos"), F.col("pos") - F.lag("pos").over(w))
    out = hets.withColumn("gap", gap)
    return out.withColumn("scaled_gap", div(F.col("gap"), F.max("gap").over(Window.partitionBy(*KEYS))))


def big_gap_split(df: DataFrame, gap: int = 3_000_000) -> DataFrame:
    """Adds piece: 0 and up, one more behind each gap of that many bases or more."""
    w = ordered()
    far = F.coalesce((F.col("pos") - F.lag("pos").over(w) >= gap).cast("int"), F.lit(0))
    return df.withColumn("_far", far).withColumn("piece", F.sum("_far").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_far")


def presegment(df: DataFrame, breakpoints: DataFrame | None = None, gap: int = 3_000_000) -> DataFrame:
    """Adds piece: breakpoints before the locus plus large gaps up to it. A locus on a breakpoint belongs to the left."""
    if breakpoints is None:
        return big_gap_split(df, gap)
    split = big_gap_split(df, gap)
    samples = df.select(*KEYS).distinct()
    points = breakpoints.select("chrom", "pos").distinct().join(samples, "chrom")
    marks = points.select(*KEYS, "pos", F.lit(1).alias("_b")).unionByName(split.select(*KEYS, "pos", F.lit(0).alias("_b"), F.struct(*split.columns).alias("_row")), allowMissingColumns=True)
    w = Window.partitionBy(*KEYS).orderBy("pos", "_b").rowsBetween(Window.unboundedPreceding, 0)
    counted = marks.withColumn("_n", F.sum("_b").over(w)).filter("_row is not null")
    return counted.select("_row.*", "_n").withColumn("piece", F.col("piece") + F.col("_n")).drop("_n")


def _join_small(chrom: np.ndarray, start: np.ndarray, end: np.ndarray, n: np.ndarray, least: int) -> np.ndarray:
    """The chunk of each piece, from 0; pieces (chromosome, start, end, loci) come in order of the genome. Small ones join until none is left:
    at the genome's ends with what comes next, elsewhere with the nearer neighbour of their chromosome, or the one before them."""
    first = np.arange(len(n))  # of each chunk, its first piece

    def size() -> np.ndarray:
        """The first counts one more, the last one less."""
        loci = np.add.reduceat(n, first)
        loci[0] += 1
        loci[-1] -= 1
        return loci

    if len(first) > 1:
        m = min(int(np.searchsorted(np.cumsum(n) + 1, least)), len(first) - 1)
        first = np.r_[0, first[m + 1 :]]
    if len(first) > 1:
        m = min(int(np.searchsorted(np.cumsum(np.add.reduceat(n, first)[::-1]) - 1, least)), len(first) - 1)
        first = first[: len(first) - m]
    while len(first) > 1 and len(i := np.flatnonzero(size() < least)):
        last = np.r_[first[1:], len(n)] - 1
        left, right = (i > 0) & (chrom[last[i - 1]] == chrom[first[i]]), np.zeros(len(i), bool)
        after = np.minimum(i + 1, len(first) - 1)
        right = (i + 1 < len(first)) & (chrom[last[i]] == chrom[first[after]])
        nearer_right = start[first[i]] - end[last[i - 1]] > start[first[after]] - end[last[i]]
        gone = np.where(right & (nearer_right | ~left), i + 1, i)  # chunks that go on with the one before them
        first = np.delete(first, np.unique(gone))
    return np.searchsorted(first, np.arange(len(n)), "right") - 1


def genome_chunks(df: DataFrame, hole: int = 1_000_000, min_snps: int = 200) -> DataFrame:
    """Pieces between holes, joined until each holds min_snps loci. Returns sample_id, chunk (0 and up in order of the genome), chrom,
    start_pos, end_pos and n; a chunk that spans chromosomes has a row for each. Only the pieces of a sample, whose number the genome's
    length bounds, meet in one task, as arrays of numbers."""
    pieces = big_gap_split(df, hole).groupBy(*KEYS, "piece").agg(F.min("pos").alias("start_pos"), F.max("pos").alias("end_pos"), F.count("*").alias("n"))
    number = F.when(F.col("chrom").rlike("^[0-9]+$"), F.col("chrom").cast("int")).otherwise(99)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (sample,), slices in groups(batches, ["sample_id"]):
            names, columns = {}, []
            for b in slices:
                own = b.column("chrom").dictionary_encode()
                codes = np.array([names.setdefault(c, len(names)) for c in own.dictionary.to_pylist()], np.int32)[own.indices.to_numpy(zero_copy_only=False)]
                columns.append((codes, *(b.column(c).to_numpy(zero_copy_only=False) for c in ("start_pos", "end_pos", "n"))))
            chrom, start, end, n = (np.concatenate(c) for c in zip(*columns))
            del columns
            chunk = _join_small(chrom, start, end, n, min_snps)
            at = np.flatnonzero(np.r_[True, (chunk[1:] != chunk[:-1]) | (chrom[1:] != chrom[:-1])])
            listed, loci, to = np.array(list(names)), np.add.reduceat(n, at), end[np.r_[at[1:], len(n)] - 1]
            for k in range(0, len(at), 100_000):
                some = at[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([sample] * len(some)), pa.array(chunk[some]), pa.array(listed[chrom[some]].tolist(), pa.string()), pa.array(start[some]),
                    pa.array(to[k : k + 100_000]), pa.array(loci[k : k + 100_000])], names=["sample_id", "chunk", "chrom", "start_pos", "end_pos", "n"])

    return in_order(pieces.withColumn("_number", number), ["sample_id"], ["_number", "chrom", "start_pos"], work, "sample_id string, chunk long, chrom string, start_pos long, end_pos long, n long")


class _Smoother:
    """Running medians of one group's values, which come slice by slice: medians leave once half a window has come behind them."""

    def __init__(self, half: int):
        self.half, self.x, self.at, self.seen = half, np.zeros(0), np.zeros(0, np.int64), 0
        self.before = 0  # values held for those behind them, whose medians have left

    def add(self, x: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray]:
        """The rows, counted from the group's first, whose medians are known now, and these; values that are NaN have none."""
        known = np.flatnonzero(~np.isnan(x))
        self.at = np.concatenate((self.at, self.seen + known))
        self.x = np.concatenate((self.x, x[known]))
        self.seen += len(x)
        held, half = len(self.x), self.half
        done = held if last else held - half
        before = self.before
        if done <= before or not last and held < 2 * half + 3:
            return np.zeros(0, np.int64), np.zeros(0)
        smooth = kernels.running_median(self.x, half)
        out = self.at[before:done], smooth[before:done]
        if not last:
            self.before = half + 3  # half a window, and what the rule at the end may look at
            self.x, self.at = self.x[done - self.before :], self.at[done - self.before :]
        return out


def running_medians(df: DataFrame, values: dict[str, str], k: int = 101, keys=None, step: int = 1) -> DataFrame:
    """running_median() of several columns (name of the median -> column) in one pass, and every step-th row of each group, from the first. Rows
    pass batch by batch; those of half a window and the medians of kept rows wait."""
    keys = list(keys or KEYS)
    rows = df.drop(*values)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, slices in groups(batches, keys):
            smoothers = {name: _Smoother(k // 2) for name in values}
            waiting, seen, slices = [], 0, iter(slices)  # batches of kept rows, with their places and medians
            b = next(slices, None)
            while b is not None:
                after = next(slices, None)
                at = np.arange(seen + -seen % step, seen + b.num_rows, step)
                seen += b.num_rows
                # a copy: a slice would hold its whole batch
                own = b if step == 1 else b.take(pa.array(at - (seen - b.num_rows)))
                waiting.append((own, at, {name: np.full(len(at), np.nan) for name in values}))
                ready = seen
                for name, c in values.items():
                    one = smoothers[name]
                    where, medians = one.add(b.column(c).cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False), after is None)
                    for _, places, found in waiting:
                        low, high = np.searchsorted(where, [places[0], places[-1] + 1]) if len(places) else (0, 0)
                        if high > low:
                            i = np.minimum(np.searchsorted(where, places), len(where) - 1)
                            hit = where[i] == places
                            found[name][hit] = medians[i[hit]]
                    ready = min(ready, *one.at[one.before : one.before + 1].tolist(), seen)
                while waiting and (after is None or not len(waiting[0][1]) or waiting[0][1][-1] < ready):
                    own, places, found = waiting.pop(0)
                    if len(places):
                        yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(v, from_pandas=True) for v in found.values())], names=[*own.schema.names, *found])
                b = after

    schema = T.StructType([*rows.schema.fields, *(T.StructField(name, T.DoubleType()) for name in values)])
    return in_order(rows, keys, ["pos"], work, schema)


def running_median(df: DataFrame, value: str, k: int = 101, keys=None, out: str = "running_median") -> DataFrame:
    """Centred median of k values; windows shrink near the ends, and each end is the median of itself, its neighbour's median and the line
    through the next two (Tukey's rule). k falls to the largest odd number that the group holds. Nulls stay null and count nowhere."""
    return running_medians(df, {out: value}, k, keys)


def mad_sd(df: DataFrame, value: str, half_width: int = 25, keys=None) -> DataFrame:
    """1.4826 times the median absolute deviation of the residual from the running median, over values other than 0."""
    keys = list(keys or KEYS)
    rows = running_median(df.filter(F.col(value) != 0), value, 2 * half_width + 1, keys).withColumn("_d", F.col(value) - F.col("running_median"))
    centre = rows.groupBy(*keys).agg(F.percentile("_d", F.lit(0.5)).alias("_c"))
    return rows.join(centre, keys).groupBy(*keys).agg((1.4826 * F.percentile(F.abs(F.col("_d") - F.col("_c")), F.lit(0.5))).alias("sd"))


def winsorise(df: DataFrame, value: str, k: int = 25, tau: float = 2.5, keys=None) -> DataFrame:
    """Adds winsorised: the value held within tau robust deviations of its running median of 2k + 1."""
    keys = list(keys or KEYS)
    rows = running_median(df, value, 2 * k + 1, keys)
    spread = rows.groupBy(*keys).agg((1.4826 * F.percentile(F.abs(F.col(value) - F.col("running_median")), F.lit(0.5))).alias("_s"))
    m, s = F.col("running_median"), F.col("_s") * tau
    return rows.join(spread, keys).withColumn("winsorised", F.least(F.greatest(F.col(value), m - s), m + s)).drop("_s", "running_median")


def phase_switches(df: DataFrame, max_lag: int = 100) -> DataFrame:
    """sample_id, chrom, pos, lag, switch: whether the haplotype bit differs from the one `lag` loci before. A batch of loci makes an array of
    all its lags at once; the bits of the last loci go on to the next batch."""
    kind = df.schema["bit"].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, slices in groups(batches, KEYS):
            bits, gone = None, np.zeros(0, bool)
            for b in slices:
                own = b.column("bit")
                at = 0 if bits is None else len(bits)
                fresh = own.fill_null(0).to_numpy(zero_copy_only=False)
                bits = fresh if bits is None else np.concatenate((bits, fresh))
                gone = np.concatenate((gone, own.is_null().to_numpy(zero_copy_only=False)))
                lags = np.minimum(np.arange(at, len(bits)), max_lag)
                back = np.lib.stride_tricks.sliding_window_view(np.concatenate((np.zeros(max_lag, bits.dtype), bits)), max_lag)[at : len(bits), ::-1]
                held = np.arange(max_lag) < lags[:, None]
                switch = np.abs(bits[at:, None] - back)[held]
                no_bit = None
                if gone.any():
                    before = np.lib.stride_tricks.sliding_window_view(np.concatenate((np.zeros(max_lag, bool), gone)), max_lag)[at : len(bits), ::-1]
                    no_bit = (before | gone[at:, None])[held]
                listed = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lags)].astype(np.int32)), pa.array(switch, own.type, mask=no_bit))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*KEYS, "pos")), listed], names=[*KEYS, "pos", "switches"])
                bits, gone = bits[-max_lag:], gone[-max_lag:]

    schema = T.StructType([*(df.schema[c] for c in (*KEYS, "pos")), T.StructField("switches", T.ArrayType(kind))])
    rows = in_order(df.select(*KEYS, "pos", "bit"), KEYS, ["pos"], work, schema)
    return rows.select(*KEYS, "pos", F.posexplode("switches").alias("_l", "switch")).select(*KEYS, "pos", (F.col("_l") + 1).alias("lag"), "switch")


def phase_evidence(df: DataFrame, max_lag: int = 100, balanced_weight: float = 0.25) -> DataFrame:
    """sample_id, chrom, pos, lag, evidence (and patient_id, where df has it): 1 where all loci from lag to here are phased and both ends share
    a phase set, else balanced_weight; as a share of the sum of the patient's samples."""
    own = [c for c in ("patient_id",) if c in df.columns]
    w = ordered([*own, *KEYS])
    rows = df.withColumn("_open", F.sum((~F.col("phased")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    back = F.collect_list(F.struct("ps", (F.col("_open") - (~F.col("phased")).cast("int")).alias("before"))).over(w.rowsBetween(-max_lag, -1))
    sure = lambda x: F.coalesce((x["before"] == F.col("_open")) & (x["ps"] == F.col("ps")), F.lit(False))
    each = rows.withColumn("_back", back).select(*own, *KEYS, "pos", F.reverse(F.transform("_back", sure)).alias("_sure"))
    # a locus's samples meet with all lags of a row in one array: a hundredth of the rows that lags would make
    alike = F.collect_list("_sure").over(Window.partitionBy(*own, "chrom", "pos"))
    lags = each.withColumn("_all", alike).select(*own, *KEYS, "pos", "_all", F.posexplode("_sure").alias("_l", "_s"))
    weight = lambda x: F.when(x, F.lit(1.0)).otherwise(F.lit(float(balanced_weight)))
    total = F.aggregate("_all", F.lit(0.0), lambda acc, x: acc + F.when(F.size(x) > F.col("_l"), weight(F.get(x, F.col("_l")))).otherwise(0.0))
    return lags.select(*own, *KEYS, "pos", (F.col("_l") + 1).alias("lag"), (weight(F.col("_s")) / total).alias("evidence"))


def phase_set_ids(df: DataFrame, threshold: float = 0.525) -> DataFrame:
    """Adds ps: the first position of each run of equal baf_seg among imbalanced loci; others take the nearest imbalanced locus's; the
    chromosome's first position where there is none."""
    from .intervals import nearest_of

    odd = F.greatest(F.col("baf_seg"), 1 - F.col("baf_seg")) > threshold
    w = ordered()
    rows = df.drop("ps").withColumn("_odd", F.when(odd, F.col("baf_seg")))
    before = F.last("_odd", True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    first = F.when(F.col("_odd").isNotNull() & ~F.col("_odd").eqNullSafe(before), F.col("pos"))
    rows = rows.withColumn("_first", first).withColumn("ps", F.last("_first", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = nearest_of("_t", KEYS)(rows.withColumn("_t", F.when(F.col("_odd").isNotNull(), F.struct("pos", "ps"))))
    placed = rows.withColumn("_least", F.min("pos").over(Window.partitionBy(*KEYS)))
    return placed.select(*df.drop("ps").columns, F.coalesce("_n.ps", "_least").alias("ps"))


def top_segments(profile: DataFrame, n: int = 5, min_mb: float = 2) -> DataFrame:
    """The longest clonal altered segments of each sample."""
    length = F.col("end_pos") - F.col("start_pos")
    good = (F.col("frac1") == 1) & ~((F.col("nMaj1") == 1) & (F.col("nMin1") == 1)) & (length > min_mb * 1e6)
    w = Window.partitionBy("sample_id").orderBy(length.desc(), "chrom", "start_pos")
    return profile.filter(good).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def thin_rows(df: DataFrame, step: int = 100, keys=None) -> DataFrame:
    """Every step-th row of each group in order, from the first."""
    return df.withColumn("_n", F.row_number().over(ordered(keys))).filter(F.col("_n") % step == 1 % step).drop("_n")


def adjacent_equal_merge_x(segs: DataFrame, tol: float = 0.01) -> DataFrame:
    """Joins neighbours of an arm whose copy numbers differ by at most tol; LogR is weighted by the number of loci."""
    w = Window.partitionBy("sample_id", "chrom", "arm").orderBy("start_pos")
    new = F.coalesce((F.abs(F.col("cn") - F.lag("cn").over(w)) > tol).cast("int"), F.lit(0))
    runs = segs.withColumn("_new", new).withColumn("run_id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("sample_id", "chrom", "arm", "run_id").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.sum("n").alias("n"),
        (F.sum(F.col("logr") * F.col("n")) / F.sum("n")).alias("logr"), (F.sum(F.col("cn") * F.col("n")) / F.sum("n")).alias("cn")).drop("run_id")


def refit_suggestions(profile: DataFrame, fit: DataFrame, n: int = 5, min_mb: float = 2, gamma: float = 1.0) -> DataFrame:
    """Purity and ploidy that make each of a sample's longest n clonal segments of unequal alleles (those with a BAF) exactly its state, with their
    distance from the fit's (sample_id, rho, psi_t). A sample without any, or without a segment of unequal alleles above min_mb, gets one row that asks
    for a purity from elsewhere (outside_purity)."""
    from ..functions.scalars import rho_psi_from_segment

    length = F.col("end_pos") - F.col("start_pos")
    unequal = profile.filter((F.col("nMaj1") != F.col("nMin1")) & F.col("baf").isNotNull())
    large = unequal.filter(length > min_mb * 1e6).select("sample_id").distinct()
    w = Window.partitionBy("sample_id").orderBy(length.desc(), "chrom", "start_pos")
    top = unequal.filter(~(F.col("frac1") < 1)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).join(large, "sample_id", "left_semi")
    rho, _, psi_t = rho_psi_from_segment("baf", "logr", "nMaj1", "nMin1", gamma)
    place = refit_position("start_pos", "end_pos").alias("pos_mb")
    rows = top.select("sample_id", "rank", "chrom", place, "nMaj1", "nMin1", "baf", "logr", rho.alias("rho"), psi_t.alias("psi_t"))
    own = fit.select("sample_id", F.col("rho").alias("_rho"), F.col("psi_t").alias("_psi_t"))
    far = {"rho_diff": F.abs(F.col("_rho") - F.col("rho")), "psi_t_diff": F.abs(F.col("_psi_t") - F.col("psi_t"))}
    placed = own.join(rows, "sample_id", "left").withColumns(far).withColumn("outside_purity", F.col("rank").isNull())
    return placed.withColumn("rank", F.coalesce("rank", F.lit(1))).drop("_rho", "_psi_t")
