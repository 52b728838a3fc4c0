"""Segmentation: ordered dynamic programmes as grouped maps, one group per sample and chromosome or piece of it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels
from .windows import KEYS, groups, in_order, presegment


def _grouped(df: DataFrame, keys: list[str], values: list[str], added: list[tuple[str, T.DataType]], work, order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """df with the arrays that work makes of each group's values, as arrays in order. A group's rows come batch by batch and wait as Arrow columns,
    strings as numbers, its keys once; as a pandas frame, they took several times as much."""
    names = {n for n, _ in added}
    kept = [f for f in df.schema.fields if f.name not in names]
    held = [f.name for f in kept if f.name not in keys]

    def small(column: pa.Array) -> pa.Array:
        return column.dictionary_encode() if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, slices in groups(batches, keys):
            waiting, columns, types = [], [], {}
            for b in slices:
                types = {c: b.schema.field(c).type for c in b.schema.names}
                waiting.append([small(b.column(c)) for c in held])
                columns.append([b.column(c).to_numpy(zero_copy_only=False) for c in values])
            arrays = [np.concatenate(c) for c in zip(*columns)]
            del columns
            made, low = work(*arrays), 0
            del arrays
            waiting.reverse()
            while waiting:
                own = dict(zip(held, waiting.pop()))
                n = len(own[held[0]])
                whole = {k: pa.array([v] * n, types[k]) for k, v in zip(keys, key)} | {c: x.cast(types[c]) for c, x in own.items()}
                yield pa.RecordBatch.from_arrays([*(whole[f.name] for f in kept), *(pa.array(x[low : low + n]) for x in made)], names=[*(f.name for f in kept), *(n for n, _ in added)])
                low += n

    return in_order(df, keys, list(order), run, T.StructType([*kept, *(T.StructField(n, t) for n, t in added)]))


def _levels(phased: np.ndarray, ends: np.ndarray, option: int) -> np.ndarray:
    """The summary of each run, value by value."""
    starts = np.r_[0, ends[:-1]]
    return np.repeat([kernels.summary(phased[a:b], option) for a, b in zip(starts, ends)], ends - starts)


def pcf_exact(df: DataFrame, value: str, gamma: float, kmin: int = 5, keys=KEYS) -> DataFrame:
    """Adds fit: the piecewise constant of least squared error + gamma a break, runs of kmin or more. Quadratic in a group's rows."""

    def work(x: np.ndarray) -> list[np.ndarray]:
        x = x.astype(float)
        return [kernels.fitted(x, kernels.pcf_exact_ends(x, kmin, gamma))]

    return _grouped(df, list(keys), [value], [("fit", T.DoubleType())], work)


def pcf_fast(df: DataFrame, value: str, kmin: int, gamma: float, keys=KEYS) -> DataFrame:
    """Adds fit: the same objective over marked breaks only."""

    def work(x: np.ndarray) -> list[np.ndarray]:
        x = x.astype(float)
        return [kernels.fitted(x, kernels.pcf_fast_ends(x, kmin, gamma))]

    return _grouped(df, list(keys), [value], [("fit", T.DoubleType())], work)


def pcf_candidates(df: DataFrame, value: str, kmin: int, share1: float = 0.15, share2: float = 0.15, share3: float = 0.02, near: float = 0.9, keys=KEYS) -> DataFrame:
    """Adds mark: whether a break may lie behind the row."""

    def work(x: np.ndarray) -> list[np.ndarray]:
        return [kernels.candidates(x.astype(float), kmin, share1, share2, share3, near)]

    return _grouped(df, list(keys), [value], [("mark", T.BooleanType())], work)


def pcf_compact(df: DataFrame, value: str, mark: str, keys=KEYS) -> DataFrame:
    """Counts, sums and squares of the rows up to each mark."""
    from .windows import ordered

    keys = list(keys)
    w = ordered(keys)
    cell = F.sum(F.col(mark).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col(mark).cast("int")
    return df.withColumn("cell", cell).groupBy(*keys, "cell").agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.sum(F.col(value) * F.col(value)).alias("squares"))


def flip_phased(baf: str, segmented: str) -> Column:
    return F.when(F.col(segmented) > 0.5, F.col(baf)).otherwise(1 - F.col(baf))


def segment_phased_baf(df: DataFrame, breakpoints: DataFrame | None = None, gamma: float = 10, phase_gamma: float = 3, kmin: int = 3, phase_kmin: int = 3,
    no_segmentation: bool = False, baf_option: int = 3) -> DataFrame:
    """Adds baf_phased and baf_seg. Pieces between breakpoints and large gaps are groups of their own."""

    def work(x: np.ndarray) -> list[np.ndarray]:
        phased, run = kernels.two_pass(x.astype(float), gamma, phase_gamma, kmin, phase_kmin, no_segmentation)
        return [phased, _levels(phased, np.r_[np.flatnonzero(np.diff(run)) + 1, len(run)], baf_option)]

    pieces = presegment(df.filter("baf is not null"), breakpoints)
    return _grouped(pieces, [*KEYS, "piece"], ["baf"], [("baf_phased", T.DoubleType()), ("baf_seg", T.DoubleType())], work).drop("piece")


def segment_phased_baf_legacy(df: DataFrame, gamma: float = 10, phase_gamma: float = 3, kmin: int = 3, phase_kmin: int = 3) -> DataFrame:
    """Whole chromosomes, mean as the summary."""

    def work(x: np.ndarray) -> list[np.ndarray]:
        phased, run = kernels.two_pass(x.astype(float), gamma, phase_gamma, kmin, phase_kmin)
        return [phased, pd.Series(phased).groupby(run).transform("mean").to_numpy()]

    return _grouped(df.filter("baf is not null"), list(KEYS), ["baf"], [("baf_phased", T.DoubleType()), ("baf_seg", T.DoubleType())], work)


def segment_phased_baf_multisample(df: DataFrame, breakpoints: DataFrame | None = None, gamma: float = 5, baf_option: int = 3, patient: str = "patient_id") -> DataFrame:
    """Breaks that all samples of a patient share, over loci that each of them has, in pieces between breakpoints and large gaps; BAF is
    winsorised for the fit and its penalty is gamma times the mean of the samples' deviations. Adds baf_phased and baf_seg."""

    def calm(v: np.ndarray) -> np.ndarray:
        m = kernels.running_median(v, 25)
        s = 2.5 * 1.4826 * np.median(np.abs(v - m))
        return np.clip(v, m - s, m + s)

    def work(pos: np.ndarray, baf: np.ndarray) -> list[np.ndarray]:
        x = baf.reshape(-1, int(np.searchsorted(pos, pos[0], "right")))  # a locus's samples follow each other
        columns = range(x.shape[1])
        sds = [max(np.nan_to_num(kernels.robust_sd(np.minimum(x[:, j], 1 - x[:, j]))), kernels.FLOOR_SD) for j in columns]
        if len(x) < kernels.FEW:
            phased, ends = np.where(x.mean(axis=0) > 0.5, x, 1 - x), np.array([len(x)])
        else:
            first = kernels.pcf_fast_ends(np.column_stack([calm(x[:, j]) for j in columns]), 3, float(np.mean(sds)))
            phased = np.column_stack([np.where(kernels.fitted(x[:, j], first) > 0.5, x[:, j], 1 - x[:, j]) for j in columns])
            ends = kernels.pcf_fast_ends(np.column_stack([calm(phased[:, j]) for j in columns]), 3, gamma * float(np.mean(sds)))
        return [phased.ravel(), np.column_stack([_levels(phased[:, j], ends, baf_option) for j in columns]).ravel()]

    samples = df.groupBy(patient, "chrom").agg(F.count_distinct("sample_id").alias("_of"))
    known = df.filter("baf is not null")
    has = known.withColumn("_has", F.count("*").over(Window.partitionBy("pos", "chrom", patient)))
    common = has.join(samples, [patient, "chrom"]).filter("_has = _of").select(*df.columns)
    pieces = presegment(common, breakpoints)
    return _grouped(pieces, [patient, "chrom", "piece"], ["pos", "baf"], [("baf_phased", T.DoubleType()), ("baf_seg", T.DoubleType())], work, ("pos", "sample_id")).drop("piece")


def segment_logr(df: DataFrame, value: str, gamma: float, kmin: int, by_arm: bool = True, out: str = "fit") -> DataFrame:
    """Adds fit: one track by chromosome arm (column arm), with gamma times the track's squared deviation as the penalty."""

    def work(x: np.ndarray) -> list[np.ndarray]:
        x = x.astype(float)
        sd = kernels.robust_sd(x)
        ends = kernels.pcf_fast_ends(x, kmin, gamma * (sd * sd if sd and not np.isnan(sd) else 1e-12))
        return [kernels.fitted(x, ends)]

    return _grouped(df.filter(F.col(value).isNotNull()), [*KEYS, "arm"] if by_arm else list(KEYS), [value], [(out, T.DoubleType())], work)
