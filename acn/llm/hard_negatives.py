"""Hard-negative mining over rotated one-bit codes.

Vectors are whole numbers, floor(scale * x). build_codes() turns each by one seeded rotation and keeps the signs of its components as a code,
with its length |v| and its alignment a: the cosine between the turned vector and its code's own direction c (components +-1/sqrt(D)).
An anchor q, turned alike, is quantised to PLANES bits a component; popcounts of the planes against a code give e, close to <q, c>. As
the unit vector is a c + r, with r orthogonal to c and |r| = sqrt(1 - a^2), Cauchy and Schwarz bound what r adds:
    <q, v> = |v| (a <q, c> +- sqrt(|q|^2 - <q, c>^2) sqrt(1 - a^2)),
and |<q, c> - e| is at most the length of what quantising left out. These intervals are certain, so a pair goes on only if its interval
reaches a score that may still count; pairs that go on are scored in whole numbers. No candidate is lost: results are exact.

Anchors are taken ANCHORS at a time (a bounded table that every task gets) against all vectors, in blocks; each scan task keeps the first k for
each anchor and the tasks' rows meet by anchor. The first pass finds positives, the second the negatives inside the
positives' bands, from the codes that the first one stored.

Defined results: rows with a null label, a null vector or a null or non-finite component take no part; shorter vectors count as filled up with
zeros; null vec_id is no anchor, comes after all others among ties and is returned as null; rows that repeat a vec_id are rows of their own (each
copy of an anchor gives the rows of one); empty tables give empty ones; further columns are ignored. Components up to 2^26 times
sqrt(63 / D) keep scores inside 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import fresh_names, materialise

PLANES = 6
ANCHORS = 8192
TILE = 256  # anchors whose intervals with a block of vectors are held at once
ROWS = 4096
GATHERED = 1 << 16  # pairs scored at once

CODES = "uid long, vec_id long, label long, vector binary, code binary, length double, align double"
_CODE_NAMES = ["uid", "vec_id", "label", "vector", "code", "length", "align"]
_CODE_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
FAR = np.iinfo(np.int64).max


def rotation(d: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix, the same for one d and seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _padded(vectors: list[list[float]], d: int) -> np.ndarray:
    out = np.zeros((len(vectors), d))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def sign_codes(turned: np.ndarray) -> np.ndarray:
    """Signs as rows of 64-bit words; the bits beyond the dimension are 0."""
    bits = np.packbits(turned >= 0, axis=1, bitorder="little")
    words = -(-turned.shape[1] // 64) * 8
    return np.ascontiguousarray(np.pad(bits, ((0, 0), (0, words - bits.shape[1])))).view("<u8")


def _code_batches(d: int, scale: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, uid = rotation(d, seed), TaskContext.get().partitionId() << 40
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                part = batch.slice(low, ROWS)
                whole = np.floor(scale * _padded(part.column(2).to_pylist(), d)).astype(np.int64)
                length = np.sqrt((whole.astype(float) ** 2).sum(axis=1))
                turned = whole @ turn
                codes = sign_codes(turned)
                align = np.abs(turned).sum(axis=1) / np.sqrt(d) / np.where(length > 0, length, 1)
                rows = [pa.array(np.arange(uid, uid + len(whole))), part.column(0), part.column(1), *(pa.array([x.tobytes() for x in y], pa.binary()) for y in (whole, codes)), pa.array(length), pa.array(align)]
                uid += len(whole)
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(rows, _CODE_TYPES, strict=True)], _CODE_NAMES)

    return run


def build_codes(embeddings: DataFrame, scale: float = 256.0, label: Column | None = None, seed: int = 11) -> DataFrame:
    """CODES of embeddings (vec_id, embedding, label), written to the shared folder. label: used in place of the column."""
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.filter(F.col("label").isNotNull() & finite).select(F.col("vec_id").cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"), vector.alias("vector"))
    d = max(1, rows.select(F.max(F.size("vector"))).first()[0] or 1)
    return materialise(rows.mapInArrow(_code_batches(d, scale, seed), CODES), "vector-codes", "zstd")


class _Side:
    """Rows of codes as arrays."""

    def __init__(self, table: pa.RecordBatch | pa.Table):
        column = lambda c: table.column(c).combine_chunks() if isinstance(table, pa.Table) else table.column(table.schema.names.index(c))
        n = table.num_rows
        self.uid, self.label, self.length, self.align = (column(c).to_numpy(zero_copy_only=False) for c in ("uid", "label", "length", "align"))
        self.unknown = column("vec_id").is_null().to_numpy(zero_copy_only=False)
        self.vec_id = column("vec_id").fill_null(FAR).to_numpy(zero_copy_only=False)
        self.vector = np.frombuffer(b"".join(column("vector").to_pylist()), np.int64).reshape(n, -1)
        self.code = np.frombuffer(b"".join(column("code").to_pylist()), "<u8").reshape(n, -1)


class Queries:
    """Anchors with their planes: turned component i is about low + step * (the number whose bits the planes hold at i)."""

    def __init__(self, side: _Side, seed: int):
        self.side, d = side, side.vector.shape[1]
        turned = side.vector @ rotation(d, seed)
        self.low = turned.min(axis=1)
        self.step = np.maximum((turned.max(axis=1) - self.low) / ((1 << PLANES) - 1), 1e-9)
        level = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        self.planes = np.stack([sign_codes(np.where(level >> j & 1, 1.0, -1.0)) for j in range(PLANES)])
        self.sum = level.sum(axis=1)
        self.error = np.sqrt(((turned - self.low[:, None] - self.step[:, None] * level) ** 2).sum(axis=1))

    def intervals(self, some: slice, rows: _Side) -> tuple[np.ndarray, np.ndarray]:
        """Certain bounds of the scores of some anchors with all rows."""
        d = rows.vector.shape[1]
        ones = np.bitwise_count(rows.code).sum(axis=1, dtype=np.int64)
        shared = np.zeros((len(self.low[some]), len(ones)), np.int64)
        for j in range(PLANES):
            for w in range(rows.code.shape[1]):
                shared += np.bitwise_count(self.planes[j, some, None, w] & rows.code[None, :, w]).astype(np.int64) << j
        col = lambda x: x[some, None]
        e = (col(self.low) * (2 * ones - d) + col(self.step) * (2 * shared - col(self.sum))) / np.sqrt(d)
        reach = np.maximum(np.abs(e) - col(self.error), 0)
        rest = np.sqrt(np.maximum(col(self.side.length) ** 2 - reach**2, 0)) * np.sqrt(np.maximum(1 - rows.align**2, 0))
        width = rows.length * (rest + rows.align * col(self.error)) + 1e-9 * col(self.side.length) * rows.length + 1e-6
        middle = rows.length * rows.align * e
        return middle - width, middle + width

    def scores(self, which: np.ndarray, rows: _Side, row: np.ndarray) -> np.ndarray:
        out = np.zeros(len(which), np.int64)
        for low in range(0, len(which), GATHERED):
            some = slice(low, low + GATHERED)
            out[some] = (self.side.vector[which[some]] * rows.vector[row[some]]).sum(axis=1)
        return out


class Best:
    """The first k of each list: highest score, then smallest vec_id (null last)."""

    def __init__(self, lists: int, k: int):
        self.k, self.n = k, lists
        self.list, self.score, self.vec_id, self.unknown = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))
        self.least = np.full(lists, -np.inf)  # scores below it can't enter any more

    def add(self, which: np.ndarray, score: np.ndarray, vec_id: np.ndarray, unknown: np.ndarray) -> None:
        if not len(which):
            return
        c = [np.r_[a, b] for a, b in ((self.list, which), (self.score, score), (self.vec_id, vec_id), (self.unknown, unknown))]
        order = np.lexsort((c[2], c[3], -c[1], c[0]))
        c = [x[order] for x in c]
        head = np.r_[True, c[0][1:] != c[0][:-1]]
        place = np.arange(len(head)) - np.flatnonzero(head)[np.cumsum(head) - 1]
        self.list, self.score, self.vec_id, self.unknown = (x[place < self.k] for x in c)
        full = place == self.k - 1
        self.least[c[0][full]] = c[1][full]


def _candidates(q: Queries, rows: _Side, best: Best, same: bool, low: np.ndarray, high: np.ndarray) -> None:
    """Adds to best what the rows hold for its lists; lists a * m .. a * m + m - 1 are anchor a's, with scores from low to high (as wholes)."""
    m = len(low) // len(q.low)
    for at in range(0, len(q.low), TILE):
        some = slice(at, at + TILE)
        lower, upper = q.intervals(some, rows)
        fits = (q.side.label[some, None] == rows.label) == same
        if same:
            fits &= q.side.uid[some, None] != rows.uid
        own = slice(at * m, at * m + len(lower) * m)
        floor, roof = np.maximum(low[own], best.least[own]).reshape(-1, m), high[own].reshape(-1, m)
        live = np.zeros_like(fits)
        for j in range(m):
            live |= (upper >= floor[:, j, None]) & (lower <= roof[:, j, None])
        which, row = np.nonzero(live & fits)
        # those of highest interval first: they raise what the others have to reach
        first = upper[which, row] >= np.partition(np.where(fits, upper, -np.inf), -min(4 * best.k, upper.shape[1]), axis=1)[:, -min(4 * best.k, upper.shape[1])][which]
        for part in (first, ~first):
            a, r = which[part], row[part]
            if part is not first:
                floor = np.maximum(low[own], best.least[own]).reshape(-1, m)
                still = ((upper[a, r][:, None] >= floor[a]) & (lower[a, r][:, None] <= roof[a])).any(axis=1)
                a, r = a[still], r[still]
            score = q.scores(a + at, rows, r)
            for j in range(m):
                lists = (a + at) * m + j
                good = (score >= np.maximum(low[lists], best.least[lists])) & (score <= high[lists])
                best.add(lists[good], score[good], rows.vec_id[r[good]], rows.unknown[r[good]])


def _mine(codes: DataFrame, anchors: pa.Table, same: bool, k: int, bands: tuple[np.ndarray, np.ndarray], seed: int) -> DataFrame:
    """anchor (its uid), list, score, vec_id: the first k of each task for each anchor and list."""
    spark = codes.sparkSession
    sent = spark.sparkContext.broadcast((anchors, *bands))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, low, high = sent.value
        q = Queries(_Side(anchors), seed)
        m = len(low) // len(q.low)
        best = Best(len(low), k)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                _candidates(q, _Side(batch.slice(at, ROWS)), best, same, low, high)
        if len(best.list):
            ids = pa.array(best.vec_id, pa.int64(), mask=best.unknown)
            yield pa.RecordBatch.from_arrays([pa.array(q.side.uid[best.list // m]), pa.array((best.list % m).astype(np.int32)), pa.array(best.score), ids], ["anchor", "list", "score", "vec_id"])

    found = codes.mapInArrow(run, "anchor long, list int, score long, vec_id long")
    order = Window.partitionBy("anchor", "list").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return materialise(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "mined")


def _every(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for x in tables[1:]:
        out = out.unionByName(x)
    return out


def mine(codes: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, anchors: int = ANCHORS, seed: int = 11) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. is_anchor: of vec_id. For each anchor and each of its first
    `positives` rows of its label, the first `negatives` rows of other labels with least * positive <= 100 * negative <= most * positive."""
    found = codes.filter(is_anchor & F.col("vec_id").isNotNull())
    n = found.count()
    turns = max(1, -(-n // anchors))
    out = []
    for turn in range(turns if n else 0):
        some = found.filter(F.pmod(F.xxhash64("uid"), F.lit(turns)) == turn).toArrow() if turns > 1 else found.toArrow()
        for at in range(0, some.num_rows, anchors):
            out.append(_turn(codes, some.slice(at, anchors), positives, negatives, least, most, seed))
    return _every(out) if out else codes.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def _turn(codes: DataFrame, anchors: pa.Table, positives: int, negatives: int, least: int, most: int, seed: int) -> DataFrame:
    n = anchors.num_rows
    near = _mine(codes, anchors, True, positives, (np.full(n, -np.inf), np.full(n, np.inf)), seed)
    # at most `positives` rows an anchor
    score = np.full((n, positives), -1, np.int64)
    place = {u: i for i, u in enumerate(anchors.column("uid").to_pylist())}
    for r in near.select("anchor", "rank", "score").toArrow().to_pylist():
        score[place[r["anchor"]], r["rank"] - 1] = r["score"]
    flat = score.reshape(-1)
    # whole scores s with least * p <= 100 s <= most * p; none where p is below 0 or there is no such positive
    low, high = np.where(flat < 0, np.inf, -(-least * flat // 100)), np.where(flat < 0, -np.inf, most * flat // 100)
    far = _mine(codes, anchors, False, negatives, (low, high), seed)
    pos = near.select("anchor", (F.col("rank") - 1).alias("list"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    own, anchor = codes.select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id")), ["anchor", "list"]
    return far.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(pos, anchor).join(own, "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )


ORACLE = """
with e as (select row_number() over () uid, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end l,
                  list_transform(embedding, lambda x: floor(256 * cast(x as double))) v from embeddings
           where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.uid, a.vec_id anchor_id, b.vec_id other, a.l = b.l same, cast(list_inner_product(a.v, b.v) as bigint) s
      from e a join e b on a.uid != b.uid where a.vec_id % 100 = 0),
p as (select * from (select *, row_number() over (partition by uid order by s desc, other) k from s where same) where k <= 5),
n as (select p.anchor_id, p.other positive_id, s.other negative_id, p.s positive_score, s.s negative_score,
             cast(row_number() over (partition by p.uid, p.k order by s.s desc, s.other) as integer) as rank
      from p join s on p.uid = s.uid and not s.same and 30 * p.s <= 100 * s.s and 100 * s.s <= 90 * p.s)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 10
"""
