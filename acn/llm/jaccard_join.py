"""N-gram Jaccard join with signature trees, and the groups of documents that it links.

Texts are lower-cased in A-Z and cut in words; a document's set holds its distinct k-word shingles as 64-bit hashes (with fewer
words, the whole sequence as one; without words, none). Two documents link when 100 * intersection >= percent * union. Equal
sets are one vertex, under the 64-bit hash of the set, so copies are never compared.

1. Of every set, the shingles are found that stand in another document too (see repeats.py). Only they can be common to two sets,
   so a set goes on only if percent of its shingles are such; their texts are read again.
2. Sets with equal repeated shingles and equal size are one class: they have the same similarity to all others, and with each
   other. So the copies of a template that differ in words of their own are few classes, however many they are.
3. Each class gives its prefix: of s repeated shingles of n, the s - ceil(t * n) + 1 first in an order in which the frequent come
   last; linked classes share one of them. The order is total whatever the list of frequent shingles (MAX_HOT of them at
   most), so the list decides speed, not results.
4. Classes that share a prefix shingle and are near in size meet under the least class among them, their anchor: most of a family's shingles have the same
   anchor, so a pair meets once or a few times, not once for each shingle. Large meetings are cut in bands of size, of
   which linked classes are in the same or in neighbouring ones, and in blocks of bounded weight; each pair of blocks is a
   task row group of its own.
5. Blocks become signature trees: nodes hold OR-combined token bitmaps and ranges of sizes, and a dual traversal drops node pairs
   whose largest possible overlap is too small for a link. The bitmaps number the shingles that two sets of the task share,
   so at the leaves their overlap is the intersection itself and what leaves a task are links, and only those that join
   what wasn't joined in it.
6. Links are joined to components.

Hashes: of two different shingles, sets or classes, a given pair is taken for equal with odds of 1 in 2^64.

Defined results: null text is a text without words; documents without words stay alone; repeated rows share a vertex; rows of
one doc_id with different texts are vertices of their own, and component_id is the least doc_id of all rows in a component; an
empty table gives an empty one; further columns are ignored by link_groups() and kept by keep_one().
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import WHITE, bytes_of, discard, few, fresh_names, materialise, release, slices, table_batch, text_key
from .components import components
from .repeats import DOCUMENTS, PACK, PACK_FIELDS, PACK_TYPES, Chunks, identity, repeated_hashes

CHUNK = 2_000_000  # shingles held at a time while counting
HOT_IN_CHUNK, HOT, MAX_HOT = 8, 64, 200_000
PER_BUCKET = 1_000_000  # shingles
LEAF = 16
BLOCK, BLOCK_SHINGLES = 256, 200_000  # classes, and their shingles, that a block has on average
_U = np.uint64


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Words()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return (h ^ (h >> _U(29))) * _U(0x9FB21C651E98DF25)


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Distinct shingle hashes in ascending order."""
    words = (text or b"").lower().split()
    n = len(words)
    if n == 0:
        return np.empty(0, _U)
    if len(_words) > 250_000:
        _words.clear()
    h = np.fromiter(map(_words.__getitem__, words), _U, n)
    span, start = min(k, n), 0 if n >= k else n
    acc = np.full(n - span + 1, start, _U)
    for j in range(span):
        acc = _mixed(acc + h[j : n - span + 1 + j])
    acc.sort()
    return acc[np.r_[True, acc[1:] != acc[:-1]]]


def least_common(n: int, percent: int) -> int:
    """The common shingles that a set of n needs at least for any link."""
    return -(-percent * n // 100)


def vertex_of(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


_NAMES, _TYPES = ["doc_id", "key", "vertex", "n"], [pa.int64()] * 4
_SCHEMA = T.StructType([*(T.StructField(n, T.LongType()) for n in _NAMES), *PACK_FIELDS])
LAST = (1 << 63) - 1  # for null doc_id


def _shingle_batches(k: int, percent: int, buckets: int):
    """(doc_id, text, key) -> a row per document (vertex null without words), and packs of the shingles of sets not seen before in the task."""
    names, types = [*_NAMES, *PACK], [*_TYPES, *PACK_TYPES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, seen = Chunks(buckets), set()

        def flushed() -> Iterator[pa.RecordBatch]:
            if columns := chunks.packs():
                yield table_batch(names, types, [*[[None] * len(columns[0])] * 4, *columns])

        for batch in slices(batches, 2000):
            rows = []
            for doc_id, text, key in zip(batch.column(0).to_pylist(), bytes_of(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                own = shingle_set(text, k)
                n = len(own)
                vertex = vertex_of(own) if n else None
                rows.append((doc_id, key, vertex, n))
                if n == 0 or vertex in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(vertex)
                if chunks.full(1):
                    yield from flushed()
                chunks.add([LAST if doc_id is None else doc_id], [key], [least_common(n, percent)], own, np.zeros(n, np.int64))
            if rows:
                yield table_batch(names, types, [*zip(*rows, strict=True), *[[None] * len(rows)] * 4])
        yield from flushed()

    return run


def _set_batches(k: int, percent: int, buckets: int):
    """(text, repeated identities) -> (vertex, class, n, tokens: the repeated shingles)."""
    names, types = ["vertex", "class", "n", "tokens"], [pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, size = [], 0
            for text, data in zip(bytes_of(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                own, repeated = shingle_set(text, k), np.frombuffer(data, np.int64)
                here = identity(own, buckets)
                tokens = own[repeated[np.minimum(np.searchsorted(repeated, here), len(repeated) - 1)] == here]
                if len(tokens) < least_common(len(own), percent):
                    continue
                data = tokens.tobytes()
                rows.append((vertex_of(own), xxhash.xxh3_64_intdigest(data, seed=len(own)) - (1 << 63), len(own), data))
                size += len(data)
                if size > 8 << 20:
                    yield table_batch(names, types, list(zip(*rows, strict=True)))
                    rows, size = [], 0
            if rows:
                yield table_batch(names, types, list(zip(*rows, strict=True)))

    return run


def _hot_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tokens) -> (token, n) of those that a chunk holds HOT_IN_CHUNK times or more."""
    held: list[np.ndarray] = []
    size = 0

    def counted() -> pa.RecordBatch:
        tokens, n = np.unique(np.concatenate(held), return_counts=True)
        often = n >= HOT_IN_CHUNK
        return table_batch(["token", "n"], [pa.int64()] * 2, [tokens[often].view(np.int64), n[often]])

    for batch in slices(batches):
        for data in batch.column(0).to_pylist():
            held.append(np.frombuffer(data, _U))
            size += len(held[-1])
            if size > CHUNK:
                yield counted()
                held, size = [], 0
    if held:
        yield counted()


def _band_step(percent: int) -> float:
    """Of the logarithm of the size: the sizes of a link differ by less than one band."""
    return max(math.log(100 / percent) * 1.0001, 1e-4)


def _prefix_batches(percent: int, hot):
    """(class, n, tokens) -> (token, class) of each class's prefix, under the token with the class's band of size, and with the band above:
    classes in the same band or in neighbouring ones have one of the two in common, others don't meet."""
    step = _band_step(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = hot.value
        for batch in slices(batches):
            found, owners = [], []
            for own, n, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                tokens = np.frombuffer(data, _U)
                want = len(tokens) - least_common(n, percent) + 1
                often = frequent[np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)] == tokens if len(frequent) else np.zeros(len(tokens), bool)
                rare = tokens[~often]
                prefix = rare[:want] if len(rare) >= want else np.r_[rare, tokens[often][: want - len(rare)]]
                band = math.floor(math.log(n) / step)
                found += [prefix + _U((band + i) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for i in (0, 1)]
                owners.append(np.full(2 * len(prefix), own, np.int64))
            if found:
                yield table_batch(["token", "class"], [pa.int64()] * 2, [np.concatenate(found).view(np.int64), np.concatenate(owners)])

    return run


class SignatureTree:
    """Sets in order of size; every level joins LEAF nodes of the one below, up to one root."""

    def __init__(self, n: np.ndarray, bits: np.ndarray, height: int = 0):
        self.n, self.bits, self.levels = n, bits, []
        low, high, most, joined = n, n, np.bitwise_count(bits).sum(axis=1, dtype=np.int64), bits
        while len(low) > 1 or len(self.levels) < max(height, 1):
            cut = np.arange(0, len(low), LEAF)
            low, high, most = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(most, cut)
            joined = np.bitwise_or.reduceat(joined, cut, axis=0)
            self.levels.append((low, high, most, joined))

    def rows(self, leaf: int) -> np.ndarray:
        return np.arange(leaf * LEAF, min(leaf * LEAF + LEAF, len(self.n)))

    def nodes(self, depth: int, parents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The children of nodes, each with the place of its parent in the list."""
        first = parents * LEAF
        count = np.minimum(first + LEAF, len(self.levels[depth][0])) - first
        place = np.repeat(np.arange(len(parents)), count)
        return first[place] + np.arange(len(place)) - np.repeat(np.cumsum(count) - count, count), place


def _possible(x: SignatureTree, y: SignatureTree, depth: int, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether the node pairs (i, j) can hold a link, by sizes and by the most that their sets can have in common."""
    low_x, high_x, most_x, joined_x = (a[i] for a in x.levels[depth])
    low_y, high_y, most_y, joined_y = (a[j] for a in y.levels[depth])
    common = np.minimum(np.bitwise_count(joined_x & joined_y).sum(axis=1, dtype=np.int64), np.minimum(most_x, most_y))
    near = (100 * high_x >= percent * low_y) & (100 * high_y >= percent * low_x)
    return near & ((100 + percent) * common >= percent * (low_x + low_y))


def leaf_pairs(x: SignatureTree, y: SignatureTree, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Dual traversal of two trees of one height, level by level; of a tree with itself, each pair once."""
    depth = len(x.levels) - 1
    i = j = np.zeros(1, np.int64)
    while True:
        good = _possible(x, y, depth, i, j, percent)
        i, j = i[good], j[good]
        if depth == 0 or not len(i):
            return i, j
        depth -= 1
        i, place = x.nodes(depth, i)
        j, again = y.nodes(depth, j[place])
        i = i[again]
        if x is y:
            i, j = i[i <= j], j[i <= j]


def spanning_links(x: SignatureTree, y: SignatureTree, percent: int) -> list[tuple[int, int]]:
    """Pairs (i of x, j of y) that link, as few as join all that link."""
    shift = 0 if x is y else len(x.n)
    label, out = np.arange(shift + len(y.n)), []
    for a, b in zip(*(v.tolist() for v in leaf_pairs(x, y, percent)), strict=True):
        i, j = x.rows(a), y.rows(b)
        if (label[i] == label[i[0]]).all() and (label[shift + j] == label[i[0]]).all():
            continue
        common = np.bitwise_count(x.bits[i][:, None, :] & y.bits[j][None, :, :]).sum(axis=2, dtype=np.int64)
        u, v = np.nonzero((100 + percent) * common >= percent * (x.n[i][:, None] + y.n[j][None, :]))
        u, v = i[u], j[v]
        while len(u):
            left = label[u] != label[shift + v]
            u, v = u[left], v[left]
            if len(u):
                out.append((int(u[0]), int(v[0])))
                label[label == label[shift + v[0]]] = label[u[0]]
    return out


def _bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """Bit maps of the tokens that two of the sets hold or more: the overlap of two maps is what the sets have in common."""
    tokens, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    width = max(-(-int((count > 1).sum()) // 64), 1) * 64
    keep, number = (count > 1)[place], number[place]
    out = np.zeros((len(sets), width // 64), _U)
    ends = np.cumsum([len(x) for x in sets]).tolist()
    for row, a, b in zip(range(len(sets)), [0, *ends], ends, strict=False):
        own = np.zeros(width, np.uint8)
        own[number[a:b][keep[a:b]]] = 1
        out[row] = np.packbits(own).view(_U)
    return out


def _tree_batches(percent: int):
    """Rows (anchor, low, high, side, class, n, tokens), a task's together and its first block before its second -> links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, found = None, [], []

        def closed() -> None:
            if len(rows) < 2:
                return
            rows.sort(key=lambda r: (r[0], r[2], r[1]))
            side, names, n = np.array([r[0] for r in rows]), [r[1] for r in rows], np.array([r[2] for r in rows], np.int64)
            bits = _bitmaps([np.frombuffer(r[3], _U) for r in rows])
            second = int((side == 0).sum())
            if second == len(rows):
                x = y = SignatureTree(n, bits)
            elif second == 0:
                return
            else:
                height = max(1, math.ceil(math.log(max(second, len(rows) - second), LEAF)) + 1)
                x, y = SignatureTree(n[:second], bits[:second], height), SignatureTree(n[second:], bits[second:], height)
            shift = 0 if x is y else second
            found.extend((names[i], names[shift + j]) for i, j in spanning_links(x, y, percent))

        for batch in slices(batches):
            for anchor, low, high, *row in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if (anchor, low, high) != key:
                    closed()
                    key, rows = (anchor, low, high), []
                rows.append(row)
            if len(found) > 50_000:
                yield table_batch(["a", "b"], [pa.int64()] * 2, list(zip(*found, strict=True)))
                found = []
        closed()
        if found:
            yield table_batch(["a", "b"], [pa.int64()] * 2, list(zip(*found, strict=True)))

    return run


def _tasks(meetings: DataFrame, percent: int) -> DataFrame:
    """(anchor, class, n, size) -> (anchor, low, high, side, class): a task for each meeting, or for each pair of blocks of a large one."""
    whole = meetings.groupBy("anchor").agg(F.count("*").alias("classes"), F.sum("size").alias("shingles"))
    large = (F.col("classes") > BLOCK) | (F.col("shingles") > BLOCK_SHINGLES)
    placed = meetings.join(whole, "anchor")
    none = F.lit(0).cast("long")
    small = placed.filter(~large).select("anchor", none.alias("low"), none.alias("high"), F.lit(0).alias("side"), "class")
    step = _band_step(percent)
    banded = placed.filter(large).select("anchor", "class", "size", F.floor(F.log(F.col("n").cast("double")) / step).cast("long").alias("band"))
    blocks = banded.groupBy("anchor", "band").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_SHINGLES)).cast("long").alias("blocks"))
    number = lambda band, block: F.shiftleft(F.col(band), 32).bitwiseOR(block)
    own = banded.join(blocks, ["anchor", "band"]).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")))
    other = F.explode(F.sequence(none, F.col("blocks") - 1)).alias("other")
    inside = own.select("anchor", "class", "band", "block", other).select(
        "anchor", number("band", F.least("block", "other")).alias("low"), number("band", F.greatest("block", "other")).alias("high"), (F.col("block") > F.col("other")).cast("int").alias("side"), "class",
    )
    next_ = blocks.select("anchor", (F.col("band") - 1).alias("band"), F.col("blocks").alias("others"))  # meets the band below
    last = blocks.select("anchor", (F.col("band") + 1).alias("band"), F.col("blocks").alias("others"))
    of = lambda d: own.join(d, ["anchor", "band"]).select("anchor", "class", "band", "block", F.explode(F.sequence(none, F.col("others") - 1)).alias("other"))
    up = of(next_).select("anchor", number("band", F.col("block")).alias("low"), F.shiftleft(F.col("band") + 1, 32).bitwiseOR(F.col("other")).alias("high"), F.lit(0).alias("side"), "class")
    down = of(last).select("anchor", F.shiftleft(F.col("band") - 1, 32).bitwiseOR(F.col("other")).alias("low"), number("band", F.col("block")).alias("high"), F.lit(1).alias("side"), "class")
    return small.union(inside).union(up).union(down)


def _rooted(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, key (text_key), n (shingles) and root (of the component; null without words), one row per input row."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key("text").alias("key"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(64, size // 6 // PER_BUCKET)
    scanned = texts.mapInArrow(_shingle_batches(k, percent, buckets), _SCHEMA)
    members, wanted = repeated_hashes(scanned, [(n, T.LongType(), pa.int64()) for n in _NAMES], "shingles")
    release(spark)
    own = texts.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), "key", "text")
    chosen = few(wanted.select("doc_id", "key").distinct())
    again = own.join(chosen, ["doc_id", "key"], "left_semi").dropDuplicates(["doc_id", "key"]).join(wanted.dropDuplicates(["doc_id", "key"]), ["doc_id", "key"]).select("text", "hashes")
    sets = materialise(again.mapInArrow(_set_batches(k, percent, buckets), "vertex long, class long, n long, tokens binary"), "shingle-sets")
    discard(wanted)
    vertices = materialise(sets.select("vertex", "class").distinct(), "shingle-vertices")
    classes = materialise(sets.groupBy("class").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens")), "shingle-classes")
    discard(sets)
    release(spark)
    frequent = (
        classes.select("tokens").mapInArrow(_hot_batches, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
        .filter(F.col("n") >= HOT).orderBy(F.desc("n"), "token").limit(MAX_HOT).select("token").toArrow()
    )
    hot = spark.sparkContext.broadcast(np.sort(frequent.column(0).to_numpy().astype(np.int64).view(_U)))  # MAX_HOT numbers at most
    postings = materialise(classes.select("class", "n", "tokens").mapInArrow(_prefix_batches(percent, hot), "token long, class long"), "shingle-postings")
    anchors = postings.groupBy("token").agg(F.min("class").alias("anchor"), F.count("*").alias("meet")).filter("meet > 1")
    met = postings.join(anchors.select("token", "anchor"), "token").select("anchor", "class").distinct()
    sizes = classes.select("class", "n", F.shiftright(F.octet_length("tokens"), 3).alias("size"))
    meetings = materialise(met.join(sizes, "class"), "shingle-meetings")
    rows = _tasks(meetings, percent).join(classes, "class").select("anchor", "low", "high", "side", "class", "n", "tokens")
    dealt = rows.repartition("anchor", "low", "high").sortWithinPartitions("anchor", "low", "high")
    links = materialise(dealt.mapInArrow(_tree_batches(percent), "a long, b long").distinct(), "shingle-links")
    release(spark)
    roots = components(links)
    alike = 100 * F.col("size") >= percent * (2 * F.col("n") - F.col("size"))  # the sets of one class link with each other
    named = sizes.join(roots.withColumnRenamed("vertex", "class"), "class", "left").select("class", F.coalesce("root", F.when(alike, F.col("class"))).alias("root"))
    # a class that is a root has links too, but no row of its own among the roots
    named = named.join(roots.select(F.col("root").alias("class")).distinct().withColumn("is_root", F.lit(True)), "class", "left").select("class", F.coalesce("root", F.when(F.col("is_root"), F.col("class"))).alias("root"))
    of = vertices.join(named.filter("root is not null"), "class").select("vertex", "root")
    return members.join(of, "vertex", "left").select("doc_id", "key", "n", F.coalesce("root", "vertex").alias("root"))


def link_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id, one row per input row."""
    rooted = _rooted(docs, k, percent)
    least = rooted.filter(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(least, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group, that of the least doc_id (null last; then by the text's hash); documents without words all stay."""
    keep_id, keep_key, keep_rows, place = fresh_names(docs, "keep_id", "keep_key", "keep_rows", "place")
    rows = _rooted(docs, k, percent).filter(F.col("root").isNotNull()).groupBy("root", "doc_id", "key").agg(F.count("*").alias("rows"))
    least = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "rows")).alias("x"))
    kept = materialise(least.select(F.col("x.doc_id").alias(keep_id), F.col("x.key").alias(keep_key), F.col("x.rows").alias(keep_rows)), "shingle-kept")
    release(docs.sparkSession)
    wordless = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), WHITE, "") == ""
    joined = docs.filter(~wordless).join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(keep_id)) & (text_key("text") == F.col(keep_key)))
    one = Window.partitionBy(keep_id, keep_key).orderBy(keep_rows)  # rows of equal doc_id and text
    again = joined.filter(F.col(keep_rows) > 1).withColumn(place, F.row_number().over(one)).filter(F.col(place) == 1)
    return docs.filter(wordless).union(joined.filter(F.col(keep_rows) == 1).select(*docs.columns)).union(again.select(*docs.columns))
