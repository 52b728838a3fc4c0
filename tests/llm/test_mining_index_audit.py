"""Hard negatives, the positional index and the source audit against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from acn.llm import hard_negatives, positional_index, source_audit
from acn.llm.word_arrays import LETTER_WORDS, texts_of, word_arrays

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def letters(text):
    return [w.translate(LOWER) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def test_words_of_arrays():
    import pyarrow as pa

    rng = random.Random(3)
    texts = [None, "", " ", "a", "Éa-B", "x1y_2", *("".join(rng.choice("aZ9 -é\n中\x7f\x00") for _ in range(rng.randrange(30))) for _ in range(300))]
    for low, high in ((0, len(texts)), (5, 200), (3, 3)):
        column = pa.array(texts).slice(low, high - low)
        for of, plain in ((None, alnum), (LETTER_WORDS, letters)):
            words, counts = word_arrays(texts_of(column)) if of is None else word_arrays(texts_of(column), of)
            assert words.to_pylist() == [w for t in texts[low:high] for w in plain(t)]
            assert counts.tolist() == [len(plain(t)) for t in texts[low:high]]


# hard negatives


def vectors(n, d, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, d))
    rows = []
    for i in range(n):
        v = (centres[i % 6] + 0.8 * rng.standard_normal(d)).tolist()
        rows.append((i, v, i % 6))
    rows += [(1000 + i, rows[7][1], 1 + i % 2) for i in range(40)]  # one vector in many rows of two labels
    rows += [(5, rows[5][1], 5), (None, rows[3][1], 4), (2000, None, 1), (2001, [None] * d, 1), (2002, [float("nan")] * d, 1), (2003, [1.0] * (d - 1) + [float("inf")], 1)]
    rows += [(2004, rows[4][1], None), (2005, [], 2), (2006, [0.0] * d, 2), (2007, [0.5] * 3, 3), (-20, rows[9][1], 0)]
    return [(i, v, label, "own") for i, v, label in rows]


def mined(rows, every, d):
    fit = [(uid, i, label, [math.floor(256 * x) for x in v] + [0] * (d - len(v))) for uid, (i, v, label, _) in enumerate(rows) if v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for uid, i, label, v in fit:
        if i is None or i % every:
            continue
        scored = [(sum(a * b for a, b in zip(v, w, strict=True)), j, other == label) for u, j, other, w in fit if u != uid]
        for p, positive, _ in sorted((x for x in scored if x[2]), key=order)[:5]:
            good = sorted((x for x in scored if not x[2] and 30 * p <= 100 * x[0] <= 90 * p), key=order)[:10]
            out += [(i, positive, k + 1, j, p, s) for k, (s, j, _) in enumerate(good)]
    return sorted(out, key=str)


@pytest.mark.parametrize("d,anchors", [(64, 8192), (70, 5), (1, 8192)])
def test_hard_negatives(spark, monkeypatch, d, anchors):
    from pyspark.sql import functions as F

    monkeypatch.setattr(hard_negatives, "ROWS", 64)
    rows = vectors(300, d, d)
    if d < 3:
        rows = [r for r in rows if r[1] is None or len(r[1]) <= d]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, uid string").repartition(3)
    codes = hard_negatives.build_codes(df)
    got = hard_negatives.mine(codes, F.col("vec_id") % 10 == 0, anchors=anchors)
    assert sorted(map(tuple, got.collect()), key=str) == mined(rows, 10, d)
    assert hard_negatives.mine(hard_negatives.build_codes(df.limit(0)), F.col("vec_id") % 10 == 0).count() == 0


def test_intervals_hold_the_score(spark):
    rows = vectors(200, 64, 9)[:200]
    side = hard_negatives._Side(hard_negatives.build_codes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, x string")).toArrow())
    low, high = hard_negatives.Queries(side, 11).intervals(slice(0, 200), side)
    exact = side.vector @ side.vector.T
    assert (low <= exact).all() and (exact <= high).all()
    assert (high < exact.max(axis=1)[:, None]).mean() > 0.1  # and they tell some pairs apart


# decontamination


def leaked():
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randint(11, 40))) for i in range(12)] + [(20, "Short One"), (21, "a"), (22, None), (23, " - "), (24, "b b b b b b b b b b b b"), (None, "no id here"), (3, text(15)), (25, text(1300))]
    docs = [None, "", "--", "short, one", "short-two one", "b " * 30, "no  ID; here", items[-1][1][40:3000]]
    for _ in range(40):
        words = text(rng.randint(5, 60)).split()
        for _ in range(rng.randrange(3)):
            part = rng.choice([t for _, t in items if t]).split()
            at = rng.randrange(len(part))
            words += part[at : at + rng.randint(5, 30)] + text(3).split()
        docs.append((", " if rng.random() < 0.5 else " ").join(words).upper())
    docs += [docs[9], docs[9], text(6000) + " " + items[0][1] + " " + text(2000)]
    return [(None if i == 10 else i // 2, t, "n", -1) for i, t in enumerate(docs)], items


def hit_words(docs, items, n=10):
    windows = defaultdict(set)
    for item, t in items:
        w = alnum(t)
        for at in range(len(w) - min(n, len(w)) + 1 if w else 0):
            windows[tuple(w[at : at + min(n, len(w))])].add("" if item is None else str(item))
    out = []
    for i, t, *_ in docs:
        w, hit, own = alnum(t), set(), set()
        for size in {len(x) for x in windows}:
            for at in range(len(w) - size + 1):
                if (x := tuple(w[at : at + size])) in windows:
                    hit |= set(range(at, at + size))
                    own |= windows[x]
        out.append((i, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("segment,piece,block", [(8 << 20, 512, 2_000_000), (700, 16, 100)])
def test_decontamination(spark, monkeypatch, segment, piece, block):
    monkeypatch.setattr(positional_index, "PIECE", piece)
    monkeypatch.setattr(positional_index, "BLOCK_WORDS", block)
    docs, items = leaked()
    index = positional_index.build_index(spark.createDataFrame(docs, "doc_id long, text string, term string, n int").repartition(2), segment)
    test = spark.createDataFrame([(*x, "z") for x in items], "item_id int, text string, size string")
    got = positional_index.contamination(index, positional_index.phrase_matches(index, test))
    assert sorted(map(tuple, got.collect()), key=str) == hit_words(docs, items)
    none = positional_index.contamination(index, positional_index.phrase_matches(index, test.limit(0)))
    assert none.filter("contaminated or n_hit > 0 or n_items > 0").count() == 0 and none.count() == len(docs)
    empty = positional_index.build_index(spark.createDataFrame([], "doc_id long, text string"))
    assert positional_index.contamination(empty, positional_index.phrase_matches(empty, test)).count() == 0


def test_near_matches(spark):
    docs, items = leaked()
    docs, items = [(i, t) for i, (_, t, *_) in enumerate(docs[:40])], [x for x in items[:14] if x[0] is not None]
    index = positional_index.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(2), 900)
    found = positional_index.near_matches(index, spark.createDataFrame(items, "item_id long, text string"), n=4, within=9)
    ids = index.filter("ordinal is not null").select("segment", "ordinal", "doc_id")
    got = {(r["doc_id"], r["item_id"]): (r["n_places"], r["shortest"], r["at"]) for r in found.join(ids, ["segment", "ordinal"]).collect()}
    want = {}
    for i, t in docs:
        w = alnum(t)
        for item, text in items:
            x, places = alnum(text), {}
            for window in {frozenset(x[at : at + min(4, len(x))]) for at in range(len(x) - min(4, len(x)) + 1)}:
                for at in range(len(w)):
                    if w[at] in window:
                        length = next((n for n in range(1, 10) if window <= set(w[at : at + n]) and at + n <= len(w)), None)
                        if length:
                            places[at] = min(places.get(at, 99), length)
            if places:
                shortest = min(places.values())
                want[i, str(item)] = (len(places), shortest, min(a for a, n in places.items() if n == shortest))
    assert got == want and len(want) > 10


def test_gaps_pack_and_unpack():
    x = np.array([0, 1, 127, 128, 16383, 16384, 2097151, 2097152, 1 << 31, 5])
    data, sizes = positional_index.pack_gaps(x)
    assert positional_index.unpack_gaps(data).tolist() == x.tolist() and sizes.tolist() == [1, 1, 1, 2, 2, 3, 3, 4, 5, 1]


# source audit


def sourced():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 3))) for _ in range(50)]
    docs = [(None, None, None), (None, "xx", "s"), ("", "xx", "s"), ("1 2 3", "lone", "only"), ("Ab aB", "", "")]
    for i in range(400):
        source = "hot" if i % 3 == 0 else f"s{i % 5}" if i % 7 else None
        docs.append((" ".join(rng.choice(words[: 20 + 6 * (i % 5)]) for _ in range(rng.randint(0, 30))).title() + "-x9y", "xx" if i % 4 else None, source))
    return [(i, t, lang, s, i, "c") for i, (t, lang, s) in enumerate(docs)] + [(0, *docs[40], 0, "c")]


def audited(rows, least):
    docs = [(t or "", lang or "", s or "") for _, t, lang, s, *_ in rows]
    out = []
    for lang in {x[1] for x in docs}:
        seen, counts = Counter(), defaultdict(Counter)
        for t, _, s in (x for x in docs if x[1] == lang):
            seen.update(set(letters(t)))
            counts[s].update(letters(t))
        kept = [t for t, n in seen.items() if n >= least]
        p = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for t in kept}
        whole, ps = p(sum(counts.values(), Counter())), {s: p(c) for s, c in counts.items()}
        for s, own in ps.items():
            pairs = sorted((-sum(abs(own[t] - ps[o][t]) for t in kept), o.encode(), o) for o in ps if o != s)
            terms = sorted((whole[t] - own[t], t.encode(), t) for t in kept if counts[s][t] and own[t] > whole[t])[:50]
            out += [(lang, s, part, item, -f, i + 1) for part, found in (("pair", pairs), ("term", terms)) for i, (f, _, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("nodes,held", [(200_000, 1_000_000), (30, 20)])
def test_source_audit(spark, monkeypatch, nodes, held):
    monkeypatch.setattr(source_audit, "NODES", nodes)
    monkeypatch.setattr(source_audit, "HELD", held)
    rows = sourced()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, count int, term string").repartition(3)
    got = source_audit.audit(df)
    assert sorted(map(tuple, got.collect())) == audited(rows, 30)
    assert source_audit.audit(df.limit(0)).count() == 0


def test_tree_shares_paths_and_sums_pairs_once():
    tree = source_audit.PatternTree()
    rows = [([(0, 10, 2), (1, 7, 3), (2, 9, 1)], 4), ([(0, 10, 2), (1, 7, 3)], 2), ([(0, 10, 2), (2, 5, 1)], 1), ([(1, 7, 3)], 8)]
    for row, times in rows:
        tree.insert(row, times)
    assert len(tree.parent) == 5 and tree.number[:2] == [7, 6]
    want = Counter()
    for row, times in rows:
        for i, (a, pa, za) in enumerate(row):
            for b, pb, zb in row[i + 1 :]:
                want[a * 3 + b] += times * (abs(pa - pb) - abs(pa - zb) - abs(za - pb) + abs(za - zb))
    keys, sums = tree.pair_sums(3)
    assert {k: v for k, v in zip(keys.tolist(), sums.tolist(), strict=True)} == dict(want)
