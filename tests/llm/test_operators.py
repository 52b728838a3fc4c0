"""Each corpus operator against brute force on a small table with nulls, empty and long texts, ties, repeated rows and extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from acn.llm import exact_dedup, jaccard_join, line_dedup, mixing, packing, quality_rules, sentence_spans, suffix_dedup, token_store, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long"


def corpus():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzäöü") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    sentence = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(6, 14))).capitalize() + ". "
    text = lambda n: "".join(sentence() + ("\n" if rng.random() < 0.2 else "") for _ in range(n))
    passage = text(9)
    out = [None, "", "  \n\t ", "one", "two words", "\x0b\x0c", "é" * 60, "x" * 3000, "aaa " * 200]
    out += [text(rng.randint(3, 12)) for _ in range(25)]
    out += [out[12], out[12] + " ", out[12].replace(" ", "\n", 3), out[13]]
    for i in range(14, 22):
        edited = out[i].split(" ")
        edited[rng.randrange(len(edited))] = "changed"
        out.append(" ".join(edited))
    out += [text(3) + passage + text(3) for _ in range(5)] + [text(400)]
    rows = [(i * 3 % 101, t, "en", None if i % 11 == 0 else f"src{i % 4}", i, -1) for i, t in enumerate(out)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_packing_boundaries_are_optimal():
    import itertools

    h = {3: 5, 4: 1, 7: 8, 9: 2, 15: 4, 16: 1}
    cost = lambda ends: sum(c * (min(e for e in ends if e >= n) - n) for n, c in h.items())
    for b in (1, 2, 3, 4, 9):
        best = min(cost([*cut, 16]) for k in range(b) for cut in itertools.combinations([3, 4, 7, 9, 15], min(k, 5)))
        got = packing.optimal_boundaries(h, b)
        assert len(got) <= b and cost(got) == best


def test_packing_keeps_every_word(docs, empty):
    got = packing.pack(docs, max_length=50, buckets=4, token_budget=200).collect()
    total = Counter()
    for r in got:
        total[r["doc_id"]] += r["n_tokens"]
    assert all(total[i] == len(words(t)) for i, t, *_ in corpus())
    fill = Counter((r["bucket"], r["batch"]) for r in got if r["bucket"])
    assert all(n <= 200 // b for (b, _), n in fill.items())
    assert all(r["slot"] < 200 // r["bucket"] and r["n_tokens"] <= r["bucket"] for r in got if r["bucket"])
    assert packing.pack(empty).count() == 0


def test_mixing(docs, empty):
    rows = mixing.decide(docs).collect()
    size = defaultdict(int)
    for _, t, _, s, *_ in corpus():
        size[s] += len(words(t))
    order = sorted(x for x in size if x) + [None]
    weight = {s: i % 3 + 1.0 for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(size.values()))
    while True:  # clamp and share again
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * size[s]}
        if not over:
            target |= share
            break
        target |= {s: 3.0 * size[s] for s in over}
        left -= sum(target[s] for s in over)
        free -= over
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["repeats"] <= 3
        taken[r["source"]] += r["size"] * r["repeats"] * r["copies"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in order)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["repeats"] * r["copies"] for r in rows)
    assert mixing.mix(empty).count() == 0


def linked(rows, k, percent):
    sets, parent = {}, {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
        parent[i] = i

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_jaccard_join(docs, k, percent):
    got = {r[0]: (r[1], r[2]) for r in jaccard_join.link_groups(docs, k, percent).collect()}
    assert got == linked(corpus(), k, percent)


def test_jaccard_join_keeps_one(docs, empty):
    want = linked(corpus(), 5, 80)
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if i == c)
    assert jaccard_join.keep_one(empty).count() == 0


def test_trie_spills_and_finds():
    trie = exact_dedup.RadixTrie()
    keys = [b"", b"a", b"ab", b"abc", b"abd", b"b", b"abcdef"]
    for n, x in enumerate(keys):
        trie.at(x).value = n
    held = dict(trie.terminals(trie.root))
    assert held == {x: n for n, x in enumerate(keys)}
    gone = dict(trie.spill())
    assert set(gone) == {x for x in keys if x.startswith(b"a")} and set(dict(trie.terminals(trie.root))) == {b"", b"b"}


def test_exact_dedup(spark, docs, empty):
    groups = defaultdict(list)
    for i, t, *_ in corpus():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    want = {}
    for norm, members in groups.items():
        for _, i in members:
            want[i] = (min(members)[1], len(members), i == min(members)[1], hashlib.sha256(norm.encode()).hexdigest())
    assert {r[0]: tuple(r)[1:] for r in exact_dedup.owners(docs).collect()} == want
    twice = docs.union(docs)
    assert sorted(r["doc_id"] for r in exact_dedup.keep_first(twice).collect()) == sorted(i for i, w in want.items() if w[2])
    assert exact_dedup.owners(empty).count() == 0


def test_line_dedup(docs, empty):
    lines = []
    for i, t, *_ in sorted(corpus(), key=lambda r: r[0]):
        for n, line in enumerate((t or "").split("\n") if t is not None else []):
            s = {w for w in re.split("[ \t\x0b\f\r]+", line.lower()) if w}
            if len(s) >= 5:
                lines.append((i, n, s))
    want = defaultdict(list)
    for at, (i, n, s) in enumerate(lines):
        if any(100 * len(s & o) >= 80 * len(s | o) for _, _, o in lines[:at]):
            want[i].append(n)
    got = {r["doc_id"]: list(r["removed"]) for r in line_dedup.removal_report(docs).collect()}
    assert got == {i: want[i] for i, *_ in corpus()}
    left = {r["doc_id"]: r["text"] for r in line_dedup.remove_lines(docs).collect()}
    assert all((left[i] is None) if t is None else left[i] == "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want[i]) for i, t, *_ in corpus())
    assert line_dedup.removal_report(empty).count() == 0


def test_line_dedup_of_short_lines(spark, tmp_path):
    from acn.llm import queries

    rng = random.Random(8)
    line = lambda: " ".join(rng.sample("abcdefg", rng.randint(0, 6)))
    rows = [(i, "\n".join(line() for _ in range(12))) for i in range(12)] + [(12, None), (13, "Share this page\n\nall rights reserved"), (14, "share THIS page"), (15, "p q r s\nt u v w x"), (16, "p q r s y\nt u v w")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want, seen = {}, []
    for i, t in rows:
        want[i] = []
        for n, x in enumerate((t or "").split("\n")):
            s = set(x.lower().split())
            if s and any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
                want[i].append(n)
            seen.append(s)
    assert want[14] == [0] and want[16] == [0, 1]
    assert {r["doc_id"]: list(r["removed"]) for r in queries.op5_line_dedup(spark, str(tmp_path)).collect()} == want


@pytest.mark.parametrize("hot", [line_dedup.HOT, 4])
def test_line_dedup_against_brute_force_on_near_lines(spark, monkeypatch, hot):
    """Lines of up to 70 words with 0 to 30% of them changed, on both sides of the similarity, and rows that repeat an id or have none."""
    monkeypatch.setattr(line_dedup, "HOT", hot)
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    bases = [rng.sample(words, n) for n in (4, 5, 9, 17, 33, 70)]

    def near(base):
        return " ".join(rng.choice(words) if rng.random() < share else w for w in base) if (share := rng.choice((0, 0.05, 0.1, 0.15, 0.3))) else " ".join(base)

    rows = [(i, "\n".join(near(rng.choice(bases)) for _ in range(8))) for i in range(40)]
    rows += [(5, near(bases[4]) + "\nonly this row has these seven words"), (5, "another text under one id\n" + near(bases[5])), (None, near(bases[3])), (None, "a b c d e f g h")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = sorted((r["id"], r["key"], r["text"]) for r in line_dedup._keyed(df).collect())
    want, seen = [], []
    for i, _, text in keyed:
        gone = []
        for n, line in enumerate(text.split("\n")):
            s = set(line.split())
            if len(s) >= 5 and any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
                gone.append(n)
            if len(s) >= 5:
                seen.append(s)
        want.append((None if i == line_dedup.NO_ID else i, text.count("\n") + 1, gone))
    got = [(r["doc_id"], r["n_lines"], list(r["removed"])) for r in line_dedup.removal_report(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    left = {r["text"] for r in line_dedup.remove_lines(df).filter("doc_id = 5").collect()}
    assert any("only this row has these seven words" in t for t in left) and any("another text under one id" in t for t in left)


def test_sentence_spans(docs, empty):
    got = {r["doc_id"]: r for r in sentence_spans.remove_repeats(docs).collect()}
    spans = defaultdict(list)
    cut = {}
    for i, t, *_ in corpus():
        cut[i] = [x for x in sentence_spans.sentences((t or "").encode()) if x.split()]
        for n in range(len(cut[i]) - 2):
            s = b" ".join(b" ".join(x.lower().split()) for x in cut[i][n : n + 3])
            if len(s.split()) >= 15:
                spans[s].append((i, n))
    gone = defaultdict(set)
    for places in spans.values():
        for i, n in sorted(places)[1:]:
            gone[i].update(range(n, n + 3))
    assert {i: r["n_removed"] for i, r in got.items()} == {i: len(gone[i]) for i, *_ in corpus()}
    assert sum(map(len, gone.values())) > 20
    assert b"".join(sentence_spans.sentences(b"A b. C d!\n\nE")) == b"A b. C d!\n\nE"
    assert sentence_spans.remove_repeats(empty).count() == 0


def test_sentence_spans_of_passages_cut_anywhere(spark, tmp_path):
    from acn.llm import queries

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(9))
    def text(lengths):
        return [w for n in lengths for w in [*(word() for _ in range(n - 1)), word() + "."]]

    rows, want = [], {}
    for i, lengths in enumerate([(70,), (24, 26), (26, 25), (10, 41), (5, 3, 44), (12, 13, 14, 12), (51,), (1, 1, 49), (60, 60), (3, 48, 2), (17, 17, 17)]):
        for n_before, n_after in ((0, 0), (1, 1), (25, 25), (24, 27), (30, 4), (4, 30), (60, 60)):
            whole = text(lengths)
            # passage: a sentence's end, whole sentences and a sentence's beginning
            passage = [*text((n_before,) if n_before else ()), *whole, *(word() for _ in range(n_after))]
            at = 2 * len(want)
            head, tail = [word() for _ in range(20)], [word() for _ in range(9)]
            rows += [(at, " ".join([*text((7,)), *[word() for _ in range(8)], *passage, *tail, word() + ".", *text((6,))])), (at + 1, " ".join([*text((30,)), *head, *passage, *[word() for _ in range(11)]]))]
            inside = len(lengths) + (0 if n_before else -1)
            want[at + 1] = inside if len(passage) >= 51 else None
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["n_removed"] for r in queries.op6_sentence_spans(spark, str(tmp_path)).collect()}
    assert {i: got[i] for i, n in want.items() if n is not None} == {i: n for i, n in want.items() if n is not None}
    assert all(got[i] == 0 for i in got if i % 2 == 0)


def test_warc_round_trip_and_splits(spark, tmp_path):
    pages = [(i, None if i == 3 else f"http://x/{i}", None if i == 2 else ("<p>" + "abé" * (i % 5) * 200 + "\x1f\u008b\x08" * 50) if i % 2 else "short") for i in range(40)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    archives = warc.write_warc(df)
    for split in (64, 1000, 8 << 20):
        got = {r["page_id"]: r for r in warc.full_payloads(warc.read_warc(spark, archives, split)).collect()}
        assert len(got) == 40
        for i, _, html in pages:
            data = (html or "").encode()
            same = [j for j, _, h in pages if h == html]
            revisit = len(data) >= 1000 and i != max(same)
            assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
            assert (got[i]["record_type"], got[i]["refers_to"]) == (("revisit", max(same)) if revisit else ("response", None))
    assert warc.full_payloads(warc.read_warc(spark, warc.write_warc(df.limit(0)))).count() == 0


def test_quality_statistics(docs, empty):
    for r in quality_rules.quality_statistics(docs).collect():
        text = next(t for i, t, *_ in corpus() if i == r["doc_id"]) or ""
        w = words(text)
        seen = Counter(zip(w, w[1:], w[2:], strict=False))
        inside = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in text.split("\n") if words(x)]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(inside))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(inside) > 50 * len(w))
    assert quality_rules.quality_statistics(empty).count() == 0


def test_forest_tells_odd_rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (1000, 3))
    forest = quality_rules.IsolationForest.fit(x)
    odd, plain = forest.score(np.full((5, 3), 8.0)), forest.score(x)
    assert odd.min() > np.quantile(plain, 0.99)
    assert (quality_rules.IsolationForest.fit(x).score(x) == plain).all()


def test_forest_on_labels(spark, docs, empty):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = [(i, " ".join(word() + ("#*$%" if i % 10 == 0 else "") for _ in range(80 + i % 7))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 != 0)) for i in range(0, 400, 3)], "doc_id long, quality int")
    kept = {r["doc_id"] for r in quality_rules.keep_good(df, labels).collect()}
    held_out = [i for i in range(400) if i % 3]
    assert sum((i in kept) == (i % 10 != 0) for i in held_out) >= 0.98 * len(held_out)
    assert quality_rules.keep_good(df, labels.limit(0)).count() == 400
    assert quality_rules.keep_good(empty, labels).count() == 0


def test_suffix_dedup(docs, empty):
    first, want = {}, {}
    rows = sorted((i, (t or "").encode()) for i, t, *_ in corpus())
    for i, b in rows:
        for j in range(len(b) - 49):
            first.setdefault(b[j : j + 50], i)
    for i, b in rows:
        gone = bytearray(len(b))
        for j in range(len(b) - 49):
            if first[b[j : j + 50]] < i:
                gone[j : j + 50] = b"\1" * 50
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        want[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    assert {r[0]: tuple(r)[1:] for r in suffix_dedup.removal_digest(docs).collect()} == want
    assert suffix_dedup.removal_digest(empty).count() == 0


def test_suffix_dedup_passes_long_stretches_without_anchors(spark):
    rng = random.Random(6)
    long = "".join(rng.choice("abcdefgh ") for _ in range(300))
    some = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    none = spark.range(10, 70_010, numPartitions=1).selectExpr("id AS doc_id", "CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'short' END AS text")
    for parts in ([some((1, long)), none, some((80_000, "x" + long))], [none, some((1, long), (80_000, "x" + long))]):
        docs = parts[0]
        for x in parts[1:]:
            docs = docs.union(x)
        got = {r[0]: r[2] for r in suffix_dedup.removal_digest(docs.coalesce(1)).collect()}
        assert len(got) == 70_002 and {i: n for i, n in got.items() if n} == {80_000: 300}


def test_token_store(spark, docs, empty):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    extra = spark.createDataFrame([(200, "a <|endoftext|> b\x01c", "en", "s", 0, 0), (201, "don't STOP... \x1cabc def É İ", "en", "s", 0, 0)], SCHEMA)
    path = P.path("word_bpe_49k.json")
    t, at = Tokenizer.from_file(path), 0
    got = {r[0]: tuple(r)[1:] for r in token_store.store_digest(token_store.read_store(spark, token_store.write_store(docs.union(extra), path))).collect()}
    for i, text in sorted([(r[0], r[1]) for r in corpus()] + [(r[0], r[1]) for r in extra.collect()]):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        assert got[i] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_store.read_store(spark, token_store.write_store(empty, path)).count() == 0


def test_chunks_follow_content():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 40_000, 20_000).astype("<u2")
    y = np.r_[rng.integers(0, 40_000, 777).astype("<u2"), x]
    cut = lambda v: {v[a:b].tobytes() for e in [token_store.chunk_ends(token_store.cut_marks(v), len(v))] for a, b in zip([0, *e], e, strict=False)}
    assert len(cut(x) & cut(y)) > 0.8 * len(cut(x))


def test_pipeline_stages_agree_with_brute_force(spark, tmp_path):
    import corpus_pipeline as p

    base = str(tmp_path)
    rows = [r[:5] for r in corpus()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    left = p.STAGES[0][1](spark, spark.read.parquet(f"{base}/documents.parquet"), base)
    good = {i for i, t, *_ in rows if len(words(t)) >= 50 and t != "aaa " * 200}
    assert {r["doc_id"] for r in left.collect()} == good
    packed = p.run(spark, base).groupBy("doc_id").sum("n_tokens").collect()
    assert {r[0] for r in packed} <= good and len(p.STAGES) == 5


def test_pipeline_keeps_rows_of_null_and_repeated_ids(spark, tmp_path):
    import corpus_pipeline as p
    from acn.llm._shared import materialise

    rng = random.Random(3)
    text = lambda: " ".join("".join(rng.choice("abcdefghijklm") for _ in range(6)) for _ in range(90))
    base, copied = str(tmp_path), "zz " + text()
    rows = [(None, text()) for _ in range(4)] + [(None, "too short"), (None, None)]
    rows += [(7, text()), (7, "short as well"), (8, text()), (8, text()), (8, text())]
    rows += [(1, copied), (9, "aa" + copied[2:]), (9, "mm " + text()), (10, copied + " end"), (None, copied + " other end")]
    rows += [(11, rows[0][1] + " more"), (12, "same " + text())]
    rows += [rows[-1]] * 3
    spark.createDataFrame([(i, t, "en", f"src{n % 3}", n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(7, 1, 0), (7, 1, 0), (8, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    last = lambda r: (r[0] is None, r[0] or 0)
    good = sorted({r for r in rows if len(words(r[1])) >= 50}, key=last)
    docs = spark.read.parquet(f"{base}/documents.parquet")
    docs = materialise(p.STAGES[0][1](spark, docs, base), "good")
    assert {(r["doc_id"], r["text"]) for r in docs.collect()} == set(good)
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (words(t) for _, t in good)]
    parent = list(range(len(good)))
    for b in range(len(good)):
        for a in range(b):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = parent[a], parent[b]
                parent = [min(x, y) if z in (x, y) else z for z in parent]
    want = [r for n, r in enumerate(good) if parent[n] == n]
    left = materialise(p.STAGES[1][1](spark, docs, base), "once")
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted(good, key=str)
    near = p.STAGES[2][1](spark, left.union(left), base)  # equal rows too
    assert sorted(((r["doc_id"], r["text"]) for r in near.collect()), key=str) == sorted(want, key=str)


def strings_removed(rows, length=50):
    """Brute force: sorted (doc_id, n_bytes, n_removed, n_spans, sha256) of rows (doc_id, text)."""
    last = lambda i: (1 << 63) - 1 if i is None else i
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for j in range(len(b) - length + 1):
            first[b[j : j + length]] = min(first.get(b[j : j + length], last(i)), last(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if first[b[j : j + length]] < last(i):
                gone[j : j + length] = b"\1" * length
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def test_suffix_dedup_of_null_repeated_and_shared_ids(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    text = lambda n=60: " ".join(word() for _ in range(n))
    x, y, z, same = text(), text(), text(), "ab" * 300
    rows = [(1, x), (2, x), (2, None), (2, None), (None, x), (None, y), (None, y), (None, None), (7, y), (7, y), (7, z), (7, x + z), (8, z[:49]), (9, z[:50]), (10, "é" + z[3:60] + "é"), (4, same), (5, same[:-1]), (6, "c" + same)]
    rows += [(20 + i, text(5) + y + text(5)) for i in range(40)]
    df = spark.createDataFrame([(i, t, "a", "b", 1, 2) for i, t in rows], "doc_id long, text string, key string, n_bytes string, hashes int, bucket int")
    for parts in (1, 5):
        got = sorted((tuple(r) for r in suffix_dedup.removal_digest(df.repartition(parts)).collect()), key=str)
        assert got == strings_removed(rows)


def test_suffix_dedup_tells_colliding_anchors_apart(spark, monkeypatch):
    """Hashes that tell nothing apart: all anchors meet, and only equal bytes may be removed."""
    rng = random.Random(13)
    side = lambda: "".join(rng.choice("abcdefgh") for _ in range(24))
    rows, n = [], 0
    for _ in range(12):
        a, b = side(), side()
        for _ in range(3):
            rows.append((n := n + 1, a + "".join(rng.choice("ijklmnop") for _ in range(26)) + b))
    rows += [(50 + i, rows[i][1] + "q") for i in range(4)]
    monkeypatch.setattr(suffix_dedup, "_fingerprints", lambda r: np.zeros(len(r), np.uint64))
    contexts = np.zeros((len(rows), suffix_dedup.ROW), np.uint8)
    for c, (_, t) in zip(contexts, rows, strict=True):
        c[:74] = np.frombuffer(t.encode()[:74], np.uint8)
    first, same = suffix_dedup.distinct_rows(contexts)
    assert len(first) == 36 and (contexts[first][same] == contexts).all()
    places = np.zeros(len(rows), suffix_dedup._PLACE)
    places["doc_id"], places["at"] = [i for i, _ in rows], 24
    full = np.full(len(rows), 24, np.uint8)
    spans = suffix_dedup.marked_spans(lambda c: contexts[:, c], places["doc_id"].copy(), full, full, np.arange(len(rows)), places)
    assert sorted((s["doc_id"], s["start"], s["end"]) for s in spans) == [(50 + i, 0, 74) for i in range(4)]
    monkeypatch.undo()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in suffix_dedup.removal_digest(df).collect()), key=str) == strings_removed(rows)


def test_columns_are_built_in_suffix_order():
    rng = np.random.default_rng(3)
    rows = rng.integers(97, 99, (200, suffix_dedup.WIDTH)).astype(np.uint8)
    rows[50:] = rows[rng.integers(0, 50, 150)]
    rows[:, 3] = rng.integers(97, 100, 200)
    for c, order, common in suffix_dedup.columns_built(lambda k: rows[:, k], len(rows)):
        suffixes = [rows[i, c:].tobytes() for i in order]
        assert suffixes == sorted(suffixes)
        for a, b, n in zip(suffixes, suffixes[1:], common[1:].tolist(), strict=False):
            assert a[:n] == b[:n] and (n == len(a) or a[n] != b[n])


def test_jaccard_join_of_large_groups(spark, monkeypatch):
    """Hundreds of near copies of one text, of which some link and some just don't, over blocks of few classes."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 40)
    monkeypatch.setattr(jaccard_join, "HOT", 16)
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, spare = [word() for _ in range(120)], [word() for _ in range(40)]
    rows = []
    for i in range(500):
        w = list(base)
        for _ in range(rng.randint(0, 3) if i < 250 else rng.randint(2, 6)):
            w[rng.randrange(len(w))] = rng.choice(spare)
        rows.append((i, " ".join(w[: rng.randint(95, 120)])))
    rows += [(500 + i, " ".join([*base[:60], f"only{i}", *base[60:]])) for i in range(60)] + [(600 + i, " ".join(word() for _ in range(50))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for k, percent in ((3, 90), (5, 80)):
        got = {r[0]: (r[1], r[2]) for r in jaccard_join.link_groups(df, k, percent).collect()}
        assert got == linked(rows, k, percent)


def test_signature_trees_find_what_all_pairs_find():
    rng = np.random.default_rng(5)
    for n, percent in ((3, 80), (70, 80), (300, 60)):
        sets = [np.unique(rng.integers(0, 60, rng.integers(20, 50)).astype(np.uint64)) for _ in range(n)]
        sets.sort(key=len)
        size, bits = np.array([len(x) for x in sets]), jaccard_join._bitmaps(sets)
        want = {(i, j) for i in range(n) for j in range(i + 1, n) if 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j]))}
        half = n // 2
        for x, y, shift, pairs in (
            (t := jaccard_join.SignatureTree(size, bits), t, 0, want),
            (jaccard_join.SignatureTree(size[:half], bits[:half], 4), jaccard_join.SignatureTree(size[half:], bits[half:], 4), half, {p for p in want if p[0] < half <= p[1]}),
        ):
            got = {(i, shift + j) for i, j in jaccard_join.spanning_links(x, y, percent)}
            assert got <= pairs

            def labels(links):
                label = list(range(n))
                for a, b in links:
                    label = [label[a] if z == label[b] else z for z in label]
                return [label.index(z) for z in label]

            assert labels(got) == labels(pairs)


CLASHING = "doc_id long, text string, source string, own_id string, own_key int, keep_id string, _id string, number int, repeats int, place int, n_sentences string, uid long, vertex long, owner long"


def clashing(rows):
    return [(i, t, "s", "a", 1, "b", "c", n, 3, 4, "d", 5, 6, 7) for n, (i, t) in enumerate(rows)]


def test_operators_keep_columns_of_clashing_names_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (1, text), (2, text + " "), (3, None), (None, None), (None, "p q r. s t u."), (5, "p q r. s t v."), (5, "another text under one id")]
    df = spark.createDataFrame(clashing(rows), CLASHING).repartition(2)
    wide = {(r["doc_id"], r["text"]) for r in exact_dedup.keep_first(df).collect()}
    assert wide == {(2, text + " "), (3, None), (None, "p q r. s t u."), (5, "p q r. s t v."), (5, "another text under one id")}
    for out in (exact_dedup.keep_first(df), mixing.mix(df), jaccard_join.keep_one(df), line_dedup.remove_lines(df)):
        assert out.columns == df.columns and out.filter("own_id <> 'a' or _id <> 'c' or owner <> 7").count() == 0
    spans = sentence_spans.remove_repeats(df)
    assert set(df.columns) <= set(spans.columns) and spans.filter("own_id <> 'a' or _id <> 'c'").count() == 0 and spans.count() == len(rows)
    assert sorted(((r["doc_id"], r["text"]) for r in jaccard_join.keep_one(df).collect()), key=str) == sorted([(1, text), (3, None), (None, None), (None, "p q r. s t u."), (5, "p q r. s t v."), (5, "another text under one id")], key=str)


def test_exact_dedup_under_a_small_budget(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "TRIE_BYTES", 50_000)  # in this process only
    trie, out = exact_dedup.RadixTrie(), []
    for i in range(3000):
        key = b"%d-%d" % (i % 700, i % 7)
        node = trie.at(key)
        trie.grown(key, exact_dedup.ROW_BYTES)
        node.value = (node.value or 0) + 1
        while trie.held > exact_dedup.TRIE_BYTES:
            out += trie.spill()
    out += trie.terminals(trie.root)
    assert Counter(x for x, n in out for _ in range(n)) == Counter(b"%d-%d" % (i % 700, i % 7) for i in range(3000))
    assert len(out) > 700  # it did spill
