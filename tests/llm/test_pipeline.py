"""All five stages of the pipeline against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def table(spark, base, rows, labels=()):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")


def survivors(rows):
    """Rows that pass the base rules, once of equal texts (most code points, then smallest doc_id), once of near ones (smallest doc_id)."""
    def good(text):
        w = words(text)
        seen = Counter(zip(w, w[1:], w[2:], strict=False))
        inside = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        return len(w) >= 50 and 100 * len(inside) <= 50 * len(w)

    best = {}
    for r in sorted((r for r in rows if good(r[1])), key=lambda r: (-len(r[1]), r[0])):
        best.setdefault("".join(words(r[1])), r)
    left = sorted(best.values())
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (words(r[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) for r in left)]
    group = list(range(len(left)))
    for b in range(len(left)):
        for a in range(b):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = group[a], group[b]
                group = [min(x, y) if g in (x, y) else g for g in group]
    return [r for n, r in enumerate(left) if group[n] == n]


def repeats(rows):
    """doc_id -> how often the mix takes it: weights 1, 2, 3 by source in order, at most 3 times a source's size, whole documents in md5 order."""
    size, own = {r[0]: len(words(r[1])) for r in rows}, defaultdict(list)
    for r in rows:
        own[r[3]].append(r[0])
    total = {s: sum(size[i] for i in ids) for s, ids in own.items()}
    weight = {s: i % 3 + 1.0 for i, s in enumerate(sorted(total, key=lambda s: (s is None, s or "")))}
    target, free, left = {}, set(total), float(sum(total.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * total[s]}
        target |= {s: 3.0 * total[s] for s in over} if over else share
        if not over:
            break
        left -= sum(target[s] for s in over)
        free -= over
    out = {}
    for s, ids in own.items():
        whole = int(target[s] / total[s] + 1e-12)
        rest, at = target[s] - whole * total[s], 0
        for i in sorted(ids, key=lambda i: (hashlib.md5(f"20|{i}".encode()).hexdigest(), i)):
            out[i] = whole + (at + size[i] / 2 < rest)
            at += size[i]
    return out


def least_padding(lengths, buckets):
    """Of all ways to choose at most so many bucket ends among the lengths."""
    h = sorted(Counter(lengths).items())
    cost = lambda a, b: sum(c * (h[b][0] - n) for n, c in h[a : b + 1])
    best = [cost(0, j) for j in range(len(h))]
    for _ in range(buckets - 1):
        best = [min([best[j], *(best[k] + cost(k + 1, j) for k in range(j))]) for j in range(len(h))]
    return best[-1]


def test_whole_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    rng = random.Random(17)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(6)) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(i, text(rng.randint(50, 400)), "en", rng.choice(["a", "a", "a", "b", "c", "d", None]), i) for i in range(120)]
    rows += [(200 + i, rows[i][1].replace(" ", "\n", 2) + " " * (i % 2), "en", "b", 0) for i in range(8)]
    rows += [(300 + i, rows[i][1].rsplit(" ", 2)[0] + " changed", "en", "c", 0) for i in range(20, 26)]
    rows += [(400, None, "en", "a", 0), (401, "short", "en", "a", 0), (402, "aaa " * 200, "en", "b", 0), (403, text(5000), "en", "b", 0), (404, text(2048), None, "d", 0)]
    base = str(tmp_path)
    table(spark, base, rows)
    left = survivors(rows)
    times = repeats(left)
    want = Counter()
    for r in left:
        n = len(words(r[1]))
        for k in range(0, n, 2048):
            want[r[0], k // 2048, k, min(n - k, 2048)] += times[r[0]]
    got = p.run(spark, base).collect()
    assert Counter((r["doc_id"], r["piece"], r["first_token"], r["n_tokens"]) for r in got) == +want and len(left) == 122
    assert sum(r["bucket"] - r["n_tokens"] for r in got) == least_padding([r["n_tokens"] for r in got], 16)
    places = Counter((r["bucket"], r["batch"], r["slot"]) for r in got)
    assert set(places.values()) == {1} and all(slot < 65536 // bucket for bucket, _, slot in places)
    for bucket in {b for b, _, _ in places}:
        filled = Counter(batch for b, batch, _ in places if b == bucket)
        assert sorted(filled) == list(range(len(filled))) and all(n == 65536 // bucket for batch, n in filled.items() if batch < len(filled) - 1)


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (None, "", "x", "y", 0)]])
def test_pipeline_of_nothing(spark, tmp_path, rows):
    import corpus_pipeline as p

    table(spark, str(tmp_path), rows)
    assert p.run(spark, str(tmp_path)).count() == 0
