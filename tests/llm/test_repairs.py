"""Ids of odd letters, null and repeated ids, and clashing names."""

import hashlib
import random
from collections import Counter

import pyarrow as pa

from acn.llm import quality_rules, sentence_spans, token_store, warc


def test_ids_of_letters_that_change_when_lower_cased():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(6)
    odd = "İıßſKÅﬁǅΣςaZé中́̇ªº²Ⅷ"
    texts = ["Prof. Dr. İ. Yılmaz, B. İ. ve K.", *("".join(rng.choice(odd + " .,;:!?'-1\n") for _ in range(rng.randrange(40))) for _ in range(1500))]
    texts += ["".join(chr(rng.choice((rng.randrange(0x20, 0x250), rng.randrange(0x300, 0x3FF), rng.randrange(0x1E00, 0x2000)))) + rng.choice(["", ".", "! "]) for _ in range(30)) for _ in range(500)]
    ids, begin = token_store.WordEncoder(path, 2).encode(pa.array(texts), 1)
    plain = Tokenizer.from_file(path)
    for t, a, b in zip(texts, begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        assert ids[a:b].tolist() == [*plain.encode(t, add_special_tokens=False).ids, 1], t


def test_archives_of_null_and_repeated_page_ids(spark):
    long = "<p>" + "abc " * 400
    pages = [(None, "u", long), (None, None, long), (-1, "u", long), (4, "u", long), (4, "v", long), (7, "u", "short"), (7, "u", "short"), (None, "u", "x" * 1200), (None, "u", None)]
    df = spark.createDataFrame([(*p, "z", 1) for p in pages], "page_id long, url string, html string, digest string, keeper int")
    got = Counter(map(tuple, warc.full_payloads(warc.read_warc(spark, warc.write_warc(df))).collect()))
    want = Counter()
    for i, _, html in pages:
        data = (html or "").encode()
        keeper = max((j for j, _, h in pages if h == html and j is not None), default=None)
        revisit = len(data) >= 1000 and keeper != i
        want[i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", keeper if revisit else None] += 1
    assert got == want


def test_null_and_minus_one_are_two_documents(spark):
    text = "".join(f"This is sentence number {i} of a text that repeats. " for i in range(6))
    rows = [(None, text), (-1, text), (3, text + "One more sentence. ")]
    out = sentence_spans.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["n_removed"] for r in out.collect()} == {None: 0, -1: 6, 3: 6}


def test_symbols_and_clashing_names(spark):
    rng = random.Random(1)
    text = lambda: " ".join(rng.choice(["alpha", "beta#", "<b>", "ga$%ma", "|", "delta&*"]) + str(rng.randrange(900)) for _ in range(80))
    rows = [(i, text() if i % 5 else "few words", "b", "k") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _bad_id string, bad_key string")
    for r in quality_rules.quality_statistics(df).collect():
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in rows[r["doc_id"]][1])
    kept = quality_rules.keep_good(df.withColumnRenamed("bad_key", "bad_id"), spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert kept.columns == ["doc_id", "text", "_bad_id", "bad_id"] and {r["doc_id"] for r in kept.collect()} == {i for i in range(30) if i % 5}
