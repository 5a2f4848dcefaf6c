"""The operators over texts against their plain versions: on the smallest sample, and on odd rows."""

from __future__ import annotations

import math
import random

import brute
import pytest
from samples import SAMPLE
from pyspark.sql import functions as F

from rtshop.llm import decontaminate, licenses, quality, queries, repeats, simhash, token_blocks, token_counts

NO_ROWS: list = []


def library(name):
    tokenizers = pytest.importorskip("tokenizers")
    pytest.importorskip("public_tokenizers")
    own = tokenizers.Tokenizer.from_file(queries.vocabulary(name))
    return lambda text: own.encode(text, add_special_tokens=False).ids


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def clashing(df):
    """Columns with the names of results and of helpers, which must not get in the way."""
    names = ["n_words", "kept", "score", "simhash", "fingerprint", "component_id", "n_bytes", "n_tokens", "size", "target",
             "llm_row", "tie", "h", "start", "matches", "first", "text_2"]
    return df.withColumns({n: F.lit("own") for n in names})


# --- SimHash ------------------------------------------------------------------------------------------------------

def test_simhash_classes_of_the_sample(spark, sample):
    assert rows(queries.op3_simhash(spark, SAMPLE)) == sorted(brute.near_duplicates(sample), key=repr)


def test_simhash_of_odd_rows(documents, odd):
    df = simhash.near_duplicates(clashing(documents(odd)))
    assert rows(df, "doc_id", "fingerprint", "component_id") == sorted(brute.near_duplicates(odd), key=repr)


def test_simhash_without_rows(documents):
    assert rows(simhash.near_duplicates(documents(NO_ROWS))) == []


def test_links_of_many_tiles_are_complete(spark):
    """Small tiles, chains and a crowd of close fingerprints: components equal those of all pairs."""
    rnd = random.Random(5)
    prints = {rnd.getrandbits(64) for _ in range(60)}
    for p in list(prints)[:20]:
        for _ in range(6):
            for _ in range(rnd.randint(1, 4)):
                p ^= 1 << rnd.randrange(64)
            prints.add(p)
    base = rnd.getrandbits(64)
    prints |= {base ^ (1 << i) for i in range(64)}
    signed = sorted(p - (1 << 64) if p >= 1 << 63 else p for p in prints)
    df = spark.createDataFrame([(p,) for p in signed], "simhash long")
    from rtshop.llm.components import components
    got = {r["node"]: r["root"] for r in components(simhash.near_links(df, 4, tile=4)).collect()}
    root = {p: p for p in signed}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in signed:
        for b in signed:
            if a < b and ((a ^ b) & (2 ** 64 - 1)).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {p: got.get(p, p) for p in signed} == {p: find(p) for p in signed}


def test_one_document_of_each_class_stays(documents, odd):
    got = simhash.one_of_each(documents(odd))
    assert got.columns == ["doc_id", "text", "source"]
    # Blank texts are one class (1, 2, 3, and the one without an id); "one" is another; the long ones stand alone.
    assert rows(got, "doc_id") == [(1,), (4,), (6,), (7,), (8,), (None,)]


# --- Token blocks -------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 1000])
@pytest.mark.parametrize("most", [1, 2, 50_000, 2 ** 63, 2 ** 64 - 1])
def test_blocks_are_an_exact_round_trip(n, most):
    import numpy as np
    rnd = np.random.default_rng(n)
    values = rnd.integers(0, most, n, dtype=np.uint64)
    values[rnd.random(n) < 0.05] = most - 1
    data = token_blocks.pack(values)
    assert (token_blocks.unpack(data) == values).all() and len(token_blocks.unpack(data)) == n
    assert (token_blocks.unpack(data, 130, 200) == values[130:330]).all()


def test_segments_hold_missing_and_extreme_ids():
    import numpy as np
    ids, lengths = [None, -5, 0, 2 ** 63 - 1, -2 ** 63, None], np.array([1, 0, 2, 3, 1, 1])
    data = np.arange(8, dtype="<u4")
    start, got, sizes, tokens = token_blocks.decode_segment(token_blocks.encode_segment(9, ids, lengths, data))
    assert (start, got, sizes.tolist(), tokens.tolist()) == (9, ids, lengths.tolist(), data.tolist())
    with pytest.raises(ValueError):
        token_blocks.decode_segment(b"x" * 64)


def test_token_blocks_of_the_sample(spark, sample):
    assert rows(queries.op4_token_blocks(spark, SAMPLE)) == sorted(
        brute.token_rows(sample, library(queries.BLOCK_VOCABULARY)), key=repr)


def test_token_blocks_of_odd_rows(spark, documents, odd, folder):
    encode = library(queries.BLOCK_VOCABULARY)
    token_blocks.write_tokens(clashing(documents(odd)), queries.vocabulary(queries.BLOCK_VOCABULARY), folder, segment_bytes=40)
    got = token_blocks.read_tokens(spark, folder)
    # Rows without an id come first; which of them is first follows a hash. Sizes and sums are checked for all.
    want = brute.token_rows(odd, encode)
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got.filter("doc_id is not null").collect()) == sorted(
        (d, n, c) for d, _, n, c in want if d is not None)
    ordered = sorted((r["start"], r["n_tokens"]) for r in got.collect())
    assert [s for s, _ in ordered] == [sum(n for _, n in ordered[:k]) for k in range(len(ordered))]
    ids = [r["doc_id"] for r in got.orderBy("start").collect()]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])


def test_token_blocks_without_rows(documents):
    assert rows(token_blocks.store_tokens(documents(NO_ROWS), queries.vocabulary(queries.BLOCK_VOCABULARY))) == []


SIGNS = ["a", "B", "the", "The,", " ", "  ", "\n", "\t", "'s", "'RE", "'", "r", "é", "É", "漢字", "🙂", "0", "12", "!", "--", ".",
         ",", "<|endoftext|>", "<|END", "\x1c", "\x85", "\xa0", "\u3000", "'ll", "don't", "İ", "ǅ", "\u0301", "\r\n", "Σ", "²"]


def texts_of_signs(seed, n, most):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(SIGNS) for _ in range(rnd.randint(0, most))) for _ in range(n)]


def test_word_cache_encodes_as_the_library():
    import numpy as np
    import pyarrow as pa
    encode, own = library(queries.BLOCK_VOCABULARY), token_blocks.WordEncoder(queries.vocabulary(queries.BLOCK_VOCABULARY))
    texts = [*texts_of_signs(1, 600, 10), None, "x" * 500]
    ids, lengths = own.encode_all(pa.array(texts))
    got = [part.tolist() for part in np.split(ids, np.cumsum(lengths)[:-1])]
    assert got == [encode(t or "") for t in texts]


# --- Repeated passages --------------------------------------------------------------------------------------------

def test_repeats_of_the_sample(spark, sample):
    assert rows(queries.op6_repeats(spark, SAMPLE)) == sorted(brute.removed(sample), key=repr)


@pytest.mark.parametrize("length, gram, group", [(50, 24, 2000), (12, 5, 3), (8, 3, 1)])
def test_repeats_of_made_up_texts(documents, odd, length, gram, group):
    rnd = random.Random(length)
    stock = ["".join(rnd.choice(["aé", "b", "the ", "a", "\n", "xyz ", "日本"]) for _ in range(rnd.randint(0, 120)))
             for _ in range(10)]
    made = [(i if rnd.random() > 0.05 else None, "".join(rnd.choice(stock)[:rnd.randint(5, 120)] for _ in range(3)))
            for i in range(40)] + [(70, "a" * 300), (71, "a" * 200), (72, "the " * 60), (73, "the " * 50)]
    given = made + made[:4] + odd[:9]
    got = repeats.remove_repeats(clashing(documents(given)), length, gram, filter_bytes=1 << 12, group=group)
    assert rows(got) == sorted(brute.removed(given, length), key=repr)


def test_long_texts_are_worked_off_in_blocks(documents, monkeypatch):
    rnd = random.Random(3)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(3000))
    given = [(1, text), (2, text[700:2300]), (3, "x" + text[:900] + "y" + text[2000:])]
    import numpy as np
    pieces = list(repeats.blocks([t.encode() for _, t in given], 50, 500))
    assert max(len(p[0]) for p in pieces) <= 2 * 549
    owned = sum(int((last - first + 1).sum()) for data, ends, _, _ in pieces
                for _, first, last, _ in [repeats.anchors(data, np.asarray(ends), 50, 24)])
    assert owned == sum(len(t) - 49 for _, t in given)
    assert rows(repeats.remove_repeats(documents(given))) == sorted(brute.removed(given), key=repr)


def test_previous_factors_are_longest():
    import numpy as np
    rnd = np.random.default_rng(1)
    suffixes = rnd.integers(97, 99, (120, 9), dtype=np.uint8)
    docs = rnd.integers(0, 12, 120)
    same = lambda a, b: next((k for k in range(9) if a[k] != b[k]), 9)
    want = [max((same(s, t) for t, e in zip(suffixes, docs) if e < d), default=0) for s, d in zip(suffixes, docs)]
    assert repeats.previous_factors(suffixes, docs).tolist() == want


def test_windows_beyond_a_mask_are_refused(documents):
    for length, gram in ((100, 24), (20, 24)):
        with pytest.raises(ValueError, match="must exceed gram"):
            repeats.remove_repeats(documents(NO_ROWS), length=length, gram=gram)


def test_repeats_keep_the_bytes_left(documents):
    passage = "".join(chr(97 + i % 26) + str(i) for i in range(40))
    got = repeats.remove_repeats(documents([(1, passage), (2, "before " + passage + " after")]), with_text=True)
    assert {r["doc_id"]: bytes(r["kept"]) for r in got.collect()} == {1: passage.encode(), 2: b"before  after"}


# --- Decontamination ----------------------------------------------------------------------------------------------

def test_contamination_of_the_sample(spark, sample):
    items = [tuple(r) for r in spark.read.parquet(f"{SAMPLE}/benchmark.parquet").select("item_id", "text").collect()]
    assert rows(queries.op7_decontaminate(spark, SAMPLE)) == sorted(brute.contamination(sample, items), key=repr)


def test_contamination_of_odd_rows(spark, documents, odd):
    long = " ".join(f"w{i}" for i in range(40))
    items = [(1, long), (2, "Short item"), (3, None), (4, "..."), (None, "no id here"), (1, "w3 w4 w5"), (5, long)]
    given = odd + [(20, "x " + long.upper() + " y"), (21, "short, ITEM; short item"), (22, "w3 w4 w5 no id here"),
                   (23, " ".join(f"w{i}" for i in range(12))), (24, long + " " + "z " * 2000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (4_000_000, 30):
        got = decontaminate.find_contamination(clashing(documents(given)), bench, keep=["doc_id"], shard_bytes=size)
        assert rows(got) == sorted(brute.contamination(given, items), key=repr)
    kept = decontaminate.remove_contaminated(documents(given), bench)
    clean = [r for r, v in zip(given, brute.contamination(given, items)) if not v[-1]]
    assert rows(kept, "doc_id", "text") == sorted(clean, key=repr)
    assert rows(decontaminate.find_contamination(documents(NO_ROWS), bench)) == []
    none = decontaminate.find_contamination(documents(given), bench.limit(0), keep=["doc_id"])
    assert {r["n_hit"] for r in none.collect()} == {0}


def test_longest_matches_and_their_places(spark, documents):
    text = " ".join(f"w{i}" for i in range(30))
    bench = spark.createDataFrame([(7, text)], "item_id long, text string")
    df = decontaminate.find_contamination(documents([(1, "a b " + " ".join(f"w{i}" for i in range(5, 25)) + " c")]), bench,
                                          locate=True, keep=["doc_id"])
    assert [tuple(m) for m in df.first()["matches"]] == [("7", 5, 2, 20)]


def test_a_benchmark_in_parts_finds_the_same(spark, documents, odd):
    long = " ".join(f"w{i}" for i in range(90))
    items = [(1, long), (2, "Short item"), (3, None), (None, "no id here"), (1, "w3 w4 w5"), (5, long), (5, long)]
    given = odd + [(20, "x " + long.upper() + " y"), (20, "x " + long.upper() + " y"), (22, "w3 w4 w5 no id here"),
                   (23, " ".join(f"w{i}" for i in range(20, 70))), (24, long + " " + "z " * 4000), (None, "short item"),
                   (25, long + " - " + long)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    find = lambda docs, **how: decontaminate.find_contamination(docs, bench, keep=["doc_id"], **how)
    got = find(clashing(documents(given)), part_bytes=200, piece=10)
    assert rows(got) == sorted(brute.contamination(given, items), key=repr)
    whole, parts = (find(documents(given), locate=True, **how) for how in ({}, {"part_bytes": 200, "piece": 10}))
    told = lambda df: rows(df.select("doc_id", F.array_sort("matches").alias("m")))
    assert told(parts) == told(whole)
    assert (20, [("1", 0, 1, 90), ("1", 0, 4, 3), ("5", 0, 1, 90)]) in [
        (d, sorted(tuple(x) for x in m)) for d, m in told(parts)]
    assert rows(find(documents(NO_ROWS), part_bytes=200)) == []


# --- Token counts -------------------------------------------------------------------------------------------------

def test_token_counts_of_the_sample(spark, sample):
    encode = library(queries.COUNT_VOCABULARY)
    want = [(d, len((t or "").encode()), n := len(encode(t or "")), n > 1024) for d, t in sample]
    assert rows(queries.op8_token_counts(spark, SAMPLE)) == sorted(want, key=repr)


def test_every_prefix_counts_as_the_library():
    encode = library(queries.COUNT_VOCABULARY)
    own = token_counts.counter(queries.vocabulary(queries.COUNT_VOCABULARY))
    for text in [*texts_of_signs(2, 250, 12), "<|endoftext|>" * 2, " <|endoftext|> a", "x" * 300, ""]:
        want = [len(encode(text[:k])) for k in range(len(text) + 1)]
        assert own.prefix_counts(text) == want, repr(text)
        assert own.count(text) == want[-1]
        assert own.cut_for(text, 3) == max(k for k, n in enumerate(want) if n <= 3)


def test_token_counts_of_odd_rows(documents, odd):
    encode, path = library(queries.COUNT_VOCABULARY), queries.vocabulary(queries.COUNT_VOCABULARY)
    got = token_counts.count_tokens(clashing(documents(odd)), path, limit=5, keep=["doc_id"])
    want = [(d, len((t or "").encode()), n := len(encode(t or "")), n > 5) for d, t in odd]
    assert rows(got) == sorted(want, key=repr)
    assert rows(token_counts.count_tokens(documents(NO_ROWS), path)) == []
    short = documents([(1, "the end"), (2, None)])
    assert rows(token_counts.prefix_table(short, path, keep=["doc_id"]))[0][1] == [len(encode("the end"[:k])) for k in range(8)]
    assert rows(token_counts.fit_budget(short, path, 1, keep=["doc_id"])) == [(1, 3), (2, 0)]


# --- Quality ------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("grams", [(1,), (1, 2)])
def test_quality_of_the_sample(spark, sample, grams):
    labels = spark.read.parquet(f"{SAMPLE}/labels.parquet")
    trusted = {r[0] for r in quality.trusted_documents(labels).collect()}
    docs = spark.read.parquet(f"{SAMPLE}/documents.parquet")
    got = {r["doc_id"]: r for r in quality.judge(docs, quality.trusted_documents(labels), grams=grams).collect()}
    for (d, text), score in zip(sample, brute.ratio_scores(sample, trusted, quality.BUCKETS, grams)):
        row = got[d]
        counts = brute.base_counts(text)
        assert tuple(row[c] for c in quality.RESULTS[:6]) == counts
        assert math.isclose(row["score"], score, abs_tol=1e-9)
        assert row["kept"] == (not counts[-1] and row["score"] >= quality.THRESHOLD)


def test_quality_of_odd_rows(spark, documents, odd):
    lines = "a b c d e\na b c d e\n \n\na b c d e\nx y z 1 2 3 4 5 6 7 # $ <"
    given = odd + [(30, lines), (31, "p q r s t p q r s t p q r s t u v"), (32, " ".join(f"w{i}" for i in range(50)))]
    trusted = spark.createDataFrame([(32,), (32,), (None,)], "doc_id long")
    got = quality.judge(clashing(documents(given)), trusted)
    assert rows(got, "doc_id", *quality.RESULTS[:6]) == sorted(((d, *brute.base_counts(t)) for d, t in given), key=repr)
    untrusted = quality.judge(documents(given), trusted.limit(0))
    assert all(r["kept"] == (not r["base_failed"]) and r["score"] is None for r in untrusted.collect())
    assert rows(quality.judge(documents(NO_ROWS), trusted)) == []
    kept = quality.keep_good(documents(given), trusted)
    assert kept.columns == ["doc_id", "text", "source"]
    assert rows(kept, "doc_id") == rows(got.filter("kept"), "doc_id")


def test_quality_rules_and_licenses_run_no_python(spark):
    for df in (queries.op9_quality(spark, SAMPLE), queries.op10_licenses(spark, SAMPLE)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- Licenses -----------------------------------------------------------------------------------------------------

def test_licenses_that_differ_in_a_word_are_told_apart(documents):
    long = ("you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software "
            "Foundation, either version {} of the License, or (at your option) any later version. It comes without warranty.")
    given = [(1, long.format("General Public License", 2)), (2, long.format("General Public License", 3)),
             (3, long.format("Lesser General Public License", "2.1")), (4, long.format("Affero General Public License", 3)),
             (5, "The text is licensed under CC BY-SA 4.0."), (6, "All of it is released under CC BY 3.0, they say."),
             (7, "Distributed under the GNU General Public License, version 2."), (8, "Licensed under a Creative Commons licence."),
             (9, "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
             (10, "It is published under the BSD 3-Clause License"), (11, "Released under CC0 1.0 or, if you like, licensed "
              "under the MIT License."), (12, "This is free and unencumbered software released into the public domain. Anyone "
              "is free to copy, modify, print, use, compile, sell, or distribute this software")]
    want = {1: {"GPL-2.0"}, 2: {"GPL-3.0"}, 3: {"LGPL-2.1"}, 4: {"AGPL-3.0"}, 5: {"CC-BY-SA-4.0"}, 6: {"CC-BY-3.0"},
            7: {"GPL-2.0"}, 9: {"CC-BY-ND-4.0"}, 10: {"BSD-3-Clause"}, 11: {"CC0-1.0", "MIT"}}
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(documents(given)).collect()}
    assert got == {(d, name) for d, names in want.items() for name in names} == brute.licenses(given, licenses.TEMPLATES)


def test_licenses_of_the_sample(spark, sample):
    got = queries.op10_licenses(spark, SAMPLE)
    assert {(r["doc_id"], r["license"]) for r in got.collect()} == brute.licenses(sample, licenses.TEMPLATES)


def test_every_template_is_found_wherever_it_stands(documents, odd):
    rnd = random.Random(4)
    filler = lambda n: " ".join(rnd.choice("abcdefgh") * 3 for _ in range(n))
    given = odd + [(100 + 10 * k + j, f"{filler(7 * j + k)} {text.upper() if j % 2 else text} {filler(5)}")
                   for k, (_, text) in enumerate(licenses.TEMPLATES) for j in range(8)]
    got = licenses.scan(clashing(documents(given)))
    assert {(r["doc_id"], r["license"]) for r in got.collect()} == brute.licenses(given, licenses.TEMPLATES)
    assert rows(licenses.scan(documents(NO_ROWS))) == []


def test_a_template_with_a_changed_word_is_still_contained(documents):
    mit = dict(reversed([t for t in licenses.TEMPLATES if t[0] == "MIT"]))
    text = [t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 100][0].replace("modify", "alter")
    assert mit and rows(licenses.scan(documents([(1, "x " + text + " y"), (2, text[:150])])), "doc_id", "license") == [(1, "MIT")]


def test_short_templates_raise(documents):
    with pytest.raises(ValueError):
        licenses.scan(documents([(1, "a")]), [("x", "four words are few")])
