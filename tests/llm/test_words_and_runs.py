"""Quality by a factorisation machine, spelling variants, periodic runs."""

from __future__ import annotations

import random
import zlib

import brute
import pytest
from pyspark.sql import functions as F
from samples import SAMPLE
from test_documents import NO_ROWS, clashing, rows

from rtshop.llm import fm_quality, periodic, queries, spelling

LABELS = "doc_id long, quality int, toxic int"


# --- Factorisation machine ----------------------------------------------------------------------------------------

def area(scored):
    """Chance that a good text has a higher score than a bad one, of (label, score)."""
    good = [s for y, s in scored if y == 1]
    bad = [s for y, s in scored if y == 0]
    return sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))


def test_held_out_documents_are_told_apart(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op11_fm_quality(spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    held = [(r["quality"], got[r["doc_id"]]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()
            if got[r["doc_id"]]["held_out"]]
    assert area([(y, r["score"]) for y, r in held]) > 0.97
    always_good = sum(y for y, _ in held) / len(held)
    assert sum(y == r["predicted"] for y, r in held) / len(held) > always_good + 0.05


def machine(spark, documents, n=80):
    rnd = random.Random(4)
    plain = [" ".join(rnd.choice(["sun", "moon", "star", "sea"]) for _ in range(30)) for _ in range(n)]
    given = [(i, t if i % 2 else t.replace(" ", "$$ ")) for i, t in enumerate(plain)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(n)], LABELS)
    return fm_quality.fit(fm_quality.labelled(documents(given), labels, F.lit(True)))


def test_pairs_are_summed_in_linear_time_as_one_by_one(spark, documents):
    """Spark's score equals the sum over all pairs of places."""
    model = machine(spark, documents)
    vectors = fm_quality.features(documents([(1, "sun sea"), (2, "star$$ moon")]), "text", []).select("features").collect()
    linear, factors = model.linear.toArray(), model.factors.toArray()
    scored = sorted(r["score"] for r in fm_quality.score(documents([(1, "sun sea"), (2, "star$$ moon")]), model).collect())
    want = []
    for row in vectors:
        x = row["features"].toArray()
        raw = model.intercept + linear @ x + sum(
            factors[i] @ factors[j] * x[i] * x[j] for i in x.nonzero()[0] for j in x.nonzero()[0] if i < j)
        want.append(1 / (1 + pow(2.718281828459045, -raw)))
    assert scored == pytest.approx(sorted(want), abs=1e-9)


def test_odd_texts_have_scores(spark, documents, odd):
    model = machine(spark, documents)
    got = fm_quality.score(clashing(documents(odd)).withColumns({"predicted": F.lit(7), "row": F.lit(8), "own": F.lit(9)}), model)
    answer = got.collect()
    assert len(answer) == len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in answer)
    assert {r["own"] for r in answer} == {9} and {r["row"] for r in answer} == {8} and {r["kept"] for r in answer} == {"own"}
    same = {r["score"] for r in answer if r["text"] == "one"}
    assert len(same) == 1
    assert rows(fm_quality.score(documents(NO_ROWS), model)) == []


def test_labels_that_teach_nothing(spark, documents):
    docs = documents([(1, "a b"), (2, "c d"), (3, "e"), (3, "f"), (None, "g")])
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 0), (3, 1, 1), (9, 1, 0)], LABELS)
    train = fm_quality.labelled(docs, labels, F.lit(True))
    assert [(r["doc_id"], r["label"]) for r in train.collect()] == [(3, 1.0)]
    assert fm_quality.fit(train) == 1.0
    nobody = fm_quality.fit(fm_quality.labelled(docs, labels, F.lit(False)))
    assert nobody == 0.5
    assert {(r["score"], r["predicted"]) for r in fm_quality.score(docs, nobody).collect()} == {(0.5, 1)}


def test_the_sample_of_labels_has_a_bound(spark, documents):
    docs = documents([(i, f"t {i}") for i in range(50)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(50)], LABELS)
    assert fm_quality.labelled(docs, labels, F.lit(True), limit=20).count() == 20


# --- Spelling variants --------------------------------------------------------------------------------------------

def test_variants_of_the_sample(spark):
    """Whole words of a sample, all pairs compared."""
    given = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SAMPLE}/documents.parquet").collect()]
    counts = brute.spelling_counts(given)
    assert len(counts) > 300
    assert rows(queries.op12_spelling(spark, SAMPLE)) == sorted(brute.spelling(counts), key=repr)


def test_words_of_few_letters_have_many_variants(spark):
    """A small alphabet: rows of equal signs, chains of forms, ties."""
    rnd = random.Random(8)
    counts = {"".join(rnd.choice("aab") for _ in range(rnd.randint(6, 9))): 5 * 6 ** rnd.randint(0, 4) + rnd.randint(0, 1)
              for _ in range(400)}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    want = brute.spelling(counts)
    assert any(r[2] not in (r[0], r[1]) for r in want)
    assert rows(spelling.variants(frame)) == sorted(want, key=repr)


def test_ranges_are_as_small_as_the_alphabet(spark):
    """Words that differ in one place: a range holds them once each and the word that lacks it."""
    letters = [chr(c) for c in range(0x61, 0x7B)] + [chr(c) for c in range(0xC0, 0x100)]
    frame = spark.createDataFrame([(f"abc{c}def", 5) for c in letters] + [("abcdef", 5)], "word string, n long")
    sizes = spelling.rotations(frame).groupBy("turned").count().agg(F.max("count")).first()[0]
    assert sizes <= len(letters) + 1
    got = {r["word"]: r["n_near"] for r in spelling.variants(frame).collect()}
    assert got["abcdef"] == len(letters) and got["abcxdef"] == len(letters)


def test_odd_texts_have_words(spark, documents, odd):
    given = [*odd, (20, "STRASSE Straße straße ÀÉÎõü×÷ Abcdef1ghijkl " * 6), (21, "abcdef abcdef"), (None, "abcdef abcdef abcdef")]
    counts = brute.spelling_counts(given)
    assert {"straße", "abcdef", "ghijkl", "ÀÉÎõü×÷"} <= set(counts)
    frame = clashing(documents(given)).withColumns({"word": F.lit("own"), "n": F.lit(1)})
    got = spelling.word_counts(frame, spelling.one_in_199)
    assert dict(map(tuple, got.collect())) == counts
    assert rows(spelling.variants(got)) == sorted(brute.spelling(counts), key=repr)
    assert rows(spelling.variants(spelling.word_counts(documents(NO_ROWS)))) == []


def test_tasks_hand_on_what_they_counted(spark, documents, monkeypatch):
    monkeypatch.setattr(spelling, "HELD_WORDS", 3)
    given = [(i, f"absolute {'wonderful' if i % 3 else 'terrible'} unique{chr(97 + i % 26)}") for i in range(90)]
    counts = brute.spelling_counts(given, times=1)
    assert dict(map(tuple, spelling.word_counts(documents(given), spelling.one_in_199, times=1).collect())) == counts


# --- Periodic runs ------------------------------------------------------------------------------------------------

def test_runs_of_the_sample(spark, sample):
    want = brute.periodic([r for r in sample if len(brute.words(r[1])) < 3000])
    assert sum(r[1] > 0 for r in want) > 15
    got = queries.op13_periodic(spark, SAMPLE)
    short = {r[0] for r in want}
    assert [r for r in rows(got) if r[0] in short] == sorted(want, key=repr)
    assert got.count() == len(sample)


def random_words(rnd):
    own = [str(rnd.randrange(rnd.choice([1, 2, 3, 10, 1000]))) for _ in range(rnd.choice([3, 30, 100, 400]))]
    for _ in range(rnd.randrange(4)):
        a = rnd.randrange(len(own))
        p = 1 + rnd.randrange(max(1, (len(own) - a) // 3))
        for i in range(a, min(len(own), a + rnd.randrange(1, 6 * p + 30))):
            own[i] = own[a + (i - a) % p]
    return own


def plain(df):
    return sorted(((r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in df.collect()), key=repr)


def collapsed(own):
    gone = {i for s, n, q in brute.runs(own) for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(own) if i not in gone)


@pytest.mark.parametrize("long, span", [(10 ** 6, 8192), (0, 8), (0, 64), (300, 200)])
def test_runs_of_random_words(documents, long, span):
    """The same runs whether a text is solved whole or exploded into rows of tiles."""
    rnd = random.Random(5)
    given = [(i, random_words(rnd)) for i in range(150)]
    given += [(i + 1000, own) for i, own in given[:30]]
    want = [(i, brute.runs(own), collapsed(own)) for i, own in given]
    got = periodic.periodic_runs(documents([(i, " ".join(own)) for i, own in given]), long=long, span=span)
    assert plain(got) == sorted(want, key=repr)


def test_multiples_and_borders(documents):
    given = [["a"] * 24, ["a"] * 23, ["a", "b"] * 12, list("abcdefgh") * 3, [*"xy", *(["a"] * 40), *"yx"],
             [*(list("abc") * 9), *(list("cab") * 9)], [str(i % 100) for i in range(300)], [str(i % 100) for i in range(299)]]
    want = [(i, brute.runs(own), collapsed(own)) for i, own in enumerate(given)]
    assert want[0][1] == [(0, 24, 1)] and want[1][1] == [] and want[6][1] == [(0, 300, 100)] and want[7][1] == []
    for long in (10 ** 6, 0):
        assert plain(periodic.periodic_runs(documents([(i, " ".join(w)) for i, w in enumerate(given)]), long=long)) == want


def test_odd_texts_have_runs(documents, odd):
    want = sorted(((d, brute.runs(brute.words(t)), collapsed(brute.words(t))) for d, t in odd), key=repr)
    frame = clashing(documents(odd)).withColumns({c: F.lit("own") for c in ("runs", "collapsed", "llm_key", "llm_runs", "period")})
    for long in (10 ** 6, 0):
        got = periodic.periodic_runs(frame, long=long)
        assert plain(got) == want
        assert {(r["llm_key"], r["period"], r["start"]) for r in got.collect()} == {("own",) * 3}
    assert rows(periodic.periodic_runs(documents(NO_ROWS))) == []


def test_a_long_text_in_many_copies_is_solved_once(spark, documents):
    text = " ".join(random_words(random.Random(3)) * 40)
    copies = periodic.periodic_runs(documents([(i, text) for i in range(40)]), long=100, span=64)
    assert {(len(r["runs"]), r["collapsed"]) for r in copies.collect()} == {
        (len(brute.runs(text.split())), collapsed(text.split()))}
