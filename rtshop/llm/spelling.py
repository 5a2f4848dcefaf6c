"""Words that are spelling variants of others (op 12).

Words are counted over all documents. Two words are near if one inserted, deleted or replaced code point turns one into
the other. They are found by permuterm rotations: a word with a mark for its end is written once from each of its places
on, round the end. ``v$u`` followed by ``c`` is the word ``u c v`` turned so that ``c`` comes last; without its last sign it
is the same for all words that differ in ``c`` only, and it is a whole rotation of the word ``u v``. So when all rotations
are sorted, words that are near stand in one range: those with the edited sign left out beside each other (replaced) and
next to the word that lacks it (inserted, deleted). A range holds at most one word for each sign of the alphabet and one
whole word, so none is large, whatever the words are.

A range is scanned once and gives, for each of its words, how many others are near there and which of those is the most
frequent. Ranges of a word add up: two words of equal length meet in the one range of the place where they differ; where
a sign was inserted into a row of equal signs, only the row's first place counts. No list of pairs is made.

The form of a word is its most frequent near word (ties: smallest in code-point order) if that is at least ``TIMES`` as
frequent. Forms grow by that factor, so chains are short: their ends are found by joining the forms with themselves
a fixed number of times, each of which doubles the reach.

Odd rows: null and empty texts, and texts without letters, have no words. A row that repeats counts again. No documents give
no words. Columns other than the id and the text are not read, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rtshop.llm.common import staged

LETTERS = r"[A-Za-zÀ-ÿ]+"
LEAST_SIGNS = 6
LEAST_TIMES = 5
TIMES = 5
# Marks the end of a word within its rotations; no word has it.
MARK = "$"
# Distinct words that a task counts before it hands them on.
HELD_WORDS = 200_000

Change = Callable[[object, list[str]], list[str]]


def one_in_199(doc_id: object, runs: list[str]) -> list[str]:
    """Runs of a document, lower-cased, of which about one in 199 loses a code point; a document without an id none."""
    if doc_id is None:
        return runs
    start, out = zlib.crc32(f"{doc_id}:".encode()), []
    for run in runs:
        h = zlib.crc32(run.encode(), start)
        if h % 199 == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        out.append(run)
    return out


def word_counts(docs: DataFrame, change: Change | None = None, doc_id: str = "doc_id", text: str = "text",
                pattern: str = LETTERS, signs: int = LEAST_SIGNS, times: int = LEAST_TIMES) -> DataFrame:
    """``word, n``: words of at least ``signs`` code points that occur ``times`` times or more.

    Only A to Z are lower-cased. ``change(doc_id, runs)`` gives what the distinct runs of a document are counted as; it
    must follow from its arguments alone. Each task adds up what it reads before anything is shuffled.
    """
    find = re.compile(pattern).findall

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def handed_on() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                                               names=["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = value.as_py()
                if not own:
                    continue
                # Bytes are lower-cased in A to Z only.
                runs = Counter(find(own.encode().lower().decode()))
                words = list(runs) if change is None else change(name, list(runs))
                for word, n in zip(words, runs.values()):
                    if len(word) >= signs:
                        held[word] += n
                if len(held) > HELD_WORDS:
                    yield handed_on()
        yield handed_on()

    counted = docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= times)


def rotations(counts: DataFrame) -> DataFrame:
    """``turned, word, n, whole, first``: rotations of each word with a sign left out, and whole ones.

    ``first`` tells that the sign left out is the first of a row of equal signs.
    """
    n = F.length("word")
    places = F.explode(F.sequence(F.lit(0), n)).alias("at")
    placed = counts.select("word", "n", places)
    before, sign = F.substring("word", 1, F.col("at")), F.substring("word", F.col("at") + 1, F.lit(1))
    after = F.substring("word", F.col("at") + 1, n)
    kinds = F.array(
        F.struct(F.concat(after, F.lit(MARK), before).alias("turned"), F.lit(True).alias("whole"), F.lit(False).alias("first")),
        F.when(F.col("at") < n, F.struct(
            F.concat(F.substring("word", F.col("at") + 2, n), F.lit(MARK), before).alias("turned"),
            F.lit(False).alias("whole"),
            ((F.col("at") == 0) | (sign != F.substring("word", F.col("at"), F.lit(1)))).alias("first"))))
    rows = placed.select("word", "n", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("k"))
    return rows.select("k.turned", "word", "n", "k.whole", "k.first")


def near_words(counts: DataFrame) -> DataFrame:
    """``word, n_near, best``: for words that have near ones, their number and the most frequent (``n, word``)."""
    lot = Window.partitionBy("turned")
    # Words with a sign left out first, the most frequent ahead; the whole word, if there is one, last.
    order = lot.orderBy("whole", F.desc("n"), "word")
    rated = F.struct((-F.col("n")).alias("less"), F.col("word").alias("word"))
    scanned = rotations(counts).select(
        "word", "whole", "first", F.count(F.lit(1)).over(lot).alias("size"),
        F.count(F.when(~F.col("whole"), 1)).over(lot).alias("left"),
        F.count(F.when(F.col("first"), 1)).over(lot).alias("firsts"),
        F.row_number().over(order).alias("rank"),
        F.first(rated).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("top"),
        F.lead(F.when(~F.col("whole"), rated)).over(order).alias("next"),
        F.min(F.when(F.col("first"), rated)).over(lot).alias("top_first"),
        F.max(F.when(F.col("whole"), rated)).over(lot).alias("full"),
    ).filter(F.col("size") > 1)
    replaced = F.when(F.col("rank") == 1, F.col("next")).otherwise(F.col("top"))
    longer = F.when(F.col("first"), F.col("full"))
    best = F.when(F.col("whole"), F.col("top_first")).otherwise(F.least(replaced, longer))
    n_near = F.when(F.col("whole"), F.col("firsts")).otherwise(
        F.col("left") - 1 + F.when(longer.isNotNull(), 1).otherwise(0))
    found = scanned.select("word", best.alias("best"), n_near.alias("n_near")).filter(F.col("n_near") > 0)
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def variants(counts: DataFrame, times: int = TIMES) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each word of ``counts`` (``word, n``, each word once).

    ``root`` is where the forms lead from a word, the word itself without a form.
    """
    held = staged(counts.select("word", "n"), "words")
    near = near_words(held)
    form_n = -F.col("best.less")
    joined = held.join(near, "word", "left").withColumn("is_form", F.coalesce(form_n >= times * F.col("n"), F.lit(False)))
    rows = staged(joined.select(
        "word", F.when(F.col("is_form"), F.col("best.word")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("is_form"), form_n).alias("form_n")), "forms")
    ends = rows.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    low, high = rows.agg(F.min("n"), F.max("n")).first()
    steps = math.log(high / low, times) if low else 0
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        ahead = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ends = staged(ends.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return rows.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
