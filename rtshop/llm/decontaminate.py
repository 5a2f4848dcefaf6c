"""Benchmark decontamination with suffix arrays over the training text.

Training text is cut into shards of whole documents. Each shard gets a suffix array over its words, the windows of all
benchmark items are binary-searched in it, and the ranges found are verbatim matches with their places. Those that
overlap on one diagonal of a document and an item are the longest matches, from which hits and items follow. Nothing is
shuffled: shards live and die inside a task, and only the benchmark's index is sent to the tasks.

An index covers ``PART_BYTES`` of the benchmark's words at most, give or take a piece. A larger benchmark is searched in
parts: one reading of the texts for each, which leaves the matches of texts that have some; those are united by the text's
hash, and matches that go on from one part to another are joined.

Defined results
---------------
* Null text, or text without a word: zero words, zero hits, not contaminated. An item without words is ignored.
* Rows that repeat are judged one by one; items with equal ``item_id`` count once; a null ``item_id`` is written as "".
  ``matches`` of items that share an id are told of the id.
* An empty benchmark hits nothing; empty ``docs`` give an empty result.
* Other columns of ``docs`` pass through; one that has the name of a result column is replaced.
* A long document is one shard of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rtshop.llm.common import add_columns, slices, staged

WINDOW = 13
SHARD_BYTES = 4_000_000
# The index of a part of the query set goes to every task. 4 MB of words take about 100 bytes a word in it.
PART_BYTES = 4_000_000
# Windows in one piece of an item; pieces overlap by a window less one word, so that none is lost.
PIECE = 20_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ITEM_WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"
# Letters A to Z become lower case; ASCII bytes that are no digit and no letter separate words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
             for b in range(256))

MATCH = T.ArrayType(T.StructType([
    T.StructField("item_id", T.StringType()), T.StructField("item_word", T.IntegerType()),
    T.StructField("doc_word", T.IntegerType()), T.StructField("n_words", T.IntegerType())]))
FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
          T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()),
          T.StructField("contaminated", T.BooleanType())]


def word_list(text: str | bytes | None) -> list[bytes]:
    if text is None:
        return []
    return (text.encode() if isinstance(text, str) else text).translate(FOLD).split()


class BenchmarkIndex:
    """Word ids of the benchmark, and its windows as big-endian byte keys that compare like word sequences."""

    def __init__(self, pieces: list[tuple[str, int, str]], window: int = WINDOW):
        """``pieces`` are (item, number of the first word, words)."""
        self.window = window
        self.ids = sorted({name for name, _, _ in pieces})
        number = {name: k for k, name in enumerate(self.ids)}
        self.vocabulary: dict[bytes, int] = {}
        rows, lengths, owner_item, owner_at = [], [], [], []
        for name, first, text in pieces:
            codes = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in word_list(text)], np.int64)
            if not len(codes):
                continue
            length = min(window, len(codes))
            padded = np.concatenate([codes, np.zeros(window - length, np.int64)])
            rows.append(np.lib.stride_tricks.sliding_window_view(padded, window))
            lengths.append(np.full(len(rows[-1]), length, np.int64))
            owner_item.append(np.full(len(rows[-1]), number[name], np.int64))
            owner_at.append(first + np.arange(len(rows[-1])))
        # Big-endian, as numpy's concatenation is not.
        every = np.concatenate(rows or [np.zeros((0, window), np.int64)]).astype(">u4", order="C")
        keys = every.view(f"S{4 * window}").ravel()
        lengths, owner_item, owner_at = (np.concatenate(x or [np.zeros(0, np.int64)]) for x in (lengths, owner_item, owner_at))
        # Shorter windows end in zeros, which no word has for its number.
        self.low, at, which = np.unique(keys, return_index=True, return_inverse=True)
        self.lengths = lengths[at]
        top = self.low.view(">u4").reshape(-1, window).copy()
        top[np.arange(window) >= self.lengths[:, None]] = 0xFFFFFFFF
        self.high = top.view(f"S{4 * window}").ravel()
        order = np.argsort(which, kind="stable")
        self.first = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(self.low)))]).astype(np.int64)
        self.owner_item, self.owner_at = owner_item[order], owner_at[order]
        self.shortest = int(self.lengths.min()) if len(self.low) else 0


def suffix_array(codes: np.ndarray, index: BenchmarkIndex) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of the shard's suffixes and their places.

    Code 0 is a word foreign to the benchmark or the end of a document; no window holds one. So only suffixes that
    begin with as many known words as the shortest window has can match, and the others are left out of the array.
    """
    n, width = len(codes), index.window
    stop = np.where(codes == 0, np.arange(n), n)
    stop = np.minimum.accumulate(stop[::-1])[::-1]
    places = np.flatnonzero(stop - np.arange(n) >= index.shortest)
    padded = np.concatenate([codes, np.zeros(width, codes.dtype)])
    steps = np.arange(width)
    rows = padded[places[:, None] + steps]
    rows[steps >= (stop[places] - places)[:, None]] = 0
    keys = np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * width}").ravel()
    order = np.argsort(keys, kind="stable")
    return keys[order], places[order]


def search(codes: np.ndarray, index: BenchmarkIndex) -> tuple[np.ndarray, np.ndarray]:
    """(window number, place in the shard) of every verbatim occurrence."""
    if not len(index.lengths) or not len(codes):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    keys, places = suffix_array(codes, index)
    low = np.searchsorted(keys, index.low, "left")
    count = np.searchsorted(keys, index.high, "right") - low
    found = np.repeat(np.arange(len(low)), count)
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return found, places[low[found] + inside]


Matches = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def longest(doc: np.ndarray, item: np.ndarray, at: np.ndarray, place: np.ndarray, length: np.ndarray) -> Matches:
    """Join matches that overlap or touch on one diagonal of a document and an item: the longest verbatim matches."""
    if not len(doc):
        return doc, item, at, place, length
    order = np.lexsort((at, place - at, item, doc))
    doc, item, at, place, length = (x[order] for x in (doc, item, at, place, length))
    new = np.ones(len(doc), bool)
    new[1:] = (np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(place - at) != 0)
    # Ends grow over all diagonals, each moved beyond the one before it.
    shift = (np.cumsum(new) - 1) * (int((at + length).max()) + 1)
    end = np.maximum.accumulate(at + length + shift)
    new[1:] |= (at + shift)[1:] > end[:-1]
    last = np.append(np.flatnonzero(new)[1:], len(doc)) - 1
    return doc[new], item[new], at[new], place[new], end[last] - shift[last] - at[new]


def _search_shard(split: list[list[bytes]], index: BenchmarkIndex) -> Matches:
    """Longest matches in one shard: its documents follow each other with a 0 between them."""
    sizes = np.array([len(w) for w in split], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    codes = np.zeros(int(sizes.sum() + len(sizes)), np.int64)
    for start, size, own in zip(starts, sizes, split):
        codes[start:start + size] = np.fromiter(map(index.vocabulary.get, own, repeat(0)), np.int64, size)
    window, place = search(codes, index)
    # A window may belong to several items.
    count = np.diff(index.first)[window]
    owner = np.repeat(index.first[window], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    place, length = np.repeat(place, count), np.repeat(index.lengths[window], count)
    doc = np.searchsorted(starts, place, "right") - 1
    return longest(doc, index.owner_item[owner], index.owner_at[owner], place - starts[doc], length)


def _told(sizes: np.ndarray, names: list[str], found: Matches) -> list[list[dict]]:
    """The matches of each document, as rows."""
    out: list[list[dict]] = [[] for _ in sizes]
    for d, i, a, p, n in zip(*(x.tolist() for x in found)):
        out[d].append({"item_id": names[i], "item_word": a, "doc_word": p, "n_words": n})
    return out


def _verdicts(sizes: np.ndarray, names: list[str], found: Matches) -> list[list]:
    """The result columns, from the longest matches."""
    doc, item, _, place, length = found
    starts = np.cumsum(sizes + 1) - sizes - 1
    depth = np.zeros(int(sizes.sum() + len(sizes)) + 1, np.int64)
    np.add.at(depth, starts[doc] + place, 1)
    np.add.at(depth, starts[doc] + place + length, -1)
    hit = np.concatenate([[0], np.cumsum(np.cumsum(depth) > 0)])
    n_hit = hit[starts + sizes] - hit[starts]
    items: list[list[str]] = [[] for _ in sizes]
    step = max(1, len(names))
    for pair in np.unique(doc * step + item).tolist():
        items[pair // step].append(names[pair % step])
    return [sizes.tolist(), n_hit.tolist(), [len(own) for own in items],
            [hashlib.sha256(",".join(own).encode()).hexdigest() for own in items],
            ((n_hit > 0) & (20 * n_hit >= sizes)).tolist()]


def _shards(text: pa.Array, shard_bytes: int) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Words of the texts of each shard, with the number of its first text."""
    column = text.cast(pa.large_binary())
    sizes = [len(v.as_buffer()) if v.is_valid else 0 for v in column]
    for start, stop in slices(sizes, shard_bytes):
        yield start, [word_list(t) for t in column[start:stop].to_pylist()]


def benchmark_pieces(benchmark: DataFrame, window: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """``item, at, words``: items with words, cut to pieces of ``piece`` windows; each once, whatever is repeated."""
    folded = F.translate(F.coalesce("text", F.lit("")), UPPER, UPPER.lower())
    own = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                           F.regexp_extract_all(folded, F.lit(ITEM_WORD), F.lit(1)).alias("own")).filter(F.size("own") > 0)
    steps = F.sequence(F.lit(0), F.greatest(F.size("own") - window, F.lit(0)), F.lit(piece))
    return (own.select("item", "own", F.explode(steps).alias("at"))
            .select("item", "at", F.array_join(F.slice("own", F.col("at") + 1, piece + window - 1), " ").alias("words"))
            .distinct())


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, locate: bool = False,
                       keep: list[str] | None = None, shard_bytes: int = SHARD_BYTES, part_bytes: int = PART_BYTES,
                       piece: int = PIECE) -> DataFrame:
    """Add ``n_words, n_hit, n_items, items_sha256, contaminated`` to ``docs``.

    A document word is hit when it lies in an occurrence of ``window`` consecutive item words (or of a whole shorter
    item). A document is contaminated when it has hits and they are 5 % of its words or more. ``locate`` adds
    ``matches``: the longest verbatim matches as (item, word in item, word in document, words).
    """
    spark = docs.sparkSession
    pieces = benchmark_pieces(benchmark, window, piece)
    size = pieces.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()[0]
    fields = FIELDS + [T.StructField("matches", MATCH)] * locate
    if size > part_bytes:
        parts = -(-size // part_bytes)
        return _in_parts(docs, pieces, parts, window, locate, keep, shard_bytes, fields)
    index = spark.sparkContext.broadcast(BenchmarkIndex([tuple(r) for r in pieces.collect()], window))

    def judge(text: pa.Array) -> list:
        made: list[list] = [[] for _ in fields]
        for _, split in _shards(text, shard_bytes):
            found, sizes = _search_shard(split, index.value), np.array([len(w) for w in split], np.int64)
            columns = _verdicts(sizes, index.value.ids, found)
            for column, own in zip(made, columns + [_told(sizes, index.value.ids, found)] * locate):
                column += own
        return made

    return add_columns(docs, judge, fields, ["text"], keep)


def _in_parts(docs: DataFrame, pieces: DataFrame, parts: int, window: int, locate: bool, keep: list[str] | None,
              shard_bytes: int, fields: list[T.StructField]) -> DataFrame:
    """The same with one index after another; each reads the texts and leaves the matches of those that have some."""
    spark = docs.sparkSession
    pieces = staged(pieces.withColumn("part", F.pmod(F.xxhash64("item", "at", "words"), F.lit(parts))), "pieces")
    some = None
    for part in range(parts):
        own = BenchmarkIndex([tuple(r) for r in pieces.filter(F.col("part") == part).drop("part").collect()], window)
        index = spark.sparkContext.broadcast(own)

        def match(text: pa.Array, index=index) -> list:
            told: list[list[dict]] = []
            for _, split in _shards(text, shard_bytes):
                sizes = np.array([len(w) for w in split], np.int64)
                told += _told(sizes, index.value.ids, _search_shard(split, index.value))
            return [told]

        texts = docs.select("text", F.md5(F.col("text")).alias("llm_key"))
        found = add_columns(texts, match, [T.StructField("llm_found", MATCH)], ["text"], ["llm_key"])
        # Copies of a text are one before the exchange.
        found = staged(found.filter(F.size("llm_found") > 0).groupBy("llm_key").agg(F.first("llm_found").alias("llm_found")),
                       "matches")
        index.unpersist()
        some = found if some is None else some.unionByName(found)
    united = some.groupBy("llm_key").agg(F.flatten(F.collect_list("llm_found")).alias("llm_found"))
    joined = docs.withColumn("llm_key", F.md5(F.col("text"))).join(united, "llm_key", "left")

    def judge(text: pa.Array, matches: pa.Array) -> list:
        sizes = np.array([len(w) for _, split in _shards(text, shard_bytes) for w in split], np.int64)
        given = [(d, m) for d, row in enumerate(matches.to_pylist()) for m in row or []]
        names = sorted({m["item_id"] for _, m in given})
        number = {name: k for k, name in enumerate(names)}
        found = longest(np.array([d for d, _ in given], np.int64),
                        np.array([number[m["item_id"]] for _, m in given], np.int64),
                        *(np.array([m[c] for _, m in given], np.int64) for c in ("item_word", "doc_word", "n_words")))
        return _verdicts(sizes, names, found) + [_told(sizes, names, found)] * locate

    return add_columns(joined, judge, fields, ["text", "llm_found"], docs.columns if keep is None else keep)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the contaminated rows, all columns as they were."""
    marked = find_contamination(docs.withColumn("llm_all", F.struct(*docs.columns)), benchmark, window,
                                keep=["llm_all"])
    return marked.filter(~F.col("contaminated")).select("llm_all.*")


def oracle(window: int = WINDOW) -> str:
    """The same rows in DuckDB's SQL: every window of every document against those of the items."""
    words = (rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), "
             r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
    return rf"""
WITH docs AS (SELECT doc_id, {words} AS w FROM documents),
items AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {words} AS w FROM benchmark),
wanted AS (
  SELECT DISTINCT item, least({window}, len(w)) AS n, list_slice(w, i, i + least({window}, len(w)) - 1) AS win
  FROM items, unnest(range(1, greatest(len(w) - {window - 1}, 1) + 1)) AS t(i) WHERE len(w) > 0),
found AS (
  SELECT d.doc_id, i, s.n, x.item
  FROM docs d, (SELECT DISTINCT n FROM wanted) s, unnest(range(1, len(d.w) - s.n + 2)) AS t(i)
  JOIN wanted x ON x.n = s.n AND x.win = list_slice(d.w, i, i + s.n - 1)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(n.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(n.names, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN hit h USING (doc_id) LEFT JOIN named n USING (doc_id)"""
