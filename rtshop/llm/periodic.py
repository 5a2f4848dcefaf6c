"""Stretches of a text that repeat with a period (op 13).

Words are the runs ``[^\\x20\\x09-\\x0D]+`` of a text, numbered from 0. A run is a stretch of consecutive words whose smallest
period is ``q`` (words ``q`` apart are equal), at least ``max(24, 3 q)`` words long, which no neighbouring word extends.

Scales. Periods are taken by octaves, ``[S, 2 S)`` with ``S = 8, 16, 32, ...`` (the first holds periods 1 to 15). In an octave
a boundary stands at every multiple of ``S``; its tile is the words from ``S`` before to ``4 S`` after it, so tiles of neighbouring
boundaries overlap. Where a run of period ``q`` lies, ``w[i] = w[i + q]`` holds for an interval of at least ``2 S`` places ``i``,
which has two boundaries or more. A tile is solved on its own: the Z-function of its words from the boundary on tells how
far each period of the octave matches to the right, the Z-function of the reversed words how far to the left. That gives
fragments of intervals; fragments of neighbouring tiles overlap, and united they are the whole intervals.

A tile can have a period only if the eight words at its boundary come again within the octave's reach. Sorted hashes of
eight words tell so for all boundaries at once; only those tiles are solved.

Where the work is done. The words of a text of up to ``LONG`` code points are one window that holds all tiles of all octaves:
it is solved by the task that reads the text, and its fragments are united there. A longer text is exploded: rows of
``text key, octave, first boundary, words of the window`` are shuffled to any task, solved there, and the fragments are
shuffled by text key and period and united by a window over their starts. Copies of a long text are solved once. Nothing
depends on which of the two ways is taken.

Odd rows: null, empty and blank texts have no words and no runs. Repeated rows get the same result. Kept columns may have any
names; those that share a result's name are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rtshop.functions.joins import broadcast_if_small
from rtshop.llm.common import WORD, add_columns, staged

LEAST = 24
TIMES = 3
FIRST = 8
# Code points from which a text is exploded into rows of tiles, and words that a row's boundaries span at least.
LONG = 65_536
SPAN = 8192

RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])
RESULT = [T.StructField("runs", T.ArrayType(RUN, False)), T.StructField("collapsed", T.StringType())]
TILE_ROW = "llm_key string, octave long, first long, places long, at long, n_words long, ids binary"
_WORDS = re.compile(WORD)

Fragments = dict[int, list[tuple[int, int]]]


def word_ids(words: list[str]) -> np.ndarray:
    """Numbers of words, equal for equal words."""
    known: dict[str, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def octaves(n: int) -> list[int]:
    """The ``S`` of all octaves whose periods a text of ``n`` words can have."""
    found, size = [], FIRST
    while n >= LEAST and (size == FIRST or TIMES * size <= n):
        found.append(size)
        size *= 2
    return found


def _grams(ids: np.ndarray) -> np.ndarray:
    """A hash of the ``FIRST`` words at each place, by doubling; equal words have equal hashes."""
    with np.errstate(over="ignore"):
        h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
        reach = 1
        while reach < FIRST:
            h = (h[:-reach] ^ (h[:-reach] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[reach:]
            reach *= 2
        return h ^ (h >> np.uint64(31))


def _z(s: list[int], most: int) -> list[int]:
    """Z-function: for each place below ``most`` how many items from there on equal those from the beginning on."""
    n = len(s)
    z, left, right = [n] + [0] * (most - 1), 0, 0
    for i in range(1, most):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def solve_tile(ids: list[int], place: int, size: int) -> Iterator[tuple[int, int, int]]:
    """``period, begin, end`` of matches around ``place`` that reach ``size`` to its right; places are those of ``ids``."""
    low, high = (1 if size == FIRST else size), 2 * size
    right = ids[place:place + 4 * size]
    forward = _z(right, min(high, len(right)))
    periods = [q for q in range(low, len(forward)) if forward[q] >= size]
    if not periods:
        return
    before = ids[max(0, place - size):place]
    before.reverse()
    if before:
        ahead = ids[max(0, place - size):place + periods[-1]]
        ahead.reverse()
        # Nothing equals the mark between the two: matches end there.
        joined = [*before, -1, *ahead]
        backward = _z(joined, len(before) + 1 + periods[-1] - periods[0] + 1)
    for q in periods:
        back = backward[len(before) + 1 + periods[-1] - q] if before else 0
        yield q, place - back, place + min(forward[q], 2 * size)


def _united(pieces: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Intervals made of pieces that overlap or touch."""
    out: list[list[int]] = []
    for begin, end in sorted(pieces):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [(b, e) for b, e in out]


def solve(ids: np.ndarray, sizes: list[int], first: int = 0, places: int | None = None, at: int = 0) -> Fragments:
    """Fragments of all tiles of ``sizes`` with a boundary in ``first, first + size, ...`` (``places`` of them at most).

    ``ids`` are the words from number ``at`` of the text on. Octaves go upwards: a tile that lies in a stretch of a smaller
    period is left out, since by the theorem of Fine and Wilf all that it could add are multiples of that period.
    """
    grams = _grams(ids) if len(ids) >= FIRST else np.empty(0, np.uint64)
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    if not len(ranked) or not (ranked[1:] == ranked[:-1]).any():
        return {}
    # Number of each gram in sorted order, then one sorted key of gram and place.
    number = np.empty(len(grams), np.int64)
    number[order] = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1])))
    width = 2 * len(grams) + 4 * max(sizes) + 1
    keys = number[order] * width + order
    plain = ids.tolist()
    found: Fragments = {}
    # Stretches of words that have a period of an octave before.
    covered: list[tuple[int, int, int]] = []
    for size in sizes:
        bound = np.arange(first - at, len(grams), size)[:places]
        low = 1 if size == FIRST else size
        want = number[bound] * width + bound + low
        spot = np.searchsorted(keys, want)
        near = spot < len(keys)
        near[near] = keys[spot[near]] <= want[near] + (2 * size - 1 - low)
        tiles = bound[near]
        for begin, end, period in covered:
            if period <= size:
                left = (np.maximum(tiles - size, 0) >= begin) & (np.minimum(tiles + 4 * size, len(ids)) <= end)
                tiles = tiles[~left]
        pieces: Fragments = {}
        for place in tiles.tolist():
            for q, begin, end in solve_tile(plain, place, size):
                pieces.setdefault(q, []).append((begin, end))
        wider = []
        for q, parts in pieces.items():
            # Of a multiple of a known period only pieces may be here, since tiles were left out.
            whole = [(b, e) for b, e in _united(parts) if not any(
                q % period == 0 and begin <= b and e + q <= end for begin, end, period in covered)]
            if whole:
                found[q] = [(b + at, e + at) for b, e in whole]
            wider += [(b, e + q, q) for b, e in whole if e - b >= 2 * q and e - b + q >= LEAST]
        covered += wider
    return found


def runs_of(found: Fragments) -> list[tuple[int, int, int]]:
    """``start, length, period`` of the runs among whole intervals, by start and period."""
    smallest: dict[tuple[int, int], int] = {}
    for q, intervals in found.items():
        for begin, end in intervals:
            length = end - begin + q
            if length >= max(LEAST, TIMES * q):
                stretch = (begin, length)
                smallest[stretch] = min(smallest.get(stretch, q), q)
    return sorted((b, length, q) for (b, length), q in smallest.items())


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words that no run repeats, joined by one space: of each run its first period stays."""
    if not runs:
        return " ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return " ".join([w for w, k in zip(words, keep) if k])


def _struct(runs: list[tuple[int, int, int]]) -> list[dict]:
    return [{"start": s, "length": n, "period": q} for s, n, q in runs]


def _solved(texts: pa.Array) -> list[list]:
    """Runs and collapsed texts of whole texts."""
    runs, collapsed = [], []
    for text in texts.to_pylist():
        words = _WORDS.findall(text or "")
        found = runs_of(solve(word_ids(words), sizes)) if (sizes := octaves(len(words))) else []
        runs.append(_struct(found))
        collapsed.append(collapse(words, found))
    return [runs, collapsed]


def tile_rows(key: str, text: str, span: int = SPAN) -> Iterator[tuple]:
    """Rows of ``TILE_ROW`` for a text: for each octave, boundaries over at least ``span`` words with their window."""
    ids = word_ids(_WORDS.findall(text or "")).astype(np.int32)
    for size in octaves(len(ids)):
        places = max(1, span // size)
        for first in range(0, len(ids), places * size):
            at = max(0, first - size)
            window = ids[at:first + (places - 1) * size + 4 * size]
            if len(window) >= FIRST:
                yield key, size, first, places, at, len(ids), window.tobytes()


def _exploded(long_texts: DataFrame, span: int) -> DataFrame:
    """One row per octave and group of boundaries of each distinct text (``llm_key, llm_text``)."""
    names = [f.split()[0] for f in TILE_ROW.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Text by text: the windows of one text together are a few times its size.
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = list(tile_rows(key, text.as_py(), span))
                if rows:
                    columns = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(columns, [pa.string(), *[pa.int64()] * 5, pa.binary()])], names=names)

    return long_texts.select("llm_key", "llm_text").mapInArrow(cut, TILE_ROW)


def _fragments(tiles: DataFrame) -> DataFrame:
    """``llm_key, period, begin, end``: fragments of each row of tiles, united within the row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int32).astype(np.int64)
                found = solve(ids, [row["octave"]], row["first"], row["places"], row["at"])
                out += [(row["llm_key"], q, b, e) for q, parts in found.items() for b, e in parts]
            if out:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), *[pa.int64()] * 3])],
                                                 names=["llm_key", "period", "begin", "end"])

    return tiles.mapInArrow(run, "llm_key string, period long, begin long, end long")


def stitched(fragments: DataFrame) -> DataFrame:
    """``llm_key, period, begin, end``: fragments of a key and period united where they overlap or touch."""
    by_start = Window.partitionBy("llm_key", "period").orderBy("begin", "end")
    seen = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    starts = fragments.withColumn("new", (seen.isNull() | (F.col("begin") > seen)).cast("int"))
    numbered = starts.withColumn("part", F.sum("new").over(by_start))
    return numbered.groupBy("llm_key", "period", "part").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("part")


def long_runs(long_texts: DataFrame, span: int = SPAN) -> DataFrame:
    """``llm_key, runs`` of long texts (``llm_key, llm_text``) that have runs, tile rows solved by any task."""
    rows = _exploded(long_texts, span)
    once = rows.groupBy("llm_key", "octave", "first").agg(
        *[F.first(c).alias(c) for c in ("places", "at", "n_words", "ids")])
    whole = stitched(_fragments(once))
    length = F.col("end") - F.col("begin") + F.col("period")
    runs = (whole.withColumn("length", length)
            .filter(F.col("length") >= F.greatest(F.lit(LEAST), TIMES * F.col("period")))
            .groupBy("llm_key", F.col("begin").alias("start"), "length").agg(F.min("period").alias("period")))
    return runs.groupBy("llm_key").agg(
        F.array_sort(F.collect_list(F.struct("start", "length", "period"))).alias("llm_runs"))


def _key(text: Column) -> Column:
    return F.sha2(text, 256)


def periodic_runs(docs: DataFrame, text: str = "text", long: int = LONG, span: int = SPAN) -> DataFrame:
    """``docs`` with ``runs`` (array of start, length, period, by start) and ``collapsed``, the text without repeats."""
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    kept = [c for c in docs.columns if c not in ("runs", "collapsed")]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("llm_row") if kept else F.lit(0).alias("llm_row"),
                         value.alias("llm_text"))
    out = [*[F.col("llm_row")[c].alias(c) for c in kept], "runs", "collapsed"]
    short = add_columns(packed.filter(F.length("llm_text") <= long), _solved, RESULT, ["llm_text"], ["llm_row"])
    rest = packed.filter(F.length("llm_text") > long).withColumn("llm_key", _key(F.col("llm_text")))
    runs = staged(long_runs(rest.select("llm_key", "llm_text"), span), "long-runs")
    joined = rest.join(broadcast_if_small(runs), "llm_key", "left")
    wide = add_columns(joined, _collapsed, RESULT, ["llm_text", "llm_runs"], ["llm_row"])
    return short.select(*out).unionByName(wide.select(*out))


def _collapsed(texts: pa.Array, runs: pa.Array) -> list[list]:
    found = [r or [] for r in runs.to_pylist()]
    lists = [[(r["start"], r["length"], r["period"]) for r in own] for own in found]
    return [found, [collapse(_WORDS.findall(t), own) for t, own in zip(texts.to_pylist(), lists)]]
