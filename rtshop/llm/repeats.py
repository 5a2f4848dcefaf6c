"""Removal of repeated passages with longest-previous-factor arrays.

Every byte covered by a string of ``length`` bytes that also starts in a document with a smaller id is removed; the
first copy stays. The work is exact and distributed:

1. Anchors. Each window of ``length`` bytes is owned by one of its ``gram``-byte strings, the one of smallest hash (the
   leftmost of equals). Equal windows have equal owners at equal places, so all that can be said of a window can be said
   among the fragments around owners of one hash. A fragment is the stretch of the windows that an anchor owns.
2. Filter. Hashes that occur once cannot repeat. Tasks send the distinct hashes of their anchors, four bytes each, by
   bucket; a bucket marks those met twice in its slice of a bit filter, which grows with the text up to a fixed size.
   The filter only saves work: a false mark costs a comparison, and when the corpus outgrows it more are compared.
3. Fragments that pass are reduced, by a hash of 64 bits beside the anchor's own, to distinct ones with the smallest
   document id. A later document of the same fragment loses all its windows.
4. Previous factors. Where an anchor has different fragments, their bytes are gathered and put into a suffix array; the
   nearest smaller document before and after a window's start in suffix order bound its longest previous factor. Where
   it reaches ``length``, the first document of the fragment loses the window as well. An anchor with more than
   ``GROUP`` distinct fragments is not brought together: its windows are grouped by content.
5. The places are collected by document, and the text is cut where it is.

Defined results
---------------
* Null text is empty; texts shorter than ``length`` lose nothing and take nothing from others.
* Rows with equal ``doc_id`` are one document for the order: they take nothing from each other. Rows without an id take
  no part, nothing is removed from them or because of them.
* An empty table gives an empty result. Other columns are dropped, or pass through where kept.
* Long texts are worked off in blocks; only the cut itself needs a text as one piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rtshop.functions.joins import broadcast_if_small
from rtshop.llm.common import add_columns, discard, release, slices, staged

LENGTH = 50
GRAM = 24
MASK = 63  # windows that share an anchor and are told by one mask
BLOCK_BYTES = 1_000_000
# Largest size of a bit filter, and how many bytes of text ask for one byte of it.
FILTER_BYTES = 64 * 1024 * 1024
TEXT_PER_BYTE = 100
# Distinct fragments of one anchor that a task compares at once: some 30 MB of windows.
GROUP = 20_000
# Odd multiplier of the rolling hash and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2 ** 64)


# --- Anchors ------------------------------------------------------------------------------------------------------

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, 0 to n - 1 at least."""
    size = 1 << max(10, (n - 1).bit_length())
    if size not in _powers:
        made = []
        for base in (BASE, INVERSE):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            made.append(np.multiply.accumulate(row))
        _powers.clear()
        _powers[size] = tuple(made)
    return _powers[size]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A mixed 64-bit hash of the ``gram`` bytes from each place on."""
    up, down = powers(len(data))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[:len(data) - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    have = 1
    low = x
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    return low if have == width else np.minimum(low[:len(x) - width + 1], low[width - have:])


def anchors(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(hash, first window, last window, place) of every anchor in texts that follow each other and end at ``ends``."""
    none = np.empty(0, np.int64)
    if len(data) < length:
        return none.astype(np.uint64), none, none, none
    h = gram_hashes(data, gram)
    width = length - gram + 1
    # The high half of the hash decides, then the place: a minimum is also its own place.
    keys = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    owner = (sliding_minimum(keys, width) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # Windows that would cross the end of a text are none.
    valid = np.ones(len(owner), bool)
    cross = (ends[:-1, None] - np.arange(1, length)).ravel()
    valid[cross[(cross >= 0) & (cross < len(valid))]] = False
    at = np.flatnonzero(valid)
    if not len(at):
        return none.astype(np.uint64), none, none, none
    new = np.ones(len(at), bool)
    new[1:] = (owner[at[1:]] != owner[at[:-1]]) | (at[1:] != at[:-1] + 1)
    first = at[new]
    last = at[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(at) - 1]])]
    place = owner[first]
    return h[place], first, last, place


def blocks(texts: list[bytes], length: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, ends, number of the text, its offset) of pieces to work off at once.

    Short texts are put together; a long one is cut into pieces that overlap by less than a window.
    """
    pieces = []
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), size):
            pieces.append((k, at, text[at:at + size + length - 1]))
    for start, stop in slices([len(p[2]) for p in pieces], size):
        own = pieces[start:stop]
        ends = np.cumsum([len(p[2]) for p in own])
        yield (np.frombuffer(b"".join(p[2] for p in own), np.uint8), ends,
               np.array([p[0] for p in own], np.int64), np.array([p[1] for p in own], np.int64))


# --- The filter ---------------------------------------------------------------------------------------------------

def filter_bits(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of a hash in a slice of ``size`` bits."""
    short = h & np.uint64(0xFFFFFFFF)
    return (short % np.uint64(size)).astype(np.int64), ((short * np.uint64(BASE) >> np.uint64(20)) % np.uint64(size)).astype(np.int64)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def bit_filter(sent: DataFrame, buckets: int, size: int) -> list[bytes]:
    """Slices of a filter of ``size`` bytes that holds the hashes sent more than once.

    ``sent`` has ``bucket`` and ``short``, packed low halves of hashes. A bucket marks its own slice, so what the driver
    collects is the filter itself, of one size at any scale.
    """
    own = max(8, size // buckets)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for b, short in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(b, []).append(short)
        for b, parts in held.items():
            values = np.sort(np.frombuffer(b"".join(parts), "<u4"))
            twice = np.unique(values[1:][values[1:] == values[:-1]]).astype(np.uint64)
            bits = np.zeros(8 * own, np.uint8)
            for places in filter_bits(twice, 8 * own):
                bits[places] = 1
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())],
                                             names=["bucket", "bits"])

    marked = sent.repartition(buckets, "bucket").mapInArrow(mark, "bucket int, bits binary")
    found = {r["bucket"]: bytes(r["bits"]) for r in marked.collect()}
    return [found.get(b, bytes(own)) for b in range(buckets)]


def packed(h: np.ndarray, again: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Distinct hashes of a task by bucket; those in ``again`` were met twice here and are sent twice."""
    which = bucket_of(h, buckets)
    order = np.argsort(which, kind="stable")
    ends = np.searchsorted(which[order], np.arange(buckets + 1))
    for b in range(buckets):
        rows = order[ends[b]:ends[b + 1]]
        if len(rows):
            short = np.concatenate([h[rows], h[rows[again[rows]]]]).astype("<u4")
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([short.tobytes()], pa.binary())],
                                             names=["bucket", "short"])


def anchor_filter(rows: DataFrame, length: int, gram: int, buckets: int, size: int) -> list[bytes]:
    """Filter of the anchor hashes that occur more than once."""
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray] = []
        for batch in batches:
            for data, ends, _, _ in blocks(batch.column(0).to_pylist(), length, BLOCK_BYTES):
                seen.append(anchors(data, ends, length, gram)[0])
        if seen:
            values, counts = np.unique(np.concatenate(seen), return_counts=True)
            yield from packed(values, counts > 1, buckets)

    return bit_filter(rows.select("text").mapInArrow(gather, "bucket int, short binary"), buckets, size)


def mixed_filter(firsts: DataFrame, buckets: int, size: int) -> list[bytes]:
    """Filter of the anchor hashes around which there are different fragments. ``firsts`` has each fragment once."""
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [batch.column(0).to_numpy() for batch in batches]
        if seen:
            values, counts = np.unique(np.concatenate(seen).view(np.uint64), return_counts=True)
            yield from packed(values, counts > 1, buckets)

    return bit_filter(firsts.select("h").mapInArrow(gather, "bucket int, short binary"), buckets, size)


def passes(h: np.ndarray, slices_of: list[bytes]) -> np.ndarray:
    """Whether hashes are in the filter."""
    table = np.frombuffer(b"".join(slices_of), np.uint8).reshape(len(slices_of), -1)
    b = bucket_of(h, len(table))
    keep = np.ones(len(h), bool)
    for places in filter_bits(h, 8 * table.shape[1]):
        keep &= (table[b, places >> 3] >> (7 - (places & 7)).astype(np.uint8) & 1).astype(bool)
    return keep


# --- Previous factors ---------------------------------------------------------------------------------------------

def nearest_smaller(rank: list[int], common: list[int]) -> list[int]:
    """Common prefix of each suffix with the nearest one before it, in suffix order, that has a smaller document."""
    found, stack, shared = [0] * len(rank), [], []
    for i, doc in enumerate(rank):
        here = common[i - 1] if i else 0
        while stack and stack[-1] >= doc:
            stack.pop()
            here = min(here, shared.pop())
        found[i] = here if stack else 0
        stack.append(doc)
        shared.append(here)
    return found


def previous_factors(suffixes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Longest previous factor of each suffix: the longest prefix that it shares with a suffix of a smaller document.

    ``suffixes`` is a matrix of bytes, cut at its width. In suffix order, only the nearest smaller document before and
    the nearest after a suffix need a look; what they share with it is the least common prefix on the way.
    """
    n, width = suffixes.shape
    if not n:
        return np.empty(0, np.int64)
    keys = np.ascontiguousarray(suffixes).view(f"S{width}").ravel()
    order = np.argsort(keys, kind="stable")
    rows = suffixes[order]
    differ = rows[1:] != rows[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width).tolist()
    rank = docs[order].tolist()
    before = nearest_smaller(rank, common)
    after = nearest_smaller(rank[::-1], common[::-1])[::-1]
    out = np.empty(n, np.int64)
    out[order] = np.maximum(before, after)
    return out


def factor_masks(fragments: list[bytes], docs: np.ndarray, length: int) -> np.ndarray:
    """For each fragment, a bit for each of its windows that a smaller document holds too."""
    sizes = np.fromiter(map(len, fragments), np.int64, len(fragments))
    counts = sizes - length + 1
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(fragments)), counts)
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    flat = np.frombuffer(b"".join(fragments), np.uint8)
    windows = np.lib.stride_tricks.sliding_window_view(flat, length)[starts[owner] + inside]
    earlier = previous_factors(windows, docs[owner]) >= length
    masks = np.zeros(len(fragments), np.int64)
    np.bitwise_or.at(masks, owner[earlier], np.int64(1) << inside[earlier])
    return masks


def _factor_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(h, k, fragment, first) in order of h to (k, mask) with windows that are found earlier; groups are never cut."""
    def solve(rows: list[tuple]) -> pa.RecordBatch:
        h, k, fragments, first = map(list, zip(*rows))
        _, group, count = np.unique(np.array(h, np.int64), return_inverse=True, return_counts=True)
        some = np.flatnonzero(count[group] > 1)
        masks = np.zeros(len(rows), np.int64)
        if len(some):
            masks[some] = factor_masks([fragments[i] for i in some], np.array(first, np.int64)[some], length)
        hit = np.flatnonzero(masks)
        return pa.RecordBatch.from_arrays([pa.array(np.array(k, np.int64)[hit]), pa.array(masks[hit])], names=["k", "mask"])

    held: list[tuple] = []
    for batch in batches:
        held += zip(*(c.to_pylist() for c in batch.columns))
        cut = len(held)
        while cut and held[cut - 1][0] == held[-1][0]:
            cut -= 1
        if cut:
            yield solve(held[:cut])
            held = held[cut:]
    if held:
        yield solve(held)


# --- The operator -------------------------------------------------------------------------------------------------

def _anchored(rows: DataFrame, held, length: int, gram: int, with_bytes: bool) -> DataFrame:
    """Fragments of ``rows`` (``doc_id, tie, text``) whose anchor passes the broadcast filter ``held``.

    Without bytes ``k, h, n, doc_id, at``: hash of the fragment, of the anchor, number of windows, and the place, that
    is the first window and the row's tie in one long. With bytes ``h, doc_id, fragment``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ties = (np.array(c.to_pylist(), np.int64) for c in batch.columns[:2])
            for data, ends, number, offset in blocks(batch.column(2).to_pylist(), length, BLOCK_BYTES):
                h, first, last, _ = anchors(data, ends, length, gram)
                keep = passes(h, held.value)
                h, first, last = h[keep], first[keep], last[keep]
                piece = np.searchsorted(ends, first, "right")
                raw = data.tobytes()
                cut = [raw[a:b] for a, b in zip(first.tolist(), (last + length).tolist())]
                owner = number[piece]
                if with_bytes:
                    columns = [pa.array(h.view(np.int64)), pa.array(ids[owner]), pa.array(cut, pa.binary())]
                else:
                    k = np.fromiter(map(xxhash.xxh64_intdigest, cut), np.uint64, len(cut)).view(np.int64)
                    at = first - np.concatenate([[0], ends[:-1]])[piece] + offset[piece]
                    columns = [pa.array(c) for c in (k, h.view(np.int64), last - first + 1, ids[owner],
                                                     at << 32 | ties[owner] & 0xFFFFFFFF)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "h long, doc_id long, fragment binary" if with_bytes else "k long, h long, n long, doc_id long, at long"
    names = [f.split()[0] for f in schema.split(", ")]
    return rows.mapInArrow(run, schema)


def _factors(rows: DataFrame, firsts: DataFrame, buckets: int, length: int, gram: int, filter_bytes: int,
             group: int) -> DataFrame:
    """``k, mask`` of the fragments with windows that an earlier document holds within another fragment."""
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast(mixed_filter(firsts, buckets, filter_bytes))
    distinct = staged(_anchored(rows, held, length, gram, True).groupBy("h", "fragment").agg(F.min("doc_id").alias("first")),
                      "distinct")
    held.destroy()
    crowded = staged(distinct.groupBy("h").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > group).select("h"),
                     "crowded")
    release(spark)
    # Few as a rule, and then sent to the tasks, which spares a shuffle of all fragments.
    side = broadcast_if_small(crowded)

    def with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = batch.column(1).to_pylist()
            k = np.fromiter(map(xxhash.xxh64_intdigest, cut), np.uint64, len(cut)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(k), *batch.columns[1:]],
                                             names=["h", "k", "fragment", "first"])

    keyed = distinct.select("h", "fragment", "first").mapInArrow(with_key, "h long, k long, fragment binary, first long")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    calm = (keyed.join(side, "h", "left_anti").repartition(n, "h").sortWithinPartitions("h")
            .mapInArrow(lambda batches: _factor_rows(batches, length), "k long, mask long"))
    # Windows of anchors with very many fragments, one by one: the smallest document of each content.
    place = F.explode(F.sequence(F.lit(0), F.length("fragment") - length))
    single = (keyed.join(side, "h", "left_semi").select("k", "first", "fragment", place.alias("j"))
              .select("k", "first", "j", F.expr(f"substring(fragment, j + 1, {length})").alias("window")))
    lowest = single.groupBy("window").agg(F.min("first").alias("lowest"))
    many = (single.join(lowest, "window").filter(F.col("lowest") < F.col("first"))
            .groupBy("k").agg(F.bit_or(F.expr("shiftleft(1L, j)")).alias("mask")))
    made = staged(calm.union(many), "factors")
    discard(distinct, crowded)
    return made


def repeated_windows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, filter_bytes: int = FILTER_BYTES,
                     group: int = GROUP) -> DataFrame:
    """``doc_id, tie, lost``: for each row of ``docs`` with windows that start in a smaller document too, where they are.

    ``tie`` is the low half of a hash of the text; ``lost`` lists (first window, mask): bit j of the mask says that the
    window j bytes on is found earlier. Each step is staged, and what it shuffled is released before the next. A mask has
    ``MASK`` bits, so ``length`` may exceed ``gram`` by less than that.
    """
    if not 0 <= length - gram < MASK:
        raise ValueError(f"length {length} must exceed gram {gram} by less than {MASK}")
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _tie().alias("tie"),
                       F.col("text").cast("binary").alias("text")).filter("doc_id is not null and text is not null")
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    filter_bytes = min(filter_bytes, max(1 << 16, size // TEXT_PER_BYTE))
    held = spark.sparkContext.broadcast(anchor_filter(rows, length, gram, buckets, filter_bytes))
    found = staged(_anchored(rows, held, length, gram, False), "anchors")
    held.destroy()
    release(spark)
    firsts = staged(found.groupBy("k", "h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"),
                                                F.first("n").alias("n")), "firsts")
    release(spark)
    masks = _factors(rows, firsts, buckets, length, gram, filter_bytes, group)
    release(spark)
    known = (firsts.join(masks, "k", "left").filter((F.col("first") < F.col("last")) | F.col("mask").isNotNull())
             .select("k", "h", "first", F.expr("shiftleft(1L, cast(n as int)) - 1").alias("all"), F.coalesce("mask", F.lit(0)).alias("mask")))
    # A later document of a fragment loses all of its windows, the first one those with a previous factor.
    mask = F.when(F.col("doc_id") > F.col("first"), F.col("all")).otherwise(F.col("mask"))
    lost = found.select("k", "h", "doc_id", "at").join(known, ["k", "h"]).select("doc_id", "at", mask.alias("mask"))
    by_row = staged(lost.filter("mask != 0").groupBy("doc_id", F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).alias("tie")).agg(
        F.collect_list(F.struct(F.shiftright("at", 32).alias("first_window"), "mask")).alias("lost")), "lost")
    discard(found, firsts, masks)
    release(spark)
    return by_row


def _tie():
    """Tells rows of one ``doc_id`` apart: the low half of a hash of the text."""
    return F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF))


FIELDS = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
          T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())]


def covered_bytes(size: int, lost: list[tuple[int, int]], length: int) -> np.ndarray:
    """Whether each byte of a text lies in a window of ``lost``, given as (first window, mask)."""
    depth = np.zeros(size + 1, np.int64)
    if lost:
        first, mask = (np.array(c, np.int64) for c in zip(*lost))
        bits = (mask[:, None] >> np.arange(64)) & 1
        row, j = np.nonzero(bits)
        np.add.at(depth, first[row] + j, 1)
        np.add.at(depth, first[row] + j + length, -1)
    return np.cumsum(depth[:-1]) > 0


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = False,
                   filter_bytes: int = FILTER_BYTES, group: int = GROUP) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row; ``with_text`` adds ``kept``, the bytes left.

    The bytes left need not be valid UTF-8, since the cut is by bytes; that is why they are binary.
    """
    lost = repeated_windows(docs, length, gram, filter_bytes, group).select(
        F.col("doc_id").alias("lost_id"), F.col("tie").alias("lost_tie"), "lost")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), _tie().alias("tie"))
    joined = rows.join(lost, (F.col("doc_id").cast("long") == F.col("lost_id")) & (F.col("tie") == F.col("lost_tie")), "left")

    def cut(text: pa.Array, found: pa.Array) -> list:
        out = []
        for data, own in zip(text.to_pylist(), found.to_pylist()):
            gone = covered_bytes(len(data), [(w["first_window"], w["mask"]) for w in own or ()], length)
            left = np.frombuffer(data, np.uint8)[~gone].tobytes() if own else data
            spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            out.append((len(data), int(gone.sum()), spans, hashlib.sha256(left).hexdigest(), left))
        made = [list(c) for c in zip(*out)] or [[]] * 5
        return made if with_text else made[:4]

    fields = FIELDS + [T.StructField("kept", T.BinaryType())] * with_text
    return add_columns(joined, cut, fields, ["text", "lost"], ["doc_id"])


def oracle(length: int = LENGTH) -> str:
    """The same rows in DuckDB's SQL: every string of ``length`` bytes of every document, in hexadecimal digits."""
    return f"""
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, {2 * length}) AS s
  FROM docs, unnest(range(0, len(h) // 2 - {length - 1})) AS t(i)),
firsts AS (SELECT s, min(doc_id) AS first FROM strings GROUP BY s),
gone AS (
  SELECT DISTINCT doc_id, p FROM (
    SELECT x.doc_id, unnest(range(x.i, x.i + {length})) AS p FROM strings x JOIN firsts f USING (s) WHERE f.first < x.doc_id)),
counts AS (
  SELECT doc_id, count(*) AS n_removed, count(*) FILTER (before IS DISTINCT FROM p - 1) AS n_spans
  FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM gone) GROUP BY doc_id),
kept AS (
  SELECT b.doc_id, string_agg(substr(b.h, 2 * b.p + 1, 2), '' ORDER BY b.p) AS h
  FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2)) AS p FROM docs) b
  ANTI JOIN gone g ON g.doc_id = b.doc_id AND g.p = b.p GROUP BY b.doc_id)
SELECT d.doc_id, (len(d.h) // 2)::BIGINT AS n_bytes, coalesce(c.n_removed, 0)::BIGINT AS n_removed,
       coalesce(c.n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k.h, ''))) AS kept_sha256
FROM docs d LEFT JOIN counts c USING (doc_id) LEFT JOIN kept k USING (doc_id)"""
