"""SimHash fingerprints and exact near-duplicate classes by tiled comparison.

Fingerprints are computed where the text is; from there on only 64-bit numbers travel. Equal fingerprints collapse to
one. The distinct ones are dealt into tiles by the bit counts of their two halves; two fingerprints within radius r have
half counts that differ by r in sum at most, so only tiles whose counts are that close are compared, each pair of tiles
whole: numpy exclusive-or, bit count, threshold. No fingerprint pair within the radius is missed, and tile pairs are
found by an equality join on the counts, not by a cross join.

What a tile pair links is reduced to a spanning forest before it leaves the task, so a class of k texts gives in the
order of k links, not k squared. Work is quadratic in distinct fingerprints, with a small constant (about 0.4 ns for
each pair that the counts do not skip); other bands would need a method other than this one.

Defined results
---------------
* Null and blank texts have no words: fingerprint zero, linked like any other. Fewer words than ``shingle``: the whole
  sequence is the one shingle.
* Repeated rows each get their row. ``component_id`` is the smallest ``doc_id`` reachable, null if all are null.
* An empty table gives an empty result. Other columns of ``docs`` are dropped, or pass through where kept.
* A long text is hashed in one piece of memory a few times its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rtshop.llm.common import add_columns, staged
from rtshop.llm.components import components

SHINGLE = 4
RADIUS = 4
SEED = 42
TILE = 1024
# Tiles that one join key may bring together on the probed side; more are dealt over further keys.
TILES_A_KEY = 64
ROWS = 64


def text_fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash over word shingles, repeats counted. ``bytes.lower`` changes A to Z only."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(shingle, len(words))
    parts = map(joined.__getitem__, map(slice, starts[:len(words) - size + 1].tolist(), ends[size - 1:].tolist()))
    n = len(words) - size + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 100_000):
        bits = np.unpackbits(hashes[at:at + 100_000].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1,
                             bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """Add ``simhash``, the fingerprint as a signed long."""

    def make(text: pa.Array) -> list:
        prints = [text_fingerprint(t, shingle) for t in text.cast(pa.large_binary()).to_pylist()]
        return [pa.array(np.array(prints, np.uint64).view(np.int64))]

    return add_columns(docs, make, [T.StructField("simhash", T.LongType())], ["text"], keep)


def forest(u: np.ndarray, v: np.ndarray, size: int) -> np.ndarray:
    """Label of each of ``size`` nodes: the smallest node linked to it over any path of links (u, v)."""
    labels = np.arange(size)
    while True:
        before = labels.copy()
        low = np.minimum(labels[u], labels[v])
        np.minimum.at(labels, u, low)
        np.minimum.at(labels, v, low)
        labels = labels[labels]
        if (labels == before).all():
            return labels


def tile_links(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between two tiles of unsigned fingerprints as a spanning forest: (fingerprint, fingerprint)."""
    both = np.concatenate([left, right])
    u, v, size = [], [], 0
    for at in range(0, len(left), ROWS):
        near = np.bitwise_count(left[at:at + ROWS, None] ^ right) <= radius
        if near.any():
            i, j = np.nonzero(near)
            u.append(i + at)
            v.append(j + len(left))
            size += len(i)
            if size > 8 * len(both):
                labels = forest(np.concatenate(u), np.concatenate(v), len(both))
                u, v, size = [np.arange(len(both))], [labels], len(both)
    if not u:
        return both[:0], both[:0]
    labels = forest(np.concatenate(u), np.concatenate(v), len(both))
    moved = np.flatnonzero(labels != np.arange(len(both)))
    moved = moved[both[moved] != both[labels[moved]]]
    return both[moved], both[labels[moved]]


def near_links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``a, b``: links that connect what lies within ``radius`` bits, of the distinct longs ``simhash`` in ``prints``."""
    spark = prints.sparkSession
    counted = prints.select("simhash", F.bit_count(F.col("simhash").bitwiseAND(F.lit(0xFFFFFFFF))).alias("p"),
                            F.bit_count(F.shiftrightunsigned("simhash", 32)).alias("q"))
    # At most 33 x 33 rows, whatever the input.
    classes = counted.groupBy("p", "q").agg(F.ceil(F.count(F.lit(1)) / tile).alias("chunks"))
    most = classes.agg(F.max("chunks")).first()[0] or 1
    salts = -(-int(most) // TILES_A_KEY)
    tiles = staged(counted.join(F.broadcast(classes), ["p", "q"])
                   .withColumn("chunk", F.pmod(F.xxhash64("simhash"), F.col("chunks")))
                   .groupBy("p", "q", "chunk").agg(F.collect_list("simhash").alias("prints")), "tiles")
    steps = [(a, b) for a in range(radius + 1) for b in range(-radius, radius + 1)
             if a + abs(b) <= radius and (a > 0 or b >= 0)]
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps]))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    left = (tiles.select("*", step.alias("step")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
            .select((F.col("p") + F.col("step.a")).alias("p"), (F.col("q") + F.col("step.b")).alias("q"), "salt",
                    F.when((F.col("step.a") == 0) & (F.col("step.b") == 0), F.col("chunk")).alias("own"),
                    F.col("prints").alias("left")))
    right = tiles.select("p", "q", F.pmod("chunk", F.lit(salts)).cast("int").alias("salt"), "chunk",
                         F.col("prints").alias("right"))
    # A fixed number of partitions: the rows are few and small, the work on their pairs is not.
    keys = ["p", "q", "salt"]
    pairs = (left.repartition(n, *keys).join(right.repartition(n, *keys), keys)
             .filter(F.col("own").isNull() | (F.col("own") <= F.col("chunk"))).select("left", "right"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, two in zip(batch.column(0), batch.column(1)):
                a, b = tile_links(*(x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in (one, two)), radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))],
                                                     names=["a", "b"])

    return pairs.mapInArrow(compare, "a long, b long")


def _rooted(docs: DataFrame, radius: int, shingle: int, kept: list[str]) -> tuple[DataFrame, DataFrame]:
    """(``kept`` columns and ``simhash`` of every row, ``simhash, first, root`` of every fingerprint).

    The root, the smallest fingerprint of a class, names it; ``first`` is the fingerprint's smallest ``doc_id``.
    """
    prints = staged(fingerprints(docs, shingle, keep=kept), "simhash")
    first = staged(prints.groupBy("simhash").agg(F.min("doc_id").alias("first")), "prints")
    roots = staged(components(near_links(first, radius)), "roots")
    rooted = first.join(roots, F.col("simhash") == F.col("node"), "left").select(
        "simhash", "first", F.coalesce("root", "simhash").alias("root"))
    return prints, rooted


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE,
                    keep: list[str] | None = None) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs``, and the columns named in ``keep``."""
    kept = ["doc_id", *[c for c in keep or [] if c not in ("doc_id", "fingerprint", "component_id")]]
    prints, rooted = _rooted(docs, radius, shingle, kept)
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(lowest, "root").select("simhash", "component_id")
    return (prints.join(classes, "simhash")
            .select(*kept, F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id"))


def one_of_each(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each class, all columns as they were: the smallest ``doc_id``'s.

    Of rows that share it, or of a class without ids, one with the smallest hash of its text stays. Classes are told
    apart by their fingerprints, so those that share an id, or have none, each keep a row.
    """
    prints, rooted = _rooted(docs.withColumn("llm_tie", F.xxhash64("text")), radius, shingle, ["doc_id", "llm_tie"])
    # The winner of a class, as (id, hash of the text): aggregated before the shuffle.
    winners = prints.join(rooted.select("simhash", "root"), "simhash").groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "llm_tie")).alias("w"))
    key = lambda doc_id, tie: F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), tie.cast("string"))
    winners = winners.select(key(F.col("w.doc_id"), F.col("w.llm_tie")).alias("llm_key"))
    rows = docs.select(F.struct(*docs.columns).alias("llm_row"),
                       key(F.col("doc_id"), F.xxhash64("text")).alias("llm_key"))
    # Equal ids with equal texts are one document; the join has already brought them together.
    return rows.join(winners, "llm_key").groupBy("llm_key").agg(F.first("llm_row").alias("r")).select("r.*")
