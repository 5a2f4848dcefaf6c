"""Mixing sources to target weights with Pareto order sampling.

Each source gets a target in words. Every document is first given the whole copies that are certain; what is then still
missing to the target is drawn without replacement: a document gets an inclusion probability p, a uniform number u from
a hash of its id and text, and the rank (u / (1 - u)) / (p / (1 - p)). The documents of smallest rank are taken until their words
fill the rest. That is a Pareto sample of fixed size (in words) with unequal probabilities: p grows with the document's
length class, and is 1 for the classes for which it would exceed 1, whose extra copy is certain too.

The order statistics are found without sorting a source: words are summed by source and bucket of the rank, the bucket
in which the target falls is the only one that is ranked, and there rows of one rank, that is copies, are drawn by their
number. So no task gets a whole source or a large group of copies.

Defined results
---------------
* Null text has size 0. Sources are in code-point order, null last, and null is a source of its own.
* A source without words has target 0. Documents of size 0 are never taken.
* Equal ranks are ordered by ``doc_id`` (null first), then size. Rows that repeat have equal ranks; which of them are
  taken makes no difference to the multiset of rows. A null ``doc_id`` hashes as "", so rows without id differ by text.
  Of rows with one id and text that differ in other columns, those first in the staged table are taken.
* An empty table gives an empty result. More than ``MAX_SOURCES`` sources raise: weights are set by people, by source.
"""

from __future__ import annotations

from math import floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rtshop.llm.common import count_words, staged

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
SEED = "mix"
BUCKETS = 4096
# The table of sources is small by contract; it is held by the driver and sent to the tasks.
MAX_SOURCES = 100_000
DIGITS = 13  # hexadecimal digits of the hash: 52 bits, exact in a double


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, most: int = MOST_COPIES) -> dict[str | None, float]:
    """Words for each source: shares of all words by weight, none above ``most`` times its size.

    The excess of capped sources goes to the others by weight, again and again, in whole-number arithmetic.
    """
    ordered = sorted((s for s, _ in sizes if s is not None)) + [None] * any(s is None for s, _ in sizes)
    size = dict(sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(ordered)}
    capped: set[str | None] = set()
    while True:
        rest = sum(size.values()) - most * sum(size[s] for s in capped)
        total = sum(weight[s] for s in ordered if s not in capped)
        above = {s for s in ordered if s not in capped and weight[s] * rest > most * size[s] * total}
        if not above:
            break
        capped |= above
    return {s: float(most * size[s]) if s in capped else float(weight[s] * rest) / total for s in ordered}


def inclusion(words_by_class: dict[int, int], missing: float) -> float:
    """The factor f for which p = min(1, f * class) makes the expected words of the draw equal to ``missing``."""
    certain = 0
    classes = sorted((c for c, w in words_by_class.items() if w), reverse=True)
    for k, c in enumerate(classes):
        rest = sum(x * words_by_class[x] for x in classes[k:])
        factor = (missing - certain) / rest
        if factor * c <= 1:
            return factor
        certain += words_by_class[c]
    return 1.0


def length_class(size: Column) -> Column:
    """Number of binary digits of the size: the unequal part of the inclusion odds."""
    return F.length(F.bin(size))


def uniform(doc_id: Column, text: Column) -> Column:
    """A number strictly between 0 and 1 that depends on the id and the text alone."""
    parts = [F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))]
    bits = F.conv(F.substring(F.md5(F.concat(*parts)), 1, DIGITS), 16, 10).cast("double")
    return (bits + 0.5) / float(16 ** DIGITS)


def _by_source(rows: DataFrame, found: DataFrame, shape: str | T.StructType) -> DataFrame:
    """``rows`` with what was found for their source, one row for each source, so ``MAX_SOURCES`` at most; else null."""
    fields = (T._parse_datatype_string(shape) if isinstance(shape, str) else shape).fields
    source = T.StructField("found_source", rows.schema["mix_source"].dataType)
    side = rows.sparkSession.createDataFrame(found.collect(), T.StructType([source, *fields]))
    return rows.join(F.broadcast(side), F.col("mix_source").eqNullSafe(F.col("found_source")), "left").drop("found_source")


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES, keep: list[str] | None = None) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies`` of every row, and the columns named in ``keep``.

    ``taken`` is ``copies`` times ``size``. A source's taken words differ from its target by half a document at most.
    """
    spark = docs.sparkSession
    kept = [c for c in keep or [] if c not in ("doc_id", "size", "source_size", "target", "taken", "copies")]
    # Counted once; from here on no text is read. The upper bits of ``place`` are the task that wrote the row.
    sized = staged(docs.select("doc_id", F.col("source").alias("mix_source"), *kept,
                               count_words(F.col("text")).cast("long").alias("size"),
                               uniform(F.col("doc_id"), F.col("text")).alias("u"),
                               F.monotonically_increasing_id().alias("place")), "sizes")
    by_class = (sized.groupBy("mix_source", length_class(F.col("size")).alias("c"))
                .agg(F.sum("size").alias("words")).limit(64 * MAX_SOURCES + 1).collect())
    words: dict[str | None, dict[int, int]] = {}
    for row in by_class:
        words.setdefault(row["mix_source"], {})[row["c"]] = row["words"]
    if len(words) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes = {s: sum(own.values()) for s, own in words.items()}
    plan = []
    for source, target in targets(list(sizes.items()), weights, most).items():
        size = sizes[source]
        whole = min(most, floor(target / size)) if size else 0
        missing = max(0.0, target - whole * size) if whole < most else 0.0
        plan.append((source, size, target, whole, missing, inclusion(words[source], missing) if missing else 0.0))
    schema = "goal_source string, source_size long, target double, whole long, missing double, factor double"
    goals = spark.createDataFrame(plan, schema)
    p = F.least(F.lit(1.0), F.col("factor") * length_class(F.col("size")))
    u = F.col("u")
    ranked = (sized.join(F.broadcast(goals), F.col("mix_source").eqNullSafe(F.col("goal_source")))
              .drop("goal_source")
              .withColumn("p", F.when(F.col("size") > 0, p).otherwise(F.lit(0.0))))
    # p = 1 ranks first whatever u is, in a bucket of its own, which never fills the rest; p = 0 has no rank.
    rank = F.when(F.col("p") >= 1.0, 0.0).when(F.col("p") > 0.0, (u / (1.0 - u)) / (F.col("p") / (1.0 - F.col("p"))))
    ranked = ranked.withColumn("rank", rank).withColumn(
        "bucket", F.when(F.col("p") >= 1.0, -1).otherwise(
            F.floor(F.col("rank") / (1.0 + F.col("rank")) * BUCKETS).cast("int")))
    # Words before each bucket of each source: a table of sources times BUCKETS.
    in_order = Window.partitionBy("mix_source").orderBy("bucket")
    sums = (ranked.filter("bucket is not null").groupBy("mix_source", "bucket")
            .agg(F.sum("size").alias("words"), F.first("missing").alias("missing"))
            .withColumn("until", F.sum("words").over(in_order)))
    # The first bucket that ends beyond what is missing; in those before it all is taken.
    cross = (sums.filter(F.col("until") > F.col("missing")).groupBy("mix_source")
             .agg(F.min(F.struct("bucket", (F.col("until") - F.col("words")).alias("before"))).alias("x"))
             .select("mix_source", "x.bucket", "x.before"))
    placed = _by_source(ranked, cross, "cross_bucket int, before long")
    inside = F.coalesce(F.col("bucket") == F.col("cross_bucket"), F.lit(False))
    # In that bucket the rows of one rank are one line with their number; the first that is not taken whole ends the draw.
    key = F.struct("rank", "doc_id", "size")
    earlier = Window.partitionBy("mix_source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("missing") - F.col("before") - F.coalesce(F.sum(F.col("n") * F.col("key.size")).over(earlier), F.lit(0))
    last = (placed.filter(inside).groupBy("mix_source", key.alias("key"))
            .agg(F.count("*").alias("n"), F.first("missing").alias("missing"), F.first("before").alias("before"))
            .withColumn("fits", F.greatest(F.lit(0), F.floor(room / F.col("key.size") + 0.5)).cast("long"))
            .filter("fits < n").groupBy("mix_source").agg(F.min(F.struct("key", "fits")).alias("x"))
            .select("mix_source", "x.key", "x.fits"))
    kind = T.StructType([T.StructField("last_key", last.schema["key"].dataType), T.StructField("fits", T.LongType())])
    placed = _by_source(placed, last, kind)
    tied = inside & (key == F.col("last_key"))
    # Of the rows of that line as many as fit are taken, by the tasks that wrote them; one such task's are numbered.
    task = F.shiftright("place", 33)
    tasks = (placed.filter(tied).groupBy("mix_source", task.alias("task"))
             .agg(F.count("*").alias("n"), F.first("fits").alias("fits"))
             .withColumn("left", F.col("fits") - F.coalesce(F.sum("n").over(
                 Window.partitionBy("mix_source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
             .filter(F.col("left") < F.col("n")).groupBy("mix_source").agg(F.min(F.struct("task", "left")).alias("x"))
             .select("mix_source", "x.task", "x.left"))
    placed = _by_source(placed, tasks, "last_task long, room long")
    numbered = F.coalesce(tied & (task == F.col("last_task")), F.lit(False))
    sure = placed.filter(~numbered).withColumn("drawn", F.when(
        inside, F.when(tied, task < F.col("last_task")).otherwise(F.coalesce(key < F.col("last_key"), F.lit(True))))
        .otherwise(F.coalesce(F.col("bucket") < F.col("cross_bucket"),
                              F.col("bucket").isNotNull() & F.col("cross_bucket").isNull())))
    edge = placed.filter(numbered).withColumn(
        "drawn", F.row_number().over(Window.partitionBy("mix_source").orderBy("place")) <= F.col("room"))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.when(F.col("drawn") & (F.col("missing") > 0), 1).otherwise(0)
                    ).otherwise(0)
    return (sure.unionByName(edge).withColumn("copies", copies.cast("long"))
            .select("doc_id", *kept, "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
                    "copies"))


def mixed_rows(docs: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, all columns as they were."""
    row = docs.withColumn("llm_row", F.struct(*docs.columns))
    taken = mix(row, weights, most, keep=["llm_row"])
    return taken.filter(F.col("copies") > 0).withColumn("n", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
        "llm_row.*")


def oracle(weights=WEIGHTS, most: int = MOST_COPIES) -> str:
    """The same rows in DuckDB's SQL, by prefix sums over whole sources."""
    weight = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))
    return rf"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS content,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} {weight} END AS weight
  FROM sized GROUP BY source),
-- Sources reach their cap in order of size by weight: find the first that does not.
points AS (
  SELECT *, row_number() OVER (ORDER BY {most}.0 * source_size / weight, source NULLS LAST) AS k FROM sources),
levels AS (
  SELECT p.*, (SELECT sum(source_size) FROM sources)
              - {most} * coalesce(sum(source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS total FROM points p),
water AS (SELECT min(k) AS k FROM levels WHERE weight * rest <= {most} * source_size * total),
goals AS (
  SELECT l.source, l.source_size,
         CASE WHEN l.k < w.k THEN ({most} * l.source_size)::DOUBLE
              ELSE (l.weight * f.rest)::DOUBLE / f.total::DOUBLE END AS target
  FROM levels l, water w, levels f WHERE f.k = w.k),
wholes AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least({most}, floor(target / source_size)::BIGINT) END AS whole FROM goals),
gaps AS (
  SELECT *, CASE WHEN whole < {most} THEN greatest(0.0, target - whole * source_size) ELSE 0.0 END AS missing FROM wholes),
classes AS (
  SELECT source, length(bin(size)) AS c, sum(size) AS words FROM sized GROUP BY ALL HAVING sum(size) > 0),
fill AS (
  SELECT k.source, k.c, g.missing,
         coalesce(sum(k.words) OVER (PARTITION BY k.source ORDER BY k.c DESC
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS certain,
         sum(k.c * k.words) OVER (PARTITION BY k.source ORDER BY k.c DESC
                                  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM classes k JOIN gaps g ON k.source IS NOT DISTINCT FROM g.source),
factors AS (
  SELECT source, (missing - certain) / rest AS factor FROM fill WHERE (missing - certain) / rest * c <= 1
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY c DESC) = 1),
odds AS (
  SELECT s.*, g.source_size, g.target, g.whole, g.missing,
         CASE WHEN s.size = 0 OR g.missing = 0 THEN 0.0
              ELSE least(1.0, coalesce(f.factor, 1.0) * length(bin(s.size))) END AS p,
         (('0x' || substr(md5('{SEED}' || coalesce(s.doc_id::VARCHAR, '') || ':' || s.content), 1, {DIGITS}))::BIGINT + 0.5)
           / {float(16 ** DIGITS)!r} AS u
  FROM sized s JOIN gaps g ON s.source IS NOT DISTINCT FROM g.source
  LEFT JOIN factors f ON s.source IS NOT DISTINCT FROM f.source),
ranks AS (
  SELECT *, CASE WHEN p >= 1.0 THEN 0.0 WHEN p > 0.0 THEN (u / (1.0 - u)) / (p / (1.0 - p)) END AS rank FROM odds),
drawn AS (
  SELECT *, p > 0 AND missing > 0 AND coalesce(sum(CASE WHEN p > 0 THEN size END) OVER (
           PARTITION BY source ORDER BY rank NULLS LAST, doc_id NULLS FIRST, size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2 <= missing AS one_more
  FROM ranks)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       (CASE WHEN size > 0 THEN whole + one_more::BIGINT ELSE 0 END * size)::BIGINT AS taken
FROM drawn"""
