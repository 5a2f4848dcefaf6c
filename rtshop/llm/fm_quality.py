"""Quality scores by a factorisation machine (op 11).

A text is a sparse vector: its words hashed to ``BUCKETS`` places, weighted by ``log(1 + count)`` and scaled to length 1,
then structure statistics and metadata, each between 0 and 1. The machine has a weight for each place and a vector of
``RANK`` factors, whose products weigh pairs of places. All pairs are summed in time linear in the places that a text
fills, since ``2 * sum of pairs = (sum of v x)^2 - sum of (v x)^2`` for each factor; Spark's machine scores this way.

The machine is fitted on at most ``SAMPLE`` labelled texts, drawn by a hash of their ids among all labelled ones. It never
sees an id, a language, a source or a label when it scores. Every text is scored, whole.

Odd rows: null, empty and blank texts are texts without words and get a score as well. Rows that repeat are scored alike.
Labels without an id or a verdict, and ids whose labels disagree, teach nothing. Without labels of both kinds every
score is the share of good labels, 0.5 without any. Missing metadata count as 0, with a mark of their own. Kept columns may have any
names; those that share a result's name are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import FMClassificationModel, FMClassifier
from pyspark.ml.feature import HashingTF, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rtshop.llm.common import staged, words

BUCKETS = 1024
RANK = 4
SAMPLE = 20_000
STEPS = 60
THRESHOLD = 0.3
# Words that one unit of a logarithmic statistic stands for: 2^20 words or lines are 1.
LOG_UNITS = 20.0


def _log(value: Column) -> Column:
    return F.least(F.log2(value + 1.0) / LOG_UNITS, F.lit(1.0))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.least(part / whole, F.lit(1.0))).otherwise(0.0)


def _left(text: Column, pattern: str) -> Column:
    """Number of code points of ``text`` that ``pattern``, a class of single characters, holds."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def structure(text: Column, own: Column) -> list[Column]:
    """Statistics between 0 and 1 of a text and the array of its words."""
    chars, n = F.length(text), F.size(own)
    lines = F.filter(F.split(text, "\n"), lambda line: F.trim(line) != "")
    return [
        _log(n),
        F.least(_share(chars, n) / 16.0, F.lit(1.0)),
        _share(F.size(F.array_distinct(own)), n),
        _share(_left(text, r"[#*$%&|<>]"), chars),
        _share(_left(text, r"[0-9]"), chars),
        _share(_left(text, r"\p{Lu}"), chars),
        _share(_left(text, r"[.,;:]"), n),
        _share(_left(text, r"[!?]"), n),
        _share(F.size(F.filter(F.zip_with(own, F.slice(own, 2, n), lambda a, b: a == b), lambda same: same)), n),
        _share(F.size(F.filter(own, lambda w: F.rlike(w, F.lit(r"^\P{Ll}*\p{Lu}\P{Ll}*$")))), n),
        _log(F.size(lines)),
        _share(F.size(F.array_distinct(lines)), F.size(lines)),
        _share(F.size(F.filter(own, lambda w: F.length(w) <= 1)), n),
    ]


def features(docs: DataFrame, text: str, metadata: Sequence[str], extra: Sequence[Column] = ()) -> DataFrame:
    """``row`` (all of ``docs``), ``extra`` columns and ``features``, the vector of each text."""
    read = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *extra,
                       F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
                       *[F.col(f"`{c}`").cast("double").alias(f"meta{i}") for i, c in enumerate(metadata)])
    read = read.withColumn("own", words(F.col("text")))
    stats = [*structure(F.col("text"), F.col("own"))]
    for i in range(len(metadata)):
        known = F.col(f"meta{i}") >= 0
        stats += [F.when(known, _log(F.col(f"meta{i}"))).otherwise(0.0), F.when(known, 1.0).otherwise(0.0)]
    made = read.withColumn("counts", F.array(*stats))
    names = [f"stat{i}" for i in range(len(stats))]
    made = made.select("row", *[c for c in made.columns if c in EXTRA], "own",
                       *[F.col("counts")[i].alias(name) for i, name in enumerate(names)])
    hashed = HashingTF(numFeatures=BUCKETS, inputCol="own", outputCol="tf").transform(made)
    scaled = Normalizer(p=2.0, inputCol="tf", outputCol="unit").transform(hashed)
    joined = VectorAssembler(inputCols=["unit", *names], outputCol="features").transform(scaled)
    return joined.drop("own", "tf", "unit", *names)


EXTRA = ("label",)


def labelled(docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", verdict: str = "quality",
             limit: int = SAMPLE) -> DataFrame:
    """At most ``limit`` rows of ``docs`` with a column ``label``, for ids of ``labels`` that ``learn`` allows.

    The ids are drawn by hash before texts are read, so the side that is broadcast has a bound.
    """
    known = (labels.filter(F.col(doc_id).isNotNull() & F.col(verdict).isin(0, 1) & learn)
             .groupBy(F.col(doc_id).alias("llm_id"))
             .agg(F.min(verdict).cast("double").alias("label"), F.max(verdict).cast("double").alias("most"))
             .filter(F.col("label") == F.col("most")).drop("most"))
    drawn = F.broadcast(known.orderBy(F.xxhash64("llm_id"), "llm_id").limit(limit))
    found = docs.join(drawn, F.col(f"`{doc_id}`") == drawn["llm_id"])
    return found.dropDuplicates(["llm_id"]).drop("llm_id")


def fit(train: DataFrame, text: str = "text", metadata: Sequence[str] = ()) -> FMClassificationModel | float:
    """The machine fitted on ``train`` with its ``label``, or the share of good labels where they are all alike."""
    read = [text, *metadata]
    vectors = features(train.select(*[F.col(f"`{c}`") for c in dict.fromkeys(read)], "label"), text, metadata,
                       [F.col("label")]).select("features", "label")
    sample = staged(vectors.repartition(2), "labelled")
    found = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(found) < 2:
        return next(iter(found), 0.5)
    return FMClassifier(factorSize=RANK, maxIter=STEPS, stepSize=0.1, regParam=0.001, seed=11, solver="adamW",
                        featuresCol="features", labelCol="label").fit(sample)


def score(docs: DataFrame, model: FMClassificationModel | float, text: str = "text",
          metadata: Sequence[str] = ()) -> DataFrame:
    """``docs`` with ``score``, the chance that a text is good, and ``predicted``, 1 from ``THRESHOLD`` on."""
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    if isinstance(model, float):
        scored = docs.select(*[F.col(f"`{c}`") for c in kept], F.lit(model).alias("score"))
    else:
        rated = model.transform(features(docs, text, metadata))
        scored = rated.select(*[F.col("row")[c].alias(c) for c in kept],
                              vector_to_array("probability")[1].alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
