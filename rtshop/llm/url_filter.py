"""URL filter: rules by host and path, and boosted trees over lexical features for what no rule decides.

The trees learn from the urls that the rules do decide: length, depth, shares of digits and signs, entropy, parameters,
and how often the host's suffixes were blocked among the labelled urls. Features are SQL functions; suffixes are counted
over all labelled urls; training is Spark's gradient-boosted trees on a bounded sample of distinct labelled urls, in one
partition, so that runs agree; every other url is scored in the JVM.

Defined results
---------------
* Null url, and url without "://": host and path are empty; no rule fits, the model judges.
* The longest rule wins (host and path together), of equal ones that with the longer host, then the later one.
* Labelled urls of one verdict only: that verdict for all others. None labelled: all others are allowed.
* Repeated rows are judged one by one and alike; a labelled url counts once for its suffixes and the trees. An empty table gives an empty result. Other columns are dropped, or
  pass through where kept. Long urls are measured whole.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rtshop.functions.joins import broadcast_if_small
from rtshop.llm.common import staged

# (verdict, host, path prefix): rules with which the trees are trained too.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
# At most so many distinct labelled urls are fitted: those of smallest hash of each verdict, which has its share of them,
# a twentieth at least.
SAMPLE = 20_000
TREES, DEPTH, SEED = 20, 4, 7
# Weight of the overall share in a suffix's share of blocked urls.
PRIOR = 5.0
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
FEATURES = ["u_length", "u_host", "u_path", "u_depth", "u_labels", "u_digits", "u_signs", "u_entropy", "u_parameters",
            "u_query", "u_share1", "u_share2", "u_seen2"]


def host_of(url: Column) -> Column:
    """What follows the first "://" up to a slash, question mark or number sign, A to Z in lower case; "" if nothing."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), upper, upper.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct of the winning rule's text and verdict, null if none fits. Rules are few and part of the plan."""
    ordered = sorted(enumerate(rules), key=lambda r: (len(r[1][1]) + len(r[1][2]), len(r[1][1]), r[0]), reverse=True)
    fits = lambda h, p: ((host == h) | host.endswith("." + h)) & path.startswith(p)
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    return F.coalesce(*[F.when(fits(h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
                        for _, (v, h, p) in ordered], none)


def share_of(text: Column, pattern: str) -> Column:
    return F.when(F.length(text) > 0, F.regexp_count(text, F.lit(pattern)) / F.length(text)).otherwise(0.0)


def entropy(text: Column) -> Column:
    """Bits a character."""
    letters = F.array_distinct(F.split(text, ""))
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / F.length(text)
    terms = F.transform(F.filter(letters, lambda c: c != ""), share)
    return F.coalesce(F.aggregate(terms, F.lit(0.0), lambda a, p: a - p * F.log2(p)), F.lit(0.0))


def with_lexical(urls: DataFrame) -> DataFrame:
    """Add the features that need the url alone, and its host's suffixes. Needs ``url``, ``host`` and ``path``."""
    url = F.coalesce(F.col("url"), F.lit(""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    return urls.withColumns({
        "u_length": F.length(url), "u_host": F.length("host"), "u_path": F.length("path"),
        "u_depth": F.regexp_count("path", F.lit("/")), "u_labels": F.regexp_count("host", F.lit("[.]")),
        "u_digits": share_of(url, "[0-9]"), "u_signs": share_of(url, "[^0-9A-Za-z]"), "u_entropy": entropy(url),
        "u_parameters": F.regexp_count(query, F.lit("[^&=]+=")), "u_query": F.length(query),
        "suffix1": F.substring_index("host", ".", -1), "suffix2": F.substring_index("host", ".", -2)})


def filter_urls(pages: DataFrame, rules=RULES, sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH,
                keep: list[str] | None = None) -> DataFrame:
    """Add ``host, path, rule, verdict`` to ``pages``, and ``p_block`` where the model judged.

    Kept columns travel as one, so they may have any names but those of the results, which replace them.
    """
    made = ("host", "path", "rule", "verdict", "p_block")
    kept = [c for c in (pages.columns if keep is None else keep) if c not in made]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.lit(0)
    urls = (pages.select(row.alias("llm_row"), "url").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
            .withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)))
    # Each labelled url once: a url that repeats is one row a task before the shuffle.
    labelled = staged(urls.filter("fit is not null").groupBy("url").agg(
        F.first("host").alias("host"), F.first("path").alias("path"),
        F.first((F.col("fit.verdict") == "block").cast("double")).alias("label")), "labelled")
    n, blocked = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if blocked in (0.0, float(n)):
        verdict = "block" if n and blocked else "allow"
        judged = urls.withColumns({"verdict": F.coalesce(F.col("fit.verdict"), F.lit(verdict)),
                                   "p_block": F.lit(None).cast("double")})
    else:
        train = with_lexical(fitted(labelled, n, int(blocked), sample)).persist()
        try:
            judged = _judge(urls, with_lexical(labelled), train, blocked / n, trees, depth)
        finally:
            train.unpersist()
    return judged.select(*[F.col("llm_row")[c].alias(c) for c in kept], "host", "path", F.col("fit.rule").alias("rule"), "verdict", "p_block")


def fitted(labelled: DataFrame, n: int, blocked: int, sample: int) -> DataFrame:
    """At most ``sample`` of ``n`` labelled urls, ``blocked`` of them blocked; bounded, so one partition may hold it."""
    least = sample // 20
    block = min(max(round(sample * blocked / n), least), sample - least)
    own = []
    for label, most, there in ((1.0, block, blocked), (0.0, sample - block, n - blocked)):
        # Hashes are even, so a share of their range holds as many as are ordered, and some more.
        cut = int(-2 ** 63 + min(1.0, (1.2 * most + 100) / there) * (2 ** 64 - 1))
        own.append(labelled.filter((F.col("label") == label) & (F.xxhash64("url") <= F.lit(min(cut, 2 ** 63 - 1))))
                   .orderBy(F.xxhash64("url"), "url").limit(most))
    # In order of the hash, so that runs agree.
    return own[0].union(own[1]).coalesce(1).sortWithinPartitions(F.xxhash64("url"), "url")


def _judge(urls: DataFrame, labelled: DataFrame, train: DataFrame, prior: float, trees: int, depth: int) -> DataFrame:
    """Fit on ``train``, score the urls that no rule decides. Suffixes are counted over all of ``labelled``."""
    counts = {name: broadcast_if_small(labelled.groupBy(F.col(name).alias("s")).agg(
        F.count(F.lit(1)).alias("seen"), F.sum("label").alias("bad"))) for name in ("suffix1", "suffix2")}

    def with_shares(rows: DataFrame, own: Column | None = None) -> DataFrame:
        """Share of blocked urls by suffix; with ``own``, the row's label, without the row itself."""
        for k, (name, known) in enumerate(counts.items(), 1):
            seen, bad = F.coalesce("seen", F.lit(0)), F.coalesce("bad", F.lit(0.0))
            if own is not None:
                seen, bad = seen - 1, bad - own
            rows = (rows.join(known, F.col(name) == F.col("s"), "left")
                    .withColumns({f"u_share{k}": (bad + PRIOR * prior) / (seen + PRIOR), f"u_seen{k}": seen})
                    .drop("s", "seen", "bad"))
        return rows

    assembler = VectorAssembler(inputCols=FEATURES, outputCol="u_features")
    # A join may deal the rows anew; they are fitted in order of the hash.
    known = (assembler.transform(with_shares(train, F.col("label"))).coalesce(1)
             .sortWithinPartitions(F.xxhash64("url"), "url").select("u_features", "label"))
    model = GBTClassifier(featuresCol="u_features", labelCol="label", maxIter=trees, maxDepth=depth, seed=SEED,
                          checkpointInterval=-1).fit(known)
    scored = model.transform(assembler.transform(with_shares(with_lexical(urls))))
    return (scored.withColumn("p_block", F.when(F.col("fit").isNull(), F.get(vector_to_array("probability"), 1)))
            .withColumn("verdict", F.coalesce(F.col("fit.verdict"), F.when(F.col("prediction") > 0.5, "block").otherwise("allow"))))
