"""The registered queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rtshop.llm import (
    decontaminate, fm_quality, html_template, licenses, mixing, periodic, quality, repeats, simhash, spelling,
    token_blocks, token_counts, url_filter)
from rtshop.llm.common import let, table, words

# Vocabulary files of public tokenizers, by the package that describes where they are.
BLOCK_VOCABULARY = "word_bpe_49k.json"
COUNT_VOCABULARY = "byte_bpe_50k.json"


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


def op2_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks.store_tokens(table(spark, sf_dir, "documents"), vocabulary(BLOCK_VOCABULARY))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), keep=["page_id"])


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"),
                                            keep=["doc_id"])


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary(COUNT_VOCABULARY), keep=["doc_id"])


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"),
                           quality.trusted_documents(table(spark, sf_dir, "labels")), distinct=True)
    return judged.drop("text")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def _id_crc32() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary"))


def op11_fm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four fifths of the ids teach, by their crc32; the others are held out. Rows without an id are neither."""
    docs, held_out = table(spark, sf_dir, "documents"), _id_crc32() % 5 == 0
    train = fm_quality.labelled(docs, table(spark, sf_dir, "labels"), ~held_out)
    model = fm_quality.fit(train, metadata=["n_chars"])
    scored = fm_quality.score(docs.select("doc_id", "text", "n_chars"), model, metadata=["n_chars"])
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = spelling.word_counts(table(spark, sf_dir, "documents"), spelling.one_in_199)
    return spelling.variants(counts)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """Texts of every tenth id, by crc32, with a period from some word on; words then stand one space apart."""
    h = _id_crc32()
    g = F.floor(h / 10).cast("long")

    def periodic_from(own: Column) -> Column:
        n = F.size(own).cast("long")
        a = F.pmod(g, F.greatest(n, F.lit(1)))
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        place = lambda i: F.when(i >= a, a + F.pmod(i - a, p)).otherwise(i).cast("int")
        return F.array_join(F.transform(own, lambda _, i: F.get(own, place(i.cast("long")))), " ")

    planted = F.when(h % 10 == 0, let(words(F.col("text")), periodic_from)).otherwise(F.col("text"))
    return docs.withColumn("text", planted)


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_planted_periods(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic.periodic_runs(docs)
    rated = F.transform("runs", lambda r: F.struct(
        (r["length"] / r["period"]).alias("exponent"), (-r["start"]).alias("early"), (-r["period"]).alias("short"),
        r["length"].alias("length")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    best = found.withColumn("best", F.array_max(rated))
    start, length, period = -F.col("best.early"), F.col("best.length"), -F.col("best.short")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"),
        period.alias("period"), F.call_function("div", 1000 * length, period).alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_html_template": op2_html_template,
    "op3_simhash": op3_simhash,
    "op4_token_blocks": op4_token_blocks,
    "op5_url_filter": op5_url_filter,
    "op6_repeats": op6_repeats,
    "op7_decontaminate": op7_decontaminate,
    "op8_token_counts": op8_token_counts,
    "op9_quality": op9_quality,
    "op10_licenses": op10_licenses,
    "op11_fm_quality": op11_fm_quality,
    "op12_spelling": op12_spelling,
    "op13_periodic": op13_periodic,
}

ORACLE: dict[str, str] = {
    "op1_mixing": mixing.oracle(),
    "op6_repeats": repeats.oracle(),
    "op7_decontaminate": decontaminate.oracle(),
}
