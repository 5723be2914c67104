"""The registered queries of the operators: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import (
    decontaminate, license_scan, line_frequency, mixing, periodic_runs, prefix_trie, quality_classifier, secret_scan, simhash, substring_dedup, suffix_array_dedup, topk_search, url_filter,
)
from fleetlens.llm.common import cut

URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
TOXIC, LOW, GOOD = 0, 1, 2
KEEP_FROM = 0.5  # probability of the best grade


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def graded(labels: DataFrame) -> DataFrame:
    """Grades of the labels: toxic documents are the worst, then those of low quality, then the rest."""
    grade = F.when(F.col("toxic") == 1, TOXIC).when(F.col("quality") == 0, LOW).when(F.col("quality") == 1, GOOD)
    return labels.select("doc_id", grade.alias("grade"))


def op1_line_frequency(spark: SparkSession, folder: str) -> DataFrame:
    out = line_frequency.line_frequency(table(spark, folder, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words", "depleted")


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = decontaminate.find_hits(docs, table(spark, folder, "benchmark"))
    items = F.col("hits.items")
    return out.select(
        "doc_id", F.col("hits.n_words").alias("n_words"), decontaminate.n_hit("hits").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), decontaminate.contaminated("hits").alias("contaminated"),
    )


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    made = mixing.mix(table(spark, folder, "documents"))
    return mixing.mixed_documents(made).select(F.col("id").alias("doc_id"), "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, folder, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    out = url_filter.judge_urls(table(spark, folder, "pages"), url_filter.rule_table(spark, URL_RULES))
    return out.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = substring_dedup.drop_repeated_words(table(spark, folder, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    out = license_scan.license_scan(table(spark, folder, "documents"))
    joined = [F.array_join(n, ",").alias(n) for n in ("base_labels", "labels")]
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", *joined, "score")


def op8_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality_classifier.train(docs, graded(table(spark, folder, "labels")))
    out = quality_classifier.classify(docs, model)
    return out.select("doc_id", "quality.expected_grade", "quality.tail_probability", (F.col("quality.tail_probability") >= KEEP_FROM).alias("kept"))


def op9_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    out = secret_scan.scan_secrets(table(spark, folder, "documents"), secret_scan.new_ledger(spark))
    base = F.filter("findings", lambda f: f["kind"].isin([r.kind for r in secret_scan.BASE_RULES]))
    kinds = F.transform("findings", lambda f: f["kind"])
    counts = [F.size(F.array_remove(kinds, r.kind)) for r in secret_scan.BASE_RULES]
    counts = [(F.size("findings") - c).cast("long").alias(f"n_{r.kind}") for c, r in zip(counts, secret_scan.BASE_RULES, strict=True)]
    return out.select(F.col("id").alias("doc_id"), *counts, F.sha2(secret_scan.span_list(base), 256).alias("base_sha256"), secret_scan.span_list(F.col("findings")).alias("spans"))


def op10_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = suffix_array_dedup.drop_repeated_bytes(table(spark, folder, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return topk_search.top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``; the texts whose id's hash ends in 0 get a periodic end, as the query's definition has it."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def planted(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.pmod(g, n)
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int"))), " ")

    # The lambda's argument holds the words, so that they are taken from the text once and not for each word.
    words = F.array(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    changed = F.transform(words, lambda w: F.when(F.size(w) > 0, planted(w)))[0]
    return docs.select("doc_id", F.when(F.pmod(h, F.lit(10)) == 0, changed).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    out = periodic_runs.periodic_runs(with_planted_periods(table(spark, folder, "documents")))
    runs = F.col("runs")
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"))))
    length, period = best["length"], -best["short"]
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return out.select(
        F.col("id").alias("doc_id"), F.size(runs).cast("long").alias("n_runs"), (-best["back"]).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("kept_text", 256).alias("collapsed_sha256"),
    )


def with_borrowed_heads(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered turns and conversations, each conversation's first h turns taken from the first one of its five."""
    base, h = F.col("conv_id") - F.col("conv_id") % 5, F.crc32(F.col("conv_id").cast("string")) % 9
    plan = convs.select("conv_id", "n_turns", base.alias("base"), h.alias("h"))
    lender = convs.select(F.col("conv_id").alias("base"), F.col("n_turns").alias("lent"))
    plan = cut(plan.join(lender, "base", "left").select("conv_id", "n_turns", "base", "h", F.least("h", F.coalesce("lent", F.lit(0))).alias("taken")), "trie-plan")
    own = turns.join(plan.select("conv_id", "h", "taken"), "conv_id").filter("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "key")
    heads = turns.filter("pos <= 8 AND conv_id % 5 = 0").withColumnRenamed("conv_id", "base")
    lent = heads.join(plan.select("conv_id", "base", "taken"), "base").filter("pos <= taken").select("conv_id", "pos", "key")
    left = F.greatest(F.col("n_turns") - F.col("h"), F.lit(0))
    return cut(own.unionAll(lent), "trie-rebuilt"), plan.select("conv_id", (F.col("taken") + left).alias("n_turns"))


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns, convs = prefix_trie.numbered_turns(table(spark, folder, "conversations"))
    return prefix_trie.trie(*with_borrowed_heads(turns, convs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_frequency, op2_decontamination, op3_mixing, op4_simhash, op5_url_filter, op6_substring_dedup, op7_license_scan,
        op8_quality_classifier, op9_secret_scan, op10_suffix_array_dedup, op11_topk_search, op12_periodic_runs, op13_prefix_trie,
    )
}
