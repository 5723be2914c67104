"""License scans: phrases, and an exact set-similarity join of text blocks with license templates.

A block is a window of words, over line ends: one starts every ``CHUNK`` words and is at least twice as long as the
template it is compared with, so a passage as long as the template lies in one block, however it is wrapped. A block
matches a template if it holds at least ``threshold`` of the template's distinct words. Words are ordered by how many
documents hold them, rarest first. With an overlap of o needed out of t words, one of the first t - o + 1 words of the
template must be in the block (prefix filter); blocks with fewer than o of the words that occur in templates are out
(length filter; documents first, so that blocks are formed of few); and where the first shared word stands, enough words
must be left on either side (positional filter). What is left is compared in full, so no match is missed.

The templates are given by the caller and bounded (``max_template_words`` in all), so their word counts and their prefix
index are small whatever the corpus; the texts are read once.

Defined results: a NULL text is an empty one: no words, no labels, score 0. NULL or repeated ids are rows like any
other. No templates, no phrases or an empty table give no labels or no rows. Only built-in functions are used.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import ascii_lower, cut

GAP = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"
WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"

# Phrases that name a license, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Sentences of common licenses, and their labels.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("gpl", "distributed under the terms of the gnu general public license"),
    ("apache", "licensed under the apache license"),
    ("cc-by", "available under a creative commons cc by license"),
)
THRESHOLD = 0.8
CHUNK = 5  # words from one block's start to the next one's


def words_of(text: str) -> list[str]:
    folded = "".join(c.lower() if c.isascii() and c.isalnum() or not c.isascii() else " " for c in text)
    return folded.split(" ")


def phrase_pattern(phrase: str) -> str:
    return f"(?<!{WORD})" + f"{GAP}+".join(f"\\Q{w}\\E" for w in phrase.split()) + f"(?!{WORD})"


def phrase_columns(text: Column, phrases: Mapping[str, str]) -> dict[str, Column]:
    """n_base, first_word, last_word and base_labels of the phrases' places; A-Z in either case."""
    patterns = {p: phrase_pattern(p) for p in phrases}
    anyone = "(?i)(?:" + "|".join(patterns.values()) + ")"
    has = text.rlike(anyone)
    count = {p: F.regexp_count(text, F.lit(f"(?i)(?={x})")) for p, x in patterns.items()}
    before_first = F.regexp_extract(text, f"(?is)^(.*?)(?={anyone[4:]})", 1)
    before_last = F.regexp_extract(text, f"(?is)^(.*)(?={anyone[4:]})", 1)
    none = F.array().cast("array<string>")
    labels = F.filter(F.array(*(F.when(text.rlike("(?i)" + x), F.lit(phrases[p])) for p, x in patterns.items())), lambda x: x.isNotNull())
    total = sum(count.values(), F.lit(0))
    return {
        "n_base": F.when(has, total).otherwise(0).cast("long"),
        "first_word": F.when(has, F.regexp_count(before_first, F.lit(WORD + "+"))).cast("long"),
        "last_word": F.when(has, F.regexp_count(before_last, F.lit(WORD + "+"))).cast("long"),
        "base_labels": F.when(has, F.array_sort(F.array_distinct(labels))).otherwise(none),
    }


def lowered(text: Column) -> Column:
    """A-Z lower-cased. Only of two other characters does lower() make ASCII letters."""
    return F.when(text.contains("\u212a") | text.contains("\u0130"), ascii_lower(text)).otherwise(F.lower(text))


def span_of(template: str) -> int:
    """Chunks in a block for a template: twice its words at least."""
    return -(-2 * len([w for w in words_of(template) if w]) // CHUNK)


def scan_texts(docs: DataFrame, phrases: Mapping[str, str], sets: Sequence[tuple[set[str], int]], id_col: str, text_col: str) -> DataFrame:
    """One pass over the texts, written: phrase columns, the template words of each text (``present``) and, of texts
    that have enough of them for one of ``sets`` (words, how many are needed), those of each chunk of words."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    vocabulary = sorted(set().union(*(ws for ws, _ in sets)))
    known = F.array(*(F.lit(w) for w in vocabulary)) if vocabulary else F.array().cast("array<string>")
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    base = base.withColumn("_words", F.regexp_extract_all(lowered(text), F.lit(WORD + "+"), F.lit(0)))
    columns = phrase_columns(text, phrases) if phrases else {
        "n_base": F.lit(0).cast("long"), "first_word": F.lit(None).cast("long"), "last_word": F.lit(None).cast("long"), "base_labels": F.array().cast("array<string>"),
    }
    scanned = base.select("id", "_text", F.size("_words").cast("long").alias("n_words"), *(c.alias(n) for n, c in columns.items()), F.array_intersect("_words", known).alias("present"))
    enough = F.lit(False)
    for ws, need in sets:
        enough = enough | (F.size(F.array_intersect("present", F.array(*(F.lit(w) for w in sorted(ws))))) >= need)
    # Only these few texts are cut into chunks.
    pieces = F.regexp_extract_all(lowered(text), F.lit(f"(?:{WORD}++{GAP}*+){{1,{CHUNK}}}+"), F.lit(0))
    chunks = F.transform(pieces, lambda piece: F.array_intersect(F.regexp_extract_all(piece, F.lit(WORD + "+"), F.lit(0)), known))
    scanned = scanned.withColumn("chunks", F.when(enough, chunks)).drop("_text")
    return cut(scanned.withColumn("row", F.monotonically_increasing_id()), "license-scan")


def text_blocks(scanned: DataFrame, spans: Mapping[int, int]) -> DataFrame:
    """(row, span, block, found): the template words of each block of ``span`` chunks that has enough of them."""
    none = F.array().cast("array<string>")
    rows = scanned.filter(F.size("chunks") > 0)

    def block_at(span: int) -> Callable[[Column], Column]:
        return lambda i: F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(span - 1)), lambda j: F.coalesce(F.get("chunks", i + j), none))))

    every = None
    for span, least in sorted(spans.items()):
        made = F.transform(F.sequence(F.lit(0), F.size("chunks") - 1), block_at(span))
        part = rows.select("row", F.lit(span).alias("span"), F.posexplode(made).alias("block", "found")).filter(F.size("found") >= least)
        every = part if every is None else every.unionAll(part)
    return every


def similar_blocks(scanned: DataFrame, templates: Sequence[tuple[str, str]], threshold: float) -> DataFrame:
    """(row, block, label, containment) of every block and template at or above the threshold."""
    spark = scanned.sparkSession
    held = scanned.select(F.explode("present").alias("token")).groupBy("token").count().collect()  # template words at most
    frequency = {r["token"]: r["count"] for r in held}
    sets = [(label, sorted({w for w in words_of(t) if w}, key=lambda w: (frequency.get(w, 0), w))) for label, t in templates]
    vocabulary = sorted({w for _, ws in sets for w in ws}, key=lambda w: (frequency.get(w, 0), w))
    rank = {w: i for i, w in enumerate(vocabulary)}
    index = []
    for n, (label, ws) in enumerate(sets):
        need = math.ceil(threshold * len(ws) - 1e-9)
        index += [(w, span_of(templates[n][1]), n, label, place, len(ws), need, ws) for place, w in enumerate(ws[: len(ws) - need + 1])]
    prefixes = spark.createDataFrame(index, "token string, span int, template int, label string, t_place int, t_size int, need int, words array<string>")
    ranks = F.create_map(*(F.lit(x) for w, i in rank.items() for x in (w, i)))
    spans: dict[int, int] = {}
    for _, span, _, _, _, _, need, _ in index:
        spans[span] = min(need, spans.get(span, need))
    blocks = text_blocks(scanned, spans)
    ordered = blocks.withColumn("found", F.transform(F.array_sort(F.transform("found", lambda w: F.struct(ranks[w].alias("rank"), w.alias("token")))), lambda s: s["token"]))
    probes = ordered.select("row", "span", "block", "found", F.posexplode("found").alias("b_place", "token"))
    met = probes.join(F.broadcast(prefixes), ["token", "span"])  # bounded by the templates
    # The first shared word of a pair in the common order; what can still follow bounds the overlap.
    first = met.groupBy("row", "block", "template").agg(F.min_by(F.struct("found", "label", "b_place", "t_place", "t_size", "need", "words"), "b_place").alias("m")).select("row", "block", "m.*")
    open_pairs = first.filter(F.least(F.col("t_size") - F.col("t_place"), F.size("found") - F.col("b_place")) >= F.col("need"))
    overlap = F.size(F.array_intersect("found", "words"))
    return open_pairs.filter(overlap >= F.col("need")).select("row", "block", "label", (overlap / F.col("t_size")).alias("containment"))


def license_scan(
    docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Mapping[str, str] = PHRASES, threshold: float = THRESHOLD,
    id_col: str = "doc_id", text_col: str = "text", max_template_words: int = 20_000,
) -> DataFrame:
    """Per document: n_words, the phrases' columns, ``labels`` (array, with those of matching templates) and ``score``,
    the best containment (1 where a phrase was found)."""
    sets = [{w for w in words_of(t) if w} for _, t in templates]
    if sum(map(len, sets)) > max_template_words:
        raise ValueError("too many template words for a broadcast index; scan with parts of the templates and unite the labels")
    if not 0 < threshold <= 1 or not all(sets):
        raise ValueError("the threshold is a share above 0, and templates have words")
    scanned = scan_texts(docs, phrases, [(s, math.ceil(threshold * len(s) - 1e-9)) for s in sets], id_col, text_col)
    joined = scanned.drop("present", "chunks")
    if not sets:
        return joined.select("row", "id", "n_words", "n_base", "first_word", "last_word", "base_labels", F.col("base_labels").alias("labels"), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0).alias("score"))
    matches = similar_blocks(scanned, templates, threshold).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    both = joined.join(matches, "row", "left")
    labels = F.array_sort(F.array_union("base_labels", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return both.select("row", "id", "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), score.alias("score"))
