"""Secret scans over an incremental blob ledger.

Every version of a text is addressed by the SHA-256 of its content. The ledger, a Parquet folder, holds one row for
each scanned blob and rule version with what was found. A scan looks only at blobs that the ledger lacks for some rule
version, each content once however many paths hold it, appends what it finds, and joins findings back to all paths.
A changed pattern is a new rule version, so only that rule is run again.

Spans are code points, end exclusive, leftmost and non-overlapping per kind. They come from the pieces between the
matches: a match starts behind the pieces and matches before it.

Defined results: a NULL text is the empty blob; NULL or repeated ids are paths like any other; an empty table leaves
the ledger as it is. A run that dies before its append leaves no ledger rows and is simply repeated; a blob that two
runs append at once has equal rows, of which one is read. Only built-in functions are used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import cut, shared_folder, unused

LEDGER = "blob binary, kind string, version string, spans array<struct<start:bigint,end:bigint>>"


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds; a match counts if its ``group`` has at least ``least`` characters. ``hint`` is a cheaper pattern
    found in every text with a match."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    hint: str | None = None

    @property
    def version(self) -> str:
        return hashlib.sha256(f"{self.kind}\n{self.pattern}\n{self.group}\n{self.least}".encode()).hexdigest()[:16]


# The base kinds, in their order, then those that the ledger's own rule set adds.
BASE_RULES = (
    Rule("assign", "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20, "AKIA[A-Z0-9]{16}"),
    Rule("hex", "[0-9a-f]+", 0, 24, "[0-9a-f]{24}"),
)
MORE_RULES = (Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----(?s:.*?)(?:-----END [A-Z ]*PRIVATE KEY-----|$)", 0, 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----"),)
RULES = BASE_RULES + MORE_RULES


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _known(spark: SparkSession, ledger: str, rules: Sequence[Rule]) -> DataFrame:
    wanted = F.concat_ws("/", "kind", "version").isin([f"{r.kind}/{r.version}" for r in rules])
    return spark.read.schema(LEDGER).parquet(ledger).filter(wanted)


def _ledger_there(spark: SparkSession, ledger: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def scan_blobs(blobs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Ledger rows of ``blobs`` (blob, text, and todo: the kinds to run)."""
    hits = []
    for r in rules:
        due = F.array_contains("todo", r.kind) & F.col("text").rlike(r.hint or r.pattern)
        hits.append(F.when(due, F.struct(
            F.lit(r.kind).alias("kind"),
            F.transform(F.split("text", r.pattern, -1), lambda x: F.length(x)).alias("gaps"),
            F.transform(F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0)), lambda x: F.length(x)).alias("lengths"),
            F.transform(F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group)), lambda x: F.length(x) >= r.least).alias("good"),
        )))
    raw = blobs.select("blob", "todo", F.filter(F.array(*hits), lambda h: h.isNotNull()).alias("hits"))
    raw = cut(raw, "secret-hits")  # blob, kinds and lengths: no text from here on
    each = raw.select("blob", F.explode("hits").alias("h")).select("blob", "h.kind", F.posexplode(F.arrays_zip("h.gaps", "h.lengths", "h.good")).alias("at", "m"))
    so_far = Window.partitionBy("blob", "kind").orderBy("at")
    start = F.sum("m.gaps").over(so_far.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum("m.lengths").over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = each.withColumn("start", start.cast("long")).filter("m.good").groupBy("blob", "kind").agg(
        F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("m.lengths")).cast("long").alias("end")))).alias("spans")
    )
    version = F.create_map(*(F.lit(x) for r in rules for x in (r.kind, r.version)))
    done = raw.select("blob", F.explode("todo").alias("kind"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return done.join(spans, ["blob", "kind"], "left").select("blob", "kind", version[F.col("kind")].alias("version"), F.coalesce("spans", none).alias("spans"))


def update_ledger(texts: DataFrame, ledger: str, rules: Sequence[Rule] = RULES) -> None:
    """Scan what the ledger lacks of ``texts`` (blob, text) and append it."""
    spark = texts.sparkSession
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    blobs = texts.select("blob", "text").dropDuplicates(["blob"])
    if _ledger_there(spark, ledger):
        done = _known(spark, ledger, rules).groupBy("blob").agg(F.collect_set("kind").alias("done"))
        todo = F.array_except(kinds, F.coalesce("done", F.array().cast("array<string>")))
        blobs = blobs.join(done, "blob", "left").select("blob", "text", todo.alias("todo")).filter(F.size("todo") > 0)
    else:
        blobs = blobs.withColumn("todo", kinds)
    scan_blobs(blobs, rules).write.mode("append").parquet(ledger)


def findings_by_blob(spark: SparkSession, ledger: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(blob, findings) of blobs with findings; each is (start, place of its rule, kind, end), in that order."""
    order = F.create_map(*(F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)))
    found = _known(spark, ledger, rules).filter(F.size("spans") > 0).select("blob", "kind", F.explode("spans").alias("s"))
    found = found.select("blob", F.struct(F.col("s.start").alias("start"), order[F.col("kind")].alias("place"), "kind", F.col("s.end").alias("end")).alias("f"))
    return found.groupBy("blob").agg(F.array_sort(F.collect_set("f")).alias("findings"))


def scan_secrets(docs: DataFrame, ledger: str, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bring the ledger up to date with ``docs``; per path its ``id``, ``blob`` and ``findings``."""
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("blob", blob_of(F.col("text")))
    paths = cut(texts.select("id", "blob"), "secret-paths")
    update_ledger(texts, ledger, rules)
    found = findings_by_blob(docs.sparkSession, ledger, rules)
    none = F.array().cast(found.schema["findings"].dataType)
    return paths.join(found, "blob", "left").select("id", "blob", F.coalesce("findings", none).alias("findings"))


def redact_secrets(docs: DataFrame, ledger: str, rules: Sequence[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """``docs`` with every secret in their text replaced by a mark; the ledger is brought up to date on the way."""
    blob, findings = unused(docs, "_blob"), unused(docs, "_findings")
    texts = docs.withColumn(blob, blob_of(F.col(text_col)))
    update_ledger(texts.select(F.col(blob).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), ledger, rules)
    found = findings_by_blob(docs.sparkSession, ledger, rules).select(F.col("blob").alias(blob), F.col("findings").alias(findings))
    return texts.join(found, blob, "left").withColumn(text_col, redact(F.col(text_col), F.col(findings))).select(*docs.columns)


def new_ledger(spark: SparkSession) -> str:
    """A folder for a ledger of one's own, in the shared folder."""
    import uuid

    return f"{shared_folder(spark).rstrip('/')}/secret-ledger-{uuid.uuid4().hex}"


def span_list(findings: Column) -> Column:
    """kind:start:end of each finding, comma-joined."""
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


def redact(text: Column, findings: Column, mark: str = "[SECRET]") -> Column:
    """The text with every found span replaced; overlapping spans become one mark."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(done: Column, f: Column) -> Column:
        gap = F.substring(text, (done["at"] + 1).cast("int"), (f["start"] - done["at"]).cast("int"))
        fresh = F.struct(f["end"].alias("at"), F.concat(done["out"], gap, F.lit(mark)).alias("out"))
        inside = F.struct(F.greatest(done["at"], f["end"]).alias("at"), done["out"].alias("out"))
        return F.when(f["start"] >= done["at"], fresh).otherwise(inside)

    rest = lambda done: F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(findings) > 0, F.aggregate(findings, start, step, rest)).otherwise(text)
