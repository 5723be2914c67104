"""Mixing sources to target weights by a low-discrepancy schedule.

Slot i of the schedule gets the golden-ratio point i * phi mod 1; the cumulative weights map it to a source, so every
stretch of the schedule holds the sources in proportion. The k-th slot of a source takes the k-th block of equal size
from the source's shuffled stream: its documents in hash order, once as they are and once more in another order. The
stream ends after two passes, so no document is taken more than twice over.

The schedule draws a source's slots in proportion, but whole blocks and the points' discrepancy would leave small sources
short or over. So each source has as many slots as its own target fills: slots drawn beyond them are left out, missing
ones follow at the schedule's end, and the last block is cut where the target is met, to a word.

No source is gathered in one task: positions are prefix sums over hash buckets within a source first, then inside
each bucket; slots are ranked the same way over ranges of the schedule.

Defined results: a NULL text has size 0; a NULL source is a source and comes last; a source of size 0 has target 0;
NULL and repeated ids are rows of their own (shuffled by their id, ties by a key given once and written). An empty
table gives an empty result. Only built-in functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import cut

WEIGHTS = (3, 1, 2)
SHARE = 1.5
PASSES = 2
DIGITS = 3  # hexadecimal digits of the shuffle hash that name a bucket
RANGE = 4096
# Golden ratio over a circle of 2^31 points.
CIRCLE, GOLDEN = 1 << 31, 1327217885
WORD = "[^\\x20\\x09-\\x0D]+"


@dataclass(frozen=True)
class Mix:
    """``sizes``: key, id, source, size; ``targets``: source, rank, weight, source_size, target, words; ``schedule``: slot, source,
    block; ``pieces``: key, block, pass, start, words (of the document); ``taken``: key, taken."""

    sizes: DataFrame
    targets: DataFrame
    schedule: DataFrame
    pieces: DataFrame
    taken: DataFrame


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """Per source its target: the wanted total shared by weight, none above ``passes`` times its source.

    Sharing the excess again and again ends where every source has min(cap, level * weight). Sorted by cap / weight,
    the capped sources come first, so the level follows from the caps before and the weights after. One row per source.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = total.withColumn("rank", F.row_number().over(order) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", (F.col("source_size") * passes).cast("double"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    leveled = ranked.withColumn("level", level)
    # The first source that the level before it does not fill sets the level of all after it.
    settled = leveled.withColumn("final", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(everything)["level"])
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("weight")))
    # Whole words; just short of a half, where rounding would hang on the last bit of the sums above.
    words = F.floor(F.col("target") + 0.499999)
    return settled.select("source", "rank", "weight", "source_size", target.alias("target")).withColumn("words", words)


def _offsets(rows: DataFrame, key: str, bucket: str, amount: Column) -> DataFrame:
    """Per key and bucket, the amount in the buckets before it."""
    sums = rows.groupBy(key, bucket).agg(F.sum(amount).alias("n"))
    before = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(key, bucket, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))


def schedule_slots(spark, targets: DataFrame, slots: int) -> DataFrame:
    """(slot, rank, block): each slot's source and its place among that source's slots."""
    order = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_of = F.sum("target").over(Window.partitionBy())
    arcs = targets.filter("target > 0").select("rank", (F.sum("target").over(order) / all_of).alias("upto"), F.col("target"))
    arcs = arcs.select("rank", F.coalesce(F.lag("upto").over(Window.orderBy("rank")), F.lit(0.0)).alias("low"), F.when(F.lead("rank").over(Window.orderBy("rank")).isNull(), F.lit(2.0)).otherwise(F.col("upto")).alias("high"))
    # Arcs cut at 1,024 marks of the circle: a slot meets the arcs of its mark by an equality join.
    marks = 1024
    cells = arcs.select("rank", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * marks), F.floor(F.least(F.col("high"), F.lit(1.0)) * marks))).alias("cell"))
    point = ((F.col("id") % CIRCLE) * GOLDEN % CIRCLE) / F.lit(float(CIRCLE))
    drawn = spark.range(slots).select(F.col("id").alias("slot"), point.alias("u")).withColumn("cell", F.floor(F.col("u") * marks))
    placed = drawn.join(cells, "cell").filter("u >= low AND u < high").select("slot", "rank", F.floor(F.col("slot") / RANGE).alias("range"))
    counted = _offsets(placed, "rank", "range", F.lit(1))
    inside = Window.partitionBy("rank", "range").orderBy("slot")
    ranked = placed.withColumn("n", F.row_number().over(inside) - 1).join(counted, ["rank", "range"])
    return ranked.select("slot", "rank", (F.col("offset") + F.col("n")).alias("block"))


def wanted_slots(drawn: DataFrame, targets: DataFrame, slots: int, block: int) -> DataFrame:
    """The slots that targets fill: those drawn, without what is beyond a target, and those that were not drawn."""
    wanted = targets.filter("words > 0").select("rank", F.ceil(F.col("words") / block).alias("blocks"))
    kept = drawn.join(wanted, "rank").filter("block < blocks").select("slot", "rank", "block")
    have = drawn.groupBy("rank").agg(F.count(F.lit(1)).alias("have"))
    short = wanted.join(have, "rank", "left").withColumn("have", F.coalesce("have", F.lit(0))).filter("have < blocks")
    more = short.select("rank", "have", F.explode(F.sequence(F.col("have"), F.col("blocks") - 1)).alias("block"))
    sources = targets.agg(F.count(F.lit(1))).scalar()
    return kept.unionAll(more.select((F.lit(slots) + (F.col("block") - F.col("have")) * sources + F.col("rank")).alias("slot"), "rank", "block"))


def shuffled_stream(sizes: DataFrame, passes: int = PASSES, digits: int = DIGITS, seed: int = 0) -> DataFrame:
    """(rank, pass, key, size, upto, at): where each document starts in its source's stream of ``passes`` shuffled passes."""
    again = sizes.filter("size > 0").select("rank", "key", "id", "size", "upto", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("pass"))
    mixed = again.withColumn("h", F.md5(F.concat_ws(":", F.lit(str(seed)), "pass", F.coalesce(F.col("id").cast("string"), F.lit("")))))
    mixed = mixed.withColumn("group", F.concat_ws(":", "pass", F.substring("h", 1, digits)))
    placed = _offsets(mixed, "rank", "group", F.col("size"))
    inside = Window.partitionBy("rank", "group").orderBy("h", "key").rowsBetween(Window.unboundedPreceding, -1)
    located = mixed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(placed, ["rank", "group"])
    return located.select("rank", "pass", "key", "size", "upto", (F.col("offset") + F.col("inside")).alias("at"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS,
    share: float = SHARE, passes: int = PASSES, block: int | None = None, digits: int = DIGITS, seed: int = 0,
) -> Mix:
    """The mix of all documents. ``block`` is its words per slot; by default a fiftieth of the smallest target, but at most
    4,096 words and at least a sixteenth of the mean document, which keeps slots and pieces in proportion to the documents.
    What a source takes does not hang on it."""
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sizes = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size")).withColumn("key", F.monotonically_increasing_id()), "mix-sizes")
    targets = cut(source_targets(sizes, weights, share, passes), "mix-targets")
    facts = targets.agg(F.sum("target").alias("all"), F.min(F.when(F.col("target") > 0, F.col("target"))).alias("least")).first()
    if not 1 <= passes <= 10 or (block is not None and block < 1):
        raise ValueError("passes go from 1 to 10, and a block has a word at least")
    if block is None:
        mean = sizes.agg(F.avg(F.when(F.col("size") > 0, F.col("size")))).first()[0] or 1
        block = int(min(4096, max(1, (facts["least"] or 1) // 50, mean // 16)))
    slots = int((facts["all"] or 0) / block + 0.5)
    # Written in two steps: what is drawn is used twice, and the plan of the whole mix stays small on the driver.
    schedule = cut(wanted_slots(cut(schedule_slots(spark, targets, slots), "mix-drawn"), targets, slots, block), "mix-schedule")
    ranked = sizes.join(targets, sizes["source"].eqNullSafe(targets["source"])).select("key", "id", "size", "rank", targets["words"].alias("upto"))
    stream = shuffled_stream(ranked, passes, digits, seed)
    last = F.least(F.col("at") + F.col("size"), "upto")  # the stream is used up to the source's target
    touched = F.sequence(F.floor(F.col("at") / block), F.floor((F.col("last") - 1) / block))
    pieces = stream.filter("at < upto").withColumn("last", last).withColumn("block", F.explode(touched))
    start = F.greatest(F.col("at"), F.col("block") * block)
    end = F.least(F.col("last"), (F.col("block") + 1) * block)
    pieces = pieces.select("rank", "block", "pass", "key", (start - F.col("at")).alias("start"), (end - start).alias("words"))
    used = pieces.join(schedule, ["rank", "block"])
    taken = used.groupBy("key").agg(F.sum("words").alias("taken"))
    return Mix(sizes, targets, schedule, used.select("slot", "rank", "block", "pass", "key", "start", "words"), taken)


def mixed_documents(made: Mix) -> DataFrame:
    """Per document its size, its source's size and target, and the words the mix takes of it."""
    known = made.sizes.alias("d").join(made.targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    known = known.select("d.key", "d.id", F.col("d.source").alias("source"), "size", "source_size", "target")
    return known.join(made.taken, "key", "left").select("key", "id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
