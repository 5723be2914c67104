"""Substring search over an inverted index of trigrams, kept beside the marts.

Every row gets a number, and every three neighbouring bytes of its searched texts (as UTF-8, each byte shown as the
character of its number) lead to a list of row numbers. A query's trigrams are looked up, their lists intersected, and what
is left is read and verified with ``contains``. So a search reads the posting lists of its trigrams and the parts of the
table that hold candidates, not all rows. A query of one or two bytes takes the lists of all trigrams that begin with it:
texts end in two marks, so that every byte begins one. The rows found are those ``contains_text`` finds by a scan, whatever
the query.

Lists hold at most 65,536 rows of one part of the table, however common a trigram is, and parts are intersected apart.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.text import contains_text, label
from fleetlens.sources.catalog import MartCatalog, input_version
from fleetlens.sources.tables import Tables

_BITS = 16  # of a row's number: its place in its part
_END = "\x00\x00"
_ROW, _PART = "_row", "_part"


def numbered_rows(df: DataFrame) -> DataFrame:
    """``df`` with row numbers and the part of the table each row lies in; to be written before it is indexed."""
    return df.withColumn(_ROW, F.monotonically_increasing_id()).withColumn(_PART, F.shiftright(_ROW, _BITS))


def shown_bytes(text: Column) -> Column:
    """The UTF-8 bytes of a text, each as the character of its number."""
    return F.decode(text.cast("binary"), "ISO-8859-1")


def postings(rows: DataFrame, texts: Mapping[str, Column]) -> DataFrame:
    """(field, gram, part, places): per searched text and trigram the rows that hold it, ordered by trigram.

    Rows are grouped by one number that holds part, field and trigram: Spark sorts such a key by its digits, while a key
    of several columns, texts among them, is compared row by row.
    """
    names = list(texts)
    found = F.explode(F.array(*(F.struct(F.lit(i).alias("field"), shown_bytes(F.concat(F.lower(F.coalesce(c.cast("string"), F.lit(""))), F.lit(_END))).alias("text")) for i, c in enumerate(texts.values()))))
    fields = rows.select(_ROW, _PART, found.alias("f")).select(_ROW, _PART, "f.field", "f.text").filter(F.length("text") > len(_END))
    each = fields.select("*", F.explode(F.sequence(F.lit(1), F.length("text") - len(_END))).alias("at"))
    number = F.col(_PART).cast("bigint") * len(names) + F.col("field")
    for i in range(3):
        number = F.shiftleft(number, 8) + F.ascii(F.substring(F.col("text"), F.col("at") + i, F.lit(1)))
    place = F.col(_ROW).bitwiseAND((1 << _BITS) - 1).cast("int")
    lists = each.select(number.alias("number"), place.alias("place")).groupBy("number").agg(F.array_distinct(F.sort_array(F.collect_list("place"))).alias("places"))
    where_from = F.shiftright("number", 24)
    gram = F.concat(*(F.chr(F.shiftright("number", shift).bitwiseAND(255)) for shift in (16, 8, 0)))
    named = F.element_at(F.array(*map(F.lit, names)), (where_from % len(names) + 1).cast("int"))
    lists = lists.select(named.alias("field"), gram.alias("gram"), F.expr(f"number div {len(names) << 24}L").alias(_PART), "places")
    order = ["gram", "field", _PART]
    return lists.repartitionByRange(*order).sortWithinPartitions(*order)


@dataclass(frozen=True)
class TextIndex:
    """A table, numbered and written by parts, with its posting lists."""

    rows: DataFrame
    lists: DataFrame
    texts: Mapping[str, Column]

    def candidates(self, query: str, fields: Sequence[str]) -> DataFrame:
        """(part, row number) of rows one of whose ``fields`` holds all trigrams of a lower-case query."""
        query = query.encode().decode("latin-1")
        mine = self.lists.filter(F.col("field").isin(list(fields)))
        if len(query) < 3:
            places = mine.filter(F.col("gram").startswith(query)).select(_PART, F.explode("places").alias("place"))
        else:
            grams = sorted({query[i : i + 3] for i in range(len(query) - 2)})
            held = mine.filter(F.col("gram").isin(grams)).groupBy("field", _PART).agg(*(F.max(F.when(F.col("gram") == g, F.col("places"))).alias(f"g{i}") for i, g in enumerate(grams)))
            both = reduce(F.array_intersect, (F.col(f"g{i}") for i in range(len(grams))))
            places = held.dropna().select(_PART, F.explode(both).alias("place"))
        return places.select(_PART, F.shiftleft(F.col(_PART).cast("bigint"), _BITS).bitwiseOR(F.col("place").cast("bigint")).alias(_ROW)).distinct()

    def search(self, query: str, fields: Sequence[str] = (), min_length: int = 2) -> DataFrame:
        """The rows that contain ``query`` in one of ``fields`` (all by default), whatever the case; a shorter query
        than ``min_length`` restricts nothing."""
        fields = list(fields) or list(self.texts)
        hit = contains_text([self.texts[f] for f in fields], query, min_length)
        if hit is None:
            return self.rows.drop(_ROW, _PART)
        wanted = self.candidates(query.lower(), fields)
        return self.rows.join(wanted, [_PART, _ROW], "left_semi").filter(hit).drop(_ROW, _PART)


def center_index(tables: Tables, catalog: MartCatalog | None = None) -> TextIndex:
    """What hubs, centers, devices and adapters are looked up by."""
    texts = {c: label(c, "") for c in ("HubName", "Centername", "DeviceID", "MacSerialID")} | {c: F.col(c).cast("string") for c in ("HubID", "CenterID")}
    return text_index(tables.centers, "center-search", texts, catalog)


def service_index(tables: Tables, catalog: MartCatalog | None = None) -> TextIndex:
    """What field-service tickets are searched by."""
    return text_index(tables.service, "service-search", {c: F.col(c) for c in ("ticket_id", "contact_person_name", "representative")}, catalog)


def text_index(df: DataFrame, name: str, texts: Mapping[str, Column], catalog: MartCatalog | None = None) -> TextIndex:
    """The index of ``df`` over ``texts``, built when this version of the table is first searched."""
    catalog = catalog or MartCatalog(df.sparkSession)
    version = input_version(df.sparkSession, {name: df}, texts=",".join(f"{k}={c}" for k, c in texts.items()))
    rows = catalog.resolve(f"{name}-rows", version, lambda: numbered_rows(df), partition=_PART)
    return TextIndex(rows, catalog.resolve(f"{name}-grams", version, lambda: postings(rows, texts)), texts)
