"""Duplicates hidden by formatting: canonical forms, 128-bit hashes, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pairing import memberships
from .textforms import canonical

#: An opening line of KEY: value fields parted by semicolons, in any letter case.
HEADER = r"^\p{IsWhite_Space}*([A-Za-z]+[ \t]*:[^;\r\n]*(?:;[ \t]*[A-Za-z]+[ \t]*:[^;\r\n]*)+);?[ \t]*(?:\r?\n|\r|$)"


def field_order_free(text: Column) -> Column:
    """canonical() with the fields of an opening KEY: value line sorted; null where the text has no such line."""
    line = F.regexp_extract(text, HEADER, 1)
    fields = F.array_sort(F.transform(F.split(line, ";"), canonical))
    rest = canonical(F.regexp_replace(text, HEADER, ""))
    return F.when(line != "", F.concat(F.array_join(fields, ";"), F.lit("|"), rest))


def hash128(form: Column) -> Column:
    """128 bits of MD5 as binary."""
    return F.unhex(F.md5(form))


def content_keys(df: DataFrame, text: str, *keep: str, fields: bool = False) -> DataFrame:
    """keep and h128, check for each canonical form of each row whose text has a letter or digit.

    A text with an opening field line has two forms if fields is set: as it stands, and with sorted fields. check is
    a second, independent 64-bit hash, so that a collision of the 128 bits shows.
    """
    forms = F.array_compact(F.array(canonical(F.col(text)), field_order_free(F.col(text)))) if fields else F.array(canonical(F.col(text)))
    rows = df.where(F.col(text).isNotNull()).select(*keep, F.explode(forms).alias("form")).where("form <> '' and form <> '|'")
    return rows.select(*keep, hash128(F.col("form")).alias("h128"), F.xxhash64("form").alias("check"))


def collapse(df: DataFrame, id_col: str, text: str, fields: bool = False) -> DataFrame:
    """One row (record, copies, ids, collided) for each content: the least id, rows and distinct ids.

    Rows whose text is null or has neither letter nor digit aren't records and give none. Only hashes and ids are
    shuffled, after map-side combining, so a content that holds a third of all rows costs each task one row. collided
    says that texts which differ met in one 128-bit hash (by the second hash); such a class is split by it.
    """
    form = F.coalesce(field_order_free(F.col(text)), canonical(F.col(text))) if fields else canonical(F.col(text))
    rows = df.select(F.col(id_col).alias("_id"), form.alias("form")).where("form <> '' and form <> '|' and _id is not null")
    rows = rows.select("_id", hash128(F.col("form")).alias("h128"), F.xxhash64("form").alias("check"))
    per_id = rows.groupBy("h128", "check", "_id").agg(F.count("*").alias("n"))
    per_form = per_id.groupBy("h128", "check").agg(F.min("_id").alias("record"), F.sum("n").alias("copies"), F.count("*").alias("ids"))
    per_hash = per_form.groupBy("h128").agg(F.count("*").alias("forms"))
    hit = per_hash.where("forms > 1")
    return per_form.join(hit, "h128", "left").select("record", "copies", "ids", F.col("forms").isNotNull().alias("collided"))


def copy_classes(df: DataFrame, id_col: str, text: str, fields: bool = False) -> DataFrame:
    """One row (id, record, ids) for each id of a content: the least id of all copies, and how many ids they have.

    Classes and left-out rows as in collapse(). An id with several contents has a row for each.
    """
    form = F.coalesce(field_order_free(F.col(text)), canonical(F.col(text))) if fields else canonical(F.col(text))
    rows = df.select(F.col(id_col).alias("_id"), form.alias("form")).where("form <> '' and form <> '|' and _id is not null")
    return memberships(rows.select("_id", hash128(F.col("form")).alias("h128"), F.xxhash64("form").alias("check")), ["h128", "check"], "_id")
