"""Column functions over JSON text and nested values of a knowledge base."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_field(x: Column, path: str) -> Column:
    return F.get_json_object(x, path)


def project_item(instance: Column) -> dict[str, Column]:
    """The parts of an item's JSON that are kept: id, and aliases, label, description, claims, sitelinks as JSON text."""
    paths = {"id": "$.id", "aliases": "$.aliases.en", "label": "$.labels.en", "description": "$.descriptions.en", "claims": "$.claims", "sitelinks": "$.sitelinks"}
    return {name: F.get_json_object(instance, path) for name, path in paths.items()}


def alias_list(x: Column) -> Column:
    """English alias values; null JSON gives an empty array."""
    parsed = F.from_json(x, "array<struct<language string, value string>>")
    return F.coalesce(F.transform(F.filter(parsed, lambda a: a["language"] == "en"), lambda a: a["value"]), F.array().cast("array<string>"))


def label_value(x: Column) -> Column:
    return F.coalesce(F.get_json_object(x, "$.value"), F.lit(""))


def item_statements(claims: Column) -> Column:
    """(property, qid) of every claim whose value is an item; the id from the numeric one where it is missing."""
    shape = "map<string, array<struct<mainsnak: struct<datavalue: struct<type: string, value: string>>>>>"
    parsed = F.map_entries(F.from_json(claims, shape))

    def of(entry: Column) -> Column:
        values = F.filter(F.transform(entry["value"], lambda c: c["mainsnak"]["datavalue"]), lambda d: d["type"] == "wikibase-entityid")
        kind = lambda d: F.coalesce(F.get_json_object(d["value"], "$.entity-type"), F.lit("item"))
        items = F.filter(values, lambda d: kind(d) == "item")
        qid = lambda d: F.coalesce(F.get_json_object(d["value"], "$.id"), F.concat(F.lit("Q"), F.get_json_object(d["value"], "$.numeric-id")))
        return F.filter(F.transform(items, lambda d: F.struct(entry["key"].alias("property"), qid(d).alias("qid"))), lambda s: s["qid"].isNotNull())

    return F.coalesce(F.flatten(F.transform(parsed, of)), F.array().cast("array<struct<property string, qid string>>"))


def sitelink_titles(x: Column) -> Column:
    """(type, title) of every site link; null JSON gives an empty array."""
    parsed = F.map_entries(F.from_json(x, "map<string, struct<title: string>>"))
    made = F.transform(parsed, lambda e: F.struct(e["key"].alias("type"), e["value"]["title"].alias("title")))
    return F.coalesce(made, F.array().cast("array<struct<type string, title string>>"))


def has_sitelink(sitelinks: Column, name: str) -> Column:
    return F.exists(sitelinks, lambda s: s["type"] == name)


def is_instance_of(statements: Column, qid: str) -> Column:
    return F.exists(statements, lambda s: (s["property"] == "P31") & (s["qid"] == qid))


def label_line(value: Column) -> Column:
    """A line of item, label and |-joined aliases as (qid, aliases), the label first; empty aliases go if there is a label."""
    f = F.split(value, "\t")
    label, aliases = F.coalesce(F.get(f, 1), F.lit("")), F.split(F.coalesce(F.get(f, 2), F.lit("")), r"\|")
    kept = F.when(label != "", F.concat(F.array(label), F.filter(aliases, lambda a: a != ""))).otherwise(aliases)
    return F.struct(F.get(f, 0).alias("qid"), kept.alias("aliases"))


def first_nonblank(*columns: Column) -> Column:
    """The first column that isn't null or blank, as it stands."""
    return F.coalesce(*(F.when(c.rlike(r"\P{IsWhite_Space}"), c) for c in columns))


def top_speaker(name: Column, probas: Column) -> Column:
    """(speaker, qid, probability): the best item among the candidates of that name, the later on ties; else the best candidate of any name, the earlier on ties."""
    empty = F.struct(F.lit(None).cast("string").alias("speaker"), F.lit(None).cast("string").alias("qid"), F.lit(-1.0).alias("probability"))

    def pick(only_name: bool):
        def step(best: Column, c: Column) -> Column:
            better = (c["probability"] >= best["probability"]) if only_name else (c["probability"] > best["probability"])
            fits = better & (c["qid"].isNotNull()) & ((c["speaker"] == name) if only_name else F.lit(True))
            return F.when(fits, F.struct(c["speaker"].alias("speaker"), c["qid"].alias("qid"), c["probability"].cast("double").alias("probability"))).otherwise(best)

        return F.aggregate(probas, empty, step)

    own, best = pick(True), pick(False)
    return F.when(own["qid"].isNotNull(), own).when(best["qid"].isNotNull(), best).otherwise(F.struct(name.alias("speaker"), F.lit(None).cast("string").alias("qid"), F.lit(0.0).alias("probability")))


def candidate_probas(local: Column, fallback: Column) -> Column:
    """(speaker, qid, probability) of the candidates that have an item, from the local list, or where that is empty the other one.

    The item is a candidate's first; a missing name is empty, a missing probability 0.
    """
    none = F.array().cast("array<struct<speaker string, qids array<string>, probability double>>")
    chosen = F.when(F.coalesce(F.size(local), F.lit(0)) > 0, local).otherwise(F.coalesce(fallback, none))
    known = F.filter(chosen, lambda c: F.coalesce(F.size(c["qids"]), F.lit(0)) > 0)
    return F.transform(known, lambda c: F.struct(F.coalesce(c["speaker"], F.lit("")).alias("speaker"), F.get(c["qids"], 0).alias("qid"), F.coalesce(c["probability"], F.lit(0.0)).alias("probability")))


def mentioned_entities(mentions: Column, names: Column) -> Column:
    """Sorted distinct items of a quotation's mentions (qid, else wikidata_id) and of all its article's names that have offsets."""
    own = F.transform(F.coalesce(mentions, F.array().cast("array<struct<qid string, wikidata_id string>>")), lambda m: F.coalesce(F.nullif(m["qid"], F.lit("")), F.nullif(m["wikidata_id"], F.lit(""))))
    placed = F.filter(F.coalesce(names, F.array().cast("array<struct<ids array<string>, offsets string>>")), lambda n: n["offsets"].isNotNull())
    ids = F.flatten(F.transform(placed, lambda n: F.coalesce(n["ids"], F.array().cast("array<string>"))))
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(own, ids))))
