"""Variant spellings of names: prefix-filtered q-gram join, soft weighted token similarity, linked clusters."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.lineage import cut
from .pairing import class_pairs

# fixed values: English short forms of first names
NICKNAMES = {
    "alexander": "alex al sandy sasha", "amanda": "mandy", "andrew": "andy drew", "anthony": "tony", "barbara": "barb babs", "benjamin": "ben benny benjy", "catherine": "cathy kate cath",
    "charles": "charlie chuck", "christopher": "chris kit topher", "daniel": "dan danny", "david": "dave", "deborah": "deb debbie debby", "donald": "don donny", "edward": "ed eddie ted",
    "elizabeth": "betty beth liz lizzie eliza bess libby", "frances": "fran", "frederick": "fred freddie freddy", "gregory": "greg", "helen": "nell", "henry": "harry hank", "jacob": "jake",
    "james": "jim jimmy jamie", "jennifer": "jen jenny", "john": "jack johnny", "jonathan": "jon", "joseph": "joe joey", "katherine": "kate kathy katie kat kathryn", "kenneth": "ken kenny",
    "lawrence": "larry", "leonard": "len lenny", "margaret": "maggie meg peggy marge", "matthew": "matt", "michael": "mike mick mickey", "nathaniel": "nate nat", "nicholas": "nick nicky",
    "pamela": "pam", "patricia": "pat patty tricia trish", "patrick": "pat paddy", "peter": "pete", "philip": "phil", "raymond": "ray", "rebecca": "becky", "richard": "dick rick rich",
    "robert": "bob rob bobby robbie bert", "ronald": "ron", "samuel": "sam sammy", "sandra": "sandy", "stephen": "steve", "susan": "sue susie suzy", "theodore": "ted theo teddy", "thomas": "tom tommy",
    "timothy": "tim", "victoria": "vicky", "vincent": "vince", "walter": "walt", "william": "will bill billy willie liam",
}
# fixed values: words before a name, pronouns, short forms of kinds of organisation
TITLES = set("mr mrs ms miss mx dr prof professor sir dame lord lady rev hon judge justice mayor minister president senator sen sens rep reps gov governor gen general col captain capt elder sister brother father".split())
PRONOUNS = set("i me you he him she her it we us they them who whom someone somebody everyone everybody nobody none anyone anybody both one others".split())
KINDS = {
    "institute": "inst", "department": "dept dep", "committee": "comm cttee", "federation": "fed", "university": "univ uni", "company": "co comp", "association": "assn assoc ass'n", "ministry": "min", "agency": "agcy",
    "bureau": "bur", "council": "cncl", "commission": "commn", "corporation": "corp", "foundation": "fdn found", "society": "soc", "college": "coll", "office": "off", "board": "bd", "union": "un", "organisation": "org", "organization": "org",
}
#: Letters that a last name without first name needs for a typing error to be forgiven.
LONE_LAST = 5
_KIND_OF = {s: k for k, short in KINDS.items() for s in short.split()} | {k: k for k in KINDS}
_NICK_OF: dict[str, set[str]] = {}
for _full, _short in NICKNAMES.items():
    for _s in [_full, *_short.split()]:
        _NICK_OF.setdefault(_s, set()).add(_full)
_INITIAL_O = regex.compile(r"^([A-Z])o([A-Z])$")


def parse(name: str, titles: frozenset[str] = frozenset(TITLES), pronouns: frozenset[str] = frozenset(PRONOUNS)) -> tuple[str, str, str, str] | None:
    """(kind, first, initials, last) of a name, or None if it names nobody.

    kind "p": a person's first name or "", further initials, last name. kind "o": an organisation's place as first, its
    kind as initials, and what it is for as last; a kind known by its initial only is one letter.
    """
    text = unicodedata.normalize("NFKC", name).strip()
    text = regex.sub(r"\s*[’'`´]s$", "", text)
    if not regex.search(r"\p{L}", text):
        return None
    acronym = regex.match(r"(?i:the )?(.*\S)\s+([A-Z]o[A-Z])\s*\((.*)\)$", text)
    if acronym:
        return "o", _fold(acronym.group(1)), acronym.group(2)[0].lower(), _fold(acronym.group(3))
    words = [w for w in regex.split(r"[\s\-‐‑_]+", text) if w]
    low = [w.lower().strip(".,;:()'’\"“”") for w in words]
    if low and low[0] == "the":
        words, low, article = words[1:], low[1:], True
    else:
        article = bool(low) and low[0] in ("a", "an") and len(low) > 1 and not words[0].endswith(".") and words[0].islower()
    at = next((i for i, w in enumerate(low) if w in _KIND_OF and len(low) > 2), None)
    if at is not None:
        if len(low) > at + 2 and low[at + 1] in ("of", "for"):
            rest = " ".join(words[at + 2 :])
            place = " ".join(low[:at])
            if "," in rest and not place:
                rest, _, place = rest.partition(",")
            if place:
                return "o", _fold(place), _KIND_OF[low[at]], _fold(rest)
        elif at == len(low) - 1 and len(low) >= 3:
            return "o", _fold(low[0]), _KIND_OF[low[at]], _fold(" ".join(low[1:at]))
    if article:
        return None
    if "," in text:
        tail, _, head = text.partition(",")
        words = [w for w in regex.split(r"[\s\-‐‑_]+", f"{head} {tail}") if w]
    shouting = text.upper() == text
    kept: list[str] = []
    for w in words:
        bare = w.strip(".,;:()'’\"“”")
        if bare.lower() in titles and (len(bare) > 1) and not kept:
            continue
        if bare:
            kept.append(w.rstrip(",;:"))
    full, initials = [], ""
    for w in kept:
        bare = w.strip(".,;:()'’\"“”")
        if len(bare) == 1 or (len(bare) == 2 and bare.isupper() and (not shouting or len(kept) == 2)) or regex.fullmatch(r"(?:\p{L}\.)+", w):
            initials += regex.sub(r"\P{L}", "", w).lower()
        else:
            full.append(bare.lower())
    if not full or all(w in pronouns or w in titles for w in full) or full[-1] in pronouns:
        return None
    last = full[-1]
    first = full[0] if len(full) > 1 else ""
    if not first and not initials and text.islower() and len(words) > 1:
        return None
    return "p", first, initials + "".join(w[0] for w in full[1:-1]), last


def _fold(text: str) -> str:
    return " ".join(regex.sub(r"[^\p{L}\p{N} ]", "", text.lower()).split())


def one_edit(a: str, b: str) -> bool:
    """Whether one insertion, deletion, replacement or swap of neighbours, or nothing, turns a into b."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (a[i + 2 :] == b[i + 2 :] and a[i : i + 2] == b[i : i + 2][::-1])


EQUAL, SHORT, TYPED, OTHER = 0, 1, 2, 3


def token_match(a: str, b: str) -> int:
    """EQUAL tokens, SHORT form or initial of each other, TYPED with one error, or OTHER."""
    if a == b:
        return EQUAL
    if len(a) == 1 or len(b) == 1:
        return SHORT if a[:1] == b[:1] else OTHER
    if _NICK_OF.get(a, {a}) & _NICK_OF.get(b, {b}):
        return SHORT
    return TYPED if min(len(a), len(b)) >= 2 and max(len(a), len(b)) >= 3 and one_edit(a, b) else OTHER


def rarity(df: Column, total: Column) -> Column:
    """1 for a token of one name among all, towards 0 the more names have it."""
    return F.log(1 + total / df) / F.log(1 + total)


def soft_similarity(places: Sequence[tuple[Column, Column, Column]], total: Column) -> Column:
    """Mean similarity of the tokens of two names, weighted by rarity; places: match, and how many names have each token.

    A short form counts 0.9. One typing error counts as much as it is likely to be one: fully if one of the two tokens
    is rare, among all names or beside the other, and little if both are frequent tokens of their own.
    """
    weighted, weights = F.lit(0.0), F.lit(0.0)
    for match, a, b in places:
        rare = rarity(F.least(a, b), total)
        typed = 1 - F.least(2 * (1 - rare), 8 * F.least(a, b) / F.greatest(a, b), F.lit(1.0))
        alike = F.when(match == EQUAL, 1.0).when(match == SHORT, 0.9).otherwise(typed)
        weighted, weights = weighted + rare * alike, weights + rare
    return weighted / weights


def _parsed(titles: frozenset[str], pronouns: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n, parse(n, titles, pronouns)) for n in batch.column(0).to_pylist()]
            rows = [(n, *p) for n, p in rows if p]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows) if rows else [()] * 5)], ["name", "kind", "first", "initials", "last"])

    return run


def token_grams(token: str) -> set[str]:
    """The q-grams of a token by which it is found: its start and its end of just under half its length.

    One typing error, the swap of neighbours included, leaves the start or the end of the shorter token's half whole, so
    of each token's q-grams these few are a prefix that no pair escapes. Tokens that may have partners of other lengths
    give the q-grams of both q; where a half has no letter the q-gram is empty.
    """
    out = set()
    for q in {max(0, (len(token) - 1) // 2), max(0, (len(token) - 2) // 2)}:
        out |= {f"{token[:q]}^", f"{token[len(token) - q :]}$"} if q else {""}
    return out


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The names, once for each pair of q-grams of their last and first token; a short form also has those of what it may stand for."""
    for batch in batches:
        rows, lasts, firsts = [], [], []
        get = lambda n: batch.column(batch.schema.get_field_index(n)).to_pylist()
        for row, (kind, first, last) in enumerate(zip(get("kind"), get("first"), get("last"))):
            heads = set().union(*(token_grams(t) for t in ({first} | _NICK_OF.get(first, set()) if kind == "p" else {first})))
            for x in token_grams(last):
                rows += [row] * len(heads)
                lasts += [x] * len(heads)
                firsts += heads
        kept = [c.take(pa.array(rows, pa.int64())) for c in batch.columns]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(lasts, pa.string()), pa.array(firsts, pa.string())], [*batch.schema.names, "l", "f"])


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates whose tokens fit, with how they fit."""
    for batch in batches:
        get = lambda n: batch.column(batch.schema.get_field_index(n)).to_pylist()
        first = [token_match(x, y) for x, y in zip(get("a_first"), get("b_first"))]
        last = [token_match(x, y) for x, y in zip(get("a_last"), get("b_last"))]
        clash = [
            (x and y and x[0] != y[0]) if kind == "p" else token_match(x, y) == OTHER for kind, x, y in zip(get("kind"), get("a_initials"), get("b_initials"))
        ]
        keep = pa.array([f != OTHER and g != OTHER and not c for f, g, c in zip(first, last, clash)], pa.bool_())
        out = batch.append_column("first_match", pa.array(first, pa.int32())).append_column("last_match", pa.array(last, pa.int32()))
        yield out.filter(keep).select(["a", "b", "kind", "a_first", "b_first", "a_last", "b_last", "first_match", "last_match"])


def parsed_names(names: DataFrame, column: str, titles: Sequence[str] = (), pronouns: Sequence[str] = ()) -> DataFrame:
    """Rows (name, kind, first, initials, last) of the distinct names that name somebody."""
    t, p = frozenset(TITLES | {x.lower() for x in titles}), frozenset(PRONOUNS | {x.lower() for x in pronouns})
    some = names.where(F.col(column).isNotNull()).select(F.col(column).alias("name")).distinct()
    return some.mapInArrow(_parsed(t, p), "name string, kind string, first string, initials string, last string")


def candidates(full: DataFrame) -> DataFrame:
    """Pairs of full names that share a q-gram of their last and one of their first token, and whose last tokens are near.

    Both q-grams, each about half a token, and the kind are one join key, so its groups are small; the bound on the edit
    distance of the last tokens is part of the join, so that only pairs within it leave it.
    """
    grams = cut(full.select("key", "kind", "first", "initials", "last").mapInArrow(_grams, "key string, kind string, first string, initials string, last string, l string, f string"))
    side = lambda s, k: grams.select("kind", "l", "f", F.col("key").alias(k), *(F.col(c).alias(f"{s}_{c}") for c in ("first", "initials", "last")))
    met = side("a", "a").join(side("b", "b"), ["kind", "l", "f"]).where("a < b and abs(length(a_last) - length(b_last)) <= 1 and levenshtein(a_last, b_last, 2) >= 0")
    return met.drop("l", "f").distinct()


def full_pairs(full: DataFrame, threshold: float, salts: int = 16) -> DataFrame:
    """Pairs (a, b) of keys of full names that are similar enough.

    Pairs without a typing error need no weights. For the others the names that have each token are counted; a token in
    many pairs is met in `salts` parts.
    """
    fit = cut(candidates(full).mapInArrow(_matched, "a string, b string, kind string, a_first string, b_first string, a_last string, b_last string, first_match int, last_match int"))
    typed = (F.col("first_match") == TYPED) | (F.col("last_match") == TYPED)
    count = lambda place: full.groupBy("kind", F.col(place).alias("token")).agg(F.count("*").alias("n")).withColumn("salt", F.explode(F.expr(f"sequence(0, {salts} - 1)")))
    near = fit.where(typed).withColumn("salt", F.pmod(F.xxhash64("a", "b"), F.lit(salts)).cast("int"))
    for place in ("first", "last"):
        for s in "ab":
            near = near.join(count(place).withColumnsRenamed({"token": f"{s}_{place}", "n": f"{s}_{place}_n"}), ["kind", f"{s}_{place}", "salt"])
    near = near.crossJoin(F.broadcast(full.groupBy().agg(F.count("*").alias("total"))))
    score = soft_similarity([(F.col(f"{p}_match"), F.col(f"a_{p}_n"), F.col(f"b_{p}_n")) for p in ("first", "last")], F.col("total"))
    return fit.where(~typed).select("a", "b").unionByName(near.where(score >= threshold).select("a", "b"))


def _one_error(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        last, near = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("last", "near"))
        yield batch.filter(pa.array([min(len(a), len(b)) >= LONE_LAST and one_edit(a, b) for a, b in zip(last, near)], pa.bool_()))


def _last_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sorted(token_grams(x)) for x in batch.column(batch.schema.get_field_index("last")).to_pylist()]
        rows = np.repeat(np.arange(batch.num_rows), [len(x) for x in found])
        yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows)) for c in batch.columns), pa.array([g for x in found for g in x], pa.string())], [*batch.schema.names, "gram"])


def near_lasts(short: DataFrame, full: DataFrame) -> DataFrame:
    """Rows (kind, place, last, near): for last names of short forms that no full form has, those of full forms one typing error away.

    Same q-grams as full_pairs; both have LONE_LAST letters or more, as no first name backs the match.
    """
    keys = ["kind", "place", "last"]
    known = full.select(*keys).distinct()
    both = known.withColumn("full", F.lit(True)).unionByName(short.select(*keys).distinct().join(known, keys, "left_anti").withColumn("full", F.lit(False)))
    grams = cut(both.where(F.length("last") >= LONE_LAST).mapInArrow(_last_grams, "kind string, place string, last string, full boolean, gram string"))
    met = grams.where("not full").drop("full").join(grams.where("full").drop("full").withColumnRenamed("last", "near"), ["kind", "place", "gram"])
    met = met.where("abs(length(last) - length(near)) <= 1 and levenshtein(last, near, 2) >= 0").select(*keys, "near").distinct()
    return cut(met.mapInArrow(_one_error, "kind string, place string, last string, near string"))


def name_clusters(names: DataFrame, column: str, titles: Sequence[str] = (), pronouns: Sequence[str] = (), threshold: float = 0.7) -> DataFrame:
    """Rows (name, cluster): spellings of one person or organisation share a cluster; spellings of nobody have no row.

    Full names (first and last, or an organisation's three parts) are linked if their tokens agree but for short forms
    and one typing error each, and the mean of their similarities, weighted by rarity, reaches the threshold: an error in
    a frequent first name is forgiven beside a rare last name, not beside a frequent one, and two frequent tokens one
    letter apart are two. A name without first name is linked to the full names with its last
    name, or if there are none to those with one a typing error away, if these are one cluster among those that its
    initials allow; else it stands with its like. Names that differ
    only in case, blanks, hyphens, titles, order, possessive or middle initials are the same at once. Null and empty
    names, pronouns and roles are left out. Work per name is bounded by its rarest q-grams; a name in a third of all rows
    counts once.
    """
    parsed = cut(parsed_names(names, column, titles, pronouns))
    is_full = (F.col("first") != "") & ((F.col("kind") == "p") | (F.length("initials") > 1))
    key = F.when(F.col("kind") == "p", F.concat_ws("|", "kind", "first", "last")).otherwise(F.concat_ws("|", "kind", "first", "initials", "last"))
    full = parsed.where(is_full).withColumn("key", key)
    forms = cut(full.groupBy("key", "kind", "first", "last").agg(F.max(F.when(F.col("kind") == "o", F.col("initials")).otherwise("")).alias("initials")))
    parts = connected_components(full_pairs(forms, threshold), "a", "b").withColumnRenamed("node", "key")
    clusters = cut(forms.join(parts, "key", "left").withColumn("cluster", F.coalesce("component", "key")).drop("component"))
    known = full.join(clusters.select("key", "cluster"), "key").select("name", "cluster")
    short = parsed.where(~is_full).withColumn("initial", F.when(F.col("kind") == "p", F.substring("initials", 1, 1)).otherwise(F.col("initials")))
    # a short form: last name and perhaps an initial; or an organisation with the initial of its kind
    forms_short = short.select("kind", F.when(F.col("kind") == "o", F.col("first")).otherwise("").alias("place"), "initial", "last").distinct()
    c = clusters.select("kind", F.when(F.col("kind") == "o", F.col("first")).otherwise("").alias("place"), F.substring(F.when(F.col("kind") == "o", F.col("initials")).otherwise(F.col("first")), 1, 1).alias("letter"), "last", "cluster").distinct()
    fits = forms_short.join(c, ["kind", "place", "last"])
    near = forms_short.join(near_lasts(forms_short, c), ["kind", "place", "last"]).join(c.withColumnRenamed("last", "near"), ["kind", "place", "near"])
    fits = fits.unionByName(near.drop("near")).where("initial = '' or initial = letter")
    chosen = fits.groupBy("kind", "place", "initial", "last").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high"))
    alone = F.concat_ws("|", F.lit("short"), "kind", "place", "last", "initial")
    placed = forms_short.join(chosen, ["kind", "place", "initial", "last"], "left")
    lonely = placed.where("low is null").groupBy("kind", "place", "last").agg(F.max("initial").alias("most"), F.min(F.when(F.col("initial") != "", F.col("initial"))).alias("least"))
    placed = placed.join(lonely, ["kind", "place", "last"], "left")
    one = F.concat_ws("|", F.lit("short"), "kind", "place", "last", F.coalesce("least", F.lit("")))
    cluster = F.when(F.col("low") == F.col("high"), F.col("low")).when(F.col("low").isNull() & (F.col("most") == F.coalesce("least", F.lit(""))), one).otherwise(alone)
    placed = placed.select("kind", "place", "initial", "last", cluster.alias("cluster"))
    rest = short.withColumn("place", F.when(F.col("kind") == "o", F.col("first")).otherwise("")).join(placed, ["kind", "place", "initial", "last"]).select("name", "cluster")
    return known.unionByName(rest)


def name_pairs(names: DataFrame, column: str, **options) -> DataFrame:
    """Pairs (lo, hi) of different strings, by code point, in one cluster."""
    return class_pairs(name_clusters(names, column, **options), ["cluster"], "name")
