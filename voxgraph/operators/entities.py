"""Person mentions by a gazetteer: n-gram hash joins in place of a trie."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import NO_SPEAKER
from ..functions.text import TARGET_QUOTE, phase_text
from .lineage import cut

#: Parts a token key's tokens; no token has it.
SEP = "\u0001"


def token_key(tokens: Column) -> Column:
    return F.lower(F.array_join(tokens, SEP))


def gazetteer(aliases: DataFrame, phases: Sequence[str] = ("E",), single: str = "none") -> DataFrame:
    """(phase, alias_key, n_tokens, qids) from (qid, aliases), the first alias being the label.

    Keys are lower-case tokens of the alias as the phase shows it. Aliases of one token are left out ("none"), kept if
    they are the label ("label"), or kept ("all"). Null qids and aliases and empty aliases give nothing; qids are sorted.
    """
    rows = aliases.where("qid is not null").select("qid", F.posexplode("aliases").alias("pos", "alias")).where("alias is not null")
    shown = F.explode(F.array(*(F.struct(F.lit(p).alias("phase"), phase_text(F.col("alias"), p).alias("alias")) for p in phases)))
    rows = rows.select("qid", "pos", shown.alias("s"))
    tokens = F.filter(F.split(F.trim("s.alias"), r"\s+"), lambda t: t != "")
    rows = rows.select("qid", "pos", "s.phase", tokens.alias("t")).where(F.size("t") > 0)
    keep = {"none": F.size("t") > 1, "label": (F.size("t") > 1) | (F.col("pos") == 0), "all": F.lit(True)}[single]
    return rows.where(keep).groupBy("phase", token_key(F.col("t")).alias("alias_key"), F.size("t").alias("n_tokens")).agg(F.array_sort(F.collect_set("qid")).alias("qids"))


def article_gazetteer(names: DataFrame) -> DataFrame:
    """(article_id, alias_key, n_tokens, qids) from (article_id, pos, name, qid): an article's own names; one-token ones only if first of their qid."""
    first = names.groupBy("article_id", "qid").agg(F.min("pos").alias("_first"))
    rows = names.join(first, ["article_id", "qid"]).withColumn("t", F.split(F.trim("name"), r"\s+")).where((F.size("t") > 1) | (F.col("pos") == F.col("_first")))
    return rows.groupBy("article_id", token_key(F.col("t")).alias("alias_key"), F.size("t").alias("n_tokens")).agg(F.array_sort(F.collect_set("qid")).alias("qids"))


def _windows(texts: DataFrame, id_col: str, tokens: str, longest: int) -> DataFrame:
    """(id, i, w, t): each token's place and lower case with the tokens from it on, at most `longest`; no row carries its whole text."""
    made = F.transform(F.col(tokens), lambda w, i: F.struct(i.alias("i"), F.lower(w).alias("w"), F.slice(F.col(tokens), i + 1, longest).alias("t")))
    return texts.select(id_col, F.explode(made).alias("x")).select(id_col, "x.i", "x.w", "x.t")


def _grams(texts: DataFrame, id_col: str, tokens: str, longest: int, firsts: DataFrame) -> DataFrame:
    """(id, i, n, key): n-grams whose first token begins some key; the semi-join prunes before n-grams are made."""
    rows = _windows(texts, id_col, tokens, longest).join(firsts, firsts.columns, "left_semi")
    sizes = F.explode(F.sequence(F.lit(1), F.size("t")))
    return rows.select(id_col, "i", "t", sizes.alias("n")).select(id_col, "i", "n", token_key(F.slice("t", F.lit(1), F.col("n"))).alias("alias_key"))


def longest_hits(texts: DataFrame, id_col: str, tokens: str, names: DataFrame, longest: int) -> DataFrame:
    """(id, i, n, alias_key, qids): for each start token the longest n-gram that is a name's key. names: alias_key, qids.

    If names have the id too, each document meets its own names only.
    """
    own = [id_col] if id_col in names.columns else []
    firsts = names.select(*own, F.element_at(F.split("alias_key", SEP), 1).alias("w")).distinct()
    met = _grams(texts, id_col, tokens, longest, firsts).join(names.select(*own, "alias_key", "qids"), [*own, "alias_key"])
    return met.groupBy(id_col, "i").agg(F.max(F.struct("n", "alias_key", "qids")).alias("m")).select(id_col, "i", "m.n", "m.alias_key", "m.qids")


def greedy(hits: DataFrame, id_col: str) -> DataFrame:
    """Hits kept from left to right where they don't overlap the last one kept. One row per document in between, of its hits."""
    shape = "array<struct<i int, n int, alias_key string, qids array<string>>>"
    rows = hits.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("i", "n", "alias_key", "qids"))).cast(shape).alias("h"))
    fold = F.aggregate("h", F.array().cast(shape), lambda kept, x: F.when((F.size(kept) == 0) | (x["i"] >= F.element_at(kept, -1)["i"] + F.element_at(kept, -1)["n"]), F.array_append(kept, x)).otherwise(kept))
    return rows.select(id_col, F.explode(F.when(F.size("h") < 2, F.col("h")).otherwise(fold)).alias("h")).select(id_col, F.col("h.i").alias("start_token"), (F.col("h.i") + F.col("h.n")).alias("end_token"), "h.alias_key", "h.qids")


def full_matches(texts: DataFrame, id_col: str, tokens: str, names: DataFrame, longest: int) -> DataFrame:
    """(id, start_token, end_token, alias_key, qids): leftmost-longest, non-overlapping names, ignoring case.

    texts: distinct ids with an array of tokens; null and empty arrays have no match. `longest` bounds a key's tokens.
    """
    return greedy(longest_hits(texts, id_col, tokens, names, longest), id_col)


def partial_matches(texts: DataFrame, id_col: str, tokens: str, full: DataFrame, skip: Sequence[str], longest: int) -> DataFrame:
    """(id, start_token, end_token, alias_key, qids): parts of a document's full names that stand alone.

    A span outside the full matches is a hit if it is a token suffix of exactly one full name of the document; it begins
    with a token of two characters or more that isn't skipped. Growth from a start stops at the first ambiguous length;
    the longest hit wins, then hits are kept from left to right.
    """
    keys = full.select(id_col, "alias_key", "qids").dropDuplicates([id_col, "alias_key"])
    parts = F.split("alias_key", SEP)
    suffixes = keys.select(id_col, "alias_key", "qids", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, -k, k), SEP))).alias("suffix"))
    owned = suffixes.groupBy(id_col, "suffix").agg(F.count("*").alias("names"), F.min("alias_key").alias("full_key"), F.min_by("qids", "alias_key").alias("qids"))
    taken = full.groupBy(id_col).agg(F.collect_list(F.struct("start_token", "end_token")).alias("taken"))
    free = lambda a, b: ~F.exists("taken", lambda s: (s["start_token"] < b) & (a < s["end_token"]))
    heads = owned.select(id_col, F.element_at(F.split("suffix", SEP), 1).alias("w")).distinct()
    rows = _windows(texts, id_col, tokens, longest).where((F.length("w") > 1) & ~F.col("w").isin([s.lower() for s in skip]))
    rows = rows.join(heads, [id_col, "w"], "left_semi").join(taken, id_col).where(free(F.col("i"), F.col("i") + 1))
    grams = rows.select(id_col, "i", "t", "taken", F.explode(F.sequence(F.lit(1), F.size("t"))).alias("n")).where(free(F.col("i"), F.col("i") + F.col("n")))
    grams = grams.select(id_col, "i", "n", token_key(F.slice("t", F.lit(1), F.col("n"))).alias("suffix"))
    met = grams.join(owned, [id_col, "suffix"])
    best = met.groupBy(id_col, "i").agg(F.min(F.when(F.col("names") > 1, F.col("n"))).alias("stop"), F.collect_list(F.struct("n", "names", "full_key", "qids")).alias("c"))
    good = F.filter("c", lambda x: (x["names"] == 1) & (F.col("stop").isNull() | (x["n"] < F.col("stop"))))
    hits = best.withColumn("m", F.array_max(F.transform(good, lambda x: F.struct(x["n"].alias("n"), x["full_key"].alias("alias_key"), x["qids"].alias("qids"))))).where("m is not null")
    return greedy(hits.select(id_col, "i", "m.n", "m.alias_key", "m.qids"), id_col)


def entities_with_offsets(texts: DataFrame, id_col: str, tokens: str, names: DataFrame, skip: Sequence[str], longest: int) -> DataFrame:
    """Full and partial matches with kind, as (id, start_token, end_token, alias_key, qids, kind)."""
    full = cut(full_matches(texts, id_col, tokens, names, longest))  # read three times below
    part = partial_matches(texts, id_col, tokens, full, skip, longest)
    return full.withColumn("kind", F.lit("full")).unionByName(part.withColumn("kind", F.lit("partial")))


def masked_text(texts: DataFrame, id_col: str, tokens: str, matches: DataFrame, mask: str = "[MASK]") -> DataFrame:
    """(id, masked, positions): each match as one mask, numbered from 1 in positions: qid -> mask numbers.

    Tokens are joined by blanks except before punctuation and clitics that begin with an apostrophe. Documents without
    a match keep their text and have no positions.
    """
    m = matches.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("start_token", "end_token", "qids"))).alias("m"))
    rows = texts.join(m, id_col, "left").withColumn("m", F.coalesce("m", F.array().cast("array<struct<start_token int, end_token int, qids array<string>>>")))
    shown = F.transform(F.col(tokens), lambda t, i: F.when(F.exists("m", lambda s: s["start_token"] == i), F.lit(mask)).when(F.exists("m", lambda s: (s["start_token"] < i) & (i < s["end_token"])), F.lit(None)).otherwise(t))
    kept = F.filter(shown, lambda t: t.isNotNull())
    glued = F.transform(kept, lambda t, i: F.when((i == 0) | t.rlike(r"^('|\p{Punct}+$)"), t).otherwise(F.concat(F.lit(" "), t)))
    numbered = F.flatten(F.transform("m", lambda s, i: F.transform(s["qids"], lambda q: F.struct(q.alias("qid"), (i + 1).alias("at")))))
    qids = F.array_distinct(F.transform(numbered, lambda x: x["qid"]))
    positions = F.map_from_entries(F.transform(qids, lambda q: F.struct(q, F.transform(F.filter(numbered, lambda x: x["qid"] == q), lambda x: x["at"]))))
    return rows.select(id_col, F.array_join(glued, "").alias("masked"), positions.alias("positions"))


def target_positions(positions: Column, target: Column) -> tuple[Column, Column]:
    """Mask numbers of a target ([0] if absent) and whether there are several."""
    found = F.try_element_at(positions, target)
    return F.coalesce(found, F.array(F.lit(0))), F.coalesce(F.size(found) > 1, F.lit(False))


def activated_names(texts: DataFrame, id_col: str, tokens: str, people: DataFrame, require_capital: bool = True) -> DataFrame:
    """(id, start_token, end_token, qid) with the rule of introductions: people (id, qid, first, last) of each document.

    A first name followed by the last one is a mention, and introduces the person; from then on the last name alone is
    one, and the first name alone if no other introduced person has it. Single tokens must begin with a capital if
    required. The rule runs from left to right, so each document's tokens go through one Python loop, in Arrow batches.
    """
    grouped = people.groupBy(id_col).agg(F.collect_set(F.struct("qid", F.lower("first").alias("first"), F.lower("last").alias("last"))).alias("people"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, toks, listed in zip(frame.iloc[:, 0], frame.iloc[:, 1], frame.iloc[:, 2]):
                known, i = [], 0
                listed = sorted((p["qid"], p["first"], p["last"]) for p in listed)
                while toks is not None and i < len(toks):
                    word, following = toks[i].lower(), toks[i + 1].lower() if i + 1 < len(toks) else ""
                    whole = [p for p in listed if p[1] == word and p[2] == following and p[1]]
                    if whole:
                        rows += [(key, i, i + 2, p[0]) for p in whole]
                        known += [p for p in whole if p not in known]
                        i += 2
                        continue
                    if not require_capital or toks[i][:1].isupper():
                        alone = [p for p in known if p[2] == word] or [p for p in known if p[1] == word]
                        if len(alone) == 1:
                            rows.append((key, i, i + 1, alone[0][0]))
                    i += 1
            yield pd.DataFrame(rows, columns=[id_col, "start_token", "end_token", "qid"])

    kind = texts.schema[id_col].dataType.simpleString()
    return texts.select(id_col, tokens).join(grouped, id_col).mapInPandas(run, f"`{id_col}` {kind}, start_token int, end_token int, qid string")


def valid_speaker(speaker: Column, qids: Column) -> Column:
    """Whether a speaker label is a marker of no speaker or one of the article's items."""
    return F.coalesce(speaker.isin(*NO_SPEAKER) | F.array_contains(qids, speaker), F.lit(False))


def training_rows(rows: DataFrame, names: DataFrame, id_col: str, kind: str = "train", longest: int = 16) -> DataFrame:
    """Quotations with masked context: (id, quotation, full_text, masked, positions, nb_entities), for training also speaker, targets, nb_targets, ambiguous.

    rows: id, left_context, right_context, quotation, speaker (an item or a marker). names: id, pos, name, qid, the names
    of the row's article. The context is both sides around a marker of the quotation, without double quotes; its names
    are masked. Rows without quotation, without a mention, and for training those whose speaker is unknown to the
    article, are left out. Keys of over `longest` tokens don't fit a name and give no match.
    """
    own = article_gazetteer(names.withColumnRenamed(id_col, "article_id")).withColumnRenamed("article_id", id_col).where(F.col("n_tokens") <= longest)
    some = rows.where("quotation is not null")
    if kind == "train":
        known = names.groupBy(id_col).agg(F.collect_set("qid").alias("_known"))
        some = some.join(known, id_col).where(valid_speaker(F.col("speaker"), F.col("_known"))).drop("_known")
    side = lambda c: F.coalesce(F.col(c), F.lit(""))
    some = some.withColumn("full_text", F.regexp_replace(F.concat(side("left_context"), F.lit(f" {TARGET_QUOTE} "), side("right_context")), '"+', ""))
    some = cut(some.withColumn("_t", F.filter(F.split("full_text", r"\s+"), lambda t: t != "")))
    masked = masked_text(some.select(id_col, "_t"), id_col, "_t", full_matches(some.select(id_col, "_t"), id_col, "_t", own, longest))
    out = some.drop("_t").join(masked, id_col).withColumn("nb_entities", F.size("positions")).where("nb_entities > 0")
    keep = [id_col, "quotation", "full_text", "masked", "positions", "nb_entities"]
    if kind != "train":
        return out.select(*keep)
    at, ambiguous = target_positions(F.col("positions"), F.col("speaker"))
    return out.withColumns({"targets": at, "ambiguous": ambiguous}).select(*keep, "speaker", "targets", F.size("targets").alias("nb_targets"), "ambiguous")


def link_mentions(mentions: DataFrame, candidates: DataFrame) -> DataFrame:
    """(mention_id, qid): of a mention's candidates (mention_id, label, qid, rank) the first whose label equals or holds the surface, else the first."""
    s, label = F.lower("surface"), F.lower("label")
    fit = F.when(label == s, 0).when(F.contains(label, s) | F.contains(s, label), 1).otherwise(2)
    met = mentions.select("mention_id", "surface").join(candidates, "mention_id")
    return met.groupBy("mention_id").agg(F.min(F.struct(fit.alias("fit"), "rank", "qid")).alias("m")).select("mention_id", "m.qid")


def usable_links(links: DataFrame) -> DataFrame:
    """Links with a qid or a title; null, empty and None are none."""
    none = lambda c: F.coalesce(F.col(c), F.lit("")).isin("", "None")
    return links.where(~(none("wikidata_qid") & none("wikipedia_title")))
