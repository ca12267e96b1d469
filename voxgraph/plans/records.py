"""Queries of nested records, gold pairs, predictions, look-ups and Parquet slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions import nested, text
from ..functions.fixed import INSTITUTIONAL_PROXY
from ..functions.urls import n_domains
from ..operators import analytics, annotation, entities, evaluation, merge, restore
from ..operators.lineage import cut
from ..sources import readers
from ..sources.tables import table
from . import mergesql
from .network import article_texts, quote_rows

VERBS = ("said", "added", "asked", "wrote", "told")


def knowledge_base_items(spark: SparkSession, folder: str) -> DataFrame:
    """Names as items of a knowledge base in JSON, and their parts read back."""
    n = table(spark, folder, "entity_names", "name", "qids").where("size(qids) = 1 and name is not null").select(F.col("qids")[0].alias("qid"), "name").groupBy("qid").agg(F.min("name").alias("name"))
    value = lambda kind, v: F.struct(F.struct(F.struct(F.lit(kind).alias("type"), v.alias("value")).alias("datavalue")).alias("mainsnak"))
    item = lambda **parts: F.struct(*(v.alias(k.replace("_", "-")) for k, v in parts.items()))
    claims = F.struct(
        F.array(value("wikibase-entityid", F.to_json(item(entity_type=F.lit("item"), id=F.lit("Q5"))))).alias("P31"),
        F.array(value("wikibase-entityid", F.to_json(item(entity_type=F.lit("item"), numeric_id=F.length("name"))))).alias("P27"), F.array(value("string", F.lit("x"))).alias("P1"),
    )
    sides = F.struct(F.array(F.struct(F.lit("en").alias("language"), F.col("name").alias("value")), F.struct(F.lit("de").alias("language"), F.upper("name").alias("value"))).alias("en"))
    instance = F.to_json(F.struct(F.col("qid").alias("id"), sides.alias("aliases"), F.struct(F.struct(F.col("name").alias("value")).alias("en")).alias("labels"), claims.alias("claims"), F.struct(F.struct(F.col("name").alias("title")).alias("enwiki")).alias("sitelinks")))
    rows = n.select(F.struct(*(c.alias(k) for k, c in nested.project_item(instance).items())).alias("x")).select("x.*")
    statements, links = nested.item_statements(F.col("claims")), nested.sitelink_titles(F.col("sitelinks"))
    shown = F.array_join(F.array_sort(F.transform(statements, lambda s: F.concat(s["property"], F.lit("="), s["qid"]))), " ")
    return rows.select(
        "id", nested.label_value(F.col("label")).alias("label"), F.array_join(nested.alias_list(F.col("aliases")), "|").alias("aliases"), shown.alias("statements"), F.get(links, 0)["title"].alias("title"),
        nested.is_instance_of(statements, "Q5").alias("is_human"), nested.has_sitelink(links, "enwiki").alias("has_page"), nested.has_sitelink(links, "dewiki").alias("has_other"),
    )


def _raw(spark: SparkSession, folder: str) -> DataFrame:
    """Quotations as the raw dumps nest them; those with one candidate have it in the global list only."""
    q = quote_rows(spark, folder)
    entry = lambda p: F.struct(p["speaker"].alias("speaker"), F.when(p["qid"].isNotNull(), F.array(p["qid"])).otherwise(F.array().cast("array<string>")).alias("qids"), p["probability"].alias("probability"))
    listed = F.transform("local_probas", entry)
    mentions = F.transform("mentioned_entities", lambda m: F.struct(m.alias("qid"), F.lit(None).cast("string").alias("wikidata_id")))
    names = table(spark, folder, "entity_names", "article_id", "qids", "start_token").groupBy("article_id").agg(F.collect_list(F.struct(F.col("qids").alias("ids"), F.col("start_token").cast("string").alias("offsets"))).alias("names"))
    quotation = F.struct(
        F.col("quote_id").alias("quoteID"), F.col("text").alias("quotation"), F.col("speaker").alias("globalTopSpeaker"), F.when(F.size("local_probas") > 1, listed).alias("localProbas"), listed.alias("globalProbas"), mentions.alias("mentions"),
    )
    return q.select("article_id", "quote_id", quotation.alias("quotation")).join(names, "article_id", "left")


def raw_quotations(spark: SparkSession, folder: str) -> DataFrame:
    """Speaker, candidates and mentioned entities of raw quotations."""
    q = F.col("quotation")
    r = _raw(spark, folder).where(q["quotation"].isNotNull()).select("quote_id", q["globalTopSpeaker"].alias("name"), nested.candidate_probas(q["localProbas"], q["globalProbas"]).alias("c"), nested.mentioned_entities(q["mentions"], F.col("names")).alias("m"))
    top = nested.top_speaker(F.col("name"), F.col("c"))
    shown = F.array_join(F.transform("c", lambda c: F.concat(c["speaker"], F.lit("/"), c["qid"])), "|")
    return r.select("quote_id", top["speaker"].alias("speaker"), top["qid"].alias("qid"), F.round(top["probability"], 6).alias("probability"), shown.alias("candidates"), F.array_join("m", " ").alias("mentioned"))


def gender_labels(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "enriched_edges", "edge_id", "target_gender")
    known = F.when(F.lower("target_gender") == "male", F.array(F.lit("Q6581097"))).when(F.lower("target_gender") == "female", F.array(F.lit("Q6581072"))).when(F.col("target_gender").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.lit("Q1"), F.lit("Q2")))
    return e.select("edge_id", text.gender(known).alias("gender"))


def alias_forms(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "entity_names", "mention_id", "name").where("name is not null").distinct()
    last = F.element_at(F.split(F.trim("name"), " "), -1)
    return n.select("mention_id", F.array_join(text.ascii_aliases(F.array(F.col("name"))), "|").alias("shown"), F.array_join(text.label_aliases(F.col("name"), F.array(last)), "|").alias("aliases"))


def decision_confidence(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates' probabilities as a judge's two best answers: margin and confidence."""
    q = quote_rows(spark, folder)
    tokens = F.array(F.struct(F.transform("local_probas", lambda p: F.round(p["probability"] * 3, 6)).alias("top")))
    margin = F.round(merge.logprob_margin(tokens), 6)
    source = F.when(F.col("speaker_qid").isNull(), "heuristic").otherwise("llm")
    return q.select("quote_id", margin.alias("margin"), merge.confidence(source, margin).alias("confidence"))


def projected_surfaces(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "articles", "article_id", "text", "detokenized_content").where("text is not null and detokenized_content is not null").distinct()
    d, g = text.blank_tokens(F.col("detokenized_content")), text.blank_tokens(F.col("text"))
    return a.select("article_id", F.sha2(F.array_join(text.project_surface(d, g), " "), 256).alias("projected"))


def usable_links(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "entity_names", "mention_id", "qids", "name").select("mention_id", F.get("qids", 0).alias("wikidata_qid"), F.when(F.col("name").contains(" "), F.col("name")).otherwise("None").alias("wikipedia_title"))
    return entities.usable_links(m)


def article_names(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "entity_names", "article_id", "mention_id", "name", "qids").where("name is not null and trim(name) <> ''").distinct()
    g = entities.article_gazetteer(n.select("article_id", F.col("mention_id").alias("pos"), "name", F.explode("qids").alias("qid")))
    return g.select("article_id", F.replace("alias_key", F.lit(entities.SEP), F.lit("/")).alias("alias_key"), "n_tokens", F.array_join("qids", " ").alias("qids"))


def domains_of_articles(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "articles", "article_id", "url").where("url is not null").groupBy("article_id").agg(F.collect_set("url").alias("urls"))
    return a.select("article_id", F.size("urls").alias("n_urls"), n_domains(F.col("urls")).alias("n_domains"))


def article_phases(spark: SparkSession, folder: str) -> DataFrame:
    """Quotations with the phase of their article in a table of articles."""
    a = table(spark, folder, "articles", "article_id", "phase").where("phase is not null").distinct()
    return table(spark, folder, "quote_candidates", "quote_id", "article_id").join(a, "article_id").select("quote_id", "article_id", "phase")


def failed_lookups(spark: SparkSession, folder: str) -> DataFrame:
    """Articles of which an annotation was saved and whose text is missing."""
    lost = table(spark, folder, "articles", "article_id", "text").where("text is null").select("article_id")
    return table(spark, folder, "annotation", "annotation_id", "article_id").join(lost, "article_id", "left_semi").select("annotation_id", "article_id")


def recovery_order(spark: SparkSession, folder: str) -> DataFrame:
    """The first 500 addresses by phase and date."""
    a = table(spark, folder, "articles", "article_id", "url", "phase", "date_published").where("url is not null").distinct()
    rank = F.coalesce(F.nullif(F.instr(F.lit("ABCDE"), F.coalesce("phase", F.lit("?"))), F.lit(0)), F.lit(9))
    return a.orderBy(rank, F.col("date_published").asc_nulls_last(), "article_id", "url").limit(500).select("article_id", "url", rank.alias("phase_rank"))


def pair_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Keys under which a judge's answers to pairs are kept: a hash of everything the judge sees."""
    order = Window.partitionBy("article_id").orderBy("quote_id")
    q = quote_rows(spark, folder).select("article_id", "quote_id", "text", "speaker", "speaker_qid")
    nxt = q.withColumns({f"next_{c}": F.lead(c).over(order) for c in ("quote_id", "text", "speaker", "speaker_qid")}).where("next_quote_id is not null")
    seen = [F.coalesce(c, F.lit("\u0002")) for c in ("text", "next_text", "speaker", "next_speaker", "speaker_qid", "next_speaker_qid")]
    return nxt.select("quote_id", "next_quote_id", F.sha2(F.concat_ws("\u0001", *seen), 256).alias("pair_key"))


DOCUMENTS = StructType([StructField("doc_id", LongType()), StructField("text", StringType())])


def chunk_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The documents as their row groups hold them, read chunk by chunk of a manifest with two columns only."""
    manifest = cut(analytics.row_group_chunks(readers.row_groups(spark, f"{folder}/documents.parquet"), 4))
    return readers.read_slices(manifest, DOCUMENTS).select("doc_id", F.length("text").alias("n_chars"))


def chunk_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of a manifest's chunks, in all."""
    s = readers.manifest_summary(analytics.row_group_chunks(readers.row_groups(spark, f"{folder}/documents.parquet"), 4))
    return s.agg(F.sum("n_rows").alias("n_rows"), F.min("first_row").alias("first_row"))


# Labelled paragraphs


def _words(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), " "), lambda w: w != "")


def labelled_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled tokens of the gold quotations' paragraphs: contexts, quotations, and speaker and verb on the labelled side."""
    g = table(spark, folder, "gold_attributions")
    kind = F.col("quote_kind")
    tagged = lambda words, first, rest: F.transform(words, lambda w, i: F.struct(w.alias("word"), F.when(i == 0, F.lit(first) if isinstance(first, str) else first).otherwise(F.lit(rest) if isinstance(rest, str) else rest).alias("tag")))
    who, verb = tagged(_words(F.col("gold_speaker")), "B-Speaker", "I-Speaker"), tagged(_words(F.col("gold_quotative_verb")), "O", "O")
    none = F.array().cast("array<struct<word string, tag string>>")
    parts = F.concat(
        tagged(_words(F.col("left_context")), "O", "O"), F.when(kind == "LeftSpeaker", F.concat(who, verb)).otherwise(none), tagged(_words(F.col("target_quote")), F.concat(F.lit("B-"), kind), F.concat(F.lit("I-"), kind)),
        F.when(kind == "RightSpeaker", F.concat(verb, who)).otherwise(none), tagged(_words(F.col("right_context")), "O", "O"),
    )
    rows = g.select(F.col("paragraph_id").alias("paragraph"), "quote_index", F.posexplode(parts).alias("at", "x"))
    pos = F.row_number().over(Window.partitionBy("paragraph").orderBy("quote_index", "at")) - 1
    return rows.select("paragraph", pos.alias("pos"), "x.word", "x.tag")


def gold_pairs(spark: SparkSession, folder: str) -> DataFrame:
    t = cut(labelled_tokens(spark, folder))
    return evaluation.gold_pairs(t, evaluation.gold_spans(t))


def first_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """Quotations of the first 20 paragraphs."""
    g = table(spark, folder, "gold_attributions", "paragraph_id", "quote_index")
    first = g.select("paragraph_id").distinct().orderBy("paragraph_id").limit(20)
    return g.join(first, "paragraph_id", "left_semi")


def merge_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    """The merge rules against gold, without speakers: pairs, risky and institutional ones, and blocks that pass."""
    t = cut(labelled_tokens(spark, folder))
    spans = cut(evaluation.gold_spans(t))
    gold = cut(evaluation.gold_pairs(t, spans))
    no = F.lit(None).cast("string")
    q = spans.join(gold.select("paragraph", "idx", F.col("bridge").alias("bridge_after")), ["paragraph", "idx"], "left")
    q = cut(q.select(F.col("paragraph").alias("article_id"), "idx", F.concat_ws(":", "paragraph", "idx").alias("quote_id"), "text", "kind", no.alias("speaker"), no.alias("speaker_qid"), F.lit(None).cast("double").alias("speaker_probability"), "bridge_after"))
    d = cut(merge.decide(merge.pairs_of(q, "article_id")))
    b = merge.blocks(q, d, "article_id")
    keys = ["article_id", "block_id"]
    empty = b.select(*keys).distinct().withColumn("mentions", F.array(F.lit("any")))
    passing = merge.passing_blocks(b, keys, empty, merge.block_roles(b, d, "article_id"))
    kept = b.groupBy(*keys).agg(F.bool_or(F.col("kind") != "Unknown").alias("gold_has_person")).join(passing, keys)
    pairs = gold.join(d.select(F.col("article_id").alias("paragraph"), "idx", "merge", "left_role", "right_role"), ["paragraph", "idx"])
    out = evaluation.merge_scores(pairs, kept)
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1", "merge_rate", "non_quote_rate")})


def applied_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """The gold labels as a judge's predictions, located in their paragraphs; quotations of unknown speaker are rejected."""
    g = table(spark, folder, "gold_attributions")
    side = lambda c: F.coalesce(F.col(c), F.lit(""))
    start = F.length(side("left_context")) + 1
    end = start + F.length(side("target_quote"))
    first = F.get(F.split(F.trim(side("target_quote")), " "), 0)
    rows = g.select(
        "paragraph_id", "quote_index", F.concat(side("left_context"), F.lit(" "), side("target_quote"), F.lit(" "), side("right_context")).alias("text"), start.alias("inner_start"), end.alias("inner_end"), start.alias("outer_start"), end.alias("outer_end"),
        F.when(F.col("quote_kind") == "Unknown", "reject").otherwise("keep").alias("pred_status"), F.lit(None).cast("string").alias("pred_reason"), F.lit("present").alias("pred_verb_status"), F.col("gold_quotative_verb").alias("pred_verb"),
        F.lit("identified").alias("pred_speaker_status"), F.element_at(F.split(F.trim(side("gold_speaker")), " "), -1).alias("pred_speaker"),
        F.array(F.struct(first.alias("surface"), F.lit("mixed").alias("sentiment")), F.struct(first.alias("surface"), F.lit("?").alias("sentiment")), F.struct(F.lit("#absent#").alias("surface"), F.lit("neutral").alias("sentiment"))).alias("pred_mentions"),
        F.lit("").alias("pred_notes"),
    )
    out = annotation.apply_predictions(rows)
    shown = F.array_join(F.transform("found_mentions", lambda m: F.concat(m["start"].cast("string"), F.lit(":"), m["sentiment"])), " ")
    return out.select("paragraph_id", "quote_index", "status", "reject_reason", F.col("verb.status").alias("verb_status"), F.col("verb.start").alias("verb_start"), F.col("speaker.status").alias("speaker_status"), F.col("speaker.start").alias("speaker_start"), shown.alias("mentions"), "remarks")


def training_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """Gold quotations as training rows: their speakers, and the names of the paragraph's contexts, as items."""
    g = table(spark, folder, "gold_attributions").withColumn("id", F.concat_ws("-", "paragraph_id", "quote_index"))
    both = F.concat_ws(" ", "left_context", "right_context")
    found = g.select("id", F.posexplode(F.array_distinct(text.proper_names(both, ()))).alias("pos", "name"))
    names = found.unionByName(g.where("trim(gold_speaker) <> ''").select("id", F.lit(1000).alias("pos"), F.trim("gold_speaker").alias("name"))).withColumn("qid", F.lower("name"))
    rows = g.select("id", "left_context", "right_context", F.col("target_quote").alias("quotation"), F.coalesce(F.lower(F.trim("gold_speaker")), F.lit("none")).alias("speaker"))
    out = entities.training_rows(rows, names, "id")
    return out.select("id", "masked", "nb_entities", "nb_targets", "ambiguous")


QUERIES = {
    f.__name__: f
    for f in (
        knowledge_base_items, raw_quotations, gender_labels, alias_forms, decision_confidence, projected_surfaces, usable_links, article_names, domains_of_articles, article_phases, failed_lookups, recovery_order, pair_keys,
        chunk_rows, chunk_summary, gold_pairs, first_paragraphs, merge_evaluation, applied_predictions, training_quotes,
    )
}

_Q = "q as (select distinct * from quote_candidates)"
_SPLIT = "list_filter(string_split(coalesce({}, ''), ' '), lambda w: w <> '')"
_NAMES = "list_distinct(list_transform(list_filter({}, lambda w: regexp_matches(w, '^\\p{{L}}+$')), lambda w: lower(w)))"


def _tagged(words: str, first: str, rest: str) -> str:
    return f"list_transform({words}, lambda w, i: {{'word': w, 'tag': case when i = 1 then {first} else {rest} end}})"


_WHO, _VERB = _tagged(_SPLIT.format("gold_speaker"), "'B-Speaker'", "'I-Speaker'"), _tagged(_SPLIT.format("gold_quotative_verb"), "'O'", "'O'")
_GOLD = f"""
    g as (select paragraph_id p, quote_index qi, list_concat(list_concat(list_concat(list_concat({_tagged(_SPLIT.format('left_context'), "'O'", "'O'")}, case when quote_kind = 'LeftSpeaker' then list_concat({_WHO}, {_VERB}) else [] end),
      {_tagged(_SPLIT.format('target_quote'), "'B-' || quote_kind", "'I-' || quote_kind")}), case when quote_kind = 'RightSpeaker' then list_concat({_VERB}, {_WHO}) else [] end), {_tagged(_SPLIT.format('right_context'), "'O'", "'O'")}) x from gold_attributions),
    u as (select p, qi, unnest(x) x, generate_subscripts(x, 1) a from g), gt as (select p, row_number() over (partition by p order by qi, a) - 1 pos, x.word w, x.tag tag from u),
    t1 as (select *, regexp_extract(tag, '^[BI]-(LeftSpeaker|RightSpeaker|Unknown)$', 1) kind, tag in ('B-Speaker', 'I-Speaker') sp from gt),
    t2 as (select *, case when kind <> '' and (starts_with(tag, 'B-') or coalesce(lag(kind) over w, '') <> kind) then 1 else 0 end b, case when sp and not coalesce(lag(sp) over w, false) then 1 else 0 end r from t1 window w as (partition by p order by pos)),
    t3 as (select *, sum(b) over w no, sum(r) over w run from t2 window w as (partition by p order by pos rows unbounded preceding)),
    s0 as (select p, no - 1 idx, kind, min(pos) st, max(pos) + 1 en, string_agg(w, ' ' order by pos) txt from t3 where kind <> '' group by p, no, kind),
    nr as (select s0.p, idx, run, list(t3.w) ws, s0.kind from s0 join t3 on t3.p = s0.p and sp and ((s0.kind = 'LeftSpeaker' and pos < st and pos >= st - 25) or (s0.kind = 'RightSpeaker' and pos >= en and pos < en + 25)) group by 1, 2, 3, 5),
    nm as (select p, idx, {_NAMES.format('ws')} names from nr qualify row_number() over (partition by p, idx order by case when kind = 'LeftSpeaker' then -run else run end) = 1),
    gs as (select s0.*, coalesce(names, []) names from s0 left join nm using (p, idx)),
    pr as (select *, lead(st) over w nst, lead(names) over w nn, lead(kind) over w nk from gs window w as (partition by p order by idx)),
    br as (select pr.p, pr.idx, string_agg(w, ' ' order by pos) bridge, list(w) filter (sp) said from pr join t3 on t3.p = pr.p and pos >= en and pos < nst group by 1, 2),
    gp as (select pr.p, pr.idx, coalesce(bridge, '') bridge, coalesce(said, []) said, names, nn, pr.kind, nk from pr left join br using (p, idx) where nst is not null),
    gold as (select p paragraph, cast(idx as int) idx, bridge, (trim(bridge) <> '' and not regexp_matches(bridge, '[A-Za-z0-9]')) or list_has_any({_NAMES.format('said')}, names) or list_has_any({_NAMES.format('said')}, nn) or list_has_any(names, nn) should_merge,
      len(said) > 0 bridge_has_person, regexp_matches(bridge, {mergesql.text('(?i)' + INSTITUTIONAL_PROXY)}) and len(said) = 0 and kind = 'Unknown' and nk = 'Unknown' institutional from gp)"""
_GOLD_BRIDGED = f"""{_GOLD},
    b as (select s.p article_id, cast(s.idx as int) idx, s.p || ':' || s.idx quote_id, txt as text, s.kind, null::varchar speaker, null::varchar speaker_qid, null::double speaker_probability, ['any'] mentioned_entities, gp.bridge bridge_after,
      null::struct(speaker varchar, qid varchar, probability double)[] local_probas from gs s left join gp on gp.p = s.p and gp.idx = s.idx)"""
_MERGE_EVALUATION = f"""
    {mergesql.merged(_GOLD_BRIDGED).rsplit('select t.article_id', 1)[0]},
    ok as (select t.article_id, t.block_id, has_speaker and not is_non_quote pred from t join r using (article_id, block_id)), hp as (select article_id, block_id, bool_or(kind <> 'Unknown') gold from k group by 1, 2),
    c0 as (select should_merge gold, d.merge = 'yes' pred, d.left_role = 'non_quote' or d.right_role = 'non_quote' nq, bridge_has_person bp, institutional ins from gold join d on d.article_id = gold.paragraph and d.idx = gold.idx),
    z as (select 'pairs' subset, gold, pred, nq from c0 union all select 'high_risk', gold, pred, nq from c0 where not bp union all select 'institutional', gold, pred, nq from c0 where ins union all select 'blocks', gold, pred, null from ok join hp using (article_id, block_id)),
    y as (select subset, count(*) total, count(*) filter (pred and gold) tp, count(*) filter (pred and not gold) fp, count(*) filter (not pred and gold) fn, count(*) filter (not pred and not gold) tn, avg(pred::int) mr, avg(nq::int) nr from z group by 1),
    x as (select *, coalesce(tp / nullif(tp + fp, 0), 0) pc, coalesce(tp / nullif(tp + fn, 0), 0) rc from y)
    select subset, total, tp, fp, fn, tn, round(mr, 6) merge_rate, round(nr, 6) non_quote_rate, round(pc, 6) as precision, round(rc, 6) recall, round(coalesce(2 * pc * rc / nullif(pc + rc, 0), 0), 6) f1 from x"""


def _places(hay: str, needle: str, low: str, high: str) -> str:
    return f"list_filter(range({low}, greatest(least({high}, len({hay})) - len({needle}) + 1, {low})), lambda i: substring({hay}, i + 1, len({needle})) = {needle})"


def _found(needle: str) -> str:
    """The place of a surface near the quotation: exact case first, outside first, nearest, leftmost."""
    low, high = "greatest(0, s - 500)", "e + 500"
    exact, loose = _places("x", needle, low, high), _places("lower(x)", f"lower({needle})", low, high)
    at = f"case when len({exact}) > 0 then {exact} else {loose} end"
    out = f"list_filter({at}, lambda i: i + len({needle}) <= s or i >= e)"
    pick = lambda v: f"(list_sort(list_transform({v}, lambda i: [abs(i - s), i])))[1][2]"
    return f"case when {needle} <> '' then case when len({out}) > 0 then {pick(out)} else {pick(at)} end end"


_MINIMAL = r"(?i)^(mr|mrs|ms|miss|dr|prof|sir|dame|lord|lady|president|senator|sen|rep|gov|judge|minister|captain)\.?\s+"
SQL = {
    "knowledge_base_items": """
      with n as (select qids[1] id, min(name) as name from entity_names where len(qids) = 1 and name is not null group by 1)
      select id, name as label, name as aliases, 'P27=Q' || length(name) || ' P31=Q5' as statements, name as title, true as is_human, true as has_page, false as has_other from n""",
    "raw_quotations": f"""
      with {_Q}, c as (select quote_id, speaker as name, list_filter(coalesce(local_probas, []), lambda c: c.qid is not null) c, mentioned_entities m, article_id from q where text is not null),
      e as (select article_id, list_sort(list_distinct(flatten(list(qids)))) ids from entity_names where qids is not null and start_token is not null group by 1),
      o as (select quote_id, unnest(c) x, generate_subscripts(c, 1) i, name from c), s1 as (select quote_id, x.qid qid, x.probability pr from o where x.speaker = name qualify row_number() over (partition by quote_id order by x.probability desc, i desc) = 1),
      s2 as (select quote_id, coalesce(x.speaker, '') sp, x.qid qid, x.probability pr from o qualify row_number() over (partition by quote_id order by x.probability desc, i) = 1), ca as (select * from c),
      one as (select c.*, s1.qid q1, s1.pr p1, s2.sp sp2, s2.qid q2, s2.pr p2, list_aggregate(list_transform(c.c, lambda v: coalesce(v.speaker, '') || '/' || v.qid), 'string_agg', '|') cand from ca c left join (select distinct * from s1) s1 using (quote_id) left join (select distinct * from s2) s2 using (quote_id))
      select quote_id, case when q1 is not null then name when q2 is not null then sp2 else name end speaker, coalesce(q1, q2) qid, round(case when q1 is not null then p1 when q2 is not null then p2 else 0 end, 6) probability, coalesce(cand, '') candidates,
        array_to_string(list_sort(list_distinct(list_filter(list_concat(coalesce(m, []), coalesce(ids, [])), lambda v: v is not null and v <> ''))), ' ') mentioned from one left join e using (article_id)""",
    "gender_labels": "select edge_id, case lower(target_gender) when 'male' then 'Male' when 'female' then 'Female' else case when target_gender is not null then 'Other' end end as gender from enriched_edges",
    "alias_forms": r"select distinct mention_id, lower(name) || '|' || regexp_replace(lower(name), '[^\x00-\x7F]', '?', 'g') as shown, name || '|' || string_split(trim(name), ' ')[-1] as aliases from entity_names where name is not null",
    "decision_confidence": f"""
      with {_Q}, m as (select quote_id, speaker_qid, list_reverse_sort(list_transform(coalesce(local_probas, []), lambda p: round(p.probability * 3, 6))) v from q), g as (select *, case when len(v) > 1 then round(v[1] - v[2], 6) else 0 end margin from m)
      select quote_id, margin::double as margin, case when speaker_qid is null or margin >= 1.5 then 'high' when margin >= 0.75 then 'medium' else 'low' end as confidence from g""",
    "projected_surfaces": r"""
      with a as (select distinct article_id, text, detokenized_content from articles where text is not null and detokenized_content is not null), b as (select *, string_split(detokenized_content, ' ') d, string_split(text, ' ') g from a),
      k as (select *, list_transform(range(1, least(len(d), len(g)) + 1), lambda i: case when coalesce(nullif(lower(regexp_replace(d[i], '[^A-Za-z0-9]', '', 'g')), ''), lower(d[i])) = coalesce(nullif(lower(regexp_replace(g[i], '[^A-Za-z0-9]', '', 'g')), ''), lower(g[i])) then g[i] else d[i] end) o from b)
      select article_id, sha256(array_to_string(o, ' ')) as projected from k""",
    "usable_links": "with m as (select mention_id, qids[1] as wikidata_qid, case when contains(name, ' ') then name else 'None' end as wikipedia_title from entity_names) select * from m where coalesce(wikidata_qid, '') not in ('', 'None') or coalesce(wikipedia_title, '') not in ('', 'None')",
    "article_names": r"""
      with n as (select distinct article_id, mention_id, name, unnest(qids) q from (select distinct article_id, mention_id, name, qids from entity_names where name is not null and trim(name) <> '')), f as (select article_id, q, min(mention_id) f from n group by 1, 2),
      t as (select n.article_id, n.q, regexp_split_to_array(trim(name), '\s+') w, mention_id = f one from n join f using (article_id, q))
      select article_id, lower(array_to_string(w, '/')) as alias_key, len(w) as n_tokens, string_agg(distinct q, ' ' order by q) as qids from t where len(w) > 1 or one group by 1, 2, 3""",
    "domains_of_articles": r"""
      with a as (select distinct article_id, url from articles where url is not null)
      select article_id, count(*) as n_urls, count(distinct coalesce(array_to_string(string_split(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '.')[-2:], '.'), '')) as n_domains from a group by 1""",
    "article_phases": "select quote_id, article_id, phase from quote_candidates join (select distinct article_id, phase from articles where phase is not null) using (article_id)",
    "failed_lookups": "select annotation_id, article_id from annotation where article_id in (select article_id from articles where text is null)",
    "recovery_order": "with a as (select distinct article_id, url, phase, date_published from articles where url is not null), r as (select *, coalesce(nullif(instr('ABCDE', coalesce(phase, '?')), 0), 9) as phase_rank from a) select article_id, url, phase_rank from r order by phase_rank, date_published nulls last, article_id, url limit 500",
    "pair_keys": f"""
      with {_Q}, d as (select article_id, quote_id, text, speaker, speaker_qid from q), n as (select *, lead(quote_id) over w ni, lead(text) over w nt, lead(speaker) over w ns, lead(speaker_qid) over w nq from d window w as (partition by article_id order by quote_id))
      select quote_id, ni as next_quote_id, sha256(concat_ws(chr(1), {', '.join(f"coalesce({c}, chr(2))" for c in ('text', 'nt', 'speaker', 'ns', 'speaker_qid', 'nq'))})) as pair_key from n where ni is not null""",
    "chunk_rows": "select doc_id, length(text) as n_chars from documents",
    "chunk_summary": "select count(*) as n_rows, 0 as first_row from documents",
    "gold_pairs": f"with {_GOLD} select * from gold",
    "first_paragraphs": "select paragraph_id, quote_index from gold_attributions where paragraph_id in (select distinct paragraph_id from gold_attributions order by 1 limit 20)",
    "merge_evaluation": _MERGE_EVALUATION,
    "applied_predictions": f"""
      with g as (select paragraph_id, quote_index, quote_kind, coalesce(left_context, '') || ' ' || coalesce(target_quote, '') || ' ' || coalesce(right_context, '') x, len(coalesce(left_context, '')) + 1 s, len(coalesce(left_context, '')) + 1 + len(coalesce(target_quote, '')) e,
        trim(coalesce(gold_quotative_verb, '')) v, trim(regexp_replace(trim(string_split(trim(coalesce(gold_speaker, '')), ' ')[-1]), '{_MINIMAL}', '')) w, string_split(trim(coalesce(target_quote, '')), ' ')[1] f from gold_attributions),
      k as (select *, quote_kind = 'Unknown' rej, {_found('v')} va, {_found('w')} wa, {_places('x', 'f', 's', 'e')} fe, {_places('lower(x)', 'lower(f)', 's', 'e')} fl from g),
      m as (select *, case when f = '' then [] when len(fe) > 0 then fe else fl end c from k), o as (select *, c[1:2] h from m)
      select paragraph_id, quote_index, case when rej then 'reject' else 'keep' end as status, case when rej then 'not_speech' end as reject_reason, case when rej then 'unset' when v <> '' and va is not null then 'present' else 'implicit' end as verb_status,
        case when not rej and v <> '' then va end as verb_start, case when rej then 'unset' when w <> '' and wa is not null then 'identified' else 'cannot_identify' end as speaker_status, case when not rej and w <> '' then wa end as speaker_start,
        case when rej then '' else coalesce(array_to_string(list_transform(h, lambda i, n: i || ':' || case when n = 1 then 'mixed' else 'neutral' end), ' '), '') end as mentions,
        case when rej then '' else array_to_string(list_filter([case when v <> '' and va is null then 'verb not found; implicit' end, case when w <> '' and wa is null then 'speaker not found; cannot identify' end,
          (case when f = '' then 1 else 3 end - len(h)) || ' mentions not inside the quote'], lambda y: y is not null), ' ') end as remarks from o""",
}
