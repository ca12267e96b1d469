"""Queries of quotations, mentions, edges, samples and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dump import dev_bucket
from ..functions.text import PHASES, phase_of_date, proper_names
from ..functions.urls import registered_domain
from ..operators import analytics, entities, graph, merge, quotes
from ..operators.lineage import cut
from ..sources.tables import table
from . import mergesql

#: The persons of the candidate gate.
PERSONS = tuple(f"Q90000000{i}" for i in range(8))
ROLES = ("the minister", "a spokesman", "he", "she", "they")
BLOCKED_NODES = ("none", "the minister", "a spokesman", "he", "she", "they")
SKIP = "the a an of in on and at to for with by from was is said says mr mrs ms dr prof gov gen rep sen minister judge".split()


def quote_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Each stored quotation once."""
    return table(spark, folder, "quote_candidates").distinct()


def article_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(article_id, text): one text per article."""
    return table(spark, folder, "articles", "article_id", "text").groupBy("article_id").agg(F.min("text").alias("text"))


def opened_spans(spark: SparkSession, folder: str) -> DataFrame:
    return quotes.opened_spans(article_texts(spark, folder), "article_id", "text")


def mark_spans(spark: SparkSession, folder: str) -> DataFrame:
    return quotes.mark_spans(article_texts(spark, folder), "article_id", "text")


def unmatched_marks(spark: SparkSession, folder: str) -> DataFrame:
    return quotes.unmatched_marks(article_texts(spark, folder), "article_id", "text")


def _bridged(spark: SparkSession, folder: str) -> DataFrame:
    return quotes.bridges(quote_rows(spark, folder), article_texts(spark, folder), "article_id", "start_tok", "end_tok", "quote_id", "text")


def bridges(spark: SparkSession, folder: str) -> DataFrame:
    return _bridged(spark, folder).select("article_id", "quote_id", "idx", "bridge_after")


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    q = quote_rows(spark, folder).select("article_id", "quote_id", "speaker", "start_tok", "end_tok")
    return graph.edges_by_range(q, table(spark, folder, "entity_names", "article_id", "name", "start_token", "end_token"))


def edge_build(spark: SparkSession, folder: str) -> DataFrame:
    return _edges(spark, folder)


def edge_build_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """Flagship: edges from quotations and mentions, without listed nodes and self-quotations, with each quotation's outlets."""
    nodes = spark.createDataFrame([(n,) for n in BLOCKED_NODES], "node string")
    edges = graph.filter_edges(_edges(spark, folder), (), nodes, "node")
    edges = graph.drop_self_quotations(edges, ("article_id", "source", "quote_id"), "source", "target")
    a = table(spark, folder, "articles", "article_id", "url").select("article_id", registered_domain(F.col("url")).alias("domain"))
    q = table(spark, folder, "quote_candidates", "article_id", "quote_id").join(a, "article_id")
    return edges.join(analytics.outlets_per_quote(q, "quote_id", "domain"), "quote_id", "left").select("article_id", "quote_id", "source", "target", "target_mentions", "n_outlets")


def edges_self_removed_window(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "enriched_edges", "edge_id", "quoteid", "source_id", "target_id")
    return graph.drop_self_quotations(e, ("quoteid", "source_id"), "source_id", "target_id")


def edges_self_removed_anti(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "enriched_edges", "edge_id", "quoteid", "source_id", "target_id")
    return graph.drop_self_quotations(e, ("quoteid", "source_id"), "source_id", "target_id", by="anti")


def mention_list_filter(spark: SparkSession, folder: str) -> DataFrame:
    q = quote_rows(spark, folder).select("quote_id", F.array_join("mentioned_entities", "|").alias("target_mentions"))
    return q.where(graph.not_all_listed(F.col("target_mentions"), PERSONS))


def quote_outlet_counts(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "articles", "article_id", "url").select("article_id", registered_domain(F.col("url")).alias("domain")).distinct()
    q = table(spark, folder, "quote_candidates", "article_id", "text").where("text is not null").join(a, "article_id")
    return analytics.outlets_per_quote(q, "text", "domain")


def unique_quote_ids(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.once_only(table(spark, folder, "enriched_edges", "quoteid"), "quoteid")


def articles_of_graph(spark: SparkSession, folder: str) -> DataFrame:
    q, e = table(spark, folder, "quote_candidates", "article_id", "quote_id"), table(spark, folder, "enriched_edges", "quoteid")
    return analytics.quotes_of_graph(q, e, "article_id", "quote_id", "quoteid")


def yearly_sample(spark: SparkSession, folder: str) -> DataFrame:
    q = table(spark, folder, "quote_candidates", "quote_id").withColumn("year", F.left("quote_id", F.lit(4)))
    return analytics.sample_per_group(q, "year", "quote_id", 20, "7")


def phase_reservoir(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "articles", "article_id", "date_published").select("article_id", phase_of_date(F.col("date_published")).alias("phase"))
    return analytics.sample_per_group(a, "phase", "article_id", 50, "42")


def phase_topk(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "articles", "article_id", "phase", "date_published").where("phase is not null").distinct()
    quoted = table(spark, folder, "quote_candidates", "article_id").distinct().withColumn("has_quotes", F.lit(True))
    rows = a.join(quoted, "article_id", "left").withColumn("has_quotes", F.coalesce("has_quotes", F.lit(False)))
    return analytics.top_per_group(rows, "phase", 100, F.desc("has_quotes"), F.col("date_published").asc_nulls_last(), F.col("article_id"))


def uniform_sample(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.uniform_sample(table(spark, folder, "enriched_edges", "quoteid"), "quoteid", 1000, "1")


def quota_sample(spark: SparkSession, folder: str) -> DataFrame:
    g = table(spark, folder, "gold_attributions", "paragraph_id", "quote_index", "quote_kind").withColumn("key", F.concat_ws("-", "paragraph_id", "quote_index"))
    return analytics.quota_sample(g, "quote_kind", "key", {"LeftSpeaker": 30, "RightSpeaker": 30, "Unknown": 15}, "3").select("key", "quote_kind")


def damaged_first_sample(spark: SparkSession, folder: str) -> DataFrame:
    q = table(spark, folder, "quote_candidates", "quote_id", "text").where("text is not null").dropDuplicates(["quote_id"])
    return analytics.damaged_first(q, F.col("text").rlike("[ÃÂâ�]"), "quote_id", 100, "5").select("quote_id")


def row_group_chunks(spark: SparkSession, folder: str) -> DataFrame:
    g = table(spark, folder, "orders", "o_orderdate").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("path")).agg(F.count("*").alias("n_rows")).withColumn("row_group", F.lit(0))
    return analytics.row_group_chunks(g, 16).select("path", "row_group", "n_rows", "first_row", "chunk_id")


def redirects_resolved(spark: SparkSession, folder: str) -> DataFrame:
    """Articles of a day in runs of six, each leading to the next; of every other run the last one leads back to the first."""
    a = table(spark, folder, "articles", "article_id").where("article_id is not null").distinct().withColumn("day", F.left("article_id", F.lit(10)))
    a = a.withColumn("n", F.row_number().over(Window.partitionBy("day").orderBy("article_id")) - 1).withColumn("run", F.floor(F.col("n") / 6))
    run = Window.partitionBy("day", "run")
    rows = a.select(F.col("article_id").alias("redirect"), F.coalesce(F.lead("article_id").over(run.orderBy("n")), F.when(F.col("run") % 2 == 0, F.min("article_id").over(run))).alias("target"))
    return graph.resolve_redirects(rows.where("target is not null"))


def pagerank(spark: SparkSession, folder: str) -> DataFrame:
    return graph.pagerank(table(spark, folder, "enriched_edges", "source_id", "target_id"), "source_id", "target_id", 10).withColumn("rank", F.round("rank", 6))


def _gazetteer(spark: SparkSession, folder: str, phases: tuple[str, ...] = ("E",), single: str = "none") -> DataFrame:
    n = table(spark, folder, "entity_names", "name", "qids").where("size(qids) = 1 and name is not null").select(F.col("qids")[0].alias("qid"), F.trim("name").alias("name")).distinct()
    last = F.element_at(F.split("name", r"\s+"), -1)
    return entities.gazetteer(n.select("qid", F.array("name", last).alias("aliases")), phases, single)


def gazetteer_phases(spark: SparkSession, folder: str) -> DataFrame:
    g = _gazetteer(spark, folder, ("A", "B", "C", "D", "E"))
    return g.where("phase <> 'A'").select("phase", F.replace("alias_key", F.lit(entities.SEP), F.lit("/")).alias("alias_key"), "n_tokens", F.array_join("qids", " ").alias("qids"))


def _name_tokens(text: str) -> Column:
    return F.filter(F.split(text, r"[^\p{L}\p{N}'’-]+"), lambda t: t != "")


def _token_texts(spark: SparkSession, folder: str) -> DataFrame:
    return article_texts(spark, folder).where("text is not null").select("article_id", _name_tokens("text").alias("t"))


def _names_and_longest(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    """The gazetteer as a table, and the tokens of its longest key."""
    names = cut(_gazetteer(spark, folder, single="all"))
    return names, names.agg(F.coalesce(F.max("n_tokens"), F.lit(1))).first()[0]


def ngram_hits(spark: SparkSession, folder: str) -> DataFrame:
    hits = entities.longest_hits(_token_texts(spark, folder), "article_id", "t", *_names_and_longest(spark, folder))
    return hits.select("article_id", F.col("i").alias("start_token"), "n", F.replace("alias_key", F.lit(entities.SEP), F.lit("/")).alias("alias_key"))


def entity_mentions(spark: SparkSession, folder: str) -> DataFrame:
    names, longest = _names_and_longest(spark, folder)
    e = entities.entities_with_offsets(_token_texts(spark, folder), "article_id", "t", names, SKIP, longest)
    return e.select("article_id", "start_token", "end_token", F.replace("alias_key", F.lit(entities.SEP), F.lit("/")).alias("alias_key"), F.array_join("qids", " ").alias("qids"), "kind")


def masked_texts(spark: SparkSession, folder: str) -> DataFrame:
    texts = _token_texts(spark, folder)
    full = entities.full_matches(texts, "article_id", "t", *_names_and_longest(spark, folder))
    m = entities.masked_text(texts, "article_id", "t", full)
    at, ambiguous = entities.target_positions(F.col("positions"), F.lit("Q900000000"))
    return m.select("article_id", "masked", F.size("positions").alias("nb_entities"), F.array_join(F.transform(at, lambda x: x.cast("string")), " ").alias("target_at"), ambiguous.alias("ambiguous"))


def introduced_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names of two capitalised words in a document, and where they or their parts stand once they were introduced."""
    d = table(spark, folder, "documents", "doc_id", "text").where("text is not null")
    people = d.select("doc_id", F.explode(F.array_distinct(proper_names(F.col("text"), ()))).alias("name"), F.split("name", " ").alias("w")).where("size(w) = 2")
    people = people.select("doc_id", F.col("name").alias("qid"), F.col("w")[0].alias("first"), F.col("w")[1].alias("last"))
    return entities.activated_names(d.select("doc_id", _name_tokens("text").alias("t")), "doc_id", "t", people)


def linked_mentions(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "entity_names", "mention_id", "name", "qids").where("name is not null").dropDuplicates(["mention_id"])
    names = m.where("size(qids) = 1").select(F.col("qids")[0].alias("qid"), F.col("name").alias("label")).groupBy("qid").agg(F.min("label").alias("label"))
    c = m.select("mention_id", F.posexplode("qids").alias("rank", "qid")).join(names, "qid")
    return entities.link_mentions(m.select("mention_id", F.col("name").alias("surface")), c)


def _merged(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    q = cut(_bridged(spark, folder))
    d = cut(merge.decide(merge.pairs_of(q, "article_id")))
    return merge.blocks(q, d, "article_id"), d


def pair_decisions(spark: SparkSession, folder: str) -> DataFrame:
    return _merged(spark, folder)[1].select("article_id", "idx", "quote_id", "next_quote_id", "merge", "left_role", "right_role", "continuity", "reason")


def dev_set(spark: SparkSession, folder: str) -> DataFrame:
    """A balanced draw of pairs: 100 each of merged, unmerged and bridge-only, 200 undecided."""
    d = _merged(spark, folder)[1]
    m = quote_rows(spark, folder).groupBy("quote_id").agg(F.min("mentioned_entities").alias("m"))
    rows = d.join(m.select("quote_id", F.col("m").alias("l")), "quote_id", "left").join(m.select(F.col("quote_id").alias("next_quote_id"), F.col("m").alias("r")), "next_quote_id", "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumn("bucket", dev_bucket(F.col("merge"), F.col("reason"), none, F.col("l"), F.col("r"))).withColumn("key", F.concat_ws("-", "quote_id", "next_quote_id"))
    return analytics.quota_sample(rows, "bucket", "key", DEV_QUOTAS, "11").select("key", "bucket", "merge", "reason")


def merge_blocks(spark: SparkSession, folder: str) -> DataFrame:
    b, d = _merged(spark, folder)
    texts, roles = merge.block_texts(b, "article_id"), merge.block_roles(b, d, "article_id")
    mentions = merge.block_mentions(b, ("article_id", "block_id"), "mentioned_entities")
    passing = merge.passing_blocks(b, ("article_id", "block_id"), mentions, roles)
    keys = ["article_id", "block_id"]
    out = texts.join(roles, keys).join(passing, keys).join(merge.attribution(b, keys, "idx"), keys)
    return out.withColumn("probability", F.round("probability", 6))


def split_recovery(spark: SparkSession, folder: str) -> DataFrame:
    return merge.split_recovery(_merged(spark, folder)[0], ("article_id", "block_id"), "mentioned_entities")


def candidate_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Persons: the listed ones; a bridge's mentions are the names found after a quotation and before the next one."""
    q = quote_rows(spark, folder)
    order = Window.partitionBy("article_id").orderBy(F.coalesce("start_tok", F.lit(0)), "quote_id")
    rows = q.withColumn("idx", F.row_number().over(order) - 1).withColumn("next_start", F.lead(F.coalesce("start_tok", F.lit(0))).over(order))
    names = table(spark, folder, "entity_names", "article_id", "start_token", F.explode("qids").alias("mention"))
    between = (F.col("start_token") > F.col("end_tok")) & (F.col("start_token") < F.col("next_start") - 1) & (F.col("end_tok") >= 0)
    met = rows.select("article_id", "idx", "end_tok", "next_start").join(names, "article_id").where(between)
    met = met.groupBy("article_id", "idx").agg(F.collect_set("mention").alias("bridge_mentions"))
    gated = merge.candidate_gate(rows.join(met, ["article_id", "idx"], "left"), "article_id", "mentioned_entities", PERSONS, "bridge_mentions")
    return gated.select("article_id", "quote_id", "idx", "is_candidate")


def speaker_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Merging with one rule, equal known speakers: the islands themselves."""
    q = _bridged(spark, folder)
    p = merge.pairs_of(q, "article_id")
    d = p.select("article_id", "idx", F.when(F.col("speaker_qid") == F.col("next_speaker_qid"), "yes").otherwise("no").alias("merge"))
    b = merge.blocks(q, d, "article_id")
    return merge.block_texts(b, "article_id").select("article_id", "block_id", "first_idx", "n_quotes", "quote_text")


def attribution_argmax(spark: SparkSession, folder: str) -> DataFrame:
    q = quote_rows(spark, folder).withColumnRenamed("quote_id", "order_key")
    a = merge.attribution(q, ("article_id",), "order_key")
    return a.select("article_id", "speaker", "qid", F.round("probability", 6).alias("probability"))


def mention_union(spark: SparkSession, folder: str) -> DataFrame:
    m = merge.block_mentions(quote_rows(spark, folder), ("article_id",), "mentioned_entities")
    return m.select("article_id", F.array_join("mentions", " ").alias("mentions"))


QUERIES = {
    f.__name__: f
    for f in (
        opened_spans, mark_spans, unmatched_marks, bridges, edge_build, edge_build_filtered, edges_self_removed_window, edges_self_removed_anti, mention_list_filter, quote_outlet_counts, unique_quote_ids, articles_of_graph, yearly_sample, phase_reservoir, phase_topk,
        uniform_sample, quota_sample, damaged_first_sample, row_group_chunks, redirects_resolved, pagerank, gazetteer_phases, ngram_hits, entity_mentions, masked_texts, introduced_names, linked_mentions, pair_decisions, dev_set, merge_blocks, split_recovery, candidate_spans, speaker_runs,
        attribution_argmax, mention_union,
    )
}

_DOMAIN = "array_to_string(string_split(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '.')[-2:], '.')"
_Q = "q as (select distinct * from quote_candidates)"
_EDGES = r"""
    qq as (select distinct article_id, quote_id, speaker, start_tok, end_tok from quote_candidates where speaker is not null and speaker <> 'None'),
    mm as (select distinct article_id, name, start_token, end_token from entity_names where name is not null and not (end_token - start_token = 1 and (length(trim(name)) <= 1 or not regexp_matches(trim(name), '\p{L}')))),
    ee as (select article_id, quote_id, speaker as source, name as target, string_agg(printf('%06d-%06d', start_token, end_token), '|' order by printf('%06d-%06d', start_token, end_token)) as target_mentions
      from qq join mm using (article_id) where start_token >= start_tok and start_token < end_tok group by all)"""
_SELF = "select edge_id, quoteid, source_id, target_id from enriched_edges e where quoteid is not null and source_id is not null and not exists (select 1 from enriched_edges s where s.quoteid = e.quoteid and s.source_id = e.source_id and s.target_id = s.source_id)"
_PHASE = " ".join(f"when length(date_published) >= 10 and date_published[1:10] between '{a}' and '{b}' then '{p}'" for p, a, b in PHASES)
_BRIDGED = f"""
    {_Q}, a as (select article_id, min(text) t from articles group by 1),
    o as (select *, row_number() over w - 1 as idx, lead(coalesce(start_tok, 0)) over w as nxt from q window w as (partition by article_id order by coalesce(start_tok, 0), quote_id)),
    b as (select o.*, case when nxt is null then null when end_tok < 0 or end_tok is null or nxt - 1 - (end_tok + 1) <= 0 or a.t is null or nxt - 1 > len(string_split(a.t, ' ')) then ''
      else array_to_string(list_slice(string_split(a.t, ' '), end_tok + 2, nxt - 1), ' ') end as bridge_after from o left join a using (article_id))"""
DEV_QUOTAS = {"hard_merge": 100, "hard_no_merge": 100, "ambiguous": 200, "bridge_only": 100}


def _pagerank_sql(rounds: int) -> str:
    steps = ["w as (select source_id s, target_id t, count(*) n from enriched_edges where source_id is not null and target_id is not null group by 1, 2)", "o as (select s, sum(n) a from w group by 1)",
             "f as (select w.s, w.t, w.n / o.a x from w join o on w.s = o.s)", "v as (select s node from w union select t from w)", "r0 as (select node, 1.0::double rank from v)"]
    for i in range(rounds):
        steps.append(f"l{i} as (select coalesce(sum(rank), 0) / (select count(*) from v) lost from r{i} where node not in (select s from o))")
        steps.append(f"g{i} as (select t, sum(rank * x) got from f join r{i} on f.s = node group by t)")
        steps.append(f"r{i + 1} as (select node, 1 - 0.85 + 0.85 * (coalesce(got, 0) + lost) rank from v left join g{i} on node = t, l{i})")
    return f"with {', '.join(steps)} select node, round(rank, 6) as rank from r{rounds}"


_SKIPPED = ", ".join(f"'{w}'" for w in SKIP)
#: Full and partial mentions of the articles' names: greedy from the left by folding each article's hits.
_MENTIONS = rf"""
      w as (select distinct qids[1] q, list_filter(regexp_split_to_array(trim(name), '\s+'), lambda x: x <> '') w from entity_names where len(qids) = 1 and name is not null),
      z as (select q, lower(array_to_string(w, '/')) k, len(w) n from w where len(w) > 0 union select q, lower(w[-1]), 1 from w where len(w) > 0), g as (select k, n, string_agg(q, ' ' order by q) q from z group by 1, 2),
      a as (select article_id, list_filter(regexp_split_to_array(min(text), '[^\p{{L}}\p{{N}}''’-]+'), lambda x: x <> '') t from articles group by 1 having min(text) is not null),
      s as (select article_id, t, unnest(range(0, len(t))) i from a), ng as (select article_id, i, unnest(range(1, (select max(n) from g) + 1)) n, t from s),
      ks as (select article_id, i, n, lower(array_to_string(list_slice(t, i + 1, i + n), '/')) k, lower(t[i + 1]) h from ng where i + n <= len(t)),
      hits as (select article_id, i, ks.n n, ks.k k, g.q q from ks join g on ks.k = g.k and ks.n = g.n qualify row_number() over (partition by article_id, i order by ks.n desc, ks.k desc) = 1),
      fold as (select article_id, list_reduce(list([{{'i': i, 'n': n, 'k': k, 'q': q}}] order by i), lambda x, y: case when y[1].i >= x[-1].i + x[-1].n then list_concat(x, y) else x end) h from hits group by 1),
      full_ as (select article_id, h.i i, h.n n, h.k k, h.q q from (select article_id, unnest(h) h from fold)),
      fk as (select distinct article_id, k, q from full_), sf as (select article_id, k, q, string_split(k, '/') p, unnest(range(1, len(string_split(k, '/')) + 1)) x from fk),
      ow as (select article_id, array_to_string(p[-x:], '/') sfx, count(*) names, min(k) k, arg_min(q, k) q from sf group by 1, 2),
      hd as (select distinct article_id, string_split(sfx, '/')[1] h from ow),
      fr as (select ks.article_id, ks.i, ks.n, ks.k from ks join hd on hd.article_id = ks.article_id and hd.h = ks.h where length(ks.h) > 1 and ks.h not in ({_SKIPPED})
        and not exists (select 1 from full_ f where f.article_id = ks.article_id and f.i < ks.i + ks.n and ks.i < f.i + f.n)),
      mt as (select fr.article_id, fr.i, fr.n, ow.names, ow.k, ow.q from fr join ow on ow.article_id = fr.article_id and ow.sfx = fr.k),
      st as (select *, min(case when names > 1 then n end) over (partition by article_id, i) stop from mt),
      ph as (select * from st where names = 1 and (stop is null or n < stop) qualify row_number() over (partition by article_id, i order by n desc, k desc) = 1),
      pf as (select article_id, list_reduce(list([{{'i': i, 'n': n, 'k': k, 'q': q}}] order by i), lambda x, y: case when y[1].i >= x[-1].i + x[-1].n then list_concat(x, y) else x end) h from ph group by 1),
      part as (select article_id, h.i i, h.n n, h.k k, h.q q from (select article_id, unnest(h) h from pf))"""
SQL = {
    "opened_spans": r"""
      with a as (select article_id, min(text) t from articles group by 1), t as (select article_id, unnest(string_split(t, ' ')) w, generate_subscripts(string_split(t, ' '), 1) - 1 i from a where t is not null),
      c as (select article_id, i from t where contains(w, '''''')), d as (select article_id, i from t where regexp_matches(w, '(?i)(\\endblockquote|</blockquote>)')),
      o as (select article_id, i, contains(w, '``') p from t where contains(w, '``') or regexp_matches(w, '(?i)(\\blockquote|<blockquote)'))
      select o.article_id, o.i + 1 as start_tok, case when p then coalesce((select min(c.i) from c where c.article_id = o.article_id and c.i > o.i), -1) else coalesce((select min(d.i) from d where d.article_id = o.article_id and d.i > o.i), -1) end as end_tok from o""",
    "bridges": f"with {_BRIDGED} select article_id, quote_id, idx, bridge_after from b",
    "edge_build": f"with {_EDGES} select * from ee",
    "edge_build_filtered": f"""
      with {_EDGES}, k as (select * from ee where lower(source) not in {BLOCKED_NODES} and lower(target) not in {BLOCKED_NODES}),
      s as (select distinct article_id, source, quote_id from k where source = target), d as (select quote_id, count(distinct {_DOMAIN}) n_outlets from quote_candidates join (select article_id, url from articles) using (article_id) group by 1)
      select k.*, d.n_outlets from k left join d using (quote_id) where not exists (select 1 from s where s.article_id = k.article_id and s.source = k.source and s.quote_id = k.quote_id)""",
    "edges_self_removed_window": _SELF,
    "edges_self_removed_anti": _SELF,
    "mention_list_filter": f"with {_Q}, m as (select quote_id, array_to_string(mentioned_entities, '|') target_mentions from q) select * from m where len(list_filter(string_split(target_mentions, '|'), lambda x: x not in ({', '.join(repr(f'Q90000000{i}') for i in range(8))}))) > 0",
    "quote_outlet_counts": f"with a as (select distinct article_id, {_DOMAIN} d from articles) select text, count(distinct d) as n_outlets from quote_candidates join a using (article_id) where text is not null group by text",
    "unique_quote_ids": "select quoteid from enriched_edges group by 1 having count(*) = 1",
    "articles_of_graph": "select article_id, string_agg(quote_id, ' ' order by quote_id) as quote_ids from (select distinct article_id, quote_id from quote_candidates where quote_id in (select quoteid from enriched_edges) and article_id is not null) group by 1",
    "yearly_sample": "select quote_id, quote_id[1:4] as year from (select distinct quote_id from quote_candidates) qualify row_number() over (partition by quote_id[1:4] order by md5(quote_id || '7'), quote_id) <= 20",
    "phase_reservoir": f"with a as (select distinct article_id, case {_PHASE} end phase from articles) select article_id, phase from a where phase is not null qualify row_number() over (partition by phase order by md5(article_id || '42'), article_id) <= 50",
    "phase_topk": "with a as (select distinct article_id, phase, date_published from articles where phase is not null), h as (select *, article_id in (select article_id from quote_candidates) has_quotes from a) select *, row_number() over (partition by phase order by has_quotes desc, date_published nulls last, article_id) as rank from h qualify rank <= 100",
    "uniform_sample": "select quoteid from (select distinct quoteid from enriched_edges) order by md5(quoteid || '1'), quoteid limit 1000",
    "quota_sample": "with g as (select paragraph_id || '-' || quote_index as key, quote_kind from gold_attributions) select key, quote_kind from g qualify row_number() over (partition by quote_kind order by md5(key || '3'), key) <= case quote_kind when 'LeftSpeaker' then 30 when 'RightSpeaker' then 30 when 'Unknown' then 15 else 0 end",
    "row_group_chunks": "with g as (select strftime(o_orderdate, '%Y-%m-%d') path, count(*) n_rows from orders group by 1), s as (select *, cast(sum(n_rows) over (order by path rows unbounded preceding) - n_rows as bigint) first_row, sum(n_rows) over () total from g) select path, 0 as row_group, n_rows, first_row, cast(floor(first_row / ceil(total / 16)) as int) as chunk_id from s",
    "redirects_resolved": """
      with a as (select distinct article_id from articles where article_id is not null), n as (select article_id, article_id[1:10] d, row_number() over (partition by article_id[1:10] order by article_id) - 1 n from a),
      g as (select *, n // 6 r, count(*) over (partition by d, n // 6) size, last_value(article_id) over w ending, lag(article_id) over (partition by d, n // 6 order by n) before from n window w as (partition by d, n // 6 order by n rows between unbounded preceding and unbounded following))
      select article_id as redirect, case when r % 2 = 1 then ending else coalesce(before, ending) end as target from g where r % 2 = 0 or n % 6 < size - 1""",
    "pagerank": _pagerank_sql(10),
    "linked_mentions": r"""
      with m as (select mention_id, min(name) as name, min(qids) qids from entity_names where name is not null group by 1), l as (select qids[1] q, min(name) as label from m where len(qids) = 1 group by 1),
      c as (select mention_id, lower(name) s, unnest(qids) q, generate_subscripts(qids, 1) r from m), k as (select mention_id, r, c.q, case when lower(label) = s then 0 when contains(lower(label), s) or contains(s, lower(label)) then 1 else 2 end fit from c join l on c.q = l.q)
      select mention_id, q as qid from k qualify row_number() over (partition by mention_id order by fit, r, q) = 1""",
    "damaged_first_sample": r"""
      with q as (select quote_id, bool_or(regexp_matches(text, '[ÃÂâ�]')) d from quote_candidates where text is not null group by 1), r as (select *, row_number() over (partition by d order by md5(quote_id || '5'), quote_id) r from q)
      select quote_id from r order by case when d and r <= 50 then 0 when not d then 1 else 2 end, r limit 100""",
    "pair_decisions": f"with {mergesql.decided(_BRIDGED)} select article_id, idx, quote_id, next_quote_id, merge, left_role, right_role, continuity, reason from d",
    "merge_blocks": mergesql.merged(_BRIDGED),
    "split_recovery": mergesql.split_recovery(_BRIDGED),
    "dev_set": mergesql.dev_set(_BRIDGED, DEV_QUOTAS, "11"),
    "candidate_spans": f"""
      with {_Q}, o as (select *, row_number() over w - 1 as idx, lead(coalesce(start_tok, 0)) over w as nxt from q window w as (partition by article_id order by coalesce(start_tok, 0), quote_id)),
      n as (select article_id, start_token, unnest(qids) m from entity_names), x as (select distinct o.article_id, idx from o join n on n.article_id = o.article_id and n.start_token > end_tok and n.start_token < nxt - 1 and end_tok >= 0 where m in {PERSONS})
      select article_id, quote_id, idx, coalesce(list_has_any(mentioned_entities, {list(PERSONS)}), false) or exists (select 1 from x where x.article_id = o.article_id and x.idx in (o.idx, o.idx - 1)) as is_candidate from o""",
    "entity_mentions": f"""
      with {_MENTIONS}
      select article_id, i as start_token, i + n as end_token, k as alias_key, q as qids, 'full' as kind from full_ union all select article_id, i, i + n, k, q, 'partial' from part""",
    "gazetteer_phases": r"""
      with n as (select distinct qids[1] q, trim(name) as name from entity_names where len(qids) = 1 and name is not null),
      p as (select q, 'B' phase, regexp_replace(lower(name), '[^\x00-\xFF]', '?', 'g') s from n union all select q, 'C', regexp_replace(lower(name), '[^\x00-\x7F]', '?', 'g') from n union all select q, 'D', regexp_replace(name, '[^\x00-\x7F]', '?', 'g') from n union all select q, 'E', name from n),
      t as (select q, phase, list_filter(regexp_split_to_array(trim(s), '\s+'), lambda x: x <> '') t from p)
      select phase, lower(array_to_string(t, '/')) as alias_key, len(t) as n_tokens, string_agg(distinct q, ' ' order by q) as qids from t where len(t) > 1 group by 1, 2, 3""",
    "ngram_hits": r"""
      with w as (select list_filter(regexp_split_to_array(trim(name), '\s+'), lambda x: x <> '') w from entity_names where len(qids) = 1 and name is not null), g as (select distinct lower(array_to_string(w, '/')) k from w union select lower(w[-1]) from w),
      a as (select article_id, list_filter(regexp_split_to_array(min(text), '[^\p{L}\p{N}''’-]+'), lambda x: x <> '') t from articles group by 1 having min(text) is not null),
      s as (select article_id, t, unnest(range(0, len(t))) i from a), n as (select article_id, i, unnest(range(1, (select max(len(w)) from w) + 1)) n, t from s), h as (select article_id, i, n, lower(array_to_string(list_slice(t, i + 1, i + n), '/')) k from n where i + n <= len(t))
      select article_id, i as start_token, n, k as alias_key from h where k in (select k from g) qualify row_number() over (partition by article_id, i order by n desc) = 1""",
    "speaker_runs": f"""
      with {_BRIDGED}, r as (select *, case when lag(speaker_qid) over w = speaker_qid then 0 else 1 end brk from b window w as (partition by article_id order by idx)),
      k as (select *, sum(brk) over (partition by article_id order by idx rows unbounded preceding) block_id from r)
      select article_id, cast(block_id as bigint) as block_id, min(idx) as first_idx, count(*) as n_quotes, string_agg(coalesce(text, ''), ' ' order by idx) as quote_text from k group by article_id, block_id""",
    "attribution_argmax": f"""
      with {_Q}, c as (select article_id, quote_id, unnest(local_probas) p, generate_subscripts(local_probas, 1) pos from q), s as (select article_id, coalesce(p.speaker, '') speaker, p.qid qid, round(sum(p.probability), 9) pr, min(quote_id || '-' || lpad(pos::varchar, 6, '0')) f from c where p.qid is not null and p.qid <> '' group by all),
      best as (select * from s qualify row_number() over (partition by article_id order by pr desc, f) = 1), pl as (select article_id, arg_min(speaker, quote_id) filter (coalesce(speaker, '') <> '') sp, arg_min(speaker_qid, quote_id) filter (coalesce(speaker_qid, '') <> '') sq, coalesce(max(speaker_probability), 0) p from q group by 1)
      select pl.article_id, case when best.qid is not null then best.speaker else sp end as speaker, coalesce(best.qid, sq) as qid, round(case when best.qid is not null then pr else p end, 6) as probability from pl left join best using (article_id)""",
    "mention_union": f"with {_Q}, m as (select distinct article_id, unnest(mentioned_entities) m from q), g as (select article_id, string_agg(m, ' ' order by m) s from m where m is not null group by 1) select article_id, coalesce(s, '') as mentions from (select distinct article_id from q) left join g using (article_id)",
}
SQL["masked_texts"] = f"""
      with {_MENTIONS},
      mm as (select *, row_number() over (partition by article_id order by i) j from full_), tk as (select s.article_id, s.i, case when mm.i = s.i then '[MASK]' when mm.i is null then t[s.i + 1] end w from s left join mm on mm.article_id = s.article_id and s.i >= mm.i and s.i < mm.i + mm.n),
      kp as (select *, row_number() over (partition by article_id order by i) r from tk where w is not null), tx as (select article_id, string_agg(case when r = 1 or regexp_matches(w, '^(''|[[:punct:]]+$)') then w else ' ' || w end, '' order by i) masked from kp group by 1),
      qs as (select article_id, j, unnest(string_split(q, ' ')) qid from mm), ps as (select article_id, count(distinct qid) n, string_agg(j::varchar, ' ' order by j) filter (qid = 'Q900000000') places, count(*) filter (qid = 'Q900000000') c from qs group by 1)
      select a.article_id, coalesce(masked, '') as masked, coalesce(n, 0) as nb_entities, coalesce(places, '0') as target_at, coalesce(c, 0) > 1 as ambiguous from a left join tx using (article_id) left join ps using (article_id)"""
