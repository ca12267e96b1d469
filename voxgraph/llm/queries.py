"""Queries of the problems, over whole tables, and SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import canonical, consensus, encoding, fuzzy, mixing, names, pairing, paragraphs, sentences, spans, tokens

Query = Callable[[SparkSession, str], DataFrame]


def quotations(spark: SparkSession, folder: str) -> DataFrame:
    """(id, text) of every quotation in both tables; an id occurs once or more."""
    q = table(spark, folder, "quote_candidates", "quote_id", "text").toDF("id", "text")
    return q.unionByName(table(spark, folder, "enriched_edges", "quoteid", "quotation").toDF("id", "text"))


def articles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "articles", "article_id", "text").toDF("id", "text")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", "doc_id", "text")


def annotation(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "annotation", "annotation_id", "annotator", "quote_id", "status", "sentiment", "qid", "saved_at")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return consensus.annotation_labels(annotation(spark, folder)).select("quote_id", "label_field", "label")


def p1_consensus(spark: SparkSession, folder: str) -> DataFrame:
    return consensus.annotation_labels(annotation(spark, folder))


def p1_reliability(spark: SparkSession, folder: str) -> DataFrame:
    return consensus.annotator_reliability(annotation(spark, folder))


def p1_agreement(spark: SparkSession, folder: str) -> DataFrame:
    return consensus.agreement(annotation(spark, folder))


def _listed(spark: SparkSession, folder: str, *keys: str, most: int = 10_000) -> list[str]:
    """Entries of the word lists in merger_patterns; more than `most` are an error, as they go to every task."""
    found = table(spark, folder, "merger_patterns").where(F.col("pattern_key").isin(*keys)).select("entry").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"word lists of over {most} entries")
    return [r.entry for r in found if r.entry is not None]


def _names(spark: SparkSession, folder: str) -> tuple[DataFrame, dict[str, list[str]]]:
    """Every name of the three fields, and the listed titles and pronouns."""
    fields = (("quote_candidates", "speaker"), ("gold_attributions", "gold_speaker"), ("entity_names", "name"))
    first, *more = (table(spark, folder, t, c).toDF("name") for t, c in fields)
    listed = {"titles": _listed(spark, folder, "speaker_titles"), "pronouns": _listed(spark, folder, "pronoun_speakers")}
    return first.unionByName(more[0]).unionByName(more[1]), listed


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    found, listed = _names(spark, folder)
    return names.name_pairs(found, "name", **listed).select(F.col("lo").alias("name_lo"), F.col("hi").alias("name_hi"))


def p2_clusters(spark: SparkSession, folder: str) -> DataFrame:
    found, listed = _names(spark, folder)
    return names.name_clusters(found, "name", **listed)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    quotes = table(spark, folder, "quote_candidates", "quote_id", "text")
    model = sentences.train(quotes, "text", [e.lower() for e in _listed(spark, folder, "abbreviations_before_period", "speaker_titles")])
    return sentences.sentence_starts(quotes, "quote_id", "text", model)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return fuzzy.near_pairs(quotations(spark, folder), "id", "text").select(F.col("lo").alias("quote_lo"), F.col("hi").alias("quote_hi"))


def p5_classes(spark: SparkSession, folder: str) -> DataFrame:
    return fuzzy.near_classes(quotations(spark, folder), "id", "text")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    q = canonical.content_keys(quotations(spark, folder), "text", "id").withColumn("rec_kind", F.lit("quote"))
    a = canonical.content_keys(articles(spark, folder), "text", "id", fields=True).withColumn("rec_kind", F.lit("article"))
    keys = ["rec_kind", "h128", "check"]
    pairs = [pairing.class_pairs(x, keys[1:], "id").select(F.lit(k).alias("rec_kind"), F.col("lo").alias("rec_lo"), F.col("hi").alias("rec_hi")) for k, x in (("quote", q), ("article", a))]
    return pairs[0].unionByName(pairs[1].distinct())


def p6_copies(spark: SparkSession, folder: str) -> DataFrame:
    q = canonical.collapse(quotations(spark, folder), "id", "text").withColumn("rec_kind", F.lit("quote"))
    a = canonical.collapse(articles(spark, folder), "id", "text", fields=True).withColumn("rec_kind", F.lit("article"))
    return q.unionByName(a).select("rec_kind", "record", "copies", "ids", "collided")


def p6_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Each record with the least id of its copies: linear in the rows where p6_found is quadratic in a class's copies."""
    q = canonical.copy_classes(quotations(spark, folder), "id", "text").withColumn("rec_kind", F.lit("quote"))
    a = canonical.copy_classes(articles(spark, folder), "id", "text", fields=True).withColumn("rec_kind", F.lit("article"))
    return q.unionByName(a).select("rec_kind", F.col("id").alias("rec_id"), "record", "ids")


def _decoded(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Records that may be damaged, and the table of garbled forms of the whole corpus."""
    q = table(spark, folder, "quote_candidates", "quote_id", "text").select(F.lit("quote").alias("rec_kind"), F.col("quote_id").alias("rec_id"), "text")
    a = table(spark, folder, "articles", "article_id", "detokenized_content").select(F.lit("article").alias("rec_kind"), F.col("article_id").alias("rec_id"), F.col("detokenized_content").alias("text"))
    records = q.unionByName(a)
    return records, encoding.forms(records.select("text").unionByName(table(spark, folder, "articles", "text")), "text")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    records, forms = _decoded(spark, folder)
    return encoding.damaged(records, ["rec_kind", "rec_id"], "text", forms)


def p7_restored(spark: SparkSession, folder: str) -> DataFrame:
    records, forms = _decoded(spark, folder)
    return encoding.restore(records, ["rec_kind", "rec_id"], "text", forms)


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_ids(documents(spark, folder), "text", "doc_id")


def p8_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_counts(documents(spark, folder), "text", "doc_id")


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(table(spark, folder, "documents", "doc_id", "source", "text"), table(spark, folder, "mix_targets"))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[1]


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return spans.shared_runs(documents(spark, folder), "doc_id", "text")[0].select(F.col("lo").alias("doc_lo"), F.col("hi").alias("doc_hi"))


def p10_shared(spark: SparkSession, folder: str) -> DataFrame:
    return spans.shared_share(documents(spark, folder), "doc_id", "text")


def p10_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return spans.removal_clusters(documents(spark, folder), "doc_id", "text")


def p10_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs that recur, nearly the same, and the one of each cluster to keep."""
    return paragraphs.repeated_paragraphs(documents(spark, folder), "doc_id", "text")


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit() and callable(v)}


#: Canonical form in SQL: letters and digits in lower case.
_CANON = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', '', 'g')"

_QUOTES = "select quote_id as id, text from quote_candidates union all select quoteid, quotation from enriched_edges"


def oracle_sql() -> dict[str, str]:
    q = _CANON.format("text")
    head = r"'^\s*([A-Za-z]+[ \t]*:[^;\r\n]*(;[ \t]*[A-Za-z]+[ \t]*:[^;\r\n]*)+);?[ \t]*(\r?\n|\r|$)'"
    fields = (
        f"case when regexp_extract(text, {head}, 1) <> '' then array_to_string(list_sort(list_transform(string_split(regexp_extract(text, {head}, 1), ';'), "
        f"lambda x: {_CANON.format('x')})), ';') || '|' || {_CANON.format(f'regexp_replace(text, {head}, {chr(39) * 2})')} else {q} end"
    )
    return {
        "p1_agreement": r"""
            with s as (
              select quote_id, annotator, lower(trim(status)) st, replace(lower(trim(sentiment)), ' ', '_') se, coalesce(upper(trim(qid)), '') qid, saved_at, annotation_id from annotation
              where quote_id is not null and annotator is not null and lower(trim(status)) in ('keep', 'reject')
            ), l as (select * from s qualify row_number() over (partition by quote_id, annotator order by saved_at desc, annotation_id desc) = 1
            ), v as (
              select quote_id, 'status' f, st as label from l
              union all select quote_id, 'sentiment', se from l where st = 'keep' and se <> ''
              union all select quote_id, 'qid', qid from l where st = 'keep'
            ), p as (select f, quote_id, label, count(*) n from v group by all
            ), i as (select f, quote_id, sum(n) n, sum(n * (n - 1)) same from p group by all having sum(n) > 1
            ), c as (select p.f, p.label, sum(p.n) n from p join i using (f, quote_id) group by all
            ), t as (select f, sum(n) votes, sum(n * n) sq from c group by f
            ), o as (select f, count(*) items, avg(same / (n * (n - 1))) ob from i group by f)
            select f as label_field, items, cast(votes as bigint) as votes, round(ob, 6) as observed, round(sq / (votes * votes), 6) as expected,
              round((ob - sq / (votes * votes)) / (1 - sq / (votes * votes)), 6) as kappa
            from o join t using (f)""",
        "p6_found": f"""
            with q as (select distinct id, {q} c from ({_QUOTES}) where text is not null and id is not null),
            a as (select distinct article_id id, {q} c, {fields} f from articles where text is not null and article_id is not null)
            select 'quote' rec_kind, x.id rec_lo, y.id rec_hi from q x join q y on x.c = y.c and x.id < y.id where x.c <> ''
            union all
            select distinct 'article', x.id, y.id from a x join a y on x.c = y.c and x.id < y.id where x.c <> ''
            union
            select distinct 'article', x.id, y.id from a x join a y on x.f = y.f and x.id < y.id where x.c <> ''""",
        "p6_copies": f"""
            with r as (select 'quote' rec_kind, id, {q} c from ({_QUOTES}) where text is not null and id is not null
              union all select 'article', article_id, {fields} from articles where text is not null and article_id is not null)
            select rec_kind, min(id) as record, count(*) as copies, count(distinct id) as ids, false as collided from r where c not in ('', '|') group by rec_kind, c""",
        "p6_classes": f"""
            with r as (select distinct 'quote' rec_kind, id, {q} c from ({_QUOTES}) where text is not null and id is not null
              union all select distinct 'article', article_id, {fields} from articles where text is not null and article_id is not null)
            select rec_kind, id as rec_id, min(id) over (partition by rec_kind, c) as record, count(*) over (partition by rec_kind, c) as ids from r where c not in ('', '|')""",
    }
