"""Queries of restoration, statistics, evaluation and annotation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank_tokens, phase_text
from ..operators import annotation, evaluation, restore, stats
from ..operators.merge import PRONOUNS
from ..sources.tables import table
from .network import article_texts, quote_rows

SCORES = ("clout", "tone", "conflict")


def _tokens(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "articles", "article_id", "detokenized_content").where("detokenized_content is not null").distinct()
    return a.select("article_id", F.explode(blank_tokens(F.col("detokenized_content"))).alias("token"))


def lexicon_majority(spark: SparkSession, folder: str) -> DataFrame:
    return restore.lexicon(_tokens(spark, folder), "token")


def question_repairs(spark: SparkSession, folder: str) -> DataFrame:
    q = quote_rows(spark, folder).where("text is not null").select(F.explode(blank_tokens(F.col("text"))).alias("token"))
    return restore.repair_questions(q, "token", restore.lexicon(_tokens(spark, folder), "token"))


def restored_questions(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "articles", "article_id", "detokenized_content").where("contains(detokenized_content, '?')").groupBy("article_id").agg(F.min("detokenized_content").alias("t"))
    texts = a.select("article_id", blank_tokens(F.col("t")).alias("t"))
    repairs = restore.repair_questions(texts.select(F.explode("t").alias("token")), "token", restore.lexicon(_tokens(spark, folder), "token"))
    return restore.apply_repairs(texts, "article_id", "t", repairs)


def rejoined_marks(spark: SparkSession, folder: str) -> DataFrame:
    q = table(spark, folder, "quote_candidates", "quote_id", "text").where("text is not null")
    return q.select("quote_id", restore.rejoin_garbled(F.col("text")).alias("text"))


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Articles' texts as the second kind of damage shows them, with the tokens as predicted and gold."""
    a = table(spark, folder, "articles", "article_id", "phase", "text", "detokenized_content").where("text is not null and detokenized_content is not null").distinct()
    gold, shown = blank_tokens(F.col("text")), blank_tokens(F.col("detokenized_content"))
    return a.select("article_id", F.coalesce("phase", F.lit("?")).alias("phase"), gold.alias("gold"), shown.alias("shown"), blank_tokens(phase_text(F.col("text"), "D")).alias("smashed")).where(F.size("gold") == F.size("shown"))


def restoration_scores(spark: SparkSession, folder: str) -> DataFrame:
    out = restore.word_scores(_pairs(spark, folder), "phase", "smashed", "shown", "gold")
    return out.select("phase", "n", "ok", "cased_n", "cased_ok", "damaged_n", "damaged_ok", F.round("accuracy", 6).alias("accuracy"))


def aligned_words(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "articles", "article_id", "text", "detokenized_content").where("text is not null and detokenized_content is not null").groupBy("article_id").agg(F.min("text").alias("text"), F.min("detokenized_content").alias("d"))
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    out = restore.aligned(a.select("article_id", words("d").alias("d"), words("text").alias("g")), "article_id", "d", "g")
    return out.select("article_id", F.array_join("projected", " ").alias("projected"), F.round("coverage", 6).alias("coverage"))


def ensemble_truecase(spark: SparkSession, folder: str) -> DataFrame:
    """Three simple models vote on each word of lower-cased quotations: a sentence case, the lexicon's surface, and the lower case."""
    from ..functions.text import collapse_blanks, fold_key, majority, sentence_truecase

    q = quote_rows(spark, folder).where("text is not null").select("quote_id", F.lower(collapse_blanks(F.col("text"))).alias("t")).distinct()
    words = F.arrays_zip(F.split(sentence_truecase(F.col("t")), " ").alias("s"), F.split("t", " ").alias("l"))
    rows = q.select("quote_id", F.posexplode(words).alias("at", "w")).select("quote_id", "at", "w.s", "w.l")
    lex = restore.lexicon(_tokens(spark, folder), "token").select("fold_key", "surface")
    met = rows.withColumn("fold_key", F.nullif(fold_key(F.col("l")), F.lit(""))).join(lex, "fold_key", "left")
    known = F.when(F.lower("surface") == F.col("l"), F.col("surface")).otherwise(F.col("l"))
    voted = met.select("quote_id", "at", majority(F.array("s", known, "l")).alias("w"))
    return voted.groupBy("quote_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "w"))), lambda x: x["w"]), " ").alias("text"))


# Statistics


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    return stats.preprocess(table(spark, folder, "enriched_edges"))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def preprocessed_edges(spark: SparkSession, folder: str) -> DataFrame:
    e = _edges(spark, folder)
    return e.select("edge_id", F.round("log_quote_length", 9).alias("log_quote_length"), "age_diff", F.round("pagerank_diff", 9).alias("pagerank_diff"), *(F.col(c).cast("long").alias(c) for c in ("source_age_bin", "target_age_bin", "age_diff_bin")), "dyad_id")


def bin_stats(spark: SparkSession, folder: str) -> DataFrame:
    e = _edges(spark, folder)
    parts = [stats.bin_statistics(e.withColumn("bin", F.col("age_diff_bin").cast("long")), s, "bin", least=30).withColumn("score", F.lit(s)) for s in SCORES]
    return _rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), "mean", "std", "se", "ci_low", "ci_high")


def heatmap_stats(spark: SparkSession, folder: str) -> DataFrame:
    e = _edges(spark, folder).withColumns({"source_bin": F.col("source_age_bin").cast("long"), "target_bin": F.col("target_age_bin").cast("long")})
    return _rounded(stats.bin_statistics(e, "tone", "source_bin", "target_bin", least=10), "mean", "std", "se", "ci_low", "ci_high")


def binning_sensitivity(spark: SparkSession, folder: str) -> DataFrame:
    b = stats.binning_sensitivity(_edges(spark, folder), "clout", "age_diff", 5, least=20)
    return _rounded(b.withColumn("gap_bin", F.col("gap_bin").cast("long")), "mean", "std", "se", "ci_low", "ci_high")


def qcut_bins(spark: SparkSession, folder: str) -> DataFrame:
    q = stats.quantile_bins(_edges(spark, folder).select("source_pagerank"), "source_pagerank", 20)
    return q.groupBy("source_pagerank_bin").agg(F.count("*").alias("n"), F.min("source_pagerank").alias("low"), F.max("source_pagerank").alias("high"))


def edge_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(stats.summary(_edges(spark, folder)), "mean_words")


def period_split(spark: SparkSession, folder: str) -> DataFrame:
    e = _edges(spark, folder).where("pub_year >= 2008 and pub_year < 2021").withColumn("period", F.when(F.col("pub_year") < 2015, "early").otherwise("late"))
    return _rounded(stats.bin_statistics(e, "tone", "period", least=1), "mean", "std", "se", "ci_low", "ci_high")


def gap_slope(spark: SparkSession, folder: str) -> DataFrame:
    """One predictor, whole, by occupation, by period and for sure attributions: the part of the regressions that SQL can hold against."""
    e = _edges(spark, folder).where("tone is not null and age_diff is not null")
    sets = {"all": F.lit(True), "early": F.col("pub_year") < 2015, "late": F.col("pub_year") >= 2015, "sure": F.col("prob_speaker") >= stats.SURE, "writer": F.col("source_occupation") == "writer"}
    rows = []
    for name, condition in sets.items():
        m = stats.fit(e.where(condition), "tone", {"gap": F.col("age_diff")})
        rows.append((name, m.n, round(float(m.beta[0]), 5), round(float(m.beta[1]), 5), round(m.r2, 6)))
    return spark.createDataFrame(rows, "subset string, n long, intercept double, slope double, r_squared double")


def gap_regressions(spark: SparkSession, folder: str) -> DataFrame:
    e, parts = _edges(spark, folder), []
    for score in SCORES:
        for gap, attribute in (("age_diff", "source_age"), ("pagerank_diff", "source_pagerank")):
            r = stats.gap_regression(e, score, gap, attribute)
            if r is not None:
                parts.append(r.withColumns({"score": F.lit(score), "gap": F.lit(gap)}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return stats.fdr(out, "p_value")


def interaction_regressions(spark: SparkSession, folder: str) -> DataFrame:
    return stats.interaction_regression(_edges(spark, folder), "tone", "source_age", "target_age")


def permutation_baseline(spark: SparkSession, folder: str) -> DataFrame:
    return stats.permutation_baseline(_edges(spark, folder), "edge_id", "tone", 5)


def variance_parts(spark: SparkSession, folder: str) -> DataFrame:
    return stats.variance_decomposition(_edges(spark, folder), "tone", "source_age_bin", "target_age_bin")


def fdr_bh(spark: SparkSession, folder: str) -> DataFrame:
    """A p-like column: the share of conflict scores by person mentioned, over 1000."""
    e = table(spark, folder, "enriched_edges", "target_id", "conflict").groupBy("target_id").agg(F.round(F.avg("conflict") / 20, 9).alias("p"))
    out = stats.fdr(e.where("target_id is not null"), "p", 0.05)
    return out.select("target_id", "p", F.round("p_adjusted", 9).alias("p_adjusted"), "significant")


# Evaluation


def _votes(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "annotation", "quote_id", "annotator", "status").select("quote_id", "annotator", F.lower(F.trim("status")).alias("guess")).where("guess in ('keep', 'reject')").distinct()
    majority = a.groupBy("quote_id").agg((F.count_if(F.col("guess") == "keep") * 2 > F.count("*")).alias("kept"))
    return a.join(majority, "quote_id").withColumn("truth", F.when(F.col("kept"), "keep").otherwise("reject"))


def annotator_prf(spark: SparkSession, folder: str) -> DataFrame:
    v = _votes(spark, folder).withColumn("said", F.col("guess") == "keep")
    return _rounded(evaluation.precision_recall(v, "annotator", "kept", "said"), "precision", "recall", "f1")


def annotator_macro_f1(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(evaluation.macro_f1(_votes(spark, folder), "annotator", "truth", "guess", ("keep", "reject")), "macro_f1")


def _outcomes(spark: SparkSession, folder: str) -> DataFrame:
    g = table(spark, folder, "gold_attributions")
    name = F.regexp_extract(F.coalesce("right_context", F.lit("")), r"([A-Z][a-z]+ [A-Z][a-z]+|\b[Hh]e\b|\b[Tt]hey\b)", 1)
    verb = F.lower(F.regexp_extract(F.coalesce("right_context", F.lit("")), r"\b(said|added|asked|wrote|told|argued|warned|noted)\b", 1))
    rows = g.select("paragraph_id", "quote_index", "quote_kind", "gold_speaker", F.col("gold_quotative_verb").alias("gold_verb"), name.alias("pred_speaker"), F.lit("").alias("pred_refers_to"), verb.alias("pred_verb"), F.concat_ws(" ", "left_context", "target_quote", "right_context").alias("document"))
    return evaluation.outcomes(rows, PRONOUNS)


def attribution_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    o = _outcomes(spark, folder).withColumn("category", evaluation.error_category())
    return o.select("paragraph_id", "quote_index", "speaker_exact", F.round("speaker_token_f1", 6).alias("speaker_token_f1"), "verb_exact", "category")


def attribution_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(evaluation.attribution_summary(_outcomes(spark, folder), "quote_kind"), "exact_accuracy", "relaxed_accuracy", "token_f1", "verb_accuracy")


def error_histogram(spark: SparkSession, folder: str) -> DataFrame:
    o = _outcomes(spark, folder).withColumn("category", evaluation.error_category())
    return o.groupBy("quote_kind", "category").agg(F.count("*").alias("n"))


def missed_examples(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.missed_groups(_outcomes(spark, folder), "paragraph_id", "quote_index")


# Annotation documents


def _records(spark: SparkSession, folder: str) -> DataFrame:
    """Records of each annotator and article from the last saves of its quotations."""
    s = table(spark, folder, "annotation").where("annotator is not null and article_id is not null and quote_id is not null")
    last = s.groupBy("annotator", "article_id", "quote_id").agg(F.max(F.struct("saved_at", "annotation_id", "status", "reject_reason", "surface", "qid", "sentiment")).alias("s"))
    quote = f"""from_json(to_json(named_struct('id', quote_id, 'status', lower(trim(s.status)), 'reject_reason', s.reject_reason, 'inner_start', 0, 'inner_end', 0, 'outer_start', 0, 'outer_end', 0, 'delimiter', 'curly', 'text', '',
      'speaker', named_struct('status', 'cannot_identify'), 'quotative', named_struct('status', 'implicit'),
      'mentions', array(named_struct('id', 'm1', 'start', 0, 'end', 0, 'surface', s.surface, 'qid', s.qid, 'nil', false, 'sentiment', replace(lower(trim(s.sentiment)), ' ', '_'), 'first_span', named_struct('start', 0, 'end', 0, 'surface', s.surface))), 'segments', array(), 'notes', '')), '{annotation.QUOTE}')"""
    return last.withColumn("q", F.expr(quote)).groupBy("annotator", "article_id").agg(F.collect_list("q").alias("quotes")).withColumns({"skipped": F.lit(False), "text": F.lit("")})


def batch_status(spark: SparkSession, folder: str) -> DataFrame:
    return annotation.batch_status(_records(spark, folder))


def record_errors(spark: SparkSession, folder: str) -> DataFrame:
    return annotation.record_errors(_records(spark, folder)).select("article_id", "annotator", F.size("errors").alias("n_errors"))


def new_annotation_records(spark: SparkSession, folder: str) -> DataFrame:
    a = article_texts(spark, folder).where("text is not null")
    return annotation.new_quotes(a, "article_id", "text").select("article_id", "text_hash", F.size("quotes").alias("n_quotes"), annotation.next_quote_id(F.col("article_id"), F.col("quotes")).alias("next_id"))


def articles_to_do(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "annotation", "article_id").distinct()
    return annotation.to_do(a, _records(spark, folder), "ana_k")


def quotative_cues(spark: SparkSession, folder: str) -> DataFrame:
    from ..operators.quotes import mark_spans

    a = article_texts(spark, folder).where("text is not null")
    s = mark_spans(a, "article_id", "text").select("article_id", "n", "outer_start", "outer_end").join(a, "article_id").withColumn("key", F.concat_ws("#", "article_id", "n"))
    return annotation.quotative_candidates(s, "key", "text", ("said", "added", "asked", "says", "told", "dijo", "sagte"))


def nearby_names(spark: SparkSession, folder: str) -> DataFrame:
    a = article_texts(spark, folder).where("text is not null").withColumn("middle", (F.length("text") / 2).cast("int"))
    return annotation.nearest_names(a, "article_id", "text", "middle", ("The", "This", "That"))


def located_surfaces(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "entity_names", "mention_id", "article_id", "name").where("name is not null").dropDuplicates(["mention_id"]).withColumn("surface", F.element_at(F.split(F.trim("name"), " "), -1))
    t = m.join(article_texts(spark, folder).where("text is not null"), "article_id").withColumns({"center": F.lit(0), "inner_start": F.lit(0), "inner_end": F.lit(0)})
    return annotation.locate_surface(t, "mention_id", "text", "surface", "center", "inner_start", "inner_end")


QUERIES = {
    f.__name__: f
    for f in (
        lexicon_majority, question_repairs, restored_questions, rejoined_marks, restoration_scores, aligned_words, ensemble_truecase, preprocessed_edges, bin_stats, heatmap_stats, binning_sensitivity, qcut_bins, edge_summary, period_split, gap_slope, gap_regressions, interaction_regressions,
        permutation_baseline, variance_parts, fdr_bh, annotator_prf, annotator_macro_f1, attribution_outcomes, attribution_summary, error_histogram, missed_examples, batch_status, record_errors, new_annotation_records, articles_to_do, quotative_cues, nearby_names, located_surfaces,
    )
}

_PRE = "e as (select *, ln(n_words) lq, source_age - target_age ad, source_pagerank - target_pagerank pd, cast(floor(source_age / 5) * 5 as bigint) sb, cast(floor(target_age / 5) * 5 as bigint) tb, cast(floor((source_age - target_age) / 5) * 5 as bigint) gb from enriched_edges where n_words >= 25 and source_id <> target_id)"
_STAT = "round(avg({0}), 6) as mean, round(stddev_samp({0}), 6) as std, count({0}) as n, round(stddev_samp({0}) / sqrt(count({0})), 6) as se, round(avg({0}) - 1.96 * (stddev_samp({0}) / sqrt(count({0}))), 6) as ci_low, round(avg({0}) + 1.96 * (stddev_samp({0}) / sqrt(count({0}))), 6) as ci_high"
_VOTES = "a as (select distinct quote_id, annotator, lower(trim(status)) guess from annotation where lower(trim(status)) in ('keep', 'reject')), m as (select quote_id, count(*) filter (guess = 'keep') * 2 > count(*) kept from a group by 1), v as (select *, case when kept then 'keep' else 'reject' end truth from a join m using (quote_id))"
_ANSWER = r"""case when lower(trim({0})) in ('', 'unknown', 'none', 'no speaker', 'not stated', 'not found', 'n/a', 'null') then '' else lower(regexp_replace(trim(regexp_replace({0}, '[\s\x0b\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g')), '^[ "''`.,:;!?()\[\]{{}}]+|[ "''`.,:;!?()\[\]{{}}]+$', '', 'g')) end"""
_TOKENS = "regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+(?:''[a-z0-9]+)?')"
_OUTCOMES = rf"""
    g as (select *, regexp_extract(coalesce(right_context, ''), '([A-Z][a-z]+ [A-Z][a-z]+|\b[Hh]e\b|\b[Tt]hey\b)', 1) ps, lower(regexp_extract(coalesce(right_context, ''), '\b(said|added|asked|wrote|told|argued|warned|noted)\b', 1)) pv from gold_attributions),
    t as (select *, {_TOKENS.format('ps')} x, {_TOKENS.format('gold_speaker')} y from g),
    u as (select *, list_distinct(x) dx, list_distinct(y) dy, {_ANSWER.format("ps")} = {_ANSWER.format("coalesce(gold_speaker, '')")} ex, {_ANSWER.format("pv")} = {_ANSWER.format("coalesce(gold_quotative_verb, '')")} vx, coalesce(list_sum(list_transform(list_distinct(x), lambda w: least(len(list_filter(x, lambda a: a = w)), len(list_filter(y, lambda a: a = w))))), 0) sh from t),
    o as (select *, case when len(x) = 0 and len(y) = 0 then 1 when sh = 0 then 0 else 2.0 * sh / (len(x) + len(y)) end f1,
      case when ex then 'correct' when len(y) = 0 and len(x) > 0 then 'false_positive_unknown' when len(y) > 0 and len(x) = 0 then 'missing_speaker' when not list_has_any(dx, dy) then 'wrong_speaker'
        when list_has_any(dx, [{', '.join(repr(w) for w in evaluation.QUOTATIVE_VERBS)}]) then 'speaker_span_includes_verb_or_clause' when list_has_all(dx, dy) and list_has_any(list_filter(dx, lambda w: not list_contains(dy, w)), [{', '.join(repr(w) for w in evaluation.TITLE_TOKENS)}]) then 'title_or_role_expansion'
        when list_has_all(dx, dy) then 'overlong_name_span' when list_has_all(dy, dx) then 'underspecified_name_span' else 'alias_or_partial_overlap' end cat from u)"""
_SETS = "select 'all' s, * from e union all select 'early', * from e where pub_year < 2015 union all select 'late', * from e where pub_year >= 2015 union all select 'sure', * from e where prob_speaker >= 0.8 union all select 'writer', * from e where source_occupation = 'writer'"
_LAST = "l as (select * from annotation where annotator is not null and article_id is not null and quote_id is not null qualify row_number() over (partition by annotator, article_id, quote_id order by saved_at desc, annotation_id desc) = 1), q as (select *, lower(trim(status)) = 'reject' or (lower(trim(status)) = 'keep' and replace(lower(trim(sentiment)), ' ', '_') in ('positive', 'negative', 'mixed', 'neutral', 'not_about') and coalesce(qid, '') <> '') done from l)"
_LEXICON = r"""
      la as (select distinct article_id, detokenized_content c from articles where detokenized_content is not null), lt as (select unnest(string_split(c, ' ')) s from la), lk as (select lower(regexp_replace(s, '[^A-Za-z0-9]', '', 'g')) f, s, regexp_matches(s, '[^\x00-\x7F]') x from lt),
      ln as (select f, s, x, count(*) n from lk where f <> '' and not (not x and s = lower(s)) group by all), lex as (select f, s from ln qualify row_number() over (partition by f order by x desc, n desc, s) = 1), ql as (select f, s from lex where regexp_matches(s, '[^\x00-\x7F]'))"""
#: The repairs of a table tok of tokens.
_TAIL = r"""'^(.*?)([!"#$%&''()*+,\-./:;<=>@\[\\\]^_`{|}~“”‘’«»]*)$'"""
_REPAIRS = rf"""
      dm as (select distinct token from tok where regexp_matches(token, '\?.|.\?\p{{L}}')), co as (select token, regexp_extract(token, {_TAIL}, 1) core, regexp_extract(token, {_TAIL}, 2) tail from dm), cq as (select * from co where contains(core, '?')),
      fi as (select token, core, f, s from cq join ql on length(core) = length(s) where len(list_filter(range(1, length(core) + 1), lambda i: not case when core[i] = '?' then not regexp_matches(s[i], '^[A-Za-z0-9]$') else lower(core[i]) = lower(s[i]) end)) = 0),
      ex as (select token, min(s) s from fi where f = lower(regexp_replace(core, '[^A-Za-z0-9]', '', 'g')) group by 1), wi as (select token, min(s) s from fi group by 1 having count(distinct s) = 1),
      rp as (select dm.token, case when coalesce(ex.s, wi.s) is not null then coalesce(ex.s, wi.s) || cq.tail else dm.token end repaired from dm left join cq using (token) left join ex using (token) left join wi using (token))"""
_REJOINED = "text"
for _p, _t in (
    (r"â\s+€\s*œ", "“"), (r"â\s+€\s*™", "’"), (r"â\s+€\s*\x{9d}", "”"), (r"â\s+€\s*˜", "‘"), (r"(?i)â\s+(s|t|re|ve|ll|d)\b", r"''\1"), (r"â\s+€", "”"), *restore.SHOWN,
    (r"""(^|[\s“”"''])€œ""", r"\1“"), (r"""(^|[\s“”"''])€([A-Za-z])""", r"\1\2"), (r"â(\s|$)", r"\1"), (r"(\S)(“)", r"\1 \2"), (r"(”)([A-Za-z])", r"\1 \2"),
):
    _REJOINED = f"regexp_replace({_REJOINED}, '{_p}', '{_t}', 'g')"
SQL = {
    "question_repairs": f"with {_LEXICON}, tok as (select unnest(string_split(text, ' ')) token from (select distinct * from quote_candidates) where text is not null), {_REPAIRS} select token, repaired from rp",
    "restored_questions": f"""
      with {_LEXICON}, ar as (select article_id, min(detokenized_content) t from articles where contains(detokenized_content, '?') group by 1), tk as (select article_id, unnest(string_split(t, ' ')) token, generate_subscripts(string_split(t, ' '), 1) i from ar), tok as (select token from tk), {_REPAIRS}
      select article_id, string_agg(coalesce(repaired, tk.token), ' ' order by i) as text from tk left join rp using (token) group by 1""",
    "rejoined_marks": f"select quote_id, case when regexp_matches(text, '[ÃÂâ€]') then {_REJOINED} else text end as text from quote_candidates where text is not null",
    "attribution_summary": f"""
      with {_OUTCOMES}, d as (select *, lower(concat_ws(' ', left_context, target_quote, right_context)) doc, lower(trim(ps)) p1, lower(trim(pv)) v1 from o)
      select quote_kind, count(*) as total, round(avg(ex::int), 6) as exact_accuracy, round(avg(ex::int), 6) as relaxed_accuracy, round(avg(f1), 6) as token_f1, round(avg(vx::int), 6) as verb_accuracy, count(*) filter (not ex) as exact_misses, count(*) filter (not ex and f1 < 0.5) as low_overlap_misses,
        count(*) filter (not ((p1 = '' or contains(doc, p1)) and (v1 = '' or contains(doc, v1)))) as copied_span_failures, count(*) filter ({_ANSWER.format("ps")} in ({', '.join(repr(x) for x in PRONOUNS)})) as pronoun_predictions from d group by 1""",
    "located_surfaces": r"""
      with m as (select mention_id, article_id, min(name) as name from entity_names where name is not null group by 1, 2), s as (select mention_id, article_id, string_split(trim(name), ' ')[-1] s from m), a as (select article_id, min(text) t from articles where text is not null group by 1),
      j as (select mention_id, t, s, string_split(lower(t), lower(s)) p from s join a using (article_id) where s <> ''), o as (select mention_id, t, s, unnest(list_transform(range(1, len(p)), lambda k: list_sum(list_transform(p[1:k], lambda x: len(x))) + (k - 1) * len(s))) i from j where len(p) > 1)
      select mention_id, cast(i as int) as start, cast(i + len(s) as int) as end from o qualify row_number() over (partition by mention_id order by substring(t, cast(i as int) + 1, len(s)) <> s, i) = 1""",
    "lexicon_majority": r"""
      with a as (select distinct article_id, detokenized_content c from articles where detokenized_content is not null), t as (select unnest(string_split(c, ' ')) s from a), k as (select lower(regexp_replace(s, '[^A-Za-z0-9]', '', 'g')) f, s, regexp_matches(s, '[^\x00-\x7F]') x from t),
      n as (select f as fold_key, s as surface, x, count(*) n from k where f <> '' and not (not x and s = lower(s)) group by all) select fold_key, surface, n from n qualify row_number() over (partition by fold_key order by x desc, n desc, surface) = 1""",
    "restoration_scores": r"""
      with a as (select distinct article_id, coalesce(phase, '?') phase, text, detokenized_content d from articles where text is not null and d is not null), b as (select phase, string_split(text, ' ') g, string_split(d, ' ') p, string_split(regexp_replace(text, '[^\x00-\x7F]', '?', 'g'), ' ') s from a),
      w as (select phase, unnest(g) g, unnest(p) p, unnest(s) s from b where len(g) = len(p)), k as (select *, coalesce(nullif(lower(regexp_replace(p, '[^A-Za-z0-9]', '', 'g')), ''), lower(p)) = coalesce(nullif(lower(regexp_replace(g, '[^A-Za-z0-9]', '', 'g')), ''), lower(g)) same, regexp_matches(g, '\p{Lu}') cased, s <> g and (contains(s, '?') or regexp_matches(s, '[ÃÂâ�]')) hurt from w)
      select phase, count(*) filter (same) as n, count(*) filter (same and p = g) as ok, count(*) filter (same and cased) as cased_n, count(*) filter (same and cased and p = g) as cased_ok, count(*) filter (hurt) as damaged_n, count(*) filter (hurt and p = g) as damaged_ok,
        round(coalesce(count(*) filter (same and p = g) / nullif(count(*) filter (same), 0), 0), 6) as accuracy from k group by phase""",
    "preprocessed_edges": f"with {_PRE} select edge_id, round(lq, 9) as log_quote_length, ad as age_diff, round(pd, 9) as pagerank_diff, sb as source_age_bin, tb as target_age_bin, gb as age_diff_bin, source_id || '_' || target_id as dyad_id from e",
    "bin_stats": f"with {_PRE} " + " union all ".join(f"select gb as bin, {_STAT.format(s)}, '{s}' as score from e where gb is not null group by gb having count({s}) >= 30" for s in SCORES),
    "heatmap_stats": f"with {_PRE} select sb as source_bin, tb as target_bin, {_STAT.format('tone')} from e where sb is not null and tb is not null group by all having count(tone) >= 10",
    "binning_sensitivity": f"with {_PRE}, w as (select * from (values ('half', 2), ('base', 5), ('double', 10)) t(label, width)), b as (select label, width, cast(floor(ad / width) * width as bigint) gap_bin, clout from e, w where ad is not null) select label, width, gap_bin, {_STAT.format('clout')} from b group by all having count(clout) >= 20",
    "qcut_bins": f"with {_PRE}, c as (select list_distinct(quantile_cont(source_pagerank, [{', '.join(str(i / 20) for i in range(21))}])) c from e), b as (select source_pagerank x, case when source_pagerank is null then null else greatest(len(list_filter(c, lambda y: y < source_pagerank)) - 1, 0) end b from e, c) select b as source_pagerank_bin, count(*) as n, min(x) as low, max(x) as high from b group by b",
    "edge_summary": f"with {_PRE} select count(*) as n_quotes, count(distinct source_id) as n_speakers, count(distinct target_id) as n_targets, count(distinct source_id || '_' || target_id) as n_dyads, median(n_words) as median_words, round(avg(n_words), 6) as mean_words, min(pub_year) as first_year, max(pub_year) as last_year from e",
    "period_split": f"with {_PRE}, p as (select *, case when pub_year < 2015 then 'early' else 'late' end period from e where pub_year >= 2008 and pub_year < 2021) select period, {_STAT.format('tone')} from p group by period having count(tone) >= 1",
    "gap_slope": f"with {_PRE}, k as ({_SETS}) select s as subset, count(*) as n, round(regr_intercept(tone, ad), 5) as intercept, round(regr_slope(tone, ad), 5) as slope, round(regr_r2(tone, ad), 6) as r_squared from k where tone is not null and ad is not null group by s",
    "fdr_bh": "with p as (select target_id, round(avg(conflict) / 20, 9) p from enriched_edges where target_id is not null group by 1), r as (select *, row_number() over (order by p nulls last) r, count(p) over () n from p), a as (select *, least(1.0, min(p * n / r) over (order by r desc rows unbounded preceding)) a from r) select target_id, p, case when p is not null then round(a, 9) end as p_adjusted, case when p is not null then a < 0.05 end as significant from a",
    "annotator_prf": f"with {_VOTES}, c as (select annotator, count(*) n, count(*) filter (kept and guess = 'keep') tp, count(*) filter (not kept and guess = 'keep') fp, count(*) filter (kept and guess <> 'keep') fn from v group by 1), r as (select *, coalesce(tp / nullif(tp + fp, 0), 0) p, coalesce(tp / nullif(tp + fn, 0), 0) r from c) select annotator, n, tp, fp, fn, round(p, 6) as precision, round(r, 6) as recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) as f1 from r",
    "annotator_macro_f1": f"with {_VOTES}, l as (select unnest(['keep', 'reject']) l), c as (select annotator, l, count(*) filter (truth = l and guess = l) tp, count(*) filter (truth <> l and guess = l) fp, count(*) filter (truth = l and guess <> l) fn from v, l group by all) select annotator, round(avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)), 6) as macro_f1 from c group by 1",
    "attribution_outcomes": f"with {_OUTCOMES} select paragraph_id, quote_index, ex as speaker_exact, round(f1, 6) as speaker_token_f1, vx as verb_exact, cat as category from o",
    "error_histogram": f"with {_OUTCOMES} select quote_kind, cat as category, count(*) as n from o group by all",
    "missed_examples": f"with {_OUTCOMES} select paragraph_id, quote_index, count(*) as n, string_agg(distinct cat, ' ' order by cat) as categories from o group by 1, 2 having not bool_and(ex)",
    "batch_status": f"with {_LAST} select article_id, annotator, count(*) as n_quotes, count(*) filter (done) as n_done, case when bool_and(coalesce(done, false)) then 'done' else 'in_progress' end as status from q group by 1, 2",
    "record_errors": f"with {_LAST} select article_id, annotator, count(*) as n_errors from q group by 1, 2",
    "articles_to_do": f"with {_LAST}, d as (select article_id from q where annotator = 'ana_k' group by 1 having bool_and(coalesce(done, false))) select distinct article_id from annotation where article_id not in (select article_id from d)",
}
SQL["nearby_names"] = r"""
      with a as (select article_id, min(text) t from articles group by 1 having min(text) is not null),
      n as (select article_id, t, cast(floor(length(t) / 2) as int) c, unnest(list_distinct(list_filter(regexp_extract_all(regexp_replace(t, '[^\x00-\x7F\p{P}\p{S}\p{Z}\p{C}]', '_', 'g'), '\b[A-Z][a-z]+(?: [A-Z][a-z]+){0,3}\b'), lambda x: lower(x) not in ('the', 'this', 'that')))) as name from a),
      j as (select *, string_split(lower(t), lower(name)) p from n), o as (select article_id, t, c, name, unnest(list_transform(range(1, len(p)), lambda k: list_sum(list_transform(p[1:k], lambda x: len(x))) + (k - 1) * len(name))) i from j where len(p) > 1),
      f as (select article_id, name, cast(i as int) as start, abs(cast(i as int) - c) as distance from o where substring(t, cast(i as int) + 1, len(name)) = name and abs(i - c) <= 600),
      g as (select * from f qualify row_number() over (partition by article_id, lower(name) order by start, name) = 1)
      select article_id, name, start, distance, row_number() over (partition by article_id order by distance, start, name) as rank from g qualify rank <= 10"""
