"""Queries of string, URL and date functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dump, nested, text, urls
from ..operators.annotation import text_hash
from ..operators.merge import PRONOUNS, TITLES
from ..sources.readers import html_text, is_html, ptb_tokens
from ..sources.tables import table


def phase_texts(spark: SparkSession, folder: str) -> DataFrame:
    q = table(spark, folder, "quote_candidates", "quote_id", "text")
    return q.select("quote_id", *(text.phase_text(F.col("text"), p).alias(f"phase_{p.lower()}") for p in "BCD"))


def phase_a_text(spark: SparkSession, folder: str) -> DataFrame:
    q = table(spark, folder, "quote_candidates", "quote_id", "text")
    return q.select("quote_id", text.phase_text(F.col("text"), "A").alias("phase_a"))


def phase_of_articles(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "articles", "article_id", "date_published", "phase", "title")
    d = F.col("date_published")
    return a.select("article_id", text.phase_of_date(d).alias("phase_by_date"), F.left("article_id", F.lit(10)).alias("id_date"), F.left("article_id", F.lit(4)).alias("id_year"), text.wayback_stamp(d).alias("stamp"), text.phase_text_by(F.col("title"), F.when(F.col("phase") == "A", "C").otherwise(F.col("phase"))).alias("title_as_shown"))


def token_profile(spark: SparkSession, folder: str) -> DataFrame:
    q = table(spark, folder, "quote_candidates", "quote_id", "text")
    t = F.col("text")
    return q.select("quote_id", text.collapse_blanks(t).alias("normal"), text.word_count(t).alias("n_words"), text.compact(t, 4).alias("compact"), text.equals_lower(t).alias("equals_lower"), F.size(text.blank_tokens(t)).alias("n_blank_tokens"))


def token_rewrites(spark: SparkSession, folder: str) -> DataFrame:
    q = table(spark, folder, "quote_candidates", "quote_id", "text")
    t = F.col("text")
    return q.select("quote_id", text.split_hyphens(t).alias("split_hyphens"), text.sentence_truecase(F.lower(t)).alias("truecased"))


def token_edges(spark: SparkSession, folder: str) -> DataFrame:
    q = table(spark, folder, "quote_candidates", "quote_id", "text")
    t = F.col("text")
    tokens = F.array_join(text.drop_punctuation(text.blank_tokens(t)), " ")
    rebuilt = text.rebuild_brackets(F.concat(F.lit("[ MASK ] "), t))
    return q.select(
        "quote_id", text.all_lower(t).alias("all_lower"), rebuilt.alias("rebuilt"), tokens.alias("without_punctuation"), text.edge_words(t, 10, True).alias("first_words"), text.edge_words(t, 10, False).alias("last_words")
    )


def speaker_forms(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "quote_candidates", "speaker").where("speaker is not null").distinct()
    tokens = text.speaker_tokens(F.col("speaker"), TITLES)
    return s.select("speaker", F.array_join(tokens, " ").alias("tokens"), text.is_one_of(tokens, PRONOUNS).alias("is_pronoun"), text.mention_form(F.col("speaker"), PRONOUNS).alias("form"), F.array_join(text.alnum_tokens(F.col("speaker")), " ").alias("alnum"))


def fold_keys(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "articles", "detokenized_content").where("detokenized_content is not null")
    t = a.select(F.explode(text.blank_tokens(F.col("detokenized_content"))).alias("token")).where("token <> ''").distinct()
    x = F.col("token")
    return t.select("token", text.fold_key(x).alias("fold_key"), text.align_key(x).alias("align_key"), text.looks_garbled(x).alias("garbled"), text.needs_repair(x).alias("needs_repair"))


def url_parts(spark: SparkSession, folder: str) -> DataFrame:
    u = table(spark, folder, "articles", "url").where("url is not null").distinct()
    x = F.col("url")
    return u.select("url", urls.host(x).alias("host"), urls.domain_field(x).alias("domain_field"), urls.registered_domain(x).alias("registered"), urls.is_blocked(x).alias("blocked"), urls.strip_tracking(x).alias("no_tracking"), urls.strip_query(x).alias("no_query"))


def url_variants(spark: SparkSession, folder: str) -> DataFrame:
    u = table(spark, folder, "articles", "url").where("url is not null").distinct()
    rows = u.select("url", urls.has_material_rewrite(F.col("url")).alias("material"), F.posexplode(urls.variants(F.col("url"))).alias("n", "v"))
    return rows.select("url", "material", "n", F.col("v.label").alias("label"), F.col("v.url").alias("variant"))


def domains_per_phase(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "articles", "phase", "url")
    hosts = a.where("url is not null").select("phase", urls.registered_domain(F.col("url")).alias("d")).groupBy("phase").agg(F.countDistinct("d").alias("n_domains"))
    return hosts


def text_hashes(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "articles", "article_id", "text", "detokenized_content")
    t = nested.first_nonblank(F.col("text"), F.col("detokenized_content"))
    return a.select("article_id", text_hash(t).alias("text_hash"), F.length(t).alias("n_chars"))


def answers_normal(spark: SparkSession, folder: str) -> DataFrame:
    g = table(spark, folder, "gold_attributions", "paragraph_id", "quote_index", "gold_speaker", "left_context", "right_context")
    verbs = ("said", "added", "asked", "wrote", "told", "argued", "warned", "noted", "replied", "claimed")
    return g.select("paragraph_id", "quote_index", text.normal_answer(F.col("gold_speaker")).alias("answer"), text.minimal_person(F.col("gold_speaker")).alias("person"), text.nearest_verb(F.col("left_context"), F.col("right_context"), verbs).alias("verb"), F.array_join(text.proper_names(F.coalesce("left_context", F.lit("")), ("the",)), "|").alias("names"))


def marked_spans_text(spark: SparkSession, folder: str) -> DataFrame:
    g = table(spark, folder, "gold_attributions", "paragraph_id", "quote_index", "left_context", "target_quote", "right_context")
    l_, t = (F.filter(F.split(F.coalesce(c, F.lit("")), " "), lambda w: w != "") for c in ("left_context", "target_quote"))
    both = F.concat(l_, t)
    return g.select("paragraph_id", "quote_index", text.mark_span(both, F.size(l_), F.size(both)).alias("marked"))


def json_projection(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events", "event_id", "props")
    return e.select("event_id", nested.json_field(F.col("props"), "$.k").cast("long").alias("k"))


def _page(c: str) -> Column:
    return F.concat(F.lit("<html><body><p>"), F.replace(F.col(c), F.lit("\n"), F.lit("</p><p>")), F.lit("</p></body></html>"))


def html_as_text(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents", "doc_id", "text").where("text is not null")
    return d.select("doc_id", is_html(F.lit(None).cast("string"), _page("text")).alias("is_html"), html_text(_page("text")).alias("plain"))


def html_as_tokens(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents", "doc_id", "text").where("text is not null")
    return d.select("doc_id", F.size(ptb_tokens(html_text(_page("text")))).alias("n_tokens"))


def cleaned_dump(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "articles", "article_id", "detokenized_content").where("detokenized_content is not null")
    x = F.col("detokenized_content")
    return a.select("article_id", dump.clean_dump(x).alias("clean"), F.size(dump.split_punctuation(text.blank_tokens(x))).alias("n_tokens"))


def speaker_candidates(spark: SparkSession, folder: str) -> DataFrame:
    g = table(spark, folder, "gold_attributions", "paragraph_id", "quote_index", "left_context", "right_context", "gold_speaker")
    c = dump.speaker_candidates(F.concat_ws(" ", "left_context", "right_context"), PRONOUNS)
    return g.select("paragraph_id", "quote_index", F.array_join(c, "|").alias("candidates"), dump.canonical_candidate(F.coalesce("gold_speaker", F.lit(""))).alias("canonical_gold"))


def encoding_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Words of texts that split alike, damaged against clean: matches and smashed names by phase."""
    a = table(spark, folder, "articles", "phase", "text", "detokenized_content").where("text is not null and detokenized_content is not null").distinct()
    a = a.select("phase", text.blank_tokens(F.col("text")).alias("g"), text.blank_tokens(F.col("detokenized_content")).alias("d")).where("size(g) = size(d)")
    w = a.select("phase", F.explode(F.arrays_zip("g", "d")).alias("w")).select("phase", "w.g", "w.d")
    return w.groupBy("phase").agg(F.count("*").alias("n"), F.count_if(dump.encoding_match(F.col("d"), F.col("g"))).alias("matches"), F.count_if(dump.is_name_smash(F.col("d"), F.col("g"))).alias("smashed"))


QUERIES = {f.__name__: f for f in (phase_texts, phase_a_text, phase_of_articles, token_profile, token_rewrites, token_edges, speaker_forms, fold_keys, url_parts, url_variants, domains_per_phase, text_hashes, answers_normal, marked_spans_text, json_projection, html_as_text, html_as_tokens, cleaned_dump, speaker_candidates, encoding_scores)}

_BLANKS = r"[\s\x0b\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_WORD = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}]+"
_NORMAL = f"trim(regexp_replace(coalesce(text, ''), '{_BLANKS}', ' ', 'g'))"
_TITLES = ", ".join(f"'{t}'" for t in TITLES)
_PRONOUNS = ", ".join(f"'{t}'" for t in PRONOUNS)
_TRACKING = ", ".join(f"'{t}'" for t in urls.TRACKING)
_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_EDGE = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}]+|[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}\s\x0b\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_ASKED = r"(?i)\b(said|added|asked|wrote|told|argued|warned|noted|replied|claimed)\b"
_MINIMAL = r"(?i)^(mr|mrs|ms|miss|dr|prof|sir|dame|lord|lady|president|senator|sen|rep|gov|judge|minister|captain)\.?\s+"
_OUTER = r"""^[ "''`.,:;!?()\[\]{}]+|[ "''`.,:;!?()\[\]{}]+$"""
SQL = {
    "token_edges": rf"""
      with q as (select quote_id, text, regexp_extract_all(coalesce(text, ''), '{_EDGE}') w, list_filter(string_split(text, ' '), lambda t: regexp_matches(t, '^\[.*\]$') or (not regexp_matches(t, '^[[:punct:]]*$') and lower(t) not in ('''s', 's''', 'n''t'))) k,
        regexp_replace(text, '\[(MASK|QUOTE|TARGET_QUOTE)\]', '', 'g') b from quote_candidates)
      select quote_id, case when coalesce(text, '') = '' then true else b = lower(b) and regexp_matches(b, '\p{{L}}') end as all_lower, regexp_replace('[ MASK ] ' || text, '\[ (.*?) \]', '[\1]', 'g') as rebuilt, array_to_string(k, ' ') as without_punctuation,
        array_to_string(w[1:10], ' ') as first_words, array_to_string(case when len(w) > 10 then w[-10:] else w end, ' ') as last_words from q""",
    "answers_normal": rf"""
      with g as (select *, regexp_extract_all(coalesce(left_context, ''), '{_EDGE}') l, regexp_extract_all(coalesce(right_context, ''), '{_EDGE}') r from gold_attributions),
      v as (select *, regexp_extract_all(array_to_string(case when len(l) > 35 then l[-35:] else l end, ' '), '{_ASKED}', 1) a, regexp_extract_all(array_to_string(r[1:35], ' '), '{_ASKED}', 1) b from g)
      select paragraph_id, quote_index, case when lower(trim(gold_speaker)) in ('', 'unknown', 'none', 'no speaker', 'not stated', 'not found', 'n/a', 'null') then '' else lower(regexp_replace(trim(regexp_replace(gold_speaker, '{_BLANKS}', ' ', 'g')), '{_OUTER}', '', 'g')) end as answer,
        regexp_replace(trim(gold_speaker), '{_MINIMAL}', '') as person, lower(coalesce(a[-1], b[1])) as verb,
        array_to_string(list_filter(regexp_extract_all(regexp_replace(coalesce(left_context, ''), '[^\x00-\x7F\p{{P}}\p{{S}}\p{{Z}}\p{{C}}]', '_', 'g'), '\b[A-Z][a-z]+(?: [A-Z][a-z]+){{0,3}}\b'), lambda n: lower(n) <> 'the'), '|') as names from v""",
    "phase_texts": r"select quote_id, regexp_replace(lower(text), '[^\x00-\xFF]', '?', 'g') phase_b, regexp_replace(lower(text), '[^\x00-\x7F]', '?', 'g') phase_c, regexp_replace(text, '[^\x00-\x7F]', '?', 'g') phase_d from quote_candidates",
    "phase_of_articles": "select article_id, case "
    + " ".join(f"when length(date_published) >= 10 and date_published[1:10] between '{a}' and '{b}' then '{p}'" for p, a, b in text.PHASES)
    + r""" end phase_by_date, article_id[1:10] id_date, article_id[1:4] id_year, (regexp_replace(date_published, '[^0-9]', '', 'g') || '0101000000')[1:14] as stamp,
      case phase when 'A' then regexp_replace(lower(title), '[^\x00-\x7F]', '?', 'g') when 'C' then regexp_replace(lower(title), '[^\x00-\x7F]', '?', 'g') when 'B' then regexp_replace(lower(title), '[^\x00-\xFF]', '?', 'g')
        when 'D' then regexp_replace(title, '[^\x00-\x7F]', '?', 'g') else title end title_as_shown from articles""",
    "token_profile": f"""
      with b as (select quote_id, text, {_NORMAL} n from quote_candidates), t as (select *, string_split(n, ' ') t from b)
      select quote_id, n as normal, len(regexp_extract_all(text, '{_WORD}')) as n_words, case when text is null then null when len(t) > 8 then array_to_string(t[1:4], ' ') || ' [...] ' || array_to_string(t[-4:], ' ')
        else regexp_replace(text, '^{_BLANKS}|{_BLANKS}$', '', 'g') end as compact, coalesce(text = lower(text), true) as equals_lower, len(string_split(text, ' ')) as n_blank_tokens from t""",
    "speaker_forms": f"""
      with s as (select distinct speaker from quote_candidates where speaker is not null),
      t as (select speaker, list_filter(list_transform(regexp_extract_all(speaker, '[A-Za-z0-9][A-Za-z0-9.''-]*'), lambda w: trim(lower(w), '.')), lambda w: w not in ({_TITLES})) t from s)
      select speaker, array_to_string(t, ' ') as tokens, len(t) = 1 and coalesce(t[1] in ({_PRONOUNS}), false) as is_pronoun,
        case when lower(trim(speaker)) in ({_PRONOUNS}) then 'pronoun' when regexp_matches(lower(trim(speaker)), '^(the|an?) ') then 'nominal' else 'proper' end as form,
        array_to_string(regexp_extract_all(lower(speaker), '[a-z0-9]+(?:''[a-z0-9]+)?'), ' ') as alnum from t""",
    "fold_keys": r"""
      with t as (select distinct unnest(string_split(detokenized_content, ' ')) token from articles where detokenized_content is not null),
      k as (select token, lower(regexp_replace(token, '[^A-Za-z0-9]', '', 'g')) f, regexp_matches(token, '[ÃÂâ]') or regexp_matches(token, '^€[œ˜™]') or regexp_matches(token, '^€\p{L}') g from t where token <> '')
      select token, f as fold_key, coalesce(nullif(f, ''), lower(token)) as align_key, g as garbled, g or contains(token, '?') as needs_repair from k""",
    "url_parts": f"""
      with u as (select distinct url from articles where url is not null),
      p as (select url, regexp_extract(url, '{_URL}', 1) s, regexp_extract(url, '{_URL}', 2) h, regexp_extract(url, '{_URL}', 3) p, regexp_extract(url, '{_URL}', 4) q, regexp_extract(url, '{_URL}', 5) f from u),
      k as (select *, lower(regexp_replace(regexp_replace(h, '^.*@', ''), ':[0-9]+$', '')) host, list_filter(string_split(q, '&'), lambda x: x <> '') a from p),
      t as (select *, list_filter(a, lambda x: lower(split_part(x, '=', 1)) not in ({_TRACKING}) and not starts_with(lower(x), 'utm_')) kept from k)
      select url, host, coalesce(string_split(url, '/')[3], '') as domain_field, array_to_string(string_split(host, '.')[-2:], '.') as registered,
        list_contains(['wordpress.com', 'wikia.com', 'gamereactor.eu', 'myspace.com', 'typepad.com'], array_to_string(string_split(host, '.')[-2:], '.')) as blocked,
        case when len(kept) < len(a) then s || '://' || h || p || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end || case when f <> '' then '#' || f else '' end end as no_tracking,
        case when q <> '' and regexp_matches(p, '(?i)(id[A-Z0-9]{{6,}}|\\.html(?:$|/)|/\\d{{8}}/|/\\d{{5,}})') then s || '://' || h || p end as no_query from t""".replace("\\\\", "\\"),
    "domains_per_phase": r"select phase, count(distinct array_to_string(string_split(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '.')[-2:], '.')) as n_domains from articles where url is not null group by phase",
    "text_hashes": r"""
      with t as (select article_id, case when regexp_matches(text, '[^\s\x{A0}\x{85}\x{2000}-\x{200A}\x{3000}\x{2028}\x{2029}\x{202F}\x{205F}\x{1680}\x0b]') then text when regexp_matches(detokenized_content, '[^\s\x{A0}\x{85}\x{2000}-\x{200A}\x{3000}\x{2028}\x{2029}\x{202F}\x{205F}\x{1680}\x0b]') then detokenized_content end t from articles)
      select article_id, sha256(t) as text_hash, length(t) as n_chars from t""",
    "marked_spans_text": """
      with g as (select paragraph_id, quote_index, list_filter(string_split(coalesce(left_context, ''), ' '), lambda w: w <> '') l, list_filter(string_split(coalesce(target_quote, ''), ' '), lambda w: w <> '') t from gold_attributions)
      select paragraph_id, quote_index, array_to_string(list_concat(list_concat(list_concat(l, ['<<']), t), ['>>']), ' ') as marked from g""",
    "encoding_scores": r"""
      with a as (select distinct phase, text, detokenized_content d from articles where text is not null and d is not null), b as (select phase, string_split(text, ' ') g, string_split(d, ' ') d from a), w as (select phase, unnest(g) g, unnest(d) d from b where len(g) = len(d)),
      k as (select *, lower(regexp_replace(d, '[^A-Za-z0-9]', '', 'g')) fd, lower(regexp_replace(g, '[^A-Za-z0-9]', '', 'g')) fg, regexp_matches(d, '[ÃÂâ]') or regexp_matches(d, '^€[œ˜™]') or regexp_matches(d, '^€\p{L}') bad from w)
      select phase, count(*) as n, count(*) filter (not bad and (lower(d) = lower(g) or (fd = fg and fd <> ''))) as matches,
        count(*) filter (contains(d, '?') and not contains(g, '?') and not (d like '%?' and length(d) - length(replace(d, '?', '')) = 1) and fd = fg and regexp_matches(g, '[^\x00-\x7F]')) as smashed from k group by phase""",
    "json_projection": "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events",
}

def _variants_sql() -> str:
    """All forms of an address in their order, each once."""
    part = lambda u, i: f"regexp_extract({u}, '{_URL}', {i})"
    rebuilt = lambda u, scheme=None, net=None: f"{scheme or part(u, 1)} || '://' || {net or part(u, 2)} || {part(u, 3)} || case when {part(u, 4)} <> '' then '?' || {part(u, 4)} else '' end || case when {part(u, 5)} <> '' then '#' || {part(u, 5)} else '' end"
    made = [f"{{'label': '{n}', 'url': {c}}}" for n, c in (("orig", "url"), ("yahoo", "yahoo"), ("embedded", "embedded"), ("no_tracking", "no_tracking"), ("no_query", "no_query"))]
    for n in ("yahoo", "embedded", "no_tracking", "no_query"):
        h = part(n, 2)
        made.append(f"{{'label': '{n}_https', 'url': case when {part(n, 1)} = 'http' then {rebuilt(n, chr(39) + 'https' + chr(39))} end}}")
        made.append(f"{{'label': '{n}_bare', 'url': case when starts_with({h}, 'www.') then {rebuilt(n, net=f'substring({h}, 5)')} end}}")
        made.append(f"{{'label': '{n}_www', 'url': case when not starts_with({h}, 'www.') and contains({h}, '.') then {rebuilt(n, net=f'(' + chr(39) + 'www.' + chr(39) + f' || {h})')} end}}")
    return rf"""
      with u as (select distinct url from articles where url is not null),
      e as (select url, list_filter(list_transform(string_split({part('url', 4)}, '&'), lambda x: trim(url_decode(regexp_extract(x, '^[^=]*=(.*)$', 1)))), lambda v: regexp_matches(v, '^https?://'))[1] embedded,
        case when contains(lower({part('url', 2)}), 'rd.yahoo.com') then regexp_extract(trim(url_decode(regexp_extract(url, '^[^*]*\*(.*)$', 1))), '^https?://.*$') end y0 from u),
      b as (select *, nullif(y0, '') yahoo, coalesce(nullif(y0, ''), embedded, url) base from e), a as (select *, list_filter(string_split({part('base', 4)}, '&'), lambda x: x <> '') a from b),
      t as (select *, list_filter(a, lambda x: lower(split_part(x, '=', 1)) not in ({_TRACKING}) and not starts_with(lower(x), 'utm_')) kept from a),
      n as (select url, yahoo, embedded, case when len(a) > 0 and len(kept) < len(a) then {part('base', 1)} || '://' || {part('base', 2)} || {part('base', 3)} || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end || case when {part('base', 5)} <> '' then '#' || {part('base', 5)} else '' end end no_tracking,
        case when {part('base', 4)} <> '' and regexp_matches({part('base', 3)}, '(?i)(id[A-Z0-9]{{6,}}|\.html(?:$|/)|/\d{{8}}/|/\d{{5,}})') then {part('base', 1)} || '://' || {part('base', 2)} || {part('base', 3)} end no_query from t),
      l as (select url, list_filter([{', '.join(made)}], lambda x: x.url is not null) l from n), k as (select url, list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: y.url), x.url) = i) k from l)
      select url, len(list_filter(k, lambda x: x.label in ('yahoo', 'embedded', 'no_tracking'))) > 0 as material, generate_subscripts(k, 1) - 1 as n, unnest(k).label as label, unnest(k).url as variant from k"""


SQL["url_variants"] = _variants_sql()
SQL["html_as_text"] = r"""
      with d as (select doc_id, '<html><body><p>' || replace(text, chr(10), '</p><p>') || '</p></body></html>' page from documents where text is not null),
      a as (select doc_id, page, regexp_replace(regexp_replace(page, '(?i)</(p|div|li|h[1-6]|blockquote|tr)>|<br\s*/?>', chr(10), 'g'), '(?s)<[^>]*>', '', 'g') x from d),
      b as (select doc_id, page, replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') x from a)
      select doc_id, true as is_html, trim(regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10)) as plain from b"""
SQL["phase_a_text"] = """
      with h as (select quote_id, text, hex(encode(lower(text))) h from quote_candidates)
      select quote_id, case when text is not null then array_to_string(list_transform(range(0, length(h) // 2), lambda i: chr(cast('0x' || substring(h, 2 * i + 1, 2) as int))), '') end as phase_a from h"""
