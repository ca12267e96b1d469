"""The merge rules as SQL text: pair decisions, blocks, roles, filters and attribution over the tables' quotations."""

from __future__ import annotations

from ..functions.fixed import (
    ABBREVIATIONS, BACKGROUND, BOILERPLATE, FORWARD, INSTITUTION, NAMED_NEXT, NEW_SPEAKER, PERSON, PRONOUNS, REPLY, SWITCH, TITLES, VERBS,
)

BLANKS = r"[\s\x0b\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
WORD = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}]+"


def text(pattern: str) -> str:
    """A pattern as an SQL literal."""
    return "'" + pattern.replace("'", "''") + "'"


def listed(words: list[str]) -> str:
    return ", ".join(text(w) for w in words)


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {text('(?i)' + pattern)})"


def count(x: str) -> str:
    return f"len(regexp_extract_all({x}, {text(WORD)}))"


_VERBS = "|".join(VERBS)
_VERB = rf"\b({_VERBS})\b"
#: The pattern's look-ahead is left out: a sentence that begins with one of its words is broken up before.
_NAMED = NAMED_NEXT.replace(r"(?!(?:The|This|That)\b)", "")


def speaker(name: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all(coalesce({name}, ''), '[A-Za-z0-9][A-Za-z0-9.''-]*'), lambda w: trim(lower(w), '.')), lambda w: w not in ({listed(TITLES)}))"


def decided(bridged: str) -> str:
    """CTEs up to d: one row per pair of adjacent quotations with the decision."""
    return rf"""{bridged},
    p0 as (select article_id, idx, quote_id, text, speaker, speaker_qid, speaker_probability sp, mentioned_entities me, coalesce(bridge_after, '') bridge, lead(quote_id) over w nid, lead(text) over w nt, lead(speaker) over w ns,
      lead(speaker_qid) over w nq, lead(speaker_probability) over w np, lead(mentioned_entities) over w nme, lead(idx) over w nx from b window w as (partition by article_id order by idx)),
    p1 as (select *, trim(regexp_replace(bridge, {text(BLANKS)}, ' ', 'g')) n, {speaker('speaker')} ta, {speaker('ns')} tb,
      coalesce(speaker_qid, '') <> '' and coalesce(sp, 0) >= 0.6 and coalesce(nq, '') <> '' and coalesce(np, 0) >= 0.6 known, coalesce(speaker, '') <> '' and coalesce(ns, '') <> '' named from p0 where nx is not null),
    p2 as (select *, trim(n, '"'' ') b0, trim(n, '"“”‘’''` ') b1, len(ta) = 1 and ta[1] in ({listed(PRONOUNS)}) pa, len(tb) = 1 and tb[1] in ({listed(PRONOUNS)}) pb from p1),
    p3 as (select *, regexp_replace(regexp_replace(b0, {text(r'(?i)\b(?:' + '|'.join(ABBREVIATIONS) + r')\.')}, '#', 'g'), {text(r'(?i)([.!?]\s+)((?:the|this|that)\b)')}, '\1#\2', 'g') bn,
      regexp_replace(b0, {text(r'(?i)(\b(?:who|which|that)\s+(?:(?:had|has|have|also)\s+)?)(?:' + _VERBS + r')\b')}, '\1xx', 'g') hidden, {count('n')} wn,
      case when known then speaker_qid = nq else named and len(ta) > 0 and len(tb) > 0 and (ta = tb or coalesce(not pa and not pb and ta[-1] = tb[-1] and (len(ta) = 1 or len(tb) = 1), false)) end same from p2),
    p4 as (select *, (known and speaker_qid <> nq) or (named and not coalesce(pa, false) and not coalesce(pb, false) and not same) diff, {has('n', BOILERPLATE)} boiler, n <> '' and wn <= 45 and {has('n', _VERB)} short,
      {has('b0', SWITCH)} or {has('b0', NEW_SPEAKER)} or {has('bn', _NAMED)} or {has('b0', FORWARD)} or {has('b0', REPLY)} or ({has('b0', BACKGROUND)} and {has('b0', _VERB)}) switch,
      regexp_matches(b1, {text(PERSON)}) person, regexp_extract(hidden, {text('(?is)^(.*?)' + _VERB)}, 1) before, {has("coalesce(text, '')", BOILERPLATE)} lb, {has("coalesce(nt, '')", BOILERPLATE)} rb from p3),
    p5 as (select *, b1 <> '' and {count('b1')} <= 35 and not person and {has('b1', INSTITUTION)} inst,
      b0 <> '' and {count('b0')} <= 35 and not switch and len(regexp_extract_all(hidden, {text('(?i)' + _VERB)})) = 1 and ({count('before')} <= 6 or (contains(before, ',') and {count('before')} <= 24)) local from p4),
    p6 as (select *, case when length(n) > 300 then 1 when contains(bridge, chr(10) || chr(10)) and not short then 2 when boiler then 3 when inst then 3 when diff then 4 when not same and switch then 5 when wn > 90 and not short then 1
      when n <> '' and not regexp_matches(n, '[A-Za-z0-9]') then 6 when same and wn <= 60 then 7 when local and (same or person) then 8 else 9 end rule from p5),
    d as (select article_id, idx, quote_id, nid next_quote_id, me, nme, n, case when rule in (6, 7, 8) then 'yes' else 'no' end as merge,
      case when rule = 3 or boiler or lb or (not rb and inst) then 'non_quote' else 'utterance' end left_role, case when rule = 3 or boiler or (not lb and (rb or inst)) then 'non_quote' else 'utterance' end right_role,
      case when rule in (6, 7, 8) then 'same' when rule in (2, 4, 5) then 'different' else 'unknown' end continuity,
      ['too_distant', 'article_boundary', 'non_quote', 'different_speakers', 'explicit_speaker_switch', 'continued_news_quote', 'same_speaker', 'same_attribution_clause', 'ambiguous'][rule] reason from p6)"""


def blocked(bridged: str) -> str:
    """decided() and k: the quotations with their block."""
    return rf"""{decided(bridged)},
    k0 as (select b.*, case when d.merge = 'yes' then 0 else 1 end brk from b left join d on d.article_id = b.article_id and d.idx = b.idx - 1),
    k as (select *, sum(brk) over (partition by article_id order by idx rows unbounded preceding) block_id from k0)"""


def merged(bridged: str) -> str:
    """The blocks with texts, roles, filters and attribution."""
    n = f"trim(regexp_replace(coalesce(bridge_after, ''), {text(BLANKS)}, ' ', 'g'))"
    b1 = f"trim({n}, '\"“”‘’''` ')"
    person = f"regexp_matches({b1}, {text(PERSON)})"
    institution = f"({b1} <> '' and {count(b1)} <= 35 and not {person} and {has(b1, INSTITUTION)})"
    return rf"""with {blocked(bridged)},
    last as (select *, max(idx) over (partition by article_id, block_id) li from k),
    t as (select article_id, block_id, min(idx) first_idx, count(*) n_quotes, string_agg(coalesce(text, ''), ' ' order by idx) quote_text, string_agg(coalesce(text, '') || case when idx < li then coalesce(bridge_after, '') else '' end, '' order by idx) raw_text,
      bool_or(coalesce(speaker_qid, '') <> '' or trim(coalesce(speaker, '')) <> '' or ({person} and not {institution})) has_speaker,
      arg_min(speaker, idx) filter (coalesce(speaker, '') <> '') ps, arg_min(speaker_qid, idx) filter (coalesce(speaker_qid, '') <> '') pq, coalesce(max(speaker_probability), 0) pp from last group by 1, 2),
    r0 as (select k.article_id, block_id, arg_max(right_role, k.idx) right_role, bool_and(coalesce(right_role = 'non_quote', false)) alln from k left join d using (article_id, idx) group by 1, 2),
    r as (select t.article_id, t.block_id, coalesce(d.left_role, 'utterance') left_role, coalesce(r0.right_role, 'utterance') right_role, coalesce(d.left_role = 'non_quote', false) and alln is_non_quote
      from t join r0 using (article_id, block_id) left join d on d.article_id = t.article_id and d.idx + 1 = t.first_idx),
    m as (select article_id, block_id, count(*) > 0 hm from (select article_id, block_id, unnest(mentioned_entities) m from k) where m is not null group by 1, 2),
    c as (select article_id, block_id, idx, unnest(local_probas) c, generate_subscripts(local_probas, 1) pos from k),
    s as (select article_id, block_id, coalesce(c.speaker, '') speaker, c.qid qid, round(sum(c.probability), 9) pr, min(idx * 1000000 + pos) f from c where coalesce(c.qid, '') <> '' group by all),
    best as (select * from s qualify row_number() over (partition by article_id, block_id order by pr desc, f) = 1)
    select t.article_id, cast(t.block_id as bigint) block_id, first_idx, n_quotes, quote_text, raw_text, r.left_role, r.right_role, r.is_non_quote, coalesce(m.hm, false) has_mention, has_speaker,
      coalesce(m.hm, false) and has_speaker and not r.is_non_quote as passes, case when best.qid is not null then best.speaker else ps end speaker, coalesce(best.qid, pq) qid,
      round(case when best.qid is not null then pr else pp end, 6) probability
    from t join r using (article_id, block_id) left join m using (article_id, block_id) left join best using (article_id, block_id)"""


def split_recovery(bridged: str) -> str:
    return f"""with {blocked(bridged)}, g as (select article_id, block_id, count(*) n, count(*) filter (len(coalesce(mentioned_entities, [])) > 0) w from k group by 1, 2)
      select count(*) blocks, count(*) filter (n > 1) merged_blocks, count(*) filter (n > 1 and w > 0 and w < n) split_blocks, cast(coalesce(sum(n - w) filter (w > 0), 0) as bigint) recovered_quotes from g"""


def dev_set(bridged: str, quotas: dict[str, int], seed: str) -> str:
    limit = " ".join(f"when '{k}' then {n}" for k, n in quotas.items())
    return f"""with {decided(bridged)}, m as (select quote_id, min(mentioned_entities) m from q group by 1),
      k as (select d.quote_id || '-' || next_quote_id as key, d.merge, d.reason, case when reason = 'ambiguous' then 'ambiguous' when merge = 'yes' then 'hard_merge' else 'hard_no_merge' end bucket from d)
      select key, bucket, merge, reason from k qualify row_number() over (partition by bucket order by md5(key || '{seed}'), key) <= case bucket {limit} else 0 end"""
