"""Column functions that turn tokenised dump text into readable text, and names in it into candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse_blanks, fold_key, looks_garbled, normal_answer

# fixed values
DELIMITERS = r"(?i)(``|''|</blockquote>|<blockquote[^>]*>|\\endblockquote|\\blockquote)"
OPENING, CLOSING = r"(?i)^(``|\\blockquote|<blockquote[^>]*>)$", r"(?i)^(''|</blockquote>|\\endblockquote)$"
# fixed values: what page converters leave behind
SCRIPT_REST = r"(?is)(?:var\s+\w+\s*=\s*escape\s*\([^;]{0,500}\)\s*;?)|(?:openwin\s*\([^)]{0,300}\)\s*;?)|(?:document\.write\s*\([^)]{0,200}\)\s*;?)|(?:navigator\.\w+(?:\.\w+)*)|(?:\{\*\s*[^*]*\*\})"
SPACED_TAG = r"""(?i)<\s*/?\s*[a-z][a-z0-9]*\b(?:\s+\w+\s*=\s*"[^"]*")*\s*/?\s*>"""
PAGE_HEAD = r"(?is)^(?:your browser's security settings are preventing some features from appearing\.\s*|your browser does not support iframes\.\s*)+"
PAGE_FOOT = r"(?is)\s*(?:share this:.*|click to share on .*|you must fill out the comment body in order to submit a comment\.?)\s*$"
HONORIFICS = "mr mrs ms miss dr prof sir dame lord lady rev hon".split()
ROLE_BEFORE = r"(?i)^(?:(?:Mr|Mrs|Ms|Miss|Dr|Prof|Professor|Rep|Representative|Sen|Senator|Gov|Governor|President|Prime\s+Minister|Minister|Secretary|Deputy|Chief|Officer|Attorney|Lawyer|Judge|Justice|Sir|Dame|Lord|Lady)\.?\s+)+"
ROLE_WORDS = "leader minister secretary attorney lawyer chairman chairwoman chief shadow employment conservative labour democrat republican".split()


def split_delimiters(tokens: Column) -> Column:
    """Tokens with quotation delimiters parted from what they are glued to."""
    return F.filter(F.flatten(F.transform(tokens, lambda t: F.split(F.regexp_replace(t, DELIMITERS, "\u0001$1\u0001"), "\u0001"))), lambda t: t != "")


def curly_marks(tokens: Column) -> Column:
    """Delimiter tokens as “ and ”."""
    return F.transform(split_delimiters(tokens), lambda t: F.when(t.rlike(OPENING), "“").when(t.rlike(CLOSING), "”").otherwise(t))


def possessive_outside(text: Column) -> Column:
    """A possessive before the mark that closes an open quotation, after that mark: “ the world 's ” as “ the world ” 's.

    The quotation may hold further, closed quotations.
    """
    return F.regexp_replace(text, r"(“[^“”]*(?:“[^“”]*”[^“”]*)*) 's ”", "$1 ” 's")


def detokenised(tokens: Column) -> Column:
    """Tokens as running text: clitics and punctuation joined to what they belong to. Approximate: rules, not a trained detokeniser."""
    x = possessive_outside(F.array_join(curly_marks(tokens), " "))
    for pattern, to in ((r" (n't|'(?:s|re|ve|ll|d|m))\b", "$1"), (r" ([.,;:!?%…)\]}]+)", "$1"), (r"([(\[{]) ", "$1"), (r"\s+”", "”"), (r"“\s+", "“")):
        x = F.regexp_replace(x, pattern, to)
    return x


def clean_dump(text: Column) -> Column:
    """Readable text of a tokenised page: garbled marks rejoined, detokenised, without script rests, tags and page furniture.

    Empty for null and blank. Question marks inside words are repaired before, by restore.apply_repairs, as they need
    the corpus's lexicon.
    """
    from ..operators.restore import rejoin_garbled

    x = detokenised(F.split(collapse_blanks(rejoin_garbled(F.coalesce(text, F.lit("")))), " "))
    x = F.regexp_replace(F.regexp_replace(x, SCRIPT_REST, " "), SPACED_TAG, " ")
    return collapse_blanks(F.regexp_replace(F.regexp_replace(F.trim(x), PAGE_HEAD, ""), PAGE_FOOT, ""))


def split_punctuation(tokens: Column) -> Column:
    """Leading punctuation dropped, one trailing mark and possessives parted, honorifics dropped; bracketed markers stay."""
    bare = F.transform(tokens, lambda t: F.when(t.rlike(r"^\[.*\]$"), t).otherwise(F.regexp_replace(t, r"^\p{Punct}+", "")))
    kept = F.filter(bare, lambda t: (t != "") & ~F.regexp_replace(F.lower(t), r"\.+$", "").isin(HONORIFICS))

    def parts(t: Column) -> Column:
        pair = lambda a, b: F.filter(F.array(a, b), lambda x: x != "")
        head = lambda n: F.substring(t, F.lit(1), F.length(t) - n)
        return F.when(t.rlike(r"^\[.*\]$"), F.array(t)).when(t.endswith("s'"), pair(head(1), F.lit("'"))).when(t.rlike(r"\p{Punct}$"), pair(head(1), F.right(t, F.lit(1)))).when(t.endswith("'s"), pair(head(2), F.lit("'s"))).otherwise(F.array(t))

    return F.flatten(F.transform(kept, parts))


def canonical_candidate(x: Column) -> Column:
    """A name without outer punctuation, apposition, possessor and roles; of a longer one with role words the last two capitalised words."""
    edge = r"""^[ "'`.,:;!?()\[\]{}]+|[ "'`.,:;!?()\[\]{}]+$"""
    c = F.regexp_replace(collapse_blanks(x), edge, "")
    c = F.trim(F.substring_index(c, ",", 1))
    c = F.trim(F.regexp_replace(F.regexp_replace(c, r"^[A-Z][A-Za-z]+ '?s\s+", ""), ROLE_BEFORE, ""))
    words = F.split(c, " ")
    capital = F.filter(words, lambda w: w.rlike(r"^(?:[A-Z]\.?|[A-Z][A-Za-z.'-]*)$"))
    roles = F.exists(words, lambda w: F.lower(F.regexp_replace(w, r"^\.+|\.+$", "")).isin(ROLE_WORDS))
    short = F.when((F.size(words) > 2) & roles & (F.size(capital) >= 2), F.array_join(F.slice(capital, -2, 2), " ")).otherwise(c)
    return F.regexp_replace(short, edge, "")


def speaker_candidates(text: Column, pronouns: Sequence[str], limit: int = 24) -> Column:
    """Names in a text and their canonical forms, each normal form once, pronouns left out, at most `limit`."""
    found = F.regexp_extract_all(text, F.lit(r"\b(?:(?:Mr|Mrs|Ms|Miss|Dr|Prof|Professor|Rep|Sen|Senator|Gov|Governor|President|Minister|Secretary|Chief|Judge|Justice)\.?\s+)?[A-Z][A-Za-z.'-]*(?:\s+[A-Z][A-Za-z.'-]*){0,4}"), F.lit(0))
    kept = F.filter(found, lambda m: ~m.isin("The", "This", "That", "While", "If", "But"))
    both = F.flatten(F.transform(kept, lambda m: F.array(m, canonical_candidate(m))))
    named = F.filter(both, lambda m: (m != "") & ~F.lower(m).isin(list(pronouns)))
    keys = F.transform(named, lambda m: normal_answer(m))
    return F.slice(F.filter(named, lambda m, i: F.array_position(keys, normal_answer(m)) == i + 1), 1, limit)


def is_name_smash(damaged: Column, gold: Column) -> Column:
    """Whether question marks stand for a name's non-ASCII letters; one at the end may be a real question."""
    q = F.contains(damaged, F.lit("?")) & ~F.contains(gold, F.lit("?"))
    end = damaged.endswith("?") & (F.length(damaged) - F.length(F.replace(damaged, F.lit("?"), F.lit(""))) == 1)
    return q & ~end & (fold_key(damaged) == fold_key(gold)) & gold.rlike(r"[^\x00-\x7F]")


def encoding_match(predicted: Column, gold: Column) -> Column:
    """The same word ignoring case or by fold key, with no garbling left."""
    return ~looks_garbled(predicted) & ((F.lower(predicted) == F.lower(gold)) | ((fold_key(predicted) == fold_key(gold)) & (fold_key(predicted) != "")))


def dev_bucket(merge: Column, reason: Column, bridge_mentions: Column, left_mentions: Column, right_mentions: Column) -> Column:
    """bridge_only, ambiguous, hard_merge or hard_no_merge, for drawing a balanced development set of pairs."""
    some = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0
    return F.when(some(bridge_mentions) & ~some(left_mentions) & ~some(right_mentions), "bridge_only").when(reason == "ambiguous", "ambiguous").when(merge == "yes", "hard_merge").otherwise("hard_no_merge")
