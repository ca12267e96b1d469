"""Column functions over strings and tokens. Nothing here leaves the JVM; null in, null out unless stated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import UNKNOWN_MARKERS

WORD = r"(?U)\w+"
#: Fixed markers of masked text.
MASK, QUOTE, TARGET_QUOTE = "[MASK]", "[QUOTE]", "[TARGET_QUOTE]"


def collapse_blanks(x: Column) -> Column:
    """Runs of white space as one space, outer ones removed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " "))


def words(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(WORD), F.lit(0))


def word_count(x: Column) -> Column:
    return F.regexp_count(x, F.lit(WORD))


def blank_tokens(x: Column) -> Column:
    """Tokens between single spaces, empty ones kept."""
    return F.split(x, " ", -1)


def compact(x: Column, edge: int = 16, gap: str = "[...]") -> Column:
    """A text of more than 2 * edge tokens as its first and last `edge` ones around a gap mark, else the trimmed text."""
    t = F.split(collapse_blanks(x), " ")
    cut_ = F.concat_ws(" ", F.array_join(F.slice(t, 1, edge), " "), F.lit(gap), F.array_join(F.slice(t, -edge, edge), " "))
    return F.when(x.isNotNull(), F.when(F.size(t) > 2 * edge, cut_).otherwise(F.regexp_replace(x, r"(?U)^\s+|\s+$", "")))


def speaker_tokens(x: Column, titles: Sequence[str]) -> Column:
    """Lower-case ASCII word tokens without outer dots and without titles."""
    t = F.transform(F.regexp_extract_all(x, F.lit(r"[A-Za-z0-9][A-Za-z0-9.'-]*"), F.lit(0)), lambda w: F.trim(F.lower(w), F.lit(".")))
    return F.filter(t, lambda w: ~w.isin(list(titles)))


def is_one_of(tokens: Column, listed: Sequence[str]) -> Column:
    """Whether there is exactly one token and it is listed."""
    return (F.size(tokens) == 1) & F.coalesce(F.get(tokens, 0).isin(list(listed)), F.lit(False))


def fold_key(x: Column) -> Column:
    """ASCII letters and digits only, lower case."""
    return F.lower(F.regexp_replace(x, r"[^A-Za-z0-9]", ""))


def align_key(x: Column) -> Column:
    """fold_key, or the lower-case token where that is empty."""
    return F.coalesce(F.nullif(fold_key(x), F.lit("")), F.lower(x))


def wildcard_match(damaged: Column, candidate: Column) -> Column:
    """Equal fold keys; if `damaged` has question marks, equal texts ignoring case with each standing for one character."""
    pattern = F.replace(F.replace(F.replace(F.replace(F.lower(damaged), F.lit("\\"), F.lit("\\\\")), F.lit("%"), F.lit("\\%")), F.lit("_"), F.lit("\\_")), F.lit("?"), F.lit("_"))
    return F.when(F.contains(damaged, F.lit("?")), F.call_function("like", F.lower(candidate), pattern)).otherwise(fold_key(damaged) == fold_key(candidate))


def fills_encoding(damaged: Column, candidate: Column) -> Column:
    """Same length, at least one question mark, each of them filled by what isn't an ASCII letter or digit, all else equal ignoring case."""
    pairs = F.arrays_zip(F.split(damaged, "").alias("d"), F.split(candidate, "").alias("c"))
    fits = F.forall(pairs, lambda p: F.when(p["d"] == "?", ~p["c"].rlike("^[A-Za-z0-9]$")).otherwise(F.lower(p["d"]) == F.lower(p["c"])))
    return F.contains(damaged, F.lit("?")) & (F.length(damaged) == F.length(candidate)) & fits


def looks_garbled(x: Column) -> Column:
    """Letters that UTF-8 read as Windows-1252 shows, or a euro sign that begins a word."""
    return x.rlike("[ÃÂâ]") | x.rlike("^€[œ˜™]") | x.rlike(r"^€\p{L}")


def needs_repair(x: Column) -> Column:
    return F.contains(x, F.lit("?")) | looks_garbled(x)


def project_surface(damaged: Column, gold: Column) -> Column:
    """Token arrays: gold's token where the align keys agree, else the damaged one; over the shorter length."""
    n = F.least(F.size(damaged), F.size(gold))
    return F.slice(F.zip_with(damaged, gold, lambda d, g: F.when(align_key(d) == align_key(g), g).otherwise(d)), 1, F.greatest(n, F.lit(0)))


def sentence_truecase(x: Column) -> Column:
    """First letter of the text, and of what follows . ! or ?, in upper case; no other character changes."""
    first = r"(?s)^(\P{L}*)(\p{L}?)(.*)$"
    part = lambda p, i: F.regexp_extract(p, first, i)
    return F.array_join(F.transform(F.split(x, r"(?<=[.!?])", -1), lambda p: F.concat(part(p, 1), F.upper(part(p, 2)), part(p, 3))), "")


def majority(candidates: Column) -> Column:
    """The first of the most frequent elements if one occurs at least twice, else the first; null for an empty array."""
    counted = F.transform(F.array_distinct(candidates), lambda c: F.struct(F.size(F.filter(candidates, lambda x: x == c)).alias("n"), (-F.array_position(candidates, c)).alias("at"), c.alias("value")))
    return F.array_max(counted)["value"]


def all_lower(x: Column) -> Column:
    """Null and empty count as lower case; markers are ignored; at least one letter is needed otherwise."""
    t = F.regexp_replace(x, r"\[(MASK|QUOTE|TARGET_QUOTE)\]", "")
    return F.when(F.coalesce(x, F.lit("")) == "", F.lit(True)).otherwise((t == F.lower(t)) & t.rlike(r"\p{L}"))


def equals_lower(x: Column) -> Column:
    """Whether the text is its own lower case; null counts so."""
    return F.coalesce(x == F.lower(x), F.lit(True))


def rebuild_brackets(x: Column) -> Column:
    """Tokens `[ X ]` joined to `[X]`."""
    return F.regexp_replace(x, r"\[ (.*?) \]", "[$1]")


def drop_punctuation(tokens: Column) -> Column:
    """Without tokens of punctuation only and the clitics 's s' n't; bracketed markers stay."""
    return F.filter(tokens, lambda t: t.rlike(r"^\[.*\]$") | (~t.rlike(r"^\p{Punct}*\z") & ~F.lower(t).isin("'s", "s'", "n't")))


def split_hyphens(x: Column) -> Column:
    """Hyphens between word characters as spaces, initials without their dot."""
    return F.regexp_replace(F.regexp_replace(x, r"(?U)(?<=\w)-(?=\w)", " "), r"\b([A-Z])\.", "$1 ")


def mention_form(surface: Column, pronouns: Sequence[str]) -> Column:
    """pronoun if listed, nominal if it begins with an article, else proper."""
    t = F.lower(F.trim(surface))
    return F.when(t.isin(list(pronouns)), "pronoun").when(t.rlike("^(the|an?) "), "nominal").when(t.isNotNull(), "proper")


def minimal_person(surface: Column) -> Column:
    """A name without one title before it."""
    return F.regexp_replace(F.trim(surface), r"(?i)^(mr|mrs|ms|miss|dr|prof|sir|dame|lord|lady|president|senator|sen|rep|gov|judge|minister|captain)\.?\s+", "")


def normal_answer(x: Column, unknown: Sequence[str] = UNKNOWN_MARKERS) -> Column:
    """Lower case, blanks collapsed, outer punctuation removed; markers of no answer become empty."""
    t = F.lower(F.regexp_replace(F.trim(F.regexp_replace(x, r"(?U)\s+", " ")), r"""^[ "'`.,:;!?()\[\]{}]+|[ "'`.,:;!?()\[\]{}]+$""", ""))
    return F.when(F.lower(F.trim(x)).isin(list(unknown)), F.lit("")).otherwise(t)


def alnum_tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit(r"[a-z0-9]+(?:'[a-z0-9]+)?"), F.lit(0))


def edge_words(x: Column, n: int, first: bool) -> Column:
    """The first or last n of the words and single punctuation marks."""
    t = F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"(?U)\w+|[^\w\s]"), F.lit(0))
    return F.array_join(F.slice(t, 1, n) if first else F.when(F.size(t) > n, F.slice(t, -n, n)).otherwise(t), " ")


def proper_names(x: Column, stop: Sequence[str]) -> Column:
    """Runs of one to four capitalised words, without listed ones."""
    return F.filter(F.regexp_extract_all(x, F.lit(r"\b[A-Z][a-z]+(?: [A-Z][a-z]+){0,3}\b"), F.lit(0)), lambda n: ~F.lower(n).isin([s.lower() for s in stop]))


def mark_span(tokens: Column, start: Column, end: Column, opening: str = "<<", closing: str = ">>") -> Column:
    """Tokens joined by blanks, with marks around [start, end)."""
    n = F.size(tokens)
    part = lambda a, b: F.slice(tokens, a + 1, F.greatest(b - a, F.lit(0)))
    return F.array_join(F.concat(part(F.lit(0), start), F.array(F.lit(opening)), part(start, end), F.array(F.lit(closing)), part(end, n)), " ")


def nearest_verb(left: Column, right: Column, verbs: Sequence[str], radius: int = 35) -> Column:
    """The last listed verb among the left text's last tokens, else the first among the right one's first; null without."""
    pattern = F.lit(r"(?i)\b(" + "|".join(verbs) + r")\b")
    found = lambda t: F.regexp_extract_all(t, pattern, F.lit(1))
    l_, r_ = found(edge_words(left, radius, False)), found(edge_words(right, radius, True))
    return F.lower(F.coalesce(F.try_element_at(l_, F.lit(-1)), F.try_element_at(r_, F.lit(1))))


def unwrap_json(x: Column) -> Column:
    """The first JSON object of an answer, without a code fence around it; null if there is none."""
    t = F.regexp_replace(x, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")
    return F.nullif(F.regexp_extract(t, r"(?s)(\{.*\})", 1), F.lit(""))


# Phases: how the corpus's five periods damaged their text.


def phase_text(x: Column, phase: str) -> Column:
    """A text as a phase shows it.

    A: lower case, UTF-8 read as Latin-1. B: lower case, code points from 256 as "?". C: lower case, from 128 as "?".
    D: from 128 as "?". Any other: unchanged.
    """
    if phase == "A":
        return F.decode(F.encode(F.lower(x), "UTF-8"), "ISO-8859-1")
    if phase == "B":
        return F.regexp_replace(F.lower(x), r"[^\x00-\xFF]", "?")
    if phase == "C":
        return F.regexp_replace(F.lower(x), r"[^\x00-\x7F]", "?")
    return F.regexp_replace(x, r"[^\x00-\x7F]", "?") if phase == "D" else x


def phase_text_by(x: Column, phase: Column) -> Column:
    """phase_text with the phase in a column."""
    out = F.when(phase == "A", phase_text(x, "A"))
    for p in "BCD":
        out = out.when(phase == p, phase_text(x, p))
    return out.otherwise(x)


def phase_aliases(aliases: Column, phase: str) -> Column:
    return F.transform(aliases, lambda a: phase_text(a, phase))


def ascii_aliases(aliases: Column) -> Column:
    """Lower-case aliases, then the same with all but ASCII as "?"."""
    return F.concat(F.transform(aliases, lambda a: F.lower(a)), F.transform(aliases, lambda a: phase_text(a, "C")))


def label_aliases(label: Column, aliases: Column) -> Column:
    """The label, unless null, before the aliases."""
    return F.when(label.isNull(), aliases).otherwise(F.concat(F.array(label), aliases))


def gender(values: Column) -> Column:
    """Null for none, Other for several; the items of male and female by name, else Other."""
    return F.when(F.size(values) == 0, F.lit(None).cast("string")).when(F.size(values) > 1, "Other").when(F.get(values, 0) == "Q6581097", "Male").when(F.get(values, 0) == "Q6581072", "Female").otherwise("Other")


#: Fixed: last day of each phase but the last, first and last day of the corpus.
PHASES = (("A", "2008-09-01", "2010-07-13"), ("B", "2010-07-14", "2010-07-26"), ("C", "2010-07-27", "2013-04-28"), ("D", "2013-04-29", "2014-05-21"), ("E", "2014-05-22", "2020-04-30"))


def phase_of_date(date: Column) -> Column:
    """The phase of an ISO date or timestamp string, by its first ten characters; null outside all phases."""
    d = F.left(date, F.lit(10))
    out = F.when(F.length(d) < 10, F.lit(None).cast("string"))
    for name, first, last in PHASES:
        out = out.when(d.between(first, last), name)
    return out


def wayback_stamp(date: Column) -> Column:
    """Digits of a date padded to fourteen, the form of archive time stamps."""
    return F.left(F.concat(F.regexp_replace(date, "[^0-9]", ""), F.lit("0101000000")), F.lit(14))
