"""Annotation documents: normalisation, checks, states, merging of saved work, suggestions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nested import first_nonblank
from ..functions.text import minimal_person, proper_names
from .quotes import mark_spans

SENTIMENTS = ("positive", "negative", "mixed", "neutral", "not_about")
SPAN = "struct<start int, end int, surface string>"
#: One quotation of a record, with everything an annotator may set.
QUOTE = (
    "struct<id string, status string, reject_reason string, inner_start int, inner_end int, outer_start int, outer_end int, delimiter string, text string, "
    f"speaker struct<status string, start int, end int, surface string, qid string, nil boolean, first_span {SPAN}>, quotative struct<status string, start int, end int, surface string>, "
    f"mentions array<struct<id string, start int, end int, surface string, qid string, nil boolean, sentiment string, first_span {SPAN}>>, segments array<struct<inner_start int, inner_end int, outer_start int, outer_end int>>, notes string>"
)
RECORD = f"struct<article_id string, annotator string, text string, text_hash string, skipped boolean, notes string, quotes array<{QUOTE}>>"


def article_text(*columns: Column) -> Column:
    """The first text that isn't blank, as it stands."""
    return first_nonblank(*columns)


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def new_quotes(articles: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, text_hash, quotes): records' quotations found by their marks, pending, with empty speaker, quotative and mentions."""
    spans = mark_spans(articles, id_col, text).withColumn("qid", F.concat(F.col(id_col).cast("string"), F.lit("-q"), (F.col("n") + 1).cast("string")))
    q = spans.select(id_col, F.struct("n", "qid", "inner_start", "inner_end", "outer_start", "outer_end", "delimiter", "text").alias("q")).groupBy(id_col).agg(F.array_sort(F.collect_list("q")).alias("q"))
    full = f"transform(q, x -> named_struct('id', x.qid, 'status', 'pending', 'reject_reason', cast(null as string), 'inner_start', x.inner_start, 'inner_end', x.inner_end, 'outer_start', x.outer_start, 'outer_end', x.outer_end, 'delimiter', x.delimiter, 'text', x.text, 'speaker', from_json('{{\"status\":\"unset\"}}', 'status string, start int, end int, surface string, qid string, nil boolean, first_span {SPAN}'), 'quotative', from_json('{{\"status\":\"unset\"}}', 'status string, start int, end int, surface string'), 'mentions', cast(array() as array<struct<id string, start int, end int, surface string, qid string, nil boolean, sentiment string, first_span {SPAN}>>), 'segments', cast(array() as array<struct<inner_start int, inner_end int, outer_start int, outer_end int>>), 'notes', ''))"
    rows = articles.select(id_col, text_hash(F.col(text)).alias("text_hash")).join(q, id_col, "left")
    return rows.select(id_col, "text_hash", F.coalesce(F.expr(full), F.expr(f"cast(array() as array<{QUOTE}>)")).alias("quotes"))


def span_set(span: Column) -> Column:
    return F.coalesce(span["start"].isNotNull() & span["end"].isNotNull(), F.lit(False))


def quote_complete(q: Column) -> Column:
    """Rejected, or decided with linked or marked-as-nil speaker and mentions, their first spans, and a quotative."""
    known = lambda x: F.coalesce(x["nil"], F.lit(False)) | (F.coalesce(x["qid"], F.lit("")) != "")
    s, v = q["speaker"], q["quotative"]
    speaker = F.when(s["status"] == "identified", s["start"].isNotNull() & s["end"].isNotNull() & known(s) & span_set(s["first_span"])).otherwise(F.coalesce(s["status"], F.lit("")) != "unset")
    verb = F.coalesce(v["status"].isin("implicit", "none"), F.lit(False)) | F.coalesce((v["status"] == "present") & v["start"].isNotNull() & v["end"].isNotNull(), F.lit(False))
    named = F.forall(F.coalesce(q["mentions"], F.array()), lambda m: F.coalesce(m["sentiment"].isin(*SENTIMENTS), F.lit(False)) & known(m) & span_set(m["first_span"]))
    return F.when(q["status"] == "reject", True).when(q["status"] == "pending", False).otherwise(speaker & verb & named)


def quote_touched(q: Column) -> Column:
    return F.coalesce(q["status"] != "pending", F.lit(False)) | F.coalesce(q["speaker"]["status"] != "unset", F.lit(False)) | (F.size(F.coalesce(q["mentions"], F.array())) > 0) | F.coalesce(~q["quotative"]["status"].isin("unset", ""), F.lit(False))


def record_status(skipped: Column, quotes: Column) -> Column:
    """skipped, done (nothing to do, or all complete), new (nothing touched) or in_progress."""
    q = F.coalesce(quotes, F.array())
    return F.when(F.coalesce(skipped, F.lit(False)), "skipped").when(F.size(q) == 0, "done").when(~F.exists(q, quote_touched), "new").when(F.forall(q, quote_complete), "done").otherwise("in_progress")


def quote_errors(q: Column, n: Column) -> Column:
    """Problems of a quotation in a text of n characters, as an array of strings; empty if well formed."""
    order = (q["outer_start"] >= 0) & (q["outer_start"] <= q["inner_start"]) & (q["inner_start"] <= q["inner_end"]) & (q["inner_end"] <= q["outer_end"]) & (q["outer_end"] <= n)
    missing = q["inner_start"].isNull() | q["inner_end"].isNull() | q["outer_start"].isNull() | q["outer_end"].isNull()
    out_of = lambda s: ~F.coalesce((s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= n), F.lit(False))
    s, v = q["speaker"], q["quotative"]
    lone = lambda x: x["start"].isNull() != x["end"].isNull()
    say = lambda c, t: F.when(F.coalesce(c, F.lit(False)), F.concat(F.coalesce(q["id"], F.lit("?")), F.lit(": " + t)))
    segments = F.coalesce(q["segments"], F.array())
    good = lambda g: (g["outer_start"] >= 0) & (g["outer_start"] <= g["inner_start"]) & (g["inner_start"] <= g["inner_end"]) & (g["inner_end"] <= g["outer_end"]) & (g["outer_end"] <= n)
    within = lambda m: F.when(F.size(segments) > 0, F.exists(segments, lambda g: (g["inner_start"] <= m["start"]) & (m["end"] <= g["inner_end"]))).otherwise((q["inner_start"] <= m["start"]) & (m["end"] <= q["inner_end"]))
    mentions = F.coalesce(q["mentions"], F.array())
    bad_mention = F.exists(mentions, lambda m: ~F.coalesce(within(m) & (m["start"] < m["end"]), F.lit(False)))
    rest = F.array(
        say(~order, "quote offsets out of range"), say(F.exists(segments, lambda g: ~F.coalesce(good(g), F.lit(False))), "segment offsets out of range"), say(lone(s["first_span"]), "first speaker span incomplete"),
        say((s["status"] == "identified") & s["start"].isNotNull() & s["end"].isNotNull() & out_of(s), "speaker span out of range"), say((v["status"] == "present") & out_of(v), "quotative span out of range"), say(bad_mention, "mention must lie inside the quote"),
    )
    return F.when(missing, F.array(F.concat(F.coalesce(q["id"], F.lit("?")), F.lit(": missing quote offsets")))).otherwise(F.array_compact(rest))


def record_errors(records: DataFrame) -> DataFrame:
    """(article_id, annotator, errors) of all records."""
    n = F.length(F.coalesce("text", F.lit("")))
    return records.select("article_id", "annotator", F.flatten(F.transform(F.coalesce("quotes", F.array()), lambda q: quote_errors(q, n))).alias("errors"))


def batch_status(records: DataFrame) -> DataFrame:
    """(article_id, annotator, n_quotes, n_done, status) for listing a batch."""
    q = F.coalesce("quotes", F.array())
    return records.select("article_id", "annotator", F.size(q).alias("n_quotes"), F.size(F.filter(q, quote_complete)).alias("n_done"), record_status(F.col("skipped"), F.col("quotes")).alias("status"))


def with_defaults(quotes: Column) -> Column:
    """Quotations with a pending status, empty lists and notes where null, and quotative none written as implicit."""

    def fill(q: Column) -> Column:
        verb = q["quotative"].withField("status", F.when(q["quotative"]["status"] == "none", "implicit").otherwise(q["quotative"]["status"]))
        return q.withField("status", F.coalesce(q["status"], F.lit("pending"))).withField("notes", F.coalesce(q["notes"], F.lit(""))).withField("mentions", F.coalesce(q["mentions"], F.array())).withField("quotative", verb)

    return F.transform(F.coalesce(quotes, F.array()), fill)


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (b_start < a_end)


def union_saved(saved: Column, found: Column) -> Column:
    """Saved quotations, then those found that overlap no quotation accepted before them; from the left, by outer range."""

    def ranges(q: Column) -> Column:
        return F.when(F.size(F.coalesce(q["segments"], F.array())) > 0, F.transform(q["segments"], lambda g: F.struct(g["outer_start"].alias("s"), g["outer_end"].alias("e")))).otherwise(F.array(F.struct(q["outer_start"].alias("s"), q["outer_end"].alias("e"))))

    def clash(a: Column, b: Column) -> Column:
        return F.exists(ranges(a), lambda x: F.exists(ranges(b), lambda y: overlaps(x["s"], x["e"], y["s"], y["e"])))

    return F.aggregate(found, saved, lambda kept, q: F.when(F.exists(kept, lambda k: clash(k, q)), kept).otherwise(F.array_append(kept, q)))


def merge_saved(fresh: DataFrame, saved: DataFrame) -> DataFrame:
    """fresh records (article_id, text_hash, quotes) with the saved work of one annotator: quotations only if the text is unchanged."""
    s = saved.select("article_id", F.col("text_hash").alias("_h"), F.col("quotes").alias("_q"), "skipped", "notes")
    rows = fresh.join(s, "article_id", "left")
    same = F.coalesce(F.col("_h") == F.col("text_hash"), F.lit(False))
    return rows.withColumn("quotes", F.when(same, union_saved(with_defaults(F.col("_q")), F.col("quotes"))).otherwise(F.col("quotes"))).drop("_h", "_q")


def next_quote_id(article_id: Column, quotes: Column) -> Column:
    """The article's id, -q, and one more than the greatest number of its quotations' ids."""
    numbers = F.transform(F.coalesce(quotes, F.array()), lambda q: F.coalesce(F.nullif(F.regexp_extract(q["id"], r"q(\d+)$", 1), F.lit("")).cast("int"), F.lit(0)))
    return F.concat(article_id, F.lit("-q"), (F.coalesce(F.array_max(numbers), F.lit(0)) + 1).cast("string"))


def to_do(articles: DataFrame, records: DataFrame, annotator: str, force: bool = False) -> DataFrame:
    """Articles without a complete record of the annotator; all of them with force."""
    if force:
        return articles
    mine = records.where(F.col("annotator") == annotator)
    done = mine.where(record_status(F.col("skipped"), F.col("quotes")).isin("skipped", "done")).select("article_id")
    return articles.join(done.distinct(), "article_id", "left_anti")


def merge_quotes(a: Column, b: Column, text: Column) -> Column:
    """Two quotations as one: both's segments, the covering range and its text, the first set speaker and quotative, mentions by id once."""

    def parts(q: Column) -> Column:
        own = F.array(F.struct(q["inner_start"].alias("inner_start"), q["inner_end"].alias("inner_end"), q["outer_start"].alias("outer_start"), q["outer_end"].alias("outer_end")))
        return F.when(F.size(F.coalesce(q["segments"], F.array())) > 0, q["segments"]).otherwise(own)

    segments = F.array_sort(F.array_distinct(F.concat(parts(a), parts(b))))
    first, last = F.element_at(segments, 1), F.element_at(segments, -1)
    speaker = F.when(F.coalesce(a["speaker"]["status"], F.lit("unset")) != "unset", a["speaker"]).otherwise(b["speaker"])
    verb = F.when(F.coalesce(a["quotative"]["status"], F.lit("unset")).isin("present"), a["quotative"]).otherwise(F.coalesce(b["quotative"], a["quotative"]))
    mentions = F.array_distinct(F.concat(F.coalesce(a["mentions"], F.array()), F.coalesce(b["mentions"], F.array())))
    out = a.withField("segments", segments).withField("inner_start", first["inner_start"]).withField("outer_start", first["outer_start"]).withField("inner_end", last["inner_end"]).withField("outer_end", last["outer_end"])
    return out.withField("text", F.substring(text, first["inner_start"] + 1, last["inner_end"] - first["inner_start"])).withField("speaker", speaker).withField("quotative", verb).withField("mentions", mentions)


def unmerge_quote(q: Column, text: Column) -> Column:
    """A merged quotation as one per segment; each keeps the mentions inside it, the first the speaker and quotative."""
    return F.transform(q["segments"], lambda g, i: q.withField("inner_start", g["inner_start"]).withField("inner_end", g["inner_end"]).withField("outer_start", g["outer_start"]).withField("outer_end", g["outer_end"]).withField("text", F.substring(text, g["inner_start"] + 1, g["inner_end"] - g["inner_start"])).withField("segments", F.array().cast("array<struct<inner_start int, inner_end int, outer_start int, outer_end int>>")).withField("mentions", F.filter(q["mentions"], lambda m: (g["inner_start"] <= m["start"]) & (m["end"] <= g["inner_end"]))).withField("speaker", F.when(i == 0, q["speaker"]).otherwise(q["speaker"].withField("status", F.lit("unset")))))


def occurrences(texts: DataFrame, id_col: str, text: str, surface: str) -> DataFrame:
    """texts with each start of its surface, as `start`, ignoring case; from lengths of what lies between occurrences."""
    low, s = F.lower(F.col(text)), F.lower(F.col(surface))
    pieces = F.split(low, F.concat(F.lit(r"\Q"), s, F.lit(r"\E")), -1)
    starts = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda k: F.aggregate(F.slice(pieces, 1, k), F.lit(0), lambda n, p: n + F.length(p)) + (k - 1) * F.length(s))
    return texts.where(s != "").withColumn("_n", F.size(pieces)).where("_n > 1").withColumn("start", F.explode(starts)).drop("_n")


def locate_surface(texts: DataFrame, id_col: str, text: str, surface: str, center: str, inner_start: str, inner_end: str) -> DataFrame:
    """(id, start, end) of the occurrence of a surface to take: exact case first, outside the quotation first, then nearest to center, then leftmost."""
    o = occurrences(texts, id_col, text, surface)
    exact = F.substring(F.col(text), F.col("start") + 1, F.length(surface)) == F.col(surface)
    inside = (F.col("start") >= F.col(inner_start)) & (F.col("start") < F.col(inner_end))
    order = F.struct((~exact).alias("a"), inside.alias("b"), F.abs(F.col("start") - F.col(center)).alias("c"), F.col("start"), F.length(surface).alias("n"))
    return o.groupBy(id_col).agg(F.min(order).alias("m")).select(id_col, F.col("m.start").alias("start"), (F.col("m.start") + F.col("m.n")).alias("end"))


def quotative_candidates(quotes: DataFrame, id_col: str, text: str, cues: Sequence[str], window: int = 160) -> DataFrame:
    """(id, cue, start, distance): listed verbs as whole words within `window` characters outside the quotation's marks, nearest first by rank.

    quotes: id, text, outer_start, outer_end. Distance is to the nearer mark.
    """
    q = quotes.select(id_col, F.col(text).alias("_t"), "outer_start", "outer_end", F.explode(F.array(*map(F.lit, cues))).alias("cue"))
    q = q.where(F.contains(F.lower("_t"), F.col("cue")))
    o = occurrences(q, id_col, "_t", "cue").withColumn("end", F.col("start") + F.length("cue"))
    before, after = F.substring("_t", F.col("start"), F.lit(1)), F.substring("_t", F.col("end") + 1, F.lit(1))
    whole = ~F.when(F.col("start") > 0, before).otherwise("").rlike(r"(?U)\w") & ~after.rlike(r"(?U)\w")
    gap = F.when(F.col("end") <= F.col("outer_start"), F.col("outer_start") - F.col("end")).when(F.col("start") >= F.col("outer_end"), F.col("start") - F.col("outer_end"))
    o = o.withColumn("distance", gap).where(whole & (F.col("distance") <= window))
    return o.select(id_col, "cue", "start", "distance", F.row_number().over(Window.partitionBy(id_col).orderBy("distance", "start", "cue")).alias("rank"))


def nearest_names(texts: DataFrame, id_col: str, text: str, center: str, stop: Sequence[str] = (), window: int = 600, limit: int = 10) -> DataFrame:
    """(id, name, start, distance, rank): proper names near a place, each surface once (its first occurrence), at most `limit`."""
    t = texts.select(id_col, F.col(text).alias("_t"), F.col(center).alias("_c"), F.explode(F.array_distinct(proper_names(F.col(text), stop))).alias("name"))
    o = occurrences(t, id_col, "_t", "name").where(F.substring("_t", F.col("start") + 1, F.length("name")) == F.col("name"))
    o = o.withColumn("distance", F.abs(F.col("start") - F.col("_c"))).where(F.col("distance") <= window)
    first = o.groupBy(id_col, F.lower("name").alias("_k")).agg(F.min(F.struct("start", "name", "distance")).alias("m")).select(id_col, "m.*")
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy("distance", "start", "name"))
    return first.withColumn("rank", rank).where(F.col("rank") <= limit).select(id_col, "name", "start", "distance", "rank")


def with_answers(quotes: DataFrame, answers: DataFrame, retries: DataFrame | None, key: str) -> DataFrame:
    """quotes with a judge's answers by key, then the retry's for those without, then a rejection. answers: key, status."""
    first = answers.groupBy(key).agg(F.min("status").alias("_a"))
    rows = quotes.join(first, key, "left")
    if retries is not None:
        rows = rows.join(retries.groupBy(key).agg(F.min("status").alias("_b")), key, "left")
    else:
        rows = rows.withColumn("_b", F.lit(None).cast("string"))
    return rows.withColumn("status", F.coalesce("_a", "_b", F.lit("reject"))).drop("_a", "_b")


#: Characters around a quotation in which its speaker and verb are looked for.
NEAR = 500


def find_surface(text: Column, surface: Column, low: Column, high: Column, center: Column, outside: tuple[Column, Column] | None = None, used: Column | None = None) -> Column:
    """(start, end) of the occurrence of a surface in text[low:high] to take, or null.

    With exact case, else ignoring case; not one of `used`; outside a range if one is; nearest to center, then leftmost.
    """
    needle = F.trim(F.coalesce(surface, F.lit("")))
    n = F.length(needle)
    last = F.least(high, F.length(text)) - n
    places = lambda t, s: F.filter(F.sequence(low, last), lambda i: F.substring(t, i + 1, n) == s)
    fits = (n > 0) & (last >= low)
    exact = F.when(fits, places(text, needle)).otherwise(F.array().cast("array<int>"))
    loose = F.when(fits, places(F.lower(text), F.lower(needle))).otherwise(F.array().cast("array<int>"))
    spans = F.transform(F.when(F.size(exact) > 0, exact).otherwise(loose), lambda i: F.struct(F.abs(i - center).alias("d"), i.alias("start"), (i + n).alias("end")))
    if used is not None:
        spans = F.filter(spans, lambda s: ~F.exists(used, lambda u: (u["start"] == s["start"]) & (u["end"] == s["end"])))
    best = F.array_min(spans)
    if outside is not None:
        free = F.array_min(F.filter(spans, lambda s: (s["end"] <= outside[0]) | (s["start"] >= outside[1])))
        best = F.coalesce(free, best)
    return F.when(best.isNotNull(), F.struct(best["start"].alias("start"), best["end"].alias("end")))


def apply_predictions(quotes: DataFrame) -> DataFrame:
    """quotes with a judge's predictions located in their text: status, reject_reason, verb, speaker, found_mentions, remarks.

    quotes: text, inner_start, inner_end, outer_start, outer_end, pred_status, pred_reason, pred_verb_status, pred_verb,
    pred_speaker_status, pred_speaker, pred_mentions (surface, sentiment), pred_notes. verb and speaker are structs
    (status, start, end). A rejection clears all fields. A verb that isn't found is implicit, a speaker that isn't found
    can't be identified, a mention that isn't found in the quotation is dropped, each with a remark; equal surfaces take
    different places; a mention of unknown sentiment is neutral.
    """
    text = F.col("text")
    low, high = F.greatest(F.lit(0), F.col("outer_start") - NEAR), F.least(F.length(text), F.col("outer_end") + NEAR)
    inner = (F.col("inner_start"), F.col("inner_end"))
    rows = quotes.withColumns({
        "_verb": find_surface(text, F.col("pred_verb"), low, high, F.col("outer_start"), inner),
        "_who": find_surface(text, minimal_person(F.coalesce("pred_speaker", F.lit(""))), low, high, F.col("outer_start"), inner),
    })
    shape = "array<struct<start int, end int, surface string, sentiment string>>"

    def step(kept: Column, m: Column) -> Column:
        at = find_surface(text, m["surface"], *inner, F.col("inner_start"), None, kept)
        feeling = F.when(m["sentiment"].isin(*SENTIMENTS), m["sentiment"]).otherwise("neutral")
        return F.when(at.isNotNull(), F.array_append(kept, F.struct(at["start"].alias("start"), at["end"].alias("end"), m["surface"].alias("surface"), feeling.alias("sentiment")))).otherwise(kept)

    asked = F.filter(F.coalesce("pred_mentions", F.array().cast("array<struct<surface string, sentiment string>>")), lambda m: F.trim(F.coalesce(m["surface"], F.lit(""))) != "")
    rows = rows.withColumn("_asked", asked).withColumn("_found", F.aggregate("_asked", F.array().cast(shape), step))
    rejected = F.coalesce(F.col("pred_status") == "reject", F.lit(False))
    want_verb = (F.col("pred_verb_status") == "present") & (F.trim(F.coalesce("pred_verb", F.lit(""))) != "")
    want_who = (F.col("pred_speaker_status") == "identified") & (F.trim(F.coalesce("pred_speaker", F.lit(""))) != "")
    none = F.lit(None).cast("int")
    span = lambda wanted, at, yes, no: F.when(rejected, F.struct(F.lit("unset").alias("status"), none.alias("start"), none.alias("end"))).when(wanted & at.isNotNull(), F.struct(F.lit(yes).alias("status"), at["start"].alias("start"), at["end"].alias("end"))).otherwise(F.struct(F.lit(no).alias("status"), none.alias("start"), none.alias("end")))
    lost = F.size("_asked") - F.size("_found")
    remarks = F.array(
        F.nullif(F.trim(F.coalesce("pred_notes", F.lit(""))), F.lit("")), F.when(~rejected & want_verb & F.col("_verb").isNull(), "verb not found; implicit"),
        F.when(~rejected & want_who & F.col("_who").isNull(), "speaker not found; cannot identify"), F.when(~rejected & (lost > 0), F.concat(lost.cast("string"), F.lit(" mentions not inside the quote"))),
    )
    made = {
        "status": F.when(rejected, "reject").otherwise("keep"), "reject_reason": F.when(rejected, F.coalesce(F.nullif("pred_reason", F.lit("")), F.lit("not_speech"))),
        "verb": span(want_verb, F.col("_verb"), "present", "implicit"), "speaker": span(want_who, F.col("_who"), "identified", "cannot_identify"),
        "found_mentions": F.when(rejected, F.array().cast(shape)).otherwise(F.col("_found")), "remarks": F.array_join(F.array_compact(remarks), " "),
    }
    return rows.withColumns(made).drop("_verb", "_who", "_asked", "_found")
