"""Scores of predictions against gold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import INSTITUTIONAL_PROXY, QUOTATIVE_VERBS, TITLE_TOKENS
from ..functions.text import alnum_tokens, normal_answer


def rates(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and their harmonic mean; 0 where a denominator is 0."""
    div = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    p, r = div(tp, tp + fp), div(tp, tp + fn)
    return p, r, div(2 * p * r, p + r)


def precision_recall(rows: DataFrame, group: str, truth: str, guess: str) -> DataFrame:
    """(group, n, tp, fp, fn, precision, recall, f1) of two boolean columns; null counts as false."""
    t, g = F.coalesce(F.col(truth), F.lit(False)), F.coalesce(F.col(guess), F.lit(False))
    out = rows.groupBy(group).agg(F.count("*").alias("n"), F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"))
    p, r, f = rates(F.col("tp"), F.col("fp"), F.col("fn"))
    return out.withColumn("precision", p).withColumn("recall", r).withColumn("f1", f)


def macro_f1(rows: DataFrame, group: str, truth: str, guess: str, labels: Sequence[str]) -> DataFrame:
    """(group, macro_f1): mean over the labels of each label against the rest, labels without a case included as 0."""
    each = rows.select(group, truth, guess, F.explode(F.array(*map(F.lit, labels))).alias("_l"))
    t, g = F.coalesce(F.col(truth) == F.col("_l"), F.lit(False)), F.coalesce(F.col(guess) == F.col("_l"), F.lit(False))
    s = each.groupBy(group, "_l").agg(F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"))
    return s.withColumn("f", rates(F.col("tp"), F.col("fp"), F.col("fn"))[2]).groupBy(group).agg(F.avg("f").alias("macro_f1"))


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two texts' alphanumeric tokens, counted with repeats; 1 if both have none, 0 if one has none."""
    x, y = alnum_tokens(F.coalesce(a, F.lit(""))), alnum_tokens(F.coalesce(b, F.lit("")))
    shared = F.aggregate(F.array_distinct(x), F.lit(0), lambda s, t: s + F.least(F.size(F.filter(x, lambda u: u == t)), F.size(F.filter(y, lambda u: u == t))))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).when((F.size(x) == 0) | (F.size(y) == 0) | (shared == 0), 0.0).otherwise(2.0 * shared / (F.size(x) + F.size(y)))


def outcomes(rows: DataFrame, pronouns: Sequence[str], document: str = "document") -> DataFrame:
    """rows (pred_speaker, gold_speaker, pred_refers_to, pred_verb, gold_verb, document) with exactness, token F1, pronoun and copied-span flags."""
    has = lambda c: (F.trim(F.coalesce(F.col(c), F.lit(""))) == "") | F.contains(F.lower(F.coalesce(F.col(document), F.lit(""))), F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))))
    answer = lambda c: normal_answer(F.coalesce(F.col(c), F.lit("")))
    return rows.withColumns({
        "speaker_exact": answer("pred_speaker") == answer("gold_speaker"), "speaker_token_f1": token_f1(F.col("pred_speaker"), F.col("gold_speaker")), "verb_exact": answer("pred_verb") == answer("gold_verb"),
        "speaker_is_pronoun": answer("pred_speaker").isin(list(pronouns)), "speaker_in_document": has("pred_speaker"), "referent_in_document": has("pred_refers_to"), "verb_in_document": has("pred_verb"),
    })


def relaxed_correct() -> Column:
    """Exact, or a pronoun whose stated referent shares a token with the gold speaker."""
    gold, referent = (alnum_tokens(F.coalesce(F.col(c), F.lit(""))) for c in ("gold_speaker", "pred_refers_to"))
    return F.col("speaker_exact") | (F.col("speaker_is_pronoun") & F.coalesce(F.arrays_overlap(gold, referent), F.lit(False)))


def error_category() -> Column:
    """The first that holds: correct, false_positive_unknown, missing_speaker, wrong_speaker, a clause or title in the span, too long, too short, partial."""
    pred, gold = (F.array_distinct(alnum_tokens(F.coalesce(F.col(c), F.lit("")))) for c in ("pred_speaker", "gold_speaker"))
    extra = F.array_except(pred, gold)
    within = F.size(F.array_except(gold, pred)) == 0
    listed = lambda words: F.array(*map(F.lit, words))
    return (
        F.when(relaxed_correct(), "correct").when((F.size(gold) == 0) & (F.size(pred) > 0), "false_positive_unknown").when((F.size(gold) > 0) & (F.size(pred) == 0), "missing_speaker")
        .when(~F.arrays_overlap(pred, gold), "wrong_speaker").when(F.arrays_overlap(pred, listed(QUOTATIVE_VERBS)), "speaker_span_includes_verb_or_clause").when(within & F.arrays_overlap(extra, listed(TITLE_TOKENS)), "title_or_role_expansion")
        .when(within, "overlong_name_span").when(F.size(extra) == 0, "underspecified_name_span").otherwise("alias_or_partial_overlap")
    )


def attribution_summary(scored: DataFrame, group: str) -> DataFrame:
    """One row per group: total, accuracies, mean token F1, misses, copied-span failures, pronoun predictions."""
    copied = F.col("speaker_in_document") & F.col("referent_in_document") & F.col("verb_in_document")
    share = lambda c: F.avg(c.cast("double"))
    return scored.groupBy(group).agg(
        F.count("*").alias("total"), share(F.col("speaker_exact")).alias("exact_accuracy"), share(relaxed_correct()).alias("relaxed_accuracy"), F.avg("speaker_token_f1").alias("token_f1"), share(F.col("verb_exact")).alias("verb_accuracy"),
        F.count_if(~F.col("speaker_exact")).alias("exact_misses"), F.count_if(~F.col("speaker_exact") & (F.col("speaker_token_f1") < 0.5)).alias("low_overlap_misses"), F.count_if(~copied).alias("copied_span_failures"), F.count_if(F.col("speaker_is_pronoun")).alias("pronoun_predictions"),
    )


def missed_groups(scored: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, categories): groups with a prediction that isn't exact, with their sorted distinct error categories."""
    g = scored.withColumn("_c", error_category()).groupBy(*keys).agg(F.count("*").alias("n"), F.bool_and("speaker_exact").alias("_all"), F.array_join(F.array_sort(F.collect_set("_c")), " ").alias("categories"))
    return g.where("not _all").drop("_all")


def nearest_run(tags: DataFrame, document: str, wanted: Column, start: str, radius: int) -> DataFrame:
    """(document, run_start, run_end): the contiguous run of wanted tags (document, pos, tag) nearest to `start` within the radius.

    start: a column of the document's target position. Ties: the earlier run.
    """
    order = Window.partitionBy(document).orderBy("pos")
    runs = tags.withColumn("_w", wanted).withColumn("_new", (F.col("_w") & ~F.coalesce(F.lag("_w").over(order), F.lit(False))).cast("int"))
    runs = runs.withColumn("_run", F.sum("_new").over(order)).where("_w").groupBy(document, "_run").agg(F.min("pos").alias("run_start"), (F.max("pos") + 1).alias("run_end"), F.first(start).alias("_s"))
    gap = F.greatest(F.col("_s") - F.col("run_end"), F.col("run_start") - F.col("_s"), F.lit(0))
    best = runs.where(gap <= radius).groupBy(document).agg(F.min(F.struct(gap.alias("gap"), "run_start", "run_end")).alias("m"))
    return best.select(document, "m.run_start", "m.run_end")


def name_tokens(words: Column) -> Column:
    """Distinct lower-case alphabetic words without outer quotes and punctuation."""
    return F.array_distinct(F.transform(F.filter(words, lambda w: w.rlike(r"^\p{L}+$")), lambda w: F.lower(w)))


def gold_spans(tokens: DataFrame, radius: int = 25) -> DataFrame:
    """(paragraph, idx, kind, start, end, text, names) of the quotations in labelled tokens (paragraph, pos, word, tag).

    Tags B-<kind> and I-<kind> mark quotations of the kinds LeftSpeaker, RightSpeaker and Unknown, B-Speaker and I-Speaker
    speakers. names are those of the run of speaker tags nearest to the quotation on its side, within `radius` tokens.
    """
    order = Window.partitionBy("paragraph").orderBy("pos")
    t = tokens.withColumn("kind", F.regexp_extract("tag", "^[BI]-(LeftSpeaker|RightSpeaker|Unknown)$", 1)).withColumn("is_speaker", F.col("tag").isin("B-Speaker", "I-Speaker"))
    begins = (F.col("kind") != "") & (F.col("tag").startswith("B-") | (F.coalesce(F.lag("kind").over(order), F.lit("")) != F.col("kind")))
    runs = F.col("is_speaker") & ~F.coalesce(F.lag("is_speaker").over(order), F.lit(False))
    t = t.withColumns({"_b": begins.cast("int"), "_r": runs.cast("int")}).withColumns({"no": F.sum("_b").over(order), "run": F.sum("_r").over(order)})
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ")
    spans = t.where("kind <> ''").groupBy("paragraph", "no", "kind").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), words.alias("text"))
    spans = spans.withColumn("idx", (F.col("no") - 1).cast("int"))
    s = t.where("is_speaker").select("paragraph", F.col("pos").alias("at"), "word", "run")
    left = (F.col("kind") == "LeftSpeaker") & (F.col("at") < F.col("start")) & (F.col("at") >= F.col("start") - radius)
    right = (F.col("kind") == "RightSpeaker") & (F.col("at") >= F.col("end")) & (F.col("at") < F.col("end") + radius)
    met = spans.select("paragraph", "idx", "kind", "start", "end").join(s, "paragraph").where(left | right)
    near = met.groupBy("paragraph", "idx", F.when(F.col("kind") == "LeftSpeaker", -F.col("run")).otherwise(F.col("run")).alias("o")).agg(F.collect_list("word").alias("w"))
    near = near.groupBy("paragraph", "idx").agg(F.min(F.struct("o", "w")).alias("m")).select("paragraph", "idx", name_tokens(F.col("m.w")).alias("names"))
    out = spans.join(near, ["paragraph", "idx"], "left")
    return out.select("paragraph", "idx", "kind", "start", "end", "text", F.coalesce("names", F.array().cast("array<string>")).alias("names"))


def gold_pairs(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """Adjacent quotations of gold_spans: (paragraph, idx, bridge, should_merge, bridge_has_person, institutional).

    They should merge if the bridge is punctuation only, or names a speaker of either side, or both sides have a speaker
    in common. institutional: the bridge has a phrase of an institution and no speaker, and both kinds are Unknown.
    """
    order = Window.partitionBy("paragraph").orderBy("idx")
    nxt = {f"next_{c}": F.lead(c).over(order) for c in ("start", "names", "kind")}
    pairs = spans.withColumns(nxt).where("next_start is not null")
    t = tokens.select("paragraph", F.col("pos").alias("at"), "word", "tag")
    met = pairs.select("paragraph", "idx", "end", "next_start").join(t, "paragraph").where("at >= end and at < next_start")
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ")
    said = F.collect_list(F.when(F.col("tag").isin("B-Speaker", "I-Speaker"), F.col("word")))
    bridge = met.groupBy("paragraph", "idx").agg(words.alias("bridge"), said.alias("_s"))
    rows = pairs.join(bridge, ["paragraph", "idx"], "left").withColumns({"bridge": F.coalesce("bridge", F.lit("")), "_s": F.coalesce("_s", F.array().cast("array<string>"))})
    b, person = name_tokens(F.col("_s")), F.size("_s") > 0
    punctuation = (F.trim("bridge") != "") & ~F.col("bridge").rlike("[A-Za-z0-9]")
    overlap = lambda x, y: F.coalesce(F.arrays_overlap(x, y), F.lit(False))
    should = punctuation | overlap(b, F.col("names")) | overlap(b, F.col("next_names")) | overlap(F.col("names"), F.col("next_names"))
    institution = F.col("bridge").rlike("(?i)" + INSTITUTIONAL_PROXY) & ~person & (F.col("kind") == "Unknown") & (F.col("next_kind") == "Unknown")
    return rows.select("paragraph", "idx", "bridge", should.alias("should_merge"), person.alias("bridge_has_person"), institution.alias("institutional"))


def merge_scores(pairs: DataFrame, kept: DataFrame) -> DataFrame:
    """(subset, total, tp, fp, fn, tn, precision, recall, f1, merge_rate, non_quote_rate) of merging against gold.

    pairs: gold_pairs with merge, left_role, right_role of a decision. kept: one row per block with gold_has_person and
    passes. Subsets: all pairs, those without a speaker in the bridge, institutional ones, and the blocks that pass.
    """
    said = F.col("merge") == "yes"
    p = pairs.select(F.explode(F.array_compact(F.array(F.lit("pairs"), F.when(~F.col("bridge_has_person"), "high_risk"), F.when(F.col("institutional"), "institutional")))).alias("subset"),
                     F.col("should_merge").alias("gold"), said.alias("pred"), ((F.col("left_role") == "non_quote") | (F.col("right_role") == "non_quote")).alias("non_quote"))
    k = kept.select(F.lit("blocks").alias("subset"), F.col("gold_has_person").alias("gold"), F.col("passes").alias("pred"), F.lit(None).cast("boolean").alias("non_quote"))
    out = p.unionByName(k).groupBy("subset").agg(
        F.count("*").alias("total"), F.count_if(F.col("pred") & F.col("gold")).alias("tp"), F.count_if(F.col("pred") & ~F.col("gold")).alias("fp"), F.count_if(~F.col("pred") & F.col("gold")).alias("fn"),
        F.count_if(~F.col("pred") & ~F.col("gold")).alias("tn"), F.avg(F.col("pred").cast("double")).alias("merge_rate"), F.avg(F.col("non_quote").cast("double")).alias("non_quote_rate"),
    )
    precision, recall, f1 = rates(F.col("tp"), F.col("fp"), F.col("fn"))
    return out.withColumns({"precision": precision, "recall": recall, "f1": f1})
