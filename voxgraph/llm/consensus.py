"""Consensus of several annotators by message passing between items and annotators.

An item is one row (or, with many votes, one row per block of votes) that holds its votes, its classes and the state of
each vote-class edge, so a round needs no shuffle of edges, and many items are kept as one value, as only the next round reads them: items send their messages by sums per annotator, which are
combined on the way, and take the annotators' rates back from a small table, or by a join where that table is large.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut, drop
from .pairing import blocks

#: Pseudo-votes of the prior that keep an annotator's rates off 0 and 1.
PRIOR_HITS, PRIOR_ALL = 2.0, 4.0
NONE = ""
#: Labels that a field may have without being pooled.
MOST_LABELS = 50
#: Votes that a row holds at most on average, and rates (annotators times groups) that are sent to every task.
BLOCK, SENT = 1000, 1 << 18
#: Rounds without damping; after them the k-th further round moves messages by 1 / (k + 1) of the change.
FREE = 12


def _tidy(label: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(label, r"\p{IsWhite_Space}+", " "))), "[ -]+", "_")


def final_votes(saves: DataFrame) -> DataFrame:
    """One row (item, annotator, field, label) per annotator's last save of a quotation that isn't pending.

    Labels lose letter case and outer blanks; sentiment and qid are votes only of annotators whose status is keep, and
    a keep without qid is a vote for "no entity" (the empty label). Saves with a null quote, annotator or status, and
    keeps with a null sentiment, give no vote of that field. Equal times: the greater annotation_id counts.
    """
    s = saves.select("quote_id", "annotator", _tidy(F.col("status")).alias("status"), _tidy(F.col("sentiment")).alias("sentiment"), F.upper(F.trim("qid")).alias("qid"), "saved_at", "annotation_id")
    s = s.where("quote_id is not null and annotator is not null and status in ('keep', 'reject')")
    last = s.groupBy("quote_id", "annotator").agg(F.max(F.struct("saved_at", "annotation_id", "status", "sentiment", "qid")).alias("s")).select("quote_id", "annotator", "s.*")
    kept = F.col("status") == "keep"
    fields = F.array(
        F.struct(F.lit("status").alias("field"), F.col("status").alias("label")),
        F.struct(F.lit("sentiment").alias("field"), F.when(kept, F.nullif("sentiment", F.lit(""))).alias("label")),
        F.struct(F.lit("qid").alias("field"), F.when(kept, F.coalesce("qid", F.lit(NONE))).alias("label")),
    )
    return last.select(F.col("quote_id").alias("item"), "annotator", F.explode(fields).alias("f")).select("item", "annotator", "f.*").where("label is not null")


@dataclass(frozen=True)
class _Groups:
    """Groups of classes whose rates are counted together: one per label of a field, one for all of a pooled field."""

    fields: tuple[str, ...]
    labels: tuple[tuple[str, ...] | None, ...]  # None: pooled

    @property
    def base(self) -> np.ndarray:
        return np.r_[0, np.cumsum([1 if x is None else len(x) for x in self.labels])].astype(np.int64)

    @property
    def names(self) -> list[tuple[str, str]]:
        return [(f, n) for f, x in zip(self.fields, self.labels) for n in (x or ("*",))]


def _groups(votes: DataFrame, pooled: tuple[str, ...]) -> _Groups:
    plain = votes.where(~F.col("field").isin(*pooled)).select("field", "label").distinct().limit(MOST_LABELS * 20 + 1).collect()
    labels = {f: None for f in pooled} | {f: tuple(sorted(r.label for r in plain if r.field == f)) for f in {r.field for r in plain}}
    if any(x and len(x) > MOST_LABELS for x in labels.values()):
        raise ValueError(f"fields with more than {MOST_LABELS} labels must be pooled")
    return _Groups(tuple(sorted(labels)), tuple(labels[f] for f in sorted(labels)))


def _items(votes: DataFrame, groups: _Groups, block: int | None) -> DataFrame:
    """Rows (field, item, part, parts, annotators, votes, classes, counts, all_votes): votes as indices into classes.

    block: votes of a row on average at most; None where no item has many.
    """
    keys = ["field", "item"]
    one = F.struct("annotator", "label").alias("vote")
    if block is None:
        rows = votes.groupBy(*keys).agg(F.collect_list(one).alias("ids")).withColumns({"part": F.lit(0), "parts": F.lit(1)})
    else:
        rows = blocks(votes.select(*keys, one), keys, "vote", block).withColumnsRenamed({"blk": "part", "blocks": "parts"})
        rows = cut(rows)
    rows = rows.select(*keys, "part", "parts", F.col("ids.annotator").alias("annotators"), F.col("ids.label").alias("labels"))
    given = F.array_sort(F.array_distinct("labels"))
    if block is not None:
        wide = rows.where("parts > 1").select(*keys, F.explode("labels").alias("label")).groupBy(*keys, "label").agg(F.count("*").alias("n"))
        wide = wide.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("label", "n"))).alias("wide"), F.sum("n").alias("wide_votes"))
        rows = rows.join(wide, keys, "left")
    else:
        rows = rows.withColumns({"wide": F.lit(None).cast("array<struct<label string, n bigint>>"), "wide_votes": F.lit(None).cast("long")})
    classes = F.coalesce(F.col("wide.label"), given)
    for field, labels in zip(groups.fields, groups.labels):
        if labels is not None:
            classes = F.when(F.col("field") == field, F.array(*map(F.lit, labels))).otherwise(classes)
    rows = rows.withColumn("classes", classes)
    own = F.transform("classes", lambda c: F.size(F.filter("labels", lambda x: x == c)).cast("long"))
    far = F.transform("classes", lambda c: F.coalesce(F.get(F.filter("wide", lambda w: w["label"] == c), F.lit(0))["n"], F.lit(0).cast("long")))
    rows = rows.withColumn("counts", F.when(F.col("wide").isNotNull(), far).otherwise(own))
    at = F.transform("labels", lambda x: (F.array_position("classes", x) - 1).cast("int"))
    none = F.lit(None).cast("array<double>")
    return rows.select(*keys, "part", "parts", "annotators", at.alias("votes"), "classes", "counts", F.coalesce("wide_votes", F.size("labels").cast("long")).alias("all_votes"), none.alias("p"), none.alias("log_odds"), F.lit(None).cast("double").alias("moved"))


_ITEM = "field string, item string, part int, parts int, annotators array<string>, votes array<int>, classes array<string>, counts array<bigint>, all_votes bigint, p array<double>, log_odds array<double>, moved double"


_COLUMNS = [f.split()[0] for f in _ITEM.split(", ")]
#: Edges in a block of items that is kept as one value.
PACKED = 1 << 18


def _packed(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Blocks of items as Arrow streams, one value each: between rounds nothing looks into them but the next round."""
    sizes = pc.multiply(pc.list_value_length(rows.column(5)), pc.list_value_length(rows.column(6))).to_numpy().astype(np.int64)
    at, cuts = 0, (np.cumsum(sizes) - 1) // PACKED
    for width in np.bincount(cuts)[np.unique(cuts)].tolist() if rows.num_rows else []:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as stream:
            stream.write_batch(rows.slice(at, width))
        at += width
        yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block"])


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items of blocks, or of rows that are no blocks."""
    for batch in batches:
        if batch.schema.names != ["block"]:
            if batch.num_rows:
                yield batch
            continue
        for block in batch.column(0):
            yield from pa.ipc.open_stream(block.as_buffer())


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from _packed(batch)


class _Flat:
    """The vote-class edges of a batch of items as flat arrays."""

    def __init__(self, batch: pa.RecordBatch, groups: _Groups):
        self.batch, self.n = batch, batch.num_rows
        field = pc.index_in(self.get("field"), value_set=pa.array(groups.fields, pa.string())).to_numpy()
        size = lambda name: pc.list_value_length(self.get(name)).to_numpy().astype(np.int64)
        per_vote, per_class = size("votes"), size("classes")
        self.annotators = self.get("annotators").flatten()
        vote = self.get("votes").flatten().to_numpy()
        row = np.repeat(np.arange(self.n), per_vote)  # of each vote
        self.row_edges = per_vote * per_class
        self.class_at = np.r_[0, np.cumsum(per_class)]
        wide = per_class[row]
        self.vote = np.repeat(np.arange(len(vote)), wide)  # of each edge
        place = np.arange(len(self.vote)) - np.repeat(np.cumsum(wide) - wide, wide)
        self.row = row[self.vote]
        self.cls = self.class_at[self.row] + place
        self.v = (vote[self.vote] == place).astype(float)
        pooled = np.array([x is None for x in groups.labels], bool)
        class_row = np.repeat(np.arange(self.n), per_class)
        inner = np.arange(len(class_row)) - self.class_at[class_row]
        self.class_group = groups.base[field[class_row]] + np.where(pooled[field[class_row]], 0, inner)
        self.group = self.class_group[self.cls]
        p = self.get("p")
        if p.null_count:
            counts, total = self.get("counts").flatten().to_numpy()[self.cls], self.get("all_votes").to_numpy()[self.row]
            self.p = np.where(total > 1, (counts - self.v) / np.maximum(total - 1, 1), 0.5)
        else:
            self.p = p.flatten().to_numpy()

    def get(self, name: str) -> pa.Array:
        return self.batch.column(self.batch.schema.get_field_index(name))


def _sums(groups: _Groups) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Soft counts by group and annotator: p and its complement, over all and over the votes for the class; and the greatest move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _opened(batches):
            e = _Flat(batch, groups)
            coded = pc.dictionary_encode(e.annotators)
            key = e.group * len(coded.dictionary) + coded.indices.to_numpy()[e.vote]
            found, at = np.unique(key, return_inverse=True)
            sums = [np.bincount(at, x, len(found)) for x in (e.p, e.p * e.v, 1 - e.p, (1 - e.p) * e.v)]
            moved = pc.max(e.get("moved")).as_py()
            names = coded.dictionary.take(pa.array(found % len(coded.dictionary)))
            yield pa.RecordBatch.from_arrays([pa.array((found // len(coded.dictionary)).astype(np.int32)), names, *map(pa.array, sums), pa.array([moved] * len(found), pa.float64())], ["g", "annotator", *_SUMS, "moved"])

    return run


_SUMS = ("p_all", "p_hit", "q_all", "q_hit")


def _rates(table: DataFrame, groups: _Groups) -> DataFrame:
    parts = table.mapInArrow(_sums(groups), f"g int, annotator string, {', '.join(f'{c} double' for c in _SUMS)}, moved double")
    return parts.groupBy("g", "annotator").agg(*(F.sum(c).alias(c) for c in _SUMS), F.max("moved").alias("moved"))


def _ratios(e: _Flat, rates: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of each edge's vote, from its annotator's counts without what this edge gave to them.

    So a vote doesn't vouch for itself. rates: a row of four sums per edge.
    """
    p, q, v = e.p, 1 - e.p, e.v
    p_all, p_hit, q_all, q_hit = rates.T
    sure = lambda x: np.clip(x, 1e-6, 1 - 1e-6)
    sens = sure((p_hit - p * v + PRIOR_HITS) / (p_all - p + PRIOR_ALL * 0.75))
    fall = sure((q_hit - q * v + PRIOR_HITS * 0.25) / (q_all - q + PRIOR_ALL))
    return np.where(v == 1, np.log(sens / fall), np.log((1 - sens) / (1 - fall)))


def _edge_rates(e: _Flat, groups: _Groups, sent) -> np.ndarray:
    if sent is None:  # the rates came by a join: four sums per vote and group
        return e.get("rates").flatten().to_numpy().reshape(-1, groups.base[-1], 4)[e.vote, e.group]
    names, tensor = sent.value
    return tensor[e.group, pc.index_in(e.annotators, value_set=names).to_numpy()[e.vote]]


def _totals(groups: _Groups, sent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of ratios of one part of an item, to be added over its parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _opened(batches):
            e = _Flat(batch, groups)
            sums = np.bincount(e.cls, _ratios(e, _edge_rates(e, groups, sent)), e.class_at[-1])
            yield pa.RecordBatch.from_arrays([e.get("field"), e.get("item"), pa.ListArray.from_arrays(pa.array(e.class_at, pa.int32()), pa.array(sums))], ["field", "item", "sums"])

    return run


def _step(groups: _Groups, sent, base: list[float], pace: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Items answer: each edge gets its class's probability by all other votes, moved by `pace` of the change."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prior = np.array(base)
        for batch in _opened(batches):
            e = _Flat(batch, groups)
            ratio = _ratios(e, _edge_rates(e, groups, sent))
            total = np.bincount(e.cls, ratio, e.class_at[-1])
            far = e.get("total") if "total" in batch.schema.names else None
            if far is not None and far.null_count < len(far):
                has = np.repeat(far.is_valid().to_numpy(zero_copy_only=False), np.diff(e.class_at))
                total[has] = far.flatten().to_numpy()
            odds = total + prior[e.class_group]
            p = 1 / (1 + np.exp(np.clip(ratio - odds[e.cls], -50, 50)))
            p = e.p + pace * (p - e.p)
            moved = np.zeros(e.n)
            np.maximum.at(moved, e.row, np.abs(p - e.p))
            offsets = pa.array(np.r_[0, np.cumsum(e.row_edges)], pa.int32())
            kept = [e.get(c) for c in _COLUMNS[:-3]]
            made = [pa.ListArray.from_arrays(offsets, pa.array(p)), pa.ListArray.from_arrays(pa.array(e.class_at, pa.int32()), pa.array(odds)), pa.array(moved)]
            yield from _packed(pa.RecordBatch.from_arrays([*kept, *made], _COLUMNS))

    return run


def _joined(table: DataFrame, rates: DataFrame, groups: _Groups, salts: int = 16) -> DataFrame:
    """The items with their annotators' rates per vote and group: the way for more annotators than can be sent to every task.

    An annotator's rates are repeated for `salts` hash classes of items, so one with a third of all votes is split.
    """
    n = int(groups.base[-1])
    spread = F.expr(f"transform(sequence(0, {n} - 1), i -> coalesce(get(filter(r, x -> x.g = i), 0).s, array(0D, 0D, 0D, 0D)))")
    per = rates.groupBy("annotator").agg(F.collect_list(F.struct("g", F.array(*_SUMS).alias("s"))).alias("r"))
    per = per.select("annotator", F.flatten(spread).alias("rates"), F.explode(F.expr(f"sequence(0, {salts} - 1)")).alias("salt"))
    keys = ["field", "item", "part"]
    votes = table.select(*keys, F.pmod(F.xxhash64("item"), F.lit(salts)).cast("int").alias("salt"), F.posexplode("annotators").alias("at", "annotator"))
    met = votes.join(per, ["annotator", "salt"]).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("at", "rates"))).alias("r"))
    return table.join(met.select(*keys, F.flatten("r.rates").alias("rates")), keys)


def _unpacked(table: DataFrame) -> DataFrame:
    return table.mapInArrow(_opened, _ITEM)


def _passed(votes: DataFrame, pooled: tuple[str, ...], tolerance: float, block: int, sent_rates: int) -> tuple[DataFrame, DataFrame]:
    """The items after the last round, and the annotators' sums: g, annotator, p_all, p_hit, q_all, q_hit."""
    votes = cut(votes)
    spark, groups = votes.sparkSession, _groups(votes, pooled)
    n, done = int(groups.base[-1]), 0
    annotators = votes.select("annotator").distinct().count()
    several = annotators > block  # else no item has more votes than a block
    items = _items(votes, groups, block if several else None)
    wide = several and not items.where("parts > 1").isEmpty()
    table = cut(items.mapInArrow(_pack, "block binary"))
    while True:
        rates = _rates(table, groups)
        if n * annotators <= sent_rates:
            found = rates.toArrow()
            at = found["g"].to_numpy()
            held, lost = (np.bincount(at, found[c].to_numpy(), n) for c in ("p_all", "q_all"))
            moved, some = pc.max(found["moved"]).as_py(), found.num_rows > 0
        else:
            rates = cut(rates)
            sums = rates.groupBy("g").agg(F.sum("p_all").alias("p"), F.sum("q_all").alias("q"), F.max("moved").alias("moved")).collect()
            held, lost = np.zeros(n), np.zeros(n)
            for r in sums:
                held[r.g], lost[r.g] = r.p, r.q
            found, some = None, bool(sums)
            moved = max((r.moved for r in sums if r.moved is not None), default=None)
        if not some or (done and moved < tolerance):
            break
        share = (held + 0.5) / (held + lost + 1)
        base = [float(x) for x in np.log(share / (1 - share))]
        if found is not None:
            known = pc.unique(found["annotator"])
            tensor = np.zeros((n, len(known), 4))
            tensor[at, pc.index_in(found["annotator"], value_set=known).to_numpy()] = np.stack([found[c].to_numpy() for c in _SUMS], 1)
            sent, rows = spark.sparkContext.broadcast((known, tensor)), cut(_unpacked(table)) if wide else table
        else:
            sent, rows = None, cut(_joined(_unpacked(table), rates, groups))
        moving = rows
        if wide:
            parts = rows.where("parts > 1").mapInArrow(_totals(groups, sent), "field string, item string, sums array<double>")
            total = parts.select("field", "item", F.posexplode("sums").alias("at", "s")).groupBy("field", "item", "at").agg(F.sum("s").alias("s"))
            total = total.groupBy("field", "item").agg(F.sort_array(F.collect_list(F.struct("at", "s"))).alias("t")).select("field", "item", F.col("t.s").alias("total"))
            moving = rows.join(total, ["field", "item"], "left")
        pace = 1.0 if done < FREE else 1 / (done - FREE + 2)
        fresh = cut(moving.mapInArrow(_step(groups, sent, base, pace), "block binary"))
        for old in {id(x): x for x in (table, rows, *([rates] if found is None else []))}.values():
            drop(old)
        table, done = fresh, done + 1
    return table, rates


def consensus(votes: DataFrame, pooled: tuple[str, ...] = ("qid",), tolerance: float = 0.02, block: int = BLOCK, sent: int = SENT) -> tuple[DataFrame, DataFrame]:
    """Scores (field, item, all_votes, change, labels) of the labels of each item, and annotators' rates.

    votes: item, annotator, field, label, one vote per item, annotator and field. Every label is a binary question about
    an item, this class against the rest: in pooled fields the labels given to the item, elsewhere all labels of the
    field (MOST_LABELS at most, else ValueError), as what nobody said counts too where annotators are known to mislead.
    An item sends each of its annotators the class's probability by all its other annotators; an annotator sends each of
    its items the likelihood ratio of its vote, from how often it named the class where the class was probable and where
    not, over all its other items. In pooled fields the rates hold for all classes together, elsewhere class by class,
    so that one who always gives the same label, or the contrary, gets the weight this deserves.

    Rounds go on until no message changes by more than `tolerance`. From the FREE-th round on changes are damped ever
    more, so messages that would swing come to rest at their mean and the rounds end for certain; change is an item's
    last one. labels are structs (label, votes, log_odds). Work per round is the votes times the labels asked. An item
    with more than `block` votes is dealt to several rows; up to `sent` rates are sent to every task, more are joined.
    """
    table, rates = _passed(votes, pooled, tolerance, block, sent)
    table = _unpacked(table)
    labels = F.expr("transform(sequence(0, size(classes) - 1), i -> named_struct('label', classes[i], 'votes', counts[i], 'log_odds', log_odds[i]))")
    # an item's parts all hold its classes' log-odds; block 0 is one of them unless the deal left it empty
    first = table.where("parts = 1").unionByName(table.where("parts > 1").dropDuplicates(["field", "item"]))
    return first.select("field", "item", "all_votes", F.col("moved").alias("change"), labels.alias("labels")), rates


def winners(scores: DataFrame) -> DataFrame:
    """One row (field, item, label, agreement, all_votes, confidence, change) per item and field with the most probable label.

    agreement is the share of votes for it; confidence its probability against the rest; change how much the item's
    messages still moved in the last round. Ties: more votes, then the least label.
    """
    least = F.expr("transform(labels, x -> named_struct('o', -round(x.log_odds, 9), 'v', -x.votes, 'label', x.label, 'votes', x.votes))")
    best = scores.withColumn("b", F.array_min(least))
    p = 1 / (1 + F.exp(F.col("b.o")))
    return best.select("field", "item", "b.label", (F.col("b.votes") / F.col("all_votes")).alias("agreement"), "all_votes", p.alias("confidence"), "change")


def annotation_labels(saves: DataFrame, **options) -> DataFrame:
    """Rows (quote_id, label_field, label, agreement, all_votes, confidence, change): status, and for kept quotations the rest.

    A quotation whose winning qid is "no entity" has no qid row.
    """
    best = winners(consensus(final_votes(saves), **options)[0])
    best = cut(best.select(F.col("item").alias("quote_id"), F.col("field").alias("label_field"), "label", "agreement", "all_votes", "confidence", "change"))
    kept = best.where("label_field = 'status' and label = 'keep'").select("quote_id")
    rest = best.where("label_field <> 'status' and label <> ''").join(kept, "quote_id", "left_semi")
    return best.where("label_field = 'status'").unionByName(rest)


def annotator_reliability(saves: DataFrame, pooled: tuple[str, ...] = ("qid",), **options) -> DataFrame:
    """One row (annotator, field, labels, hit_rate, false_rate, reliability) per annotator and field.

    hit_rate: soft share of a class's items for which the annotator named it; false_rate: of the other items; both as the
    mean over classes, weighted by the class's share. reliability is their difference: 1 perfect, 0 no information (as
    always the same label), below 0 misleading.
    """
    votes = final_votes(saves)
    _, rates = consensus(votes, pooled, **options)
    div = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    names = _groups(votes, pooled).names
    field = F.element_at(F.array(*(F.lit(f) for f, _ in names)), F.col("g") + 1) if names else F.lit("")
    part = rates.withColumn("field", field).withColumn("h", div("p_hit", "p_all")).withColumn("f", div("q_hit", "q_all"))
    mean = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("p_all")), F.sum("p_all")), F.lit(0.0))
    sums = part.groupBy("annotator", "field").agg(mean("h").alias("hit_rate"), mean("f").alias("false_rate"))
    n = votes.groupBy("annotator", "field").agg(F.count("*").alias("labels"))
    return sums.join(n, ["annotator", "field"]).select("annotator", "field", "labels", "hit_rate", "false_rate", (F.col("hit_rate") - F.col("false_rate")).alias("reliability"))


def agreement(saves: DataFrame) -> DataFrame:
    """One row (label_field, items, votes, observed, expected, kappa): pairwise agreement over items with two votes or more."""
    votes = final_votes(saves)
    per = votes.groupBy("field", "item", "label").agg(F.count("*").alias("n"))
    items = per.groupBy("field", "item").agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same")).where("n > 1")
    share = per.join(items.select("field", "item"), ["field", "item"], "left_semi").groupBy("field", "label").agg(F.sum("n").alias("n"))
    total = share.groupBy("field").agg(F.sum("n").alias("votes"), F.sum(F.pow("n", F.lit(2))).alias("squares"))
    seen = items.groupBy("field").agg(F.count("*").alias("items"), F.avg(F.col("same") / (F.col("n") * (F.col("n") - 1))).alias("observed"))
    out = seen.join(total, "field").withColumn("expected", F.col("squares") / F.pow("votes", F.lit(2)))
    kappa = F.expr("try_divide(observed - expected, 1 - expected)")
    return out.select(F.col("field").alias("label_field"), "items", "votes", F.round("observed", 6).alias("observed"), F.round("expected", 6).alias("expected"), F.round(kappa, 6).alias("kappa"))
