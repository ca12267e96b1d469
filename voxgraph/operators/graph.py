"""Edges speaker -> person mentioned, and their filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def is_person_speaker(speaker: Column) -> Column:
    """Whether there is a speaker; the string None stands for none."""
    return speaker.isNotNull() & (speaker != "None")


def is_faulty_token(mention: Column) -> Column:
    """Whether a one-token mention is a single character or has no letter."""
    return (F.length(mention) <= 1) | ~mention.rlike(r"\p{L}")


def nested_edges(articles: DataFrame, content: str = "content") -> DataFrame:
    """Edges of articles with nested quotations, ends and names: (articleID, url, source, target, quotation, quoteID, target_mentions).

    quotations: array of (quoteID, quotation, quotationOffset, localTopSpeaker); ends: array of int beside it; names: array of
    maps with name and offsets, a list of [start, end] as JSON. A name is the target of a quotation if one of its mentions
    lies in it and isn't faulty; mentions are joined by |. All within the row: no shuffle.
    """
    tokens = F.split(F.col(content), " ", -1)
    q = articles.select("articleID", "url", "names", tokens.alias("t"), F.posexplode("quotations").alias("i", "q"), "ends")
    q = q.withColumn("end", F.get("ends", F.col("i"))).where(is_person_speaker(F.col("q.localTopSpeaker")))
    q = q.select("*", F.explode("names").alias("name"))
    spans = F.from_json(F.col("name")["offsets"], "array<array<int>>")
    text = lambda s: F.array_join(F.slice(F.col("t"), s[0] + 1, F.greatest(s[1] - s[0], F.lit(0))), " ")
    inside = F.filter(spans, lambda s: (s[0] >= F.col("q.quotationOffset")) & (s[0] < F.col("end")))
    good = F.filter(inside, lambda s: ~((s[1] - s[0] == 1) & is_faulty_token(text(s))))
    q = q.withColumn("mentions", F.transform(good, text)).where(F.size("mentions") > 0)
    return q.select("articleID", "url", F.col("q.localTopSpeaker").alias("source"), F.col("name")["name"].alias("target"), F.col("q.quotation").alias("quotation"), F.col("q.quoteID").alias("quoteID"), F.array_join("mentions", "|").alias("target_mentions"))


def edges_by_range(quotes: DataFrame, mentions: DataFrame) -> DataFrame:
    """Edges from flat tables: quotes (article_id, quote_id, speaker, start_tok, end_tok), mentions (article_id, name, start_token, end_token).

    An equi-join on the article with the range as residual; per quotation and name the distinct mentions, joined by |.
    """
    q = quotes.where(is_person_speaker(F.col("speaker"))).distinct()
    m = mentions.where(~((F.col("end_token") - F.col("start_token") == 1) & is_faulty_token(F.trim("name")))).distinct()
    met = q.join(m, "article_id").where((F.col("start_token") >= F.col("start_tok")) & (F.col("start_token") < F.col("end_tok")))
    return met.groupBy("article_id", "quote_id", F.col("speaker").alias("source"), F.col("name").alias("target")).agg(F.array_join(F.array_sort(F.collect_list(F.format_string("%06d-%06d", "start_token", "end_token"))), "|").alias("target_mentions"))


def not_all_listed(mentions: Column, listed: Sequence[str]) -> Column:
    """Whether some |-part of the mentions isn't listed (case matters)."""
    return ~F.forall(F.split(mentions, r"\|"), lambda m: m.isin(list(listed)))


def drop_listed_nodes(edges: DataFrame, nodes: DataFrame, node: str, *columns: str) -> DataFrame:
    """Edges none of whose columns is a listed node, ignoring case; a null end stays."""
    small = nodes.select(F.lower(node).alias("_n")).distinct()
    for c in columns:
        edges = edges.join(small, F.lower(F.col(c)) == F.col("_n"), "left_anti")
    return edges


def filter_edges(edges: DataFrame, mention_list: Sequence[str], nodes: DataFrame, node: str) -> DataFrame:
    """Mention list, then listed targets, then listed sources."""
    return drop_listed_nodes(edges.where(not_all_listed(F.col("target_mentions"), mention_list)), nodes, node, "target", "source")


def drop_self_quotations(edges: DataFrame, keys: Sequence[str], source: str, target: str, by: str = "window") -> DataFrame:
    """Edges of groups (by keys) in which no edge has source = target; groups with a null key are dropped.

    by "window": one shuffle on the keys. by "anti": only the keys of self-quotations are shuffled against the edges,
    which is cheaper where they are few, and splits a hot key.
    """
    known = edges.where(" and ".join(f"`{k}` is not null" for k in keys))
    same = F.col(source).eqNullSafe(F.col(target))
    if by == "window":
        return known.withColumn("_self", F.bool_or(same).over(Window.partitionBy(*keys))).where("not _self").drop("_self")
    return known.join(known.where(same).select(*keys).distinct(), list(keys), "left_anti")


def resolve_redirects(redirects: DataFrame, source: str = "redirect", target: str = "target", max_rounds: int = 40) -> DataFrame:
    """(redirect, target) with every chain followed to its end by pointer doubling.

    A walk that would enter a node twice stops at the last unvisited one, so a cycle's nodes keep the node before
    themselves on it; a self-loop keeps itself. Rounds grow with the logarithm of the longest chain.
    """
    done = None
    base = cut(redirects.select(F.col(source).alias("s"), F.col(target).alias("t")).where("s is not null and t is not null").groupBy("s").agg(F.min("t").alias("t")))
    loops = base.where("s = t")
    # nodes that reach a cycle never end at a node without successor: find the others by doubling from ends backwards
    links = base.where("s <> t")
    pointer, known, last = links, links.select(F.col("s").alias("t")), None
    for _ in range(max_rounds):
        nxt = pointer.alias("a").join(pointer.alias("b"), F.col("a.t") == F.col("b.s"), "left")
        moved = cut(nxt.select(F.col("a.s").alias("s"), F.coalesce("b.t", "a.t").alias("t")))
        # every round ends some chain, if one is still open: what stays open runs into a cycle
        still = moved.join(known, "t", "left_semi").count()
        if still in (0, last):
            done = moved
            break
        pointer, last = moved, still
    if done is None:
        raise RuntimeError(f"redirects need more than {max_rounds} rounds")
    ended = done.join(links.select(F.col("s").alias("t")).unionByName(loops.select(F.col("s").alias("t"))).distinct(), "t", "left_anti").select("s", "t")
    at_loop = done.join(loops.select(F.col("s").alias("t")), "t", "left_semi").select("s", "t")
    stuck = links.join(ended, "s", "left_anti").join(at_loop.select("s"), "s", "left_anti")
    walked = _walk(stuck)
    out = ended.unionByName(at_loop).unionByName(walked).unionByName(loops)
    return out.select(F.col("s").alias(source), F.col("t").alias(target))


def _walk(links: DataFrame, max_steps: int = 1000) -> DataFrame:
    """Chains that run into a cycle, step by step with the nodes visited; cycles are short and rare."""
    state = cut(links.select("s", F.col("t").alias("at"), F.array("s").alias("seen"), F.lit(False).alias("over")))
    for steps in range(max_steps + 1):
        if state.where("not over").isEmpty():
            break
        if steps == max_steps:
            raise RuntimeError(f"a cycle of redirects has more than {max_steps} nodes")
        step = state.join(links.select(F.col("s").alias("from"), F.col("t").alias("to")), F.col("at") == F.col("from"), "left")
        stop = F.col("over") | F.col("to").isNull() | F.array_contains("seen", F.col("to")) | (F.col("to") == F.col("at"))
        state = cut(step.select("s", F.when(stop, F.col("at")).otherwise(F.col("to")).alias("at"), F.when(stop, F.col("seen")).otherwise(F.array_append("seen", F.col("at"))).alias("seen"), stop.alias("over")))
    return state.select("s", F.col("at").alias("t"))


def pagerank(edges: DataFrame, source: str, target: str, rounds: int = 15, damping: float = 0.85) -> DataFrame:
    """(node, rank) after `rounds` steps, edges weighted by their number; ranks sum to the number of nodes. An extension."""
    w = cut(edges.where(F.col(source).isNotNull() & F.col(target).isNotNull()).groupBy(F.col(source).alias("s"), F.col(target).alias("t")).agg(F.count("*").alias("n")))
    out = w.groupBy("s").agg(F.sum("n").alias("all"))
    share = cut(w.join(out, "s").select("s", "t", (F.col("n") / F.col("all")).alias("share")))
    nodes = cut(w.select(F.col("s").alias("node")).unionByName(w.select(F.col("t").alias("node"))).distinct())
    sinks = nodes.join(out.select(F.col("s").alias("node")), "node", "left_anti").withColumn("sink", F.lit(True))
    ranks = nodes.withColumn("rank", F.lit(1.0))
    for _ in range(rounds):
        lost = ranks.join(sinks, "node", "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        n = nodes.agg(F.count("*").alias("n"))
        got = share.join(ranks, F.col("s") == F.col("node")).groupBy("t").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        base = nodes.join(got, F.col("node") == F.col("t"), "left").crossJoin(F.broadcast(lost)).crossJoin(F.broadcast(n))
        ranks = cut(base.select("node", (F.lit(1 - damping) + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / F.col("n"))).alias("rank")))
    return ranks
