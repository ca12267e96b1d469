"""Restoring damaged and lower-cased tokens with a lexicon of the corpus."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import align_key, fills_encoding, fold_key, majority, wildcard_match

# fixed values: UTF-8 marks as Windows-1252 shows them, longest first
SHOWN = (("â€œ", "“"), ("â€™", "’"), ("â€\x9d", "”"), ("â€˜", "‘"), ("â€”", "—"), ("â€“", "–"), ("â€", "”"))


def lexicon(tokens: DataFrame, token: str) -> DataFrame:
    """(fold_key, surface, n): for each fold key its most frequent surface with non-ASCII characters, else its most frequent one.

    Surfaces of ASCII in lower case, and tokens without an ASCII letter or digit, are left out. Ties: the least surface.
    """
    t = tokens.select(F.col(token).alias("surface")).where("surface is not null").withColumn("fold_key", fold_key(F.col("surface"))).where("fold_key <> ''")
    plain = ~F.col("surface").rlike(r"[^\x00-\x7F]")
    n = t.where(~(plain & (F.col("surface") == F.lower("surface")))).groupBy("fold_key", "surface").agg(F.count("*").alias("n"))
    order = F.struct((~F.col("surface").rlike(r"[^\x00-\x7F]")).alias("ascii"), (-F.col("n")).alias("o"), F.col("surface"), F.col("n"))
    return n.groupBy("fold_key").agg(F.min(order).alias("m")).select("fold_key", "m.surface", "m.n")


def question_lexicon(lex: DataFrame) -> DataFrame:
    """Entries whose surface has a character that isn't ASCII."""
    return lex.where(F.col("surface").rlike(r"[^\x00-\x7F]"))


EDGES = r"^([\p{Punct}“”‘’«»]*?)(.*?)([\p{Punct}“”‘’«»&&[^?]]*)$"


def repair_questions(tokens: DataFrame, token: str, lex: DataFrame) -> DataFrame:
    """(token, repaired) of the distinct tokens with a question mark inside: by fold key, else by the only surface that fits.

    Edge punctuation is set aside and put back. A surface fits if it has the token's length and equals it ignoring case
    but at question marks, which stand for what isn't an ASCII letter or digit. Tokens that nothing fits stay.
    """
    damaged = tokens.select(F.col(token).alias("token")).where(F.col("token").rlike(r"\?.|.\?\p{L}")).distinct()
    core = F.regexp_extract("token", EDGES, 2)
    d = damaged.withColumn("core", core).withColumn("head", F.regexp_extract("token", EDGES, 1)).withColumn("tail", F.regexp_extract("token", EDGES, 3)).where(F.contains("core", F.lit("?")))
    q = question_lexicon(lex)
    exact = d.join(q, fold_key(F.col("core")) == F.col("fold_key")).where(fills_encoding(F.col("core"), F.col("surface"))).groupBy("token").agg(F.min("surface").alias("exact"))
    # the wildcard pass: both sides with a mark for whatever isn't an ASCII letter or digit, which the marks stand for
    blind = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", "?"))
    wide = d.select("token", "core", blind(F.col("core")).alias("form")).join(q.select("surface", blind(F.col("surface")).alias("form")), "form")
    wide = wide.where(wildcard_match(F.col("core"), F.col("surface")) & fills_encoding(F.col("core"), F.col("surface"))).groupBy("token").agg(F.countDistinct("surface").alias("k"), F.min("surface").alias("only")).where("k = 1")
    out = damaged.join(d.select("token", "head", "tail"), "token", "left").join(exact, "token", "left").join(wide.select("token", "only"), "token", "left")
    found = F.coalesce("exact", "only")
    return out.select("token", F.when(found.isNotNull(), F.concat("head", found, "tail")).otherwise(F.col("token")).alias("repaired"))


def apply_repairs(texts: DataFrame, id_col: str, tokens: str, repairs: DataFrame) -> DataFrame:
    """(id, text): tokens with repairs (token, repaired) applied, joined by blanks; texts without a question mark skip the join."""
    rows = texts.select(id_col, F.posexplode(tokens).alias("pos", "token")).join(repairs, "token", "left")
    parts = rows.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("repaired", "token").alias("t")))).alias("p"))
    return parts.select(id_col, F.array_join(F.transform("p", lambda x: x["t"]), " ").alias("text"))


def rejoin_garbled(x: Column) -> Column:
    """Marks of UTF-8 read as Windows-1252 restored, also where a tokeniser split them; real euro amounts stay.

    Order: split sequences are joined, shown sequences replaced, a euro sign before a letter or œ at a word's start dropped or made
    an opening mark, a left-over â at a word's end removed, and glued marks parted from words.
    """
    # fixed values: split sequences and what they stood for
    steps = (
        (r"â\s+€\s*œ", "“"), (r"â\s+€\s*™", "’"), (r"â\s+€\s*\x9d", "”"), (r"â\s+€\s*˜", "‘"), (r"(?i)â\s+(s|t|re|ve|ll|d)\b", "'$1"), (r"â\s+€", "”"),
    )
    out = x
    for pattern, to in steps:
        out = F.regexp_replace(out, pattern, to)
    for shown, mark in SHOWN:
        out = F.replace(out, F.lit(shown), F.lit(mark))
    for pattern, to in ((r"""(^|[\s“”"'])€œ""", "$1“"), (r"""(^|[\s“”"'])€(?=[A-Za-z])""", "$1"), (r"â(?=\s|$)", ""), (r"(\S)(“)", "$1 $2"), (r"(”)(?=[A-Za-z])", "$1 ")):
        out = F.regexp_replace(out, pattern, to)
    return F.when(x.rlike("[ÃÂâ€]"), out).otherwise(x)


def aligned(pairs: DataFrame, id_col: str, left: str, right: str) -> DataFrame:
    """(id, projected, coverage): the left words with the right ones where both sequences' align keys match in equal blocks.

    coverage is the share of left words so matched. Longest equal blocks have no relational form: Python, in Arrow batches.
    """

    def key(w: str) -> str:
        return "".join(c for c in w.lower() if c.isascii() and c.isalnum()) or w.lower()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, a, b in zip(frame.iloc[:, 0], frame.iloc[:, 1], frame.iloc[:, 2]):
                a, b = list(a if a is not None else []), list(b if b is not None else [])
                out, hit = list(a), 0
                for at, to, n in SequenceMatcher(None, [key(w) for w in a], [key(w) for w in b], autojunk=False).get_matching_blocks():
                    out[at : at + n] = b[to : to + n]
                    hit += n
                rows.append((k, out, hit / len(a) if a else 0.0))
            yield pd.DataFrame(rows, columns=[id_col, "projected", "coverage"])

    kind = pairs.schema[id_col].dataType.simpleString()
    return pairs.select(id_col, left, right).mapInPandas(run, f"`{id_col}` {kind}, projected array<string>, coverage double")


def ensemble(candidates: Column) -> Column:
    """Arrays of words of equal length, one per model: the majority word at each place, the first model's on ties."""
    n = F.size(F.get(candidates, 0))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: majority(F.transform(candidates, lambda c: F.get(c, i))))).otherwise(F.array().cast("array<string>"))


def word_scores(pairs: DataFrame, group: str, damaged: str, predicted: str, gold: str) -> DataFrame:
    """(group, n, ok, cased_n, cased_ok, damaged_n, damaged_ok) over aligned word arrays, and accuracies; 0 where there is nothing.

    Words count where predicted and gold have the same align key; cased ones are those with a capital in gold. Damaged:
    words that differ from gold by a question mark or garbling; they count whatever their key.
    """
    n = F.least(F.size(damaged), F.size(predicted), F.size(gold))
    zipped = F.slice(F.arrays_zip(F.col(damaged).alias("d"), F.col(predicted).alias("p"), F.col(gold).alias("g")), 1, n)
    w = pairs.where(n > 0).select(group, F.explode(zipped).alias("w")).select(group, "w.*")
    same, right, cased = align_key(F.col("p")) == align_key(F.col("g")), F.col("p") == F.col("g"), F.col("g").rlike(r"\p{Lu}")
    hurt = (F.col("d") != F.col("g")) & (F.contains("d", F.lit("?")) | F.col("d").rlike("[ÃÂâ�]"))
    tally = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    out = w.groupBy(group).agg(tally(same).alias("n"), tally(same & right).alias("ok"), tally(same & cased).alias("cased_n"), tally(same & cased & right).alias("cased_ok"), tally(hurt).alias("damaged_n"), tally(hurt & right).alias("damaged_ok"))
    rate = lambda a, b: F.coalesce(F.expr(f"try_divide({a}, {b})"), F.lit(0.0))
    return out.withColumns({"accuracy": rate("ok", "n"), "cased_accuracy": rate("cased_ok", "cased_n"), "damaged_accuracy": rate("damaged_ok", "damaged_n")})
