"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_ALNUM = r"[^\p{L}\p{N}]+"
BLANKS = r"\p{IsWhite_Space}+"
INK = r"[^\p{L}\p{N}\p{IsWhite_Space}]+"


def canonical(text: Column) -> Column:
    """Letters and digits in lower case, in order; nothing else. Null stays null."""
    return F.regexp_replace(F.lower(text), NOT_ALNUM, "")


def words(text: Column) -> Column:
    """What stands between Unicode blanks, lower case, letters and digits only, without empty words."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), INK, ""), BLANKS), lambda w: w != "")


def blank(text: Column) -> Column:
    """Whether nothing but Unicode blanks is in the text."""
    return ~text.rlike(r"\P{IsWhite_Space}")
