"""Garbled text from wrong decoding: a table of garbled forms of the clean corpus, joined with document tokens.

The corpus's words come in two sizes. Letters (every distinct non-ASCII character) are the units of UTF-8 that was
read as a single-byte encoding, once or twice, and of multi-byte Chinese that was read so; words serve where whole
words turn into other letters (one Cyrillic encoding read as another) or lose characters (replacement by "?" or
U+FFFD). Each garbled form leads to its originals; a document's look-alike tokens are equi-joined with the forms.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import combinations

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut

#: Encodings as which UTF-8 is read.
READ_AS = ("latin-1", "cp1252", "cp1251", "mac_roman", "cp437")
#: Single-byte chains for whole words: written in the first, read as the second.
WORD_CHAINS = (("cp1251", "cp1252"), ("koi8-r", "cp1251"), ("koi8-r", "cp1252"), ("cp866", "cp1251"), ("mac_cyrillic", "cp1251"))
CASES: dict[str, Callable[[str], str]] = {"as_is": str, "lower": str.lower, "upper": str.upper}
#: Letters from which one explained word is evidence enough; shorter ones may be clean words by chance.
SURE_WORD = 4
COMMON_AFTER = set("»«¡¿\xa0°£–—’“”„…€‚ª")
LATIN, CONTROLS = r"[À-ÖØ-öø-ÿ]", regex.compile("[\x80-\x84\x86-\x9f]")


def read(raw: bytes, encoding: str) -> str:
    """Bytes read as an encoding; what it leaves undefined becomes the control character of that number."""
    return "".join(_BYTES[encoding][b] for b in raw)


def _byte_table(encoding: str) -> list[str]:
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


_BYTES = {e: _byte_table(e) for e in {*READ_AS, *(e for chain in WORD_CHAINS for e in chain)}}


def _classes(encoding: str, case: Callable[[str], str]) -> str:
    """A pattern of one UTF-8 sequence of two bytes or more, as it looks when read so."""

    def of(first: int, last: int) -> str:
        chars = {c for b in range(first, last + 1) for c in {case(_BYTES[encoding][b])} if len(c) == 1}
        return "[" + "".join(regex.escape(c, special_only=False) for c in sorted(chars)) + "]"

    tail = of(0x80, 0xBF)
    return f"(?:{of(0xE0, 0xEF)}{tail}{{2}}|{of(0xF0, 0xF4)}{tail}{{3}}|{of(0xC2, 0xDF)}{tail})"


_UNITS = {(e, c): _classes(e, f) for e in READ_AS for c, f in CASES.items()}
_RUNS = {k: regex.compile(f"(?:{p})+") for k, p in _UNITS.items()}
_ONE = {k: regex.compile(p) for k, p in _UNITS.items()}
_CYRILLIC = regex.compile("[Ѐ-ӿ]{2,}")
_HIGH = regex.compile(rf"(?<![A-Za-zÀ-ÿ]){LATIN}{{2,}}(?![A-Za-zÀ-ÿ])")
_PAIRS = regex.compile("(?:[\xa1-\xf7][\xa1-\xfe]){3,}")
_ASKED = regex.compile(r"[\p{L}’'-]*(?:\p{L}\?(?=\p{L})|(?<![\S])\?(?=\p{L}))[\p{L}’'?-]*\p{L}")
#: Blanks that came between the characters of a unit; what may stand alone after a letter counts only where no capital is before.
_ODD, _REST = "[©£°¼½¾±²³µ¶¸¹º¤¥¦§¨ª¬®¯´ƒ†‡ˆ‰‹›]", "[\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]"
_THREE = f"â(?: [€‚] ?| ?[€‚] ){_REST}"
_SPLIT = {"as_is": regex.compile(f"{_THREE}|(?<![A-ZÀ-Þ])[ÃÂ] {_REST}|[ÃÂ] {_ODD}"), "lower": regex.compile(f"{_THREE}|[ãâ] {_ODD}"), "upper": regex.compile(f"Â(?: [€‚] ?| ?[€‚] ){_REST}|[ÃÂ] {_ODD}")}
#: Double-byte punctuation read byte by byte.
_PUNCTUATION_PAIR = regex.compile("¡[¤¥¦§¨ª®¯°±²³´µ¶·¸¹]")
#: A question mark before a letter, after a letter, a blank or nothing.
_QUESTION = regex.compile(r"(?:(?<=\p{L})|(?<![\S])|^)\?(?=\p{L})")
_BEFORE, _AFTER = regex.compile(r"[\p{L}’']*$"), regex.compile(r"[\p{L}’']*")
_LOST = regex.compile(r"[\p{L}’'-]*�[\p{L}’'�-]*")


def case_of(text: str) -> str:
    """How the record's letters stand; a text that was changed in case after the damage needs forms of that case."""
    return "lower" if text == text.lower() else "upper" if text == text.upper() else "as_is"


def tokens(text: str) -> Iterator[tuple[int, int, str, str, bool]]:
    """(start, end, token, chain family, weak) of all look-alikes; runs of units give each stretch of up to four units."""
    case = case_of(text)
    if not text.isascii():
        for encoding in READ_AS:
            key = (encoding, case)
            for run in _RUNS[key].finditer(text):
                yield from _stretches(text, run.start(), [m.span() for m in _ONE[key].finditer(run.group())], encoding)
        for m in _SPLIT[case].finditer(text):
            yield *m.span(), m.group().replace(" ", ""), "unit", False
        for m in _CYRILLIC.finditer(text):
            yield *m.span(), m.group(), "word", False
        for m in _HIGH.finditer(text):
            yield *m.span(), m.group(), "word", False
        for m in _PAIRS.finditer(text):
            for at in range(m.start(), m.end(), 2):
                yield at, at + 2, text[at : at + 2], "pair", False
        if "�" in text:
            for m in _LOST.finditer(text):
                yield *m.span(), m.group().lower(), "lost", False
    if "?" in text:
        for m in _ASKED.finditer(text):
            yield *m.span(), m.group().lower(), "asked", False


def _stretches(text: str, at: int, units: list[tuple[int, int]], encoding: str) -> Iterator[tuple[int, int, str, str, bool]]:
    n = len(units)
    for i in range(n):
        for j in range(i, min(i + 6, n)):
            start, end = at + units[i][0], at + units[j][1]
            weak = False
            if n == 1:
                before, after = text[start - 1 : start], text[end : end + 1]
                lead, last = text[start], text[end - 1]
                same_case = before.isalpha() and before.isupper() == lead.isupper()
                if encoding in ("latin-1", "cp1252"):
                    weak = end - start == 2 and last in COMMON_AFTER and same_case and not after.isalnum()
                elif encoding == "cp1251":
                    weak = True
                else:
                    weak = end - start == 2 and lead in "“”‘’–—"
            yield start, end, text[start:end], "unit", weak
            if weak:  # the unit alone may be clean text; the word around it tells
                s, e = start - len(_BEFORE.search(text[max(0, start - 40) : start]).group()), end + len(_AFTER.match(text, end).group())
                if (s, e) != (start, end):
                    yield s, e, text[s:e], "whole", False


def signs(text: str) -> Iterator[tuple[str, str]]:
    """(token, family) of what stands for characters by itself: U+FFFD, C1 controls, halved punctuation, and question marks with their neighbours.

    Question marks count inside words and before them, where no sentence can end: before a small letter if the text has
    both letter cases, before 's and 't, and at the beginning of the text.
    """
    if "�" in text:
        yield "�", "hole"
    if not text.isascii():
        yield from ((c, "control") for c in set(CONTROLS.findall(text)))
        yield from ((m, "mark") for m in set(_PUNCTUATION_PAIR.findall(text)))
    if "?" in text:
        cased = case_of(text) == "as_is"
        for m in _QUESTION.finditer(text):
            i = m.start()
            before, after = text[i - 1 : i] if i else "", text[i + 1]
            if (cased and after.islower()) or i == 0 or (before.isalpha() and after in "st" and not text[i + 2 : i + 3].isalpha()):
                yield gap(before, after), "gap"


def gap(before: str, after: str) -> str:
    """A lost character by its neighbours, in lower case; ^ stands for no letter before it."""
    return f"{before.lower() if before.isalpha() else '^'}?{after.lower()}"


def _letter_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Garbled forms of single characters."""
    for batch in batches:
        rows: set[tuple[str, str, str, str]] = set()
        for c in batch.column(0).to_pylist():
            raw = c.encode("utf-8", "replace")
            once = {e: read(raw, e) for e in READ_AS}
            twice = {f"{e}+{e}": read(g.encode(), e) for e, g in once.items()} | {"latin-1+cp1252": read(once["latin-1"].encode(), "cp1252")}
            for chain, g in (once | twice).items():
                rows |= {(f(g), f(c), f"utf-8>{chain}", k) for k, f in CASES.items()}
            for e in ("gbk", "big5", "euc_jp"):
                try:
                    pair = c.encode(e)
                except UnicodeEncodeError:
                    continue
                if len(pair) == 2 and min(pair) > 0xA0:
                    shown = pair.decode("latin-1")
                    rows.add((shown, c, f"{e}>latin-1", "as_is"))
                    if shown[0] == "¡":
                        rows.add((shown, c, f"{e}>mark", "as_is"))
            # single bytes of the letter: controls as Latin-1 shows them, and what UTF-8 doesn't allow
            single = {b for e in ("latin-1", "cp1252", "cp1251") for b in [c.encode(e, "ignore")] if b and b.decode("utf-8", "replace") == "�"}
            rows |= {("�", c, "bytes>hole", "as_is") for _ in single}
            rows |= {(chr(b), c, "bytes>control", "as_is") for b in {*raw, *(x[0] for x in single)} if CONTROLS.match(chr(b))}
        columns = zip(*sorted(rows)) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in columns], ["form", "original", "chain", "kase"])


def _lost_forms(word: str, mark: str) -> list[str]:
    """The word with its non-ASCII characters replaced: all of them, and, as damage may be partial, any subset of up to four or else each one."""
    at = [i for i, c in enumerate(word) if c > "\x7f"]
    sets = [s for k in range(1, len(at) + 1) for s in combinations(at, k)] if len(at) <= 4 else [tuple(at), *((i,) for i in at)]
    return ["".join(mark if i in s else c for i, c in enumerate(word)) for s in map(set, sets)]


_PAIRED = regex.compile(r"[^\x00-\x7f]{2}")


def _word_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Garbled forms of whole words, with the word's frequency."""
    for batch in batches:
        rows = []
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for e, d in WORD_CHAINS:
                try:
                    g = read(word.encode(e), d)
                except UnicodeEncodeError:
                    continue
                rows += [(f(g), f(word), f"{e}>{d}", k, n) for k, f in CASES.items() if f(g) != f(word)]
            if all(map(str.isascii, _PAIRED.findall(word))):
                # words whose other letters stand alone, as one such unit may be clean text
                for e in READ_AS:
                    g = "".join(read(c.encode(), e) if c > "\x7f" else c for c in word)
                    rows += [(f(g), f(word), f"word:utf-8>{e}", k, n) for k, f in CASES.items()]
            low = word.lower()
            for chain, mark in (("ascii>?", "?"), ("latin-1>utf-8", "�")):
                rows += [(form, low, chain, "as_is", n) for form in _lost_forms(low, mark)]
        *columns, n = zip(*rows) if rows else ((), (), (), (), ())
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.string()) for x in columns), pa.array(n, pa.int64())], ["form", "original", "chain", "kase", "n"])


def forms(corpus: DataFrame, text: str) -> DataFrame:
    """Rows (form, original, chain, kase): the most frequent original of each garbled form of each chain.

    kase says whether the damaged text was turned to lower or upper case afterwards.

    Clean words are those without a look-alike of their own; characters that only garbled text has count as none. A
    form that is itself a word is kept only if its original is at least three times as frequent. Rows of the chain
    "clean" are the corpus's words themselves, in lower case, by which restored words are verified.
    """
    t = F.col(text)
    some = corpus.where(t.rlike(r"[^\x00-\x7f]")).select(t.alias("t"))
    letters = some.select(F.explode(F.array_distinct(F.split(F.regexp_replace("t", r"[\x00-\x9f�]+", ""), ""))).alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    letters = letters.where("c <> ''").select("c")
    char_forms = letters.mapInArrow(_letter_forms, "form string, original string, chain string, kase string").where("form <> original").distinct()
    # words of alphabets whose letters one byte can hold
    words = F.regexp_extract_all("t", F.lit(r"[\p{IsLatin}\p{IsCyrillic}’']+"), F.lit(0))
    found = some.select(F.explode(F.array_distinct(F.filter(words, lambda w: w.rlike(r"[^\x00-\x7f]")))).alias("w")).where("w <> '’'")
    counted = cut(found.where(F.length("w").between(2, 40)).groupBy("w").agg(F.count("*").alias("n")))
    # characters lost between letters, by their neighbours
    around = F.regexp_extract_all("t", F.lit(r"(?:^|\s|\p{IsLatin})[^\x00-\x9F�]\p{IsLatin}"), F.lit(0))
    near = some.select(F.explode(F.array_distinct(around)).alias("g")).distinct()
    head = F.when(F.left("g", F.lit(1)).rlike(r"^\p{L}$") & (F.length("g") == 3), F.lower(F.left("g", F.lit(1)))).otherwise("^")
    gaps = near.select(F.concat(head, F.lit("?"), F.lower(F.right("g", F.lit(1)))).alias("form"), F.substring("g", -2, 1).alias("original"))
    gaps = gaps.groupBy("form").agg(F.min("original").alias("original")).select("form", "original", F.lit("ascii>gap").alias("chain"), F.lit("as_is").alias("kase"))
    word_forms = counted.mapInArrow(_word_forms, "form string, original string, chain string, kase string, n long")
    one = word_forms.groupBy("form", "chain", "kase").agg(F.max(F.struct("n", "original")).alias("m")).select("form", "m.original", "chain", "kase", "m.n")
    kept = one.join(counted.select(F.col("w").alias("form"), F.col("n").alias("own")), "form", "left").where("own is null or n >= 3 * own").select("form", "original", "chain", "kase")
    clean = counted.select(F.lower("w").alias("form"), F.lower("w").alias("original"), F.lit("clean").alias("chain"), F.lit("as_is").alias("kase")).distinct()
    return cut(char_forms.unionByName(gaps).unionByName(kept).unionByName(clean))


def _look_alikes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records' look-alikes and signs; words and pairs by line, as damage may be partial."""
    for batch in batches:
        rows = []
        texts = batch.column(batch.num_columns - 1).to_pylist()
        for row, text in enumerate(texts):
            ends = [i for i, c in enumerate(text) if c == "\n"]
            seen = {(token, family, weak, bisect_left(ends, start) if family in ("word", "pair") else 0) for start, _, token, family, weak in tokens(text)}
            seen |= {(token, family, False, 0) for token, family in signs(text)}
            rows += [(row, *x) for x in sorted(seen)]
        at, token, family, weak, line = zip(*rows) if rows else ((), (), (), (), ())
        ids = [c.take(pa.array(at, pa.int64())) for c in batch.columns[:-1]]
        yield pa.RecordBatch.from_arrays([*ids, pa.array(token, pa.string()), pa.array(family, pa.string()), pa.array(weak, pa.bool_()), pa.array(line, pa.int32())], [*batch.schema.names[:-1], "token", "family", "weak", "line"])


#: Families that show damage but not what stood there.
SIGNS = ("hole", "control", "mark", "gap")
_FAMILY = "case when chain like 'utf-8>%' then 'unit' when chain like 'word:%' then 'whole' when chain like '%>hole' then 'hole' when chain like '%>control' then 'control' when chain like '%>mark' then 'mark' when chain like '%>gap' then 'gap' when chain = 'ascii>?' then 'asked' when chain = 'latin-1>utf-8' then 'lost' when chain like '%>latin-1' then 'pair' else 'word' end"


def _distinct_texts(records: DataFrame, keys: list[str], text: str) -> DataFrame:
    return records.where(F.col(text).isNotNull() & (F.col(text).rlike(r"[^\x00-\x7f]") | F.col(text).contains("?"))).select(*keys, F.col(text).alias("text"))


def matches(records: DataFrame, keys: list[str], text: str, table: DataFrame) -> DataFrame:
    """Rows (keys, token, family, weak, original, chain) of look-alikes that the table of forms explains."""
    some = _distinct_texts(records, keys, text)
    kinds = ", ".join(f"`{k}` {records.schema[k].dataType.simpleString()}" for k in keys)
    seen = some.mapInArrow(_look_alikes, f"{kinds}, token string, family string, weak boolean, line int").drop("line").distinct()
    best = table.where("chain <> 'clean'").withColumn("family", F.expr(_FAMILY)).where(~F.col("family").isin(*SIGNS))
    order = F.struct((F.col("kase") != "as_is").alias("changed"), F.length("original"), F.expr("case when chain like 'gbk%' then 0 else 1 end").alias("g"), "chain", "original")
    best = best.groupBy("form", "family").agg(F.min(F.struct(order.alias("o"))).alias("m")).select(F.col("form").alias("token"), "family", "m.o.original", "m.o.chain")
    return seen.join(best, ["token", "family"])


def damaged(records: DataFrame, keys: list[str], text: str, table: DataFrame) -> DataFrame:
    """Distinct keys of the damaged records.

    All evidence comes of the table: a record is damaged if the table explains one of its signs (SIGNS), a look-alike that
    isn't weak, the word around a weak one, three distinct weak ones, a word of SURE_WORD letters, or in a line three
    words (or pairs) that are at least half of such look-alikes there. Null texts and keys that are null are never damaged; pure ASCII
    without a question mark is skipped unread.
    """
    some = _distinct_texts(records, keys, text)
    kinds = ", ".join(f"`{k}` {records.schema[k].dataType.simpleString()}" for k in keys)
    seen = some.mapInArrow(_look_alikes, f"{kinds}, token string, family string, weak boolean, line int").distinct()
    best = table.where("chain <> 'clean'").select("form", F.expr(_FAMILY).alias("family")).distinct().withColumnRenamed("form", "token").withColumn("hit", F.lit(1))
    met = seen.join(best, ["token", "family"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    of = lambda c: F.sum(F.when(c, 1).otherwise(0))
    hit = F.col("hit") == 1
    sure = (F.col("family") == "word") & (F.length("token") >= SURE_WORD)
    sums = met.groupBy(*keys, "line").agg(
        of(hit & ((F.col("family").isin("unit", "whole", "asked", "lost", *SIGNS) & ~F.col("weak")) | sure)).alias("strong"), of(hit & F.col("weak")).alias("weak"),
        *(of(hit & (F.col("family") == f)).alias(f) for f in ("word", "pair")), *(of(F.col("family") == f).alias(f"all_{f}") for f in ("word", "pair")),
    )
    known = " and ".join(f"`{k}` is not null" for k in keys)
    return sums.where(known).where("strong > 0 or weak >= 3 or (word >= 3 and 2 * word >= all_word) or (pair >= 3 and 2 * pair >= all_pair)").select(*keys).distinct()


def _turned(text: str, chain: str) -> str:
    """A run of letters read in a chain's first encoding instead of its second, where that is possible."""
    written, seen = chain.split(">")
    back = {c: bytes([b]) for b, c in enumerate(_BYTES[seen])}
    try:
        return b"".join(back[c] for c in text).decode(written)
    except (KeyError, UnicodeDecodeError):
        return text


def _turned_spans(text: str, words: list[tuple[int, int, str | None]]) -> Iterator[tuple[int, int, str]]:
    """(start, end, restored) of the runs of letters that a word chain damaged.

    words: start, end and chain (None if unexplained) of the look-alike words. In a line with an explained word of
    SURE_WORD letters, or three, the line's commonest chain is reversed: in all runs if explained words are three times
    the others, else in runs that hold an explained word and in those between two such with at most two others there.
    """
    for line in regex.finditer(r"[^\n]+", text):
        inside = [w for w in words if line.start() <= w[0] < line.end()]
        hits = [w for w in inside if w[2]]
        if len(hits) < 3 and not any(e - s >= SURE_WORD for s, e, _ in hits):
            continue
        chain = Counter(w[2] for w in hits).most_common(1)[0][0]
        whole = len(hits) >= 3 * (len(inside) - len(hits))
        gap: list[tuple[int, int]] = []
        others, after = 0, False
        for m in regex.finditer(r"[^\x00-\x7f\s«»“”„—–…]+", text, pos=line.start(), endpos=line.end()):
            here = [w[2] for w in inside if m.start() <= w[0] < m.end()]
            if whole:
                yield *m.span(), _turned(m.group(), chain)
            elif any(here):
                if after and others <= 2:
                    yield from ((s, e, _turned(text[s:e], chain)) for s, e in gap)
                yield *m.span(), _turned(m.group(), chain)
                gap, others, after = [], 0, True
            else:
                gap.append(m.span())
                others += bool(here)


_NEW = regex.compile(r"[\p{L}’']+")


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, made = [], []
        for text, pairs in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
            known, families, chains = {}, Counter(), {}
            for p in pairs or []:
                known[p["token"], p["family"]] = p["original"]
                families[p["family"]] += 1
                if p["family"] == "word":
                    chains[p["token"]] = p["chain"]
            found = list(tokens(text))
            spans = [(s, -families[family], -e, known[token, family]) for s, e, token, family, _ in found if (token, family) in known and family != "word"]
            if chains:
                spans += [(s, -families["word"], -e, new) for s, e, new in _turned_spans(text, [(s, e, chains.get(token)) for s, e, token, family, _ in found if family == "word"])]
            parts, at, size, places = [], 0, 0, []
            for s, _, e, original in sorted(spans):
                if s >= at:
                    parts += [text[at:s], original]
                    size += s - at + len(original)
                    places.append(size - 1)
                    at = -e
            whole = "".join([*parts, text[at:]])
            words = [m for m in _NEW.finditer(whole) if not m.group().isascii()] if places else []
            out.append(whole)
            made.append(sorted({m.group().lower() for m in words if (i := bisect_left(places, m.start())) < len(places) and places[i] < m.end()}))
        columns = [*batch.columns[:-2], pa.array(out, pa.string()), pa.array(made, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-2], "restored", "made"])


def restore(records: DataFrame, keys: list[str], text: str, table: DataFrame) -> DataFrame:
    """Rows (keys, restored, made_words, verified_words) of the damaged records: each explained look-alike replaced by its original, longest first.

    made_words counts the distinct words with other than ASCII letters that a replacement made or changed, verified_words
    those of them that the clean corpus has. What no form explains stays as it is, so a record whose damage lost its
    letters comes back unchanged.
    """
    hurt = damaged(records, keys, text, table)
    pairs = matches(records, keys, text, table).join(hurt, keys, "left_semi").where("not weak")
    known = pairs.groupBy(*keys).agg(F.collect_set(F.struct("token", "family", "original", "chain")).alias("pairs"))
    first = records.where(F.col(text).isNotNull()).groupBy(*keys).agg(F.min(text).alias("text"))
    kinds = ", ".join(f"`{k}` {records.schema[k].dataType.simpleString()}" for k in keys)
    back = cut(first.join(hurt, keys, "left_semi").join(known, keys, "left").mapInArrow(_restored, f"{kinds}, restored string, made array<string>"))
    clean = table.where("chain = 'clean'").select(F.col("form").alias("word"))
    sure = back.select(*keys, F.explode("made").alias("word")).join(clean, "word").groupBy(*keys).agg(F.count("*").alias("verified_words"))
    return back.join(sure, keys, "left").select(*keys, "restored", F.size("made").alias("made_words"), F.coalesce("verified_words", F.lit(0)).alias("verified_words"))
