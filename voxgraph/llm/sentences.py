"""Sentence boundaries across languages: a linear-chain model over characters with Viterbi decoding.

A character's tag is B (a sentence begins here) or I. Where a script marks sentence ends, only a character that
follows an end mark, outside quotations and brackets that lie within a sentence, may be B; its score comes from a
logistic model of the words around, and from learned transitions: the tag of the place before and the distance to it. Where a script has no end marks (Thai and the like), every character may be B, and
its score comes from the characters around, learnt on text whose blanks were stripped. Both are trained here, on a
bounded sample of the texts: the labels come from places where letter case, or a blank between letters, leaves no
doubt, and each example is also seen without these cues, so that the model holds where they are missing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import READ_AS, read
from .textforms import blank

#: Texts on which the model is fitted, and weights it has.
SAMPLE, SIZE = 20_000, 1 << 18
#: Features of a place that don't look at letter case; they come first.
CASELESS = 9
SPACE, SPACE_RUN = r"\s", r"[\s\u200b]+"
_GARBLED = {}
for _c in "“”„«»‹›「」『』。！？…।؟":
    for _e in READ_AS:
        _GARBLED.setdefault(read(_c.encode(), _e), _c)
        for _g in (read(_c.encode(), _e), read(read(_c.encode(), _e).encode(), _e)):
            for _f in (str, str.lower, str.upper):
                _GARBLED.setdefault(_f(_g), _c)
_GARBLE = regex.compile("|".join(regex.escape(g) for g in sorted(_GARBLED, key=len, reverse=True) if len(g) > 1))
_MARK = regex.compile(r"(?:\.|!|\?|。|！|？|…|।|॥|؟|۔|｡)+")
_CLOSE = regex.compile(r"[”»\"'’)\]}」』›“]+")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}][\p{L}\p{M}\p{N}'’.-]*")
_PREV = regex.compile(r"[\p{L}\p{M}\p{N}][\p{L}\p{M}\p{N}'’.-]*$")
_URL = regex.compile(r"(?:https?:|www\.)[^\s]*[\p{L}\p{N}/]", regex.I)
_THAI = r"[฀-໿က-႟ក-៿]"
_UNMARKED = regex.compile(_THAI)
_QUOTE_MARKS = regex.compile(r"``|''|[“”„«»‹›「」『』()\[\]\"]")
_HEAD = regex.compile(rf"[{SPACE}–—-]*")
_GAP, _ONE_GAP, _GAP_OR_END = regex.compile(rf"[{SPACE}]*"), regex.compile(rf"[{SPACE}]"), regex.compile(rf"[{SPACE}]|$")
_BLANKS = regex.compile(rf"{SPACE}+")
_ALNUM, _LETTERS = regex.compile(r"[\p{L}\p{N}]"), regex.compile(r"\p{L}+")
_OPENER = regex.compile(r"[“«„「『\"'`(\[‹¿¡–—-]*")
_PAIRS = {"“": "”", "«": "»", "„": "“”", "「": "」", "『": "』", "‹": "›", "(": ")", "[": "]", "»": "«", "``": "''", "''": "''"}


def plain_marks(text: str) -> tuple[str, list[int]]:
    """The text with garbled quotation and end marks replaced by what they stood for, and each character's old offset."""
    if not _GARBLE.search(text):
        return text, list(range(len(text) + 1))
    out, at, places = [], 0, []
    for m in _GARBLE.finditer(text):
        places += range(at, m.start() + 1)
        out.append(text[at : m.start()] + _GARBLED[m.group()])
        at = m.end()
    places += range(at, len(text) + 1)
    return "".join([*out, text[at:]]), places


def nested(text: str) -> np.ndarray:
    """Whether each character lies in a quotation or bracket that is itself part of a sentence.

    Marks that enclose the whole text, and marks without a partner, enclose nothing.
    """
    marks = [(m.start(), m.group()) for m in _QUOTE_MARKS.finditer(text)]
    if len(marks) < 2:
        return np.zeros(len(text) + 1, bool)
    stack: list[tuple[int, str]] = []
    spans = []
    for at, mark in marks:
        before, after = text[at - 1 : at], text[at + len(mark) : at + len(mark) + 1]
        opened = next((i for i in range(len(stack) - 1, -1, -1) if mark in _closers(stack[i][1])), None)
        opens = mark in _PAIRS or mark == '"'
        if mark in ('"', "''"):
            opens = (not before or before.isspace() or before in "“«„(「'\"`-–—") and bool(after) and not after.isspace()
        elif mark == "“" and opened is not None:
            opens = bool(after) and (after.isalnum() or after in "“«\"'") and (not before or before.isspace() or before in "“«\"'`")
        elif mark == "»":
            opens = opened is None and (not before or before.isspace()) and after.isalnum()
        if opened is not None and not (opens and mark in ('"', "''", "“") and at - stack[opened][0] <= len(stack[opened][1])):
            spans.append((stack[opened][0], at + len(mark)))
            del stack[opened:]
        elif opens:
            stack.append((at, mark))
    head = _HEAD.match(text).end()
    inside = np.zeros(len(text) + 1, bool)
    edge = len(text)
    for start, end in sorted(spans):
        whole = not _ALNUM.search(text, head, start) and not _ALNUM.search(text, end, edge)
        if not whole:
            inside[start:end] = True
    return inside


def _closers(mark: str) -> tuple[str, ...]:
    """Marks that may close one; straight and curly double quotes close each other, as either may have been rewritten."""
    return ('"', "”") if mark == '"' else ("''", '"') if mark in ("``", "''") else (*_PAIRS.get(mark, ""), '"') if mark in "“„" else tuple(_PAIRS.get(mark, ""))


def places(text: str) -> Iterator[tuple[int, dict[str, str]]]:
    """Offsets where a sentence may begin after an end mark, with what stands around."""
    inside = nested(text)
    urls = [m.span() for m in _URL.finditer(text)] if "/" in text or "www." in text.lower() else []
    last = len(text.rstrip())
    while last and not _ALNUM.match(text, last - 1):
        last -= 1  # no sentence begins after the last letter or digit
    for m in _MARK.finditer(text):
        end = m.end()
        if any(a < m.start() < b for a, b in urls) or (text[end : end + 1].isdigit() and text[m.start() - 1 : m.start()].isdigit()):
            continue
        if inside[m.start()]:
            # the mark may be the last one of a quotation that ends its sentence
            close = _CLOSE.match(text, end)
            if not close or inside[min(close.end(), len(text))] and not _ONE_GAP.match(text, close.end()):
                continue
            if inside[close.end()] or _GAP.match(text, close.end()).end() >= len(text):
                continue
            end = close.end()
            closed = "2"
        else:
            close = _CLOSE.match(text, end)
            closed = "0"
            if close:
                stop = next((i for i in range(close.start(), close.end()) if inside[i] or text[i] == "“"), close.end())
                if stop == close.end() and not _GAP_OR_END.match(text, stop) and stop - end == 1 and text[end] in "\"'":
                    stop = end
                closed = "1" if stop > end else "0"
                end = stop
        gap = _GAP.match(text, end).end()
        if gap >= last:
            continue
        opener = _OPENER.match(text, gap).group()
        word = _WORD.search(text, gap, gap + 80)
        first = word.group() if word else ""
        second = _WORD.search(text, word.end(), word.end() + 60) if word else None
        before = _PREV.search(text[max(0, m.start() - 40) : m.start()])
        yield gap, {
            "mark": m.group()[:4], "gap": "1" if gap > end else "0", "closed": closed, "opener": opener[:1],
            "before": before.group() if before else "", "first": first, "second": second.group() if second else "",
        }


def _shape(word: str) -> str:
    return "u" if word[:1].isupper() else "l" if word[:1].islower() else "d" if word[:1].isdigit() else "o"


def _kind(word: str) -> str:
    if word.isdigit():
        return f"d{min(len(word), 4)}"
    bare = word.replace(".", "")
    return f"{'a' if '.' in word else ''}{min(len(bare), 5)}"


def feature_names(x: dict[str, str], cased: bool) -> list[str]:
    """Features of a place; those of letter case only if cased."""
    b, f, s = (x[k].lower().rstrip(".") for k in ("before", "first", "second"))
    base = [f"m{x['mark']}{x['gap']}{x['closed']}", f"o{x['opener']}", f"b{b}", f"k{_kind(b)}{x['mark']}", f"f{f}", f"fs{f} {s}", f"bf{b} {f}", f"k{_kind(b)}f{_kind(f)}{x['gap']}", f"c{x['closed']}f{f}"]
    if cased:
        base += [f"S{_shape(x['first'])}{x['mark'][:1]}", f"S{_shape(x['first'])}k{_kind(b)}", f"Sb{_shape(x['first'])}{b}", f"SS{_shape(x['before'])}{_kind(b)}{_shape(x['first'])}", f"G{x['gap']}{_shape(x['first'])}{_shape(x['before'])}"]
    return base


def features(x: dict[str, str], cased: bool) -> list[int]:
    """Hashed features."""
    return [crc32(v.encode()) % SIZE for v in feature_names(x, cased)]


def distance(words: int) -> int:
    """Class of a distance in words: 0, 1, 2, 3-4, 5-8, 9-16, more."""
    return min(6, words if words < 3 else (words - 1).bit_length() + 1)


def apart(text: str, at: Sequence[int], head: int = 0) -> list[int]:
    """Distance classes between places of a text, the first one's from its head."""
    ends = [head, *at]
    return [distance(len(_BLANKS.findall(text, a, b))) for a, b in zip(ends, ends[1:])]


def prior(x: dict[str, str]) -> float:
    """Score before any feature is known: a mark that only ends sentences is likely to, any other a little if a blank follows."""
    if x["closed"] == "2" or x["mark"][0] == "…":
        return -1.0
    return 2.0 if x["mark"][0] in "。！？।॥؟۔｡" else 0.5 if x["gap"] == "1" else -0.5


def is_cased(text: str) -> bool:
    """Whether capitals tell anything: letters of both cases, and most words with a letter case begin small or have no capital inside."""
    if text == text.lower():
        return False
    heads = [w for w in _LETTERS.findall(text) if w[0].islower() or w[0].isupper()]
    plain = sum(map(str.islower, heads))
    return any(map(str.isupper, text)) and 5 * plain >= 2 * len(heads) > 0


class Segmenter:
    """The fitted model; its size is fixed by SIZE and by the characters of unmarked scripts."""

    def __init__(self) -> None:
        self.weights = np.zeros(SIZE)
        #: Transition weights: what a boundary scores more after a place that was none (0) or one (1), by distance.
        self.chain = np.zeros((2, 7))
        self.chars: dict[str, float] = {}
        self.known: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def emission(self, x: dict[str, str], cased: bool) -> float:
        """Score of a boundary at a place by itself; weights of features met before are kept, a bounded number."""
        known, total = self.known, prior(x)
        for f in feature_names(x, cased):
            w = known.get(f)
            if w is None:
                if len(known) > 500_000:
                    known.clear()
                w = known[f] = float(self.weights[crc32(f.encode()) % SIZE])
            total += w
        return total

    def fit(self, texts: Sequence[str], abbreviations: Sequence[str] = (), rounds: int = 6) -> Segmenter:
        """Fits to texts; abbreviations, lower case, are known not to end a sentence before a name or number."""
        rows, labels, priors = [], [], []
        steps: list[tuple[int, int, int]] = []  # example, tag of the place before, distance
        small, dotted, bare = Counter(), Counter(), Counter()
        kept = []
        for text in texts:
            text = plain_marks(text)[0]
            if not is_cased(text):
                if not any(c.isupper() or c.islower() for c in text):
                    kept.append((text, list(places(text)), False))
                continue
            found = list(places(text))
            kept.append((text, found, True))
            for m in _WORD.finditer(text):
                w = m.group().rstrip(".")
                small[w] += w.islower()
                end = m.start() + len(w)
                (dotted if text[end : end + 1] == "." else bare)[w.lower()] += 1
                small["." + w.lower()] += text[end : end + 1] == "." and (text[end + 2 : end + 3].islower() or text[end + 2 : end + 3].isdigit())
        listed = set(abbreviations)
        begun = Counter(m.group().lower().rstrip(".") for text, _, cased in kept if cased for m in [_WORD.search(text)] if m)
        heads = {w for w, n in begun.items() if n >= max(3, len(kept) // 2000) and 5 * n >= dotted[w] + bare[w]}
        for text, found, cased in kept:
            before: int | None = 1
            for (_, x), gap in zip(found, apart(text, [at for at, _ in found])):
                label = self._label(x, cased, small, dotted, bare, listed, heads)
                if label is not None:
                    every = features(x, cased)
                    for seen in (every, every[:CASELESS]) if cased else (every,):
                        if before is not None:
                            steps.append((len(rows), before, gap))
                        rows.append(seen)
                        labels.append(label)
                        priors.append(prior(x))
                before = label
        if rows:
            y, offset = np.array(labels, float), np.array(priors)
            self._logistic(rows, y, offset, rounds)
            self._transitions(rows, y, offset, np.array(steps))
        self._fit_chars([t for t in texts if _UNMARKED.search(t)])
        return self

    @staticmethod
    def _label(x: dict[str, str], cased: bool, small: Counter, dotted: Counter, bare: Counter, listed: set[str], heads: set[str]) -> int | None:
        """1, 0, or None where the cues leave doubt. heads: words that mostly stand at the beginning of a text."""
        b, first = x["before"].rstrip("."), x["first"]
        low = b.lower()
        if x["closed"] == "2" and not (first[:1].isupper() or first[:1].islower()):
            return 0
        if x["mark"][0] in "。！？।॥؟۔｡":
            return 1 if x["closed"] == "0" else None
        short = len(b) == 1 and b.isalpha()
        abbreviated = low in listed or short or "." in b or (dotted[low] >= 3 and dotted[low] > 4 * bare[low] and (len(b) <= 2 or (len(b) <= 6 and (b[0].isupper() or small["." + low] >= 2 or not regex.search("[aeiouyаеёиоуыэюяäöüáéíóú]", low)))))
        if not cased:
            return 0 if x["mark"][0] == "…" else None if x["mark"] not in (".", "!", "?") else 0 if short else 1 if x["mark"] != "." or len(b) > 3 else None
        shape = _shape(first)
        if shape == "l":
            return 0
        if shape == "d" or not first:
            return 0 if abbreviated else None if x["gap"] == "0" else 1 if not b.isdigit() else None
        if x["gap"] == "0" and (len(b) < 2 or b[-1:].isdigit() or b.isupper()):
            return None if b[-1:].isdigit() else 0
        if x["mark"] == "." and b.isdigit() and len(b) <= 2:
            return 0 if x["gap"] == "1" and not small[first.lower()] else None
        word = first.lower().rstrip(".")
        if shape == "u" and len(word) > 1 and small[word] >= 2 and 5 * small[word] >= dotted[word] + bare[word]:
            return 1
        if x["mark"] == "." and abbreviated:
            return 0 if word not in heads else None if low in listed or short else 1
        return 1 if shape == "u" else None

    def _logistic(self, rows: list[list[int]], y: np.ndarray, offset: np.ndarray, rounds: int) -> None:
        """Adagrad over shuffled blocks of examples."""
        order = np.random.default_rng(7)
        lengths = np.array([len(r) for r in rows])
        flat, offsets = np.concatenate([np.array(r) for r in rows]), np.r_[0, np.cumsum(lengths)]
        squares = np.full(SIZE, 1e-3)
        for _ in range(rounds):
            for block in np.array_split(order.permutation(len(rows)), max(1, len(rows) // 256)):
                width = lengths[block]
                index = flat[np.repeat(offsets[block] - np.cumsum(width) + width, width) + np.arange(width.sum())]
                owner = np.repeat(np.arange(len(block)), width)
                score = offset[block] + np.bincount(owner, self.weights[index], len(block))
                slope = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y[block])[owner]
                met, at = np.unique(index, return_inverse=True)
                gradient = np.bincount(at, slope, len(met)) + 1e-4 * self.weights[met]
                squares[met] += gradient**2
                self.weights[met] -= 0.5 * gradient / np.sqrt(squares[met])

    def _transitions(self, rows: list[list[int]], y: np.ndarray, offset: np.ndarray, steps: np.ndarray, rounds: int = 30) -> None:
        """Weights of (tag before, distance) that explain what the places' own scores leave: Newton steps, one per cell.

        A cell's prior of 20 examples' weight keeps rare cells near 0.
        """
        if not len(steps):
            return
        example, cell = steps[:, 0], steps[:, 1] * 7 + steps[:, 2]
        own = np.array([offset[i] + self.weights[rows[i]].sum() for i in example])
        chain = np.zeros(14)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(own + chain[cell], -30, 30)))
            slope = np.bincount(cell, y[example] - p, 14) - 5 * chain
            chain += np.clip(slope / (np.bincount(cell, p * (1 - p), 14) + 5), -1, 1)
        self.chain = chain.reshape(2, 7)

    def _fit_chars(self, texts: list[str], rounds: int = 5) -> None:
        """Averaged structured perceptron on unmarked text without blanks; a blank between two letters was a boundary."""
        weights: Counter = Counter()
        totals: Counter = Counter()
        examples = [e for e in map(_stripped, texts) if e and e[1]]
        step = 1
        for _ in range(rounds):
            for line, gold in examples:
                step += 1
                guess = set(viterbi([weights_sum(weights, char_features(line, i)) for i in range(len(line))]))
                for i in gold ^ guess:
                    sign = 1 if i in gold else -1
                    for f in char_features(line, i):
                        weights[f] += sign
                        totals[f] += sign * step
        self.chars = {f: w - totals[f] / step for f, w in weights.items() if abs(w - totals[f] / step) > 1e-6}

    def starts(self, text: str) -> list[int]:
        """Offsets, in code points, of the first character of each sentence; none for a blank text."""
        head = _GAP.match(text).end()
        if head >= len(text):
            return []
        plain, back = plain_marks(text)
        cased = is_cased(plain)
        scores = {at: self.emission(x, cased) for at, x in places(plain)}
        if _UNMARKED.search(plain) and len(_UNMARKED.findall(plain)) * 2 > sum(map(str.isalpha, plain)):
            self._unmarked(plain, scores)
            order = sorted(scores)
            found = [order[i] for i in viterbi([scores[p] for p in order], order)]
        else:
            order = sorted(scores)
            found = [order[i] for i in best_path([scores[p] for p in order], self.chain[:, apart(plain, order)].T.tolist() if order else [])]
        return sorted({head, *(back[p] for p in found if back[p] > head)})

    def _unmarked(self, text: str, scores: dict[int, float]) -> None:
        """Scores of boundaries in a script without end marks: sure at a blank between letters, by the model elsewhere."""
        inside = nested(text)
        for at in list(scores):
            if text[:at].rstrip().endswith("."):
                del scores[at]  # only abbreviations have a full stop
        for m in regex.finditer(rf"(?<=[{_THAI[1:-1]}'\"”’]){SPACE_RUN}(?=[{_THAI[1:-1]}'\"“‘])", text):
            if not inside[m.start()] and _UNMARKED.search(text, m.end()):
                scores[m.end()] = 5.0
        line = [(i, c) for i, c in enumerate(text) if _UNMARKED.match(c) or c.isdigit() or c == "."]
        joined = "".join(c for _, c in line)
        for k in range(1, len(line)):
            i = line[k][0]
            if line[k - 1][0] == i - 1 and not inside[i]:
                score = weights_sum(self.chars, char_features(joined, k))
                if score > 0:
                    scores[i] = max(score, scores.get(i, score))


def _stripped(text: str) -> tuple[str, set[int]] | None:
    """An unmarked text without blanks, and where its sentences after the first begin; None if it has other letters."""
    if regex.search(r"[A-Za-z]", text):
        return None
    keep, gold = [], set()
    for m in regex.finditer(rf"{SPACE_RUN}|.", text.strip(), regex.S):
        c = m.group()
        if c.isspace() or not c.strip("\u200b"):
            rest = text.strip()[m.end() : m.end() + 1]
            if keep and _UNMARKED.match(keep[-1]) and _UNMARKED.match(rest):
                gold.add(len(keep))
        elif _UNMARKED.match(c) or c.isdigit() or c == ".":
            keep.append(c)
    return "".join(keep), gold


def char_features(line: str, i: int) -> list[str]:
    """Character n-grams on both sides of offset i."""
    left, right = line[max(0, i - 6) : i], line[i : i + 7]
    return [f"l{k}{left[-k:]}" for k in (1, 2, 3, 4, 6)] + [f"r{k}{right[:k]}" for k in (1, 2, 3, 5, 7)] + [f"x{left[-1:]}{right[:1]}", f"y{left[-2:]}{right[:2]}", f"z{left[-3:]}{right[:3]}", "*"]


def weights_sum(weights: dict[str, float], names: list[str]) -> float:
    return sum(weights.get(n, 0.0) for n in names)


def viterbi(scores: Sequence[float], offsets: Sequence[int] | None = None) -> list[int]:
    """Indices tagged B on the best path of the chain.

    Characters that may be B score as given, all others and the tag I score 0; B can't follow B on the next character.
    offsets are the characters' places; without them the characters are a whole text, whose first is not tagged.
    """
    inner, begin, back = 0.0, -1e18, []
    for i, s in enumerate(scores):
        apart = offsets is not None and (i == 0 or offsets[i] - offsets[i - 1] > 1)
        stay = max(inner, begin)
        new = -1e18 if offsets is None and i == 0 else (stay if apart else inner) + s
        back.append((begin > inner, apart and begin > inner))
        inner, begin = stay, new
    out, tag = [], begin > inner
    for i in range(len(scores) - 1, -1, -1):
        if tag:
            out.append(i)
        tag = back[i][1] if tag else back[i][0]
    return out[::-1]


def best_path(scores: Sequence[float], chain: Sequence[Sequence[float]]) -> list[int]:
    """Indices tagged B by Viterbi over places after end marks: tag I scores 0, tag B the place's score and its transition's.

    chain: per place the transition scores after a place tagged I and after one tagged B. A text's head is tagged B.
    """
    inner, begin, back = -1e18, 0.0, []
    for s, (after_inner, after_begin) in zip(scores, chain):
        stay = begin > inner
        up = begin + after_begin > inner + after_inner
        back.append((stay, up))
        inner, begin = max(inner, begin), s + max(inner + after_inner, begin + after_begin)
    out, tag = [], begin > inner
    for i in range(len(back) - 1, -1, -1):
        if tag:
            out.append(i)
        tag = back[i][tag]
    return out[::-1]


def train(texts: DataFrame, text: str, abbreviations: Sequence[str] = (), sample: int = SAMPLE) -> Segmenter:
    """A segmenter fitted to at most `sample` distinct texts, those of least hash."""
    some = texts.where(F.col(text).isNotNull() & ~blank(F.col(text))).select(text)
    share = min(1.0, 1.5 * sample / max(1, some.count()))
    some = some.where(F.pmod(F.xxhash64(text), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).distinct().orderBy(F.xxhash64(text), text).limit(sample)
    return Segmenter().fit([r[0] for r in some.collect()], abbreviations)


def sentence_starts(df: DataFrame, id_col: str, text: str, model: Segmenter) -> DataFrame:
    """Rows (id, sent_start), one per sentence of each distinct id; ids with null or blank texts have none.

    sent_start is the offset in code points of the sentence's first character that isn't blank. If an id occurs with
    several texts, that of the least hash counts. Texts are tagged where they lie; only the offsets are shuffled, to
    drop an id's repeated rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = [shared.value.starts(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(starts, pa.list_(pa.int32()))], [id_col, "_hash", "_starts"])

    rows = df.where(F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(id_col, F.xxhash64(text).alias("_hash"), text)
    tagged = rows.mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, _hash long, _starts array<int>")
    once = tagged.groupBy(id_col).agg(F.min(F.struct("_hash", "_starts")).alias("_m"))
    return once.select(id_col, F.explode("_m._starts").alias("sent_start"))
