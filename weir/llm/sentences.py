"""Sentence units of texts in several languages and scripts.

A text's possible ends are its closing marks, blank lines and (Thai) spaces. A semi-Markov dynamic
program picks the whole spans between possible ends that score most in sum. A span is scored by

    how it opens    its first word (``_opening``)
    how it closes   its mark and its last word (``_closing``)
    its length      very short and very long spans lose (``_length_score``)
    its pairs       a span that begins or ends inside a pair of brackets or quotation marks loses
    its content     a span that is a number alone (of a claim or paragraph) loses

with the weights under ``WEIGHT``. Blank lines are ends by definition; between them the program is
free. Most ends need no search: adding an end to any choice of spans changes the sum by what it closes
and opens and by bounded terms, so an end beyond these bounds is in every best choice or in none
(``_settle``). The program runs over what is left, in time linear in the text. ``sentence_ends`` with
``prune=False`` leaves that step out and gives the same ends.

Each text is one row and is read whole; rows stream through ``mapInArrow``, nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weir.sources.session import ensure_importable

# Abbreviations after which a sentence goes on, in lower case and without the last mark.
NEVER_FINAL = set(
    """fig figs no nos nr abb abs tab tabl tabs vol vols ref refs sect sec cf vgl gem s ss ca env approx aprox pag pág págs num núm p pp
    eq eqs gl chap cap kap art bzw ggf evtl sog inkl exkl zzgl insb max mind vs dr prof mr mrs ms st ing sr sra d'env ex ej
    e.g i.e z.b d.h u.a c.-à-d p.ex p.ej viz resp para pos lit ziff rn tel सं डॉ क्र पृ मि.मी से.मी कि.मी मि""".split()
)
# Abbreviations that may also close a sentence.
MAY_BE_FINAL = set("etc usw usf suiv ff al hrs hr min mins sec secs a.m p.m ltd inc co corp jr m.p kg cm vol.% ब.व".split())
# Units that are also words, abbreviations only after a number.
AFTER_NUMBER = {"in", "ft", "lb", "lbs", "oz", "gal"}
# Words before a number that make its mark an ordinal's.
ORDINAL_BEFORE = set("am im der die das dem den des vom zum zur ab bis seit beim jeder jede jedes".split())
# Words in small letters that open sentences, and frequent opening words.
SMALL_OPENERS = {"pH", "iPhone", "eBay", "mRNA", "tRNA"}
OPENERS = set("the a an in at it is as each this that other thus unlike der die das ein eine im am wird bei wie dies andere le la les un une on il voir el los las una se como queda ¿está".split())

_LETTER = r"A-Za-zÀ-ÖØ-öø-ÿĀ-ɏ"
_CJK = "぀-ヿ㐀-鿿豈-﫿ｦ-ﾝ"
_MARKS = re.compile(
    "(?:(?<=[" + _CJK + ")）」』”℃])[.．](?=[0-9０-９])|[.．](?![0-9０-９.．])|[.．]{2,}|[?!？！]+[.?!？！]*|[。｡।॥…]+[。｡।॥…？！?!]*|(?<=[ऀ-ॿ)\"”])[ ]?\\|(?![|\\w]))"
    "(?:[\"'”’“»«」』›]+|[   ]»)?"
)
_THAI = re.compile("(?<=[ก-๎])[  ]+(?=[ก-๎])")
_BLANK = re.compile(r"\n[^\S\n]*\n\s*")
_LINE = r"\n(?![^\S\n]*\n)"
_QUOTED = re.compile("|".join(f"{a}(?:[^{b}\n]|{_LINE})*[{c}]" for a, b, c in (("„", "„“”", "“”"), ("“", "“”", "”"), ("«", "«»", "»"), ("「", "「」", "」"), ("『", "『』", "』"), ('"', '"', '"'))))
_BRACKET = re.compile(r"[()（）\[\]]|\n[^\S\n]*\n")
_CLOSED_BY = {")": "(", "）": "（", "]": "["}
_LIST_LABEL = re.compile(r"[\s(][a-z]\)$")
_WORD_AFTER = re.compile(r"[^\s.,;:!?]+")
_STRAY = re.compile(r"\s+(?=\S)")
_LABEL = re.compile(r"\d+[.．)](?!\d)")
_BREAKS_WORD = frozenset("(（[“”„«»\"「」")
_ALPHA = re.compile(rf"[{_LETTER}ऀ-ॿ][{_LETTER}ऀ-ॿ'’-]*$")
_FULL_STOP = set(".．")
_STRONG = set("。｡।॥|")
_CLOSERS = "\"'”’“»«」』›"

#: What spans score, as log-odds: stated, not fitted, for there are no labelled texts.
WEIGHT = {
    # the first word of a span
    "open_label": 8.0, "open_word": 5.0, "open_capital": 4.0, "open_digit": 3.0, "open_caseless": 3.0, "open_after_stray": 3.0, "open_symbol": 0.0, "open_small": -4.0, "open_joint": -30.0,
    # the mark and the last word of a span
    "close_strong": 20.0, "close_question": 6.0, "close_dots": 0.0, "close_dots_joined": -6.0, "close_quotation": 1.0, "close_quotation_caseless": -30.0,
    "close_word": 6.5, "close_short_word": 4.0, "close_joined": 4.0, "close_short_joined": -1.0, "close_symbol": 6.0,
    "close_number": 3.0, "close_number_caseless": 6.0, "close_number_joined": -3.0, "close_unit": 0.0, "close_short_caseless": 2.0,
    "close_may_be_final": -1.0, "close_initial": -9.0, "close_dotted": -9.0, "close_never": -30.0, "close_thai_space": 20.0,
    # the whole span
    "torn": -20.0, "number_alone": -20.0, "short": -1.5, "long": -2.0,
}
#: Scores are summed as whole numbers of this unit.
UNIT = 400
#: Characters below which a span is short, from which it gets long, and from which it gets no longer.
SHORT, LONG, LONGEST = 8, 400, 1200
#: The least and most that lengths change when an end is added: two long spans for one that is not,
#: and the reverse.
LENGTH_LOSS, LENGTH_GAIN = 4 * UNIT, 2 * UNIT


def _inside(starts: list[int], ends: list[int], at: int) -> int:
    """The end of the pair that holds position ``at``, or 0."""
    i = bisect_right(starts, at) - 1
    return ends[i] if i >= 0 and at < ends[i] else 0


def _quoted(text: str) -> tuple[list[int], list[int]]:
    starts, ends = [], []
    for m in _QUOTED.finditer(text):
        starts.append(m.start())
        ends.append(m.end())
    return starts, ends


def _bracketed(text: str) -> tuple[list[int], list[int]]:
    """The outermost brackets of any length, each kind by itself; none goes on over a blank line. The
    bracket of a list's label, as in "b)", takes the one it would close with it and encloses nothing."""
    open_at: dict[str, list[int]] = {"(": [], "（": [], "[": []}
    spans: list[tuple[int, int]] = []
    for m in _BRACKET.finditer(text):
        c = m[0]
        if c in open_at:
            open_at[c].append(m.start())
        elif c not in _CLOSED_BY:
            for held in open_at.values():
                held.clear()
        elif open_at[_CLOSED_BY[c]]:
            start, end = open_at[_CLOSED_BY[c]].pop(), m.end()
            if c == ")" and end - start > 4 and _LIST_LABEL.search(text, max(start + 1, end - 3), end):
                continue
            while spans and spans[-1][1] > start:  # inside, or crossing with another kind
                start = min(start, spans.pop()[0])
            spans.append((start, end))
    return [x for x, _ in spans], [x for _, x in spans]


def _opening(text: str, at: int, latin: bool = False, peek: bool = True) -> float:
    """How much the text at ``at`` looks like the start of a sentence. A stray word of another script
    or in small letters (machine translation leaves them) is looked past: the next word may open one.
    ``latin``: whether the text before is in letters with case."""
    c = text[at]
    if c.isupper() or c in "¿¡„«“\"「【[(（•§":
        m = _WORD_AFTER.match(text, at)
        return WEIGHT["open_word"] if m and m[0].lower() in OPENERS else WEIGHT["open_capital"]
    if c.isdigit() or c in "∑√$<":
        return WEIGHT["open_label"] if peek and _LABEL.match(text, at) else WEIGHT["open_digit"]
    if c.islower() or (latin and c.isalpha()):
        m = _WORD_AFTER.match(text, at)
        if m and m[0] in SMALL_OPENERS:
            return WEIGHT["open_word"]
        stray = _STRAY.match(text, m.end()) if peek and m else None
        if stray and text[stray.end()].isupper():
            own = _WORD_AFTER.match(text, stray.end())
            if own and own[0].lower() in OPENERS:
                return WEIGHT["open_after_stray"]
        if not c.islower() and stray:
            return _opening(text, stray.end(), latin, False)
        return WEIGHT["open_small"]
    return WEIGHT["open_caseless"] if c.isalpha() else WEIGHT["open_symbol"]


def _is_cjk(c: str) -> bool:
    return "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "豈" <= c <= "﫿"


def _cased(c: str) -> bool:
    return c.lower() != c.upper()


class Mark(NamedTuple):
    """A possible end: ``begin``..``bare`` is the closing mark, ``end`` includes closing quotation
    marks, ``after`` is where the text goes on, ``word`` is where the last word before the mark begins,
    ``pieces`` whether its parts between full stops are all of one or two characters, ``quoted``
    whether it lies in a pair of quotation marks."""

    begin: int
    mark: str
    bare: int
    end: int
    after: int
    word: int
    pieces: bool
    quoted: bool


def _previous(text: str, at: int) -> int:
    """The end of the last word before ``at``."""
    while at and text[at - 1].isspace():
        at -= 1
    return at


def _ordinal(text: str, word: int) -> bool:
    """Whether the word before ``word`` makes a number an ordinal. Longer words are in no list."""
    stop = _previous(text, word)
    begin = stop
    while begin and stop - begin <= _LONGEST_BEFORE and text[begin - 1].isalpha():
        begin -= 1
    return text[begin:stop].lower() in ORDINAL_BEFORE


def _boundary(text: str, m: Mark) -> tuple[float, float]:
    """(what closes at ``m.end``, what opens at ``m.after``)."""
    nxt = text[m.after]
    gap = m.after > m.end
    if nxt in ",;)）" or (not gap and nxt in ":]-–/%=*+·、，；："):
        return 0.0, WEIGHT["open_joint"]
    if m.end > m.bare and m.quoted:  # a quotation ends here: does the sentence go on?
        latin = _cased(text[m.begin - 1 : m.begin])
        if (_is_cjk(nxt) and not latin) or "ऀ" <= nxt <= "ॿ":
            return WEIGHT["close_quotation_caseless"], WEIGHT["open_caseless"]
        return WEIGHT["close_quotation"], _opening(text, m.after, latin)
    head = m.mark[0]
    if head in _STRONG:
        return WEIGHT["close_strong"], WEIGHT["open_symbol"]
    if head not in _FULL_STOP:
        return WEIGHT["close_dots" if head == "…" else "close_question"], _opening(text, m.after)
    if len(m.mark.rstrip(_CLOSERS + " ")) > 1:  # an ellipsis
        return WEIGHT["close_dots" if gap else "close_dots_joined"], _opening(text, m.after)
    return _full_stop(text, m, nxt, gap)


def _full_stop(text: str, m: Mark, nxt: str, gap: bool) -> tuple[float, float]:
    """``_boundary`` of a single full stop: what the last word says."""
    never = WEIGHT["close_never"], 0.0
    if m.word == m.begin:  # no word before it
        before = text[m.begin - 1] if m.begin else ""
        joined = before and before in ")）\"”»」』℃" and (_is_cjk(nxt) or nxt in "[【")
        return (WEIGHT["close_symbol"], _opening(text, m.after)) if gap or joined else never
    last = text[m.begin - 1]
    small = m.begin - m.word <= _LONGEST_WORD  # longer words are in no list
    word = text[m.word : m.begin] if small else text[m.begin - _LONGEST_WORD : m.begin]
    if last.isdigit():
        number = text[m.word : m.begin].isdigit()
        if not gap:
            if _is_cjk(nxt) or nxt in "[【":
                return WEIGHT["close_number_caseless"], _opening(text, m.after)
            return (WEIGHT["close_number_joined"], _opening(text, m.after)) if nxt.isupper() else never
        if number and nxt.isupper() and _ordinal(text, m.word):
            return never
        return WEIGHT["close_number"], _opening(text, m.after, True)
    if _is_cjk(last) or (_is_cjk(nxt) and not gap):
        few = small and word.isascii() and len(word) < 3
        return WEIGHT["close_short_caseless" if few else "close_strong"], _opening(text, m.after)
    low = word.lower().lstrip("'’„“‚-–")
    low = low[low.rfind("/") + 1 :]
    if low in NEVER_FINAL or (low.startswith("d'") and low[2:] in NEVER_FINAL):
        return never
    dotted = "." in word or not small and text.find(".", m.word, m.begin) >= 0
    if not gap:
        plain = _ALPHA.search(word)
        opens = nxt.isupper() or nxt in "¿¡„«[【" or text.startswith("pH ", m.after)
        if opens and plain and len(plain[0]) > 1 and (len(plain[0]) > 2 or plain[0].islower()) and not dotted and "=" not in word and "_" not in word:
            return WEIGHT["close_joined" if len(plain[0]) > 2 else "close_short_joined"], _opening(text, m.after)
        return never
    opens = _opening(text, m.after, _cased(last))
    if low in MAY_BE_FINAL:
        return WEIGHT["close_may_be_final"], opens
    if low in AFTER_NUMBER and text[_previous(text, m.word) - 1 : _previous(text, m.word)].isdigit():
        return WEIGHT["close_unit"], opens
    if len(low) == 1 and last.isalpha() and last.isascii():
        return WEIGHT["close_never" if dotted else "close_initial"], opens
    if "." in low and m.pieces:
        return WEIGHT["close_dotted"], opens
    return WEIGHT["close_word" if len(low) > 3 else "close_short_word"], opens


_LONGEST_BEFORE = max(map(len, ORDINAL_BEFORE))
_LONGEST_WORD = 2 * max(map(len, NEVER_FINAL | MAY_BE_FINAL | AFTER_NUMBER))


class End(NamedTuple):
    """A possible end with what spans gain by closing at ``at`` and opening after it, in units; torn
    pairs are counted in both. ``label``: where the number begins that is all of the last word, or -1."""

    at: int
    after: int
    closing: int
    opening: int
    label: int

    @property
    def score(self) -> int:
        return self.closing + self.opening


def _length_score(length: int) -> int:
    if length < SHORT:
        return round(WEIGHT["short"] * UNIT)
    return 0 if length < LONG else max(round(WEIGHT["long"] * UNIT), LONG - length)


def _span_score(begin: End, end: End) -> int:
    """The score of the span from where the text goes on after ``begin`` to ``end``."""
    score = begin.opening + end.closing + _length_score(end.at - begin.at)
    return score + round(WEIGHT["number_alone"] * UNIT) if end.label == begin.after else score


def _choose(points: list[End]) -> list[int]:
    """The ends of the best spans from the first point to the last; both are settled."""
    best, back = [0], [0]
    for j in range(1, len(points)):
        top, prev = None, 0
        for i in range(j):
            value = best[i] + _span_score(points[i], points[j])
            if top is None or value > top:
                top, prev = value, i
        best.append(top)
        back.append(prev)
    return _path(points, back)


def _path(points: list[End], back: list[int]) -> list[int]:
    chosen, j = [], len(points) - 1
    while j > 0:
        chosen.append(points[j].at)
        j = back[j]
    return chosen[::-1]


class _Zone:
    """The best of the begins that are ``low`` to ``high`` characters back; of equal ones the first.
    ``slope``: its scores fall by one unit a character."""

    def __init__(self, low: int, high: float, level: int, slope: bool) -> None:
        self.low, self.high, self.level, self.slope = low, high, level, slope
        self.next = 0
        self.line: deque[tuple[int, int, int]] = deque()

    def look(self, end: int, points: list[End], best: list[int], known: int) -> tuple[int, int] | None:
        """(value, begin) of the best among the first ``known`` begins."""
        while self.next < known and end - points[self.next].at >= self.low:
            i = self.next
            value = best[i] + points[i].opening + (points[i].at if self.slope else 0)
            while self.line and self.line[-1][0] < value:
                self.line.pop()
            self.line.append((value, i, points[i].at))
            self.next += 1
        while self.line and end - self.line[0][2] >= self.high:
            self.line.popleft()
        return (self.line[0][0] + self.level - (end if self.slope else 0), self.line[0][1]) if self.line else None


def _choose_long(points: list[End]) -> list[int]:
    """``_choose`` in linear time. A span's length scores by four zones, constant or falling by one unit
    a character, so the best begin of each will do; only the begin just before an end can leave a
    number alone, and is looked at by itself."""
    zones = [_Zone(0, SHORT, round(WEIGHT["short"] * UNIT), False), _Zone(SHORT, LONG, 0, False), _Zone(LONG, LONGEST, LONG, True), _Zone(LONGEST, float("inf"), round(WEIGHT["long"] * UNIT), False)]
    best, back = [0], [0]
    for j in range(1, len(points)):
        found = [x for z in zones if (x := z.look(points[j].at, points, best, j - 1))]
        options = [(v + points[j].closing, -i) for v, i in found] + [(best[j - 1] + _span_score(points[j - 1], points[j]), 1 - j)]
        top, prev = max(options)
        best.append(top)
        back.append(-prev)
    return _path(points, back)


#: Doubtful ends in a row beyond which the program takes the way that is linear in their number.
MANY = 64


def _best(points: list[End]) -> list[int]:
    return [points[1].at] if len(points) == 2 else _choose(points) if len(points) < MANY else _choose_long(points)


def _settle(points: list[End]) -> list[list[End]]:
    """Cuts a paragraph's points at the ends that are in every best choice, and leaves out those that
    are in none.

    Adding an end to a choice of spans changes the sum by its score and by what lengths change. A
    number alone takes more: an end that may leave one is not settled as an end, unless what it would
    leave alone is an end worth less. The first and the last point are ends by definition.
    """
    alone = -round(WEIGHT["number_alone"] * UNIT)
    kept = [points[0]]
    for p in points[1:-1]:
        loss = alone if len(kept) == 1 and p.label == kept[0].after else 0
        if p.score - loss >= -LENGTH_GAIN:
            kept.append(p)
    kept.append(points[-1])
    runs, run = [], [kept[0]]
    for i, p in enumerate(kept[1:-1], 1):
        follower = kept[i + 1]
        rival = max(0, follower.score + LENGTH_LOSS + LENGTH_GAIN) if follower.label == p.after and follower is not kept[-1] else 0
        last = follower is kept[-1] and follower.label == p.after
        run.append(p)
        if p.score > LENGTH_LOSS + rival and p.label != kept[i - 1].after and not last:
            runs.append(run)
            run = [p]
    return [*runs, [*run, kept[-1]]]


def _points(text: str, marks: list[tuple[int, int, str]], low: int, high: int, quotes: tuple, brackets: tuple) -> list[End]:
    """The possible ends among ``marks`` of the paragraph ``low``..``high``, in order."""
    found: list[End] = []
    torn = round(WEIGHT["torn"] * UNIT)
    word = seen = low
    pieces, size = True, 0
    for begin, end, mark in marks:
        if not mark:
            inside = _inside(*quotes, begin) or _inside(*brackets, begin)
            found.append(End(begin, end, round(WEIGHT["close_thai_space"] * UNIT) + (torn if inside else 0), torn if inside else 0, -1))
            continue
        if end >= high:
            continue
        if mark[0] == " ":
            begin, mark = begin + 1, mark[1:]
        bare = begin + len(mark.rstrip(_CLOSERS).rstrip(" \u00a0\u202f")) if mark[-1] in _CLOSERS else end
        quote = _inside(*quotes, begin)
        if bare < end and not quote:
            end, mark = bare, text[begin:bare]  # quotation marks that open the next sentence
        elif quote and quote < end:
            end = quote
        after = end
        while text[after].isspace():
            after += 1
        at = begin
        while at > seen and not (text[at - 1].isspace() or text[at - 1] in _BREAKS_WORD):
            at -= 1
        if at > seen:
            word, pieces = at, True
        pieces = pieces and all(len(x) <= 2 for x in text[max(word, seen) : begin].split("."))
        seen = max(seen, min(end, begin + 1))
        closing, opening = _boundary(text, Mark(begin, mark, bare, end, after, min(word, begin), pieces, bool(quote)))
        cost = torn if quote > end or _inside(*brackets, begin) else 0
        digits = begin > word and text[begin - 1].isdigit() and text[word:begin].isdigit()
        found.append(End(end, after, round(closing * UNIT) + cost, round(opening * UNIT) + cost, word if digits else -1))
        if closing + opening > 0 and not cost:
            word = seen = after
            pieces = True
    return found


def sentence_ends(text: str, prune: bool = True) -> list[int]:
    """The end (exclusive, in code points) of every sentence unit of ``text``, in order.

    ``prune=False`` runs the program over every possible end; the result is the same.
    """
    size = len(text.rstrip())
    if not size:
        return []
    quotes, brackets = _quoted(text), _bracketed(text)
    marks: list[tuple[int, int, str]] = [(m.start(), m.end(), m[0]) for m in _MARKS.finditer(text, 0, size)]
    if not text.isascii() and _THAI.search(text):
        marks += [(m.start(), m.end(), "") for m in _THAI.finditer(text, 0, size)]
        marks.sort()
    found: list[int] = []
    low = len(text) - len(text.lstrip())
    at = 0
    for blank, high in [*((m.start(), m.end()) for m in _BLANK.finditer(text, 0, size)), (size, size)]:
        if blank < low:
            continue
        stop = _previous(text, blank)
        first = at
        while at < len(marks) and marks[at][0] < stop:
            at += 1
        if stop > low:
            edge = End(low, low, 0, 0, -1), End(stop, stop, 0, 0, -1)
            inner = _points(text, marks[first:at], low, stop, quotes, brackets)
            points = [edge[0], *inner, edge[1]]
            for run in _settle(points) if prune else [points]:
                found += _best(run)
        low = high
    return found


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        rows: list[int] = []
        ends: list[int] = []
        for i in range(batch.num_rows):
            value = texts[i]
            if value.is_valid:
                e = sentence_ends(value.as_py())
                ends += e
                rows += [i] * len(e)
        at = np.asarray(rows, dtype=np.int64)
        stops = np.asarray(ends, dtype=np.int32)
        number = np.zeros(len(at), dtype=np.int32)
        if len(at):
            first = np.r_[True, at[1:] != at[:-1]]
            number = (np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))).astype(np.int32)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(number), pa.array(stops)], names=["_id", "unit_no", "end_pos"])


def sentence_units(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, unit_no, end_pos), one row per sentence unit; end_pos counts code points.

    Null, empty and blank texts have no units; a repeated id gives its units each time.
    """
    ensure_importable(df.sparkSession)
    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(df[doc_id].alias("_id"), df[text].alias("_text")).mapInArrow(_run, f"_id {kind}, unit_no int, end_pos int").withColumnRenamed("_id", doc_id)
