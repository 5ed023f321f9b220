"""The program decides: it is exact, linear in long runs of doubtful ends, and not the boundaries' own scores."""

import random

import duckdb
import pytest

from weir.llm import sentences
from weir.llm.sentences import End, _choose, _choose_long, _span_score, sentence_ends


def test_initials_force_no_end():
    for many in (60, 64, 70, 400):
        text = "It was made by " + ", ".join(f"{chr(65 + i % 26)}. Berg" for i in range(many)) + "."
        assert sentence_ends(text) == [len(text)]


def _total(points, chosen):
    by = {p.at: p for p in points[1:]}
    path = [points[0], *[by[e] for e in chosen]]
    return sum(_span_score(a, b) for a, b in zip(path, path[1:], strict=False))


def test_linear_choice_against_the_full_program():
    r = random.Random(3)
    for _ in range(150):
        size = r.choice([60, 900, 5000])
        at = sorted(r.sample(range(5, size), min(size - 10, r.choice([3, 40, 150]))))
        points = [End(2, 2, 0, 0, -1)]
        for e in at:
            points.append(End(e, e, r.randint(-2500, 2500), r.randint(-2500, 2500), points[-1].after if r.random() < 0.3 else -1))
        points.append(End(size, size, 0, 0, points[-1].after if r.random() < 0.3 else -1))
        full, linear = _choose(points), _choose_long(points)
        assert linear[-1] == size and _total(points, full) == _total(points, linear)


@pytest.fixture(scope="module")
def texts():
    return [t for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE text IS NOT NULL").fetchall()]


def test_settled_ends_are_those_of_the_whole_program(texts):
    r = random.Random(8)
    pieces = ["The cam. ", "1. ", "2. A rod", "( ", ") ", '"', " e.g. x", "Mr. A. ", "no. 5. ", "in. ", "a.b. C", "? y ", "! ", "„", "“ ", "Fig. 2. ", "5.", " B. ", "etc. ", "a) ", ".", "。", "\n"]
    made = ["".join(r.choice(pieces) for _ in range(r.randint(1, 60))) for _ in range(3000)]
    for text in [*texts, *made]:
        assert sentence_ends(text) == sentence_ends(text, prune=False), text


def test_without_the_program_rows_differ(texts):
    """Ends whose closing and opening words alone look like ends: spans refuse more than one in twenty
    of them, in pairs or as numbers alone."""
    chosen = alone = refused = 0
    for text in texts:
        ends = set(sentence_ends(text))
        size = len(text.rstrip())
        quotes, brackets = sentences._quoted(text), sentences._bracketed(text)
        marks = [(m.start(), m.end(), m[0]) for m in sentences._MARKS.finditer(text, 0, size)]
        torn = 2 * round(sentences.WEIGHT["torn"] * sentences.UNIT)
        for p in sentences._points(text, marks, len(text) - len(text.lstrip()), size, quotes, brackets):
            inside = sentences._inside(*quotes, p.at - 1) > p.at or sentences._inside(*brackets, p.at - 1)
            if p.score - (torn if inside else 0) > 0:
                alone += 1
                refused += p.at not in ends
        chosen += len(ends)
    assert refused > 0.05 * alone, (chosen, alone, refused)


def test_more_than_a_few_characters_back():
    far = "Am " + " " * 60 + "7. Tag ist es kalt. Dann wird es warm."
    assert len(sentence_ends(far)) == 2
    long_word = "x" * 70
    assert len(sentence_ends(f"It is the {long_word}. The next one. {long_word}.e.g. it")) == 3
    assert len(sentence_ends("The gap is 7.5" + " " * 40 + "in. wide. It is so.")) == 2
