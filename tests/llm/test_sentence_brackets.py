"""Marks inside long, nested and broken brackets end nothing."""

import pytest

from weir.llm.sentences import sentence_ends

LONG = "first it is heated for an hour. Then it is cooled in the bath. " * 8


def units(text):
    found, at = [], 0
    for end in sentence_ends(text):
        found.append(text[at:end].strip())
        at = end
    return found


@pytest.mark.parametrize(
    "one",
    [
        f"The part (see below: {LONG.strip()}) is then removed.",
        "The part (it is hot. It may (as in the second case) be cooled. It is dry) is then removed.",
        "The part [it is hot. It may [as in the second case] be cooled. It is dry] is then removed.",
        "The part [it is hot. It may\nbe cooled. It is dry] is then removed.",
        "該部件（首先加熱。然後\n冷卻。再乾燥）隨後被移除。",
        "該部件（首先加熱。其（如圖）後冷卻。再乾燥）隨後被移除。",
        "The part (it is hot [or cold. It is wet]. It is dry) is then removed.",
    ],
)
def test_brackets_hold(one):
    assert units(f"{one} The next part follows.")[0] == one


def test_open_brackets_and_labels_hold_nothing():
    assert units("The part (it is hot. It is cooled.\n\nThe next part) is dry. It is removed.") == ["The part (it is hot.", "It is cooled.", "The next part) is dry.", "It is removed."]
    assert units("The part (of steel is heated. It is then cooled. It is dry.") == ["The part (of steel is heated.", "It is then cooled.", "It is dry."]
    assert len(units("The part (made by a step. It is a) heated. It is then cooled.")) == 3
    assert len(sentence_ends("(" * 100_000 + "The part is hot. It is cold." + ")" * 50_000)) >= 1
