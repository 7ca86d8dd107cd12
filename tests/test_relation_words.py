"""The words that a relation pattern has to find choose its texts, and lose none."""

import re

import pytest

from casewright.operators import extract
from casewright.registry import RELATIONS, WORDS_OF, default_registry

NAMES = ["Ann Lee", "O'Neil", "AB12"]
SAID = [
    "{a} was seen at the yard.", "{a}\tWERE\n spotted  inside a van;", "{a} is known to associate with {b}", "{a} was meeting with {b}.", "{a} and {b} were seen together", "{a} with {b} are present",
    "{a} are tied to the case.", "{a} is related\nto a car;", "{a}'s phone (07700 900 123) was in contact with {b}", "{a}'s number +44 7700 900123 is contacting with {b}", "{a} was here", "{a} is connected", "together {a}", "", "and with were together",
]


def plain(text):
    """All patterns on all texts."""
    got = [(m.group("source").strip(), m.group("target").strip(), kind, m.start(), m.end()) for kind, p in RELATIONS for m in re.finditer(p, text, re.IGNORECASE)]
    return [g for g in got if g[0] and g[1] and g[0] != g[1]]


def test_same_relations():
    texts = [s.format(a=a, b=b) for s in SAID for a in NAMES for b in NAMES]
    texts += [f"{x} {y}" for x in texts for y in texts[::7]]
    found = [[(r[0], r[1], r[2], r[4], r[5]) for r in extract.pattern_relations(t, default_registry())] for t in texts]
    assert found == [plain(t) for t in texts] and {k for f in found for _, _, k, _, _ in f} == {k for k, _ in RELATIONS}


@pytest.mark.parametrize("kind, pattern", RELATIONS)
def test_a_text_without_the_words_is_not_tried(kind, pattern, monkeypatch):
    tried = []
    monkeypatch.setattr(extract.re, "finditer", lambda *a: tried.append(a) or iter(()))
    extract.pattern_relations("Ann Lee went home with Bob Ray in the evening.", default_registry())
    assert not tried and pattern in WORDS_OF
