"""Small grammars of generated answers and exam papers, built from words.

A pattern is put together from vocabulary (the fixed values of the formats) and a few shapes: a mark at the start of a
line, an item's number and what ends it, a labelled field. Patterns hold in Java's and Python's regular expressions alike.
"""

from __future__ import annotations

import re

#: How items, answers and their fields are called (English and Vietnamese), and what may end a number.
ITEM_WORDS = ("question", "câu", "câu hỏi")
ANSWER_WORDS = ("answer", "đáp án")
EVIDENCE_WORDS = ("evidence", "bằng chứng")
RELATIONSHIP_WORDS = ("relationship",)
EXPLANATION_WORDS = ("giải thích",)
RELATIONSHIPS = ("supports", "contradicts", "absent")
ROLES = ("user", "assistant", "system")
TRUTH_LABELS = ("true", "false", "not given")
COUNT_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6}
NUMBER_ENDS = ".):"
ARROWS = ("→", "->", "=>")
TO = ("-", "–", "to")
TO_ANY = ("-", "–", "—", "to", "đến", "tới")

BULLET, STARS = r"(?:[-*]\s*)?", r"(?:\*{0,2})"
EMPHASIS = r"(?:\*{1,2}|_{1,2})?"
HASHES = r"(?:#{1,6}{gap})?"


def phrase(words: str) -> str:
    """Words in order with any white space between."""
    return r"\s+".join(re.escape(w) for w in words.split())


def one_of(*phrases: str) -> str:
    """Longer phrases first, so that none is cut short by its own beginning."""
    return "(?:" + "|".join(map(phrase, sorted(phrases, key=len, reverse=True))) + ")"


def any_char(characters: str) -> str:
    return "[" + re.escape(characters) + "]"


def numbered(number: str, ends: str = NUMBER_ENDS, words: tuple[str, ...] = ITEM_WORDS) -> str:
    """An item's number as a line may begin with it: the word for it or not, the number, its end."""
    return rf"{one_of(*words)}?\s*{number}\s*{any_char(ends)}"


def field(*names: str) -> str:
    """A labelled field at the start of a line: bullet and emphasis or not, its name, a colon."""
    return rf"{BULLET}{STARS}{one_of(*names)}\s*:\s*{STARS}"


def span(low: str, high: str, joined: tuple[str, ...] = TO) -> str:
    return rf"{low}\s*(?:{'|'.join(map(re.escape, joined))})\s*{high}"


def role_mark(gap: str, after: str) -> str:
    """A conversation's role at the start of a text, as a heading or emphasised or plain."""
    return rf"\A\s*{HASHES.replace('{gap}', gap)}{EMPHASIS}({'|'.join(ROLES)}){after}"
