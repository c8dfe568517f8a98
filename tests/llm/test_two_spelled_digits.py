"""Two spelled digits in a row are enough of a disguise, whatever else the text holds."""

import pytest

from touchline.llm import pii


@pytest.mark.parametrize(
    ("kind", "text"),
    [
        ("card", "4111 1111 1111 11 one one"),
        ("phone", "+1 555 010 two three"),
        ("phone", "+1 555 010 Two-Three"),
    ],
)
def test_two_spelled_digits(kind, text):
    assert pii.find(text) == ([], [(kind, 0, len(text))])
    assert pii.redact_text(text) == f"<{kind.upper()}>"


@pytest.mark.parametrize("text", ["one two", "oh, one", "NINE-nine", "a (at) b", "a[.]b", "a dot b", "a_at_b", "a_dot_b", "&#64;", "&commat;", "&#46;", "&period;", "%40", "a at b dot c"])
def test_hint_is_necessary(text):
    assert pii.TOKENS.search(text) and pii.HINT.search(text)
