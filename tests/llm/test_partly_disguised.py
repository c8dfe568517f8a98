"""Identifiers of which only a part is disguised."""

import pytest

from touchline.llm import pii


@pytest.mark.parametrize(
    ("text", "base", "whole", "redacted"),
    [
        ("to jаne@example.com now", "ne@example.com", "jаne@example.com", "to <EMAIL> now"),
        ("to jane.doe@mail.example[.]com now", "jane.doe@mail.example", "jane.doe@mail.example[.]com", "to <EMAIL> now"),
        ("to jane dot doe@example.com now", "doe@example.com", "jane dot doe@example.com", "to <EMAIL> now"),
    ],
)
def test_whole_span_beside_the_base_span(text, base, whole, redacted):
    found, spans = pii.find(text)
    assert [text[s:e] for _, s, e in found] == [base]
    assert {text[s:e] for _, s, e in spans} == {base, whole}
    assert pii.redact_text(text) == redacted


def test_no_part_of_a_base_span_comes_in():
    text = "jane@example.com, 4111 1111 1111 1111 and 10.0.0.1 ([.])"
    base, spans = pii.find(text)
    assert spans == base and len(base) == 3
