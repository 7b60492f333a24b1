"""Secrets that hold a part that looks like other personal data."""

import pytest

pytest.importorskip("matchgrain.llm")
from matchgrain.llm import pii


def test_secrets_around_base_spans_are_redacted_whole():
    model = pii.BoostedTrees(*pii.examples(pii.EXAMPLES))
    for text, left in [("api_key=4111111111111111abcdEF rest", "api_key=[CARD] rest"), ("password=x9+14155550123qz end", "password=[KEYED] end"), ("write jane_long_user12345678@example.com now", "write [EMAIL] now")]:
        base, spans = pii.all_spans(text, model)
        assert set(base) <= set(spans) and pii.redacted(text, spans) == left
    assert [k for k, _, _ in pii.all_spans("write jane_long_user12345678@example.com now", model)[1]] == ["email"]
