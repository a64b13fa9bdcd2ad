"""Forms of personal data that the field must score, and short numbers that it must leave alone."""

import pytest

from tessera.llm import pii


@pytest.fixture(scope="module")
def field():
    return pii.fit(["Some plain words of a text that trains the field, with numbers 12 and 345."])


@pytest.mark.parametrize("value", ["8[.]8[.]8[.]8", "1(.)0(.)0(.)1", "10[.]0[.]0[.]5", "10(.)0(.)0(.)5", "8.8.8[.]8", "10[.]10[.]0[.]5", "10(.)10(.)0(.)5", "10.10.0[.]5"])
def test_short_bracketed_addresses_are_found(field, value):
    text = f"see {value} now"
    assert field.spans(text)[1] == [(4, 4 + len(value), 1)]


def test_capital_at_is_found(field):
    assert field.spans("mail JANE AT EXAMPLE DOT COM")[1] == [(5, 28, 0)] or field.spans("JANE AT EXAMPLE DOT COM")[1] == [(0, 23, 0)]


@pytest.mark.parametrize("text", ["in 2024 we", "v 1.2.3 and", "1999-2004", "page 123456", "1 2 3 4", "1-2-3-4", "3/4/2024", "1 [2] 3 [4]"])
def test_short_numbers_stay_outside(field, text):
    assert field.spans(text)[1] == []


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("write to jane [at] example.com. Thanks a lot", "jane [at] example.com"),
        ("mail jane at example dot com. Thanks", "jane at example dot com"),
        ("mail jane at example dot com, or call", "jane at example dot com"),
        ("ask jane.doe (at) mail.example.org. then wait", "jane.doe (at) mail.example.org"),
        ("ask jane_doe@example [dot] com.\nMore words", "jane_doe@example [dot] com"),
        ("see jane [at] example [dot] co [dot] uk. We", "jane [at] example [dot] co [dot] uk"),
        ("jane [at] example.com", "jane [at] example.com"),
    ],
)
def test_what_follows_an_address_is_kept(field, text, value):
    at = text.index(value)
    assert field.spans(text) == ([], [(at, at + len(value), 0)])
    assert pii.redact(text, field.spans(text)[1]) == text.replace(value, "[EMAIL]")


def test_two_addresses_with_a_sentence_end_between(field):
    text = "To jane [at] example.com. Or joe [at] example.net. Thanks"
    assert pii.redact(text, field.spans(text)[1]) == "To [EMAIL]. Or [EMAIL]. Thanks"


def test_plain_addresses_before_a_sentence_are_trained_on(field):
    (r,) = pii.regions("jane@example.com. Thanks")
    assert pii.gradient(r, [(0, 16, 0)], {})


def test_recall_and_precision_of_added_spans():
    """Lines of another seed and of words that the field has not met."""
    import random

    model = pii.fit(["Some plain words of a text that trains the field, with numbers 12 and 345.", "Eauouon enpaeux leaux le ouè une la par des rien pour cela dans notre vie"])
    rng, words = random.Random(99), "lorem ipsum dolor amet sed tempor magna aliqua veniam quis nostrud labore".split()
    hit = gold = found = 0
    for _ in range(1500):
        text, own = pii.line(rng, words)
        base, added = model.spans(text)
        plain = [s for s in base if s not in own]  # what a plain form takes that the line did not mean
        want = {s for s in own if s not in base and not any(s[0] < z and a < s[1] for a, z, _ in base)}
        got = {s for s in added if not any(s[0] < z and a < s[1] for a, z, _ in plain)}
        hit, gold, found = hit + len(want & got), gold + len(want), found + len(got)
    print(f"recall {hit / gold:.3f} of {gold}, precision {hit / found:.3f} of {found}")
    assert hit >= 0.9 * gold and hit >= 0.9 * found
