"""Redaction and the audit that looks at it with other eyes, on own sentences."""

import pytest

from ticketloom.operators import audit, redaction

FOUND = [
    ("Hi again, Elsa", "greeting"), ("Hello there, dear Elsa Smith", "greeting"), ("We wrote to Mrs Okafor today", "honorific"), ("We will check.\nKind regards, Marta", "sign-off"),
    ("It never came. Olga Petrenko", "trailing-name"), ("Reach me at 730 192 8455 now", "phone"), ("it is +44 7301 928455", "phone"), ("Marta from support wrote", "from-team"),
    ("the advisor named Selene lied", "advisor"), ("Luna's reading was off", "possessive"), ("Dear [Name] bell, we saw it", "after-placeholder"), ("Меня зовут Ирина", "self-name"),
    ("mein Name ist Jonas", "self-name"), ("Hello, I'm Tuan Anh.", "self-intro"), ("my code is 482913", "confirmation-code"), ("write to @luna_star please", "handle"),
    ("I live at 44 North Willow Street now", "address"), ("I was born on 12.03.1988", "birth-data"),
]
CLEAN = ["Hello team, the app is slow", "Dear Customer, thank you", "Order 7301928455610 was never sent", "I am not happy. Thanks", "It cost 20 dollars on Monday", "Mail me at a@b.example", "[Name]'s reading was off", "Dear [Name], hello"]


@pytest.mark.parametrize(("text", "category"), FOUND)
def test_found(text, category):
    assert category in {c for c, _ in audit.findings(text)}


@pytest.mark.parametrize("text", CLEAN)
def test_clean(text):
    assert audit.findings(text) == []


def test_fifteen_detectors():
    assert len(audit.DETECTORS) == 15 and {c for _, c in FOUND} == set(audit.DETECTORS)
    assert audit.findings(None) == audit.findings("") == []


REPLIES = {
    "Hi again, Elsa. We looked": "Hi again, [Name]. We looked",
    "Hello, I'm Tuan Anh.": "Hello, I'm [Agent].",
    "Dear ANNA bell, thank you": "Dear [Name], thank you",
    "Marta from the support team here": "[Agent] from the support team here",
    "Luna's reading was refunded": "[Advisor]'s reading was refunded",
    "Dear Customer, thank you": "Dear Customer, thank you",
}
REVIEWS = {
    "Меня зовут Ирина и я жду": "Меня зовут [Name] и я жду",
    "mein Name ist Jonas Weber, danke": "mein Name ist [Name], danke",
    "Mystic Luna Moonlight was wrong": "Mystic [Advisor] was wrong",
    "I'm Maria and I paid": "I'm [Name] and I paid",
    "I am Very upset": "I am Very upset",
}


@pytest.mark.parametrize(("text", "want"), REPLIES.items())
def test_replies(text, want):
    assert redaction.redact_reply(text) == want
    assert redaction.redact_reply(want) == want


@pytest.mark.parametrize(("text", "want"), REVIEWS.items())
def test_reviews(text, want):
    assert redaction.redact_review(text) == want
    assert redaction.redact_review(want) == want
