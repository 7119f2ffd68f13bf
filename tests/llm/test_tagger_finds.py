"""What the tagger finds and the fixed patterns do not: short addresses of an ip, capitals, and the start of an address."""
import pytest

from textguard.llm import pii_tagger


@pytest.fixture(scope="module")
def model():
    return pii_tagger.trained()


@pytest.mark.parametrize("text,made", [
    ("please write to JOHN AT MAIL DOT COM today", "please write to [EMAIL] today"),
    ("contact MARIA [AT] EXAMPLE [DOT] ORG now", "contact [EMAIL] now"),
    ("route fe80::ab:cd is up", "route [IP] is up"),
    ("write to jürgen@example.com or call", "write to [EMAIL] or call"),
    ("std::find and a::b", "std::find and a::b"),
])
def test_finds_of_the_tagger_come_out(model, text, made):
    found = pii_tagger.tagged([text], model)
    assert found == pii_tagger.tagged([text], model, every=True)
    assert pii_tagger.redacted(text, pii_tagger.all_spans(pii_tagger.base_spans(text), found[0])) == made


def test_a_wider_span_stays_beside_a_base_span():
    base = [("email", 3, 9), ("phone", 8, 12)]
    assert pii_tagger.all_spans(base, [("email", 0, 9), ("card", 4, 11)]) == [("email", 0, 9), ("email", 3, 9), ("phone", 8, 12)]
