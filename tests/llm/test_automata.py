import random
import re

import pytest

from riftlens.llm import secrets as S
from riftlens.llm.automata import Automaton


@pytest.mark.parametrize("pattern, alphabet", [(r"a(?:b|cd)*e?", "abcde"), (r"[a-c]{2,4}x+", "abcx"), (r"(?:ab?){3}|a{5,}", "ab"), (r"[^a\s]+@[\w.]", "ab@ ."), (r"x?y?z?", "xyz"), (r"(?:[A-Z0-9]+ )*KEY", "AK E Y0")])
def test_longest_equals_a_search_of_all_ends(pattern, alphabet):
    rng, made = random.Random(1), Automaton({"p": pattern})
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(12)))
        at = rng.randrange(len(text) + 1)
        ends = [e for e in range(at + 1, len(text) + 1) if re.fullmatch(pattern, text[at:e])]
        assert made.longest(text, at) == (("p", ends[-1]) if ends else None)


def test_the_first_of_equal_productions_is_named():
    made = Automaton({"one": "ab", "two": "a."})
    assert made.longest("ab", 0) == ("one", 2) and made.longest("ac", 0) == ("two", 2) and made.longest("b", 0) is None and made.longest("", 0) is None


def test_look_around_is_refused():
    with pytest.raises(ValueError):
        Automaton({"p": r"a(?=b)"})


@pytest.mark.parametrize("length", [30, 600, 5000])
def test_long_tokens_are_masked_whole(length):
    rng = random.Random(length)
    body = "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(length))
    for token in ("sk_live_" + body, "ghp_" + body, "acme-pat-" + body):
        assert S.redact(f'send("{token}", 5)') == 'send("REDACTED", 5)'
    assert S.redact(f"postgres://own:{body}@db.host/x") == "postgres://own:REDACTED@db.host/x"
    assert S.redact(f"It is {body} (the token), as said") == "It is REDACTED (the token), as said"
    # a long name before its value
    assert S.redact(f'put("{"very-long-" * length}api-key", "{body}1")') == f'put("{"very-long-" * length}api-key", "REDACTED")'
    assert S.redact(f"run --{'very-long-' * length}password {body}1 now") == f"run --{'very-long-' * length}password REDACTED now"
