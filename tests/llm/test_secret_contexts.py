import random
import string

import pytest

from tidemill.llm import secrets_scan as ss


def guessed(text):
    return [text[a:b] for k, a, b in ss.scan(text) if k == "guess"]


def test_long_values_are_taken_whole():
    rng = random.Random(1)
    jwt = "".join(rng.choices(string.ascii_letters + string.digits + "-_.", k=599)) + "Q"
    text = f"Authorization: Bearer {jwt} end"
    assert guessed(text) == [jwt]
    assert ss.redact(text, ss.scan(text)) == "Authorization: Bearer [secret] end"
    # the costly part may stand far behind
    assert guessed("pwd: " + "z" * 5_000 + "xK9#vQ2!mZ7$Lw8" + "z" * 400) == ["z" * 5_000 + "xK9#vQ2!mZ7$Lw8" + "z" * 400]


@pytest.mark.parametrize("lead", ["login password: ", "login credentials: ", "secret passphrase: ", "token token token: "])
def test_contexts_overlap(lead):
    assert guessed(f"{lead}Xy9$kq!Zw2 end") == ["Xy9$kq!Zw2"]


def test_many_contexts_in_one_value_end_in_time():
    text = "token=" * 20_000
    assert len(ss.scan(text)) < 20_000 and ss.scan("pass " * 50_000) == []
    assert ss.scan("pwd:" * 20_000 + "aaaaaaaaaaaa") is not None


@pytest.mark.parametrize("value", ["Tr0ub4dorLong&3xyz!Q", "xK!9deadbeefdeadbeef#vQ2!"])
def test_values_reach_beyond_base_spans(value):
    text = f"password: {value} end"
    assert guessed(text) == [value.rstrip("!")]
    assert value.rstrip("!")[-5:] not in ss.redact(text, ss.scan(text))


def test_letters_are_judged_by_cost():
    assert guessed("pwd: QzXvKpWmRtLsNbYd") == ["QzXvKpWmRtLsNbYd"]
    for text in ["password authentication", "the secret ingredient", "pass legislation", "login credentials", "token distribution", "secret government documents", "password: information"]:
        assert guessed(text) == [], text
