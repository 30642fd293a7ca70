import math
import random
import time

import pytest

from tidemill.llm import secrets_scan as ss

SECRET = "xK9#vQ2!mZ7$Lw8"


def guessed(text):
    return [text[a:b] for k, a, b in ss.scan(text) if k == "guess"]


@pytest.mark.parametrize("n", [100, 300, 3_000, 30_000])
@pytest.mark.parametrize("lead", ["login: https://example.com/?pwd=", "login: https://example.com/?bearer=zzzzzzzz&passcode=", "Authorization: Bearer http://a.de/pwd:"])
def test_a_value_within_an_address_is_priced_to_its_end(lead, n):
    for value in ("z" * n + SECRET, "z" * n + SECRET + "z" * n):
        text = f"{lead}{value} end"
        [found] = guessed(text)
        assert found.endswith(value)
        assert SECRET not in ss.redact(text, ss.scan(text))


def test_a_value_within_running_text_is_priced_to_its_end():
    # The whole is too cheap for running text; what follows the second name is not.
    value = "z" * 400 + "k#q%v"
    assert ss.guess_cost(f"login={value}", True) < ss.THRESHOLD + ss.PROSE_MORE and ss.guess_cost(value) >= ss.THRESHOLD
    assert guessed(f"secret login={value} end") == [value]


def test_a_long_value_costs_what_its_parts_cost_together():
    value = "".join(c * 300 for c in "zq-w.v")
    assert ss.guess_cost(value) >= ss.THRESHOLD and guessed(f"pwd: {value} end") == [value]
    assert guessed("pwd: " + "z" * 2_000 + " end") == []


def all_ends(value):
    """The least cost with every end of every repeat, by position from the end."""
    each, n = math.log10(ss._charset(value)), len(value)
    best = [0.0] * (n + 1)
    for i in range(n - 1, -1, -1):
        ways = [(0.3 if value[i] in "-_./ " else each) + best[i + 1]]
        ways += [math.log10(ss._ranks()[value[i:j]] + 1) + 0.3 + best[j] for j in range(i + 2, min(n, i + 20) + 1) if value[i:j] in ss._ranks()]
        for p in range(1, min(16, (n - i) // 2) + 1):
            j = i + p
            while j < n and value[j] == value[j - p]:
                j += 1
            ways += [p * each + math.log10(k - i) + 0.3 + best[k] for k in range(i + max(2 * p, 3), j + 1)]
        best[i] = min(ways)
    return best


def test_long_repeats_cost_the_least_over_all_their_ends():
    rng = random.Random(5)
    for _ in range(60):
        units = ["".join(rng.choices("xk#-", k=rng.randint(1, 18))) for _ in range(3)] + ["password", "token"]
        value = "".join(u * rng.randint(1, 40) + u[: rng.randint(0, len(u))] for u in rng.choices(units, k=3))[:400]
        want = all_ends(value)
        assert list(ss.rest_costs(value, ss._charset(value))) == pytest.approx(want)
        # What is left out is sure to cost enough.
        short = ss.rest_costs(value, ss._charset(value), enough=9.0)
        assert [c >= 9.0 for c in short] == [c >= 9.0 for c in want]


def test_many_long_values_in_one_end_in_time():
    start = time.monotonic()
    text = "login: https://example.com/?" + "pwd=" * 20_000 + "z" * 50_000
    assert len(guessed(text)) <= 1
    rng = random.Random(6)
    blob = "".join(rng.choices("abcdefghijKLMNOP0123456789+/", k=2_000_000))
    assert guessed(f"bearer {blob} end") == [blob]
    assert time.monotonic() - start < 60
