import re

import pytest

from tidemill.llm import license_scan as ls


@pytest.mark.parametrize("name", sorted(ls.TEMPLATES))
def test_each_notice_is_found_as_its_own(name):
    for notice in ls.TEMPLATES[name]:
        text = f"Some prose here.\nmore of it {notice} and on\nthe end"
        got = ls.scan(text)
        assert [r["license"] for r in got] == [name], (notice, got)
        assert text[got[0]["start"] : got[0]["end"]] == text.split("\n")[1] and got[0]["n_changed"] == 0


def test_near_misses_are_rejected_and_small_changes_reported():
    assert ls.scan("This work is licensed under the GNU General Public License, version 4.") == []
    assert ls.scan("you need a license to drive and permission to fish") == []
    [r] = ls.scan("This project is licensed under the GNU General Public License, version 3!")
    assert r["license"] == "GPL-3.0" and r["changes"] == "-work +project"
    assert ls.scan(None) == ls.scan("") == ls.scan("\n") == []


def test_ranking_is_by_smallest_conditional_size():
    ranked = ls.reductions("Released under the MIT License.")
    assert ranked[0][1] == "MIT" and [r[0] for r in ranked] == sorted((r[0] for r in ranked), reverse=True)


def test_query_equals_plain_search_for_unchanged_notices(spark):
    notices = [(k, n) for k, v in ls.TEMPLATES.items() for n in v]
    rows = [(i, f"x\n{n}\ny z" if i % 2 else f"{n}", "q") for i, (_, n) in enumerate(notices)] + [(900, None, "q"), (901, "", "q"), (None, notices[0][1], "q"), (0, notices[0][1], "q"), (902, "pad " * 100_000 + "\n" + notices[0][1], "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = sorted(((r["doc_id"], r["license"], r["n_changed"]) for r in ls.find_licenses(df).collect()), key=str)
    want = sorted(((i, k, 0) for i, t, _ in rows for k, n in notices if t and n in t and not re.search(re.escape(n[:-1]) + r" \(", t)), key=str)
    assert got == want
    assert ls.find_licenses(df.limit(0)).count() == 0
