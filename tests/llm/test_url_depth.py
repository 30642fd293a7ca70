from tidemill.llm import url_filter


def test_rules_come_from_all_tokens_of_a_url(spark):
    # what tells the labels apart: the sixth segment, the fifth query name, the outermost of six host labels
    rows = []
    for i in range(60):
        bad = i % 2
        rows += [
            (f"http://s{i}.org/a/b/c/d/e/{'bet' if bad else 'news'}/{i}", "block" if bad else "allow"),
            (f"http://t{i}.org/?a=1&b=2&c=3&d=4&{'track' if bad else 'page'}=1", "block" if bad else "allow"),
            (f"http://{'ads' if bad else 'docs'}.v.w.x.y{i}.net/", "block" if bad else "allow"),
        ]
    rules = url_filter.mine_rules(spark.createDataFrame(rows, "url string, label string"), min_support=0.1)
    got = {(tuple(r["tokens"]), r["label"]) for r in rules.collect()}
    want = {"path:bet": "block", "path:news": "allow", "query:track": "block", "query:page": "allow", "host:ads": "block", "host:docs": "allow"}
    assert {((t,), v) for t, v in want.items()} == got
    asked = [("http://q.org/1/2/3/4/5/6/bet", "block"), ("http://q.org/?m&n&o&p&q&r&page", "allow"), ("http://ads.a.b.c.d.e.f/", "block")]
    found = url_filter.match_rules(spark.createDataFrame([(u,) for u, _ in asked], "url string"), rules)
    assert {(r["url"], r["label"]) for r in found.collect()} == set(asked)
