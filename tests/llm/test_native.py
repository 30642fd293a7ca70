import re
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from tidemill.llm import decontaminate, queries, url_filter


def plain_contained(docs, items, n=5, t=0.8):
    def words(x):
        return [w for w in re.split(r"[\x20\x09-\x0D]+", (x or "").lower()) if w]

    out = set()
    for item, text in items:
        w = words(text)
        k = min(n, len(w))
        s = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
        for doc, body in docs:
            b = words(body)
            d = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)}
            if s and len(s & d) >= t * len(s) - 1e-9:
                out.add((doc, item, len(s), len(s & d)))
    return out


def test_contained_items_equal_all_pairs(spark):
    import random

    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 4, 5, 6, 9, 20, 40])))) for i in range(40)] + [(90, None), (91, ""), (92, "A\x0bB")]
    docs = []
    for d in range(60):
        parts = [" ".join(rng.choices(words, k=rng.randint(0, 40)))]
        for _ in range(2):
            w = (rng.choice(items)[1] or "").split(" ")
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = "edit"
            parts.append(" ".join(w).upper())
        docs.append((d, "\n".join(parts)))
    docs += [(None, items[7][1]), (200, None), (201, ""), (202, "word " * 20_000 + items[8][1]), (docs[0][0], docs[0][1])]
    a = spark.createDataFrame([(*x, "z") for x in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, doc_id string")
    got = [tuple(r) for r in decontaminate.contained_items(a, b).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_contained(docs, items)
    assert decontaminate.contained_items(a.limit(0), b).count() == 0 and decontaminate.contained_items(a, b.limit(0)).count() == 0
    kept = decontaminate.drop_contaminated(a, b)
    assert kept.columns == a.columns
    clean = [(d, t) for d, t in docs if not plain_contained([(d, t)], items)]
    assert len(clean) < len(docs) - 20 and Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter(clean)


def test_partitions_of_items_bound_what_documents_ask(spark):
    import random

    rng = random.Random(5)
    some = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    items = spark.createDataFrame([(i, some(n)) for i, n in enumerate([2] * 5 + [5] * 5 + [8] * 20 + [40] * 20 + [300] * 20)], "item_id long, text string")
    docs = spark.createDataFrame([(0, some(20_000))], "doc_id long, text string")
    sketches = decontaminate.item_sketches(items).cache()
    bounds = decontaminate.bounds_of(sketches)
    assert len(bounds) == 5 and all(r["sketch"] == sorted(r["sketch"]) and len(r["sketch"]) == r["q"] - r["least"] + 1 for r in sketches.collect())
    split = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), decontaminate.words_of(F.col("text")).alias("words"))
    asked = {part: (n, top) for part, n, top in decontaminate.asked_hashes(split, bounds).groupBy("part").agg(F.count("*"), F.max("h")).collect()}
    for part, n, top in bounds:
        share = asked[part][0] / (20_000 - n + 1)
        assert asked[part][1] <= top
        assert share < {5 * 64 + 2: 0.9, 5 * 64 + 5: 0.5, 5 * 64 + 8: 0.35}.get(part, 1)
    seen, keys = decontaminate.asked_hashes(split, bounds), sketches.select("item_id", "part", F.explode("sketch").alias("h"))
    plan = seen.join(keys, ["part", "h"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Join \[part#\d+, h#\d+L\], \[part#\d+, h#\d+L\]", plan) and "Python" not in plan


def plain_tokens(url):
    after = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", after)[0]
    path = re.match("[^?#]*", after[len(host) :])[0]
    query = re.match(r"(?:\?([^#]*))?", after[len(host) + len(path) :])[1] or ""
    fold = lambda p, xs: [p + re.sub("[0-9]+", "#", x) for x in xs if x]
    low = "".join(c.lower() if c.isascii() else c for c in host)
    h, p, q = fold("host:", low.split(".")), fold("path:", path.split("/")), fold("query:", [x.split("=")[0] for x in query.split("&")])
    return low, path, list(dict.fromkeys(h + p + q))


def plain_verdicts(pages, rules, support, confidence):
    judged = []
    for i, url in pages:
        host, path, _ = plain_tokens(url)
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        judged.append((i, url, host, path, *(max(fits)[1:] if fits else (None, None))))
    # what the given rules name is no evidence
    named = {t for _, h, p in rules for t in plain_tokens(f"://{h}{p}")[2]}
    rows = [([t for t in plain_tokens(u)[2] if t not in named], v) for _, u, _, _, r, v in judged if r]
    both, alone = Counter(), Counter()
    for toks, v in rows:
        for k in (1, 2, 3):
            for c in combinations(sorted(toks), k):
                both[c, v] += 1
                alone[c] += 1
    mined = {(c, v): n / alone[c] for (c, v), n in both.items() if n >= support * len(rows) and n / alone[c] >= confidence}
    mined = {(c, v): conf for (c, v), conf in mined.items() if not any(set(c2) < set(c) and v2 == v and k2 >= conf for (c2, v2), k2 in mined.items())}
    out = []
    for i, u, host, path, rule, v in judged:
        if rule is None:
            toks = set(plain_tokens(u)[2])
            v = max(((conf, len(c), both[c, v], v) for (c, v), conf in mined.items() if set(c) <= toks), default=(0, 0, 0, "allow"))[3]
        out.append((i, host, path, rule, v))
    return out


def test_url_verdicts_equal_plain_mining(spark):
    import random

    rng = random.Random(4)
    pages = []
    for i in range(300):
        host = rng.choice(["", "www.", "m.", "blog."]) + rng.choice(["a.", "b.", "spam-farm."]) + "Example." + rng.choice(["com", "net", "org"])
        pages.append((i, f"http{rng.choice(['', 's'])}://{host}/{rng.choice(['en', 'fr', 'es', 'de'])}/{rng.randint(1, 99)}{rng.choice(['', '?page=2&ref=x', '#top', '/'])}"))
    pages += [(900, None), (901, ""), (902, "no scheme/en/"), (903, "http://"), (904, "http://net"), (905, "x://COM/?u=http://b"), (None, "http://a.example.net/fr/1"), (906, "http://x.org/" + "en/" * 3000), (0, pages[0][1])]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, verdict string")
    got = sorted((tuple(r) for r in url_filter.filter_urls(df, queries.URL_RULES, min_support=0.02).collect()), key=str)
    assert got == sorted(plain_verdicts(pages, queries.URL_RULES, 0.02, url_filter.MIN_CONFIDENCE), key=str)
    assert url_filter.filter_urls(df.limit(0), queries.URL_RULES).count() == 0
    only_open = df.where("page_id = 906")
    assert [r["verdict"] for r in url_filter.filter_urls(only_open, queries.URL_RULES).collect()] == ["allow"]


def test_mined_rules_do_not_echo_the_given_ones(spark):
    rows = [(f"http://{'win-big' if i % 4 == 0 else f's{i}'}.example.{'net' if i % 4 == 0 else 'com'}/{'fr' if i % 4 == 0 else 'de'}/{i}",) for i in range(200)]
    df = spark.createDataFrame([(i, u) for i, (u,) in enumerate(rows)] + [(900, "http://other.net/en/1"), (901, "http://win-big.example.org/en/1")], "page_id long, url string")
    found = {r["page_id"]: r for r in url_filter.filter_urls(df, queries.URL_RULES, min_support=0.05).collect()}
    assert found[0]["rule"] == "net/fr/" and found[0]["verdict"] == "block"
    assert found[900]["rule"] is None and found[900]["verdict"] == "allow"  # host:net alone is the given rule's word
    assert found[901]["verdict"] == "block"
    quality = {r["label"]: r for r in url_filter.held_out_precision(df, queries.URL_RULES, min_support=0.05).collect()}
    assert all(0 <= r["right"] <= r["judged"] <= r["pages"] for r in quality.values())
