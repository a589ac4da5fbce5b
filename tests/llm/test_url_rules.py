from __future__ import annotations

from itertools import combinations

from lectern.llm import url_rules as U

URLS = [None, "", "no scheme", "http://", "HTTP://Example.NET/en/1", "http://example.net/EN/1", "http://xexample.net/en/",
        "https://a.b.example.com/de/3?x#y", "http://net/", "http://net", "http://net?x", "http://org/fr/", "http://a.org/fr",
        "ftp://x.org#/fr/", "http://É.NET/é", "a://b://c/d", "http://x.com/fr/1"]


def split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    for mark in "?#":
        rest = rest.split(mark, 1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(str.maketrans(U.UPPER, U.LOWER)), slash + path


def ruled(host, path):
    fits = [(len(n + p), v, n + p) for v, n, p in U.RULES if (host == n or host.endswith("." + n)) and path.startswith(p)]
    return max(fits)[1:] if fits else None


def test_given_rules(spark):
    urls = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    found = {r["page_id"]: r for r in U.judged(urls, None).collect()}
    for i, url in enumerate(URLS):
        host, path = split(url)
        assert (found[i]["host"], found[i]["path"]) == (host, path), url
        want = ruled(host, path)
        assert found[i]["rule"] == (want and want[1]), url
        assert found[i]["verdict"] in ("allow", "block") and (not want or found[i]["verdict"] == want[0])


def brute(rows, support, confidence):
    """(antecedent, verdict) -> confidence of the rules that are kept."""
    counts = {}
    for tokens, label in rows:
        for size in range(1, len(tokens) + 1):
            for part in combinations(sorted(tokens), size):
                own = counts.setdefault(part, [0, 0])
                own[label] += 1
    n, base = len(rows), [sum(1 for _, l in rows if l == v) / len(rows) for v in (0, 1)]
    rules = {(part, v): own[v] / sum(own) for part, own in counts.items() for v in (0, 1)
             if own[v] / n >= support and own[v] / sum(own) >= confidence and own[v] / sum(own) / base[v] > 1}
    return {(part, v): c for (part, v), c in rules.items() if not any(
        rules.get((tuple(t for t in part if t != left), v), -1) >= c for left in part if len(part) > 1)}


def test_mined_rules_match_brute_force(spark):
    rows = [(["a", "b"], 1)] * 6 + [(["a", "c"], 0)] * 5 + [(["b", "c"], 1)] * 2 + [(["b", "c"], 0)] * 3 + [(["d"], 0)] * 4
    labelled = spark.createDataFrame([(t, bool(l)) for t, l in rows] + [(["a"], None)], "tokens array<string>, blocked boolean")
    found = {(tuple(r["antecedent"]), int(r["verdict"] == "block")): r["confidence"]
             for r in U.mined(labelled, 0.1, 0.6).collect()}
    assert found == brute(rows, 0.1, 0.6)
    sets = spark.createDataFrame([(["a", "b"],), (["b"],), (["z"],), (["a", "b", "d"],)], "tokens array<string>")
    best = {tuple(r["tokens"]): (r["verdict"], tuple(r["antecedent"])) for r in U.matched(sets, U.mined(labelled, 0.1, 0.6)).collect()}
    assert best[("a", "b")] == ("block", ("a", "b")) and ("z",) not in best


def test_labels_decide_where_no_rule_does(spark):
    rows = [(f"http://{'spam' if i % 3 == 0 else 'good'}.x.com/en/{i}", i % 3 == 0) for i in range(60)]
    labels = spark.createDataFrame(rows, "url string, blocked boolean")
    urls = spark.createDataFrame([(1, "http://spam.y.com/en/9"), (2, "http://good.y.com/en/9"), (3, None), (3, None)],
                                 "page_id long, url string").withColumn("verdict", U.F.lit("old")).withColumn("tokens", U.F.lit(1))
    found = U.judged(urls, labels).collect()
    assert sorted((r["page_id"], r["verdict"]) for r in found) == [(1, "block"), (2, "allow"), (3, "allow"), (3, "allow")]
    assert U.judged(urls.limit(0), labels).count() == 0 and U.judged(urls, labels.limit(0)).count() == 4


def test_keys_that_come_together_are_one_item(spark):
    keys = "&".join(f"k{j}=1" for j in range(30))
    rows = [(f"http://{'spam' if i % 2 else 'good'}.x.com/{'a' if i % 3 else 'b'}/{i}?" + (keys if i % 2 else "z=1"), bool(i % 2)) for i in range(120)]
    labels = spark.createDataFrame(rows, "url string, blocked boolean")
    urls = spark.createDataFrame([(1, "http://other.x.com/q?k7=5"), (2, "http://other.x.com/q?z=1"), (3, "http://other.x.com/q")], "page_id long, url string")
    found = {r["page_id"]: r["verdict"] for r in U.judged(urls, labels).collect()}
    assert found == {1: "block", 2: "allow", 3: "allow"}


def test_equal_tokens(spark):
    sets = [(0, ["a", "b", "c"]), (1, ["a", "b"]), (2, ["c", "d"]), (3, []), (4, ["a", "b", "e", "f"])]
    labelled = spark.createDataFrame([(i, t, True) for i, t in sets] + [(5, ["a"], None)], "row long, tokens array<string>, blocked boolean")
    equal = U.equal_tokens(labelled)
    assert {tuple(r) for r in equal.collect()} == {("b", "a"), ("f", "e")}
    items = {r["row"]: r["items"] for r in U.with_items(labelled, equal, ["row"]).collect()}
    assert items[0] == ["a", "c"] and items[3] == [] and items[4] == ["a", "e"]
