import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from polyquilt.llm import urls


def test_hosts_paths_and_rules(spark):
    cases = [
        ("HTTP://Sub.Example.NET/en/1?q=/x", "sub.example.net", "/en/1", "example.net/en/"),
        ("https://example.net/de/", "example.net", "/de/", "net/"),
        ("https://a.example.com/de/9#t", "a.example.com", "/de/9", "example.com/de/"),
        ("https://notexample.com/de/9", "notexample.com", "/de/9", None),
        ("x://y.org/fr/://z", "y.org", "/fr/://z", "org/fr/"),
        ("https://x.net", "x.net", "", None),
        ("https://x.org?/fr/", "x.org", "", None),
        ("no scheme.net/en/", "", "", None),
        (None, "", "", None),
        ("", "", "", None),
    ]
    df = spark.createDataFrame([(k, c[0], 1, "h") for k, c in enumerate(cases)], "page_id bigint, url string, yes int, host string")
    got = {r["page_id"]: r for r in urls.judge(df).collect()}
    for k, (_, host, path, rule) in enumerate(cases):
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, rule)
        if rule:
            assert got[k]["verdict"] == ("allow" if rule in ("example.net/en/", "org/fr/") else "block")
        else:
            assert got[k]["verdict"] in ("allow", "block")


def brute_scores(rows):
    """rows of (normal url, counted yes, counted no) -> {url: llr}."""
    tri = {s: Counter() for s in "yn"}
    for u, y, n in rows:
        for i in range(len(u) - 2):
            tri["y"][u[i : i + 3]] += y
            tri["n"][u[i : i + 3]] += n
    def log(g, s):
        t = tri[s]
        c0 = sum(v for k, v in t.items() if k[2] == g[2])
        c1 = sum(v for k, v in t.items() if k[1:] == g[1:])
        n1 = sum(v for k, v in t.items() if k[1] == g[1])
        n2 = sum(v for k, v in t.items() if k[:2] == g[:2])
        p0 = (c0 + urls.BETA / 53) / (sum(t.values()) + urls.BETA)
        p1 = (c1 + urls.BETA * p0) / (n1 + urls.BETA)
        return math.log((t[g] + urls.BETA * p1) / (n2 + urls.BETA))
    out = {}
    for u, _, _ in rows:
        grams = [u[i : i + 3] for i in range(len(u) - 2)]
        if grams:
            out[u] = math.floor(sum(round((log(g, "y") - log(g, "n")) * 1e6) for g in grams) / len(grams))
    return out


def test_model_against_brute_force(spark):
    words = ["news", "shop", "win", "free", "blog"]
    raw = [f"https://{words[k % 5]}{k}.example.{'net' if k % 3 else 'com'}/{['en', 'de', 'fr'][k % 3]}/{words[(k // 5) % 5]}" for k in range(60)]
    df = spark.createDataFrame(list(enumerate(raw)), "page_id bigint, url string")
    got = urls.judge(df).collect()
    own = df.select("url", urls.normal(F.col("url")).alias("u"), F.substring(F.md5(urls.host_of(F.col("url"))), 1, 1).isin(*urls.HELD_OUT).alias("held"))
    facts = {r["url"]: r for r in own.collect()}
    rule = {raw[r["page_id"]]: r["rule"] for r in got}
    rows = [(facts[x]["u"], int(not facts[x]["held"] and rule[x] in ("example.net/en/", "org/fr/")), int(not facts[x]["held"] and rule[x] in ("net/", "example.com/de/"))) for x in raw]
    want = brute_scores(rows)
    for r in got:
        if r["rule"] is None:
            assert abs(r["score"] - want[facts[raw[r["page_id"]]]["u"]]) <= 1


@pytest.mark.parametrize("bins,want", [([], 0), ([(1, 5, 0)], 0), ([(-3, 0, 9), (4, 9, 0)], urls.GRID), ([(2, 9, 0), (5, 0, 9)], 2 * urls.GRID), ([(-6, 0, 3), (-5, 1, 6), (7, 9, 0)], urls.GRID * 3 // 2)])
def test_threshold(bins, want):
    assert urls.best_threshold(bins) == want


def test_held_out_accuracy(spark):
    """Planted dialects: the model must tell held-out URLs apart."""
    yes = [f"https://site{k}.org/fr/culture-et-art-{k % 17}" for k in range(150)]
    no = [f"http://x{k}.net/win-cash-now{k % 13}" for k in range(150)]
    new = [f"https://site{k}.com/fr/culture-et-art-{k}" for k in range(300, 350)] + [f"http://x{k}.biz/win-cash-now{k}" for k in range(300, 350)]
    df = spark.createDataFrame(list(enumerate(yes + no + new)), "page_id bigint, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(df).collect()}
    right = sum(got[300 + k] == "allow" for k in range(50)) + sum(got[350 + k] == "block" for k in range(50))
    assert right >= 95


def test_empty_table(spark):
    assert urls.judge(spark.createDataFrame([], "page_id bigint, url string")).count() == 0


def test_repeated_and_long_urls(spark):
    """Rows that repeat are judged alike, each by itself; a very long URL is scored whole."""
    long = "https://a.example.info/" + "win-cash-now/" * 20_000
    raw = [f"https://site{k}.org/fr/culture-{k}" for k in range(60)] + [f"http://x{k}.net/win-cash-now{k}" for k in range(60)]
    df = spark.createDataFrame([(0, long), (1, long), (2, "https://b.info/culture"), (2, "https://b.info/culture")] + [(10 + k, u) for k, u in enumerate(raw)], "page_id bigint, url string")
    got = [r for r in urls.judge(df).collect() if r["page_id"] < 3]
    assert len(got) == 4 and {r["verdict"] for r in got if r["page_id"] < 2} == {"block"} and {r["verdict"] for r in got if r["page_id"] == 2} == {"allow"}
    assert len({r["score"] for r in got if r["page_id"] < 2}) == 1
