"""Rules as a join: the same answers as first-match-wins, at any count."""

import random
import re

import pytest

from reqlens.functions import rule_index as RI
from reqlens.functions.urls import Rule, rules_from_patterns
from reqlens.operators import filters, series, stats


def first(url, compiled):
    return next((rep for p, rep in compiled if p.match(url)), None)


@pytest.fixture(scope="module")
def urls():
    rnd = random.Random(8)
    words = ["api", "v1", "v2", "items", "users", "blog", "static", "img", "a+b", "naïve", "x.y", "search"]
    out = {"/" + "/".join(rnd.choice(words) for _ in range(rnd.randrange(1, 5))) + rnd.choice(["", "/%d" % rnd.randrange(3000), "?page=%d" % rnd.randrange(9)])
           for _ in range(400)}
    return sorted(out | {"", "/", "/API/Items", "no-slash", "/api/item/7777"})


ODD = [Rule(r"(?i)/api/items", "any case"), Rule(r".*\?page=[23]", "paged"), Rule(r"/(?:blog|img)/.*", "either"), Rule(r"/sta+tic$", "plus"),
       Rule(r".*/us(er)s/.*7$", "group"), Rule(r"[^/].*", "no slash"), Rule(r"/x\.y(?=/)", "ahead"), Rule(r"/v1?/.*", "maybe"), Rule("(?x) /img /a", "verbose")]


@pytest.mark.parametrize("few", [0, 200])
def test_equals_first_match(spark, urls, few, monkeypatch):
    monkeypatch.setattr(RI, "FEW", few)
    rnd = random.Random(3)
    rules = rules_from_patterns([re.sub(r"\d+", "*", u) for u in rnd.sample(urls, 60)]) + ODD
    rnd.shuffle(rules)
    df = spark.createDataFrame([(u,) for u in urls] + [(None,)], "u STRING")
    compiled = [(re.compile(r.pattern), r.replacement) for r in rules]
    if not few:
        monkeypatch.setattr(RI, "FEW", 2)         # rules without a literal in several chains
    got = {r["u"]: r["rep"] for r in RI.with_rule(df, "u", rules, "rep").collect()}
    assert got == {None: None} | {u: first(u, compiled) for u in urls}


def test_every_match_holds_its_literals():
    for r in ODD + rules_from_patterns(["/a/*/b*", "*tail", "/x+(y)", "*"]):
        prefix, runs = RI.literal_runs(r.pattern)
        for u in ("/api/items", "/a?page=2", "/blog/1", "/staatic", "/q/users/x7", "q", "/x.y/", "/v1/", "/img/a", "/a/1/b2", "tail", "/x+(y)"):
            if re.match(r.pattern, u):
                assert u.startswith(prefix) and all(x in u for x in runs), (r.pattern, u)
    assert RI.literal_runs("(?i)abc") == ("", []) and RI.literal_runs(r"ab|cd") == ("", [])


def test_fifty_thousand_rules(spark):
    """No limit on the number of rules; series, pattern table and filters take them."""
    rules = rules_from_patterns([f"/api/c{i}/*/end{i % 7}" for i in range(50_000)] + ["/api/*"])
    rnd = random.Random(5)
    urls = [f"/api/c{rnd.randrange(60_000)}/x{rnd.randrange(9)}/end{rnd.randrange(7)}" for _ in range(3000)] + ["/other"]
    df = spark.createDataFrame([(u,) for u in urls], "request_url STRING")

    def want(u):
        m = re.match(r"/api/c(\d+)/[^/]*/end(\d)$", u)
        i = int(m[1]) if m else None
        return f"/api/c{i}/*/end{i % 7}" if m and i < 50_000 and i % 7 == int(m[2]) else "/api/*" if u.startswith("/api/") else u
    expected = {}
    for u in urls:
        expected[want(u)] = expected.get(want(u), 0) + 1
    assert {r["pattern"]: r["count"] for r in stats.uri_patterns(df, rules=rules).collect()} == expected
    listed = [r.replacement for r in rules[:50_000]]
    kept = filters.filter_glob(df, listed).count()
    assert kept == filters.filter_uri_patterns(df, [f"{p}$" for p in listed]).count() == sum(want(u) not in ("/api/*", "/other") for u in urls)


def test_series_with_many_rules_equals_few(spark, sf, monkeypatch):
    from reqlens.plans.q_exprs import P5_RULES
    from reqlens.sources.fixtures import requests_relation
    req = requests_relation(spark, sf)
    a = sorted(map(tuple, series.requests_per_uri(req, interval="1d", rules=P5_RULES).collect()), key=str)
    t = sorted(map(tuple, series.processing_time_per_uri(req, metric="max", interval="1d", rules=P5_RULES).collect()), key=str)
    monkeypatch.setattr(RI, "FEW", 0)
    assert sorted(map(tuple, series.requests_per_uri(req, interval="1d", rules=P5_RULES).collect()), key=str) == a
    assert sorted(map(tuple, series.processing_time_per_uri(req, metric="max", interval="1d", rules=P5_RULES).collect()), key=str) == t
