import random
import re

from borelake.llm import urls
from borelake.llm.urls import pattern, place


def brute(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c.group().lower(), m.group(1)), m.group(2)) if m else ("", "")
    fits = [r for r in rules if r.kind == "place" and re.search(r.expression, host + path)]
    best = max(fits, key=lambda r: (len(r.name), r.verdict == "block"), default=None)
    blocked = any(re.search(r.expression, host + path) for r in rules if r.kind == "pattern")
    return host, path, best and best.name, best.verdict if best else "block" if blocked else "allow"


RULES = [*urls.PLACES, *urls.PATTERNS, place("a.org", "/x", "block"), place("a.org", "/xy", "allow"), place("org", "/", "allow"), pattern("q[0-9]+z"), pattern("^b", )]
ODD = [None, "", "no scheme", "http://", "://", "http://COM/", "http://com", "http://a.com/EN/", "http://x.example.com/en/", "http://www.EXAMPLE.com/en/a?b#c", "https://notexample.com/en/", "a://b://c.com/", "http://a.net/es/x", "http://net/es", "http://a.org/xyz", "http://b.a.org/x#y", "http://ads-track.a.b/", "http://adult-x.example.com/de/1", "http://é.com/ü?", "http://u@h.com:80/p", "http://x.org?q=1/", "http://h.net\n/fr/"]


def test_against_all_rules(spark):
    rng = random.Random(4)
    hosts = ["example.com", "www.example.com", "m.example.net", "a.org", "z.a.org", "free-bets.example.net", "x.casino-win.io", "b7.io", "com"]
    rows = ODD + [f"http://{rng.choice(hosts)}/{rng.choice(['en', 'es', 'fr', 'xy', 'q12z', 'EN'])}{rng.choice(['/', '', '/1?x', '#a'])}" for _ in range(400)]
    df = spark.createDataFrame([(k, u, "own", "own") for k, u in enumerate(rows)], "page_id long, url string, verdict string, token string")
    want = {k: brute(u, RULES) for k, u in enumerate(rows)}
    for block in (3, 1000):
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df, RULES, block=block).collect()}
        assert got == want
    assert urls.judge(df.limit(0), RULES).count() == 0
    assert {r["verdict"] for r in urls.judge(df, []).collect()} == {"allow"}
    assert urls.keep_allowed(df, RULES).count() == sum(w[3] == "allow" for w in want.values())


def test_rarest_token_files_a_rule(spark):
    rules = [place("example.com", "/en/", "block"), place("example.com", "/en", "block")]
    assert rules[0].tokens == ("example", "com", "en") and rules[1].tokens == ("example", "com")
    assert urls.filed(rules, {"example": 5, "com": 9, "en": 2}) == {"en": [0], "example": [1]}
