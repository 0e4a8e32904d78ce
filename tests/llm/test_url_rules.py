"""URL rules against a plain loop over all rules."""

import random
import re

import pytest

from trialloom.llm import url_rules
from trialloom.llm.queries import URL_RULES

RULES = "host string, path string, verdict string"


def split(url):
    at = (url or "").find("://")
    if url is None or at < 0:
        return "", ""
    found = re.match(r"([^/?#]*)([^?#]*)", url[at + 3 :])
    return re.sub("[A-Z]", lambda m: m.group().lower(), found[1]), found[2]


def plain_version(url, rules, otherwise="allow"):
    host, path = split(url)
    best = None
    for rule_host, rule_path, verdict in rules:
        if rule_host is None or verdict not in ("allow", "block"):
            continue
        rule_path = rule_path or ""
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith(rule_path):
            key = (len(rule_host + rule_path), rule_host.count("."), verdict)
            best = max(best or (key,), (key, rule_host + rule_path, verdict))
    return (host, path, best[1], best[2]) if best else (host, path, None, otherwise)


def judged(spark, urls, rules, **more):
    pages = spark.createDataFrame([(i, u, "x", 3) for i, u in urls], "page_id long, url string, host string, length int")
    found = url_rules.judge(pages, spark.createDataFrame(rules, RULES), **more)
    assert found.columns == ["page_id", "host", "path", "rule", "verdict"]
    return sorted(map(repr, (tuple(r) for r in found.collect())))


def expected(urls, rules, **more):
    return sorted(repr((i, *plain_version(u, rules, **more))) for i, u in urls)


EDGES = [
    None, "", "no scheme", "http://", "http://org", "http://org/", "HTTPS://WWW.Example.ORG/es/x?a=b/c#d", "http://example.org/en/1",
    "http://example.org/en/12", "http://notexample.org/es/", "http://a.b.example.org/es", "http://example.org./es/", "x://y://org/",
    "http://example.org?/es/", "http://example.org#/es/", "http://ÄB.com/fr/", "http://com/fr/", "http://.com/de/é😀", "http://a..com/de/",
    "http://user@a.com:80/fr/", "http://a.com/fr/" + "z" * 100_000, "http://" + "a." * 5_000 + "com/de/", "http://a.com/fr\n/x", "://com/de/",
]


def test_the_query_rules_on_edge_cases(shipped):
    urls = list(enumerate(EDGES)) + [(None, "http://a.com/de/x"), (None, None), (7, "http://a.com/de/x"), (7, "http://a.com/de/x")]
    assert judged(shipped, urls, URL_RULES) == expected(urls, URL_RULES)


@pytest.mark.parametrize("seed", range(3))
def test_random_rules_and_urls(shipped, seed):
    rng = random.Random(seed)
    label = lambda: rng.choice(["a", "b", "com", "org", ""])
    host = lambda most: ".".join(label() for _ in range(rng.randint(1, most)))
    path = lambda: "/" + "".join(rng.choice(["x", "/", "yy", "é"]) for _ in range(rng.randint(0, 4)))
    rules = [(host(3), rng.choice([path(), "", None]), rng.choice(["allow", "block", "block", "other", None])) for _ in range(60)]
    rules += [(None, "/", "block"), *rules[:5]]
    # Rules of one host and path: the stricter wins; a null path and an empty one are the same.
    urls = [(i, f"{rng.choice(['http', ''])}://{host(5)}{rng.choice([path(), '', '?q', '#f'])}") for i in range(400)]
    assert judged(shipped, urls, rules, otherwise="block") == expected(urls, rules, otherwise="block")


def test_short_hashes_that_collide_are_told_apart(shipped, monkeypatch):
    full = url_rules.hashed
    monkeypatch.setattr(url_rules, "hashed", lambda e: [(full(e)[0] % 2).alias("short"), full(e)[1]])
    urls = [(i, f"http://h{i}.com/{'fr' if i % 3 else 'de'}/{i}") for i in range(50)] + list(enumerate(EDGES))
    assert judged(shipped, urls, URL_RULES) == expected(urls, URL_RULES)


def test_empty_tables(shipped):
    assert judged(shipped, [], URL_RULES) == []
    urls = [(1, "http://a.com/de/"), (2, None)]
    assert judged(shipped, urls, []) == expected(urls, [])
    with pytest.raises(ValueError):
        judged(shipped, urls, [], otherwise="maybe")
