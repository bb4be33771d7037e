from __future__ import annotations

import re
from collections import Counter

from loglake.llm.op2_url_filter import LISTED, RULES, judge_urls

URLS = [
    "http://example.org/es/1", "https://A.EXAMPLE.org/en/12?x", "http://notexample.org/es/", "http://x.com/fr/", "http://x.com",
    "http://org/", "https://com/de/a#b", "x.com/fr/", None, "", "://", "http://", "http://a.b.example.org/es",
    "ftp://x.org?q=http://y.com/de/", "http://www.spam-farm.example.org/a", "http://cheap-pills.example.com/fr/1",
    "http://m.cheap-pills.example.com/en/1", "http://x.com:80/fr/1", "http://é.com/fr/\n", "http://x.com/fr/" + "a" * 5000,
]


def brute(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)

    def fits(h, p):
        return (host == h or host.endswith("." + h)) and path.startswith(p)

    found = sorted((len(h + p), len(h), h + p, v) for h, p, v in RULES if fits(h, p))
    listed = any(fits(*re.match(r".*?://([^/]*)(.*)", u).groups()) for u in LISTED)
    rule, verdict = found[-1][2:] if found else (None, "block" if listed else "allow")
    return host, path, rule, verdict


def tables(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, key string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return pages, rules, spark.createDataFrame([(u,) for u in LISTED], "url string")


def test_urls(spark):
    rows = [(i, u, "h", None) for i, u in enumerate(URLS)] + [(None, URLS[0], None, None), (3, URLS[3], "x", "y")]
    got = Counter(map(tuple, judge_urls(*tables(spark, rows)).collect()))
    assert got == Counter((i, *brute(u)) for i, u, _, _ in rows)


def test_empty_tables(spark):
    pages, rules, listed = tables(spark, [])
    assert judge_urls(pages, rules, listed).count() == 0
    some, _, _ = tables(spark, [(1, URLS[0], None, None)])
    got = judge_urls(some, rules.limit(0), listed.limit(0)).collect()
    assert [tuple(r) for r in got] == [(1, "example.org", "/es/1", None, "allow")]
