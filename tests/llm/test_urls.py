"""Listed rules against plain Python; mined rules against counting."""

import itertools
import random

from thornweave.llm import urls

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    tail = rest[end:]
    stop = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    return host, tail[:stop]


def listed(url):
    host, path = parts(url)
    fits = [(len(h) + len(p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = [
    None, "", "no scheme", "://", "http://", "http:///x", "HTTP://WWW.Example.NET/en/a?b#c", "http://example.net/EN/", "http://example.net", "http://net/", "http://xnet/",
    "https://a.example.com/de/1", "https://example.com/de", "https://notexample.com/de/", "http://a.org/fr/?x", "http://a.org/fr", "http://É.ORG/fr/\u00c9", "ftp://u:p@h.net:80/a//b", "http://a.net?q=/x", "http://a.net#/x",
    "x://y://z.net/a", "http://a.net/\nline", "http://.net/", "http://a..net/en/", "javascript:void(0)",
]


def test_listed_rules(spark):
    rows = [(i, u, "x", "clash") for i, u in enumerate(URLS)] + [(None, URLS[6], None, None), (6, URLS[6], "x", "y"), (6, URLS[6], "x", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = sorted([tuple(r)[:5] for r in urls.judged(pages, labels).collect()], key=str)
    assert got == sorted([(i, *parts(u), listed(u)[0], listed(u)[1] or "allow") for i, u, *_ in rows], key=str)
    assert urls.judged(pages.limit(0), labels).collect() == []


def planted(n=900):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        spam = rng.random() < 0.3
        host = f"{rng.choice(['www', 'blog'])}.{'cheap' if spam and rng.random() < 0.9 else rng.choice(['news', 'home', 'cheap2'])}.{rng.choice(['com', 'info'])}"
        path = f"/{'pills' if spam and rng.random() < 0.7 else rng.choice(['a', 'b'])}/{i}"
        rows.append((i, f"http://{host}{path}" + rng.choice(["", "?ref=x", "#top"])))
        if i % 2:
            bad = spam if rng.random() < 0.95 else not spam
            labels.append((i, 0 if bad else 1, None) if rng.random() < 0.5 else (i, None, int(bad)))
    return rows, labels + [(None, 0, 1), (1, None, None), (10**6, 0, 0)]


def test_mined_rules(spark):
    rows, labels = planted()
    pages, marks = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    mining = urls.Mining(support=0.02, least_pages=10, confidence=0.8, tokens=2)
    held = {r.page_id: frozenset(r.t) for r in pages.select("page_id", urls.tokens(pages.url).alias("t")).collect()}
    bad = {}
    for d, q, t in labels:
        if d in held and (q is not None or t is not None):
            bad[d] = bad.get(d, False) or q == 0 or t == 1
    for d, u in rows:  # a listed rule's word goes first
        if listed(u)[1] and held[d]:
            bad[d] = listed(u)[1] == "block"
    bad = {d: b for d, b in bad.items() if held[d]}
    every = sorted({x for d in bad for x in held[d]})
    rules = {}
    for k in (1, 2):
        for s in map(frozenset, itertools.combinations(every, k)):
            of = [bad[d] for d in bad if s <= held[d]]
            if sum(of) >= max(0.02 * len(bad), 10) and sum(of) / len(of) >= 0.8:
                rules[s] = sum(of) / len(of)
    rules = {s: c for s, c in rules.items() if not any(x < s for x in rules)}
    assert rules and {frozenset(r.tokens): round(r.confidence, 9) for r in urls.mined_rules(pages, marks, mining).collect()} == {s: round(c, 9) for s, c in rules.items()}
    for few in (10_000, 0):  # with and without a broadcast
        got = {r.page_id: (r.verdict, r.mined) for r in urls.judged(pages, marks, mining=urls.Mining(0.02, 10, 0.8, 2, few)).collect()}
        for d, t in held.items():
            fit = sorted((-c, " ".join(sorted(s))) for s, c in rules.items() if s <= t)
            said = listed(dict(rows)[d])[1]
            assert got[d] == ((said, None) if said else ("block", fit[0][1]) if fit else ("allow", None))
    assert sum(v == "block" for v, _ in got.values()) > 100


def test_rules_of_four_tokens(spark):
    """Bad only where four tokens stand together; and a rule that holds a much smaller one goes."""
    rows, labels = [], []
    for held in range(16):
        for k in range(40):
            parts = "/".join(f"t{'abcd'[b]}" for b in range(4) if held >> b & 1)
            rows.append((len(rows), f"http://h{held}{'xyz'[k % 3]}/{parts}"))
            labels.append((len(labels), 0 if held == 15 else 1, None))
    for k in range(40):
        rows.append((len(rows), "http://host/one/two/three/four"))
        labels.append((len(labels), 0, None))
    pages, marks = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = {frozenset(r.tokens) for r in urls.mined_rules(pages, marks, urls.Mining(support=0.055)).collect()}
    assert found == {frozenset(f"path:t{x}" for x in "abcd"), *(frozenset([x]) for x in ("host:host", "path:one", "path:two", "path:three", "path:four"))}
    got = {r.page_id: r.verdict for r in urls.judged(pages, marks, mining=urls.Mining(support=0.055)).collect()}
    assert [d for d, v in got.items() if v == "block"] and {d for d, v in got.items() if v == "block"} == {d for d, q, _ in labels if q == 0}


def test_the_method_decides(spark):
    """On the driver's tables rules are mined, and they decide on pages that no listed rule speaks on."""
    from thornweave.llm.common import table

    sf = "/root/testdata/sf0.01"
    rules = urls.mined_rules(table(spark, sf, "pages"), table(spark, sf, "labels")).collect()
    assert rules and all(r.confidence >= 0.6 and r.tokens == sorted(r.tokens) for r in rules)
    assert not any(set(a.tokens) < set(b.tokens) for a in rules for b in rules)
    by_method = urls.query(spark, sf).filter("rule IS NULL").groupBy("verdict").count().collect()
    assert {r.verdict for r in by_method} == {"allow", "block"}


def test_query(spark, sf):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = urls.query(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        rule, verdict = listed(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (*parts(pages[r.page_id]), rule) and r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
