"""URL filters: rules, host and path by plain code, and the reputation by plain arithmetic."""

import math
import random
import re

import pytest

from loamworks.llm import urls


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.DOTALL).groups()
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), path


def plain_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def names(host):
    parts = host.split(".")
    k = 2 if ".".join(parts[-2:]) in urls.SUFFIXES else 1
    return ".".join(parts[-k - 1 :]), ".".join(parts[-k:])


def level(groups):
    room = sum(n * (n - 1) * p * (1 - p) for n, k, p in groups.values())
    over = sum((k - n * p) ** 2 - n * p * (1 - p) for n, k, p in groups.values())
    w = 1 / (min(max(over / room, 0.001), 0.999) if room > 0 else 0.5) - 1
    return {g: ((p * w + k) / (w + n), w + n) for g, (n, k, p) in groups.items()}


def plain_reputation(outcomes):
    count = lambda key: {g: (sum(1 for u, _ in outcomes if key(u) == g), sum(b for u, b in outcomes if key(u) == g)) for g in {key(u) for u, _ in outcomes}}
    host = lambda u: plain_parts(u)[0]
    ends, domains, hosts = count(lambda u: names(host(u))[1]), count(lambda u: names(host(u))[0]), count(host)
    root = (sum(b for _, b in outcomes) + 1) / (len(outcomes) + 2)
    e = level({g: (n, k, root) for g, (n, k) in ends.items()})
    d = level({g: (n, k, e[names(g)[1]][0]) for g, (n, k) in domains.items()})
    return level({g: (n, k, d[names(g)[0]][0]) for g, (n, k) in hosts.items()}), d, e


def some():
    rng = random.Random(4)
    hosts = {f"{s}{n}.{d}": rng.choice([0.05, 0.1, 0.95]) for n in ("able", "bake", "crab", "dune") for s in ("", "www.") for d in ("example.org", "shop.co.uk", "x.com", "net", "example.net", "a.example.com")}
    outcomes = [(f"https://{h}/{rng.choice(['en', 'de', 'fr'])}/{i}", int(rng.random() < bad)) for h, bad in hosts.items() for i in range(rng.randint(0, 25))]
    return [u for u, _ in outcomes] + [f"http://{h.upper()}/fr/x?y" for h in hosts] + ["http://new.example.org/", "http://new.zone/a", "ftp://ABLE.x.com", "x.com/en/", "", None, "https://example.net/en/a", "https://badexample.com/de/", "a://b://c/d", "://", "http://é.org/fr/", "http://h.com:80/de/#x", "http://example.com/de/?q\n#", "http://user@example.com/de/1"], outcomes


def test_every_page_equals_plain_arithmetic(spark):
    pages, outcomes = some()
    d = spark.createDataFrame(list(enumerate(pages)), "page_id long, url string")
    o = spark.createDataFrame([*outcomes, (None, 1), ("http://a.org/1", None)], "url string, bad int")
    got = {r["page_id"]: r for r in urls.judged(spark, d, o).collect()}
    hosts, domains, ends = plain_reputation(outcomes)
    blocked = 0
    for i, url in enumerate(pages):
        host, path = plain_parts(url)
        rule, verdict = plain_rule(host, path)
        if verdict is None:
            m, w = hosts.get(host) or domains.get(names(host)[0]) or ends.get(names(host)[1]) or (0.0, 1.0)
            verdict = "block" if m - urls.Z * math.sqrt(m * (1 - m) / (w + 1)) > urls.BAD_RATE else "allow"
            blocked += verdict == "block"
        assert tuple(got[i]) == (i, host, path, rule, verdict), url
    assert blocked > 20
    mine = {r["host"]: (r["mean"], r["weight"]) for r in urls.reputation(spark, o)[0].collect()}
    assert set(mine) == set(hosts) and all(mine[h] == pytest.approx(hosts[h]) for h in hosts)


def test_few_labels_are_shrunk_and_many_are_believed(spark):
    other = [(f"http://h{i}.fine.org/{j}", int(j < 3)) for i in range(400) for j in range(10)]
    o = other + [(f"http://often{i}.fine.org/{j}", int(j < 36)) for i in range(3) for j in range(40)] + [("http://once.fine.org/1", 1)]
    hosts = {r["host"]: r for r in urls.reputation(spark, spark.createDataFrame(o, "url string, bad int"))[0].collect()}
    assert hosts["once.fine.org"]["mean"] < 0.5 < 0.7 < hosts["often1.fine.org"]["mean"]
    pages = spark.createDataFrame([(1, "http://once.fine.org/x"), (2, "http://often1.fine.org/x"), (3, "http://h1.fine.org/x")], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.judged(spark, pages, spark.createDataFrame(o, "url string, bad int")).collect()}
    assert got == {1: "allow", 2: "block", 3: "allow"}


def test_nulls_repeats_clashing_names_and_empty_tables(spark, monkeypatch):
    rows = [(None, "http://a.com/1", "x", 1), (None, "http://a.com/1", "x", 1), (2, None, None, None), (2, "http://" + "a" * 1_000_000 + ".com/" + "b" * 1_000_000, "y", 2)]
    d = spark.createDataFrame(rows, "page_id long, url string, host string, bad int")
    o = spark.createDataFrame([("http://a.com/2", 1)] * 50, "url string, bad int")
    for most in (10, 0):  # blocked hosts sent to all tasks, and joined
        monkeypatch.setattr(urls, "BROADCAST_IDS", most)
        got = sorted(((r["page_id"], r["host"][:5], r["verdict"]) for r in urls.judged(spark, d, o).collect()), key=str)
        assert got == sorted([(None, "a.com", "block"), (None, "a.com", "block"), (2, "", "allow"), (2, "aaaaa", "block")], key=str)
        assert [tuple(r) for r in urls.allowed(spark, d, o).collect()] == [(2, None, None, None)]
    assert urls.judged(spark, d.limit(0), o).collect() == []
    assert {r["verdict"] for r in urls.judged(spark, d, o.limit(0)).collect()} == {"allow"}
    labels = spark.createDataFrame([(7, 0, 0), (7, 1, 0), (8, 1, 0), (9, 1, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    p = spark.createDataFrame([(f"http://a.org/en/{x}",) for x in ("7.html?x", "8/", "9#a", "10", "7x")], "url string")
    assert {(r["url"][16:], r["bad"]) for r in urls.outcomes_of(p, labels).collect()} == {("7.html?x", 1), ("8/", 0), ("9#a", 1)}
