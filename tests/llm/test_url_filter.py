from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionlake.llm import url_filter
from sessionlake.llm.url_filter import Reputation, judge_urls

CASES = [
    ("http://a.example.net/en/1", "a.example.net", "/en/1", "example.net/en/", "allow"),
    ("http://EXAMPLE.NET/en/", "example.net", "/en/", "example.net/en/", "allow"),
    ("http://example.net/en", "example.net", "/en", "net/", "block"),
    ("http://badexample.net/en/", "badexample.net", "/en/", "net/", "block"),
    ("http://x.net", "x.net", "", None, "allow"),
    ("http://x.net?q=/", "x.net", "", None, "allow"),
    ("http://net/", "net", "/", "net/", "block"),
    ("https://www.example.com/de/x?y#z", "www.example.com", "/de/x", "example.com/de/", "block"),
    ("https://example.com/fr/x", "example.com", "/fr/x", None, "allow"),
    ("ftp://o.org/fr/a://b", "o.org", "/fr/a://b", "org/fr/", "allow"),
    ("no scheme", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("://ÄB.com/É", "Äb.com", "/É", None, "allow"),
]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(k, c[0]) for k, c in enumerate(CASES)], "page_id long, url string").selectExpr("*", "'h' AS host", "1 AS verdict", "2 AS n")
    none = spark.createDataFrame([], "page_id long, good int")
    got = {r.page_id: tuple(r)[1:] for r in judge_urls(pages, none).collect()}
    assert got == {k: c[1:] for k, c in enumerate(CASES)}
    assert judge_urls(pages.limit(0), none).collect() == []


def test_bad_hosts_are_blocked_and_good_ones_not(spark):
    rng = random.Random(1)
    pages, outcomes = [], []
    for h in range(40):
        bad = h < 4
        for _ in range(60):
            k = len(pages)
            pages.append((k, f"http://h{h}.site{h % 7}.com/p"))
            if rng.random() < 0.6:
                outcomes.append((k, int(rng.random() < (0.05 if bad else 0.95))))
    pages.append((10**6, "http://new.site1.com/"))
    df, out = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame([*outcomes, (None, 1), (5, None)], "page_id long, good int")
    got = {(r.host, r.verdict) for r in judge_urls(df, out, rules={}).collect()}
    assert {h for h, v in got if v == "block"} == {f"h{h}.site{h}.com" for h in range(4)}
    assert ("new.site1.com", "allow") in got


def test_shrinkage_goes_to_the_parent(spark):
    pages = spark.createDataFrame([(k, f"h{k % 30}.d{k % 3}.co.uk") for k in range(300)], "page_id long, name string")
    outcomes = spark.createDataFrame([(k, int(k % 3 != 0)) for k in range(0, 300, 2)], "page_id long, good int")
    from sessionlake.llm.shared import shared_folder

    rows = url_filter.host_reputation(pages, outcomes, Reputation(), shared_folder(spark)).collect()
    assert len(rows) == 30
    assert all(0 < r["mean"] < 1 for r in rows)
    assert {r.name for r in rows if r.blocked} == {r.name for r in rows if r.name.split(".")[1] == "d0"}
    unseen = {r.name: r["mean"] for r in rows if r.n == 0}
    for h, m in unseen.items():
        assert (m < 0.5) == (h.split(".")[1] == "d0")


def test_registered_domains(spark):
    rows = [("a.b.co.uk", "b.co.uk", "co.uk"), ("a.example.com", "example.com", "com"), ("com", "com", "com"), ("", "", ""), ("x.y", "x.y", "y")]
    df = spark.createDataFrame(rows, "host string, d string, s string")
    bad = df.filter((F.regexp_extract("host", url_filter.DOMAIN, 0) != F.col("d")) | (F.regexp_extract("host", url_filter.SUFFIX, 0) != F.col("s")))
    assert bad.collect() == []


def test_names_of_hosts(spark):
    rows = [("u:p@Example.com:8080", "Example.com"), ("example.com.", "example.com"), ("1.2.3.4:80", "1.2.3.4"), ("[::1]:80", "[::1]"), ("[::1]", "[::1]"), ("a.b", "a.b"), ("", ""), (":", "")]
    got = spark.createDataFrame(rows, "host string, want string").select("want", url_filter.name_of(F.col("host")).alias("name")).collect()
    assert all(r.want == r.name for r in got)


def test_ports_and_addresses_in_the_hierarchy(spark):
    """Bad pages of a host on one port tell of its others, and of its domain; addresses have no domain in common."""
    pages = [(k, f"http://{h}/") for k, h in enumerate(["bad.com:81", "bad.com.", "u@bad.com", "x.bad.com:9"] * 30 + ["9.9.9.9"] * 30 + ["good.com"] * 60 + ["9.8.9.9", "new.bad.com:1"])]
    outcomes = [(k, int("good" in u)) for k, u in pages if not u.startswith("http://new") and "9.8" not in u]
    rows = judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, good int"), rules={}).collect()
    got = {(r.host, r.verdict) for r in rows}
    assert got >= {(h, "block") for h in ("bad.com:81", "bad.com.", "u@bad.com", "x.bad.com:9", "9.9.9.9")} | {("good.com", "allow")}


def test_beta_tail_is_the_integral(spark):
    """Against sums over a fine grid of the density in the logit, where it is smooth."""
    cases = [(a, b, x) for a in (0.02, 0.5, 1.0, 3.7, 60.0, 4000.0) for b in (0.03, 0.5, 2.0, 55.5, 3900.0) for x in (0.2, 0.5, 0.9)]
    df = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(cases)], "k int, a double, b double")
    for x in (0.2, 0.5, 0.9):
        got = {r.k: r.v for r in df.select("k", url_filter.beta_below(F.col("a"), F.col("b"), x, 200).alias("v")).collect()}
        for k, (a, b, at) in enumerate(cases):
            if at != x:
                continue
            mid, wide = np.log(a / b), 60 * np.sqrt(1 / a + 1 / b) + 60 / min(a, b, 1)
            t = np.linspace(mid - wide, mid + wide, 2_000_001)
            log_density = -a * np.logaddexp(0, -t) - b * np.logaddexp(0, t)
            density = np.exp(log_density - log_density.max())
            below = t < np.log(x / (1 - x))
            assert got[k] == pytest.approx(density[below].sum() / density.sum(), abs=2e-3)
            assert 0 <= got[k] <= 1 + 1e-12
