from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marlstone.llm import url_lists


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def entries(spark, rows):
    return spark.createDataFrame(rows, "category string, domain string, listed boolean, since timestamp_ntz, id long")


def captures(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, fetched_at timestamp_ntz, domain string, n string, category string")


def test_host(spark):
    urls = {"http://A.Example.com/x": "a.example.com", "https://u:p@h.org:81/": "h.org", "http://h.org.?q": "h.org", "mailto:x": None, None: None, "": None, "http:///x": None, "http://[2001:DB8::1]:80/a": "[2001:db8::1]", "http://u@[::1]/": "[::1]", "http://[::1": None, "http://10.0.0.1:8/": "10.0.0.1"}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(url_lists.host(F.col("u"))).collect()] == list(urls.values())


def test_intervals(spark):
    e = entries(spark, [
        ("a", "x.com", True, day(1), 1), ("a", "X.com", True, day(2), 2), ("a", "x.com", False, day(3), 3), ("a", "x.com", True, day(5), 4), ("a", "x.com", False, day(5), 5),
        ("b", "y.com", False, day(1), 6), (None, "z.com", True, day(1), 7), ("a", None, True, day(1), 8), ("a", "w.com", None, day(1), 9),
    ])
    got = sorted((r["category"], r["domain"], r["valid_from"], r["valid_to"]) for r in url_lists.intervals(e).collect())
    assert [x[:3] for x in got] == [("a", "x.com", day(1)), ("a", "x.com", day(5))] and [x[3] for x in got] == [day(3), None]


def test_as_of(spark):
    e = entries(spark, [("spam", "bad.com", True, day(2), 1), ("spam", "bad.com", False, day(4), 2), ("adult", "sub.bad.com", True, day(3), 3), ("spam", "com", True, day(0), 4), ("local", "intranet", True, day(0), 5)])
    c = captures(spark, [(1, "http://bad.com/", day(1), "q", "q", "q"), (2, "http://bad.com/", day(2), "q", "q", "q"), (3, "http://x.sub.bad.com/", day(3), "q", "q", "q"), (4, "http://sub.bad.com/", day(4), "q", "q", "q"),
                         (5, "http://notbad.com/", day(3), "q", "q", "q"), (6, None, day(3), "q", "q", "q"), (7, "http://bad.com/", None, "q", "q", "q"), (2, "http://bad.com/", day(2), "q", "q", "q"), (None, "http://intranet/", day(1), "q", "q", "q")])
    got = sorted((str(r["page_id"]), r["n_matches"], r["categories"]) for r in url_lists.evaluate(c, e).collect())
    assert got == [("1", 0, None), ("2", 1, "spam"), ("2", 1, "spam"), ("3", 2, "adult,spam"), ("4", 1, "adult"), ("5", 0, None), ("6", 0, None), ("7", 0, None), ("None", 1, "local")]


def test_empty(spark):
    none = entries(spark, [])
    assert url_lists.evaluate(captures(spark, []), none).count() == 0
    assert url_lists.evaluate(captures(spark, [(1, "http://a.b/", day(1), "", "", "")]), none).first()["blocked"] is False


def test_addresses_have_no_parents(spark):
    e = entries(spark, [("spam", "0.1", True, day(0), 1), ("spam", "[2001", True, day(0), 2), ("adult", "[::1]", True, day(0), 3)])
    c = captures(spark, [(1, "http://10.0.0.1/", day(1), "", "", ""), (2, "http://[2001:db8::1]/", day(1), "", "", ""), (3, "https://[::1]:8080/x", day(1), "", "", "")])
    assert {r["page_id"]: r["categories"] for r in url_lists.evaluate(c, e).collect()} == {1: None, 2: None, 3: "adult"}


@pytest.mark.parametrize("per_task", [7, 10**6])
def test_long_history_and_hot_domain(spark, per_task):
    """A thousand changes of one domain in two categories, and many captures of it, against a loop; no join multiplies by the history."""
    r = random.Random(1)
    rows = [(r.choice(["a", "b"]), r.choice(["hot.com", "hot.com", "hot.com", "sub.hot.com", "x.org"]), r.random() < 0.5, day(k // 2), k) for k in range(1000)]
    caps = [(k, f"http://{r.choice(['hot.com', 'sub.hot.com', 'deep.sub.hot.com', 'x.org', 'y.org'])}/", day(r.randrange(-5, 510)) + dt.timedelta(hours=r.choice([0, 5])), "", "", "") for k in range(400)]
    want = []
    for i, url, at, *_ in caps:
        name = url.split("/")[2]
        found = []
        for d in {".".join(name.split(".")[k:]) for k in range(len(name.split(".")) - 1)}:
            for cat in ("a", "b"):
                state, since = False, None
                times = sorted({t for c, dom, _, t, _ in rows if (c, dom) == (cat, d)})
                for t in times:
                    now = any(on for c, dom, on, u, _ in rows if (c, dom, u) == (cat, d, t))
                    if t <= at and now != state:
                        state, since = now, t
                if state:
                    found.append((cat, since))
        want.append((i, len(found), ",".join(sorted({c for c, _ in found})) or None, min((t for _, t in found), default=None)))
    out = url_lists.evaluate(captures(spark, caps), entries(spark, rows), per_task=per_task)
    assert sorted((x["page_id"], x["n_matches"], x["categories"], x["active_since"]) for x in out.collect()) == want
