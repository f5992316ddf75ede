import re

import pandas as pd

from scanloom.llm import url_filter as u

URLS = [
    "http://a.example.org/en/1x?y", "https://example.org/es/", "https://example.org/es", "http://notexample.org/es/1", "HTTP://M.Example.COM/fr/9#t", "x.com/fr/", None, "", "://", "http://org/", "http://xorg/",
    "https://com/de/a", "https://h.com/de", "http://q.net?x=/fr/", "http://q.org", "a://b://c.org/d", "http://ex.com/de/\nnext", "http://Ä.ORG/",
]


def plain(url):
    if not url or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule(host, path):
    fits = []
    for r, v in u.RULES:
        h, _, p = r.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(r), r, v))
    return max(fits)[1:] if fits else (None, None)


def test_rules(spark):
    got = u.judge(spark.createDataFrame([(k, x, 1) for k, x in enumerate(URLS)], "page_id long, url string, host int")).collect()
    assert len(got) == len(URLS)
    for r in got:
        host, path = plain(URLS[r.page_id])
        name, verdict = rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, name)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def test_model_learns_held_out_urls(spark):
    rows = [(f"h{k}.example.net", f"/{'shop' if k % 2 else 'news'}/item-{k * 37}", k % 2 == 0) for k in range(600)]
    labelled = spark.createDataFrame(rows[:400], "host string, path string, allow boolean")
    pages = spark.createDataFrame([(k, f"http://{h}{p}") for k, (h, p, _) in enumerate(rows[400:])], "page_id long, url string")
    got = {r.page_id: r.verdict for r in u.judge(pages, labelled).collect()}
    right = sum((got[k] == "allow") == allow for k, (_, _, allow) in enumerate(rows[400:]))
    assert right >= 190


def test_one_class_or_none():
    none, some = pd.Series([], dtype=object), pd.Series(["a.net"])
    assert u.train(none, none, pd.Series([], dtype=bool).to_numpy()).score(some, some)[0] > 0.5
    assert u.train(some, some, pd.Series([False]).to_numpy()).score(some, some)[0] < 0.5


def test_empty_table(spark):
    assert u.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
