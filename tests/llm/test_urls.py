import random

import numpy as np

from riskmart.llm import urls

URLS = ["http://a.com/x", "https://Example.COM/en/1?q#f", "http://www.example.com/en/", "ftp://m.www.example.com/en/x",
        "http://x.net/es/1", "http://net/fr/", "http://xnet/fr/", "http://com", "http://com/", None, "no scheme", "", "://net/es/",
        "http://example.com/EN/", "http://example.com?/en/", "http://a.example.com/en", "x://y://com/", "http://.net/es/", "http://com./a"]


def by_hand(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = rest
        for c in "/?#":
            host = host.split(c)[0]
        path = rest[len(host):].split("?")[0].split("#")[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[1:] if fit else (None, "allow")))


def test_every_url_by_hand(spark):
    rnd = random.Random(2)
    more = ["http://" + ".".join(rnd.choice(["www", "example", "com", "net", "a"]) for _ in range(rnd.randint(1, 4)))
            + rnd.choice(["", "/", "/en/", "/es/", "/fr/", "/en"]) + rnd.choice(["", "x", "?en/"]) for _ in range(300)]
    rows = list(enumerate(URLS + more)) + [(None, "http://x.net/es/"), (4, URLS[4])]
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in rows], "page_id long, url string, host string, rule string")
    rules = spark.createDataFrame(urls.RULES, "verdict string, host string, path string")
    want = sorted(str((i, *by_hand(u))) for i, u in rows)
    for size in (urls.FILTER_BYTES, 1):       # one filter; one for each key or so
        got = urls.judge_urls(df, rules, filter_bytes=size).collect()
        assert sorted(str((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in got) == want
    assert urls.judge_urls(df.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.judge_urls(df, rules.limit(0)).collect()} == {"allow"}


def test_filter_has_no_false_negatives():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 2**63, 20000).astype(np.uint64)
    bloom = urls.build_filter(h[:10000])
    assert urls.may_hold(bloom, h[:10000]).all()
    assert urls.may_hold(bloom, h[10000:]).mean() < 0.01


def test_hosts_of_many_labels_and_rules_listed_twice(spark):
    import time
    long = "a." * 300_000
    rows = [(1, f"http://{long}example.com/en/x"), (2, f"http://{long}com/"), (3, "http://q.net/"), (4, f"http://{long}org/")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    rules = spark.createDataFrame([("example.com", "/en/", "block"), ("com", "/", "allow"), ("net", "/", "allow"), ("net", "/", "block")],
                                  "host string, path string, verdict string")
    begun = time.time()
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge_urls(df, rules).collect()}
    assert got == {1: ("example.com/en/", "block"), 2: ("com/", "allow"), 3: ("net/", "block"), 4: (None, "allow")}
    assert time.time() - begun < 60
