"""URL verdicts against every rule tried on every URL."""

import random

from pyspark.sql import functions as F

from ledgerflow.llm.url_filter import judge_urls

from oracle import equal


def brute(url, rules, default="allow"):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url[url.index("://") + 3:]
    n = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n])
    m = next((i for i, c in enumerate(rest[n:]) if c in "?#"), len(rest) - n)
    path = rest[n:n + m]
    best = None
    for h, p, v in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            key = (len(h + p), len(h), v == "block")
            if best is None or key > best[0]:
                best = (key, h + p, v)
    return (host, path, best[1], best[2]) if best else (host, path, None, default)


def test_against_all_rules(spark):
    rnd = random.Random(1)
    label = lambda: rnd.choice(["a", "b", "ab", "a-b", "net", "org", "x1", "é"])
    host = lambda n: ".".join(label() for _ in range(rnd.randint(1, n)))
    path = lambda n: "".join("/" + label() for _ in range(rnd.randint(0, n)))
    rules = list({(host(3), rnd.choice(["", "/", path(2)])): rnd.choice(["allow", "block"]) for _ in range(120)}.items())
    rules = [(h, p, v) for (h, p), v in rules] + [("net", "/", "block"), ("net", "/", "allow")]
    urls = [f"{rnd.choice(['http', 'HTTPS'])}://{host(5).upper() if rnd.random() < .2 else host(5)}{path(4)}"
            f"{rnd.choice(['', '?q=http://net/', '#top', '/'])}" for _ in range(3000)]
    urls += ["http://hot.a.net/x/y"] * 1500 + [None, "", "no scheme", "://", "http://", "http:///p", "http://A..net/a\nb",
                                               "x://y://z/", "http://" + "a." * 200 + "net/" + "p" * 9000]
    df = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    got = judge_urls(df.repartition(7), spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute(urls[r.page_id], rules), urls[r.page_id]


def test_empty_tables(spark):
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    urls = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert judge_urls(urls.where(F.lit(False)), rules).count() == 0
    assert [tuple(r) for r in judge_urls(urls, rules, "block").collect()] == [(1, "a.net", "/", None, "block")]


def test_query(spark):
    ok, why = equal(spark, "op6_url_filter", "/root/testdata/sf0.001")
    assert ok, why
