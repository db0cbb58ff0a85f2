import math
import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import url_filter as u
from tidemark.llm.queries import ORACLE_SQL


@pytest.mark.parametrize(
    "url, host, domain, suffix",
    [
        ("http://www.a.co.uk/x", "www.a.co.uk", "a.co.uk", "co.uk"),
        ("HTTPS://User:pw@Blog.Site.ORG.:8080/p?q#f", "blog.site.org", "site.org", "org"),
        ("//cdn.x.net/a", "cdn.x.net", "x.net", "net"),
        ("http://m.name.example.com/", "m.name.example.com", "name.example.com", "example.com"),
        ("http://10.0.0.1:80/x", "10.0.0.1", "10.0.0.1", ""),
        ("http://localhost", "localhost", "localhost", "localhost"),
        ("http://co.uk/", "co.uk", "co.uk", "co.uk"),
        ("not a url", None, None, None),
        ("http:///path", None, None, None),
        ("", None, None, None),
        (None, None, None, None),
    ],
)
def test_parts(spark, url, host, domain, suffix):
    d, s = u.parts(F.col("h"))
    r = spark.createDataFrame([(url,)], "url string").select(u.host_of(F.col("url")).alias("h")).select("h", d.alias("d"), s.alias("s")).first()
    assert r.h == host and (host is None or (r.d, r.s) == (domain, suffix))


def brute(hosts):
    """{host: (n, k)} to {host: (mean, bound)} by the same model in plain Python. Hosts: three labels below a plain suffix."""
    up = {h: (".".join(h.split(".")[-2:]), h.split(".")[-1]) for h in hosts}
    sums = defaultdict(lambda: [0, 0])
    for h, (n, k) in hosts.items():
        for name in (("h", h), ("d", up[h][0]), ("s", up[h][1]), ("all",)):
            sums[name][0] += n
            sums[name][1] += k
    post = {("all",): (sums["all",][1] + 0.5, sums["all",][0] - sums["all",][1] + 0.5)}
    parent = {("s", s): ("all",) for _, s in up.values()} | {("d", d): ("s", s) for d, s in up.values()} | {("h", h): ("d", d) for h, (d, _) in up.items()}
    for level in "sdh":
        units = [x for x in parent if x[0] == level]
        mean = {x: post[parent[x]][0] / sum(post[parent[x]]) for x in units}
        seen = [x for x in units if sums[x][0] > 0]
        z = sum(sums[x][0] * (sums[x][1] / sums[x][0] - mean[x]) ** 2 / (mean[x] * (1 - mean[x])) for x in seen)
        more = sum(sums[x][0] - 1 for x in seen)
        rho = max(u.LEAST_RHO, min(u.MOST_RHO, (z - len(seen)) / more)) if more > 0 else u.LEAST_RHO
        c = 1 / rho - 1
        post |= {x: (mean[x] * c + sums[x][1], (1 - mean[x]) * c + sums[x][0] - sums[x][1]) for x in units}
    out = {}
    for h in hosts:
        a, b = post["h", h]
        out[h] = a / (a + b), a / (a + b) + u.Z * math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
    return out


def world(seed=1):
    r = random.Random(seed)
    pages, good, counts = [], [], {}
    for d in range(30):
        quality = r.choice([0.1, 0.8, 0.9])
        for s in range(r.randint(1, 4)):
            host, n, k = f"h{s}.d{d}.{'org' if d % 2 else 'net'}", 0, 0
            for _ in range(r.choice([1, 5, 60])):
                i = len(pages)
                pages.append((i, f"http://{host}/{i}"))
                if r.random() < 0.6:
                    y = int(r.random() < quality)
                    good.append((i, y))
                    n, k = n + 1, k + y
            counts[host] = (n, k)
    return pages, good, counts


def test_against_plain_python(spark):
    pages, good, counts = world()
    want = brute(counts)
    got = u.reputations(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(good, "page_id long, good int")).collect()
    assert {r.host for r in got} == set(want)
    for r in got:
        assert (r.n, r.k) == counts[r.host] and (r.reputation, r.bound) == pytest.approx(want[r.host], abs=1e-9)


def test_bad_hosts_go_and_unknown_ones_stay(spark):
    pages, good, counts = world(2)
    pages += [(9000, "http://new.d999.org/"), (9001, None), (9002, "no host")]
    kept = {r.host for r in u.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(good, "page_id long, good int")).collect()}
    big = {h: k / n for h, (n, k) in counts.items() if n >= 20}
    assert all((h in kept) == (q > 0.4) for h, q in big.items()) and any(q < 0.4 for q in big.values())
    assert {"new.d999.org", None} <= kept
    # a new host of a bad domain goes with it
    bad = next(h for h, q in big.items() if q < 0.2)
    domain = bad.split(".", 1)[1]
    all_hosts = [h for h in counts if h.endswith("." + domain)]
    assert bad not in kept and all_hosts


def test_cases(spark):
    pages = spark.createDataFrame([(1, "http://a.b.org/", 1), (1, "http://a.b.org/", 2), (None, "http://a.b.org/", 3), (2, None, 4), (3, "http://x.org/" + "p" * 300_000, 5)], "page_id long, url string, n int").selectExpr("*", "1 AS host", "2 AS `a.b`", "3 AS k")
    good = spark.createDataFrame([(1, 1), (1, 0), (2, None), (3, 7), (None, 1)], "page_id long, good int")
    assert u.filter_urls(pages, good).count() == 5
    r = {x.host: (x.n, x.k) for x in u.reputations(pages, good).collect()}
    assert r == {"a.b.org": (2, 2), "x.org": (0, 0), None: (0, 0)}
    none = u.filter_urls(pages, good.limit(0))
    assert none.count() == 5 and {x.reputation for x in none.collect()} == {0.5}
    assert u.filter_urls(pages.limit(0), good).count() == 0


def test_query_equals_its_sql(spark):
    at = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    got = sorted(map(tuple, u.op3_url_reputation(spark, at).collect()))
    assert got == sorted(con.execute(ORACLE_SQL["op3_url_reputation"]).fetchall())
