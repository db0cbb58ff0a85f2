"""URL filter by the empirical-Bayes reputation of hosts.

Pages with a labelled outcome (1 good, 0 bad) give each host a count of labelled and of good pages. Host names shrink along a chain of beta-binomial priors: suffix towards all pages, registered domain towards its suffix, host towards its registered domain. The prior of a level is Beta(m c, (1 - m) c), m being the parent's posterior mean and c = 1 / rho - 1 the level's concentration, with rho, the correlation of two pages of one unit, estimated by the method of moments over all units of the level: rho = (sum z - M) / sum (n - 1), where z = n (k / n - m)^2 / (m (1 - m)) and M is the number of units. A page goes if it is likely that its host is bad: if the posterior's upper bound, mean + Z standard deviations, is below KEEP_AT. A host without labelled pages has its nearest labelled ancestor's posterior as prior; its bound is wide and it stays unless the ancestor is bad.

Host counts are aggregated once and stored; levels above are aggregates of them, so that nothing of the corpus comes to the driver and pages are joined once with their host's row.

Defined cases: a null or hostless URL has a null host and is judged by all pages; user, port, a trailing dot and letter case of a host don't count; an address of numbers is its own domain, with an empty suffix; repeated page rows count each; of several labels of a page the greatest counts; labels that are null or outside 0/1 are ignored; a page with a null id has no label but is judged; without any label the mean is 1/2 and all pages stay; extra columns are never read; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import stored, table, tune, work_dir

#: Suffixes of two labels, besides every last label. The example domains host a site under each name, as private suffixes do.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "com.br", "com.cn", "com.mx", "com.tr", "co.in", "co.kr", "co.za", "com.ar", "github.io", "blogspot.com", "example.com", "example.net", "example.org")
Z, KEEP_AT, LEAST_RHO, MOST_RHO = 1.645, 0.5, 0.001, 0.9


def host_of(url: Column) -> Column:
    """The URL's host in lower case; null where there is none."""
    authority = F.regexp_extract(url, r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#\\\s]*)", 1)
    bare = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"\.?(:[0-9]*)?$", "")
    return F.nullif(F.lower(bare), F.lit(""))


def parts(host: Column, suffixes=SUFFIXES) -> tuple[Column, Column]:
    """(registered domain, suffix)."""
    number = host.rlike(r"^[0-9.]+$|^\[")
    two = F.substring_index(host, ".", -2)
    long = two.isin(*suffixes)
    domain = F.when(number, host).when(long, F.substring_index(host, ".", -3)).otherwise(two)
    return domain, F.when(number, F.lit("")).when(long, two).otherwise(F.substring_index(host, ".", -1))


def _posterior(units: DataFrame, parents: DataFrame, key: str, least: float = LEAST_RHO, most: float = MOST_RHO) -> DataFrame:
    """units (…, key, n, k) with the columns a and b of their posterior. parents: (key, m); each unit has one."""
    met = units.join(parents, key)
    n, k, m = F.col("n"), F.col("k"), F.col("m")
    seen = n > 0
    z = F.when(seen, n * (k / n - m) * (k / n - m) / (m * (1 - m)))
    spread = met.agg(F.sum(z).alias("z"), F.count_if(seen).alias("units"), F.sum(F.when(seen, n - 1)).alias("more"))
    rho = F.greatest(F.lit(least), F.least(F.lit(most), F.when(F.col("more") > 0, (F.col("z") - F.col("units")) / F.col("more")).otherwise(F.lit(least))))
    level = spread.select((1 / rho - 1).alias("c"))  # one row
    c = F.col("c")
    return met.crossJoin(F.broadcast(level)).withColumn("a", m * c + k).withColumn("b", (1 - m) * c + (n - k)).drop("m", "c")


def reputations(pages: DataFrame, outcomes: DataFrame, suffixes=SUFFIXES) -> DataFrame:
    """(host, n, k, reputation, bound) for each host of pages, the null one too. outcomes: (page_id, good)."""
    spark = tune(pages.sparkSession)
    known = outcomes.where("page_id IS NOT NULL AND good IN (0, 1)").groupBy(F.col("page_id").cast("long").alias("page_id")).agg(F.max("good").cast("long").alias("good"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"))
    counts = rows.join(known, "page_id", "left").groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("k"))
    domain, suffix = parts(F.col("host"), suffixes)
    hosts = stored(counts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "k"), f"{work_dir(spark, 'hosts')}/counts")
    mean = F.col("a") / (F.col("a") + F.col("b"))
    root = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k"))
    root = root.select(F.lit(1).alias("all"), (F.col("k") + 0.5).alias("a"), (F.col("n") - F.col("k") + 0.5).alias("b"))
    total = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    named = hosts.where("host IS NOT NULL")
    by_suffix = _posterior(named.groupBy("suffix").agg(*total).withColumn("all", F.lit(1)), root.select("all", mean.alias("m")), "all")
    by_domain = _posterior(named.groupBy("suffix", "domain").agg(*total), by_suffix.select("suffix", mean.alias("m")), "suffix")
    by_host = _posterior(named.select("host", "domain", "n", "k"), by_domain.select("domain", mean.alias("m")), "domain")
    none = hosts.where("host IS NULL").select("host", "n", "k").crossJoin(F.broadcast(root.select("a", "b")))
    sd = F.sqrt(F.col("a") * F.col("b") / ((F.col("a") + F.col("b")) * (F.col("a") + F.col("b")) * (F.col("a") + F.col("b") + 1)))
    return by_host.select("host", "n", "k", "a", "b").unionByName(none).select("host", "n", "k", mean.alias("reputation"), (mean + Z * sd).alias("bound"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, keep_at: float = KEEP_AT, suffixes=SUFFIXES) -> DataFrame:
    """(page_id, url, host, reputation, bound) of the pages that stay."""
    good = reputations(pages, outcomes, suffixes).where(F.col("bound") >= keep_at).select(F.col("host").alias("h"), "reputation", "bound")
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"))
    return rows.join(good, F.col("host").eqNullSafe(F.col("h"))).select("page_id", "url", "host", F.round("reputation", 6).alias("reputation"), F.round("bound", 6).alias("bound"))


def op3_url_reputation(spark, sf_dir):
    """Outcomes are the quality labels of the documents of the same number."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return filter_urls(table(spark, sf_dir, "pages"), outcomes)


_POST = """{name}_met AS (SELECT u.*, p.m FROM {units} u JOIN {parents} p USING ({key})),
 {name}_c AS (SELECT 1 / greatest({least}, least({most}, CASE WHEN sum(CASE WHEN n > 0 THEN n - 1 END) > 0 THEN (sum(CASE WHEN n > 0 THEN n * (k / n - m) * (k / n - m) / (m * (1 - m)) END) - count(*) FILTER (n > 0)) / sum(CASE WHEN n > 0 THEN n - 1 END) ELSE {least} END)) - 1 AS c FROM {name}_met),
 {name} AS (SELECT *, m * c + k AS a, (1 - m) * c + (n - k) AS b FROM {name}_met, {name}_c)"""


def _post(**x) -> str:
    return _POST.format(least=f"{LEAST_RHO}::DOUBLE", most=f"{MOST_RHO}::DOUBLE", **x)


ORACLE = rf"""
WITH page AS (SELECT page_id, url, nullif(lower(regexp_replace(regexp_replace(regexp_extract(url, '^\s*(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#\\\s]*)', 1), '^.*@', ''), '\.?(:[0-9]*)?$', '')), '') AS host FROM pages),
 known AS (SELECT doc_id AS page_id, max(quality) AS good FROM labels WHERE quality IN (0, 1) GROUP BY 1),
 host AS (SELECT host, string_split(host, '.') AS s, count(good)::DOUBLE AS n, coalesce(sum(good), 0)::DOUBLE AS k FROM page LEFT JOIN known USING (page_id) GROUP BY host),
 cut AS (SELECT host, n, k, regexp_matches(host, '^[0-9.]+$|^\[') AS number, array_to_string(s[-2:], '.') AS two, array_to_string(s[-3:], '.') AS three, s[-1] AS one FROM host),
 unit AS (SELECT host, n, k, CASE WHEN number THEN host WHEN two IN {SUFFIXES} THEN three ELSE two END AS domain, CASE WHEN number THEN '' WHEN two IN {SUFFIXES} THEN two ELSE one END AS suffix, 1 AS "all" FROM cut),
 root AS (SELECT 1 AS "all", sum(k) + 0.5 AS a, sum(n) - sum(k) + 0.5 AS b FROM unit),
 root_m AS (SELECT "all", a / (a + b) AS m FROM root),
 s_units AS (SELECT suffix, "all", sum(n) AS n, sum(k) AS k FROM unit WHERE host IS NOT NULL GROUP BY ALL),
 {_post(name="s_post", units="s_units", parents="root_m", key='"all"')},
 s_m AS (SELECT suffix, a / (a + b) AS m FROM s_post),
 d_units AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM unit WHERE host IS NOT NULL GROUP BY ALL),
 {_post(name="d_post", units="d_units", parents="s_m", key="suffix")},
 d_m AS (SELECT domain, a / (a + b) AS m FROM d_post),
 h_units AS (SELECT host, domain, n, k FROM unit WHERE host IS NOT NULL),
 {_post(name="h_post", units="h_units", parents="d_m", key="domain")},
 post AS (SELECT host, a, b FROM h_post UNION ALL SELECT host, a, b FROM unit, root WHERE host IS NULL),
 judged AS (SELECT host, a / (a + b) AS reputation, a / (a + b) + {Z}::DOUBLE * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM post)
SELECT page_id, url, p.host, round(reputation, 6) AS reputation, round(bound, 6) AS bound FROM page p JOIN judged j ON p.host IS NOT DISTINCT FROM j.host WHERE bound >= {KEEP_AT}
"""
