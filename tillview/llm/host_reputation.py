"""URL filter: rules first, else the reputation of the host.

Labelled page outcomes are counted for each host and shrunk from host to registered domain to public suffix to
all pages: at every level the group's rate of good pages has a beta prior around the posterior mean of the
level above, whose strength is fitted to the spread of the groups (beta-binomial, by moments). A host is
blocked when the upper bound of its posterior rate lies under ``least``. Only built-in functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillview.session import stage

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEVELS = ("suffix", "domain", "host")
# Spread of rates that a level is given at least and at most, as intra-class correlation.
LOW, HIGH = 0.0001, 0.5
BOUND, LEAST = 1.645, 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower case) and path; both empty for null and where ``://`` is missing."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substring(rest, F.length(host) + 1, F.length(url))
    path = F.regexp_extract(tail, r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null; of equally long ones the first by name."""
    name = verdict = None
    for what, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        at = rule.find("/")
        base, start = (rule, "") if at < 0 else (rule[:at], rule[at:])
        fits = ((host == base) | host.endswith("." + base)) & path.startswith(start)
        name = F.when(fits, rule) if name is None else name.when(fits, rule)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def domain_and_suffix(host: Column, long_suffixes: Sequence[str]) -> tuple[Column, Column]:
    """Registered domain and public suffix; a suffix is the last label, or one of ``long_suffixes`` (two labels)."""
    name = F.regexp_replace(host, r":[0-9]*$", "")
    two = F.substring_index(name, ".", -2)
    long = two.isin(*long_suffixes) if long_suffixes else F.lit(False)
    return F.when(long, F.substring_index(name, ".", -3)).otherwise(two), F.when(long, two).otherwise(F.substring_index(name, ".", -1))


def reputation(outcomes: DataFrame, long_suffixes: Sequence[str] = (), bound: float = BOUND) -> DataFrame:
    """One row per host: pages, good, mean and upper bound of the posterior rate of good pages.

    ``outcomes``: host, pages, good, counted beforehand as far as possible; hosts may repeat, null counts are 0.
    """
    counted = outcomes.groupBy("host").agg(F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    domain, suffix = domain_and_suffix(F.col("host"), long_suffixes)
    hosts = stage(counted.where("pages > 0").withColumns({"domain": domain, "suffix": suffix}))
    rate = hosts.agg(F.sum("good") / F.sum("pages")).scalar()
    above = None
    for i, level in enumerate(LEVELS):
        keys = [*LEVELS[:i][-1:], level]
        groups = hosts.groupBy(*dict.fromkeys(keys)).agg(F.sum("pages").alias("pages"), F.sum("good").alias("good"))
        groups = groups.withColumn("prior", rate) if above is None else groups.join(above, LEVELS[i - 1])
        p = F.col("prior") * (1 - F.col("prior"))
        excess = F.sum((F.col("good") - F.col("pages") * F.col("prior")) ** 2 - F.col("pages") * p)
        room = F.sum(F.col("pages") * (F.col("pages") - 1) * p)
        spread = F.greatest(F.lit(LOW), F.least(F.lit(HIGH), F.coalesce(excess / F.nullif(room, F.lit(0.0)), F.lit(LOW))))
        strength = groups.agg(1 / spread - 1).scalar()
        found = groups.withColumn("strength", strength)
        weight = F.col("pages") + F.col("strength")
        mean = (F.col("good") + F.col("strength") * F.col("prior")) / weight
        found = found.select(level, "pages", "good", mean.alias("mean"), weight.alias("weight"))
        above = found.select(level, F.col("mean").alias("prior"))
    upper = F.col("mean") + bound * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))
    return found.select("host", "pages", "good", "mean", upper.alias("upper"))


def judge(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    least: float = LEAST,
    long_suffixes: Sequence[str] = (),
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    A page is labelled when the number that ends its path is the doc_id of a row in ``labels``; it is good when
    that document has quality 1 and is not toxic (null quality: not labelled; null toxic: not toxic). Hosts
    without labelled pages are allowed: nothing is known against them. Null urls have an empty host and path.
    Repeated rows are judged alike, an empty table gives an empty result, other columns are not looked at.
    """
    host, path = host_and_path(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    number = F.regexp_extract("path", r"/([0-9]{1,18})(?:\.[A-Za-z0-9]+)?/?$", 1)
    seen = rows.where(number != "").groupBy("host", number.cast("long").alias("doc_id")).agg(F.count("*").alias("n"))
    good = F.when((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) != 1), 1).otherwise(0)
    marks = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(good).alias("good"))
    outcomes = seen.join(marks, "doc_id").groupBy("host").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.col("good")).alias("good"))
    bad = reputation(outcomes, long_suffixes).where(F.col("upper") < least).select("host", F.lit("block").alias("of_host"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    at = rows.join(bad, "host", "left")
    return at.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, "of_host", F.lit("allow")).alias("verdict"))


SQL = r"""
    WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM r),
    p AS (SELECT page_id, coalesce(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                 coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path FROM h),
    m AS (SELECT doc_id, min(CASE WHEN quality = 1 AND coalesce(toxic, 0) <> 1 THEN 1 ELSE 0 END) AS good FROM labels
          WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
    o AS (SELECT host, count(*) AS n, sum(good) AS x FROM p JOIN m
          ON try_cast(regexp_extract(path, '/([0-9]{1,18})(\.[A-Za-z0-9]+)?/?$', 1) AS BIGINT) = doc_id GROUP BY host),
    d AS (SELECT *, array_to_string(list_slice(string_split(regexp_replace(host, ':[0-9]*$', ''), '.'), -2, -1), '.') AS domain,
                 list_extract(string_split(regexp_replace(host, ':[0-9]*$', ''), '.'), -1) AS suffix FROM o),
    g0 AS (SELECT sum(x) / sum(n) AS prior FROM d),
    s1 AS (SELECT suffix, sum(n) AS n, sum(x) AS x, any_value(prior) AS prior FROM d, g0 GROUP BY suffix),
    k1 AS (SELECT 1 / greatest(0.0001, least(0.5, coalesce(sum((x - n * prior) ** 2 - n * prior * (1 - prior)) / nullif(sum(n * (n - 1) * prior * (1 - prior)), 0), 0.0001))) - 1 AS k FROM s1),
    t1 AS (SELECT suffix, (x + k * prior) / (n + k) AS mean FROM s1, k1),
    s2 AS (SELECT domain, suffix, sum(n) AS n, sum(x) AS x FROM d GROUP BY domain, suffix),
    p2 AS (SELECT domain, n, x, mean AS prior FROM s2 JOIN t1 USING (suffix)),
    k2 AS (SELECT 1 / greatest(0.0001, least(0.5, coalesce(sum((x - n * prior) ** 2 - n * prior * (1 - prior)) / nullif(sum(n * (n - 1) * prior * (1 - prior)), 0), 0.0001))) - 1 AS k FROM p2),
    t2 AS (SELECT domain, (x + k * prior) / (n + k) AS mean FROM p2, k2),
    p3 AS (SELECT host, n, x, mean AS prior FROM d JOIN t2 USING (domain)),
    k3 AS (SELECT 1 / greatest(0.0001, least(0.5, coalesce(sum((x - n * prior) ** 2 - n * prior * (1 - prior)) / nullif(sum(n * (n - 1) * prior * (1 - prior)), 0), 0.0001))) - 1 AS k FROM p3),
    t3 AS (SELECT host, (x + k * prior) / (n + k) AS mean, n + k AS w FROM p3, k3),
    bad AS (SELECT host FROM t3 WHERE mean + 1.645 * sqrt(mean * (1 - mean) / (w + 1)) < 0.5),
    f AS (SELECT p.*, CASE WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                           WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                           WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                           WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
    SELECT page_id, host, path, rule,
           CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
                WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END AS verdict FROM f"""
