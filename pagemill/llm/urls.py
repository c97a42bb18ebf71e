"""URL filtering: fixed rules first, then an empirical-Bayes reputation of the host.

Labelled page outcomes are counted by host, registered domain and suffix.  Each level's bad
share has a beta prior whose mean is the posterior mean of the level above (the suffix's is the
overall share) and whose weight is estimated from how much the groups of that level differ.
A page that no rule fits is blocked if the lower posterior bound of its host's bad share
exceeds a limit; a host without labels has its prior.

Edge cases: a null url or one without ``://`` has empty host and path; a host without a dot is
its own domain and suffix, and so is an address; user and port are no part of either; without labels everything is allowed that no rule blocks; repeated
pages each get a row; labels that repeat for a page count each; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.store import saved

#: (verdict, host and path); a rule fits the host and its subdomains.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "co.nz", "com.br", "co.in", "co.za")
LIMIT = 0.5
#: Standard deviations from the posterior mean to its lower bound: one-sided 95 %.
SIGMAS = 1.645
LEAST_WEIGHT, MOST_WEIGHT = 2.0, 1000.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def name_of(host: Column) -> Column:
    """The host without user and port."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")


def domain_of(host: Column) -> Column:
    """What is registered: a suffix of one or two labels and the label before it; addresses are whole."""
    host = name_of(host)
    labels = F.split(host, r"\.")
    two = F.array_join(F.slice(labels, -2, 2), ".")
    three = F.array_join(F.slice(labels, -3, 3), ".")
    n = F.size(labels)
    return F.when((n <= 2) | host.rlike(r"^([0-9.]+|\[.*\])$"), host).when(two.isin(*TWO_LABEL_SUFFIXES), F.when(n >= 3, three).otherwise(host)).otherwise(two)


def suffix_of(domain: Column) -> Column:
    return F.when(domain.contains(".") & ~domain.rlike(r"^([0-9.]+|\[.*\])$"), F.regexp_extract(domain, r"(?s)^[^.]*\.(.*)$", 1)).otherwise(domain)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does."""
    rule = verdict = None
    for what, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


@dataclass
class Prior:
    mean: float
    weights: dict[str, float]


def _weight(groups: DataFrame) -> float:
    """Weight of the beta prior of groups (n, bad), from the variance between their shares."""
    row = groups.agg(F.count("*").alias("g"), F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("s")).first()
    g, n = row.g or 0, float(row.n or 0)
    if g < 2 or n <= g:
        return LEAST_WEIGHT
    p = row.bad / n
    between = (row.s - n * p * p - (g - 1) * p * (1 - p)) / (n - row.nn / n)
    if between <= 0 or not 0 < p < 1:
        return MOST_WEIGHT
    return min(MOST_WEIGHT, max(LEAST_WEIGHT, p * (1 - p) / between - 1))


def reputations(pages: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, Prior]:
    """Counts by host, domain and suffix, and the priors.

    ``pages`` has page_id, host, domain and suffix; ``outcomes`` has page_id and bad (0/1).
    """
    labelled = pages.select("page_id", "host", "domain", "suffix").join(outcomes.where("bad in (0, 1)").select("page_id", "bad"), "page_id")
    # a row for each host: read by all that follows, so that pages and labels are joined once
    by_host = labelled.groupBy("host", "domain", "suffix").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    by_host = saved(by_host, "hosts")
    by_domain = by_host.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    by_suffix = by_domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    row = by_suffix.agg(F.sum("n"), F.sum("bad")).first()
    mean = float(row[1]) / float(row[0]) if row[0] else 0.0
    return by_host, by_domain, by_suffix, Prior(mean, {"host": _weight(by_host), "domain": _weight(by_domain), "suffix": _weight(by_suffix)})


def bounds(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row for each host of ``pages``: host, bad_share (posterior mean) and bad_bound (lower bound)."""
    by_host, by_domain, by_suffix, prior = reputations(pages, outcomes)

    def mean(level: str, above: Column) -> Column:
        w = F.lit(prior.weights[level])
        return (F.coalesce(F.col(f"{level}_bad"), F.lit(0)) + w * above) / (F.coalesce(F.col(f"{level}_n"), F.lit(0)) + w)

    named = lambda df, level: df.select(level, F.col("n").alias(f"{level}_n"), F.col("bad").alias(f"{level}_bad"))
    hosts = pages.select("host", "domain", "suffix").distinct()
    joined = hosts.join(named(by_suffix, "suffix"), "suffix", "left").join(named(by_domain, "domain"), "domain", "left").join(named(by_host, "host"), "host", "left")
    share = mean("host", mean("domain", mean("suffix", F.lit(prior.mean))))
    size = F.coalesce(F.col("host_n"), F.lit(0)) + F.lit(prior.weights["host"]) + 1
    out = joined.select("host", share.alias("bad_share"), size.alias("size"))
    return out.select("host", "bad_share", (F.col("bad_share") - SIGMAS * F.sqrt(F.col("bad_share") * (1 - F.col("bad_share")) / F.col("size"))).alias("bad_bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple = RULES, limit: float = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict and bad_bound for every row of ``pages`` (page_id, url)."""
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    split = split.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("domain")))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    found = split.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    own = F.when(F.col("bad_bound") > limit, "block").otherwise("allow")
    return found.join(bounds(split, outcomes), "host", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "bad_bound")


def page_outcomes(labels: DataFrame) -> DataFrame:
    """Outcomes from the labels table, where a page is labelled by its number: bad quality is bad."""
    return labels.select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))


_SQL_WEIGHT = """
  SELECT CASE WHEN g < 2 OR n <= g THEN 2.0
    WHEN NOT (p > 0 AND p < 1) OR v <= 0 THEN 1000.0
    ELSE least(1000.0, greatest(2.0, p * (1 - p) / v - 1)) END AS w
  FROM (SELECT g, n, p, (s - n * p * p - (g - 1) * p * (1 - p)) / nullif(n - nn / n, 0) AS v
    FROM (SELECT count(*) AS g, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) / sum(n) AS p,
      CAST(sum(n * n) AS DOUBLE) AS nn, sum(CAST(bad * bad AS DOUBLE) / n) AS s FROM {0}))
"""

ORACLE = f"""
WITH split AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM split),
bare AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name FROM ruled),
parts AS (
  SELECT *, CASE WHEN len(string_split(name, '.')) <= 2 OR regexp_matches(name, '^([0-9.]+|\\[.*\\])$') THEN name
    WHEN array_to_string(string_split(name, '.')[-2:], '.') IN {TWO_LABEL_SUFFIXES} THEN array_to_string(string_split(name, '.')[-3:], '.')
    ELSE array_to_string(string_split(name, '.')[-2:], '.') END AS domain
  FROM bare),
named AS (
  SELECT *, CASE WHEN contains(domain, '.') AND NOT regexp_matches(domain, '^([0-9.]+|\\[.*\\])$') THEN regexp_extract(domain, '(?s)^[^.]*\\.(.*)$', 1) ELSE domain END AS suffix FROM parts),
by_host AS (
  SELECT host, domain, suffix, count(*) AS n, sum(1 - quality) AS bad
  FROM named JOIN labels ON page_id = doc_id WHERE quality IN (0, 1) GROUP BY ALL),
by_domain AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM by_host GROUP BY ALL),
by_suffix AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM by_domain GROUP BY ALL),
host_weight AS ({_SQL_WEIGHT.format("by_host")}),
domain_weight AS ({_SQL_WEIGHT.format("by_domain")}),
suffix_weight AS ({_SQL_WEIGHT.format("by_suffix")}),
overall AS (SELECT coalesce(CAST(sum(bad) AS DOUBLE) / nullif(sum(n), 0), 0.0) AS p FROM by_suffix),
means AS (
  SELECT DISTINCT a.host, coalesce(h.n, 0) + hw.w + 1 AS size,
    (coalesce(h.bad, 0) + hw.w * ((coalesce(d.bad, 0) + dw.w * ((coalesce(s.bad, 0) + sw.w * overall.p) / (coalesce(s.n, 0) + sw.w))) / (coalesce(d.n, 0) + dw.w))) / (coalesce(h.n, 0) + hw.w) AS m
  FROM named a LEFT JOIN by_suffix s ON a.suffix = s.suffix LEFT JOIN by_domain d ON a.domain = d.domain LEFT JOIN by_host h ON a.host = h.host,
    host_weight hw, domain_weight dw, suffix_weight sw, overall)
SELECT page_id, named.host AS host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
    WHEN rule IS NOT NULL THEN 'allow'
    WHEN m - 1.645 * sqrt(m * (1 - m) / size) > 0.5 THEN 'block' ELSE 'allow' END AS verdict, round(m - 1.645 * sqrt(m * (1 - m) / size), 6) AS bad_bound
FROM named JOIN means ON named.host = means.host
"""
