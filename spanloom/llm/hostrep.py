"""URL filters with empirical-Bayes host reputation (operator 2), in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .common import stash

#: (verdict, host, path): the rules of the driver's contract.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: A host is blocked when the lower bound of its share of bad pages reaches this.
BLOCK_AT = 0.5
#: Standard deviations between the posterior mean and its lower bound (95 %, one-sided).
Z = 1.645
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: page_id, host, path, and the number in the path under which outcomes are labelled.
PARSED = f"""
SELECT page_id, host, path, try_cast(regexp_extract(path, '/([0-9]+)', 1) AS bigint) AS item FROM (
  SELECT page_id, host, regexp_extract(substr(rest, length(host) + 1), '^[^?#]*', 0) AS path FROM (
    SELECT page_id, rest, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host FROM (
      SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
      FROM {{pages}}) a) b) c
"""

#: A row for each host: its labelled pages n, and y of them bad.
HOSTS = """
SELECT host,
  CASE WHEN regexp_extract(host, '[^.]+[.][^.]+$', 0) = '' THEN host
    ELSE regexp_extract(host, '[^.]+[.][^.]+$', 0) END AS dom,
  regexp_extract(host, '[^.]*$', 0) AS suf, n, y
FROM (
  SELECT host, cast(count(bad) AS double) AS n, cast(coalesce(sum(bad), 0) AS double) AS y
  FROM {parsed} p LEFT JOIN (
    SELECT doc_id, CASE WHEN toxic = 1 OR quality = 0 THEN 1 WHEN toxic IS NULL AND quality IS NULL THEN NULL ELSE 0 END AS bad
    FROM {labels}) l ON p.item = l.doc_id
  GROUP BY host) h
"""


def _strength(children: str) -> str:
    """Prior strength k = 1/rho - 1 from the moments of a beta-binomial: children have n, y and their parent's mean m."""
    return f"""SELECT 1 / rho - 1 AS k FROM (
      SELECT least(greatest(coalesce(sum((y - n * m) * (y - n * m) - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0), 0.001), 0.999) AS rho
      FROM {children}) r"""


#: host, mean, bound: the posterior of each host.
POSTERIOR = f"""
WITH total AS (SELECT (coalesce(sum(y), 0) + 0.5) / (coalesce(sum(n), 0) + 1) AS mu FROM {{hosts}}),
suf0 AS (SELECT suf, sum(n) AS n, sum(y) AS y, (SELECT mu FROM total) AS m FROM {{hosts}} GROUP BY suf),
sufk AS ({_strength("suf0")}),
suf1 AS (SELECT suf, (y + (SELECT k FROM sufk) * m) / (n + (SELECT k FROM sufk)) AS mean FROM suf0),
dom0 AS (SELECT d.dom, d.n, d.y, s.mean AS m
  FROM (SELECT dom, suf, sum(n) AS n, sum(y) AS y FROM {{hosts}} GROUP BY dom, suf) d JOIN suf1 s ON d.suf = s.suf),
domk AS ({_strength("dom0")}),
dom1 AS (SELECT dom, (y + (SELECT k FROM domk) * m) / (n + (SELECT k FROM domk)) AS mean FROM dom0),
host0 AS (SELECT h.host, h.n, h.y, d.mean AS m FROM {{hosts}} h JOIN dom1 d ON h.dom = d.dom),
hostk AS ({_strength("host0")}),
host1 AS (SELECT host, y + (SELECT k FROM hostk) * m AS a, n - y + (SELECT k FROM hostk) * (1 - m) AS b FROM host0)
SELECT host, a / (a + b) AS mean,
  greatest(a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 0) AS bound
FROM host1
"""


def _ruled(rules, what: int) -> str:
    """A CASE over the rules, the longest first; what: 0 its verdict, 1 its text."""
    whens = []
    for verdict, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = f"(host = '{host}' OR host LIKE '%.{host}') AND substr(path, 1, {len(path)}) = '{path}'"
        whens.append(f"WHEN {fits} THEN '{(verdict, host + path)[what]}'")
    return f"CASE {' '.join(whens)} END" if whens else "CAST(NULL AS string)"


def verdict_sql(rules=RULES, block_at: float = BLOCK_AT) -> str:
    return f"""
SELECT page_id, p.host AS host, path, {_ruled(rules, 1).replace("host ", "p.host ")} AS rule,
  coalesce({_ruled(rules, 0).replace("host ", "p.host ")}, CASE WHEN bound >= {block_at} THEN 'block' ELSE 'allow' END) AS verdict,
  round(mean, 6) AS bad_rate, round(bound, 6) AS bad_rate_bound
FROM {{parsed}} p JOIN {{posterior}} q ON p.host = q.host
"""


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, block_at: float = BLOCK_AT) -> DataFrame:
    """A verdict for each row of ``pages`` (page_id, url), by rule or else by its host's posterior.

    ``labels`` (doc_id, quality, toxic) hold outcomes of the pages whose path has that number; toxic or of
    quality 0 is bad.  Each host's share of bad pages has a beta prior centred at its registered domain's mean,
    that at its suffix's, that at the overall mean; the strength of each prior comes from the spread between
    the units of its level (moments of a beta-binomial).  A host without outcomes gets its domain's mean.

    Everything is counts per host, combined before the shuffle.  Null urls and urls without ``://`` have empty
    host and path and share one posterior.  Labels that are null in both columns are no outcomes; repeated rows count each; empty tables give
    an empty result or priors alone.
    """
    spark = pages.sparkSession
    parsed = spark.sql(PARSED, pages=pages.select("page_id", "url"))
    hosts = stash(spark.sql(HOSTS, parsed=parsed, labels=labels.select("doc_id", "quality", "toxic")), "hosts")
    posterior = spark.sql(POSTERIOR, hosts=hosts)
    return spark.sql(verdict_sql(rules, block_at), parsed=parsed, posterior=posterior)


def oracle() -> str:
    """The same in one statement for DuckDB."""
    parsed = PARSED.format(pages="pages")
    hosts = HOSTS.format(parsed="parsed", labels="labels")
    posterior = POSTERIOR.format(hosts="hosts").strip().removeprefix("WITH ")
    ctes, last = posterior.rsplit("SELECT host, a / (a + b)", 1)
    final = verdict_sql().format(parsed="parsed", posterior="posterior")
    return f"WITH parsed AS ({parsed}), hosts AS ({hosts}), {ctes}, posterior AS (SELECT host, a / (a + b){last}) {final}"
