"""Host reputation by empirical Bayes: beta-binomial shrinkage from host to registered domain to suffix.

Outcomes are labels of pages (``quality`` 1 or 0; several labels of a page are several outcomes).  At each
level the strength of the prior comes from the spread of the groups' rates by the method of moments, held
between 1 and 1000.  A suffix shrinks to the rate of all, a domain to its suffix, a host to its domain.  A page is kept
if the posterior mean of its host less ``z`` standard deviations is at least ``least``.

The posterior bound is the normal one, mean less z deviations: for hosts with few outcomes it lies below the quantile of the beta
distribution, so such hosts are kept later, not sooner.  Everything is built-in aggregation on hosts, counted once; only single rows are broadcast.
Suffixes of two labels are those under ``second_level`` labels of countries, a parameter.

Defined results: a null or unreadable URL has the host '' (its pages form one group); null outcomes don't count; without outcomes the
rate is 0.5 everywhere and nothing is kept; an address of numbers, or in brackets, is its own domain; pages that repeat in full count once and are
each scored; texts, other columns and their names don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise

Z, LEAST = 1.2816, 0.6
_HOST = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/]*\]|[^/:?#]+)"
SECOND_LEVEL = ("co", "com", "org", "net", "ac", "gov", "edu")
_NUMBERS = r"^[0-9.]+$|^\["


def _domain(second_level: tuple[str, ...]) -> str:
    return rf"([^.]+\.)?((?:{'|'.join(second_level)})\.[a-z][a-z]|[^.]+)$"


def parts(url: Column, second_level: tuple[str, ...] = SECOND_LEVEL) -> tuple[Column, Column, Column]:
    """Host, registered domain and suffix."""
    own = _domain(second_level)
    host = F.coalesce(F.rtrim(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit(".")), F.lit(""))
    number = host.rlike(_NUMBERS)
    return (
        host,
        F.when(number, host).otherwise(F.regexp_extract(host, own, 0)),
        F.when(number, F.lit("")).otherwise(F.regexp_extract(host, own, 2)),
    )


def _strength(groups: DataFrame, n: str, s: str) -> DataFrame:
    """One row: strength of the prior from groups of n outcomes with s good ones."""
    g = groups.filter(F.col(n) > 0).agg(
        F.count("*").alias("k"), F.sum(n).cast("double").alias("N"), F.sum(s).cast("double").alias("S"),
        F.sum(F.col(n).cast("double") * F.col(n)).alias("N2"), F.sum(F.col(s).cast("double") * F.col(s) / F.col(n)).alias("Q"),
    )
    p = F.expr("S / N")
    within = p * (1 - p)
    between = (F.expr("Q - S * S / N") - (F.col("k") - 1) * within) / F.nullif(F.expr("N - N2 / N"), F.lit(0.0))
    raw = F.when(between > 0, within / between - 1).otherwise(F.lit(1000.0))
    return g.select(F.coalesce(F.greatest(F.lit(1.0), F.least(F.lit(1000.0), raw)), F.lit(1000.0)).alias("m"))


def scored(pages: DataFrame, labels: DataFrame, z: float = Z, least: float = LEAST, second_level: tuple[str, ...] = SECOND_LEVEL) -> DataFrame:
    """One row per page: ``page_id``, ``host``, ``domain``, ``suffix``, ``n_labelled`` and ``posterior_mean`` of the
    host, ``lower_bound`` and ``keep``."""
    host, _, _ = parts(F.col("url"))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"))
    outcome = labels.select(F.col("doc_id").cast("long").alias("page_id"), F.col("quality").cast("int").alias("y")).dropna()
    outcome = outcome.groupBy("page_id").agg(F.count("*").alias("n"), F.sum((F.col("y") > 0).cast("long")).alias("s"))
    hosts = own.distinct().join(outcome, "page_id", "left").groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("s"), F.lit(0)).alias("s"))
    _, domain, suffix = parts(F.concat(F.lit("x://"), F.col("host")), second_level)
    hosts = hosts.select("host", F.when(F.col("host") == "", "").otherwise(domain).alias("domain"), F.when(F.col("host") == "", "").otherwise(suffix).alias("suffix"), "n", "s")
    hosts = materialise(hosts, "hosts")  # read by every level
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("s").alias("ds"))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("ds").alias("ss"))
    total = suffixes.agg((F.sum("ss") / F.nullif(F.sum("sn").cast("double"), F.lit(0.0))).alias("rate"), F.sum("sn").alias("all"))
    scale = total.select(F.coalesce("rate", F.lit(0.5)).alias("rate"), F.coalesce("all", F.lit(0)).alias("all"))
    for level, (groups, n, s) in {"ms": (suffixes, "sn", "ss"), "md": (domains, "dn", "ds"), "mh": (hosts, "n", "s")}.items():
        scale = scale.crossJoin(_strength(groups, n, s).withColumnRenamed("m", level))
    one = F.broadcast(scale)
    shrunk = suffixes.crossJoin(one).select("suffix", F.expr("(ss + ms * rate) / (sn + ms)").alias("mean_s"), "md", "mh", "all")
    shrunk = domains.join(shrunk, "suffix").select("domain", "suffix", F.expr("(ds + md * mean_s) / (dn + md)").alias("mean_d"), "mh", "all")
    post = hosts.join(shrunk, ["domain", "suffix"]).select("*", F.expr("s + mh * mean_d").alias("a"), F.expr("n - s + mh * (1 - mean_d)").alias("b"))
    post = post.select("host", "domain", "suffix", "n", "all", F.expr("a / (a + b)").alias("mean"), F.expr("a * b / ((a + b) * (a + b) * (a + b + 1))").alias("var"))
    low = F.col("mean") - F.lit(z) * F.sqrt("var")
    post = post.select("host", "domain", "suffix", F.col("n").alias("n_labelled"), F.round("mean", 6).alias("posterior_mean"), F.round(low, 6).alias("lower_bound"), ((low >= least) & (F.col("all") > 0)).alias("keep"))
    return own.join(post, "host").select("page_id", "host", "domain", "suffix", "n_labelled", "posterior_mean", "lower_bound", "keep")


def keep_reputable(pages: DataFrame, labels: DataFrame, z: float = Z, least: float = LEAST, second_level: tuple[str, ...] = SECOND_LEVEL) -> DataFrame:
    """The rows of ``pages`` whose host's bound is high enough, all columns kept; rows that repeat stay or go together."""
    (h,) = fresh(pages, "kept_host")
    good = scored(pages, labels, z, least, second_level).filter("keep").select(F.col("host").alias(h)).distinct()
    return pages.join(good, parts(F.col("url"))[0] == F.col(h), "left_semi")


def _sql(z: float, least: float) -> str:
    def strength(groups: str, n: str, s: str) -> str:
        return f"""(SELECT coalesce(greatest(1.0, least(1000.0, CASE WHEN bt > 0 THEN w / bt - 1 ELSE 1000.0 END)), 1000.0) FROM (
            SELECT w, (q - ss * ss / nn - (k - 1) * w) / nullif(nn - n2 / nn, 0.0) AS bt FROM (
            SELECT *, (ss / nn) * (1 - ss / nn) AS w FROM (
            SELECT count(*) AS k, sum({n})::DOUBLE AS nn, sum({s})::DOUBLE AS ss, sum({n}::DOUBLE * {n}) AS n2, sum({s}::DOUBLE * {s} / {n}) AS q FROM {groups} WHERE {n} > 0))))"""

    return f"""
WITH own AS (SELECT page_id, coalesce(rtrim(lower(regexp_extract(url, '{_HOST}', 1)), '.'), '') AS host FROM pages),
outcome AS (SELECT doc_id AS page_id, count(*) AS n, sum(CASE WHEN quality > 0 THEN 1 ELSE 0 END) AS s FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1),
h0 AS (SELECT host, coalesce(sum(n), 0) AS n, coalesce(sum(s), 0) AS s FROM (SELECT DISTINCT * FROM own) LEFT JOIN outcome USING (page_id) GROUP BY 1),
hosts AS (SELECT host, CASE WHEN regexp_matches(host, '{_NUMBERS}') THEN host ELSE regexp_extract(host, '{_domain(SECOND_LEVEL)}', 0) END AS domain,
          CASE WHEN regexp_matches(host, '{_NUMBERS}') THEN '' ELSE regexp_extract(host, '{_domain(SECOND_LEVEL)}', 2) END AS suffix, n, s FROM h0),
domains AS (SELECT domain, suffix, sum(n) AS dn, sum(s) AS ds FROM hosts GROUP BY 1, 2),
suffixes AS (SELECT suffix, sum(dn) AS sn, sum(ds) AS ss FROM domains GROUP BY 1),
scale AS (SELECT (SELECT coalesce(sum(ss)::DOUBLE / nullif(sum(sn)::DOUBLE, 0), 0.5) FROM suffixes) AS rate, (SELECT coalesce(sum(sn), 0) FROM suffixes) AS n_all,
          {strength("suffixes", "sn", "ss")} AS ms, {strength("domains", "dn", "ds")} AS md, {strength("hosts", "n", "s")} AS mh),
s1 AS (SELECT suffix, (ss + ms * rate) / (sn + ms) AS mean_s FROM suffixes, scale),
d1 AS (SELECT domain, suffix, (ds + md * mean_s) / (dn + md) AS mean_d FROM domains JOIN s1 USING (suffix), scale),
p1 AS (SELECT host, domain, suffix, n, n_all, s + mh * mean_d AS a, n - s + mh * (1 - mean_d) AS b FROM hosts JOIN d1 USING (domain, suffix), scale),
p2 AS (SELECT host, domain, suffix, n, n_all, a / (a + b) AS mean, a / (a + b) - {z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS low FROM p1)
SELECT page_id, host, domain, suffix, n::BIGINT AS n_labelled, round(mean, 6) AS posterior_mean, round(low, 6) AS lower_bound, low >= {least} AND n_all > 0 AS keep
FROM own JOIN p2 USING (host)"""


ORACLE = _sql(Z, LEAST)
