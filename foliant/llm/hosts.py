"""URL filters by empirical-Bayes host reputation, in DataFrame and SQL functions only.

Labelled page outcomes (good or bad) are counted by host, registered domain and suffix. Each level
is a beta-binomial: a suffix is shrunk towards the rate of all labelled pages, a domain towards its
suffix, a host towards its domain, in each case without its own pages, which would count twice. The
strength of a prior is fitted by moments over the groups of
the level, and bounded, so that what is known of a host can outweigh its prior. A page is blocked
if the lower bound of its host's posterior rate of bad pages is above WORSE times the rate of all
labelled pages; hand-written rules come first, the longest that fits.

Cases: a null url or one without ``://`` has an empty host and path, and is judged like any host
without labels. A host without labelled pages has the prior alone: its domain's rate, else the
suffix's, else the overall one, with the spread of STRONGEST pages. Without bad outcomes every page
is allowed, and a bound equal to the threshold allows. Of rules that fit, equal lengths go by code point. A suffix is the last label of a
host (the last two for listed second-level suffixes), the registered domain one label more.
Labels of pages that don't exist count for nothing; a page labelled twice counts twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, written

#: Fixed rules of the contract: host and path prefix, and what they decide.
RULES = (
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
)
#: Suffixes of two labels.
SECOND_LEVEL = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz")
#: Normal quantile of the posterior's lower bound (84 % lie above it), and how many times the overall
#: rate of bad pages it may reach.
QUANTILE, WORSE = 1.0, 0.9
#: Labelled pages that a prior is worth, at least and at most.
WEAKEST, STRONGEST = 1.0, 10.0
DEFAULT_RATE = 0.1


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without it."""
    rest = F.substring_index(url, "://", 1)
    after = F.substring(url, F.length(rest) + 4, F.length(url))
    return F.when(F.contains(url, F.lit("://")), ascii_lower(F.regexp_extract(after, r"^([^/?#]*)", 1))).otherwise("")


def path(url: Column) -> Column:
    """From the end of the host up to ``? #`` or the end; empty without ``://``."""
    rest = F.substring_index(url, "://", 1)
    after = F.substring(url, F.length(rest) + 4, F.length(url))
    return F.when(F.contains(url, F.lit("://")), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def suffix(name: Column) -> Column:
    two = F.substring_index(name, ".", -2)
    return F.when(two.isin(*SECOND_LEVEL), two).otherwise(F.substring_index(name, ".", -1))


def domain(name: Column) -> Column:
    two = F.substring_index(name, ".", -2)
    return F.when(two.isin(*SECOND_LEVEL), F.substring_index(name, ".", -3)).otherwise(two)


def rule(name: Column, where: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    fits = None
    for text, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        at, slash, below = text.partition("/")
        here = ((name == at) | name.endswith("." + at)) & where.startswith(slash + below)
        found = F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))
        fits = F.when(here, found) if fits is None else fits.when(here, found)
    return fits


def _shrunk(level: DataFrame, key: str, parent: Column) -> DataFrame:
    """Posterior (a, b, rate, spread) of each group: prior mean parent, strength by moments over the level.

    With binomial noise taken off, the groups' squared distance from their priors estimates
    m (1 - m) / (strength + 1).
    """
    rated = level.withColumn("prior", parent)
    noise = F.col("prior") * (1 - F.col("prior"))
    apart = F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("prior"), 2)
    fit = rated.where("n > 1").agg(F.sum(F.col("n") * noise).alias("top"), F.sum(apart - noise).alias("extra"), F.sum((F.col("n") - 1) * noise).alias("scale"))
    # extra / scale is 1 / (strength + 1); without extra spread the prior is as strong as allowed.
    share = F.col("extra") / F.col("scale")
    strength = F.least(F.lit(STRONGEST), F.greatest(F.lit(WEAKEST), F.when(share > 0, 1 / share - 1).otherwise(F.lit(STRONGEST))))
    fitted = fit.select(F.coalesce(strength, F.lit(STRONGEST)).alias("strength"))
    a, b = F.col("bad") + F.col("strength") * F.col("prior"), F.col("n") - F.col("bad") + F.col("strength") * (1 - F.col("prior"))
    mean = a / (a + b)
    deviation = F.sqrt(mean * (1 - mean) / (a + b + 1))
    return rated.join(F.broadcast(fitted)).select(key, a.alias("a"), b.alias("b"), mean.alias("rate"), deviation.alias("spread"))  # one row


def _others(level: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """The level with the rate above: of each group's parent without the group's own pages."""
    a, b = F.col("a") - F.col("bad"), F.col("b") - (F.col("n") - F.col("bad"))
    return level.join(parents.select(key, "a", "b"), key).withColumn("above", a / (a + b)).drop("a", "b")


def reputation(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Posterior rate of bad pages by host: host, rate, spread, and the overall rate.

    pages: page_id, url; outcomes: page_id, bad (0 or 1). One row for each host of pages.
    """
    named = pages.select("page_id", host(F.col("url")).alias("host"))
    labelled = named.join(outcomes, "page_id").groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    labelled = written(labelled.withColumns({"domain": domain(F.col("host")), "suffix": suffix(F.col("host"))}), "labelled")
    overall = labelled.agg(F.coalesce((F.sum("bad") + 1) / (F.sum("n") + 2), F.lit(DEFAULT_RATE)).alias("overall"))

    def level(key: str) -> DataFrame:
        return labelled.groupBy(key).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))

    by_suffix = _shrunk(level("suffix").join(F.broadcast(overall)), "suffix", F.col("overall"))
    up = _others(level("domain").withColumn("suffix", suffix(F.col("domain"))), by_suffix, "suffix")
    by_domain = _shrunk(up, "domain", F.col("above"))
    by_host = _shrunk(_others(labelled.select("host", "domain", "n", "bad"), by_domain, "domain"), "host", F.col("above"))
    hosts = named.select("host").distinct().withColumns({"domain": domain(F.col("host")), "suffix": suffix(F.col("host"))})
    for key, table in (("host", by_host), ("domain", by_domain), ("suffix", by_suffix)):
        hosts = hosts.join(table.select(key, F.struct("rate", "spread").alias(f"by_{key}")), key, "left")
    rate = F.coalesce("by_host.rate", "by_domain.rate", "by_suffix.rate", "overall")
    hosts = hosts.join(F.broadcast(overall)).withColumn("rate", rate)
    prior = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (STRONGEST + 1))
    return hosts.select("host", "rate", F.coalesce("by_host.spread", prior).alias("spread"), "overall")


def judge(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, bound: every page's verdict.

    bound is the posterior's lower bound, to nine digits. Host rows are joined by host; a host
    with very many pages is split by the engine's skew handling, as its side of the join is one row.
    """
    named = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    bound = F.round(F.col("rate") - QUANTILE * F.col("spread"), 9)
    limit = F.round(WORSE * F.col("overall"), 9)
    judged = named.join(reputation(pages, outcomes).select("host", bound.alias("bound"), limit.alias("limit")), "host", "left").withColumn("fits", rule(F.col("host"), F.col("path")))
    verdict = F.coalesce("fits.verdict", F.when(F.col("bound") > F.col("limit"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("fits.rule").alias("rule"), verdict.alias("verdict"), "bound")


def _level_sql(source: str, key: str, parent: str) -> str:
    return f"""
  SELECT {key}, a, b, a / (a + b) AS rate, sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) AS spread FROM (
    SELECT {key}, bad + strength * prior AS a, n - bad + strength * (1 - prior) AS b
    FROM (SELECT *, {parent} AS prior FROM ({source})), (
      SELECT coalesce(least({STRONGEST}::DOUBLE, greatest({WEAKEST}::DOUBLE, CASE WHEN extra / scale > 0 THEN 1 / (extra / scale) - 1 ELSE {STRONGEST}::DOUBLE END)), {STRONGEST}::DOUBLE) AS strength
      FROM (SELECT sum(n * pow(bad::DOUBLE / n - prior, 2) - prior * (1 - prior)) AS extra, sum((n - 1) * prior * (1 - prior)) AS scale
            FROM (SELECT *, {parent} AS prior FROM ({source})) WHERE n > 1)))"""


_TWO = "array_to_string(list_slice(string_split(host, '.'), -2, -1), '.')"
_LISTED = ", ".join(f"'{s}'" for s in SECOND_LEVEL)


def oracle() -> str:
    """The same in DuckDB over the pages and labels views; page outcomes as :func:`outcomes` has them."""
    when = " ".join(
        f"WHEN (host = '{at}' OR ends_with(host, '.{at}')) AND starts_with(path, '/{below}') THEN '{text}'"
        for text, at, below in sorted(((t, *t.split("/", 1)) for t, _ in RULES), key=lambda r: (-len(r[0]), r[0]))
    )
    decided = " ".join(f"WHEN rule = '{t}' THEN '{v}'" for t, v in RULES)
    after = "CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END"
    split = f"""CASE WHEN {_TWO} IN ({_LISTED}) THEN {_TWO} ELSE string_split(host, '.')[-1] END AS suffix,
      CASE WHEN {_TWO} IN ({_LISTED}) THEN array_to_string(list_slice(string_split(host, '.'), -3, -1), '.') ELSE {_TWO} END AS domain"""
    return f"""
WITH named AS (
  SELECT page_id, translate(coalesce(regexp_extract({after}, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract({after}, '^[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
labelled AS (
  SELECT *, {split} FROM (
    SELECT host, count(*) AS n, sum(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad
    FROM named JOIN labels ON doc_id = page_id GROUP BY host)),
overall AS (SELECT coalesce((sum(bad) + 1)::DOUBLE / (sum(n) + 2), {DEFAULT_RATE}) AS overall FROM labelled),
by_suffix AS ({_level_sql("SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(overall) AS overall FROM labelled, overall GROUP BY suffix", "suffix", "overall")}),
by_domain AS ({_level_sql("SELECT d.*, (s.a - d.bad) / (s.a - d.bad + s.b - (d.n - d.bad)) AS above FROM (SELECT domain, any_value(suffix) AS suffix, sum(n) AS n, sum(bad) AS bad FROM labelled GROUP BY domain) d JOIN by_suffix s USING (suffix)", "domain", "above")}),
by_host AS ({_level_sql("SELECT l.*, (d.a - l.bad) / (d.a - l.bad + d.b - (l.n - l.bad)) AS above FROM labelled l JOIN by_domain d USING (domain)", "host", "above")}),
hosts AS (
  SELECT h.host, overall, coalesce(a.rate, b.rate, c.rate, overall) AS rate,
         coalesce(a.spread, sqrt(coalesce(b.rate, c.rate, overall) * (1 - coalesce(b.rate, c.rate, overall)) / {STRONGEST + 1}::DOUBLE)) AS spread
  FROM (SELECT host, {split} FROM (SELECT DISTINCT host FROM named)) h
  LEFT JOIN by_host a ON h.host = a.host LEFT JOIN by_domain b ON h.domain = b.domain LEFT JOIN by_suffix c ON h.suffix = c.suffix, overall),
fitted AS (
  SELECT page_id, host, path, CASE {when} END AS rule, round(rate - {QUANTILE}::DOUBLE * spread, 9) AS bound, round({WORSE}::DOUBLE * overall, 9) AS most FROM named JOIN hosts USING (host))
SELECT page_id, host, path, rule, CASE {decided} WHEN bound > most THEN 'block' ELSE 'allow' END AS verdict, bound FROM fitted
"""
