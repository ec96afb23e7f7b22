"""URL filtering by empirical-Bayes host reputation.

Labelled page outcomes are counted by host; beta-binomial priors, fitted by moments on each level, shrink them from the
suffix to the registered domain to the host, and a host is blocked where the lower posterior bound of its bad rate exceeds
a threshold. Fixed rules (host and path prefix) come before reputation. DataFrame functions only.

Counting is by partial aggregation, so a host with a third of all pages costs its map tasks a row each; the reputation
table has a row a host and joins back by key (adaptive execution splits a skewed host there).

Defined results: a null url or one without ``://`` has empty host and path and is judged as the empty host; a page with
several labels is bad if any is; a label that is null on both counts is no outcome; repeated rows count each for itself;
user parts and ports belong to the host but not to its domain; an address is a domain of its own; without labels the prior
is one half and nothing is blocked; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import beta_prior
from .store import written

RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))

#: Fixed: public suffixes of two labels under which names are registered; all others have one label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "com.br", "com.cn", "co.in", "co.za", "com.mx")


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    tail = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(tail, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(tail, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(rest, host).otherwise(""), F.when(rest, path).otherwise("")


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: len(r[1])):  # the last that fits is the longest
        name, _, start = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + start))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


#: An address has no registered domain: it is one of its own, and all addresses share a suffix.
ADDRESS, ADDRESSES = r"^[0-9]+(\.[0-9]+){3}$|^\[", "[]"


def name_of(host: Column) -> Column:
    """The host without user part, port and dots at its end."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"\.*(:[0-9]*)?$", "")


def suffix_of(host: Column) -> Column:
    """Of a ``name_of`` a host."""
    two = F.substring_index(host, ".", -2)
    return F.when(host.rlike(ADDRESS), ADDRESSES).when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """Of a ``name_of`` a host."""
    return F.when(host.rlike(ADDRESS), host).when(F.substring_index(host, ".", -2).isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def _prior(level: DataFrame) -> tuple[float, float]:
    n, bad = F.col("n").cast("double"), F.col("bad").cast("double")
    return beta_prior(level.agg(F.sum(bad), F.sum(n), F.sum(bad * (bad - 1)), F.sum(n * (n - 1))).first())


def reputation(outcomes: DataFrame) -> DataFrame:
    """From (host, n, bad), a row a host, the posterior (host, rate, strength, n_labels) of each."""
    name = name_of(F.col("host"))
    hosts = outcomes.select("host", domain_of(name).alias("domain"), suffix_of(name).alias("suffix"), "n", "bad")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    (mean, ks), (_, kd), (_, kh) = _prior(suffixes), _prior(domains), _prior(hosts)
    s = suffixes.select("suffix", ((F.col("bad") + ks * mean) / (F.col("n") + ks)).alias("suffix_rate"))
    d = domains.join(s, "suffix").select("domain", ((F.col("bad") + kd * F.col("suffix_rate")) / (F.col("n") + kd)).alias("domain_rate"))
    return hosts.join(d, "domain").select("host", ((F.col("bad") + kh * F.col("domain_rate")) / (F.col("n") + kh)).alias("rate"), (F.col("n") + kh).alias("strength"), F.col("n").alias("n_labels"))


def judge(pages: DataFrame, labels: DataFrame, *, rules=RULES, z: float = 1.645, max_rate: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_rate, n_labels.

    ``labels`` (doc_id, quality, toxic) are outcomes of the pages of the same number: bad if of quality 0 or toxic.
    """
    host, path = host_path(F.col("url"))
    rows = written(pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path")), "urls")
    bad = (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("int")
    outcome = labels.filter(F.col("quality").isNotNull() | F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("labelled")).agg(F.max(bad).alias("outcome"))
    judged = rows.join(outcome, F.col("page_id") == F.col("labelled"), "left")
    hosts = written(judged.groupBy("host").agg(F.count("outcome").alias("n"), F.coalesce(F.sum("outcome"), F.lit(0)).alias("bad")), "url-hosts")
    known = reputation(hosts).withColumnRenamed("host", "of")
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    low = F.col("rate") - z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("strength") + 1))
    return rows.join(known, F.col("host") == F.col("of"), "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(low > max_rate, "block").otherwise("allow")).alias("verdict"), F.round("rate", 6).alias("bad_rate"), F.col("n_labels").cast("long").alias("n_labels")
    )


def _sql() -> str:
    two = ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES)
    last = lambda k: f"array_to_string(list_reverse(list_reverse(string_split(name, '.'))[1:{k}]), '.')"
    cases, verdicts = [], []
    for action, text in sorted(RULES, key=lambda r: -len(r[1])):
        name, _, start = text.partition("/")
        fits = f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{start}')"
        cases.append(f"WHEN {fits} THEN '{text}'")
        verdicts.append(f"WHEN {fits} THEN '{action}'")
    prior = lambda t: f"SELECT coalesce(sum(bad) / sum(n), 0.5) AS mean, sum(bad * (bad - 1)) / nullif(sum(n * (n - 1)), 0) AS second FROM {t}"
    strength = "CASE WHEN coalesce(second, mean * mean) - mean * mean > 1e-12 THEN least(1000.0, greatest(1.0, (mean - second) / (second - mean * mean))) ELSE 1000.0 END"
    return rf"""
WITH u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) END AS tail FROM pages),
h AS (SELECT page_id, tail, CASE WHEN tail IS NULL THEN '' ELSE regexp_extract(tail, '^[^/?#]*') END AS raw FROM u),
rows AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
   CASE WHEN tail IS NULL THEN '' ELSE regexp_extract(substr(tail, length(raw) + 1), '^[^?#]*') END AS path FROM h),
o AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS outcome FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
hc AS (SELECT host, CAST(count(outcome) AS DOUBLE) AS n, CAST(coalesce(sum(outcome), 0) AS DOUBLE) AS bad FROM rows LEFT JOIN o ON page_id = doc_id GROUP BY host),
hn AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), '\.*(:[0-9]*)?$', '') AS name FROM hc), ha AS (SELECT *, regexp_matches(name, '{ADDRESS}') AS address FROM hn),
hosts AS (SELECT *, CASE WHEN address THEN name WHEN {last(2)} IN ({two}) THEN {last(3)} ELSE {last(2)} END AS domain, CASE WHEN address THEN '{ADDRESSES}' WHEN {last(2)} IN ({two}) THEN {last(2)} ELSE {last(1)} END AS suffix FROM ha),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix),
ps AS (SELECT mean, {strength} AS k FROM ({prior("suffixes")})), pd AS (SELECT {strength} AS k FROM ({prior("domains")})), ph AS (SELECT {strength} AS k FROM ({prior("hosts")})),
s AS (SELECT suffix, (bad + k * mean) / (n + k) AS suffix_rate FROM suffixes, ps),
d AS (SELECT domain, (bad + k * suffix_rate) / (n + k) AS domain_rate FROM domains JOIN s USING (suffix), pd),
rep AS (SELECT host, n, (bad + k * domain_rate) / (n + k) AS rate, n + k AS strength FROM hosts JOIN d USING (domain), ph)
SELECT page_id, rows.host AS host, path, CASE {" ".join(cases)} END AS rule,
  CASE {" ".join(verdicts)} WHEN rate - 1.645 * sqrt(rate * (1 - rate) / (strength + 1)) > 0.5 THEN 'block' ELSE 'allow' END AS verdict,
  round(rate, 6) AS bad_rate, CAST(n AS BIGINT) AS n_labels
FROM (SELECT page_id, host, path FROM rows) rows JOIN (SELECT host AS rh, n, rate, strength FROM rep) ON rows.host = rh
"""


SQL = _sql()
