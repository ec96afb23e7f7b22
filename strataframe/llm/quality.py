"""Host-level quality rules.

Each document is measured and tested by rules; the failures of each rule are added up by domain (the source of a
document), each domain's rate is shrunk by an empirical beta prior fitted over all domains, and a domain whose rate is
surely high is rejected as a whole when the verdicts are joined back. DataFrame functions only.

Text is measured inside its row with array functions: no word or line leaves its row, so very long documents and very
frequent words, lines or windows move nothing. The measures are written once to the shared folder, since the verdicts
need a pass before the result.

Defined results: a null or empty text has all measures 0 and fails for length; a null domain is a domain of its own;
repeated rows count each for itself; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mixing import WORD
from .store import written

MIN_WORDS = 50


def let(value: Column, use) -> Column:
    """``use(v)`` with ``value`` computed once in each row, even where lambdas refer to it many times."""
    return F.transform(F.array(value), use)[0]


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more. Windows are hashed; only rows where hashes repeat (found
    with a hash set) sort them with their places."""

    def window_hash(w, i):
        return F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))

    def covered(w):
        places = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(window_hash(w, i).alias("h"), i.alias("i"))))

        def same(s, x, k, step):
            return F.coalesce(F.get(s, k + step)["h"] == x["h"], F.lit(False))

        def of(s):
            hits = F.filter(s, lambda x, k: same(s, x, k, -1) | same(s, x, k, 1))
            return F.size(F.array_distinct(F.flatten(F.transform(hits, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        return let(places, of)

    def of_words(w):
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: window_hash(w, i))
        return F.when(F.size(w) < 4, F.lit(0)).when(F.size(F.array_distinct(hashes)) == F.size(w) - 2, F.lit(0)).otherwise(covered(w))

    return let(words, of_words)


def measures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), text.alias("text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))

    def dup_lines(lines):
        return F.size(lines) - F.size(F.array_distinct(lines))

    return base.select(
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), dup_lines).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
    )


#: Rules by name; true is a failure. Rates are in whole numbers, so both sides are exact.
RULES = {
    "short": lambda: F.col("n_words") < MIN_WORDS,
    "repeats": lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
    "symbols": lambda: 10 * F.col("n_symbols") > F.col("n_words"),
    "dup_lines": lambda: 10 * F.col("n_dup_lines") > F.col("n_words"),
    "word_length": lambda: (F.col("word_chars") > 12 * F.col("n_words")) | (F.col("word_chars") < 2 * F.col("n_words")),
}


def posterior_low(bad: Column, n: Column, mean: float, strength: float, z: float) -> Column:
    """Lower bound of a beta-binomial posterior rate."""
    rate = (bad + strength * mean) / (n + strength)
    return rate - z * F.sqrt(rate * (1 - rate) / (n + strength + 1))


def beta_prior(sums) -> tuple[float, float]:
    """Mean and strength of the beta prior by moments, from whole-number sums over groups: failures, trials, ordered
    pairs of failures and of trials in one group. Without spread the prior is as strong as it may be (1,000)."""
    bad, n, bad_pairs, pairs = (float(x or 0) for x in sums)
    mean = bad / n if n else 0.5
    second = bad_pairs / pairs if pairs else mean * mean
    spread = second - mean * mean
    return mean, min(1000.0, max(1.0, (mean - second) / spread)) if spread > 1e-12 else 1000.0


def host_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = 0.5, z: float = 2.0) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host, host_verdict.

    A host is rejected if for any rule the lower bound (``z`` deviations) of its shrunk failure rate exceeds ``max_rate``.
    """
    rows = written(measures(docs, id_col=id_col, text_col=text_col, host_col=host_col), "quality")
    counts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(rule()).alias(name) for name, rule in RULES.items()))
    counts = written(counts, "quality-hosts")
    n = F.col("n").cast("double")
    sums = counts.agg(F.sum(n).alias("n"), F.sum(n * (n - 1)).alias("pairs"), *(F.sum(F.col(k).cast("double") * p).alias(f"{k}{i}") for k in RULES for i, p in enumerate((F.lit(1.0), F.col(k) - 1)))).first()
    failed = F.lit(False)
    for k in RULES:
        mean, strength = beta_prior((sums[f"{k}0"], sums["n"], sums[f"{k}1"], sums["pairs"]))
        failed = failed | (posterior_low(F.col(k), F.col("n"), mean, strength, z) > max_rate)
    verdicts = counts.select(F.col("host").alias("of"), F.when(failed, "reject").otherwise("keep").alias("host_verdict"))
    joined = rows.join(verdicts, F.col("host").eqNullSafe(F.col("of")), "left")
    base_failed = RULES["short"]() | RULES["repeats"]()
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), (~base_failed & (F.col("host_verdict") == "keep")).alias("kept"), "host", "host_verdict")


_RULES_SQL = {"short": "n_words < 50", "repeats": "100 * n_repeat_words > 50 * n_words", "symbols": "10 * n_symbols > n_words", "dup_lines": "10 * n_dup_lines > n_words", "word_length": "word_chars > 12 * n_words OR word_chars < 2 * n_words"}


def _sql() -> str:
    prior, failed = [], []
    for k in RULES:
        prior.append(f"""SELECT '{k}' AS rule, sum({k}) / sum(n) AS mean, sum({k} * ({k} - 1.0)) / sum(n * (n - 1.0)) AS second FROM counts""")
        p = f"(SELECT mean FROM prior WHERE rule = '{k}')"
        s = f"(SELECT strength FROM prior WHERE rule = '{k}')"
        rate = f"(({k} + {s} * {p}) / (n + {s}))"
        failed.append(f"{rate} - 2.0 * sqrt({rate} * (1 - {rate}) / (n + {s} + 1)) > 0.5")
    return rf"""
WITH w AS (SELECT doc_id, source AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT *, row_number() OVER () AS rid FROM w),
pos AS (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM g WHERE len(words) >= 3),
win AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i], words[i + 1], words[i + 2]) AS c FROM pos),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM win WHERE c > 1) GROUP BY rid),
rows AS (SELECT doc_id, host, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
   CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
   CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
   CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM g LEFT JOIN rep USING (rid)),
counts AS (SELECT host, CAST(count(*) AS DOUBLE) AS n, {", ".join(f"CAST(count(*) FILTER (WHERE {v}) AS DOUBLE) AS {k}" for k, v in _RULES_SQL.items())} FROM rows GROUP BY host),
moments AS ({" UNION ALL ".join(prior)}),
prior AS (SELECT rule, mean, CASE WHEN second - mean * mean > 1e-12 THEN least(1000.0, greatest(1.0, (mean - second) / (second - mean * mean))) ELSE 1000.0 END AS strength FROM moments),
verdict AS (SELECT host, CASE WHEN {" OR ".join(failed)} THEN 'reject' ELSE 'keep' END AS host_verdict FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
   (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
   (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND host_verdict = 'keep') AS kept, rows.host AS host, host_verdict
FROM rows JOIN verdict ON rows.host IS NOT DISTINCT FROM verdict.host
"""


SQL = _sql()
