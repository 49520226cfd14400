"""Host-level quality rules.

Each document is measured, the failures of every rule are summed by host, each
host's failure rate is shrunk towards what hosts in general show, and the
host's verdict is joined back to its documents.

* Rules (per document): ``short`` - under ``min_words`` words; ``repeats`` - words
  in repeated 3-word windows exceed ``max_repeat_pct`` % of the words; ``symbols`` -
  symbols exceed ``max_symbol_pct`` % of the words; ``dup_lines`` - repeated lines
  exceed ``max_dup_line_pct`` % of the lines with a word. The first two are the base
  rules: they reject a document by themselves. All four count for the host.
* Prior: a Beta distribution fitted by the method of moments to the failure
  rates of all hosts, per rule. A host with f failures in n documents gets the
  rate (a + f) / (a + b + n). Where the rates of the hosts do not differ, or
  there is only one host, the prior is Beta(1, 1).
* Verdict, on the posterior Beta(a + f, b + n - f): a host whose shrunk rate of any rule
  exceeds ``max_host_rate`` is rejected with all its documents. A host is suspect for a rule
  when its shrunk rate exceeds the prior's mean by ``host_doubt`` posterior standard
  deviations (0.6745: three chances in four that the host is worse than hosts in general);
  its documents that fail this rule go, while those of other hosts stay. A document is kept if it passes
  the base rules, its host is not rejected, and it fails no rule that its host is suspect for.

The texts are measured once: the measures are staged with the columns that are kept, and host
sums and verdicts come from there. Very long texts are measured whole, in linear time.

Null or empty texts have no words and fail ``short``; documents with a null host
form a host of their own; repeated rows count as often as they occur; an empty
table gives an empty result. Columns of the input are passed through untouched
and may have any name: the results are in one struct column, ``quality``.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, prepare, stage, table, words

#: Characters counted by the symbol rule (fixed value).
SYMBOLS = "#*$%&|<>"

RULES = ("short", "repeats", "symbols", "dup_lines")

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The measures of one text, in the order of ``MEASURES``."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    found = words(text)
    n = len(found)
    chars = len(text) - sum(text.count(c) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    windows = list(zip(found, found[1:], found[2:]))
    repeats = 0
    if len(set(windows)) < len(windows):
        seen: set[tuple[bytes, bytes, bytes]] = set()
        twice = {w for w in windows if w in seen or seen.add(w)}
        end = 0  # first word that no repeated window has covered yet
        for i, w in enumerate(windows):
            if w in twice:
                repeats += i + 3 - max(i, end)
                end = i + 3
    return n, chars, symbols, len(lines), len(lines) - len(set(lines)), repeats


@F.arrow_udf(T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))
def _measures(text: pa.Array) -> pa.Array:
    rows = [measure(t) for t in text.to_pylist()]
    columns = list(zip(*rows)) or [()] * len(MEASURES)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], list(MEASURES))


def _failures(q, min_words, max_repeat_pct, max_symbol_pct, max_dup_line_pct):
    return {
        "short": q["n_words"] < min_words,
        "repeats": q["n_repeat_words"] * 100 > q["n_words"] * max_repeat_pct,
        "symbols": q["n_symbols"] * 100 > q["n_words"] * max_symbol_pct,
        "dup_lines": q["n_dup_lines"] * 100 > q["n_lines"] * max_dup_line_pct,
    }


def _host_key(host):
    """Never null, and a null host is none of the named ones."""
    return F.when(host.isNull(), F.lit("n")).otherwise(F.concat(F.lit("h"), host.cast("string")))


def host_rates(measured: DataFrame, failures: dict) -> DataFrame:
    """One row per host: ``host_key, n`` and the failures ``f_<rule>``."""
    return measured.groupBy("host_key").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c.cast("bigint")).alias(f"f_{r}") for r, c in failures.items()]
    )


def beta_prior(hosts: DataFrame) -> dict[str, tuple[float, float]]:
    """Beta(a, b) of each rule's failure rate over hosts, by the method of moments."""
    rate = {r: F.col(f"f_{r}") / F.col("n") for r in RULES}
    got = hosts.agg(
        *[F.avg(c).alias(f"m_{r}") for r, c in rate.items()], *[F.var_samp(c).alias(f"v_{r}") for r, c in rate.items()]
    ).first()
    prior = {}
    for r in RULES:
        m, v = got[f"m_{r}"], got[f"v_{r}"]
        strength = m * (1 - m) / v - 1 if m is not None and v else 0
        prior[r] = (m * strength, (1 - m) * strength) if strength > 0 and 0 < m < 1 else (1.0, 1.0)
    return prior


def quality_rules(
    docs: DataFrame,
    *,
    text: str = "text",
    host: str = "source",
    keep: list[str] | None = None,
    min_words: int = 50,
    max_repeat_pct: int = 50,
    max_symbol_pct: int = 10,
    max_dup_line_pct: int = 30,
    max_host_rate: float = 0.5,
    host_doubt: float = 0.6745,
) -> DataFrame:
    """The columns ``keep`` of ``docs`` (None: all) with a struct column ``quality``: the
    measures, ``base_failed``, ``host_rejected``, ``suspect_failed`` and ``kept``.

    The texts are measured in place and never shuffled for it: the host counts
    come from the staged measures, partial sums first, and the few columns of
    a host's verdict are joined back on the host (a hot host is split by the
    adaptive skew join, or the verdicts are broadcast when Spark has measured
    that they are small).
    """
    spark = docs.sparkSession
    prepare(spark)
    limits = (min_words, max_repeat_pct, max_symbol_pct, max_dup_line_pct)
    row = F.struct(*[docs[c] for c in (docs.columns if keep is None else keep)])
    measured = docs.select(row.alias("row"), _host_key(docs[host]).alias("host_key"), _measures(docs[text]).alias("q"))
    measured = stage(spark, measured, "quality-measures")
    failures = _failures(F.col("q"), *limits)
    hosts = stage(spark, host_rates(measured, failures), "quality-hosts")
    rejected, suspect = F.lit(False), {}
    for r, (a, b) in beta_prior(hosts).items():
        size = F.col("n") + (a + b)
        rate = (F.col(f"f_{r}") + a) / size
        rejected = rejected | (rate > max_host_rate)
        suspect[r] = rate - host_doubt * F.sqrt(rate * (1 - rate) / (size + 1)) > a / (a + b)
    verdicts = hosts.select("host_key", rejected.alias("host_rejected"), *[c.alias(f"suspect_{r}") for r, c in suspect.items()])

    joined = measured.join(verdicts, "host_key", "left")
    base = failures["short"] | failures["repeats"]
    doubted = F.lit(False)
    for r, fails in failures.items():
        doubted = doubted | (fails & F.col(f"suspect_{r}"))
    kept = ~base & ~F.col("host_rejected") & ~doubted
    quality = F.struct(F.col("q.*"), base.alias("base_failed"), F.col("host_rejected"), doubted.alias("suspect_failed"), kept.alias("kept"))
    return joined.select("row", quality.alias("quality")).select("row.*", F.col("quality").alias("quality"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality_rules(table(spark, sf_dir, "documents"), keep=["doc_id"])
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rejected", "suspect_failed", "kept")
    q = [F.col(f"quality.{c}").alias(c) for c in names]
    return got.select("doc_id", *q)


def kept_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = {c: f"c{i}" for i, c in reversed(list(enumerate(docs.columns)))}
    got = quality_rules(plain, text=at["text"], host=at["source"])
    return got.filter("quality.kept").drop("quality").toDF(*docs.columns)


#: The same rules in SQL, for DuckDB.
OP4_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), win AS (
  SELECT rid, i, ws[i] || chr(32) || ws[i + 1] || chr(32) || ws[i + 2] AS g
  FROM w, unnest(generate_series(1, len(ws) - 2)) AS t(i)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS k FROM win) WHERE k > 1
), covered AS (
  SELECT rid, count(DISTINCT i + o) AS n_repeat_words FROM twice, unnest([0, 1, 2]) AS t(o) GROUP BY rid
), m AS (
  SELECT w.rid, doc_id, source, len(ws) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN covered USING (rid)
), f AS (
  SELECT *, n_words < 50 AS short, 100 * n_repeat_words > 50 * n_words AS repeats,
         100 * n_symbols > 10 * n_words AS symbols, 100 * n_dup_lines > 30 * n_lines AS dups FROM m
), h AS (
  SELECT source, count(*) AS n, unnest([
           {'rule': 1, 'f': count_if(short)}, {'rule': 2, 'f': count_if(repeats)},
           {'rule': 3, 'f': count_if(symbols)}, {'rule': 4, 'f': count_if(dups)}], recursive := true)
  FROM f GROUP BY source
), p AS (
  SELECT rule, avg(f / n) AS m, var_samp(f / n) AS v FROM h GROUP BY rule
), s AS (
  SELECT rule, m, CASE WHEN v > 0 THEN m * (1 - m) / v - 1 ELSE 0 END AS k FROM p
), ab AS (
  SELECT rule, CASE WHEN k > 0 AND m > 0 AND m < 1 THEN m * k ELSE 1 END AS a,
         CASE WHEN k > 0 AND m > 0 AND m < 1 THEN (1 - m) * k ELSE 1 END AS b FROM s
), posterior AS (
  SELECT source, rule, n, a, b, (a + f) / (a + b + n) AS rate FROM h JOIN ab USING (rule)
), doubt AS (
  SELECT source, rule, rate > 0.5 AS rejected, rate - 0.6745 * sqrt(rate * (1 - rate) / (a + b + n + 1)) > a / (a + b) AS suspect FROM posterior
), verdict AS (
  SELECT source, bool_or(rejected) AS host_rejected, bool_or(rule = 1 AND suspect) AS s1, bool_or(rule = 2 AND suspect) AS s2,
         bool_or(rule = 3 AND suspect) AS s3, bool_or(rule = 4 AND suspect) AS s4 FROM doubt GROUP BY source
), judged AS (
  SELECT f.*, host_rejected, short OR repeats AS base_failed,
         (short AND s1) OR (repeats AND s2) OR (symbols AND s3) OR (dups AND s4) AS suspect_failed
  FROM f JOIN verdict ON f.source IS NOT DISTINCT FROM verdict.source
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       base_failed, host_rejected, suspect_failed, NOT base_failed AND NOT host_rejected AND NOT suspect_failed AS kept
FROM judged
"""
