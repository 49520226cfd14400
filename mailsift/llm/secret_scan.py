"""Secret scans: three patterns and a battery of randomness tests, in DataFrame functions only.

* Base patterns, leftmost and without overlap: ``assign`` (a password-like name, ``:`` or
  ``=``, a value of 12 characters), ``access`` (access key ids of 18 characters) and
  ``hex`` (16 lower-case hexadecimal digits). Shorter matches use up their text but do
  not count. Their spans always stay.
* Candidates of the battery: runs of 16 or more letters, digits, ``+ / _ -`` with up to two
  ``=`` behind. The smallest usual alphabet that holds all characters of a run is taken
  as its encoding (decimal, hexadecimal, base 32, one-case letters, one-case letters and
  digits, base 62, base 64).
* Battery, for a run of n symbols from an alphabet of k: chi-squared uniformity of the
  symbols (normalised by its exact multinomial mean and variance), Wald-Wolfowitz
  runs of the symbols in the upper and the lower half of the alphabet, and serial
  correlation of neighbouring symbols. Of random text all three are about standard
  normal: a run whose squares add up to more than ``battery_limit`` (chi-squared with 3 degrees
  of freedom) is not random.
* False discoveries: long words are the text that a battery is fooled by, the shorter the
  easier. So the null hypothesis is ordinary writing: letters as they are
  distributed in all candidate runs of letters alone, put into the run's alphabet. From that distribution
  follow mean and variance of the chi-squared statistic at every length; the p-value of
  a run is the chance that writing of its length looks as even. A run that failed the
  battery has p-value 1. Benjamini-Hochberg at ``fdr`` is applied within every class of
  encoding and length (half powers of two), on p-values rounded up to tenths of a power of
  ten, so that only a histogram is ranked. Letters alone in a short run can
  never be told from a word this way and are not reported; long ones are.
* Runs that lie inside a base span add nothing; the others that are discovered are spans
  of kind ``random``.

Null and empty texts have no spans, and their digest is that of the empty text. Positions
are code points. Very long texts and texts of many matches are scanned whole: matches become
narrow rows, whose positions are running sums, so the work is linear. Repeated rows are
answered each, a null id stays null. Equal starts are ordered by kind. An empty table gives an
empty result. Other columns are never looked at, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import prepare, stage, table

#: The base patterns (fixed values): kind, pattern, group that is measured, least characters. The last
#: two are ``AKIA[A-Z0-9]+`` and ``[0-9a-f]+`` with their least length inside: a match that is too short
#: runs to the end of its characters, where no longer one can begin. A short value of the first may hold
#: the name of a longer one, which it uses up, so its length is looked at afterwards.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)

#: Candidates of the battery, and their kind.
RANDOM, RANDOM_KIND = r"[A-Za-z0-9+/_-]{16,}={0,2}", "random"

KINDS = [k for k, *_ in BASE] + [RANDOM_KIND]

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Encodings, smallest alphabet first: the pattern of a whole run, and its symbols in order.
ENCODINGS = (
    ("dec", "[0-9]+", _DIGITS),
    ("hex", "[0-9a-f]+", _DIGITS + "abcdef"),
    ("HEX", "[0-9A-F]+", _DIGITS + "ABCDEF"),
    ("a26", "[a-z]+", _LOWER),
    ("A26", "[A-Z]+", _UPPER),
    ("b32", "[A-Z2-7]+", _UPPER + "234567"),
    ("a36", "[0-9a-z]+", _DIGITS + _LOWER),
    ("A36", "[0-9A-Z]+", _DIGITS + _UPPER),
    ("b62", "[0-9A-Za-z]+", _DIGITS + _UPPER + _LOWER),
    ("b64", "[0-9A-Za-z+/]+", _UPPER + _LOWER + _DIGITS + "+/"),
    ("u64", "[0-9A-Za-z_-]+", _UPPER + _LOWER + _DIGITS + "-_"),
    ("all", "[0-9A-Za-z+/_-]+", _UPPER + _LOWER + _DIGITS + "+/-_"),
)

#: Tenths of a power of ten that the histogram of p-values tells apart; smaller ones share the last.
BINS = 300


#: Runs that are plainly words: their letters say how writing looks.
WORDS = "^[A-Za-z/_-]+$"


def _matches(kind: str, pattern: str, group: int, least: int) -> Column:
    """From the matches of a kind (column ``kind``), in order: characters between the end of the match before
    and this one, own characters, and whether the measured group is long enough. Splitting at a pattern
    and extracting it see the same matches; texts without one are not read again."""
    whole, text = F.col(kind), F.col("text")
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    inner = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    # one gap more than matches: the rest of the text
    sized = F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), whole.alias("run"), inner.alias("inner"))
    run = (lambda m: m["run"]) if kind == RANDOM_KIND else (lambda m: F.lit(None).cast("string"))
    found = F.transform(sized, lambda m: F.struct(
        m["gap"].alias("gap"), F.length(m["run"]).alias("size"), (F.length(m["inner"]) >= least).alias("counts"), run(m).alias("run")))
    none = F.array().cast("array<struct<gap:int,size:int,counts:boolean,run:string>>")
    return F.when(F.size(whole) > 0, found).otherwise(none).alias(kind)


def _letter_counts(runs: Column) -> Column:
    """How often each letter, of either case, occurs in runs that are words."""
    text = F.lower(F.array_join(F.filter(runs, lambda r: r.rlike(WORDS)), ""))
    return F.array(*[F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in _LOWER])


def _writing(counts: list[int]) -> dict[str, tuple[float, float]]:
    """For each encoding the sums of the squares and cubes of the symbol shares that writing has
    in it: letters keep their distribution; smaller alphabets than letters are filled by place."""
    total = sum(counts)
    share = [c / total for c in counts] if total else [1 / len(counts)] * len(counts)
    out = {}
    for name, _, symbols in ENCODINGS:
        k = len(symbols)
        folded = [sum(share[i] for i in range(j, len(share), k)) for j in range(min(k, len(share)))]
        out[name] = sum(q * q for q in folded), sum(q**3 for q in folded)
    return out


def _sum(items: Column, value) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, x: acc + value(x))


def _of_encoding(values: dict[str, object]) -> Column:
    out = None
    for name, v in values.items():
        hit = F.col("encoding") == name
        out = F.when(hit, F.lit(v)) if out is None else out.when(hit, F.lit(v))
    return out


def _tail(z: Column) -> Column:
    """Chance of a standard normal above ``z`` (for ``z`` below 0: 1/2 at least), within 1 %."""
    x = F.greatest(z, F.lit(1e-6)) / math.sqrt(2)
    return (1 - F.exp(-1.98 * x)) * F.exp(-x * x) / (2 * 1.135 * math.sqrt(math.pi) * x)


def battery(runs: DataFrame, writing: dict[str, tuple[float, float]], *, battery_limit: float = 11.34) -> DataFrame:
    """``runs`` (a column ``run``) with ``encoding``, ``length``, the three statistics ``z_chi,
    z_runs, z_serial``, ``p`` (the chance that writing looks as even; 1 if the run is not random)."""
    body = F.regexp_replace("run", "=+$", "")
    encoding = F.coalesce(*[F.when(body.rlike(f"^{p}$"), F.lit(name)) for name, p, _ in ENCODINGS])
    df = runs.withColumn("_body", body).withColumn("encoding", encoding).withColumn("length", F.length("_body"))
    df = df.withColumn("_symbols", _of_encoding({n: s for n, _, s in ENCODINGS})).withColumn("_k", F.length("_symbols").cast("double"))
    df = df.withColumn("_chars", F.split("_body", ""))
    df = df.withColumn("_places", F.transform("_chars", lambda c: F.position(c, F.col("_symbols")).cast("double") - 1))
    n, k = F.col("length").cast("double"), F.col("_k")
    squares = _sum(F.array_distinct("_chars"), lambda c: F.pow(n - F.length(F.replace(F.col("_body"), c, F.lit(""))), F.lit(2.0)))
    df = df.withColumn("_chi", k / n * squares - n)
    # one walk over the symbols: neighbours' products, symbols of the upper half, changes of half
    start = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("prod"), F.lit(0.0).alias("high"), F.lit(0.0).alias("turns"))
    mean = _sum(F.col("_places"), lambda x: x) / n
    df = df.withColumn("_mean", mean)
    half = k / 2
    walk = F.aggregate(
        "_places",
        start,
        lambda acc, x: F.struct(
            x.alias("last"),
            (acc["prod"] + F.coalesce((acc["last"] - F.col("_mean")) * (x - F.col("_mean")), F.lit(0.0))).alias("prod"),
            (acc["high"] + (x >= half).cast("double")).alias("high"),
            (acc["turns"] + F.coalesce(((acc["last"] >= half) != (x >= half)).cast("double"), F.lit(0.0))).alias("turns"),
        ),
    )
    df = df.withColumn("_walk", walk)
    spread = _sum(F.col("_places"), lambda x: (x - F.col("_mean")) * (x - F.col("_mean")))
    high = F.col("_walk.high")
    expected = 2 * high * (n - high) / n + 1
    varied = (expected - 1) * (expected - 2) / (n - 1)
    never = F.lit(1e9)  # symbols of one half or one kind only: as far from random as can be
    df = df.withColumns({
        "z_chi": (F.col("_chi") - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n),
        "z_runs": F.when(varied > 0, (F.col("_walk.turns") + 1 - expected) / F.sqrt(varied)).otherwise(never),
        "z_serial": F.when(spread > 0, (F.col("_walk.prod") / spread + 1 / n) * F.sqrt(n)).otherwise(never),
    })
    two, three = (_of_encoding({e: v[i] for e, v in writing.items()}) for i in (0, 1))
    # counts of writing: mean and variance of the sum of squared counts
    expected2 = n + n * (n - 1) * two
    varied2 = 2 * n * n * two + 4 * n * n * n * F.greatest(three - two * two, F.lit(0.0))
    evenness = (k / n * expected2 - n - F.col("_chi")) / (k / n * F.sqrt(varied2))
    random = F.pow("z_chi", F.lit(2)) + F.pow("z_runs", F.lit(2)) + F.pow("z_serial", F.lit(2)) <= battery_limit
    df = df.withColumn("p", F.when(random, F.least(_tail(evenness), F.lit(1.0))).otherwise(F.lit(1.0)))
    return df.drop("_body", "_symbols", "_k", "_chars", "_places", "_chi", "_mean", "_walk")


def discoveries(tested: DataFrame, fdr: float) -> DataFrame:
    """Rows of ``tested`` that Benjamini-Hochberg accepts within their encoding and length class."""
    by = ["encoding", "size_class"]
    binned = tested.withColumns({
        "size_class": F.floor(2 * F.log2(F.col("length") / F.lit(16.0))),
        "bin": F.when(F.col("p") >= 1, 0).otherwise(F.least(F.floor(-10 * F.log10("p")), F.lit(BINS))).cast("int"),
    })
    bars = binned.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("bar"))  # encodings x classes x bins rows at most
    up = Window.partitionBy(*by).orderBy(F.desc("bin"))
    ranked = bars.withColumn("least", F.sum("bar").over(up)).withColumn("all", F.sum("bar").over(Window.partitionBy(*by)))
    passing = F.pow(F.lit(10.0), -F.col("bin") / 10) <= fdr * F.col("least") / F.col("all")
    limits = ranked.where(passing).groupBy(*by).agg(F.min("bin").alias("limit"))
    return binned.join(limits, by).where(F.col("bin") >= F.col("limit")).drop("limit", "bin", "size_class")


def secret_spans(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", fdr: float = 0.05, battery_limit: float = 11.34) -> tuple[DataFrame, DataFrame]:
    """Documents as ``row, doc_id``, and their spans as ``row, start, end, kind`` (the place of the
    kind in ``KINDS``)."""
    spark = docs.sparkSession
    prepare(spark)
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    narrow = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), body.alias("text"))
    every = [*BASE, (RANDOM_KIND, RANDOM, 0, 16)]
    # each pattern goes through each text once, and a second time where it was found
    matched = narrow.select("doc_id", "text", *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(k) for k, p, *_ in every])
    matched = matched.select(F.monotonically_increasing_id().alias("row"), "doc_id", _letter_counts(F.col(RANDOM_KIND)).alias("letters"), *[_matches(*b) for b in every])
    # the one pass over the texts; row numbers are fixed by being written
    scanned = stage(spark, matched, "secret-matches")
    sums = scanned.agg(*[F.sum(F.col("letters")[i]).alias(f"l{i}") for i in range(len(_LOWER))]).first()
    writing = _writing([x or 0 for x in sums])

    def of_kind(at: int) -> Column:
        return F.transform(F.col(KINDS[at]), lambda m, i: F.struct(F.lit(at).alias("kind"), i.alias("place"), m.alias("m")))

    # dealt by row once: the running sums and all later groups of a row stay where they are
    rows = scanned.select("row", F.explode(F.concat(*map(of_kind, range(len(KINDS))))).alias("x")).select("row", "x.kind", "x.place", "x.m.*").repartition("row")
    before = Window.partitionBy("row", "kind").orderBy("place")
    end = F.sum(F.col("gap") + F.col("size")).over(before)
    spans = rows.withColumn("end", end).where("counts").select("row", "kind", (F.col("end") - F.col("size")).alias("start"), "end", "run")
    spans = stage(spark, spans, "secret-spans")
    is_base = F.col("kind") < len(BASE)
    own = F.max(F.when(is_base, F.col("end"))).over(
        Window.partitionBy("row").orderBy("start", F.desc("end"), "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # a base span that begins no later and ends no earlier; at an equal start the longer one comes first
    base = spans.where(is_base).drop("run")
    fresh = spans.withColumn("_covered", F.coalesce(own, F.lit(-1)) >= F.col("end")).where(~is_base & ~F.col("_covered"))
    random = discoveries(battery(fresh.drop("_covered"), writing, battery_limit=battery_limit), fdr)
    return scanned.select("row", "doc_id"), base.unionByName(random.select(base.columns))


def secret_scan(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans`` for every row of ``docs``."""
    rows, spans = secret_spans(docs, **options)
    named = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    text = F.concat_ws(":", named, F.col("start").cast("string"), F.col("end").cast("string"))
    base = F.col("kind") < len(BASE)
    entry = F.struct("start", "kind", "end", text.alias("text"))

    def listed(entries: Column) -> Column:
        return F.array_join(F.transform(F.sort_array(entries), lambda e: e["text"]), ",")

    grouped = spans.groupBy("row").agg(
        *[F.count_if(F.col("kind") == i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        listed(F.collect_list(F.when(base, entry))).alias("base"),
        listed(F.collect_list(entry)).alias("spans"),
    )
    counts = [F.coalesce(F.col(f"n_{k}"), F.lit(0)).cast("bigint").alias(f"n_{k}") for k in KINDS]
    none = F.lit("")
    return rows.join(grouped, "row", "left").select(
        "doc_id", *counts, F.sha2(F.coalesce("base", none), 256).alias("base_sha256"), F.coalesce("spans", none).alias("spans")
    )


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))
