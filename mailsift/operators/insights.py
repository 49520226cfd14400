"""Insight queries over the stored triage table (T5).

``triage_query`` is the filter tool of the answer loop; the rest are the
aggregate questions and dashboard tables built from the same table. All of
them are single declarative plans: filters reach the Parquet scan and only
the projected columns are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import timefmt

PAGE_FIELDS = [
    "email_id", "from_address", "subject", "redacted_body", "category",
    "urgency", "sentiment", "feature_tags", "received_at",
]
MIN_FIELDS = ["category", "urgency", "sentiment", "feature_tags", "received_at"]


def auto_processed(triage: DataFrame) -> DataFrame:
    """The base filter every insight applies."""
    return triage.where(F.col("review_status") == S.AUTO_PROCESSED)


def auto_processed_min(triage: DataFrame) -> DataFrame:
    """P5: five-field projection of auto-processed records."""
    return auto_processed(triage).select(*MIN_FIELDS)


def _date_bound(value: str, *, upper: bool, mode: str) -> Column:
    if mode == "lexical":
        return F.col("received_at") <= F.lit(value) if upper else F.col("received_at") >= F.lit(value)
    if len(value) == 10:  # date only: the whole day is inside the range
        day = timefmt.ntz_literal(f"{value} 00:00:00")
        if upper:
            return F.col("received_ts") < F.timestamp_add("DAY", F.lit(1), day)
        return F.col("received_ts") >= day
    ts = timefmt.parse_iso(F.lit(value))
    return F.col("received_ts") <= ts if upper else F.col("received_ts") >= ts


def filter_condition(*, category=None, sentiment=None, urgency=None, from_address=None,
                     date_from=None, date_to=None, mode: str = "time") -> Column:
    """AND of the set filters on top of the base filter; unset = match all.

    ``mode="lexical"`` compares ``received_at`` as text (the original
    behaviour, where a date-only upper bound excludes that day);
    ``mode="time"`` compares instants on ``received_ts``.
    """
    if mode not in ("time", "lexical"):
        raise ValueError(f"mode must be 'time' or 'lexical', not {mode!r}")
    for name, val, allowed in (("category", category, S.CATEGORIES),
                               ("sentiment", sentiment, S.SENTIMENTS),
                               ("urgency", urgency, S.URGENCIES)):
        if val is not None and val not in allowed:
            raise ValueError(f"{name} must be one of {allowed}, not {val!r}")
    conds = [F.col("review_status") == S.AUTO_PROCESSED]
    for name, val in (("category", category), ("sentiment", sentiment),
                      ("urgency", urgency), ("from_address", from_address)):
        if val is not None:
            conds.append(F.col(name) == F.lit(val))
    if date_from is not None:
        conds.append(_date_bound(date_from, upper=False, mode=mode))
    if date_to is not None:
        conds.append(_date_bound(date_to, upper=True, mode=mode))
    return reduce(lambda a, b: a & b, conds)


def partition_condition(triage: DataFrame, *, date_from=None, date_to=None, **_) -> Column | None:
    """Extra predicate on ``received_date`` implied by the date filters.

    When the stored table is partitioned by ``received_date`` this lets the
    scan skip whole days (``PartitionFilters``); the exact bounds are still
    applied to each row. The day range is widened by one day on each side,
    so it can never exclude a row the exact filter keeps (offsets in ISO
    text, lexical comparisons).
    """
    if "received_date" not in triage.columns:
        return None
    cond = None
    if date_from is not None:
        c = F.col("received_date") >= F.date_sub(F.to_date(F.lit(date_from[:10])), 1)
        cond = c if cond is None else cond & c
    if date_to is not None:
        c = F.col("received_date") <= F.date_add(F.to_date(F.lit(date_to[:10])), 1)
        cond = c if cond is None else cond & c
    return cond


def read_store(spark, path: str) -> DataFrame:
    """The stored triage table (partitioned by ``received_date``) with ``received_ts``."""
    return spark.read.parquet(path).withColumn("received_ts", timefmt.parse_iso(F.col("received_at")))


def _filtered(triage: DataFrame, mode: str, filters: dict) -> DataFrame:
    part = partition_condition(triage, **filters)
    cond = filter_condition(mode=mode, **filters)
    return triage.where(cond if part is None else part & cond)


def triage_query(triage: DataFrame, *, mode: str = "time", **filters) -> DataFrame:
    """P2 + P4: filtered, nine-field page of results (all pages joined up)."""
    return _filtered(triage, mode, filters).select(*PAGE_FIELDS)


def filtered_count(triage: DataFrame, *, mode: str = "time", **filters) -> DataFrame:
    """A5: how many auto-processed records match the filters."""
    return _filtered(triage, mode, filters).agg(F.count(F.lit(1)).alias("n"))


def top_feature_tags(triage: DataFrame, k: int = 3, *, date_from=None, date_to=None,
                     mode: str = "time") -> DataFrame:
    """A4/O2: most requested tags among feature requests, top ``k``.

    explode -> partial/final count by tag -> TakeOrderedAndProject; ties are
    broken by tag so the answer is stable.
    """
    rows = triage.where(
        filter_condition(category="feature_request", date_from=date_from, date_to=date_to, mode=mode)
    )
    return (
        rows.select(F.explode("feature_tags").alias("tag"))
        .groupBy("tag")
        .agg(F.count(F.lit(1)).alias("mentions"))
        .orderBy(F.desc("mentions"), F.asc("tag"))
        .limit(k)
    )


def category_compare(triage: DataFrame) -> DataFrame:
    """Categories side by side, one column per sentiment (fixed pivot values)."""
    values = S.SENTIMENTS + ["unknown"]
    return (
        auto_processed(triage)
        .groupBy("category")
        .pivot("sentiment", values)
        .agg(F.count(F.lit(1)))
        .na.fill(0, subset=values)
        .withColumn("total", reduce(lambda a, b: a + b, [F.col(v) for v in values]))
    )


def triage_cube(triage: DataFrame) -> DataFrame:
    """Category x urgency x sentiment with every subtotal."""
    return (
        triage.cube("category", "urgency", "sentiment")
        .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid"))
    )


def triage_rollup(triage: DataFrame) -> DataFrame:
    """Category > urgency > sentiment hierarchy with subtotals."""
    return (
        triage.rollup("category", "urgency", "sentiment")
        .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid"))
    )


def confidence_spread(triage: DataFrame) -> DataFrame:
    """Records by confidence and review status, with their share of all.

    The grand total is summed over the grouped rows (a handful), not by a
    second pass over the records."""
    from pyspark.sql import Window

    counts = triage.groupBy("confidence", "review_status").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counts.select("confidence", "review_status", "n", F.round(F.col("n") / total, 6).alias("share"))


def override_effect(triage: DataFrame) -> DataFrame:
    """A10: urgency as set by the model vs raised by a phrase."""
    return triage.groupBy("urgency", "urgency_override_applied").agg(F.count(F.lit(1)).alias("n"))


def latency_stats(triage: DataFrame, *, exact: bool = True) -> DataFrame:
    """Received -> processed latency in seconds, p50/p95/max per category.

    One scan. ``exact=True`` first counts equal latencies (partial sums on the map
    side), then takes Spark's weighted ``percentile`` over the distinct values of
    a category; ``exact=False`` uses ``percentile_approx`` (fixed memory per group).
    """
    lat = triage.select(
        "category",
        (F.timestamp_diff("MICROSECOND", F.col("received_ts"), F.col("processed_ts")) / F.lit(1e6))
        .alias("latency_s"),
    )
    if exact:
        lat = lat.groupBy("category", "latency_s").agg(F.count(F.lit(1)).alias("_n"))
        n, pct = F.sum("_n"), F.percentile("latency_s", [0.5, 0.95], F.col("_n"))
    else:
        n, pct = F.count(F.lit(1)), F.percentile_approx("latency_s", [0.5, 0.95], 10000)
    stats = lat.groupBy("category").agg(n.alias("n"), pct.alias("_p"), F.max("latency_s").alias("_max"))
    return stats.select(
        "category", "n",
        F.round(F.col("_p")[0], 6).alias("p50_s"),
        F.round(F.col("_p")[1], 6).alias("p95_s"),
        F.round("_max", 6).alias("max_s"),
    )


# ---------------------------------------------------------------------------
# Many filter requests at once
# ---------------------------------------------------------------------------

def _with_request_bounds(requests: DataFrame) -> DataFrame:
    day = F.length("date_to") == 10
    to_day = timefmt.parse_iso(F.concat(F.col("date_to"), F.lit("T00:00:00+00:00")))
    from_day = timefmt.parse_iso(F.concat(F.col("date_from"), F.lit("T00:00:00+00:00")))
    return requests.withColumns({
        "_from_ts": F.when(F.length("date_from") == 10, from_day).otherwise(timefmt.parse_iso(F.col("date_from"))),
        # exclusive upper bound: end of day for a date, just past the instant otherwise
        "_to_ts": F.when(day, F.timestamp_add("DAY", F.lit(1), to_day)).otherwise(
            F.timestamp_add("MICROSECOND", F.lit(1), timefmt.parse_iso(F.col("date_to")))
        ),
    })


EQ_FILTERS = ["category", "sentiment", "urgency", "from_address"]
WILDCARD = "\u0000*"


def _day(ts: str) -> Column:
    return F.datediff(F.to_date(F.col(ts)), F.to_date(F.lit("1970-01-01")))


def tool_call_matches(triage: DataFrame, requests: DataFrame, *, mode: str = "time",
                      carry: list[str] | None = None) -> DataFrame:
    """Every (request, record) pair where the record satisfies the request.

    Null filters match all, so this is a theta join; it is run as an exact
    equi-join. Each request becomes a key: a wildcard for every unset equality
    filter, and the largest aligned day ranges (1, 2, 4, ... days) that its dates
    touch, or a wildcard without dates. Each record is expanded into the shapes
    (set filters x range length) that the requests actually use and joined on that
    key; the exact date bounds stay a condition on the border days. Requests that differ only
    in their dates have different keys, and a request without an equality filter is
    spread over days. The strategy is left to the planner, which splits hot keys.
    """
    carry = [] if carry is None else carry
    t = triage.where(F.col("review_status") == S.AUTO_PROCESSED).select(
        *dict.fromkeys(["email_id", *carry, *EQ_FILTERS, "received_at", "received_ts"]))
    ids = ["question_id", "attempt", "turn", "call_id"]
    req = _with_request_bounds(requests)
    dated = F.col("date_from").isNotNull() & F.col("date_to").isNotNull()
    if mode == "lexical":
        dated = F.lit(False)  # text order has no days
    spans = F.when(dated & (F.col("_from_ts") < F.col("_to_ts")), _day_spans("_from_ts", "_to_ts")).otherwise(
        F.when(dated, F.array().cast("array<struct<level:int,bucket:bigint>>")).otherwise(
            F.array(F.struct(F.lit(-1).alias("level"), F.lit(0).cast("bigint").alias("bucket")))))
    req = req.withColumn("_span", F.explode(spans)).withColumn(
        "_shape", _shape(EQ_FILTERS) + (F.col("_span.level") + 1) * 16)
    # A bounded result: 16 combinations of filters x at most 33 range lengths.
    shapes = sorted(r[0] for r in req.select("_shape").distinct().collect())
    rkey = F.struct(F.col("_shape").alias("shape"), F.col("_span.bucket").alias("bucket"),
                    *[F.coalesce(F.col(c), F.lit(WILDCARD)).alias(c) for c in EQ_FILTERS])
    r = req.select(*ids, "date_from", "date_to", "_from_ts", "_to_ts", rkey.alias("_key")).alias("r")
    day = _day("received_ts").cast("bigint")
    patterns = F.array(*[
        F.struct(
            F.lit(s).alias("shape"),
            (F.lit(0).cast("bigint") if s < 16 else F.shiftright(day, s // 16 - 1)).alias("bucket"),
            *[(F.col(c) if s & (1 << i) else F.lit(WILDCARD)).alias(c) for i, c in enumerate(EQ_FILTERS)])
        for s in shapes
    ])
    kept = list(dict.fromkeys(["email_id", *carry]))
    te = t.select(*[F.col(c).alias(f"t_{c}") for c in kept], "received_at", "received_ts",
                  F.explode(patterns).alias("_key")).alias("te")
    # Qualified names stay unresolved until the join is analysed (one pass).
    tc, rc = (lambda c: F.col(f"te.{c}")), (lambda c: F.col(f"r.{c}"))
    if mode == "lexical":
        lo = tc("received_at") >= rc("date_from")
        hi = tc("received_at") <= rc("date_to")
    else:
        lo = tc("received_ts") >= rc("_from_ts")
        hi = tc("received_ts") < rc("_to_ts")
    cond = (tc("_key") == rc("_key")) & (rc("date_from").isNull() | lo) & (rc("date_to").isNull() | hi)
    return te.join(r, cond, "inner").select(*[tc(f"t_{c}").alias(c) for c in kept], *[rc(c) for c in ids])


#: Longest aligned range: 2^15 days.
LEVELS = 15


def _day_spans(start: str, end: str) -> Column:
    """Aligned ranges of 2^k days that cover the days from ``start`` up to ``end``
    (exclusive instant) without overlap: at each length the first range if it is
    the second half of a longer one, the last if it is a first half; what lies
    between is left to the longer ones. A day belongs to exactly one range, and a
    request has at most two ranges of a length."""
    first = _day(start).cast("bigint")
    last = F.datediff(F.to_date(F.timestamp_add("MICROSECOND", F.lit(-1), F.col(end))), F.to_date(F.lit("1970-01-01")))
    stop = last.cast("bigint") + 1
    empty = F.array().cast("array<struct<level:int,bucket:bigint>>")
    parts = []
    for k in range(LEVELS + 1):
        a, b = F.shiftright(first + F.lit((1 << k) - 1), k), F.shiftright(stop, k)
        item = lambda x, k=k: F.struct(F.lit(k).alias("level"), x.alias("bucket"))
        if k == LEVELS:
            parts.append(F.when(a < b, F.transform(F.sequence(a, F.greatest(a, b - 1)), item)).otherwise(empty))
            break
        odd = a.bitwiseAND(F.lit(1))
        parts.append(F.when((a < b) & (odd == 1), F.array(item(a))).otherwise(empty))
        parts.append(F.when((a + odd < b) & (b.bitwiseAND(F.lit(1)) == 1), F.array(item(b - 1))).otherwise(empty))
    return F.concat(*parts)


def _shape(cols: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(F.col(c).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0))
                                       for i, c in enumerate(cols)])


def tool_call_eval(triage: DataFrame, requests: DataFrame, *, mode: str = "time") -> DataFrame:
    """Rows matched per request; requests with no match keep a count of 0.

    Partial+final count by ``call_id`` over the matches, then a left join back to
    the request table.
    """
    counts = (
        tool_call_matches(triage, requests, mode=mode)
        .groupBy("call_id")
        .agg(F.count(F.lit(1)).alias("records"))
    )
    return (
        requests.join(counts, "call_id", "left")
        .select(*requests.columns, F.coalesce("records", F.lit(0)).cast("long").alias("records"))
    )


def tool_call_union(triage: DataFrame, requests: DataFrame, *, mode: str = "time") -> DataFrame:
    """The concatenated pages of all calls (duplicates kept), tagged by call. The
    page columns travel through the match, so a record that occurs twice gives two rows."""
    return tool_call_matches(triage, requests, mode=mode, carry=PAGE_FIELDS).select(
        "question_id", "attempt", "turn", "call_id", *PAGE_FIELDS
    )


def records_considered(triage: DataFrame, requests: DataFrame, *, mode: str = "time") -> DataFrame:
    """Rows returned over all calls of a (question, attempt); overlaps count twice."""
    return (
        tool_call_eval(triage, requests, mode=mode)
        .groupBy("question_id", "attempt")
        .agg(F.sum("records").cast("long").alias("records_considered"),
             F.count(F.lit(1)).alias("calls"))
    )


def insight_batch(triage: DataFrame, requests: DataFrame, answers: DataFrame, *, mode: str = "time",
                  max_turns: int = S.MAX_TOOL_TURNS) -> DataFrame:
    """M3: outcome of the answer loop for a table of questions.

    ``requests``: the tool calls issued (question, attempt, turn, filters);
    ``answers``: the envelope that ended each (question, attempt) at a turn.
    An attempt succeeds when it ends within ``max_turns`` turns with text
    that is one JSON object whose ``answer`` is a string; the first
    successful attempt decides. ``records_considered`` sums the rows of all
    calls of that attempt (overlaps counted twice); 0 when every attempt
    failed.
    """
    from ..functions import jsonparse as J

    counts = (
        tool_call_eval(triage, requests.where(F.col("turn") <= max_turns), mode=mode)
        .groupBy("question_id", "attempt")
        .agg(F.sum("records").cast("long").alias("records_considered"))
    )
    env = J.parse_envelope(F.col("envelope"))
    ends = (
        answers.where((F.col("turn") <= max_turns))
        .withColumn("_env", env)
        .where(F.col("_env.stop_reason") == "end_turn")
        .withColumn("answer", J.answer_of(J.first_text(F.col("_env"))))
        .where(F.col("answer").isNotNull())
        .select("question_id", "attempt", "answer")
    )
    ok = ends.join(counts, ["question_id", "attempt"], "left").groupBy("question_id").agg(
        F.min_by(F.struct("answer", "records_considered"), "attempt").alias("_best"),
        F.min("attempt").alias("answered_attempt"),
    )
    questions = requests.select("question_id").unionByName(answers.select("question_id")).distinct()
    return questions.join(ok, "question_id", "left").select(
        "question_id",
        F.col("_best.answer").alias("answer"),
        F.coalesce(F.col("_best.records_considered"), F.lit(0)).cast("long").alias("records_considered"),
        F.col("_best").isNull().alias("synthesis_failed"),
        "answered_attempt",
    )


def request_errors(requests: DataFrame) -> DataFrame:
    """Check filter requests against the tool's enumerations and date forms.

    Adds ``request_error`` (null when the request is well formed). A request
    with an error still runs - an unknown value simply matches nothing.
    """
    checks = [
        (F.col("category").isNotNull() & ~F.col("category").isin(S.CATEGORIES), "bad_category"),
        (F.col("sentiment").isNotNull() & ~F.col("sentiment").isin(S.SENTIMENTS), "bad_sentiment"),
        (F.col("urgency").isNotNull() & ~F.col("urgency").isin(S.URGENCIES), "bad_urgency"),
    ]
    b = _with_request_bounds(requests)
    checks += [
        (F.col("date_from").isNotNull() & F.col("_from_ts").isNull(), "bad_date_from"),
        (F.col("date_to").isNotNull() & F.col("_to_ts").isNull(), "bad_date_to"),
    ]
    err = F.lit(None).cast("string")
    for cond, label in reversed(checks):
        err = F.when(cond, F.lit(label)).otherwise(err)
    return b.withColumn("request_error", err).drop("_from_ts", "_to_ts")
