"""The library as Spark SQL functions of a session.

``register_functions(spark, view)`` makes available, from SQL text and with named arguments:

* ``triage_filter(category => ..., sentiment => ..., urgency => ..., from_address => ..., date_from => ..., date_to => ...)``:
  a table function over the view of stored records; an argument that is left out matches all.
* ``pii_redact(body)``: a struct of the body with its sensitive spans replaced (``redacted_text``) and of those
  spans (``kept``).

The table function is expanded into the calling query, so filters reach the scan as if written out.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..functions import redact as R
from ..operators.insights import PAGE_FIELDS
from ..session import importable

#: An ISO text with offset as an instant; null for others.
_INSTANT = "try_to_timestamp({0}, \"yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX\")"


def _bound(name: str, last: bool) -> str:
    """The instant of a bound; a date alone is its first instant, or the first one after it."""
    day = f"try_to_timestamp(concat(substr({name}, 1, 10), 'T00:00:00Z'), \"yyyy-MM-dd'T'HH:mm:ssXXX\")"
    whole = f"{day} + INTERVAL 1 DAY" if last else day
    exact = f"{_INSTANT.format(name)} + INTERVAL 1 MICROSECOND" if last else _INSTANT.format(name)
    return f"CASE WHEN length({name}) = 10 THEN {whole} ELSE {exact} END"


FILTERS = ("category", "sentiment", "urgency", "from_address")


def register_functions(spark: SparkSession, view: str) -> None:
    """Register the functions in this session; ``view`` names the records (with ``received_ts``)."""
    importable(spark)
    at = "timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', t.received_ts))"
    fields = dict(spark.table(view).dtypes)
    arguments = ", ".join(f"{c} STRING DEFAULT NULL" for c in (*FILTERS, "date_from", "date_to"))
    returned = ", ".join(f"{c} {fields[c]}" for c in PAGE_FIELDS)
    equal = " AND ".join(f"(triage_filter.{c} IS NULL OR t.{c} = triage_filter.{c})" for c in FILTERS)
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION triage_filter({arguments}) RETURNS TABLE ({returned})
        RETURN SELECT {", ".join(f"t.{c}" for c in PAGE_FIELDS)} FROM {view} t
        WHERE t.review_status = 'auto_processed' AND {equal}
          AND (triage_filter.date_from IS NULL OR {at} >= {_bound("triage_filter.date_from", False)})
          AND (triage_filter.date_to IS NULL OR {at} < {_bound("triage_filter.date_to", True)})""")
    spark.udf.register("pii_redact", R.redactor())
