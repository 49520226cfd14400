"""Small helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import importable, scratch_path

#: Code points that separate words: space and U+0009 to U+000D. ``bytes.split()``
#: without an argument splits UTF-8 text at exactly these.
SPACES = " \t\n\x0b\x0c\r"


#: Rows in one Arrow batch. Texts can be long; Spark's default of 10,000 rows
#: would put tens of megabytes, or with long texts gigabytes, into one batch.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Lower the rows of an Arrow batch, unless the session asks for fewer, and let
    workers that share this checkout import it from any working folder."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    have = int(spark.conf.get(key, "10000"))
    if have <= 0 or have > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    importable(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that
    survives lost executors and keeps Python stages from running twice."""
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shards_for(docs: DataFrame, text: str, each: int, least: int) -> int:
    """Groups for the texts of ``docs``: one for every ``each`` bytes, ``least`` at least. What a group holds then
    does not grow with the data, whatever ``spark.sql.shuffle.partitions`` is."""
    size = docs.agg(F.sum(F.octet_length(docs[text].cast("string")))).first()[0] or 0
    return max(least, -(-size // each))


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def words(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split()
