"""Session and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings a triage job relies on; applied only when building a new session.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "mailsift", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**DEFAULT_CONF, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


#: The folder that holds the package.
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def importable(spark: SparkSession) -> None:
    """Let Python workers that share this checkout import the package from any working folder.
    (On a cluster whose machines do not share it, install the package or ship it.)"""
    env = spark.sparkContext.environment
    path = [x for x in env.get("PYTHONPATH", "").split(os.pathsep) if x]
    if ROOT not in path:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *path])


#: Rows in one Arrow batch. Spark's default of 10,000 puts that many whole texts, and several copies of
#: them, into every Python worker at once.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower the rows of an Arrow batch for stages that take whole texts to Python, unless the session asks for fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    have = int(spark.conf.get(key, "10000"))
    if have <= 0 or have > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """Folder shared by the whole cluster for checkpoints and staged tables.

    Read from ``spark.checkpoint.dir`` (or the context's checkpoint folder).
    When neither is set, a session with a ``local`` master gets a scratch folder,
    registered so that later calls agree; on a cluster that is an error, since
    executors would write to disks of their own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    sc = None
    if not path:
        try:
            sc = spark.sparkContext
            path = sc.getCheckpointDir()
        except Exception:  # a session without a local SparkContext (e.g. Connect)
            sc = None
    if not path:
        if not (spark.conf.get("spark.master", "") or "").startswith("local") or "cluster" in spark.conf.get("spark.master"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        if sc is not None:
            sc.setCheckpointDir(path)
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique location under the shared folder."""
    root = shared_dir(spark)
    return os.path.join(root, "mailsift", f"{name}-{uuid.uuid4().hex[:12]}")


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly under ``path`` (none where it does not exist)."""
    fs, p = _file_system(spark, path)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the store or of the shared folder; a missing one is fine, so a
    caller that stopped halfway can run again."""
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


@contextmanager
def staged(spark: SparkSession, df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``df`` written to the shared folder, for as long as the block runs."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        delete_folder(spark, path)
