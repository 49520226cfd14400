"""JSON-lines sink with a two-step commit for each micro-batch.

Tasks write files under names of their own; the driver then writes one small commit
file for the micro-batch that names them. Readers take the files of commits only, so a task that
is retried, a micro-batch that is aborted or one that is replayed (its commit file is replaced as
a whole) leaves each line once.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage

from ..session import folders, importable

FORMAT = "mailsift_lines"


def _files(path: str):
    import pyarrow.fs as pafs

    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    lines: int


class LineWriter(DataSourceStreamWriter):
    """Rows with one string column: a line each."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator) -> Written:
        fs, root = _files(self.path)
        name, n, out = f"part-{uuid.uuid4().hex}.jsonl", 0, None
        for row in iterator:
            if out is None:
                fs.create_dir(f"{root}/data", recursive=True)
                out = fs.open_output_stream(f"{root}/data/{name}")
            out.write((row[0] + "\n").encode())
            n += 1
        if out is not None:
            out.close()
        return Written(name if n else None, n)

    def commit(self, messages, batchId: int) -> None:
        fs, root = _files(self.path)
        fs.create_dir(f"{root}/commits", recursive=True)
        mine = f"{root}/commits/.{batchId}-{uuid.uuid4().hex}"
        with fs.open_output_stream(mine) as out:
            out.write(json.dumps([m.file for m in messages if m is not None and m.file]).encode())
        fs.move(mine, f"{root}/commits/{batchId:012d}.json")  # replaces what an earlier try committed

    def abort(self, messages, batchId: int) -> None:
        fs, root = _files(self.path)
        for m in messages:
            if m is not None and m.file:
                fs.delete_file(f"{root}/data/{m.file}")


class LineSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def streamWriter(self, schema, overwrite: bool) -> LineWriter:
        if len(schema.fields) != 1:
            raise ValueError("the sink takes one string column")
        return LineWriter(self.options["path"])


def write_lines(lines: DataFrame, path: str, checkpoint: str):
    """A stream of one string column -> the sink; processes what is there, then stops."""
    spark = lines.sparkSession
    importable(spark)
    spark.dataSource.register(LineSink)
    query = lines.writeStream.format(FORMAT).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
    return query


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The committed lines, one string column ``value``."""
    if "commits" not in folders(spark, path):
        return spark.createDataFrame([], "value string")
    commits = spark.read.option("wholetext", "true").text(f"{path}/commits/*.json")
    names = [f"{path}/data/{n}" for r in commits.collect() for n in json.loads(r.value)]  # a name per task, as a file listing has
    return spark.read.text(names) if names else spark.createDataFrame([], "value string")
