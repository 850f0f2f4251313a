"""Acknowledged ingest: a sink for the message log whose commits are the acknowledgements.

    spark.dataSource.register(ingest.AckLog)
    messages.writeStream.format("ack_log").option("path", "s3://bucket/log").option("checkpointLocation", ...)

Tasks write JSON lines and tell the driver, for each talk, the highest number
they hold. When all tasks of a batch are done the driver writes one small file
for the batch, `commits/<batch>.json`: the files that belong to it and the
acknowledgement of each talk, of that number and all before. So nothing is
acknowledged that isn't stored, a batch that runs again replaces its own file
and what a failed try has left is never read. A sender that lost the answer
sends again; readers drop what came twice by revision, as they do anyway.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage

from lectern.sources import messages, pcm

COMMIT = "batch long, files array<string>, acks array<struct<talk:string,ack:long>>"


@dataclass
class Stored(WriterCommitMessage):
    """A task's file, if it had rows, and the highest number of each talk in it."""

    file: str | None
    highest: dict[str, int] = field(default_factory=dict)


class AckLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ack_log"

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return _Writer(self.options["path"], schema.fieldNames())


class _Writer(DataSourceStreamWriter):
    def __init__(self, path: str, columns: list[str]):
        missing = {"talk", "no"} - set(columns)
        if missing:
            raise ValueError(f"columns are missing: {sorted(missing)}")
        self.path = path

    def write(self, iterator: Iterator[Row]) -> Stored:
        system, root = pcm.located(self.path)
        name, out, highest = f"{uuid.uuid4().hex}.json", None, {}
        try:
            for row in iterator:
                if out is None:
                    system.create_dir(f"{root}/rows")
                    out = system.open_output_stream(f"{root}/rows/{name}")
                own = {k: v for k, v in row.asDict(recursive=True).items() if v is not None}
                out.write((json.dumps(own, ensure_ascii=False) + "\n").encode())
                highest[own["talk"]] = max(highest.get(own["talk"], 0), own["no"])
        finally:
            if out is not None:
                out.close()
        return Stored(name if out else None, highest)

    def commit(self, messages: list[Stored | None], batchId: int) -> None:
        done = [m for m in messages if m is not None]
        acks: dict[str, int] = {}
        for m in done:
            for talk, no in m.highest.items():
                acks[talk] = max(acks.get(talk, 0), no)
        entry = {"batch": batchId, "files": sorted(m.file for m in done if m.file), "acks": [{"talk": t, "ack": n} for t, n in sorted(acks.items())]}
        system, root = pcm.located(self.path)
        system.create_dir(f"{root}/commits")
        aside = f"{root}/.{batchId}.{uuid.uuid4().hex}"  # written aside and moved, so that a reader never finds half of it
        with system.open_output_stream(aside) as out:
            out.write(json.dumps(entry, ensure_ascii=False).encode())
        system.move(aside, f"{root}/commits/{batchId}.json")

    def abort(self, messages: list[Stored | None], batchId: int) -> None:
        """Files of a failed try."""
        system, root = pcm.located(self.path)
        for m in messages:
            if m is not None and m.file:
                system.delete_file(f"{root}/rows/{m.file}")


def received(spark: SparkSession, path: str) -> DataFrame:
    """Message rows with their number on the link (`no`), of committed batches only; body is a message as JSON."""
    stored = spark.read.schema("talk string, no long, body string").json(f"{path}/rows").withColumn("file", F.regexp_extract(F.input_file_name(), "[^/]+$", 0))
    whole = spark.read.schema(COMMIT).json(f"{path}/commits").select(F.explode("files").alias("file"))
    return messages.parsed(stored.join(whole, "file", "left_semi"), "body", "no")


def _acks(commits: DataFrame) -> DataFrame:
    return commits.select(F.explode("acks").alias("a")).select("a.talk", "a.ack")


def acknowledged(spark: SparkSession, path: str) -> DataFrame:
    """(talk, ack): up to which number a talk's messages are stored."""
    return _acks(spark.read.schema(COMMIT).json(f"{path}/commits")).groupBy("talk").agg(F.max("ack").alias("ack"))


def ack_stream(spark: SparkSession, path: str) -> DataFrame:
    """(talk, ack) as they are given, the way back to the senders."""
    return _acks(spark.readStream.schema(COMMIT).json(f"{path}/commits"))
