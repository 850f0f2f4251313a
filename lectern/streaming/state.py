"""The folds and the log as stateful streams.

The same step functions as in batch run behind one processor that keeps their
state as JSON, so that a stream gives what batch gives over the same rows, in
however many batches they come. Within a batch rows are put in order; between
batches the source has to keep the order of a key, as a partitioned log does.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from lectern.config import Knobs
from lectern.operators import words

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FoldProcessor(StatefulProcessor):
    """Runs a step over each key's rows; `tick(state, now_ms)` may close what has waited for a timer.

    since(state) tells since when, in ms, something waits (None: nothing does);
    the timer is set once for it, so later rows don't put it off. A key that has
    no rows for ttl_ms loses its state.
    """

    def __init__(self, names: list[str], order: list[str], start: Callable, step: Callable, tick: Callable | None = None, since: Callable | None = None, after_ms: int = 0, ttl_ms: int | None = None):
        self.names, self.order, self.start, self.step, self.tick, self.since, self.after_ms, self.ttl_ms = names, order, start, step, tick, since, after_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("state", "json string", self.ttl_ms)

    def _frame(self, key, out):
        return pd.DataFrame([(*key, *o) for o in out], columns=self.names)

    def handleInputRows(self, key, rows, timerValues):
        state = json.loads(self.kept.get()[0]) if self.kept.exists() else self.start()
        batch, out = pd.concat(list(rows)).sort_values(self.order, kind="stable"), []
        now = timerValues.getCurrentProcessingTimeInMs() if self.tick else 0
        for row in batch.itertuples(index=False):
            state, more = self.step(state, row) if not self.tick else self.step(state, row, now)
            out += more
        self.kept.update((json.dumps(state),))
        self._wait(state)
        yield self._frame(key, out)

    def _wait(self, state) -> None:
        """One timer, for what waits now."""
        if not self.tick:
            return
        since = self.since(state)
        due = None if since is None else int(since) + self.after_ms
        for timer in list(self.handle.listTimers()):
            if timer != due:
                self.handle.deleteTimer(timer)
        if due is not None:
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        out = []
        if self.kept.exists():
            state, out = self.tick(json.loads(self.kept.get()[0]), timerValues.getCurrentProcessingTimeInMs())
            self.kept.update((json.dumps(state),))
            self._wait(state)
        yield self._frame(key, out)

    def close(self) -> None:
        pass


def fold_stream(rows: DataFrame, keys: list[str], order: list[str], schema: str, start, step, tick=None, since=None, after_ms: int = 0, ttl_ms: int | None = None) -> DataFrame:
    """The fold of each key as a stream; rows holds the keys and what the step reads. Needs the RocksDB state store.

    With a tick the step takes the time of the batch as a third argument.
    """
    full = StructType.fromDDL(schema)
    processor = FoldProcessor(full.fieldNames(), order, start, step, tick, since, after_ms, ttl_ms)
    mode = "ProcessingTime" if tick or ttl_ms is not None else "None"
    return rows.groupBy(*keys).transformWithStateInPandas(processor, outputStructType=full, outputMode="Append", timeMode=mode)


def segments_stream(rows: DataFrame, knobs: Knobs = Knobs(), unit: float = 1.0, ttl_ms: int | None = None) -> DataFrame:
    """Live segments (talk, and words.LIVE) of a stream of events (talk, seq, what, words, name).

    What has been open for knobs.max_segment seconds of the machine's time
    closes, though no word may come.
    """
    step = words.live_step(knobs, unit)
    last = words.live_step(knobs, 1.0)

    def live(state, row, now):
        return step(state, words.LiveRow(int(row.seq), row.what, row.words, row.name, now))

    def tick(state, now):
        return last(state, words.LiveRow(-1, "flush", (), None, now))

    since = lambda state: state["open"]["at"] if state["open"] and state["open"]["words"] else None
    own = rows.select("talk", "seq", "what", "words", "name")
    schema = f"talk {own.schema['talk'].dataType.simpleString()}, {words.LIVE}"
    return fold_stream(own, ["talk"], ["seq"], schema, words.live_start, live, tick, since, int(knobs.max_segment * 1000), ttl_ms)


def accept_start() -> list:
    return [None, None, None]


def accept_step(state, row):
    """One segment's log: state [rev, text, speaker]; output of accepted messages: seq, rev, text, speaker."""
    rev, text, spk = state
    if (rev is None and row.t != "seg") or (rev is not None and row.rev <= rev):
        return state, []
    state = [int(row.rev), row.text if row.t == "seg" else text, row.spk]
    return state, [(int(row.seq), *state)]


def accepted_stream(messages: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """(talk, sid, seq, rev, text, spk) for each message that takes effect, as it does.

    A segment without messages for ttl_ms is forgotten; a talk's length bounds
    what has to be remembered.
    """
    own = messages.where(F.col("t").isin("seg", "spk")).select("talk", "sid", "seq", "t", "rev", "text", "spk")
    kinds = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    schema = f"talk {kinds['talk']}, sid {kinds['sid']}, seq long, rev long, text string, spk string"
    return fold_stream(own, ["talk", "sid"], ["seq"], schema, accept_start, accept_step, ttl_ms=ttl_ms)


def once_delivered(messages: DataFrame, time: str, late: str) -> DataFrame:
    """Redelivered messages go; how late one may come bounds the state."""
    return messages.withWatermark(time, late).dropDuplicatesWithinWatermark(["talk", "sid", "rev", "t"])


def activity(messages: DataFrame, time: str, late: str, width: str, slide: str | None = None) -> DataFrame:
    """Messages of a talk in tumbling or sliding windows of event time."""
    span = F.window(time, width, slide) if slide else F.window(time, width)
    return messages.withWatermark(time, late).groupBy("talk", span.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("talk", F.col("w.start").alias("start"), "n")


def sessions(messages: DataFrame, time: str, late: str, gap: str) -> DataFrame:
    return messages.withWatermark(time, late).groupBy("talk", F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("talk", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def append_versions(path: str):
    """A foreachBatch sink: each batch a folder of its own, so that one that runs again writes the same folder.

    What is written grows with the batch, not with the table; current() folds
    the batches, and compact() now and then makes one of them.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def current(spark: SparkSession, path: str, keys: list[str], order: str) -> DataFrame:
    """The last row of each key over the batches at `path`; a compacted table stands for the batches it names."""
    rows = spark.read.option("basePath", path).parquet(path)
    columns = [c for c in rows.columns if c not in (*keys, "batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(order, "batch")).alias("r"))
    return last.select(*keys, "r.*")


def compact(spark: SparkSession, path: str, into: str, keys: list[str], order: str, buckets: int = 64) -> None:
    """The current rows as one new batch at another path, in files by key; a reader moves over when it is whole."""
    current(spark, path, keys, order).repartition(buckets, *keys).write.mode("errorifexists").parquet(f"{into}/batch=-1")
