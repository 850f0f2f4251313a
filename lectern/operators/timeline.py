"""Frames, speech runs and the two clocks, by window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hangover(frames: DataFrame, keys: list[str], active: Column, frames_kept: int) -> DataFrame:
    """`speech`: active now or in any of the frames_kept frames before."""
    recent = Window.partitionBy(*keys).orderBy("frame").rowsBetween(-frames_kept, 0)
    return frames.withColumn("speech", F.max(active).over(recent))


def run_lengths(frames: DataFrame, keys: list[str], flag: Column, out: str = "run") -> DataFrame:
    """Length so far of the run of frames for which flag holds; 0 where it doesn't."""
    order = Window.partitionBy(*keys).orderBy("frame")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = frames.withColumn("__flag", flag).withColumn("__row", F.row_number().over(order))
    broken = F.coalesce(F.max(F.when(~F.col("__flag"), F.col("__row"))).over(upto), F.lit(0))
    return rows.withColumn(out, (F.col("__row") - broken).cast("long")).drop("__flag", "__row")


def dead_since(frames: DataFrame, keys: list[str], quiet: Column, need: int) -> DataFrame:
    """Channels that were quiet for `need` frames on end, and the frame at which that became so."""
    return run_lengths(frames, keys, quiet).where(F.col("run") >= need).groupBy(*keys).agg(F.min("frame").alias("frame"))


def speech_runs(gated: DataFrame, tolerance: int) -> DataFrame:
    """(talk, run, s0, a0, dur) of frames (talk, t, dur) that passed the gate, in one time unit.

    A run begins where a frame doesn't follow the one before within the
    tolerance; s0 is its begin on the clock that only speech advances.
    """
    order = Window.partitionBy("talk").orderBy("t")
    fresh = F.coalesce(F.abs(F.col("t") - F.lag(F.col("t") + F.col("dur")).over(order)) > tolerance, F.lit(True))
    numbered = gated.withColumn("__fresh", fresh.cast("int")).withColumn("run", F.sum("__fresh").over(order))
    runs = numbered.groupBy("talk", "run").agg(F.min("t").alias("a0"), F.sum("dur").alias("dur"))
    before = Window.partitionBy("talk").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("s0", F.coalesce(F.sum("dur").over(before), F.lit(0))).select("talk", "run", "s0", "a0", "dur")


def to_absolute(points: DataFrame, runs: DataFrame, speech: str, out: str) -> DataFrame:
    """points with the absolute time of a time on the speech clock.

    As-of by a window over points and runs together: each run holds from its
    begin to the next one's, the first from ever, and the last one for ever.
    """
    kinds = {f.name: f.dataType for f in points.schema}
    none = F.lit(None)
    begun = runs.select("talk", F.col("s0").cast(kinds[speech]).alias("__t"), F.lit(0).alias("__kind"), F.struct("s0", "a0").alias("__run"), none.cast(points.select(F.struct("*").alias("p")).schema["p"].dataType).alias("__p"))
    asked = points.select("talk", F.col(speech).alias("__t"), F.lit(1).alias("__kind"), none.cast(begun.schema["__run"].dataType).alias("__run"), F.struct("*").alias("__p"))
    talk = Window.partitionBy("talk")
    order = talk.orderBy("__t", "__kind")
    last = F.last("__run", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first = F.min("__run").over(talk)
    rows = begun.unionByName(asked).withColumn("__at", F.coalesce(last, first)).where("__kind = 1")
    t = F.col("__t")
    absolute = F.when(F.col("__at").isNull(), t).otherwise(F.col("__at.a0") + F.greatest(t - F.col("__at.s0"), F.lit(0)))
    return rows.select(*(F.col(f"__p.{c}").alias(c) for c in points.columns if c != out), absolute.alias(out))


def silence_dropped(runs: DataFrame) -> DataFrame:
    """Absolute time up to the end of the last run that is not speech."""
    return runs.groupBy("talk").agg((F.max_by(F.col("a0") + F.col("dur"), "run") - F.sum("dur")).alias("dropped"))


def pause_cut(frames: DataFrame, frame_ms: int, gap_frames: int, most_ms: int, least_ms: int) -> DataFrame:
    """(talk, t0, t1) pieces of speech: cut at pauses of gap_frames and chopped at most_ms; shorter rests than least_ms go.

    frames: (talk, frame, speech). The last piece of a talk keeps one frame of
    the silence after it.
    """
    total = frames.groupBy("talk").agg((F.max("frame") + 1).alias("frames"))
    order = Window.partitionBy("talk").orderBy("frame")
    own = frames.where("speech").select("talk", "frame")
    fresh = F.coalesce(F.col("frame") - F.lag("frame").over(order) - 1 >= gap_frames, F.lit(True))
    own = own.withColumn("__fresh", fresh.cast("int")).withColumn("run", F.sum("__fresh").over(order))
    runs = own.groupBy("talk", "run").agg(F.min("frame").alias("i"), F.max("frame").alias("j"))
    last = F.lead("run").over(Window.partitionBy("talk").orderBy("run")).isNull()
    ends = runs.withColumn("__last", last).join(total, "talk")
    end = F.when(F.col("__last") & (F.col("frames") - F.col("j") - 1 < gap_frames), F.least(F.col("j") + 2, F.col("frames"))).otherwise(F.col("j") + 1)
    spans = ends.select("talk", (F.col("i") * frame_ms).alias("a"), (end * frame_ms).alias("b"))
    length = F.col("b") - F.col("a")
    pieces = F.greatest(F.ceil(length / most_ms), F.lit(1)).cast("long")
    cut = spans.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)))
    start = F.col("a") + F.col("k") * most_ms
    cut = cut.select("talk", start.alias("t0"), F.least(start + most_ms, F.col("b")).alias("t1"))
    return cut.where((F.col("t1") - F.col("t0") == most_ms) | (F.col("t1") - F.col("t0") > least_ms))


def within(frames: DataFrame, t0: Column, t1: Column) -> DataFrame:
    """Frames that overlap [t0, t1)."""
    return frames.where((F.col("t") < t1) & (F.col("t") + F.col("dur") > t0))


def retained(frames: DataFrame, keep: int) -> DataFrame:
    """Frames of the last `keep` time units of each talk."""
    newest = F.max(F.col("t")).over(Window.partitionBy("talk"))
    return frames.withColumn("__new", newest).where(F.col("t") > F.col("__new") - keep).drop("__new")
