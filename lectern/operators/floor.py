"""Who has the floor: noise, leaders, bleed and the turn of speakers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.config import Knobs
from lectern.operators.folds import fold


def noise_step(knobs: Knobs):
    """Noise follows the level down fast and up slowly; the first level is the noise."""

    def step(noise, row):
        if noise is None:
            noise = row.level_db
        else:
            gap = row.level_db - noise
            noise = noise + gap * (knobs.noise_fall if gap < 0 else knobs.noise_rise)
        return noise, [(row.frame, row.level_db, noise, row.level_db - noise)]

    return step


def noise_floor(frames: DataFrame, keys: list[str], knobs: Knobs = Knobs()) -> DataFrame:
    """keys, frame, level_db, noise_db and snr, which uses the noise after the frame."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frames.select(*keys).schema.fields)
    schema = f"{kinds}, frame long, level_db double, noise_db double, snr double"
    return fold(frames.select(*keys, "frame", "level_db"), keys, ["frame"], schema, lambda: None, noise_step(knobs))


def leaders(snr: DataFrame, knobs: Knobs = Knobs()) -> DataFrame:
    """Per (talk, frame): the active channel of the best snr and the others within the margin. Ties: the lower channel."""
    active = snr.where(F.col("snr") >= knobs.open_snr)
    by = Window.partitionBy("talk", "frame")
    ranked = active.withColumn("place", F.row_number().over(by.orderBy(F.desc("snr"), "ch"))).withColumn("best", F.max("snr").over(by))
    near = F.when((F.col("place") > 1) & (F.col("best") - F.col("snr") < knobs.margin_db), F.col("ch"))
    return ranked.groupBy("talk", "frame").agg(F.max_by("ch", -F.col("place")).alias("leader"), F.array_sort(F.collect_list(near)).alias("near"))


def bleed(pairs: DataFrame, knobs: Knobs = Knobs(), keys: tuple[str, ...] = ("talk",)) -> DataFrame:
    """pairs (keys, frame, a, b: levels of two channels) with their correlation over the last frames, and `bleed`.

    Too few frames or a flat level count as bleed.
    """
    recent = Window.partitionBy(*keys).orderBy("frame").rowsBetween(1 - knobs.corr_frames, 0)
    mean = lambda c: F.avg(c).over(recent)
    a, b = F.col("a"), F.col("b")
    rows = pairs.select("*", F.count(a).over(recent).alias("__n"), mean(a).alias("__a"), mean(b).alias("__b"), mean(a * a).alias("__aa"), mean(b * b).alias("__bb"), mean(a * b).alias("__ab"))
    var_a = F.greatest(F.col("__aa") - F.col("__a") * F.col("__a"), F.lit(0.0))
    var_b = F.greatest(F.col("__bb") - F.col("__b") * F.col("__b"), F.lit(0.0))
    flat = (F.sqrt(var_a) < 1e-6) | (F.sqrt(var_b) < 1e-6) | (F.col("__n") < knobs.corr_min_frames)
    corr = F.when(~flat, F.try_divide(F.col("__ab") - F.col("__a") * F.col("__b"), F.sqrt(var_a * var_b)))
    return rows.withColumn("corr", corr).withColumn("bleed", F.coalesce(F.col("corr") >= knobs.bleed_corr, F.lit(True))).drop("__n", "__a", "__b", "__aa", "__bb", "__ab")


def channel_bleed(frames: DataFrame, knobs: Knobs = Knobs()) -> DataFrame:
    """(talk, x, y, frame, bleed) for each two channels x < y of a talk; frames: (talk, ch, frame, level_db)."""
    own = frames.select("talk", "frame", F.col("ch").alias("x"), F.col("level_db").alias("a"))
    other = frames.select("talk", "frame", F.col("ch").alias("y"), F.col("level_db").alias("b"))
    return bleed(own.join(other, ["talk", "frame"]).where("x < y"), knobs, ("talk", "x", "y")).select("talk", "x", "y", "frame", "bleed")


def rivals(frames: DataFrame, knobs: Knobs = Knobs()) -> DataFrame:
    """Per (talk, frame): the leader, its snr, the second channel, and the overlap: others within the margin that are no bleed of it.

    frames: (talk, ch, frame, level_db, snr). Frames without an active channel have no row.
    """
    active = frames.where(F.col("snr") >= knobs.open_snr).select("talk", "frame", "ch", "snr")
    by = Window.partitionBy("talk", "frame")
    order = by.orderBy(F.desc("snr"), "ch")
    first = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = active.withColumns({"place": F.row_number().over(order), "leader": F.first("ch").over(first), "best": F.first("snr").over(first)})
    pair = ranked.withColumns({"x": F.least("ch", "leader"), "y": F.greatest("ch", "leader")})
    met = pair.join(channel_bleed(frames, knobs), ["talk", "x", "y", "frame"], "left")
    near = (F.col("place") > 1) & (F.col("best") - F.col("snr") < knobs.margin_db) & ~F.coalesce("bleed", F.lit(True))
    found = F.array_sort(F.collect_list(F.when(near, F.struct("place", "ch"))))
    return met.groupBy("talk", "frame").agg(
        F.first("leader").alias("leader"), F.first("best").alias("snr"), F.max(F.when(F.col("place") == 2, F.col("ch"))).alias("second"), F.transform(found, lambda x: x["ch"]).alias("overlap")
    )


def turn_step(knobs: Knobs):
    """Floor ownership. State: [frames seen, owner, candidate, frames of the candidate, frames left to the owner]."""
    attack, hold, warmup = knobs.frames(knobs.attack), knobs.frames(knobs.hold), knobs.frames(knobs.warmup)

    def step(state, row):
        seen, owner, candidate, count, left = state
        seen += 1
        leader = None if row.leader is None or row.leader != row.leader else int(row.leader)
        if seen < warmup:
            return [seen, owner, candidate, count, left], []
        if leader is None:
            # silence neither counts for a candidate nor against it, until the owner is let go
            if owner is None:
                return [seen, owner, candidate, count, left], []
            if left > 1:
                return [seen, owner, candidate, count, left - 1], []
            return [seen, None, None, 0, 0], [(row.frame, None, "released")]
        if leader == owner:
            return [seen, owner, None, 0, hold], []
        count = count + 1 if candidate == leader else 1
        if count < attack:
            return [seen, owner, leader, count, hold], []
        return [seen, leader, None, 0, hold], [(row.frame, leader, "taken")]

    return step


def turn_start() -> list:
    return [0, None, None, 0, 0]


def turns(frames: DataFrame, knobs: Knobs = Knobs()) -> DataFrame:
    """(talk, frame, owner, reason) where the floor changes; frames: (talk, frame, leader), a null leader is silence."""
    kind = frames.schema["talk"].dataType.simpleString()
    schema = f"talk {kind}, frame long, owner long, reason string"
    own = frames.select("talk", "frame", F.col("leader").cast("double").alias("leader"))
    return fold(own, ["talk"], ["frame"], schema, turn_start, turn_step(knobs)).withColumn("owner", F.col("owner").cast("long"))


def events(frames: DataFrame, knobs: Knobs = Knobs()) -> DataFrame:
    """(talk, frame, owner, overlap, reason, snr, second) where the floor changes; frames: (talk, ch, frame, level_db, snr)."""
    lead = rivals(frames, knobs)
    every = frames.select("talk", "frame").distinct().join(lead.select("talk", "frame", "leader"), ["talk", "frame"], "left")
    told = turns(every, knobs).join(lead.drop("leader"), ["talk", "frame"], "left")
    return told.select("talk", "frame", "owner", F.coalesce("overlap", F.array().cast("array<bigint>")).alias("overlap"), "reason", F.round("snr", 1).alias("snr"), "second")


def owners(frames: DataFrame, told: DataFrame) -> DataFrame:
    """(talk, frame, owner) after each frame; told: (talk, frame, owner) of events()."""
    upto = Window.partitionBy("talk").orderBy("frame").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = frames.select("talk", "frame").join(told.select("talk", "frame", F.struct("owner").alias("__now")), ["talk", "frame"], "left")
    return rows.select("talk", "frame", F.last("__now", ignorenulls=True).over(upto)["owner"].alias("owner"))


def routed(frames: DataFrame, knobs: Knobs = Knobs(), mix: bool = False) -> DataFrame:
    """`input` of the recogniser at (frame, owner): 'mix' in warm-up or by choice, else the owner's channel, or null."""
    if mix:
        return frames.withColumn("input", F.lit("mix"))
    warm = F.col("frame") + 1 < knobs.frames(knobs.warmup)
    return frames.withColumn("input", F.when(warm, "mix").otherwise(F.concat(F.lit("ch"), F.col("owner").cast("string"))))


def status(snr: DataFrame, dead: DataFrame) -> DataFrame:
    """Last snr and noise of each channel, rounded to a tenth, and if it is dead."""
    last = snr.groupBy("talk", "ch").agg(F.max_by(F.struct("snr", "noise_db"), "frame").alias("x"))
    rows = last.join(dead.select("talk", "ch", F.lit(True).alias("dead")), ["talk", "ch"], "left")
    return rows.select("talk", "ch", F.round("x.snr", 1).alias("snr"), F.round("x.noise_db", 1).alias("noise_db"), F.coalesce("dead", F.lit(False)).alias("dead"))


def floor_status(lead: DataFrame, told: DataFrame, knobs: Knobs = Knobs()) -> DataFrame:
    """Per talk: the owner now and the overlap, which is that of the last frame with a leader unless the floor was released since.

    lead: (talk, frame, overlap) of rivals(); told: (talk, frame, owner) of events().
    """
    warm = lead.where(F.col("frame") + 1 >= knobs.frames(knobs.warmup)).select("talk", "frame", "overlap")
    released = told.where("owner is null").select("talk", "frame", F.array().cast(lead.schema["overlap"].dataType).alias("overlap"))
    overlap = warm.unionByName(released).groupBy("talk").agg(F.max_by("overlap", "frame").alias("overlap"))
    owner = told.groupBy("talk").agg(F.max_by(F.struct("owner"), "frame")["owner"].alias("owner"))
    return overlap.join(owner, "talk", "left").select("talk", "owner", "overlap")
