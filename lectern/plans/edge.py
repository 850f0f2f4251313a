"""What the recogniser hears: wired by the knobs, from frames of one or several channels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.config import Knobs
from lectern.operators import floor, timeline


def heard(frames: DataFrame, knobs: Knobs = Knobs(), gate=None) -> DataFrame:
    """(talk, frame, input) of frames (talk, ch, frame, level_db); rows without an input are silence.

    With knobs.diarize `channel` the owner of the floor is heard, and the floor
    takes the place of the gate. Otherwise channels are mixed where one of them
    passes the gate, by level or by `gate`, a condition of another detector.
    """
    if knobs.diarize == "channel":
        noisy = floor.noise_floor(frames, ["talk", "ch"], knobs)
        owned = floor.owners(frames.select("talk", "frame").distinct(), floor.events(noisy, knobs))
        return floor.routed(owned, knobs, mix=knobs.asr_source == "mix").select("talk", "frame", "input")
    active = F.col("level_db") > knobs.vad_db if gate is None else gate
    mixed = frames.groupBy("talk", "frame").agg(F.max(active).alias("active"))
    speech = timeline.hangover(mixed, ["talk"], F.col("active"), int(knobs.vad_hangover / knobs.frame))
    return speech.select("talk", "frame", F.when(F.col("speech"), "mix").alias("input"))
