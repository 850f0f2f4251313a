"""From recordings to labelled segments: cutting, windows, enrolment, attribution, scoring."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.config import Knobs
from lectern.functions.encoders import spectral_encoder
from lectern.functions.vectors import level_db
from lectern.operators import revlog, scoring, speakers, timeline
from lectern.operators.folds import fold
from lectern.plans import talks

Encoder = Callable[[np.ndarray], np.ndarray | None]
WINDOWS = "array<struct<t0:double,t1:double,v:array<double>>>"

#: Speech of a recording lies within this range below its loudest frame.
SPEECH_RANGE_DB = 40.0


def cut(frames: DataFrame, knobs: Knobs = Knobs()) -> DataFrame:
    """(talk, sid, t0, t1 in ms) pieces of speech of frames (talk, frame, pcm) of one channel."""
    level = frames.select("talk", "frame", level_db(F.col("pcm"), outside=1e-12).alias("db"))
    loud = level.withColumn("speech", F.col("db") >= F.max("db").over(Window.partitionBy("talk")) - SPEECH_RANGE_DB)
    ms = int(knobs.frame * 1000)
    pieces = timeline.pause_cut(loud.select("talk", "frame", "speech"), ms, knobs.frames(knobs.pause_split), int(knobs.max_segment * 1000), 150)
    return pieces.withColumn("sid", F.row_number().over(Window.partitionBy("talk").orderBy("t0")).cast("long"))


def windowed(pcm: np.ndarray, t0: float, encoder: Encoder, knobs: Knobs) -> list[tuple[float, float, list[float]]]:
    """(from, to, vector) of each window with enough voiced sound."""
    size, hop = int(knobs.window * knobs.sample_rate), int(knobs.hop * knobs.sample_rate)
    out = []
    for start in range(0, max(len(pcm) - size, 0) + 1, hop):
        part = pcm[start : start + size]
        whole = part[: len(part) // knobs.frame_samples * knobs.frame_samples].reshape(-1, knobs.frame_samples)
        if len(whole):
            db = 20 * np.log10(np.sqrt((whole**2).mean(1) + 1e-12))
            part = whole[(db >= db.max() - knobs.voiced_range_db) & (db >= knobs.voiced_floor_db)].ravel()
        if len(part) < knobs.min_voiced * knobs.sample_rate:
            continue
        v = encoder(part)
        if v is not None:
            end = min(start + size, len(pcm))
            out.append((t0 + start / knobs.sample_rate, t0 + end / knobs.sample_rate, v.tolist()))
    return out


def segment_windows(signals: DataFrame, spans: DataFrame, factory: Callable[[], Encoder] = spectral_encoder, knobs: Knobs = Knobs()) -> DataFrame:
    """(talk, sid, wins) of spans (talk, sid, t0, t1 in ms) over signals (name, pcm).

    The span's samples are cut out before Python sees them.
    """
    per_ms = knobs.sample_rate // 1000
    first, n = (F.col("t0") * per_ms + 1).cast("int"), ((F.col("t1") - F.col("t0")) * per_ms).cast("int")
    rows = signals.withColumnRenamed("name", "talk").join(spans, "talk").select("talk", "sid", (F.col("t0") / 1000).cast("double").alias("t0"), F.slice("pcm", first, n).alias("pcm"))
    return _windowed_rows(rows, factory, knobs)


def windows_of_frames(frames: DataFrame, spans: DataFrame, factory: Callable[[], Encoder] = spectral_encoder, knobs: Knobs = Knobs()) -> DataFrame:
    """(talk, sid, wins) of spans (talk, sid, t0, t1 in ms) over frames (talk, frame, pcm) of one channel.

    A span meets only its own frames, which come together in one row; no task
    holds a recording.
    """
    per_ms, size = knobs.sample_rate // 1000, knobs.frame_samples
    first = F.expr(f"t0 * {per_ms} div {size}")
    wide = spans.select("talk", "sid", "t0", "t1", F.explode(F.sequence(first, F.expr(f"greatest(t0 * {per_ms}, t1 * {per_ms} - 1) div {size}"))).alias("frame"))
    met = wide.join(frames.select("talk", F.col("frame").cast("long").alias("frame"), "pcm"), ["talk", "frame"])
    pieces = met.groupBy("talk", "sid").agg(F.first("t0").alias("t0"), F.first("t1").alias("t1"), F.sort_array(F.collect_list(F.struct("frame", "pcm"))).alias("own"))
    whole = F.flatten(F.transform("own", lambda x: x["pcm"]))
    at = (F.col("t0") * per_ms - F.col("own")[0]["frame"] * size + 1).cast("int")
    rows = pieces.select("talk", "sid", (F.col("t0") / 1000).cast("double").alias("t0"), F.slice(whole, at, ((F.col("t1") - F.col("t0")) * per_ms).cast("int")).alias("pcm"))
    return _windowed_rows(rows, factory, knobs)


def _windowed_rows(rows: DataFrame, factory: Callable[[], Encoder], knobs: Knobs) -> DataFrame:
    """(talk, sid, wins) of rows (talk, sid, t0 in s, pcm)."""
    kind = pa.list_(pa.struct([("t0", pa.float64()), ("t1", pa.float64()), ("v", pa.list_(pa.float64()))]))

    def run(batches):
        encoder = factory()
        for batch in batches:
            found = []
            for t0, pcm in zip(batch.column(2), batch.column(3), strict=True):
                wins = windowed(np.asarray(pcm.values, float) if pcm.is_valid else np.zeros(0), t0.as_py(), encoder, knobs)
                found.append([{"t0": a, "t1": b, "v": v} for a, b, v in wins])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, kind)], names=["talk", "sid", "wins"])

    return rows.mapInArrow(run, f"talk string, sid long, wins {WINDOWS}")


def _mean(wins) -> np.ndarray | None:
    if not len(wins):
        return None
    m = np.mean([np.asarray(w["v"], float) for w in wins], axis=0)
    norm = np.linalg.norm(m)
    return m / norm if norm > 1e-9 else None


def enrol(signals: DataFrame, factory: Callable[[], Encoder] = spectral_encoder, knobs: Knobs = Knobs()) -> dict[str, list[float]]:
    """Mean vector of each named signal; those without speech are left out. Enrolled speakers are few."""
    whole = signals.select(F.col("name").alias("talk"), F.lit(0).cast("long").alias("sid"), F.lit(0).cast("long").alias("t0"), (F.size("pcm") * 1000 / knobs.sample_rate).cast("long").alias("t1"))
    found = {r["talk"]: _mean(r["wins"]) for r in segment_windows(signals, whole, factory, knobs).collect()}
    return {name: v.tolist() for name, v in sorted(found.items()) if v is not None}


def _change(wins, labels: list[str | None], knobs: Knobs) -> float | None:
    """Time of the one label change within a segment, if its sides sound different."""
    turns = [i for i in range(1, len(labels)) if labels[i] != labels[i - 1]]
    if len(turns) != 1:
        return None
    i = turns[0]
    a, b = _mean(wins[:i]), _mean(wins[i:])
    if a is None or b is None or float(a @ b) >= knobs.assign:
        return None
    return round((wins[i - 1]["t1"] + wins[i]["t1"]) / 2, 2)


def attribute_step(knobs: Knobs):
    """A segment's speaker from its windows: they are looked up without learning, their mean is learned.

    Output: sid, raw label, shown label or null, confidence, time of a change, mean vector, length.
    """
    inner = speakers.assign_step(knobs)

    def step(state, row):
        v = _mean(row.wins)
        if v is None:
            return state, [(int(row.sid), None, None, 0.0, None, None, 0.0)]
        voices = speakers.Registry(state, knobs)
        labels = [voices.observe(np.asarray(w["v"], float), learn=False)[0] for w in row.wins]
        state, [(sid, raw, _, conf)] = inner(state, type(row)._make((row.sid, row.wins, v)))
        at = _change(row.wins, labels, knobs)
        conf = round(conf * (knobs.mixed_penalty if at is not None else 1.0), 3)
        shown = raw if conf >= knobs.min_conf else None
        return state, [(sid, raw, shown, conf, at, v.tolist(), float(row.wins[-1]["t1"] - row.wins[0]["t0"]))]

    return step


def attributed(windows: DataFrame, enrolled: dict[str, list[float]] | None = None, knobs: Knobs = Knobs()) -> DataFrame:
    """(talk, sid, raw, spk, conf, change_at, v, weight) of segment windows (talk, sid, wins)."""
    schema = "talk string, sid long, raw string, spk string, conf double, change_at double, v array<double>, weight double"
    rows = windows.select("talk", "sid", "wins", F.lit(None).cast("double").alias("v"))
    return fold(rows, ["talk"], ["sid"], schema, lambda: speakers.Registry.empty(enrolled), _with_rows(attribute_step(knobs)))


def _with_rows(step):
    """The step on rows of (sid, wins, v) only."""
    kind = pd.DataFrame({"sid": [0], "wins": [None], "v": [None]}).itertuples(index=False, name="Segment")
    made = type(next(iter(kind)))
    return lambda state, row: step(state, made(row.sid, row.wins, None))


def final_labels(online: DataFrame, enrolled: dict[str, list[float]] | None = None, limit: float | None = None, knobs: Knobs = Knobs()) -> DataFrame:
    """(talk, sid, spk) after the look back over the whole talk; segments it says nothing about keep their label."""
    heard = online.where("v is not null")
    refined = speakers.refined_labels(heard.select("talk", "sid", "v", "weight"), knobs, enrolled, limit)
    return online.select("talk", "sid", F.col("spk").alias("was")).join(refined.select("talk", "sid", "spk"), ["talk", "sid"], "left").select("talk", "sid", F.coalesce("spk", "was").alias("spk"))


def finished(sent: DataFrame, segments: DataFrame, titles: DataFrame, online: DataFrame, merged: DataFrame, refined: DataFrame | None, model=None) -> dict[str, DataFrame]:
    """What the end of a talk brings, in this order: late labels, the labelled segments, the talk's state, its summary.

    All segments are there before the look back begins, as the stream has ended.
    refined is None where there is none to be.
    """
    none = online.select("talk", "sid", "spk", "conf").where("false")
    changes = revlog.relabelled(sent, speakers.late_labels(online, merged, none if refined is None else refined))
    labelled = revlog.last_labels(segments, changes)
    return {
        "changes": changes,
        "segments": labelled,
        "talks": sent.select("talk").distinct().withColumn("state", F.lit("ended")),
        "summaries": talks.summaries(labelled, titles, model),
    }


def labelled_by(windows: DataFrame, knobs: Knobs = Knobs(), enrolled: dict[str, list[float]] | None = None) -> DataFrame:
    """Online labels by the strategy of knobs.diarize: `embed` listens; by any other no segment is labelled."""
    if knobs.diarize == "embed":
        return attributed(windows, enrolled, knobs)
    return attributed(windows.where("false"), enrolled, knobs)


def error_rates(reference: DataFrame, spans: DataFrame, labels: DataFrame, knobs: Knobs = Knobs()) -> DataFrame:
    """Error rates of labels (talk, sid, spk) on spans (talk, sid, t0, t1) against a reference (scenario, ord, spk, t0, t1)."""
    hyp = spans.join(labels.select("talk", "sid", "spk"), ["talk", "sid"]).select(F.col("talk").alias("scenario"), F.col("sid").alias("ord"), "spk", "t0", "t1")
    counted = scoring.grid(reference, hyp, 10, int(knobs.collar * 100))
    return scoring.components(counted, scoring.mapping(scoring.overlaps(counted)))
