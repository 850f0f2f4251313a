"""WAV files, each one value: frames, and whole signals of short ones. Long recordings are read in parts by `recordings`."""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.pcm import FRAME_SAMPLES

def decode(content: bytes) -> tuple[np.ndarray, int]:
    """(samples x channels in [-1, 1), rate) of 16-bit PCM."""
    with wave.open(io.BytesIO(content), "rb") as w:
        raw = np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.float32) / 32768
        return raw.reshape(-1, w.getnchannels()), w.getframerate()


def encode(samples: np.ndarray, rate: int = 16_000) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(samples.shape[1])
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1 - 1 / 32768) * 32768).astype("<i2").tobytes())
    return out.getvalue()


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, content): the stem of each WAV file names its talk or its speaker."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.[wW][aA][vV]").load(folder)
    return rows.select(F.regexp_extract("path", r"([^/]+)\.[wW][aA][vV]$", 1).alias("name"), "content")


def frames(recordings: DataFrame) -> DataFrame:
    """(talk, ch, frame, t_abs, pcm) of whole frames; a file's last part of a frame is left out."""

    def run(batches):
        names = ["talk", "ch", "frame", "t_abs", "pcm"]
        for batch in batches:
            for name, content in zip(*batch.columns, strict=True):
                samples, rate = decode(content.as_py())
                n = len(samples) // FRAME_SAMPLES
                for ch in range(samples.shape[1]):
                    pcm = samples[: n * FRAME_SAMPLES, ch].reshape(n, FRAME_SAMPLES)
                    at = np.arange(n)
                    cols = [pa.array([name.as_py()] * n, pa.string()), pa.array([ch] * n, pa.int32()), pa.array(at, pa.int64()), pa.array(at * FRAME_SAMPLES / rate), pa.array(list(pcm), pa.list_(pa.float32()))]
                    yield pa.RecordBatch.from_arrays(cols, names=names)

    return recordings.select("name", "content").mapInArrow(run, "talk string, ch int, frame long, t_abs double, pcm array<float>")


def signals(recordings: DataFrame) -> DataFrame:
    """(name, pcm) of whole files, channels averaged."""

    def run(batches):
        for batch in batches:
            for name, content in zip(*batch.columns, strict=True):
                mono = decode(content.as_py())[0].mean(1)
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()], pa.string()), pa.array([mono], pa.list_(pa.float32()))], names=["name", "pcm"])

    return recordings.select("name", "content").mapInArrow(run, "name string, pcm array<float>")
