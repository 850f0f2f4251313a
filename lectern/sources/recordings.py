"""Recordings as frames, each file read by several tasks.

    spark.dataSource.register(recordings.WavFrames)
    spark.read.format("wav_frames").option("path", "halls/").load()

A file is cut into byte ranges, many small files share a task. The driver only
lists the files: a task reads a file's header for itself and takes the frames
that begin in its range. Rows are those of audio.frames, which reads a file as
one value: whole frames, the last part of one left out. Option `mono` gives the
mean of the channels, `split_bytes` the size of a task's share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lectern.sources import pcm

SPLIT_BYTES = 16 << 20


@dataclass
class Share(InputPartition):
    """(file, its size, from byte, to byte) of what one task reads."""

    ranges: list[tuple[str, int, int, int]]


def shares(files: list[tuple[str, int]], split: int) -> list[Share]:
    """All bytes of the files, in shares of at most `split`."""
    out, now, room = [], [], split
    for path, size in files:
        at = 0
        while at < size:
            n = min(room, size - at)
            now.append((path, size, at, at + n))
            at, room = at + n, room - n
            if not room:
                out.append(Share(now))
                now, room = [], split
    return [*out, Share(now)] if now else out


class WavFrames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav_frames"

    def schema(self) -> str:
        return pcm.FRAMES

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        return _Reader(o["path"], int(o.get("split_bytes", SPLIT_BYTES)), str(o.get("mono", "false")).lower() == "true")


class _Reader(DataSourceReader):
    def __init__(self, path: str, split: int, mono: bool):
        self.path, self.split, self.mono = path, split, mono

    def partitions(self) -> list[Share]:
        return shares(pcm.listed(self.path, ".wav"), self.split)

    def read(self, share: Share) -> Iterator:
        system, _ = pcm.located(self.path)
        for path, size, a, b in share.ranges:
            with system.open_input_file(path) as f:
                sound = pcm.wav_sound(f, size)
                first, last = (min(sound.frames, max(0, -(-(x - sound.start) // sound.frame_bytes))) for x in (a, b))
                yield from pcm.read_frames(f, sound, pcm.stem(path), first, last, self.mono)


def frames(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, mono: bool = False) -> DataFrame:
    """(talk, ch, frame, t_abs, pcm) of the WAV files at a path."""
    spark.dataSource.register(WavFrames)
    return spark.read.format("wav_frames").option("split_bytes", str(split_bytes)).option("mono", str(mono).lower()).load(path)
