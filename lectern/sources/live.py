"""A live source: sound that recorders append to files, as a stream of frames.

    spark.dataSource.register(live.PcmTail)
    spark.readStream.format("pcm_tail").option("path", "halls/").option("channels", 2).load()

Each *.raw file (or the one at the path) is raw 16-bit little-endian PCM of a
talk, channels interleaved. Files only grow, so an offset is a frame number for
each talk, and a batch that runs again reads the same frames. Tasks read their
own ranges of `split` frames; the driver only looks at the files' sizes.

Where capture runs ahead of the query nothing is dropped: a batch takes at most
`most` frames of a talk beyond the last one, and leaves the rest. Only the first
batch after a start takes all that has come: the offset it starts from isn't
told before. Its ranges bound what a task holds, however long the query was down.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from lectern.sources import pcm

SPLIT_FRAMES, MOST_FRAMES = 1_000, 3_000


@dataclass
class Range(InputPartition):
    talk: str
    path: str
    first: int
    last: int


class PcmTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pcm_tail"

    def schema(self) -> str:
        return pcm.FRAMES

    def streamReader(self, schema) -> DataSourceStreamReader:
        o = self.options
        sound = pcm.Sound(int(o.get("channels", 1)), int(o.get("rate", 16_000)), 0, 0)
        return _Tail(o["path"], o.get("talk"), sound, int(o.get("most", MOST_FRAMES)), int(o.get("split", SPLIT_FRAMES)))


class _Tail(DataSourceStreamReader):
    def __init__(self, path: str, talk: str | None, sound: pcm.Sound, most: int, split: int):
        self.path, self.talk, self.sound, self.most, self.split = path, talk, sound, most, split
        self.admitted: dict[str, int] | None = None

    def _there(self) -> dict[str, tuple[str, int]]:
        """By talk: its file and the whole frames in it."""
        return {self.talk or pcm.stem(path): (path, size // self.sound.frame_bytes) for path, size in pcm.listed(self.path, ".raw")}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        there = {talk: n for talk, (_, n) in self._there().items()}
        if self.admitted is None:
            self.admitted = there
        else:
            grown = {talk: min(n, self.admitted.get(talk, 0) + self.most) for talk, n in there.items()}
            self.admitted |= {talk: max(n, self.admitted.get(talk, 0)) for talk, n in grown.items()}
        return dict(self.admitted)

    def partitions(self, start: dict, end: dict) -> list[Range]:
        paths = {talk: path for talk, (path, _) in self._there().items()}
        spans = [(talk, start.get(talk, 0), last) for talk, last in sorted(end.items())]
        return [Range(talk, paths[talk], a, min(a + self.split, last)) for talk, first, last in spans for a in range(first, last, self.split)]

    def read(self, partition: Range) -> Iterator:
        system, _ = pcm.located(self.path)
        with system.open_input_file(partition.path) as f:
            yield from pcm.read_frames(f, self.sound, partition.talk, partition.first, partition.last)

    def commit(self, end: dict) -> None:
        pass
