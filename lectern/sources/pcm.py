"""Byte ranges of recordings: what batch and live sources of sound share.

Paths are local ones or addresses that Arrow's file systems know (file, hdfs,
s3, gs), so tasks read their own ranges wherever they run.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs

FRAME_SAMPLES = 512
FRAMES = "talk string, ch int, frame long, t_abs double, pcm array<float>"
ARROW = pa.schema([("talk", pa.string()), ("ch", pa.int32()), ("frame", pa.int64()), ("t_abs", pa.float64()), ("pcm", pa.list_(pa.float32()))])
#: Frames of a record batch.
BATCH_FRAMES = 256


@dataclass(frozen=True)
class Sound:
    """Where 16-bit samples lie in a file, channels interleaved."""

    channels: int
    rate: int
    start: int
    size: int

    @property
    def frame_bytes(self) -> int:
        return 2 * self.channels * FRAME_SAMPLES

    @property
    def frames(self) -> int:
        return self.size // self.frame_bytes


def located(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (pafs.LocalFileSystem(), os.path.abspath(path))


def listed(path: str, ending: str) -> list[tuple[str, int]]:
    """(path within the file system, size) of a file, or of a folder's files with this ending, in any case; none if it isn't there."""
    system, own = located(path)
    info = system.get_file_info(own)
    if info.type == pafs.FileType.Directory:
        found = system.get_file_info(pafs.FileSelector(own))
        return sorted((f.path, f.size) for f in found if f.is_file and f.path.lower().endswith(ending))
    return [(info.path, info.size)] if info.is_file else []


def stem(path: str) -> str:
    return os.path.splitext(os.path.basename(path))[0]


def wav_sound(f: pa.NativeFile, size: int) -> Sound:
    """Where the samples of a WAV file lie; its chunks are walked, only their heads are read."""
    f.seek(0)
    riff, _, kind = struct.unpack("<4sI4s", f.read(12))
    if riff != b"RIFF" or kind != b"WAVE":
        raise ValueError("no WAV file")
    at, channels, rate = 12, 0, 0
    while at + 8 <= size:
        f.seek(at)
        name, length = struct.unpack("<4sI", f.read(8))
        if name == b"fmt ":
            _, channels, rate, _, _, bits = struct.unpack("<HHIIHH", f.read(16))
            if bits != 16:
                raise ValueError(f"{bits} bits a sample, 16 are read")
        elif name == b"data":  # a recorder that was cut off leaves no length
            return Sound(channels, rate, at + 8, size - at - 8 if length in (0, 0xFFFFFFFF) else min(length, size - at - 8))
        at += 8 + length + length % 2
    raise ValueError("a WAV file without samples")


def read_frames(f: pa.NativeFile, sound: Sound, talk: str, first: int, last: int, mono: bool = False) -> Iterator[pa.RecordBatch]:
    """Frames first to last (exclusive); mono: one channel, the mean of all."""
    for a in range(first, last, BATCH_FRAMES):
        n = min(BATCH_FRAMES, last - a)
        f.seek(sound.start + a * sound.frame_bytes)
        raw = np.frombuffer(f.read(n * sound.frame_bytes), "<i2").astype(np.float32) / 32768
        block = raw.reshape(n, FRAME_SAMPLES, sound.channels)
        block = block.mean(2, keepdims=True, dtype=np.float32) if mono else block
        wide = block.shape[2]
        flat = np.ascontiguousarray(block.transpose(0, 2, 1)).ravel()
        at = np.repeat(np.arange(a, a + n), wide)
        pcm = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, FRAME_SAMPLES, dtype=np.int32)), pa.array(flat))
        cells = [pa.array([talk] * (n * wide), pa.string()), pa.array(np.tile(np.arange(wide, dtype=np.int32), n)), pa.array(at), pa.array(at * FRAME_SAMPLES / sound.rate), pcm]
        yield pa.RecordBatch.from_arrays(cells, schema=ARROW)
