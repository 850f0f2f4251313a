"""Voice encoders and other pluggable models, by name."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_FACTORIES: dict[str, Callable[[], Callable[[np.ndarray], np.ndarray | None]]] = {}


def register_encoder(name: str, factory: Callable) -> None:
    """factory() makes, once per worker task, a function from samples to a unit vector or None."""
    _FACTORIES[name] = factory


def build_encoder(name: str) -> Callable[[Column], Column]:
    """A pandas UDF over arrays of samples; an unknown name is an error, a failed encoding is null."""
    if name not in _FACTORIES:
        raise ValueError(f"no encoder named {name!r}; known: {', '.join(sorted(_FACTORIES))}")
    factory = _FACTORIES[name]

    @F.pandas_udf("array<double>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = factory()
        for part in parts:
            yield part.map(lambda pcm: None if pcm is None or (v := own(np.asarray(pcm, float))) is None else v.tolist())

    return encode


#: Analysis length, bands and their edges, cepstral coefficients, sample rate.
FFT, BANDS, LOW_HZ, HIGH_HZ, COEFFICIENTS, RATE = 1024, 32, 250.0, 7000.0, 20, 16_000


def spectral_encoder() -> Callable[[np.ndarray], np.ndarray | None]:
    """Shape of the long-term spectrum: log band energies, their cosine transform without the level, at length 1.

    Whole stretches of FFT samples, side by side, give the mean spectrum; bands
    that hold no bin are left out; coefficient i is weighted by i.
    """
    edges = np.geomspace(LOW_HZ, HIGH_HZ, BANDS + 1)
    hz = np.fft.rfftfreq(FFT, 1 / RATE)
    within = (hz >= edges[:-1, None]) & (hz < edges[1:, None])
    within = within[within.any(1)].astype(float)
    window = np.hanning(FFT)
    place = (np.arange(len(within)) + 0.5) * np.pi / len(within)
    order = np.arange(1, COEFFICIENTS + 1)
    basis = np.cos(np.outer(order, place)) * order[:, None]

    def encode(pcm: np.ndarray) -> np.ndarray | None:
        whole = len(pcm) // FFT
        if not whole:
            return None
        mean = np.abs(np.fft.rfft(pcm[: whole * FFT].reshape(whole, FFT) * window, axis=1)).mean(0)
        v = basis @ np.log(within @ mean + 1e-8)
        norm = np.linalg.norm(v)
        return v / norm if norm > 1e-9 else None

    return encode


register_encoder("spectral", spectral_encoder)
