"""Vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.config import Knobs


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def bound(value: Column, f) -> Column:
    """f(value), with the value computed once however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def unit(v: Column) -> Column:
    """v at length 1; null where it has none."""
    scaled = lambda x, norm: F.when(norm > 1e-9, F.transform(x, lambda c: c / norm))
    return bound(v, lambda x: bound(F.sqrt(dot(x, x)), lambda norm: scaled(x, norm)))


def mean_vector(dim: int, v: str = "v", weight: Column | None = None) -> Column:
    """Unit (weighted) mean over a group: one sum for each component, combined before the shuffle."""
    w = F.lit(1.0) if weight is None else weight
    return unit(F.array(*(F.sum(F.col(v)[i] * w) for i in range(dim))))


def sigmoid(x: Column, temp: float) -> Column:
    return 1.0 / (1.0 + F.exp(-x / max(temp, 1e-6)))


def confidence(best: Column, second: Column, knobs: Knobs = Knobs()) -> Column:
    """In [0, 1]: the lead over the threshold and over the second best."""
    return sigmoid((best - knobs.assign) + (best - second - knobs.margin_ref), knobs.conf_temp)


def lag_ms(decode: Column, chunk: Column | float) -> Column:
    """How far the shown text is behind, from the seconds a chunk took to decode and its length."""
    return F.round((decode + chunk) * 1000.0)


def latency(now: Column, emitted_at: Column) -> Column:
    """Seconds from the emission of a message to its showing; clocks that disagree give no negative ones."""
    return F.greatest(now - emitted_at, F.lit(0.0))


def new_confidence(best: Column, knobs: Knobs = Knobs()) -> Column:
    """Of a cluster that has just begun."""
    return F.least(F.lit(knobs.new_conf_cap), sigmoid(F.lit(knobs.assign) - best - knobs.margin_ref, knobs.conf_temp))


def gain(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20.0)


def level_db(samples: Column, outside: float = 1e-10, inside: float = 0.0) -> Column:
    """Level of an array of samples in dB; the two small terms keep silence finite."""
    square = F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return 20.0 * F.log10(F.sqrt(square / F.size(samples) + inside) + outside)
