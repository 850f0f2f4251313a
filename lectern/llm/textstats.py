"""Statistics of whole texts, one pass in Arrow batches."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

NAMES = (
    "log_chars", "log_words", "word_chars", "upper", "digits", "spaces", "lines_per_word", "full_stops", "commas",
    "exclaims", "pipes", "hash_marks", "percents", "stars", "dollars", "ampersands", "brackets", "other_marks",
    "high_bytes", "distinct_words", "top_word", "distinct_lines", "marked_words", "upper_words", "longest_word",
    "repeated_halves", "sentence_words",
)

_CLASSES = {
    "digits": b"0123456789",
    "full_stops": b".",
    "commas": b",",
    "exclaims": b"!",
    "pipes": b"|",
    "hash_marks": b"#",
    "percents": b"%",
    "stars": b"*",
    "dollars": b"$",
    "ampersands": b"&",
    "brackets": b"()[]{}<>",
}
_MARKED = re.compile(r"[^\w\s.,]{2}(?:\s|$)")


def stats(text: str | None) -> list[float]:
    """The statistics named in NAMES; a null text counts as empty, whose ratios are all 0."""
    text = text or ""
    raw = text.encode()
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = max(len(raw), 1)
    words, lines = text.split(), text.split("\n")
    n = max(len(words), 1)
    own = {name: int(count[list(chars)].sum()) / size for name, chars in _CLASSES.items()}
    named = int(count[[i for chars in _CLASSES.values() for i in chars]].sum())
    letters = int(count[65:91].sum() + count[97:123].sum())
    blank = int(count[[9, 10, 11, 12, 13, 32]].sum())
    high = int(count[128:].sum())
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    half = len(text) // 2
    own |= {
        "log_chars": math.log1p(len(text)),
        "log_words": math.log1p(len(words)),
        "word_chars": (size - blank) / n,
        "upper": int(count[65:91].sum()) / max(letters, 1),
        "spaces": blank / size,
        "lines_per_word": len(lines) / n,
        "other_marks": max(0, len(raw) - named - letters - blank - high) / size,
        "high_bytes": high / size,
        "distinct_words": len(seen) / n,
        "top_word": max(seen.values(), default=0) / n,
        "distinct_lines": len(set(lines)) / len(lines),
        "marked_words": len(_MARKED.findall(text)) / n,
        "upper_words": sum(c for w, c in seen.items() if w.isupper()) / n,
        "longest_word": math.log1p(max(map(len, seen), default=0)),
        "repeated_halves": float(half > 20 and text[half : half + 20] in text[:half]),
        "sentence_words": math.log1p(n / max(1, int(count[46] + count[33] + count[63]))),
    }
    return [float(own[name]) for name in NAMES]


def with_stats(df: DataFrame, text: str, column: str) -> DataFrame:
    """df and one more column, an array of the statistics of its text."""
    schema = T.StructType([*df.schema.fields, T.StructField(column, T.ArrayType(T.DoubleType()))])
    at = df.columns.index(text)

    def run(batches):
        for batch in batches:
            found = pa.array([stats(t.as_py()) for t in batch.column(at)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, column])

    return df.mapInArrow(run, schema)
