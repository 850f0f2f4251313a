"""Secret scan: known shapes, and a token-efficiency test for random strings.

Three known shapes are found by pattern. Beyond them, a run of secret-like
characters is suspicious if a tokenizer's vocabulary needs many tokens for it:
natural words are a few long tokens, random strings many short ones. Runs that
are known digests or identifiers are excluded before the test. Of a run that
known shapes cover in part, the rest is tested.

Runs of fewer than LEAST characters are not tested: below it the ratios of
random strings and of rare words overlap.

Defined results: a null text is the empty text and has no spans; an empty table
gives an empty table; texts are scanned whole, in time that grows with their
length; repeated rows are scanned row by row; a known shape may report the same
characters as another, a random string none that a known shape has; columns
beside key and text are not looked at. Positions are code points, ends
exclusive.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order of the report; the first three are the known shapes.
KINDS = ("assign", "access", "hex", "random")
BASE_KINDS = KINDS[:3]

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
#: Characters of a run that is tested, at least.
LEAST = 16
#: A run is random below so many characters per token: of LEAST characters and more, and of 20 and more.
RATIO_SHORT, RATIO = 1.75, 2.0
LONG = 20
#: Characters encoded at once; bounds the time for one long run.
PIECE = 1024

_RUN = re.compile(rf"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{{{LEAST},}}")
_PART = re.compile(r"[A-Za-z0-9+/_=-]+(?:\.[A-Za-z0-9+/_=-]+)*")

#: Hexadecimal digests by length: MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
_DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: Numbers with separators, and names made of words and short numbers.
_NUMBER = re.compile(r"[\d+/_=.-]+")
_NAME = re.compile(r"/?(?:[A-Za-z]{1,15}|\d{1,8})(?:[/_=.-]+(?:[A-Za-z]{1,15}|\d{1,8}))*[/_=-]*")
#: Words of a name that have to be spelled efficiently themselves.
_WORD = re.compile(r"[A-Za-z]{8,}")


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("secrets", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the known shapes."""
    out = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


def efficient(run: str, encoder: tiktoken.Encoding, ratio: float) -> bool:
    """At least `ratio` characters per token."""
    return len(run) >= ratio * sum(len(encoder.encode_ordinary(run[at : at + PIECE])) for at in range(0, len(run), PIECE))


def is_known(run: str, encoder: tiktoken.Encoding) -> bool:
    """Digests, UUIDs, numbers and names are no secrets by themselves; a name's words are spelled efficiently."""
    if any(p.fullmatch(run) for p in (_DIGEST, _UUID, _NUMBER)):
        return True
    return bool(_NAME.fullmatch(run)) and all(efficient(w, encoder, RATIO) for w in _WORD.findall(run))


def _open_parts(text: str, taken: list[tuple[str, int, int]]):
    """(start, end) of the parts of runs that no taken span covers; both are walked in order, once."""
    covered = sorted((a, b) for _, a, b in taken)
    at = 0
    for m in _RUN.finditer(text):
        start, end = m.span()
        while at < len(covered) and covered[at][1] <= start:
            at += 1
        look = at
        while look < len(covered) and covered[look][0] < end:
            if covered[look][0] > start:
                yield start, covered[look][0]
            start = max(start, covered[look][1])
            look += 1
        if start < end:
            yield start, end


def random_spans(text: str, taken: list[tuple[str, int, int]], encoder: tiktoken.Encoding, ratio: float = RATIO, short: float = RATIO_SHORT) -> list[tuple[str, int, int]]:
    """Runs outside the known shapes that the vocabulary spells inefficiently."""
    out = []
    for start, end in _open_parts(text, taken):
        for m in _PART.finditer(text, start, end):
            run = m[0]
            if len(run) >= LEAST and not is_known(run, encoder) and not efficient(run, encoder, ratio if len(run) >= LONG else short):
                out.append(("random", m.start(), m.end()))
    return out


def scan(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", ratio: float = RATIO) -> DataFrame:
    """Per row: key and spans, an array of (kind, start, end) by start, then kind as listed."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        encoder = _encoder(path, pattern)
        for batch in batches:
            found = []
            for text in batch.column(1):
                text = text.as_py()
                spans = base_spans(text)
                spans += random_spans(text, spans, encoder, ratio)
                spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
                found.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["key", "spans"])

    own = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {own}, spans array<struct<kind:string,start:int,end:int>>").withColumnRenamed("key", key)


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of the known shapes, a digest of their spans, and all spans as text."""
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        key,
        *(of(kind).alias(f"n_{kind}") for kind in BASE_KINDS),
        F.sha2(_written(F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))), 256).alias("base_sha256"),
        _written(F.col("spans")).alias("spans"),
    )
