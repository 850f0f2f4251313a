"""Byte-level BPE: encode and decode whole texts.

Two tiers per pre-token. A minimal perfect hash over the vocabulary answers
pre-tokens that are tokens themselves; everything else is merged with a heap of
adjacent pairs over a linked list of byte spans, so a pre-token of n bytes costs
O(n log n) however long it is. A memo in each Python worker, bounded in bytes,
keeps the answers for short pre-tokens that come again.

Defined results: a null text counts as the empty text (no tokens, empty bytes);
an empty table gives an empty table; repeated rows and repeated ids are encoded
row by row, keys of any type; texts of any length are encoded whole; other
columns of the input are not looked at, whatever their names.
"""

from __future__ import annotations

import base64
import heapq
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_M64 = (1 << 64) - 1

#: Pre-tokens in a generation of a worker's memo, of which there are two, and characters of one that is kept:
#: with 4 bytes a character, the same again for the ids and some 200 of Python's own, 2 x 150,000 x 250 B in the mean.
MEMO_LIMIT, MEMO_BYTES, MEMO_CHARS = 150_000, 12 << 20, 64
#: Rows of one output batch; bounds the memory of a worker.
OUT_ROWS = 256


class PerfectHash:
    """Minimal perfect hash of a fixed key set, as levels of bit arrays.

    On each level the keys that have a slot of their own settle there, the rest
    move on. A key's number is the rank of its bit over all levels. A stranger
    may get any number, so the caller compares the key.
    """

    def __init__(self, keys: list[bytes], spare: float = 1.6):
        left = np.array([xxhash.xxh64_intdigest(k) for k in keys], dtype=np.uint64)
        self.levels: list[tuple[int, int, int]] = []
        parts, base = [], 0
        while left.size:
            if len(self.levels) > 60:
                raise ValueError("keys repeat, or two of them share their 64-bit hash")
            size = max(64, -(-int(left.size * spare) // 64) * 64)
            mult = xxhash.xxh64_intdigest(b"level", len(self.levels)) | 1  # unrelated from level to level
            slot = ((left * np.uint64(mult)) >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)
            alone = np.bincount(slot.astype(np.int64), minlength=size) == 1
            parts.append(alone)
            self.levels.append((base, size, mult))
            base += size
            left = left[~alone[slot.astype(np.int64)]]
        bits = np.concatenate(parts) if parts else np.zeros(64, bool)
        packed = np.packbits(bits, bitorder="little").view("<u8")
        self.words = packed.tolist()
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]).tolist()
        self.size = self.ranks[-1]

    def number(self, key: bytes) -> int:
        h = xxhash.xxh64_intdigest(key)
        for base, size, mult in self.levels:
            at = base + (((h * mult & _M64) >> 32) * size >> 32)
            word, bit = self.words[at >> 6], at & 63
            if word >> bit & 1:
                return self.ranks[at >> 6] + (word & ((1 << bit) - 1)).bit_count()
        return -1


class Codec:
    """Encoder and decoder for one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.findall = regex.compile(pattern).findall
        self.shadow = _disputed(ranks)
        self.may_be_disputed = re.compile(f"[{chr(min(self.shadow, default=0x10FFFF))}-\U0010ffff]").search
        self.disputed = {*map(chr, self.shadow)}
        self.ranks = ranks
        self.pairs = {(b[0], b[1]): i for b, i in ranks.items() if len(b) == 2}
        self.token = {i: b for b, i in ranks.items()}
        keys = list(ranks)
        self.hash = PerfectHash(keys)
        self.whole: list[tuple[bytes, int]] = [(b"", -1)] * self.hash.size
        for key in keys:
            self.whole[self.hash.number(key)] = (key, ranks[key])
        self.memo = _Memo(self.encode_piece)

    def split(self, text: str) -> list[str]:
        if not self.may_be_disputed(text) or self.disputed.isdisjoint(text):
            return self.findall(text)
        out, at = [], 0
        for part in self.findall(text.translate(self.shadow)):  # as many code points as the text
            out.append(text[at : at + len(part)])
            at += len(part)
        return out

    def encode_piece(self, piece: bytes) -> list[int]:
        if (number := self.hash.number(piece)) >= 0:
            key, token = self.whole[number]
            if key == piece:
                return [token]
        return self._merge(piece)

    def _merge(self, piece: bytes) -> list[int]:
        """The lowest rank first, the leftmost of equals; spans are linked by their ends.

        A heap entry is one integer: rank, start and end of the joined span.
        """
        n, rank = len(piece), self.ranks.get
        shift = n.bit_length()
        low = (1 << shift) - 1
        end = list(range(1, n + 1))  # of the span that begins here; 0 where none does
        before = list(range(-1, n))  # start of the span that ends here
        heap = [(((r << shift) | i) << shift) | (i + 2) for i, r in enumerate(map(self.pairs.get, zip(piece, piece[1:]))) if r is not None]  # noqa: B905
        heapq.heapify(heap)
        while heap:
            entry = heapq.heappop(heap)
            e, i = entry & low, entry >> shift & low
            mid = end[i]
            if not mid or mid >= n or end[mid] != e:
                continue  # one of the two has been merged meanwhile
            end[i], end[mid] = e, 0
            if e < n:
                before[e] = i
                if (r := rank(piece[i : end[e]])) is not None:
                    heapq.heappush(heap, (((r << shift) | i) << shift) | end[e])
            if i and (r := rank(piece[(at := before[i]) : e])) is not None:
                heapq.heappush(heap, (((r << shift) | at) << shift) | e)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _disputed(ranks: dict[bytes, int]) -> dict[int, str]:
    """Code points that the two regex libraries class differently, with a stand-in of tiktoken's class.

    Their Unicode versions differ, so a letter of the newer one may be no letter
    yet in the other. The pattern splits by nothing but these three classes.
    """
    every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    own, theirs = {}, {}
    for name, stand_in in ((r"\p{L}", "a"), (r"\p{N}", "1"), (r"\s", " ")):
        found = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=ranks, special_tokens={})
        theirs |= dict.fromkeys(found.decode(found.encode_ordinary(every)), stand_in)
        own |= dict.fromkeys(regex.findall(name, every), stand_in)
    return {ord(c): theirs.get(c, "!") for c in own.keys() | theirs.keys() if own.get(c) != theirs.get(c)}


class _Memo(dict):
    """Ids of pre-tokens met lately: two generations, the older of which goes when the younger is full."""

    def __init__(self, encode):
        self.encode, self.older, self.bytes = encode, {}, 0

    def __missing__(self, piece: str) -> bytes:
        out = self.older.get(piece)
        if out is None:
            ids = self.encode(piece.encode())
            out = struct.pack(f"<{len(ids)}I", *ids)
            if len(piece) > MEMO_CHARS:
                return out
        if len(self) >= MEMO_LIMIT or self.bytes >= MEMO_BYTES:
            self.older = dict(self)
            self.clear()
            self.bytes = 0
        self.bytes += len(piece) + len(out)
        self[piece] = out
        return out


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return Codec(ranks, pattern)


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, ids (binary, unsigned 32-bit little endian), decoded (binary, from the ids)."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(at, OUT_ROWS)
                ids = [own.encode(t.as_py()) for t in part.column(1)]
                cols = [part.column(0), pa.array(ids, pa.binary()), pa.array(list(map(own.decode, ids)), pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "ids", "decoded"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, ids binary, decoded binary").withColumnRenamed("key", key)


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """Number of tokens and the SHA-256 of ids and of decoded bytes, for each row of encode()."""
    return encoded.select(
        key,
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
