import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import bpe
from lectern.llm.queries import QUERIES

PATH = P.path("byte_bpe_multi_50k.tiktoken")
CODEC = bpe.codec(PATH, P.PATTERN)
TRUE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})


def ids(text):
    return np.frombuffer(CODEC.encode(text), "<u4").tolist()


@settings(max_examples=400, deadline=None)
@given(st.text() | st.text(alphabet="ab '\n\tthe1é漢", max_size=80))
def test_encodes_as_tiktoken(text):
    text = text.encode("utf-8", "ignore").decode()
    assert ids(text) == TRUE.encode_ordinary(text)
    assert CODEC.decode(CODEC.encode(text)) == text.encode()


def test_letters_of_any_unicode_version():
    for cp in [*range(0x250), *range(0x540, 0x560), 0x10EC5, 0x16EA0, 0x323B0]:
        text = f"x{chr(cp)}1 {chr(cp)}a"
        assert ids(text) == TRUE.encode_ordinary(text)


def test_long_pieces():
    text = "ab" * 20_000 + "!" * 5_000
    assert ids(text) == TRUE.encode_ordinary(text)


def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(3000)]
    own = bpe.PerfectHash(keys)
    assert sorted(map(own.number, keys)) == list(range(3000)) and own.size == 3000
    assert bpe.PerfectHash([]).number(b"x") == -1


def test_memo_generations(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_LIMIT", 4)
    codec = bpe.Codec(CODEC.ranks, P.PATTERN)
    for text in ("a bb ccc dddd eeeee ffffff a bb", "zz a yy bb", "a bb ccc"):
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == TRUE.encode_ordinary(text)
    assert len(codec.memo) <= 4


def test_memo_is_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_BYTES", 100)
    codec = bpe.Codec(CODEC.ranks, P.PATTERN)
    for text in ("qqqqzzzz xxxxwwww jjjjkkkk " * 3, "long" * 40, " ".join(f"zq{i}" for i in range(90))):
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == TRUE.encode_ordinary(text)
        assert codec.memo.bytes <= 100 + 5 * bpe.MEMO_CHARS and max(map(len, codec.memo)) <= bpe.MEMO_CHARS


def test_keys_of_any_type(spark):
    for kind in ("smallint", "decimal(9,2)", "binary", "string", "array<int>", "struct<a:int,b:string>"):
        value = {"array<int>": "array(1)", "struct<a:int,b:string>": "named_struct('a', 1, 'b', 'x')"}.get(kind, f"cast('1' as {kind})")
        df = spark.range(2).selectExpr(f"if(id = 0, {value}, null) as doc_id", "'ab cd' as text")
        out = bpe.encode(df, PATH, P.PATTERN)
        assert out.schema["doc_id"].dataType.simpleString() == df.schema["doc_id"].dataType.simpleString() and out.count() == 2


def test_registered_query_against_the_library(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op6_byte_bpe"](spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids = np.array(TRUE.encode_ordinary(texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_odd_rows(odd_docs, no_docs):
    rows = bpe.digests(bpe.encode(odd_docs, PATH, P.PATTERN)).collect()
    assert len(rows) == odd_docs.count()
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    for r in rows:
        text = texts[r.doc_id] or ""
        assert r.n_tokens == len(TRUE.encode_ordinary(text))
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode(no_docs, PATH, P.PATTERN).count() == 0
