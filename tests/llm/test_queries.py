"""All queries of the subpackage on small tables, and the pipeline stage by stage."""

import random

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import bpe, simhash
from lectern.llm.queries import ORACLES, QUERIES, VOCABULARY
from tests.compare import connect, spark_rows, sql_rows
from tests.llm.test_lines import brute

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [*ORACLES])
def test_against_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, FOLDER)) == sql_rows(connect(FOLDER), ORACLES[name])


def test_one_query_for_each_operator():
    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 14)] == [1] * 13
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "lines", "copies", "mix", "tokens"]


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept[-1], FOLDER)
        out.write.parquet(str(tmp_path / name))
        kept.append(spark.read.parquet(str(tmp_path / name)))
        if name != "tokens":
            assert kept[-1].columns == docs.columns
    before, good, lined, single, mixed, tokens = kept
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    ids = lambda df: [r.doc_id for r in df.select("doc_id").collect()]
    agree = [(d in set(ids(good))) == bool(labels[d]) for d in ids(before) if d in labels]
    assert sum(agree) >= 0.9 * len(agree)
    texts = {r.doc_id: r.text for r in good.collect()}
    want = {d: t for d, t in brute(list(texts.items()), 50).items() if t or not texts[d]}
    assert {r.doc_id: r.text for r in lined.collect()} == want
    assert all(r.n_chars == len(r.text) for r in lined.collect())
    rest = sorted(ids(single))
    assert len(rest) == len(set(rest)) and not any(simhash.similarity(want[a], want[b], 5) >= 0.8 for i, a in enumerate(rest) for b in rest[:i])
    near = {d for d in want if d not in set(rest)}
    assert all(any(simhash.similarity(want[d], want[e], 5) >= 0.8 for e in want if e != d) for d in near)
    encoder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.codec(P.path(VOCABULARY), P.PATTERN).ranks, special_tokens={})
    counts = {d: len(encoder.encode_ordinary(want[d])) for d in rest}
    assert sorted((r.doc_id, r.n_tokens) for r in tokens.collect()) == sorted((d, counts[d]) for d in ids(mixed))


def test_copies_of_repeated_ids(spark):
    say = lambda seed: " ".join(f"w{random.Random(seed).randrange(10**6) + i}" for i in range(60))
    rows = [(1, say(1), "en", "b", 5), (1, say(2), "en", "a", 5), (1, say(1), "en", "a", 5), (2, say(2), "en", "a", 5), (-3, say(1) + " x", "en", "c", 6), (None, say(1), "en", "a", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    got = corpus_pipeline.copies_stage(spark, docs.withColumn("__name", F.lit(0)), FOLDER).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in got) == sorted([(False, -3, rows[4][1]), (False, 1, say(2)), (True, 0, say(1))])


def test_pipeline_takes_odd_rows(spark, odd_docs):
    docs = odd_docs.select("doc_id", "text", "source").selectExpr("doc_id", "text", "'en' as lang", "source", "cast(length(text) as long) as n_chars")
    for docs_ in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs_, FOLDER)
            if name != "tokens":
                assert out.columns == docs.columns
            assert out.count() <= 3 * max(1, docs.count())
