"""Corpus pipeline: stages that each read what the one before has kept.

quality drops documents the rule ensemble rejects; lines deletes later copies
of repeated line runs, and documents nothing is left of; copies keeps one
document of each near-duplicate group; mix takes documents as often as the
target weights ask; tokens encodes and decodes what was taken.

Defined results, beside those of the operators: rows without a doc_id pass the
copies stage, as no group can name them; rows of one doc_id and different texts
are documents of their own there, rows of one doc_id and text are one, of which
the first by its other columns stays; of a group the smallest doc_id stays, and
of its texts the first by a hash. Null and empty texts are one group there and
have no words for the mix. Empty tables pass every stage; texts are read whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm import bpe, lines, mixing, quality, simhash
from lectern.llm.common import crc_mod, cut, free_name, table
from lectern.llm.queries import VOCABULARY
from lectern.session import reachable


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    reachable(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 3) != 1)
    score = free_name("__score", docs.columns)
    return quality.score(docs, model, out=score).where(F.col(score) >= 0.5).select(*docs.columns)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = free_name("__removed", docs.columns)
    rest, removed = lines.dedup(docs, removed=name), F.col(name)
    n_chars = F.when(removed > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return rest.where(F.col("text").isNull() | (removed == 0) | (F.col("text") != "")).withColumn("n_chars", n_chars).select(*docs.columns)


def copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    reachable(spark)
    mark, place = free_name("__mark", docs.columns), free_name("__place", docs.columns)
    found = simhash.similar_documents(docs, words=5, least=0.8)
    first = found.where("doc_id = component_id and text_hash = component_hash").select("doc_id", F.col("text_hash").alias(mark)).distinct()
    others = [F.col(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()]
    own = F.row_number().over(Window.partitionBy("doc_id", mark).orderBy(*others))
    named = docs.where("doc_id is not null").withColumn(mark, F.xxhash64("text"))
    kept = named.join(first, ["doc_id", mark], "left_semi").withColumn(place, own).where(F.col(place) == 1)
    return kept.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    reachable(spark)
    return bpe.digests(bpe.encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN))


STAGES = [
    ("quality", quality_stage),
    ("lines", lines_stage),
    ("copies", copies_stage),
    ("mix", mix_stage),
    ("tokens", tokens_stage),
]

#: The classifier, the fingerprints and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are materialised, as later ones read them several times."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
