"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence has a probability of being toxic,
logistic in the features of its distinct words; a document is toxic if any
sentence is (noisy-or), so document labels train the sentence scores, and the
trained scores point at the offending sentences.

A word's features are the word itself and its beginnings, so that inflected
forms share a stem. The vocabulary is counted in Spark over all words of the
training sample and holds every feature whose document frequencies in the two
classes differ by more than chance, by their likelihood ratio; equal texts count
once, or the words of a text with many copies would fill it. It grows with the
sample and has no other bound. The likelihood of the noisy-or is then climbed on
the sample's sparse sentences, from half the log odds.

Defined results: a null text is the empty text, whose one sentence is empty; an
empty text has the score of that sentence; without labels of both kinds every
score is the prior (0 without labels); null labels are not used; repeated rows
are scored row by row; texts are read whole, however long; an empty table gives
an empty table; columns beside key and text are not looked at and stay, but
those that are named as the results are replaced by them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lectern.llm.common import cut
from lectern.llm.quality import labelled_sample

#: Labelled rows that the model is fitted on, at most; chosen by a hash of the key.
SAMPLE_ROWS = 15_000
#: Features in the sentences of those rows, at most: in order of the hash, rows beyond it are left out of the fit.
SAMPLE_MARKS = 5_000_000
#: Documents of the sample a feature must be in, and its likelihood ratio statistic: below either it can't be told from chance.
LEAST_DOCS, LEAST_G = 5, 25.0
#: Log odds from which the climb starts, at most.
MOST_ODDS = 6.0
#: Lengths of the word beginnings that are features.
STEMS = (4, 5, 6, 7, 8)
#: Climb: steps, their length (a fifth of it in the last part), shrinkage, first bias.
STEPS, RATE, RIDGE, BIAS = 600, 0.05, 1e-5, -5.0

WORDS = re.compile(r"[^\W\d_]+")
SENTENCES = re.compile(r"[^.!?\n]*(?:[.!?]+|\n|$)")


def features(words: set[str]) -> list[str]:
    """Of distinct words; a beginning comes once for each word that has it."""
    return [*words, *("^" + w[:k] for k in STEMS for w in words if len(w) >= k)]


def roots_of(known: Iterable[str]) -> frozenset[str]:
    """The first letters of these features: a word that begins otherwise has none of them."""
    return frozenset(f.removeprefix("^")[: STEMS[0]] for f in known)


def rooted(words: set[str], roots: frozenset[str]) -> set[str]:
    return {w for w in words if w[: STEMS[0]] in roots}


@dataclass(frozen=True)
class BagModel:
    """A sentence's logit is bias + the weights of the features of its distinct words."""

    bias: float = -30.0
    weights: dict[str, float] = field(default_factory=dict)
    roots: frozenset[str] = frozenset()  # of the features, see roots_of

    def sentences(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, probability) of each sentence with a feature of the vocabulary."""
        found, text = [], text or ""
        if not rooted({*WORDS.findall(text.lower())}, self.roots):
            return found
        for m in SENTENCES.finditer(text):
            known = [self.weights[f] for f in features(rooted({*WORDS.findall(m[0].lower())}, self.roots)) if f in self.weights]
            if known:
                found.append((m.start(), m.end(), float(_sigmoid(self.bias + math.fsum(known)))))
        return found

    def noisy_or(self, sentences: list[tuple[int, int, float]]) -> float:
        """Score of a document with these sentences; the bias is one draw for the whole document."""
        keep = 1 - _sigmoid(self.bias)
        for _, _, p in sentences:
            keep *= 1 - p
        return float(1 - keep)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def vocabulary(sample: DataFrame, sizes: dict[int, int]) -> list[tuple[str, float]]:
    """Features of the sample (__text, __label) that are more frequent in toxic documents, and their log odds; the most telling first."""

    def run(batches):
        for batch in batches:
            for text, label in zip(*batch.columns, strict=True):  # a batch for each text, as a batch of texts has no bound
                own = pa.array({*features({*WORDS.findall((text.as_py() or "").lower())})}, pa.string())
                yield pa.RecordBatch.from_arrays([own, pa.array([label.as_py()] * len(own), pa.int32())], names=["word", "label"])

    n1, n0 = float(sizes.get(1, 0)), float(sizes.get(0, 0))
    a, b, every = F.col("a"), F.col("b"), n1 + n0
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    rest = every - a - b
    ratio = 2 * (part(a, (a + b) * (n1 / every)) + part(b, (a + b) * (n0 / every)) + part(n1 - a, rest * (n1 / every)) + part(n0 - b, rest * (n0 / every)))
    odds = F.log((a + 0.5) / (n1 - a + 0.5)) - F.log((b + 0.5) / (n0 - b + 0.5))
    rows = (
        sample.select("__text", F.col("__label").cast("int"))
        .mapInArrow(run, "word string, label int")
        .groupBy("word")
        .agg(F.sum("label").cast("double").alias("a"), F.sum(1 - F.col("label")).cast("double").alias("b"))
        .where((a + b >= LEAST_DOCS) & (a * n0 > b * n1))
        .select("word", odds.alias("odds"), ratio.alias("g"))
        .where(F.col("g") >= LEAST_G)
        .orderBy(F.desc("g"), "word")
        .collect()
    )
    return [(r["word"], r["odds"]) for r in rows]


def fit(docs: DataFrame, labels: DataFrame, use: Column, key: str = "doc_id", text: str = "text", label: str = "toxic") -> BagModel:
    """Fit on the labelled documents that `use`, a condition on labels, lets through."""
    picked = labelled_sample(labels, key, label, use, SAMPLE_ROWS)
    sample = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text")).join(F.broadcast(picked), "__key")
    # of equal texts the first key stays; the sample's texts are few enough to keep
    first = sample.groupBy(F.xxhash64("__text").alias("__h"), "__label").agg(F.min(F.struct("__key", "__text")).alias("x"))
    sample = cut(first.select("x.__key", "x.__text", "__label"))
    sizes = {r["__label"]: r["count"] for r in sample.groupBy("__label").count().collect()}
    if len(sizes) < 2:
        return BagModel(bias=0.0 if sizes.get(1) else -30.0)
    known = vocabulary(sample, sizes)
    number = {w: i for i, (w, _) in enumerate(known)}
    roots = roots_of(number)

    def run(batches):
        for batch in batches:
            bags, times = [], []
            for t in batch.column(1):
                parts = (features(rooted({*WORDS.findall(m[0].lower())}, roots)) for m in SENTENCES.finditer(t.as_py() or ""))
                own = (tuple(sorted(number[f] for f in part if f in number)) for part in parts)
                bag = sorted(Counter(x for x in own if x).items())  # equal sentences count together
                bags.append([x for x, _ in bag])
                times.append([n for _, n in bag])
            found = [pa.array(bags, pa.list_(pa.list_(pa.int32()))), pa.array(times, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *found], names=["k", "label", "bags", "times"])

    kind = sample.schema["__key"].dataType.simpleString()
    rows = sample.select("__key", "__text", F.col("__label").cast("int")).mapInArrow(run, f"k {kind}, label int, bags array<array<int>>, times array<bigint>")
    rows = cut(rows.withColumn("n", F.aggregate("bags", F.lit(1).cast("long"), lambda a, x: a + F.size(x))))
    upto = F.sum("n").over(Window.orderBy(F.xxhash64("k"), "k"))  # one window, of SAMPLE_ROWS small rows at most
    kept = rows.select("k", "n").select("k", "n", upto.alias("upto")).where(F.col("upto") - F.col("n") < SAMPLE_MARKS).select("k")
    got = sorted(rows.join(F.broadcast(kept), "k", "left_semi").select("k", "label", "bags", "times").collect(), key=lambda r: r["k"])
    return _climb([dict(zip(map(tuple, r["bags"]), r["times"], strict=True)) for r in got], np.array([r["label"] for r in got], float), known)


def _climb(bags: list[dict[tuple, int]], y: np.ndarray, known: list[tuple[str, float]]) -> BagModel:
    """Maximise the noisy-or likelihood by gradient steps of adapted size; a bag has its sentences' features and how often each comes."""
    doc, sent, at, col = [], 0, [], []
    times = []
    for i, bag in enumerate(bags):
        for items, count in bag.items():
            doc.append(i)
            times.append(count)
            at += [sent] * len(items)
            col += items
            sent += 1
    doc_a, at_a, col_a, times_a = np.array(doc, int), np.array(at, int), np.array(col, int), np.array(times, float)
    theta = np.array([*(min(odds, MOST_ODDS) / 2 for _, odds in known), BIAS])
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, STEPS + 1):
        w, b = theta[:-1], theta[-1]
        p, lone = _sigmoid(b + np.bincount(at_a, w[col_a], sent)), _sigmoid(b)
        # log of the chance that no sentence is toxic, and what a step in each logit does to it
        keep = np.log1p(-lone) + np.bincount(doc_a, times_a * np.log1p(-np.minimum(p, 1 - 1e-12)), len(y))
        toxic = -np.expm1(np.minimum(keep, -1e-12))
        pull = np.where(y > 0, (1 - toxic) / np.maximum(toxic, 1e-12), -1.0)
        step = pull[doc_a] * times_a * p
        grad = np.append(np.bincount(col_a, step[at_a], len(known)), step.sum() + (pull * lone).sum()) / len(y)
        grad[:-1] -= RIDGE * w
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        rate = RATE if k < 0.6 * STEPS else RATE / 5
        theta = theta + rate * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.999**k)) + 1e-9)
    weights = {word: float(x) for (word, _), x in zip(known, theta, strict=False)}
    return BagModel(float(theta[-1]), weights, roots_of(weights))


def score(docs: DataFrame, model: BagModel, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the score of each text and its offending sentences (start, end, probability of 0.5 and more)."""
    spans = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType())]))
    stays = [i for i, c in enumerate(docs.columns) if c.lower() not in (out.lower(), "offending")]
    schema = T.StructType([*(docs.schema.fields[i] for i in stays), T.StructField(out, T.DoubleType()), T.StructField("offending", spans)])
    at = docs.columns.index(text)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches):
        for batch in batches:
            scores, found = [], []
            for t in batch.column(at):
                sentences = model.sentences(t.as_py())
                scores.append(model.noisy_or(sentences))
                found.append([{"start": a, "end": b, "p": p} for a, b, p in sentences if p >= 0.5])
            names = [*(batch.schema.names[i] for i in stays), out, "offending"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in stays), pa.array(scores, pa.float64()), pa.array(found, kind)], names=names)

    return docs.mapInArrow(run, schema)
