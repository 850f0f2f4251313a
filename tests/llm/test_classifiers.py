import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from lectern.llm import quality, toxicity
from lectern.llm.common import crc_mod
from lectern.llm.queries import QUERIES
from lectern.llm.textstats import NAMES, stats

FOLDER = "/root/testdata/sf0.01"


def labelled(spark):
    return spark.read.parquet(f"{FOLDER}/labels.parquet")


def test_quality_on_held_out_rows(spark):
    rows = QUERIES["op9_quality"](spark, FOLDER).join(labelled(spark), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 50 and sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)


def test_toxicity_on_held_out_rows(spark):
    rows = QUERIES["op10_toxicity"](spark, FOLDER).join(labelled(spark), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 40 and sum(r.predicted == r.toxic for r in held) >= 0.9 * len(held)
    assert sum(r.predicted for r in held if not r.toxic) <= 0.03 * len(held)


def test_vocabulary_grows_with_the_sample(spark):
    """A thousand telling words are a thousand features; what is as frequent in both classes is none."""
    words = lambda i, n: [f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{'xyz'[k // 676]}q" for k in range(i, 1000, n)]
    docs = [(i, i % 2, " ".join([*(words(i // 2 % 10, 10) if i % 2 else []), "plain", "usual"])) for i in range(600)]
    sample = spark.createDataFrame(docs, "__key long, __label int, __text string")
    found = {w for w, _ in toxicity.vocabulary(sample, {0: 300, 1: 300})}
    assert {w for k in range(10) for w in words(k, 10)} <= found and found.isdisjoint({"plain", "usual"})


def test_marks_bound_the_fit_only(spark, monkeypatch):
    docs = [(i, "calm words here. nasty stuff!" if i % 2 else "calm words here.") for i in range(100)]
    docs = [(i, f"{t} t{i}") for i, t in docs]
    df, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "SAMPLE_MARKS", 200)
    rows = toxicity.score(df, toxicity.fit(df, known, F.lit(True))).collect()
    assert len(rows) == 100 and all((r.score >= 0.5) == bool(r.doc_id % 2) for r in rows)


def test_rules_in_spark_score_as_in_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, len(NAMES)))
    y = ((x[:, 1] > 0.2) & (x[:, 4] < 0.5)).astype(float)
    model = quality.fit_rules(x, y)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x[:50])], "i int, s array<double>")
    got = np.array([r.p for r in df.select("i", model.score(F.col("s")).alias("p")).orderBy("i").collect()])
    z = model.bias + sum(r.weight * r.holds(x[:50]) for r in model.rules)
    assert np.allclose(got, 1 / (1 + np.exp(-z))) and ((got >= 0.5) == (y[:50] > 0)).mean() > 0.95


def test_lasso_is_at_its_optimum():
    rng = np.random.default_rng(1)
    a = (rng.random((300, 12)) < 0.4).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(-(2 * a[:, 0] - 1.5 * a[:, 1])))).astype(float)
    w, b = quality._lasso(a, y, 0.0)
    grad = a.T @ (1 / (1 + np.exp(-(a @ w + b))) - y) / 300
    assert np.abs(grad[w == 0]).max(initial=0) <= quality.LASSO + 1e-3
    assert np.abs(grad + quality.LASSO * np.sign(w))[w != 0].max() < 1e-3


def test_offending_sentences_are_located(spark):
    rng = random.Random(5)
    calm = lambda: " ".join(f"w{rng.randrange(60)}" for _ in range(8))
    docs, labels = [], []
    for i in range(300):
        toxic = i % 3 == 0
        parts = [calm() for _ in range(4)]
        if toxic:
            parts[i % 4] = f"{calm()} nasty{rng.choice(['', 'er'])} {calm()}"
        docs.append((i, ". ".join(parts) + "."))
        labels.append((i, int(toxic)))
    df, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(df, known, F.lit(True))
    rows = toxicity.score(df, model).collect()
    assert all((r.score >= 0.5) == (r.doc_id % 3 == 0) for r in rows)
    assert all("nasty" in r.text[s.start : s.end] for r in rows for s in r.offending)
    assert sum(len(r.offending) for r in rows) == 100


def test_odd_rows(spark, odd_docs, no_docs):
    some = spark.createDataFrame([(i, i % 2, i % 2) for i in range(9)] + [(0, None, None), (None, 1, 1), (77, 1, 1)], "doc_id long, quality int, toxic int")
    clashing = odd_docs.withColumns({"offending": F.lit("x"), "__stats": F.lit("own"), "__score": F.lit(7.0)})
    for mod, label, empty in ((quality, "quality", quality.RuleModel(0.0, ())), (toxicity, "toxic", None)):
        for labels in (some, some.where("false"), some.where(f"{label} = 1")):
            model = mod.fit(odd_docs, labels, crc_mod("doc_id", 3) != 1, label=label)
            found = mod.score(clashing, model)
            rows = found.collect()
            assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
            assert sorted(found.columns) == sorted({*clashing.columns, *found.columns}) and {r["__stats"] for r in rows} == {"own"}
        assert mod.fit(no_docs, some, F.lit(True), label=label) is not None
        assert mod.score(no_docs, model).count() == 0
    assert quality.fit(odd_docs, some.where("false"), F.lit(True)) == quality.RuleModel(0.0, ())
    assert all(np.isfinite(stats(t)).all() for t in (None, "", " ", "\x00é" * 9))
