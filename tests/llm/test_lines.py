import random
import re

from lectern.llm import lines
from lectern.llm.common import WORD


def brute(docs, least):
    """Delete every line in a run of enough words that begins at an earlier place too."""
    docs = sorted(docs)
    split = [t.split("\n") if t is not None else [] for _, t in docs]
    size = [[len(re.findall(WORD, x)) for x in ls] for ls in split]
    gone = [[False] * len(ls) for ls in split]
    places = [(d, i) for d, ls in enumerate(split) for i in range(len(ls))]
    for n, (d, i) in enumerate(places):
        best = 0
        for e, j in places[:n]:
            k = 0
            while i + k < len(split[d]) and j + k < len(split[e]) and split[d][i + k] == split[e][j + k]:
                k += 1
            best = max(best, k)
        if best and sum(size[d][i : i + best]) >= least:
            gone[d][i : i + best] = [True] * best
    return {key: None if t is None else "\n".join(x for x, g in zip(ls, gs) if not g) for (key, t), ls, gs in zip(docs, split, gone)}


def run(spark, docs, least):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return {r.doc_id: r.text for r in lines.dedup(df, least_words=least).collect()}


def test_against_brute_force(spark):
    rng = random.Random(11)
    for least in (1, 4):
        pool = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 3))) for _ in range(6)]
        docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 9)))) for i in range(12)]
        docs += [(20 + i, docs[i % 3][1] + "\nnew " * (i % 2)) for i in range(4)]
        assert run(spark, docs, least) == brute(docs, least)


def test_a_passage_goes_and_clean_text_stays(spark):
    passage = "\n".join(f"w{i} " * 20 for i in range(3)).strip()
    docs = [(1, f"head\n{passage}\ntail"), (2, f"other\n{passage}\nend"), (3, "head\nshort\ntail"), (4, passage)]
    got = run(spark, docs, 50)
    assert got == {1: docs[0][1], 2: "other\nend", 3: docs[2][1], 4: ""}


def test_one_line_over_and_over(spark):
    line = "x " * 60
    assert run(spark, [(1, "\n".join([line] * 40))], 50) == {1: line}


def test_odd_rows(spark, odd_docs, no_docs):
    before = {(r.doc_id, r.text) for r in odd_docs.collect()}
    rows = lines.dedup(odd_docs, removed="n").collect()
    assert {(r.doc_id, r.text) for r in rows} == before and len(rows) == odd_docs.count()
    assert rows[0].asDict().keys() == {"doc_id", "text", "source", "score", "key", "n"}
    assert lines.dedup(no_docs).count() == 0


def test_columns_keep_their_names_and_values(spark):
    line = "x " * 60
    docs = spark.createDataFrame([(1, line, 5, 6, "k", 9), (2, line, 7, 8, "l", 9)], "doc_id long, text string, __u1 long, __U2 long, __keep string, n int")
    rows = sorted(lines.dedup(docs, removed="n").collect())
    assert [(r.doc_id, r.text, r["__u1"], r["__U2"], r["__keep"], r.n) for r in rows] == [(1, line, 5, 6, "k", 0), (2, "", 7, 8, "l", 1)]


def test_jobs_do_not_grow_with_the_repeat(spark):
    context = spark.sparkContext

    def jobs(n):
        text = "\n".join("" if i % 9 else f"line {i}" for i in range(n))
        context.setJobGroup(f"repeat {n}", "")
        got = run(spark, [(1, text), (2, f"own\n{text}\nend")], 4)
        context.setLocalProperty("spark.jobGroup.id", None)
        assert got == brute([(1, text), (2, f"own\n{text}\nend")], 4)
        return len(context.statusTracker().getJobIdsForGroup(f"repeat {n}"))

    assert jobs(100) <= jobs(30) + 2
