import random

import numpy as np
import xxhash

from pyspark.sql import functions as F

from lectern.llm import simhash
from lectern.llm.common import rejoin
from lectern.llm.graph import components
from lectern.llm.queries import QUERIES


def brute(fps, budget):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = sorted(root)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= budget:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def near(rng, groups):
    out = set()
    for _ in range(groups):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 4, 30])):
            y = x
            for _ in range(rng.randint(0, 4)):
                y ^= 1 << rng.randrange(64)
            out.add(y)
            x = rng.choice([x, y])
    return [x - 2**64 if x >= 2**63 else x for x in out | {0, 2**64 - 1}]


def test_links_against_brute_force(spark):
    rng = random.Random(5)
    fps = near(rng, 25)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    for budget, subtrie, task in ((2, 20_000, 16_000), (2, 6, 10), (0, 20_000, 16_000), (4, 8, 50)):
        edges = simhash.links(df, budget, subtrie, task)
        got = {r.node: r.root for r in components(edges).collect()}
        assert {f: got.get(f, f) for f in fps} == brute(fps, budget), (budget, subtrie)


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, x) for x in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, **{x: 100 for x in range(100, 160)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_hub_is_split(spark):
    """A frequent key of a joined aggregate does not stay in one task."""
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = spark.range(400_000, numPartitions=8).selectExpr("if(id % 10 = 0, id, 7) as x", "hash(id) as y")
        joined = rejoin(rows, rows.groupBy("x").agg(F.min("y").alias("m")), ["x"])
        sizes = joined.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
        assert max(r["count"] for r in sizes) < 0.8 * rows.where("x = 7").count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_fingerprint_by_hand():
    text = "A b C\td é"
    shingles = ["a b c", "b c d", "c d é"]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    want = sum(1 << i for i in range(64) if sum(x >> i & 1 for x in h) * 2 > 3)
    assert simhash.fingerprint(text, 3) % 2**64 == want
    assert simhash.fingerprint(None, 3) == simhash.fingerprint(" \n", 3) == 0
    assert simhash.fingerprint("É b", 3) % 2**64 == xxhash.xxh64_intdigest("É b".encode(), 42)


def test_near_duplicates(spark, odd_docs, no_docs):
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(odd_docs, 3, 2).collect()}
    assert got[0] == got[1] == got[2] == 0 and got[3] == 3 and got[8] == 8 and len(got) == 10
    assert simhash.near_duplicates(no_docs, 3, 2).count() == 0


def test_registered_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    fps = {d: simhash.fingerprint(t, 3) for d, t in docs.items()}
    root = brute(set(fps.values()), 2)
    least = {}
    for d, f in sorted(fps.items()):
        least.setdefault(root[f], d)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op3_simhash"](spark, folder).collect()}
    assert got == {d: (f"{f % 2**64:016x}", least[root[f]]) for d, f in fps.items()}


def test_similar_documents_against_brute_force(spark):
    rng = random.Random(9)
    base = [[f"w{rng.randrange(500)}" for _ in range(rng.randint(30, 120))] for _ in range(25)]
    docs = []
    for w in base:
        for _ in range(rng.choice([1, 3])):
            own = list(w)
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = f"new{rng.randrange(99)}"
            docs.append((len(docs), " ".join(own)))
    docs += [(len(docs), docs[0][1]), (len(docs) + 1, None), (len(docs) + 2, "")]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    root = {d: d for d, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(docs):
        for b, t in docs[:i]:
            if simhash.similarity(s, t, 5) >= 0.8:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert got == {d: find(d) for d, _ in docs}


def test_sampled_fingerprints():
    h = np.sort(np.array([xxhash.xxh64_intdigest(bytes([i])) for i in range(50)], np.uint64))
    assert simhash.sampled(h) == simhash.sampled(h.copy()) and len(set(simhash.sampled(h))) > 5
    assert simhash.sampled(h[:0]) == [0] * simhash.SAMPLES


def test_groups_whose_first_document_is_not_the_hub(spark):
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]

    def variant(of):
        new = list(of)
        for at in range(5 + rng.randrange(14), 190, 28):
            new[at] = f"n{rng.randrange(10**9)}"
        return new

    copies = [variant(base) for _ in range(150)]
    docs = [(i, " ".join(c)) for i, c in enumerate(copies)] + [(1000, " ".join(base))]
    assert all(simhash.similarity(t, docs[-1][1], 5) >= 0.8 for _, t in docs)
    assert simhash.similarity(docs[0][1], docs[1][1], 5) < 0.8
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for blocks in ({}, {"block_rows": 40}):
        got = {r.doc_id: r.component_id for r in simhash.similar_documents(frame, **blocks).collect()}
        assert got == dict.fromkeys([i for i, _ in docs], 0)


def test_sketch_differs_in_no_more_than_the_sets():
    rng = random.Random(12)
    for _ in range(200):
        x, y = ({rng.randrange(2**64) for _ in range(rng.randrange(300))} for _ in range(2))
        y |= set(list(x)[: rng.randrange(300)])
        a, b = (np.frombuffer(simhash.sketch(np.array(sorted(s), np.uint64)), np.uint64) for s in (x, y))
        assert np.bitwise_count(a ^ b).sum() <= len(x ^ y)


def test_links_between_later_fingerprints_of_a_family(spark, monkeypatch):
    """Of a chain of fingerprints only the later two have similar texts; no sample joins them."""
    rng = random.Random(13)
    first, second = ([f"w{rng.randrange(10**6)}" for _ in range(200)] for _ in range(2))
    third = [*second[:-1], "other"]
    docs = [(i, " ".join(words)) for i, words in enumerate((first, second, third))]
    prints = {docs[0][1]: 0b000, docs[1][1]: 0b111, docs[2][1]: 0b011}
    alone = {simhash.shingle_set(t, 5).tobytes(): 100 * i for i, t in docs}
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)

    def signed(found, words):
        marks = {r.key: r.h for r in found.collect()}
        rows = [(i, marks[i], i, prints[t], [alone[simhash.shingle_set(t, 5).tobytes()] + k for k in range(simhash.SAMPLES)], len(h := simhash.shingle_set(t, 5)), simhash.sketch(h)) for i, t in docs]
        return spark.createDataFrame(rows, "key long, h long, whole long, fp long, bands array<long>, size long, sketch binary")

    monkeypatch.setattr(simhash, "_signed", signed)
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(frame).collect()}
    assert got == {0: 0, 1: 1, 2: 1}
