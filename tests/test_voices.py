"""Windows, strategies and the end of a talk; whole scenes are in test_scenes."""

import numpy as np
import pytest

from lectern.config import Knobs
from lectern.functions.encoders import spectral_encoder
from lectern.operators import revlog, speakers
from lectern.plans import voices
from lectern.sources import scenes

K = Knobs()


def test_silence_is_kept_out_of_windows():
    encoder = spectral_encoder()
    speech = scenes.voice(scenes.CAST["Мария"], 1.0, np.random.default_rng(3)).astype(float)
    padded = np.concatenate([np.zeros(16_000), speech, np.zeros(16_000)])
    knobs = Knobs(window=3.0, hop=3.0)
    (_, _, v), (_, _, clean) = *voices.windowed(padded, 0.0, encoder, knobs), *voices.windowed(speech, 0.0, encoder, knobs)
    assert np.dot(v, clean) >= 0.95
    assert voices.windowed(np.zeros(16_000), 0.0, encoder, K) == []


def test_level_does_not_matter_to_the_encoder():
    encoder, rng = spectral_encoder(), np.random.default_rng(1)
    pcm = scenes.voice(scenes.CAST["Иван"], 2.0, rng).astype(float)
    assert encoder(pcm) @ encoder(pcm * 10 ** (-18 / 20)) >= 0.999
    assert encoder(pcm[:1023]) is None


@pytest.fixture()
def vectors(spark):
    """Two voices; the first is heard as two until enough is known of it."""
    a, b = np.array([1.0, 0.0, 0.0]), np.array([0.0, 0.0, 1.0])
    turned = lambda deg: [float(np.cos(np.radians(deg))), float(np.sin(np.radians(deg))), 0.0]
    rows = [turned(0), turned(50), b.tolist(), *[turned(40 - i) for i in range(3)], *[turned(20 + i) for i in range(6)], a.tolist()]
    return spark.createDataFrame([("x", i + 1, v, 1.0) for i, v in enumerate(rows)], "talk string, sid long, v array<double>, weight double")


MERGING = Knobs(merge=0.8, merge_every=10)


def test_merges_come_out_and_mend_the_past(spark, vectors):
    merged = speakers.merges(vectors, MERGING).collect()
    assert [(r.sid, r.old in ("S1", "S2"), r.new in ("S1", "S2")) for r in merged] == [(10, True, True)]
    online = speakers.online_labels(vectors, MERGING).cache()
    late = speakers.late_labels(online, speakers.merges(vectors, MERGING), online.select("talk", "sid", "spk", "conf").where("false"))
    sent = spark.createDataFrame([("x", i + 1, 3, None) for i in range(13)], "talk string, sid long, rev long, spk string")
    changes = revlog.relabelled(sent, late)
    last = {r.sid: r for r in revlog.last_labels(sent, changes).collect()}
    gone = merged[0].old
    assert gone not in {r.spk for r in last.values()}
    again = [r for r in changes.collect() if r.src == "merge"]
    assert again and all(r.was == gone and r.spk == merged[0].new and r.rev == last[r.sid].rev for r in again)


def test_the_end_of_a_talk(spark, vectors):
    online = speakers.online_labels(vectors, MERGING).cache()
    refined = speakers.refined_labels(vectors, MERGING, limit=0.4)
    sent = spark.createDataFrame([("x", i + 1, 3, None) for i in range(12)], "talk string, sid long, rev long, spk string")
    segments = sent.selectExpr("*", "'some words that were said' as text", "sid * 1000 as t0", "sid * 1000 + 900 as t1")
    titles = spark.createDataFrame([("x", "Talk")], "talk string, title string")
    out = voices.finished(sent, segments, titles, online, speakers.merges(vectors, MERGING), refined)
    labels = {r.sid: r.spk for r in out["segments"].collect()}
    want = {r.sid: r.spk for r in refined.collect()}
    assert labels == {sid: want[sid] for sid in range(1, 13)}
    assert [tuple(r) for r in out["talks"].collect()] == [("x", "ended")]
    assert "R1" in out["summaries"].first().summary
    without = voices.finished(sent, segments, titles, online, speakers.merges(vectors, MERGING), None)
    assert {r.src for r in without["changes"].collect()} == {"online", "merge"}


def test_without_a_listener_nothing_is_labelled(spark):
    wins = spark.createDataFrame([("x", 1, [(0.0, 1.5, [1.0, 0.0])])], f"talk string, sid long, wins {voices.WINDOWS}")
    assert voices.labelled_by(wins, Knobs(diarize="off")).count() == 0
    assert voices.labelled_by(wins).first().raw == "S1"


def plain_linkage(v, weight, limit, tag):
    """The least distance of all pairs, looked up anew for each join."""
    groups = {i: [i] for i in range(len(v))}
    size, tags = dict(enumerate(weight)), dict(enumerate(tag))
    far = {(i, j): 1.0 - float(v[i] @ v[j]) for i in groups for j in groups if i < j}
    while True:
        open_ = [(d, i, j) for (i, j), d in far.items() if tags[i] < 0 or tags[j] < 0 or tags[i] == tags[j]]
        d, i, j = min(open_, default=(np.inf, 0, 0))
        if not d <= limit:
            break
        for k in groups:
            if k not in (i, j):
                a, b = ((min(x, k), max(x, k)) for x in (i, j))
                one, two = (far[p] if tags[x] < 0 or tags[k] < 0 or tags[x] == tags[k] else np.inf for x, p in ((i, a), (j, b)))
                far[a] = (size[i] * one + size[j] * two) / (size[i] + size[j])
        far = {p: d for p, d in far.items() if j not in p}
        groups[i] += groups.pop(j)
        size[i] += size[j]
        tags[i] = max(tags[i], tags[j])
    out = np.zeros(len(v), int)
    for number, i in enumerate(sorted(groups)):
        out[groups[i]] = number
    return out


def test_linkage_joins_the_nearest_pair_each_time():
    """Weights, tags that may not meet, and many equal distances."""
    rng = np.random.default_rng(5)
    for round_ in range(60):
        n = int(rng.integers(0, 26))
        v = rng.integers(-1, 2, (n, 3)).astype(float) if round_ % 2 else rng.normal(size=(n, 3))
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        weight, tag = rng.integers(1, 4, n).astype(float), rng.integers(-1, 3, n) if round_ % 3 else np.full(n, -1)
        for limit in (0.1, 0.5, 2.0):
            got = speakers.average_linkage(v, weight, limit, tag)
            assert got.tolist() == plain_linkage(v, weight, limit, tag).tolist(), (round_, limit)


def test_linkage_of_a_long_talk():
    """Twice the segments take about four times as long, not eight."""
    import time

    def took(n):
        v = np.random.default_rng(n).normal(size=(n, 16))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        began = time.process_time()
        speakers.average_linkage(v, np.ones(n), 0.9)
        return time.process_time() - began

    took(200)
    assert took(2_400) < 6.5 * max(took(1_200), 0.05)


def test_linkage_keeps_no_table_of_distances():
    import tracemalloc

    n = 4_000
    v = np.random.default_rng(3).normal(size=(n, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    tracemalloc.start()
    speakers.average_linkage(v, np.ones(n), 0.1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < n * n * 8 / 2


def test_pairs_over_small_shards(spark):
    rng = np.random.default_rng(8)
    rows = [(t, i, int(rng.integers(0, 3)) if i % 7 else None, None if i == 5 else rng.normal(size=4).tolist()) for t in (0, 1) for i in range(t, 40, 2)]
    df = spark.createDataFrame(rows, "talk long, id long, label long, v array<double>")
    known = {(t, i): (la, v) for t, i, la, v in rows}
    cos = {(t, a, b): None if known[t, a][1] is None or known[t, b][1] is None else float(np.dot(known[t, a][1], known[t, b][1])) for t, a in known for u, b in known if t == u and a < b}
    got = {(r.talk, r.a, r.b): r.cos for r in speakers.pair_cosines(df, ["talk"], shard_rows=3).collect()}
    assert got.keys() == cos.keys() and all((got[k] is None) == (c is None) and (c is None or abs(got[k] - c) < 1e-12) for k, c in cos.items())
    near = {(r.talk, r.a, r.b) for r in speakers.pair_cosines(df, ["talk"], 0.3, shard_rows=3).collect()}
    assert near == {k for k, c in cos.items() if c is not None and c >= 0.3}
    ends = {r.same: (r.least, r.most, r.pairs) for r in speakers.cosine_range(df, ["talk"], shard_rows=3).collect()}
    want = {}
    for (t, a, b), c in cos.items():
        la, lb = known[t, a][0], known[t, b][0]
        want.setdefault(None if la is None or lb is None else la == lb, []).append(c)
    assert ends.keys() == want.keys()
    for same, cs in want.items():
        some = [c for c in cs if c is not None]
        assert ends[same][2] == len(cs) and abs(ends[same][0] - min(some)) < 1e-12 and abs(ends[same][1] - max(some)) < 1e-12
