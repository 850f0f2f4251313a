"""Operators against plain models and hand-made cases."""

import itertools
import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.config import Knobs, load
from lectern.functions import text as X
from lectern.functions import vectors as V
from lectern.operators import floor, pubsub, revlog, scoring, speakers, timeline, words
from lectern.operators.folds import run_fold
from lectern.plans import talks

K = Knobs()


def largest_overlap(overlap):
    """Over all mappings."""
    hyps, refs = sorted({h for h, _ in overlap}), sorted({r for _, r in overlap})
    slots = [*refs, *[None] * len(hyps)]
    return max(sum(overlap.get((h, r), 0) for h, r in zip(hyps, p, strict=False)) for p in itertools.permutations(slots, len(hyps)))


def test_knobs_ignore_unknown_keys():
    assert load('{"max_words": 7, "backend": "x"}').max_words == 7
    assert load("max_words: 9  # short\nbackend: y\n").max_words == 9
    assert load("") == Knobs()


def test_current_segments_follow_the_log(spark):
    rng = random.Random(4)
    log = [(1, i, rng.choice(["seg", "seg", "spk"]), rng.randrange(3), rng.randrange(6), f"x{i}", f"s{i}") for i in range(200)]
    model = {}
    for _, _, t, sid, rev, text, spk in log:
        row = model.get(sid)
        if t == "seg" and (row is None or row[0] < rev):
            model[sid] = (rev, text, spk)
        elif t == "spk" and row is not None and row[0] < rev:
            model[sid] = (rev, row[1], spk)
    df = spark.createDataFrame(log, "talk int, seq int, t string, sid int, rev int, text string, spk string")
    df = df.withColumns({"final": F.lit(True), "stable": F.lit(True), "lang": F.lit("en")})
    for part in (df, df.union(df.where("seq % 3 = 0").withColumn("seq", F.col("seq") + 1000))):  # redelivery changes nothing
        got = {r.sid: (r.rev, r.text, r.spk) for r in revlog.current_segments(part).collect()}
        assert got == model


def test_listeners_are_held_at_zero(spark):
    rng = random.Random(1)
    log = [(1, "en", i, rng.choice(["attach", "detach", "detach"])) for i in range(60)]
    n, want = 0, []
    for *_, op in log:
        n = n + 1 if op == "attach" else max(0, n - 1)
        want.append(n)
    got = pubsub.counted(spark.createDataFrame(log, "talk int, lang string, seq int, op string")).orderBy("seq").collect()
    assert [r.n for r in got] == want


def word(text, t0, t1, idx=0):
    return SimpleNamespace(text=text, t0=t0, t1=t1, idx=idx)


def closed(items):
    ws = [word(*w, idx=i) for i, w in enumerate(items)]
    return [(n, why) for _, _, n, _, _, why in run_fold(ws, words.close_start, words.close_step(K), words.close_rest)]


def test_segments_close_by_each_rule():
    short = lambda n, text="a": [(text, i * 0.1, i * 0.1 + 0.1) for i in range(n)]
    assert closed([*short(2)[:1], ("b", 0.7, 0.8)]) == [(1, "pause"), (1, "open")]  # a pause of 0.6 splits
    assert closed([("a", 0, 0.1), ("b.", 0.1, 0.2)]) == [(2, "open")]  # two words are no sentence
    assert closed([("a", 0, 0.1), ("b", 0.1, 0.2), ("c.»", 0.2, 0.3)]) == [(3, "sentence")]
    assert closed(short(18)) == [(18, "words")]
    assert closed([*short(11)[:-1], ("x,", 1.0, 1.1)]) == [(11, "open")]
    assert closed([*short(12)[:-1], ("x,", 1.1, 1.2)]) == [(12, "clause")]
    assert closed([("a", 0, 1.0), ("b", 1.0, 3.5)]) == [(2, "span")]


def agreed(hyps, n):
    rows = [SimpleNamespace(poll=i, words=[{"text": w, "t0": 0, "t1": 0} for w in h.split()]) for i, h in enumerate(hyps)]
    return [o[2] for o in run_fold(rows, list, words.agree_step(n))]


def test_agreement_commits_common_prefixes():
    assert agreed(["a b", "A, b c", "c d"], 2) == ["A,", "b", "c"]
    assert agreed(["a b", "", "a b"], 2) == []
    assert agreed(["a b"], 1) == ["a", "b"]
    assert agreed(["a b c", "a b x", "a b y"], 3) == ["a", "b"]
    assert agreed(["a"], 2) == []


def turns_of(leaders, **changes):
    knobs = Knobs(attack=0.128, hold=0.1, warmup=0.064, **changes)
    rows = [SimpleNamespace(frame=i, leader=x) for i, x in enumerate(leaders)]
    return run_fold(rows, floor.turn_start, floor.turn_step(knobs))


def test_floor_is_taken_held_and_released():
    assert turns_of([None, *[0] * 6]) == [(4, 0, "taken")]
    # silence between does not undo a candidate's frames
    assert turns_of([None, 0, 0, None, 0, 0, 0]) == [(5, 0, "taken")]
    assert turns_of([None, *[0] * 4, None, None, None, 1]) == [(4, 0, "taken"), (7, None, "released")]
    assert turns_of([None, *[0] * 4, None, None, 0, None, None, None]) == [(4, 0, "taken"), (10, None, "released")]
    assert turns_of([None, *[0] * 4, 1, 1, 1, 0, 1, 1, 1, 1]) == [(4, 0, "taken"), (12, 1, "taken")]


def test_time_map(spark):
    frames = [(1, 0, 32), (1, 32, 32), (1, 3064, 32), (1, 3096, 32)]
    runs = timeline.speech_runs(spark.createDataFrame(frames, "talk int, t long, dur long"), 5)
    assert [tuple(r) for r in runs.orderBy("run").collect()] == [(1, 1, 0, 0, 64), (1, 2, 64, 3064, 64)]
    points = spark.createDataFrame([(1, -5), (1, 10), (1, 64), (1, 200), (2, 7)], "talk int, t long")
    got = {(r.talk, r.t): r.x for r in timeline.to_absolute(points, runs, "t", "x").collect()}
    assert got == {(1, -5): 0, (1, 10): 10, (1, 64): 3064, (1, 200): 3200, (2, 7): 7}
    assert timeline.silence_dropped(runs).first().dropped == 3000


def test_hangover_and_runs(spark):
    rng = random.Random(2)
    flags = [rng.random() < 0.1 for _ in range(300)]
    df = spark.createDataFrame([(1, i, f) for i, f in enumerate(flags)], "talk int, frame int, on boolean")
    got = [r.speech for r in timeline.hangover(df, ["talk"], F.col("on"), 18).orderBy("frame").collect()]
    assert got == [any(flags[max(0, i - 18) : i + 1]) for i in range(300)]
    run, want = 0, []
    for f in flags:
        run = 0 if f else run + 1
        want.append(run)
    assert [r.run for r in timeline.run_lengths(df, ["talk"], ~F.col("on")).orderBy("frame").collect()] == want


def test_verdicts(spark):
    rows = [
        ("", 0.0, 0.0, 1.0, "empty"),
        ("fine words here", 0.65, 0.0, 1.0, "no_speech"),
        ("fine words here", 0.64, 0.0, 2.4, "compression"),
        ("a b a b a b", 0.0, 0.0, 1.0, "degenerate"),
        ("a b a b a", 0.0, 0.0, 1.0, None),
        ("x a b a b a b a b", 0.0, 0.0, 1.0, "degenerate"),
        ("x y a b a b a b c d", 0.0, 0.0, 1.0, None),
        ("Thanks for watching", 0.0, 0.0, 1.0, None),
        ("Thanks for watching", 0.35, 0.0, 1.0, "boilerplate"),
        ("Thanks for watching", 0.0, -1.0, 1.0, "boilerplate"),
        ("Подписывайтесь на канал", 0.4, 0.0, 1.0, "boilerplate"),
    ]
    df = spark.createDataFrame(rows, "text string, n double, l double, c double, want string")
    for r in df.withColumn("got", X.verdict(F.col("text"), F.col("n"), F.col("l"), F.col("c"))).collect():
        assert r.got == r.want, r


def test_glossary(spark):
    df = spark.createDataFrame([("The Big Apple and apple, grapple Apple",)], "t string")
    p = X.protect(F.col("t"), X.glossary_pattern(["apple", "big apple"]))
    row = df.select(p.alias("p")).first().p
    assert row.masked == "The §0§ and §1§, grapple §2§" and row.found == ["Big Apple", "apple", "Apple"]
    back = df.select(p.alias("p")).select(X.restore(F.col("p.masked"), F.col("p.found"), F.create_map(F.lit("apple"), F.lit("Apfel"))).alias("x")).first().x
    assert back == "The Big Apple and Apfel, grapple Apfel"


def test_chunks_and_tail(spark):
    segs = [(1, 1, None, "x" * 50, 0, 1), (1, 2, "a", "y" * 50, 1, 2), (1, 3, None, "z" * 300, 2, 3), (1, 4, None, "w", 3, 4)]
    df = spark.createDataFrame(segs, "talk int, sid long, spk string, text string, t0 int, t1 int")
    assert {r.sid: r.chunk for r in words.packed(df, 120).collect()} == {1: 0, 2: 0, 3: 1, 4: 2}
    hyp = spark.createDataFrame([(1, [{"text": "A,"}, {"text": "b"}, {"text": "c"}])], "talk int, words array<struct<text:string>>")
    stable = spark.createDataFrame([(1, ["a"])], "talk int, forms array<string>")
    assert [w.text for w in words.open_tail(stable, hyp).first().tail] == ["b", "c"]


# -- voices ---------------------------------------------------------------------------------------


def unit(*v):
    v = np.array(v, float)
    return v / np.linalg.norm(v)


def test_confidence_falls_with_doubt(spark):
    df = spark.createDataFrame([(0.95, 0.30), (0.69, 0.66), (0.20, 0.10)], "a double, b double")
    x, y, z = (r[0] for r in df.select(V.confidence(F.col("a"), F.col("b"))).collect())
    assert 1 >= x > y > z >= 0 and y < 0.5


def test_average_linkage_respects_tags():
    a, b = unit(1, 0.1, 0), unit(1, 0.5, 0)
    v, w = np.stack([a, b, a, b]), np.ones(4)
    assert len(set(speakers.average_linkage(v, w, 0.5))) == 1
    tagged = speakers.average_linkage(v, w, 0.5, np.array([0, 1, 0, 1]))
    assert tagged.tolist() == [0, 1, 0, 1]


def test_average_linkage_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(20):
        n = int(rng.integers(2, 9))
        v = np.stack([unit(*rng.normal(size=3)) for _ in range(n)])
        w = rng.uniform(0.1, 3, n)
        groups = [[i] for i in range(n)]
        mean = lambda g, h: sum(w[i] * w[j] * (1 - v[i] @ v[j]) for i in g for j in h) / (w[g].sum() * w[h].sum())  # noqa: E731, B023
        while len(groups) > 1:
            d, x, y = min((mean(g, h), x, y) for x, g in enumerate(groups) for y, h in enumerate(groups) if x < y)
            if d > 0.6:
                break
            groups[x] = groups[x] + groups.pop(y)
        got = speakers.average_linkage(v, w, 0.6)
        assert {frozenset(g) for g in groups} == {frozenset(np.flatnonzero(got == k).tolist()) for k in set(got)}


def test_registry_full_and_merge():
    small = Knobs(max_speakers=2)
    voices = speakers.Registry(speakers.Registry.empty(), small)
    assert voices.observe(unit(1, 0, 0))[0] == "S1" and voices.observe(unit(0, 1, 0))[0] == "S2"
    name, conf = voices.observe(unit(0.3, 0.2, 1))
    assert name == "S1" and conf < small.min_conf
    twins = speakers.Registry(speakers.Registry.empty({"Ann": unit(1, 0, 0)}), K)
    twins.rows.append(["S1", unit(1, 0.1, 0), 5, False])
    twins.merge()
    assert [r[0] for r in twins.rows] == ["Ann"] and twins.state["alias"] == {"S1": "Ann"}
    assert np.allclose(twins.rows[0][1], unit(1, 0, 0))  # an enrolled voice is not moved


def test_refine_names_and_fixes(spark):
    rng = np.random.default_rng(5)
    centres = [unit(1, 0, 0, 0), unit(0, 1, 0, 0)]
    rows = [(1, i, [*map(float, unit(*(centres[i % 2] + 0.05 * rng.normal(size=4))))], 1.0) for i in range(10)]
    df = spark.createDataFrame(rows, "talk int, sid long, v array<double>, weight double")
    got = {r.sid: r.spk for r in speakers.refined_labels(df, K, {"Ann": centres[0].tolist()}).collect()}
    assert {got[i] for i in range(0, 10, 2)} == {"Ann"} and len({got[i] for i in range(1, 10, 2)}) == 1
    alone = spark.createDataFrame(rows[:1], df.schema)
    assert speakers.refined_labels(alone, K).count() == 0
    online = speakers.online_labels(df.drop("weight"), K)
    assert online.where("raw in ('S1', 'S2')").count() == 10


def test_change_point(spark):
    a, b = unit(1, 0, 0).tolist(), unit(0, 1, 0).tolist()
    rows = [(1, 1, i, lab, 1.5 + 0.75 * i, v) for i, (lab, v) in enumerate([("x", a), ("x", a), ("y", b), ("y", b)])]
    rows += [(1, 2, i, lab, 1.5, v) for i, (lab, v) in enumerate([("x", a), ("y", b), ("x", a)])]
    df = spark.createDataFrame(rows, "talk int, sid int, pos int, label string, t1 double, v array<double>")
    assert [tuple(r) for r in speakers.change_points(df, 3).collect()] == [(1, 1, 2.625)]


# -- scoring --------------------------------------------------------------------------------------


def test_best_mapping_against_all_mappings():
    rng = random.Random(8)
    for _ in range(200):
        overlap = {(f"h{i}", f"r{j}"): n for i in range(rng.randint(1, 5)) for j in range(rng.randint(1, 5)) if (n := rng.randint(0, 9))}
        if overlap:
            found = scoring.best_mapping(overlap)
            assert len(set(found.values())) == len(found) and all((h, r) in overlap for h, r in found.items())
            assert sum(overlap[p] for p in found.items()) == largest_overlap(overlap)


def test_scores_of_a_scene(spark):
    schema = "scenario string, ord int, spk string, t0 long, t1 long"
    ref = spark.createDataFrame([("s", 0, "a", 0, 1000), ("s", 1, "b", 1000, 2000)], schema)
    hyp = spark.createDataFrame([("s", 0, "x", 0, 1000), ("s", 1, "x", 1000, 1500), ("s", 2, None, 1500, 2000)], schema)
    counted = scoring.grid(ref, hyp, 10, 0)
    got = scoring.components(counted, scoring.mapping(scoring.overlaps(counted))).first()
    # three boundary cells (0, 100, 200) are not scored even without a collar
    assert (got.total, got.miss, got.confusion, got.false_alarm) == (198, 50, 49, 0)
    perfect = scoring.grid(ref, ref, 10, 25)
    assert scoring.components(perfect, scoring.mapping(scoring.overlaps(perfect))).first().der == 0


@pytest.mark.parametrize(("der", "state"), [(0.119, "ok"), (0.121, "worse")])
def test_regression_gate(spark, der, state):
    now = spark.createDataFrame([("s", "online", der), ("n", "online", 0.9)], "scenario string, kind string, der double")
    base = spark.createDataFrame([("s", "online", 0.1)], "scenario string, kind string, der double")
    got = {r.scenario: r.state for r in scoring.regressions(now, base, K.tolerance).collect()}
    assert got == {"s": state, "n": "new"}


def test_settings_from_lines_and_json():
    lines = "chunk: 0.5  # seconds\nlook_back: false\nvocabulary:\n  - 'Spark'\n  - Catalyst\nchannels:\n  \"0\": Ann\n  1: Bob\nphrases: [\"a b\", \"c\"]\nunknown: 3\n"
    got = load(lines)
    assert (got.chunk, got.look_back, got.vocabulary, got.channels, got.phrases) == (0.5, False, ("Spark", "Catalyst"), {"0": "Ann", "1": "Bob"}, ("a b", "c"))
    assert load('{"vocabulary": ["x"], "diarize": "off", "max_words": 9}') == Knobs(vocabulary=("x",), diarize="off", max_words=9)


def test_a_full_buffer_keeps_its_newer_half():
    """Hypotheses that never agree fill the buffer; then half of it and the hypotheses go."""
    knobs = Knobs()
    step, s, seen = words.poll_step(knobs, lambda row, audio, prompt, origin: [[f"w{row.seq}", origin, origin + 1, 1.0]]), words.poll_start(), []
    for seq in range(31):
        s, out = step(s, SimpleNamespace(seq=seq, what="feed", samples=12_800, audio=None, at=0))
        seen.append(out[0][4:])
    assert seen[29] == (0, 30 * 12_800) and seen[30] == (31 * 0.8 - 12.0, 12 * 16_000) and s["kept"] == []
    s, out = step(s, SimpleNamespace(seq=99, what="flush", samples=0, audio=None, at=0))
    assert [w[0] for w in out[0][2]] == ["w30"] and s["partial"] == []


def test_a_short_buffer_is_not_recognised():
    step = words.poll_step(Knobs(chunk=0.1), lambda *_: pytest.fail("too early"))
    assert step(words.poll_start(), SimpleNamespace(seq=0, what="feed", samples=6_000, audio=None, at=0))[1] == []


def test_exit_codes(spark):
    rows = spark.createDataFrame([("a", "online", "ok"), ("b", "online", "worse")], "scenario string, kind string, state string")
    assert [talks.exit_code(rows, ["a", "b"], x) for x in (None, "a", "b", "z")] == [1, 0, 1, 2]


def test_bleed_is_no_overlap(spark):
    """The second channel speaks along with the first; as its echo it doesn't overlap, as another voice it does."""
    rng = np.random.default_rng(5)
    rows = []
    for talk, echo in ((1, True), (2, False)):
        speech, other = rng.normal(-30, 4, 60), rng.normal(-33, 4, 60)
        for f in range(120):
            loud = 40 <= f < 100
            a = speech[f - 40] if loud else -80.0
            b = (a - 3 if echo else other[f - 40]) if loud else -80.0
            rows += [(talk, 0, f, float(a)), (talk, 1, f, float(b))]
    frames = spark.createDataFrame(rows, "talk long, ch long, frame long, level_db double")
    noisy = floor.noise_floor(frames, ["talk", "ch"])
    lead = floor.rivals(noisy).where("frame >= 60 and frame < 100").groupBy("talk").agg(F.sum(F.size("overlap")).alias("n")).collect()
    found = {r.talk: r.n for r in lead}
    assert found[1] == 0 and found[2] > 10
    told = floor.events(noisy).collect()
    assert {(1, "taken"), (2, "taken")} <= {(r.talk, r.reason) for r in told}
    owner = {(r.talk, r.frame): r.owner for r in floor.owners(frames.select("talk", "frame").distinct(), floor.events(noisy)).collect()}
    assert owner[1, 70] == 0 and owner[1, 10] is None


def test_a_fold_streams_through_its_groups(spark):
    """Null keys are a group, null places come last, ends are told, and no group is gathered."""
    from lectern.operators.folds import fold

    rows = [(k, i, 7 if i is None else i * i) for k in (None, 1, 2, 3) for i in (None, *range(9))]
    df = spark.createDataFrame(rows, "k long, i long, x long")
    found = fold(df, ["k"], ["i"], "k long, i long, total long", lambda: 0, lambda s, r: (s + r.x, [(r.i, s + r.x)]), lambda s: [(-1, s)])
    got = sorted(((r.k or 0, -2 if r.i is None else r.i, r.total) for r in found.collect()))
    one = [(-2, 211), (-1, 211), *((i, sum(j * j for j in range(i + 1))) for i in range(9))]
    assert got == sorted((k, *x) for k in (0, 1, 2, 3) for x in one)
    assert "InPandas" not in found._jdf.queryExecution().toString()
