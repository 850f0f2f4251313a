"""Files in, streams through, jobs out."""

import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.config import Knobs
from lectern.functions.encoders import build_encoder, spectral_encoder
from lectern.operators import revlog, words
from lectern.plans import talks, voices
from lectern.sources import audio, live, messages, recordings, scenes
from lectern.streaming import state



def say(name, seconds, seed=1):
    return scenes.voice(scenes.CAST[name], seconds, np.random.default_rng(seed))


def test_wav_frames_and_signals(spark, tmp_path):
    left, right = say("Иван", 1.0), scenes.noise(1.0, np.random.default_rng(2))
    (tmp_path / "hall.wav").write_bytes(audio.encode(np.stack([left, right], 1)))
    (tmp_path / "other.txt").write_text("x")
    files = audio.files(spark, str(tmp_path))
    got = audio.frames(files).groupBy("talk", "ch").agg(F.count("frame").alias("n"), F.max(F.size("pcm")).alias("size")).orderBy("ch").collect()
    assert [(r.talk, r.ch, r.n, r.size) for r in got] == [("hall", 0, 31, 512), ("hall", 1, 31, 512)]
    mono = audio.signals(files).first()
    assert mono.name == "hall" and np.allclose(mono.pcm, (left + right) / 2, atol=1e-4)


def test_long_recordings_are_read_in_parts(spark, tmp_path):
    """Whatever the cuts, the frames are those of whole files; a file fills several tasks, small ones share one."""
    for name, seconds, channels in (("long", 4.0, 2), ("short", 0.3, 1), ("tiny", 0.01, 3)):
        sound = np.stack([say("Иван", seconds, c) for c in range(channels)], 1)
        (tmp_path / f"{name}.wav").write_bytes(audio.encode(sound))
    odd = (tmp_path / "long.wav").read_bytes()
    (tmp_path / "Chunk.WAV").write_bytes(odd[:4] + (len(odd) + 4).to_bytes(4, "little") + odd[8:36] + b"LIST\x03\0\0\0abc\0" + odd[36:])  # a chunk before the samples
    (tmp_path / "cut.wav").write_bytes(odd[:40] + b"\xff\xff\xff\xff" + odd[44 : 44 + 2048 * 7 + 99])  # a recorder that was cut off
    (tmp_path / "notes.txt").write_text("x")
    rows = lambda df: sorted((r.talk, r.ch, r.frame, r.t_abs, tuple(r.pcm)) for r in df.collect())
    want = rows(audio.frames(audio.files(spark, str(tmp_path)).where("name != 'cut'")))
    cut = [("cut", ch, f) for ch in (0, 1) for f in range(7)]
    for split in (7_777, 50_000, 1 << 20):
        got = recordings.frames(spark, str(tmp_path), split)
        assert rows(got.where("talk != 'cut'")) == want
        assert sorted((r.talk, r.ch, r.frame) for r in got.where("talk = 'cut'").collect()) == cut
        if split < 1 << 20:
            assert got.where("talk = 'long'").select(F.spark_partition_id()).distinct().count() > 4
    assert recordings.frames(spark, "file://" + str(tmp_path)).rdd.getNumPartitions() == 1
    mono = recordings.frames(spark, str(tmp_path / "long.wav"), 3_000, mono=True).orderBy("frame").collect()
    signal = audio.signals(audio.files(spark, str(tmp_path / "long.wav"))).first().pcm
    assert np.allclose(np.concatenate([r.pcm for r in mono]), signal[: len(mono) * 512], atol=1e-6) and {r.ch for r in mono} == {0}


def test_segments_meet_only_their_frames(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(audio.encode(np.concatenate([say("Иван", 2.2), say("Ольга", 3.1)])[:, None]))
    (tmp_path / "b.wav").write_bytes(audio.encode(say("Пётр", 2.0)[:, None]))
    spans = spark.createDataFrame([("a", 1, 0, 1700), ("a", 2, 1701, 5001), ("a", 3, 64, 64), ("b", 1, 333, 1999), ("c", 1, 0, 900)], "talk string, sid long, t0 long, t1 long")
    whole = voices.segment_windows(audio.signals(audio.files(spark, str(tmp_path))), spans).where("size(wins) > 0")
    parts = voices.windows_of_frames(recordings.frames(spark, str(tmp_path), 10_000, mono=True), spans).where("size(wins) > 0")
    key = lambda df: {(r.talk, r.sid): r.wins for r in df.collect()}
    a, b = key(whole), key(parts)
    assert a.keys() == b.keys() and len(a) == 3
    assert all([(w.t0, w.t1) for w in a[k]] == [(w.t0, w.t1) for w in b[k]] and np.allclose([w.v for w in a[k]], [w.v for w in b[k]]) for k in a)


def test_growing_recordings_are_a_stream(spark, tmp_path):
    """Two halls, restarts, a file that comes later, a part of a frame: no frame comes twice or is lost."""
    folder, rng = tmp_path / "halls", np.random.default_rng(1)
    folder.mkdir()
    sound = {name: rng.integers(-(2**15), 2**15, (n * 512, 2)).astype("<i2") for name, n in (("a", 23), ("b", 9), ("c", 5))}
    spark.dataSource.register(live.PcmTail)
    stream = lambda: spark.readStream.format("pcm_tail").option("path", str(folder)).option("channels", "2").option("most", "4").option("split", "3").load()
    sizes = [{"a": 4 * 512 + 100, "b": 512}, {"a": 15 * 512 + 1, "b": 512}, {"a": 23 * 512, "b": 9 * 512 - 1, "c": 5 * 512}, {"a": 23 * 512, "b": 9 * 512, "c": 5 * 512}]
    batches = []
    for step, own in enumerate(sizes):
        for name, n in own.items():
            (folder / f"{name}.raw").write_bytes(sound[name][:n].tobytes())
        if step in (0, 2):  # the query starts anew here
            q = stream().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).start()
        q.processAllAvailable()
        batches += [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]
        rows = spark.read.parquet(str(tmp_path / "out")).orderBy("talk", "frame", "ch").collect()
        assert [(r.talk, r.frame, r.ch) for r in rows] == [(name, i, c) for name in sorted(own) for i in range(own[name] // 512) for c in (0, 1)]
        if step in (1, 3):
            q.stop()
    assert max(batches) > 16 and all(np.allclose(r.pcm, sound[r.talk][r.frame * 512 : (r.frame + 1) * 512, r.ch] / 32768) and r.t_abs == r.frame * 512 / 16_000 for r in rows)
    reader = live._Tail(str(folder), None, live.pcm.Sound(2, 16_000, 0, 0), 4, 3)
    assert [(r.talk, r.first, r.last) for r in reader.partitions({"a": 2}, {"a": 9, "c": 1})] == [("a", 2, 5), ("a", 5, 8), ("a", 8, 9), ("c", 0, 1)]
    reader.admitted = {"a": 2, "b": 9}
    assert reader.latestOffset() == {"a": 6, "b": 9, "c": 4}


def test_spectral_encoder_tells_voices_apart(spark):
    own = spectral_encoder()
    vec = {n: [own(say(n, 1.5, s).astype(float)) for s in (1, 2)] for n in ("Иван", "Ольга")}
    assert vec["Иван"][0] @ vec["Иван"][1] > 0.95 and vec["Иван"][0] @ vec["Ольга"][0] < 0.6
    assert own(np.zeros(1000)) is None
    df = spark.createDataFrame([(1, say("Иван", 0.2).tolist()), (2, [0.0] * 10)], "id int, pcm array<float>")
    got = {r.id: r.v for r in df.select("id", build_encoder("spectral")("pcm").alias("v")).collect()}
    assert len(got[1]) == 20 and got[2] is None
    with pytest.raises(ValueError):
        build_encoder("none such")


def test_log_defaults_and_baseline(spark, tmp_path):
    (tmp_path / "log").write_text('{"t":"seg","talk":"x","sid":1,"rev":1,"extra":5}\nnot json\n{"t":"seg"}\n')
    row = messages.read_log(spark, str(tmp_path / "log")).collect()
    assert len(row) == 1 and row[0].text == "" and row[0].final is False and row[0].spk is None
    (tmp_path / "base.json").write_text(json.dumps({"scenarios": {"s": {"online": 0.5}}, "tolerance": 0.02}, indent=1))
    assert [tuple(r) for r in messages.baseline(spark, str(tmp_path / "base.json")).collect()] == [("s", "online", 0.5)]


def log_rows(n=90):
    rng = random.Random(6)
    return [{"talk": "x", "seq": i, "t": rng.choice(["seg", "seg", "spk"]), "sid": rng.randrange(4), "rev": rng.randrange(9), "text": f"t{i}", "spk": f"s{i % 3}"} for i in range(n)]


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, state.ROCKSDB)
    yield spark
    spark.conf.set(key, before)


def run_once(df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"ck_{name}")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return q


@pytest.mark.parametrize("parts", [1, 3])
def test_stream_of_the_log_equals_batch(rocks, tmp_path, parts):
    rows = log_rows()
    folder = tmp_path / "in"
    folder.mkdir()
    size = -(-len(rows) // parts)
    for p in range(parts):
        f = folder / f"{p}.json"
        f.write_text("\n".join(map(json.dumps, rows[p * size : (p + 1) * size])))
        import os

        os.utime(f, (1_700_000_000 + p, 1_700_000_000 + p))
    stream = messages.stream_log(rocks, str(folder), files_at_once=1)
    run_once(state.accepted_stream(stream), f"log{parts}", tmp_path)
    last = rocks.table(f"log{parts}").groupBy("sid").agg(F.max_by(F.struct("rev", "text", "spk"), "seq").alias("r")).select("sid", "r.*")
    batch = revlog.current_segments(messages.read_log(rocks, str(folder))).select("sid", "rev", "text", "spk")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, batch.collect()))


def test_stream_of_words_equals_batch(rocks, tmp_path):
    rng = random.Random(3)
    texts = [rng.choice(["a", "b,", "c.", "d"]) for _ in range(80)]
    rows = [{"talk": "x", "idx": i, "text": t, "t0": i * 0.3, "t1": i * 0.3 + 0.2} for i, t in enumerate(texts)]
    folder = tmp_path / "w"
    folder.mkdir()
    (folder / "0.json").write_text("\n".join(map(json.dumps, rows)))
    schema = "talk string, idx long, text string, t0 double, t1 double"
    out = "talk string, sid long, first long, n long, t0 double, t1 double, reason string"
    stream = rocks.readStream.schema(schema).json(str(folder))
    knobs = Knobs()
    run_once(state.fold_stream(stream, ["talk"], ["idx"], out, words.close_start, words.close_step(knobs)), "words", tmp_path)
    batch = words.segments(rocks.read.schema(schema).json(str(folder)), knobs).where("reason != 'open'")
    assert sorted(map(tuple, rocks.table("words").collect())) == sorted(map(tuple, batch.collect()))


def live_rows():
    rng = random.Random(4)
    rows, at = [], 0.0
    for seq in range(120):
        at += rng.choice([0.3, 0.3, 0.9])
        word = {"text": rng.choice(["a", "b,", "c.", "d"]), "t0": at, "t1": at + 0.2, "p": 0.5}
        what = rng.choice(["stable"] * 6 + ["partial", "floor", "flush"])
        rows.append({"talk": "x", "seq": seq, "what": what, "words": [word] if what != "flush" else [], "name": rng.choice(["ann", None]), "now": 0.0})
    return [*rows, {"talk": "x", "seq": 120, "what": "flush", "words": [], "name": None, "now": 0.0}]


def test_live_segments_as_a_stream(rocks, tmp_path):
    folder = tmp_path / "l"
    folder.mkdir()
    (folder / "0.json").write_text("\n".join(map(json.dumps, live_rows())))
    schema = "talk string, seq long, what string, words array<struct<text:string,t0:double,t1:double,p:double>>, name string, now double"
    want = sorted(map(tuple, words.live_segments(rocks.read.schema(schema).json(str(folder))).collect()), key=str)
    live = state.segments_stream(rocks.readStream.schema(schema).json(str(folder)), ttl_ms=10**7)
    q = live.writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path / "ck_live")).start()
    try:  # with timers a query never says that it is done
        for _ in range(240):
            got = sorted(map(tuple, rocks.table("live").collect()), key=str)
            if len(got) >= len(want) or q.exception():
                break
            time.sleep(0.5)
    finally:
        q.stop()
    assert got == want and {r[2] for r in want} == {"seg", "floor"}


class Timers:
    def __init__(self):
        self.set = set()

    def listTimers(self):
        return sorted(self.set)

    def registerTimer(self, at):
        self.set.add(at)

    def deleteTimer(self, at):
        self.set.discard(at)


def test_a_timer_counts_from_the_opening():
    """Later words don't put it off; a new segment sets a new one, and none is left when nothing is open."""
    since = lambda s: s["open"]["at"] if s["open"] and s["open"]["words"] else None
    p = state.FoldProcessor([], [], words.live_start, None, tick=lambda *_: None, since=since, after_ms=3500)
    p.handle = Timers()
    step, s = words.live_step(Knobs()), words.live_start()
    row = lambda what, now: words.LiveRow(0, what, [["w", now / 1000, now / 1000 + 0.1, 1.0]] if what == "stable" else [], None, now)
    seen = []
    for what, now in (("stable", 100), ("stable", 400), ("stable", 2000), ("flush", 2100), ("stable", 2600)):
        s, _ = step(s, row(what, now))
        p._wait(s)
        seen.append(p.handle.listTimers())
    assert seen == [[3600], [3600], [5500], [], [6100]]


def test_event_time_windows(spark, tmp_path):
    folder = tmp_path / "e"
    spark.range(100).selectExpr("'x' as talk", "timestamp_seconds(1700000000 + id * 60 + case when id > 50 then 7200 else 0 end) as at", "id % 7 as sid", "1L as rev", "'seg' as t").write.parquet(str(folder))
    stream = lambda: spark.readStream.schema("talk string, at timestamp, sid long, rev long, t string").parquet(str(folder))
    run_once(state.activity(stream(), "at", "1 minute", "10 minutes"), "tumbling", tmp_path)
    run_once(state.sessions(stream(), "at", "1 minute", "30 minutes"), "gaps", tmp_path)
    run_once(state.once_delivered(stream(), "at", "30 days"), "unique", tmp_path)
    assert spark.table("tumbling").agg(F.sum("n")).first()[0] > 50
    assert [r.n for r in spark.table("gaps").collect()] == [51]
    assert spark.table("unique").count() == 7


def test_versions_are_appended_folded_and_compacted(spark, tmp_path):
    path, then = str(tmp_path / "v"), str(tmp_path / "w")
    write = state.append_versions(path)
    rows = lambda *r: spark.createDataFrame(list(r), "k int, seq int, v string")
    write(rows((1, 1, "a"), (2, 2, "b")), 0)
    for _ in range(2):  # a batch that runs again
        write(rows((1, 3, "c"), (2, 1, "old")), 1)
    assert sorted(map(tuple, state.current(spark, path, ["k"], "seq").collect())) == [(1, 3, "c"), (2, 2, "b")]
    state.compact(spark, path, then, ["k"], "seq", buckets=2)
    state.append_versions(then)(rows((2, 9, "new")), 2)
    assert sorted(map(tuple, state.current(spark, then, ["k"], "seq").collect())) == [(1, 3, "c"), (2, 9, "new")]


def test_translation_job(spark):
    wanted = spark.createDataFrame([("x", 1, 2, "de", "en", "see Apple now"), ("x", 2, 1, "de", "en", "old"), ("x", 3, 1, "fr", "en", "fails")], "talk string, sid int, rev int, lang string, own_lang string, text string")
    have = spark.createDataFrame([("x", 2, "de", 1, "alt")], "talk string, sid int, lang string, rev int, text string")
    engine = lambda texts, own, to: [None if t == "fails" else t.upper() for t in texts]
    got = {r.sid: (r.text, r.failed) for r in talks.translate(wanted, have, {"apple": {"de": "Apfel"}}, engine).collect()}
    assert got == {1: ("SEE Apfel NOW", False), 3: ("fails", True)}


def test_summaries(spark):
    segs = spark.createDataFrame([("x", i, "ann" if i % 3 else "bob", f"transformer models number {i} are really very good", i * 1000, i * 1000 + 900) for i in range(1, 7)], "talk string, sid long, spk string, text string, t0 long, t1 long")
    titles = spark.createDataFrame([("x", "Talk"), ("y", None)], "talk string, title string")
    got = {r.talk: r.summary for r in talks.summaries(segs, titles).collect()}
    assert got["y"] == "The transcript is empty." and got["x"].startswith("# Talk") and "transformer" in got["x"] and "ann: 67%" in got["x"]
    model = lambda prompt, tokens: f"[{tokens}]"
    assert "[1200]" in talks.summaries(segs, titles, model).where("talk = 'x'").first().summary

    def broken(prompt, tokens):
        raise OSError

    assert "## Key terms" in talks.summaries(segs, titles, broken).where("talk = 'x'").first().summary


def test_summaries_are_a_tree_of_bounded_calls(spark, tmp_path):
    """Many chunks, one segment longer than a chunk, one talk whose model fails: no prompt is too long, and only that talk falls back."""
    rows = [("x", i, "ann", f"part {i} of a long talk about transformer models and so on", i * 1000, i * 1000 + 900) for i in range(1, 200)]
    rows += [("y", 1, None, "z " * 900, 0, 900), ("y", 2, None, "broken engine here now today friends", 1000, 1900), ("w", 1, None, "short words here for the one chunk", 0, 900)]
    segs = spark.createDataFrame(rows, "talk string, sid long, spk string, text string, t0 long, t1 long")
    titles = spark.createDataFrame([("x", "Talk"), ("y", "Other"), ("w", None), ("none", "Empty")], "talk string, title string")
    seen = tmp_path / "prompts"
    seen.mkdir()

    def model(prompt, tokens):
        import uuid

        (seen / uuid.uuid4().hex).write_text(f"{tokens} {len(prompt)} {prompt[:20]}")
        if "broken" in prompt:
            raise OSError("engine")
        return f"<{prompt.count('part ') + prompt.count('<')}>" + "n" * (5_000 if tokens == 600 else 10)

    got = {r.talk: r.summary for r in talks.summaries(segs, titles, model, most=300).collect()}
    prompts = [p.read_text().split(" ", 2) for p in seen.iterdir()]
    assert max(int(n) for tokens, n, _ in prompts if tokens == "600") <= len(talks.PART) + talks.FAN_IN * (talks.NOTE_CHARS + 2)
    assert len([1 for tokens, n, _ in prompts if tokens == "600" and int(n) <= len(talks.PART) + 300]) >= 40
    assert any(int(n) > 1000 for tokens, n, _ in prompts if tokens == "600")  # notes of notes
    assert "<" in got["x"] and "<" in got["w"] and "## Key terms" in got["y"] and "<" not in got["y"] and got["none"] == "The transcript is empty."


def test_counters_of_a_stream_are_observed(spark, tmp_path):
    from lectern.streaming import health

    folder = tmp_path / "asked"
    folder.mkdir()
    rng, rows = random.Random(2), []
    for p in range(3):
        own = [{"talk": rng.choice("xy"), "text": "t" * rng.randrange(9), "hit": rng.random() < 0.4, "failed": rng.random() < 0.3} for _ in range(40)]
        (folder / f"{p}.json").write_text("\n".join(map(json.dumps, own)))
        rows += own
    schema = "talk string, text string, hit boolean, failed boolean"
    listener = health.Reports(str(tmp_path / "health"))
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
        run_once(health.translations(stream), "counted", tmp_path)
        want = revlog.translation_counters(spark.read.schema(schema).json(str(folder))).agg(*(F.sum(c).alias(c) for c in ("hits", "calls", "chars", "errors"))).first().asDict()
        for _ in range(60):  # listeners hear of a batch a little later
            got = {r.key: r.total for r in health.totals(spark, str(tmp_path / "health")).where("name = 'translation'").collect()} if (tmp_path / "health").exists() else {}
            if got == want:
                break
            time.sleep(0.5)
        assert got == want
    finally:
        spark.streams.removeListener(listener)
