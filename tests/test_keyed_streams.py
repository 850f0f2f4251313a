"""Stateful operators: against batch forms and plain models, in many batchings, and as streams of Spark."""

import json
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.config import Knobs
from lectern.operators import pubsub, revlog, speakers
from lectern.plans import voices
from lectern.sources import tables
from lectern.streaming import ingest, keyed, state


class Fake:
    """State kept in a dict, with what the processors use of Spark's handle."""

    def __init__(self):
        self.kept = {}

    def getValueState(self, name, schema, ttl=None):
        return _Value(self.kept, name)

    def getListState(self, name, schema, ttl=None):
        return _Value(self.kept, name)

    def getMapState(self, name, key, value, ttl=None):
        return _Map(self.kept.setdefault(name, {}))


class _Value:
    def __init__(self, kept, name):
        self.kept, self.name = kept, name

    def exists(self):
        return self.name in self.kept

    def get(self):
        return self.kept[self.name]

    def update(self, value):
        self.kept[self.name] = value

    put = update

    def clear(self):
        self.kept.pop(self.name, None)


class _Map:
    def __init__(self, own):
        self.own = own

    def containsKey(self, key):
        return key in self.own

    def getValue(self, key):
        return self.own[key]

    def updateValue(self, key, value):
        assert isinstance(key, tuple) and isinstance(value, tuple)
        self.own[key] = value

    def removeKey(self, key):
        self.own.pop(key, None)

    def iterator(self):
        return iter(list(self.own.items()))


def replayed(make, rows, columns, cuts):
    """Outputs of a new processor for each batch, over one state: as if the query had been started anew between all of them."""
    handle, out = Fake(), []
    for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        p = make()
        p.init(handle)
        batch = rows[a:b]
        random.Random(a).shuffle(batch)
        if batch:
            for frame in p.handleInputRows(("x",), iter([pd.DataFrame(batch, columns=columns, dtype=object)]), None):
                out += list(frame.itertuples(index=False, name=None))
    return out


def cuts_of(rng, n):
    return sorted(rng.sample(range(n + 1), rng.randrange(0, min(7, n))))


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, state.ROCKSDB)
    yield spark
    spark.conf.set(key, before)


def streamed(spark, tmp_path, name, rows, schema, query, parts=2):
    """query over a stream of `parts` files of rows, one file a batch, started anew after each."""
    folder = tmp_path / name
    folder.mkdir()
    size = -(-len(rows) // parts)
    for p in range(parts):
        f = folder / f"{p}.json"
        f.write_text("\n".join(json.dumps(r) for r in rows[p * size : (p + 1) * size]))
        os.utime(f, (1_700_000_000 + p, 1_700_000_000 + p))
        stream = query(spark.readStream.schema(schema).json(str(folder)))
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / f"{name}_out")).option("checkpointLocation", str(tmp_path / f"{name}_ck")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    return spark.read.parquet(str(tmp_path / f"{name}_out"))


LINK = "talk string, at long, what string, body string, ack long"


def link_events(rng, n):
    rows, sent, acked = [], 0, 0
    for at in range(n):
        what = rng.choice(["send"] * 6 + ["ack", "ack", "up", "down"])
        sent += what == "send"
        if what == "ack":
            acked = rng.randint(min(acked, sent), sent)
        rows.append({"talk": "x", "at": at, "what": what, "body": f"m{at}" if what == "send" else None, "ack": acked if what == "ack" else None})
    return rows


@pytest.mark.parametrize("room", [1, 4, 50])
def test_outbox_equals_its_batch_form(spark, room):
    rng = random.Random(room)
    schema = "talk string, at long, no long, body string, resent boolean, dropped long"
    for _ in range(3):
        rows = link_events(rng, 120)
        want = sorted(map(tuple, revlog.transmissions(spark.createDataFrame([tuple(r.values()) for r in rows], LINK), room).collect()))
        for _ in range(5):
            got = replayed(lambda: keyed.Outbox(schema, room, None), [tuple(r.values())[1:] for r in rows], ["at", "what", "body", "ack"], cuts_of(rng, len(rows)))
            assert sorted(got) == want


def test_outage_drill(rocks, tmp_path):
    """76 messages while the cloud is away for 8 s: all arrive, what was sent twice counts once, nothing is lost but what a small outbox drops."""
    log = str(tmp_path / "log")
    rocks.dataSource.register(ingest.AckLog)
    say = lambda i: json.dumps({"talk": "x", "t": "seg", "sid": i // 3, "rev": i % 3 + 1, "seq": i, "text": f"text {i}"}, ensure_ascii=False)
    send = lambda i: {"talk": "x", "at": i * 105, "what": "send", "body": say(i), "ack": None}
    event = lambda at, what: {"talk": "x", "at": at, "what": what, "body": None, "ack": None}
    folder = tmp_path / "edge"
    folder.mkdir()
    (folder / "0.json").write_text("\n".join(json.dumps(r) for r in [event(0, "up"), *(send(i) for i in range(1, 11)), event(1_060, "down")]))
    events = lambda: rocks.readStream.schema(LINK).json(str(folder))
    acks = lambda: ingest.ack_stream(rocks, log).select("talk", F.lit(2_000).cast("long").alias("at"), F.lit("ack").alias("what"), F.lit(None).cast("string").alias("body"), "ack")

    def run(source):
        sent = keyed.outbox(source).select("talk", "no", "body", "resent", "at")
        q = sent.writeStream.format("ack_log").option("path", log).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)

    os.makedirs(f"{log}/commits")
    run(events().unionByName(acks()))
    assert [tuple(r) for r in ingest.acknowledged(rocks, log).collect()] == [("x", 10)]
    # the answer for the last three is lost, then the link stays down for 76 messages
    commit = tmp_path / "log" / "commits" / "0.json"
    commit.write_text(commit.read_text().replace('"ack": 10', '"ack": 7'))
    (folder / "1.json").write_text("\n".join(json.dumps(r) for r in [*(send(i) for i in range(20, 96)), event(10_100, "up"), send(97)]))
    run(events().unionByName(acks()))
    got = ingest.received(rocks, log)
    assert ingest.acknowledged(rocks, log).first().ack == 87
    assert got.count() == 10 + 3 + 76 + 1 and got.select("no").distinct().count() == 87
    texts = {f"text {i}" for i in [*range(1, 11), *range(20, 96), 97]}
    assert {r.text for r in got.collect()} == texts
    twice = got.groupBy("sid", "rev").count().where("count > 1").count()
    once = revlog.judged(got.withColumn("seq", F.monotonically_increasing_id())).where("accepted")
    assert twice == 3 and once.groupBy("sid", "rev").count().where("count > 1").isEmpty()
    (tmp_path / "log" / "rows" / "left-by-a-failed-try.json").write_text(json.dumps({"talk": "x", "no": 999, "body": say(999)}))
    assert ingest.received(rocks, log).count() == 90
    small = [tuple(r.values())[1:] for r in [event(0, "down"), *(send(i) for i in range(20, 96)), event(10_100, "up")]]
    out = replayed(lambda: keyed.Outbox("talk string, at long, no long, body string, resent boolean, dropped long", 50, None), small, ["at", "what", "body", "ack"], [30])
    assert len(out) == 50 and {r[-1] for r in out} == {26}


MERGING = Knobs(merge=0.8, merge_every=10)
SEGMENTS = f"talk string, sid long, rev long, spk string, wins {voices.WINDOWS}"


def spoken(rng, n):
    """Voices that drift together, so that some merge; a few segments without sound."""
    rows = []
    for i in range(1, n + 1):
        base = rng.choice([0, 0, 50 - i, 200])
        turned = [np.radians(base + rng.uniform(-4, 4)) for _ in range(rng.choice([0, 1, 2, 2, 3]))]
        wins = [{"t0": i + k / 2, "t1": i + k / 2 + 1, "v": [float(np.cos(t)), float(np.sin(t)), 0.0]} for k, t in enumerate(turned)]
        rows.append({"talk": "x", "sid": i, "rev": 3, "spk": rng.choice([None, None, "S1"]), "wins": wins})
    return rows


def batch_revisions(spark, rows):
    segments = spark.createDataFrame([(r["talk"], r["sid"], r["rev"], r["spk"], [tuple(w.values()) for w in r["wins"]]) for r in rows], SEGMENTS)
    online = voices.attributed(segments.select("talk", "sid", "wins"), None, MERGING).cache()
    merged = speakers.merges(online.where("v is not null").select("talk", "sid", "v"), MERGING)
    none = online.select("talk", "sid", "spk", "conf").where("false")
    changes = revlog.relabelled(segments.select("talk", "sid", "rev", "spk"), speakers.late_labels(online.select("talk", "sid", "raw", "spk", "conf"), merged, none))
    return sorted(map(tuple, changes.select("talk", "sid", "seq", "rev", "was", "spk", "spk_conf", "src").collect()), key=lambda r: (r[1], r[2])), merged.count()


def test_revisions_equal_batch_in_any_batching(spark, rocks, tmp_path):
    rng, merged = random.Random(4), 0
    schema = "talk string, sid long, seq long, rev long, was string, spk string, spk_conf double, src string, change_at double"
    for k in range(4):
        rows = spoken(rng, 60)
        want, n = batch_revisions(spark, rows)
        merged += n
        plain = [(r["sid"], r["rev"], r["spk"], r["wins"]) for r in rows]
        for _ in range(4):
            got = replayed(lambda: keyed.Revisions(schema, MERGING, None, None), plain, ["sid", "rev", "spk", "wins"], cuts_of(rng, len(rows)))
            assert sorted((r[:-1] for r in got), key=lambda r: (r[1], r[2])) == want
        if k == 0:
            out = streamed(rocks, tmp_path, "who", rows, SEGMENTS, lambda s: keyed.revisions(s, MERGING))
            assert sorted((tuple(r)[:-1] for r in out.collect()), key=lambda r: (r[1], r[2])) == want
        assert {r[-1] for r in want} == {"online", "merge"} or not n
    assert merged >= 2


SAID = "talk string, seq long, what string, sid long, rev long, lang string, text string, final boolean, stable boolean"


def said(rng, n):
    rows = []
    for seq in range(n):
        what = rng.choice(["seg"] * 8 + ["edit", "attach", "attach", "detach"])
        own = {"sid": rng.randrange(1, 60), "rev": rng.randrange(1, 6), "lang": rng.choice(["en", "en", "de"]), "text": f"t{seq}", "final": rng.random() < 0.8, "stable": rng.random() < 0.8}
        if what in ("attach", "detach"):
            own = dict.fromkeys(own) | {"lang": rng.choice(["de", "fr", "en"])}
        rows.append({"talk": "x", "seq": seq, "what": what, **own})
    return rows


def asked_model(rows, backlog):
    """The stated rules, over plain dicts."""
    current, cache, heard, out = {}, {}, {}, []

    def ask(r, sid, lang, live):
        rev, _, own, text = current[sid]
        hit = cache.get((sid, lang), 0) >= rev
        cache[sid, lang] = max(cache.get((sid, lang), 0), rev)
        out.append(("x", r["seq"], sid, rev, lang, own, text, hit, live))

    for r in rows:
        if r["what"] == "seg" and r["rev"] > current.get(r["sid"], (0,))[0]:
            current[r["sid"]] = (r["rev"], r["final"], r["lang"], r["text"])
            if r["final"] and r["stable"]:
                for lang in sorted(k for k, n in heard.items() if n and k != r["lang"]):
                    ask(r, r["sid"], lang, True)
        elif r["what"] == "edit" and r["sid"] in current:
            rev, _, own, _ = current[r["sid"]]
            current[r["sid"]] = (rev + 1, True, own, r["text"])
            cache = {k: v for k, v in cache.items() if k[0] != r["sid"]}
            for lang in sorted(k for k, n in heard.items() if n and k != own):
                ask(r, r["sid"], lang, True)
        elif r["what"] == "attach":
            heard[r["lang"]] = heard.get(r["lang"], 0) + 1
            if heard[r["lang"]] == 1:
                for sid in sorted(s for s, x in current.items() if x[1])[-backlog:]:
                    if current[sid][2] != r["lang"]:
                        ask(r, sid, r["lang"], False)
        elif r["what"] == "detach":
            heard[r["lang"]] = max(0, heard.get(r["lang"], 0) - 1)
    return out


def test_lazy_translation_equals_its_rules(rocks, tmp_path):
    rng = random.Random(8)
    schema = "talk string, seq long, sid long, rev long, lang string, own_lang string, text string, hit boolean, live boolean"
    for k in range(6):
        rows = said(rng, 300)
        want = asked_model(rows, 7)
        for _ in range(4):
            got = replayed(lambda: keyed.LazyTranslation(schema, 7, None), [tuple(r.values())[1:] for r in rows], SAID.replace(",", "").split()[2::2], cuts_of(rng, len(rows)))
            assert sorted(got) == sorted(want)
        if k == 0:
            out = streamed(rocks, tmp_path, "asked", rows, SAID, lambda s: keyed.asked(s, 7, ttl_ms=None))
            assert sorted(map(tuple, out.collect())) == sorted(want)
            counted = revlog.translation_counters(out.withColumn("failed", F.col("sid") % 11 == 0)).first()
            calls = [r for r in want if not r[7] and r[2] % 11]
            assert (counted.hits, counted.calls, counted.chars) == (sum(r[7] for r in want), len(calls), sum(len(r[6]) for r in calls))
    assert any(r[7] for r in want) and any(not r[8] for r in want)


def test_backlog_of_a_stream_is_that_of_the_batch_query(spark):
    """Over the given tables: listeners come once all is said, and get the last 30 finals of each talk."""
    folder = "/root/testdata/sf0.001"
    said_ = tables.messages(spark, folder)
    active = pubsub.activations(tables.subscriptions(spark, folder)).select("talk", "lang").distinct()
    want = sorted(map(tuple, pubsub.targets(revlog.last_rows(revlog.current_segments(said_).where("final"), ["talk"], "sid", 30), active).select("talk", "sid", "rev", "target").collect()))
    by_talk = {}
    for r in said_.where("t = 'seg'").orderBy("talk", "seq").collect():
        by_talk.setdefault(r.talk, []).append((r.seq, "seg", r.sid, r.rev, r.lang, r.text, r.final, r.stable))
    got, end = [], 10**9
    for talk, rows in by_talk.items():
        rows += [(end + i, "attach", None, None, r.lang, None, None, None) for i, r in enumerate(active.where(F.col("talk") == talk).orderBy("lang").collect())]
        out = replayed(lambda: keyed.LazyTranslation("talk string, seq long, sid long, rev long, lang string, own_lang string, text string, hit boolean, live boolean", 30, None), rows, SAID.replace(",", "").split()[2::2], [len(rows) // 2])
        got += [(talk, sid, rev, lang) for _, _, sid, rev, lang, *_ in out]
    assert sorted(got) == want and want


WATCHED = "talk string, at long, what string, viewer string, lang string, body string"


def watched(rng, n):
    rows = []
    for at in range(n):
        what = rng.choice(["say"] * 8 + ["setlang", "read"])
        rows.append({"talk": "x", "at": at, "what": what, "viewer": None if what == "say" else rng.choice("abc"), "lang": None if what == "read" else rng.choice(["en", "de", "fr"]), "body": f"m{at}" if what == "say" else None})
    return rows


def test_live_fan_out_equals_the_batch_queries(rocks, tmp_path):
    rng = random.Random(11)
    schema = "talk string, shard int, viewer string, seq long, lang string, body string, what string, at long"
    for k in range(3):
        rows = watched(rng, 250)
        table = rocks.createDataFrame([tuple(r.values()) for r in rows], WATCHED).withColumnRenamed("at", "seq")
        fed = pubsub.delivered(table.where("what = 'say'"), table.where("what = 'setlang'")).cache()
        want = sorted(map(tuple, pubsub.bounded(fed, table.where("what = 'read'"), 3).collect()))
        assert {r[3] for r in want} == {True, False}
        for _ in range(4):
            got = replayed(lambda: keyed.Viewers(schema, 3, 5, None, None), [tuple(r.values())[1:] for r in rows], WATCHED.replace(",", "").split()[2::2], cuts_of(rng, len(rows)))
            assert sorted(("x", v, seq, what == "dropped") for _, v, seq, _, _, what, _ in got if what in ("queued", "dropped")) == want
            queued = sorted((v, seq) for _, v, seq, _, _, what, _ in got if what == "queued")
            read = sorted((v, seq) for _, v, seq, _, _, what, _ in got if what == "read")
            assert set(read) <= set(queued) and len(read) == len(set(read))
            last = {v: max((r["at"] for r in rows if r["viewer"] == v and r["what"] == "read"), default=-1) for v in "abc"}
            assert read == [(v, s) for v, s in queued if s < last[v]]
        if k == 0:
            out = streamed(rocks, tmp_path, "seen", rows, WATCHED, lambda s: keyed.fan_out(s, 3, 5, shards=3))
            both = out.where("what in ('queued', 'dropped')").selectExpr("talk", "viewer", "seq", "what = 'dropped'")
            assert sorted(map(tuple, both.collect())) == want


def test_snapshots_and_switches():
    schema = "talk string, shard int, viewer string, seq long, lang string, body string, what string, at long"
    columns = WATCHED.replace(",", "").split()[2::2]
    rows = [(i, "say", None, ["en", "de"][i % 2], f"m{i}") for i in range(8)] + [(8, "attach", "a", "de", None), (9, "say", None, None, "ctl"), (10, "say", None, "fr", "x"), (11, "setlang", "a", "fr", None), (12, "say", None, "fr", "y"), (13, "detach", "a", None, None), (14, "say", None, "fr", "z")]
    got = [(r[2], r[5], r[6]) for r in replayed(lambda: keyed.Viewers(schema, 9, 6, "en", None), rows, columns, [5, 9])]
    assert got == [*((i, "snapshot", 8) for i in range(2, 8)), (9, "queued", 9), *((i, "snapshot", 11) for i in (4, 6, 10)), (12, "queued", 12)]
