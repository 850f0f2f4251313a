"""Stateful operators with state of their own kind: outboxes, speaker revisions, lazy translation, live viewers.

State is kept entry by entry (maps by message, segment or viewer), so a batch
writes what it changes, not all that a talk has. All take their events in one
stream, as a union of what belongs to a key in its order; within a batch rows
are put in order, between batches the source keeps it. They need the RocksDB
state store. With a ttl_ms the entries of a talk that has fallen silent go.
"""

from __future__ import annotations

import json
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from lectern.config import Knobs
from lectern.operators import speakers
from lectern.plans import voices


class Keyed(StatefulProcessor):
    """Hands each row of a key to `take`, in order; subclasses open their state in `init`."""

    def __init__(self, schema: str, order: str, ttl_ms: int | None):
        self.names, self.order, self.ttl_ms = StructType.fromDDL(schema).fieldNames(), order, ttl_ms

    def begin(self) -> None:
        """Before the rows of a key in a batch."""

    def take(self, row) -> list[tuple]:
        raise NotImplementedError

    def done(self) -> None:
        """After them."""

    def handleInputRows(self, key, rows, timerValues):
        batch, out = pd.concat(list(rows)).sort_values(self.order, kind="stable"), []
        self.begin()
        for row in batch.itertuples(index=False):
            out += self.take(row)
        self.done()
        yield pd.DataFrame([(*key, *o) for o in out], columns=self.names)

    def close(self) -> None:
        pass


def run(rows: DataFrame, keys: list[str], schema: str, processor: Keyed) -> DataFrame:
    mode = "None" if processor.ttl_ms is None else "ProcessingTime"
    return rows.groupBy(*keys).transformWithStateInPandas(processor, outputStructType=StructType.fromDDL(schema), outputMode="Append", timeMode=mode)


# -- store and forward ----------------------------------------------------------------------------


class Outbox(Keyed):
    """Numbers messages, keeps the last `room` that aren't acknowledged, sends while the link is up and all that is kept when it comes back."""

    def __init__(self, schema: str, room: int, ttl_ms: int | None):
        super().__init__(schema, "at", ttl_ms)
        self.room = room

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("counts", "last long, low long, dropped long, up boolean", self.ttl_ms)
        self.waiting = handle.getMapState("waiting", "no long", "body string", self.ttl_ms)

    def begin(self):
        self.last, self.low, self.dropped, self.up = self.kept.get() if self.kept.exists() else (0, 1, 0, False)

    def done(self):
        self.kept.update((self.last, self.low, self.dropped, self.up))

    def _drop_upto(self, no: int) -> None:
        for old in range(self.low, min(no, self.last) + 1):
            self.waiting.removeKey((old,))
        self.low = max(self.low, min(no, self.last) + 1)

    def take(self, row):
        out = []
        if row.what == "send":
            if self.last - self.low + 1 >= self.room:
                self._drop_upto(self.low)
                self.dropped += 1
            self.last += 1
            self.waiting.updateValue((self.last,), (row.body,))
            out = [(int(row.at), self.last, row.body, False, self.dropped)] if self.up else []
        elif row.what == "ack":
            self._drop_upto(int(row.ack))
        elif row.what == "up":
            self.up = True
            out = [(int(row.at), no, self.waiting.getValue((no,))[0], True, self.dropped) for no in range(self.low, self.last + 1)]
        elif row.what == "down":
            self.up = False
        return out


def outbox(events: DataFrame, room: int = 5_000, ttl_ms: int | None = None) -> DataFrame:
    """(talk, at, no, body, resent, dropped): what goes over the link, and when; dropped counts what the full outbox has lost so far.

    events: (talk, at, what, body, ack), what being send, ack (of all up to
    that number), up or down.
    """
    schema = f"talk {events.schema['talk'].dataType.simpleString()}, at long, no long, body string, resent boolean, dropped long"
    return run(events.select("talk", "at", "what", "body", "ack"), ["talk"], schema, Outbox(schema, room, ttl_ms))


# -- who speaks -----------------------------------------------------------------------------------


def _rounded(x: float) -> float:
    """To two decimals as Spark rounds: halves of the number as it is written go up."""
    return float(Decimal(repr(x)).quantize(Decimal("0.01"), ROUND_HALF_UP))


class Revisions(Keyed):
    """Labels each segment as it comes, and relabels all segments of a voice that turns out to be another."""

    def __init__(self, schema: str, knobs: Knobs, enrolled: dict | None, ttl_ms: int | None):
        super().__init__(schema, "sid", ttl_ms)
        self.knobs, self.enrolled = knobs, enrolled
        self.step = voices._with_rows(voices.attribute_step(knobs))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("voices", "json string", self.ttl_ms)
        self.carried = handle.getMapState("carried", "voice string, sid long", "rev long, spk string, conf double", self.ttl_ms)

    def begin(self):
        self.registry = json.loads(self.known.get()[0]) if self.known.exists() else speakers.Registry.empty(self.enrolled)

    def done(self):
        self.known.update((json.dumps(self.registry),))

    def take(self, row):
        sid, rev, was, before = int(row.sid), int(row.rev), row.spk, self.registry["alias"]
        self.registry, [(_, voice, shown, conf, at, *_)] = self.step(self.registry, row)
        out = []
        if shown is not None:
            if shown != was:
                rev += 1
                out.append((sid, 2 * sid, rev, was, shown, _rounded(conf), "online", at))
            self.carried.updateValue((voice, sid), (rev, shown, conf))
        for old, new in self.registry["alias"].items():
            if before.get(old) != new:
                out += self._renamed(old, new, 2 * sid + 1)
        return out

    def _renamed(self, old: str, new: str, seq: int):
        """All segments that carry a voice get another one."""
        for (voice, sid), (rev, spk, conf) in [x for x in self.carried.iterator() if x[0][0] == old]:
            self.carried.removeKey((voice, sid))
            if spk != new:
                rev += 1
                yield sid, seq, rev, spk, new, _rounded(conf), "merge", None
            self.carried.updateValue((new, sid), (rev, new, conf))


def revisions(segments: DataFrame, knobs: Knobs = Knobs(), enrolled: dict | None = None, ttl_ms: int | None = None) -> DataFrame:
    """(talk, sid, seq, rev, was, spk, spk_conf, src, change_at): the `spk` messages of final segments (talk, sid, rev, spk, wins), merges included."""
    schema = f"talk {segments.schema['talk'].dataType.simpleString()}, sid long, seq long, rev long, was string, spk string, spk_conf double, src string, change_at double"
    own = segments.select("talk", "sid", "rev", "spk", "wins")
    return run(own, ["talk"], schema, Revisions(schema, knobs, enrolled, ttl_ms))


# -- translation on demand ------------------------------------------------------------------------


class LazyTranslation(Keyed):
    """Asks for translations of fresh finals into the languages that are listened to, and of the last finals when one gets its first listener."""

    def __init__(self, schema: str, backlog: int, ttl_ms: int | None):
        super().__init__(schema, "seq", ttl_ms)
        self.backlog = backlog

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.segments = handle.getMapState("segments", "sid long", "rev long, final boolean, lang string, text string", self.ttl_ms)
        self.cache = handle.getMapState("cache", "sid long, lang string", "rev long", self.ttl_ms)
        self.heard = handle.getMapState("heard", "lang string", "n long", self.ttl_ms)

    def _ask(self, seq: int, sid: int, rev: int, own: str | None, text: str, lang: str, live: bool) -> tuple:
        have = self.cache.getValue((sid, lang)) if self.cache.containsKey((sid, lang)) else None
        hit = have is not None and have[0] >= rev
        if not hit:
            self.cache.updateValue((sid, lang), (rev,))
        return seq, sid, rev, lang, own, text, hit, live

    def take(self, row):
        seq = int(row.seq)
        if row.what in ("seg", "edit"):
            return self._said(row, seq)
        n = self.heard.getValue((row.lang,))[0] if self.heard.containsKey((row.lang,)) else 0
        n = n + 1 if row.what == "attach" else max(0, n - 1)
        if n:
            self.heard.updateValue((row.lang,), (n,))
        elif self.heard.containsKey((row.lang,)):
            self.heard.removeKey((row.lang,))
        if row.what != "attach" or n != 1:
            return []
        finals = sorted((sid, rev, own, text) for (sid,), (rev, final, own, text) in self.segments.iterator() if final)
        return [self._ask(seq, sid, rev, own, text, row.lang, False) for sid, rev, own, text in finals[-self.backlog :] if own != row.lang]

    def _said(self, row, seq):
        sid = int(row.sid)
        old = self.segments.getValue((sid,)) if self.segments.containsKey((sid,)) else None
        if row.what == "edit":
            if old is None:
                return []
            rev, final, own = old[0] + 1, True, old[2]
            for (s, lang), _ in [x for x in self.cache.iterator() if x[0][0] == sid]:
                self.cache.removeKey((s, lang))
        else:
            rev, final, own = int(row.rev), bool(row.final), row.lang
            if old is not None and old[0] >= rev:
                return []
        self.segments.updateValue((sid,), (rev, final, own, row.text))
        if not final or (row.what == "seg" and not row.stable):
            return []
        return [self._ask(seq, sid, rev, own, row.text, lang, True) for (lang,), _ in sorted(self.heard.iterator()) if lang != own]


def asked(events: DataFrame, backlog: int = 30, ttl_ms: int | None = None) -> DataFrame:
    """(talk, seq, sid, rev, lang, own_lang, text, hit, live): translations that are asked for, when, and whether they are there already.

    events: (talk, seq, what, sid, rev, lang, text, final, stable), what being
    seg, edit, attach or detach. Those asked for by a first listener aren't
    published (live is false). What is no hit goes to the engine.
    """
    schema = f"talk {events.schema['talk'].dataType.simpleString()}, seq long, sid long, rev long, lang string, own_lang string, text string, hit boolean, live boolean"
    own = events.select("talk", "seq", "what", "sid", "rev", "lang", "text", "final", "stable")
    return run(own, ["talk"], schema, LazyTranslation(schema, backlog, ttl_ms))


# -- viewers --------------------------------------------------------------------------------------


class Viewers(Keyed):
    """A bounded queue for each viewer, filled with the messages of the topics that the viewer has chosen."""

    def __init__(self, schema: str, room: int, shown: int, source_lang: str | None, ttl_ms: int | None):
        super().__init__(schema, "at", ttl_ms)
        self.room, self.shown, self.source_lang = room, shown, source_lang

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.viewers = handle.getMapState("viewers", "viewer string", "lang string, waiting long", self.ttl_ms)
        self.queue = handle.getMapState("queue", "viewer string, place long", "seq long, lang string, body string", self.ttl_ms)
        self.recent = handle.getListState("recent", "seq long, lang string, body string", self.ttl_ms)

    def begin(self):
        self.now = {v: [lang, n] for (v,), (lang, n) in self.viewers.iterator()}
        self.last = list(self.recent.get()) if self.recent.exists() else []
        self.touched: set[str] = set()

    def done(self):
        for viewer in self.touched:
            if viewer in self.now:
                self.viewers.updateValue((viewer,), tuple(self.now[viewer]))
            elif self.viewers.containsKey((viewer,)):
                self.viewers.removeKey((viewer,))
        self.recent.put(self.last) if self.last else self.recent.clear()

    def _wants(self, lang: str | None, message: str | None) -> bool:
        return message is None or message == lang or (self.source_lang is not None and message == self.source_lang)

    def take(self, row):
        seq, viewer = int(row.at), row.viewer
        if row.what == "say":
            return self._said(seq, row.lang, row.body)
        self.touched.add(viewer)
        out = []
        if row.what in ("attach", "setlang"):
            same = viewer in self.now and self.now[viewer][0] == row.lang
            self.now[viewer] = [row.lang, self.now.get(viewer, [None, 0])[1]]
            if row.what == "attach" or not same:
                shown = [x for x in self.last if self._wants(row.lang, x[1])]
                out = [(viewer, s, lang, body, "snapshot", seq) for s, lang, body in shown]
        elif row.what in ("read", "detach") and viewer in self.now:
            for place in range(self.now[viewer][1]):
                if row.what == "read":
                    s, lang, body = self.queue.getValue((viewer, place))
                    out.append((viewer, s, lang, body, "read", seq))
                self.queue.removeKey((viewer, place))
            self.now[viewer][1] = 0
            if row.what == "detach":
                del self.now[viewer]
        return out

    def _said(self, seq, lang, body):
        out = []
        for viewer, (own, n) in sorted(self.now.items()):
            if self._wants(own, lang):
                room = n < self.room
                if room:
                    self.queue.updateValue((viewer, n), (seq, lang, body))
                    self.now[viewer][1] = n + 1
                    self.touched.add(viewer)
                out.append((viewer, seq, lang, body, "queued" if room else "dropped", seq))
        if lang is not None:
            self.last = [*self.last, (seq, lang, body)][-self.shown :] if self.shown else []
        return out


def fan_out(events: DataFrame, room: int = 500, shown: int = 40, source_lang: str | None = None, shards: int = 1, ttl_ms: int | None = None) -> DataFrame:
    """(talk, viewer, seq, lang, body, what, at): what happens to each message for each viewer: queued, dropped as the queue is full, read, or in a snapshot.

    events: (talk, at, what, viewer, lang, body), what being say (a message of
    a language, of all if null), attach, setlang, read (all that waits) or
    detach. A talk of very many viewers is dealt into shards, each of which
    gets the messages.
    """
    schema = f"talk {events.schema['talk'].dataType.simpleString()}, shard int, viewer string, seq long, lang string, body string, what string, at long"
    every = F.sequence(F.lit(0), F.lit(shards - 1))
    own = F.pmod(F.xxhash64(F.col("viewer").cast("string")), F.lit(shards)).cast("int")
    rows = events.select("talk", "at", "what", F.col("viewer").cast("string").alias("viewer"), "lang", "body", F.explode(F.when(F.col("what") == "say", every).otherwise(F.array(own))).alias("shard"))
    return run(rows, ["talk", "shard"], schema, Viewers(schema, room, shown, source_lang, ttl_ms)).drop("shard")

