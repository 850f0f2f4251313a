"""From hypotheses to committed words, from words to segments, and what segments say."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.config import STOP_TERMS, Knobs
from lectern.functions import text as X
from lectern.operators.folds import fold

_NOT_WORD = re.compile(r"[^\w]")
_CLOSED = re.compile(r"""[.!?…]+[»"')\]]*$""")


def same_form(word: str) -> str:
    return _NOT_WORD.sub("", word.lower())


def agree_step(n: int):
    """Words on which the last n hypotheses agree are committed, in the newest spelling.

    State: the kept hypotheses, each a list of [text, t0, t1], without what is committed.
    """

    def step(kept, row):
        kept = [*kept, [[w["text"], float(w["t0"]), float(w["t1"])] for w in row.words]][-n:]
        if len(kept) < n:
            return kept, []
        agreed = 0
        for column in zip(*kept, strict=False):
            if len({same_form(w[0]) for w in column}) > 1:
                break
            agreed += 1
        out = [(row.poll, i, *w) for i, w in enumerate(kept[-1][:agreed])]
        return [h[agreed:] for h in kept], out

    return step


def committed(hypotheses: DataFrame, n: int = 2) -> DataFrame:
    """(talk, poll, pos, text, t0, t1) of hypotheses (talk, poll, words)."""
    kind = hypotheses.schema["talk"].dataType.simpleString()
    schema = f"talk {kind}, poll long, pos long, text string, t0 double, t1 double"
    return fold(hypotheses.select("talk", "poll", "words"), ["talk"], ["poll"], schema, list, agree_step(n))


def close_step(knobs: Knobs, unit: float = 1.0):
    """Segments close by pause, sentence end, length or a late comma. `unit` is a second in the words' time.

    State: [segment, its first word, words, t0, end of the last word], with 0 words between segments.
    """
    pause, span = knobs.pause_split * unit, knobs.max_segment * unit

    def step(state, row):
        sid, first, n, t0, end = state
        out = []
        if n and row.t0 - end >= pause:
            out.append((sid, first, n, t0, end, "pause"))
            n = 0
        if not n:
            sid, first, t0 = sid + 1, int(row.idx), row.t0
        n, end = n + 1, row.t1
        if _CLOSED.search(row.text) and n >= knobs.min_words:
            why = "sentence"
        elif n >= knobs.max_words:
            why = "words"
        elif end - t0 >= span:
            why = "span"
        elif row.text.endswith(",") and n >= knobs.clause_words:
            why = "clause"
        else:
            return [sid, first, n, t0, end], out
        return [sid, first, 0, t0, end], [*out, (sid, first, n, t0, end, why)]

    return step


def close_start() -> list:
    return [0, 0, 0, 0, 0]


def close_rest(state) -> list[tuple]:
    sid, first, n, t0, end = state
    return [(sid, first, n, t0, end, "open")] if n else []


def segments(words: DataFrame, knobs: Knobs = Knobs(), unit: float = 1.0) -> DataFrame:
    """(talk, sid, first, n, t0, t1, reason) of words (talk, idx, text, t0, t1); what is open at the end comes as such."""
    kind = words.schema["talk"].dataType.simpleString()
    time = words.schema["t0"].dataType.simpleString()
    schema = f"talk {kind}, sid long, first long, n long, t0 {time}, t1 {time}, reason string"
    return fold(words.select("talk", "idx", "text", "t0", "t1"), ["talk"], ["idx"], schema, close_start, close_step(knobs, unit), close_rest)


# -- the recogniser's buffer ----------------------------------------------------------------------

Word = list  # text, begin, end, probability


def poll_start() -> dict:
    return {"kept": [], "origin": 0, "buf": 0, "since": 0, "said": [], "partial": [], "audio": []}


def poll_step(knobs: Knobs, recognise, unit: float = 1.0):
    """The buffer of a streaming recogniser. `unit` is a second in the words' time.

    Rows: seq, what, samples, audio, at. A `feed` adds samples (and audio, which
    is data with an `end` last but one in each item, as words have), and once a
    chunk has come the whole buffer is recognised: recognise(row, audio, prompt,
    origin) gives the hypothesis as words. What the last hypotheses agree on is
    committed, and the buffer loses the sound up to its end; a buffer that grows
    too long keeps its newer half and forgets the hypotheses. `flush` commits
    the open tail; `reset` also empties the buffer, which then begins at `at`.

    Output: seq, what, committed words, open tail, origin, samples in the buffer.
    """
    rate = knobs.sample_rate / unit
    agree = agree_step(knobs.agreement_n)
    most = int(knobs.max_buffer * knobs.sample_rate)

    def step(state, row):
        s = dict(state)
        if row.what != "feed":
            tail = s["partial"]
            s |= {"partial": [], "kept": []}
            if row.what == "reset":
                s |= {"buf": 0, "origin": row.at, "since": 0, "said": [], "audio": []}
            return s, [(int(row.seq), row.what, tail, [], s["origin"], s["buf"])]
        s["audio"] = [*s["audio"], *([list(x) for x in row.audio] if row.audio is not None else [])]
        s["buf"] += int(row.samples)
        s["since"] += int(row.samples)
        if s["since"] < knobs.chunk * knobs.sample_rate or s["buf"] < 0.4 * knobs.sample_rate:
            return s, []
        s["since"] = 0
        heard = [list(w) for w in recognise(row, s["audio"], " ".join(s["said"][-40:]), s["origin"])]
        s["kept"], agreed = agree(s["kept"], _Poll(heard))
        new = heard[: len(agreed)]
        if new:
            s["said"] = [*s["said"], *(w[0] for w in new)][-60:]
            gone = int(max(0, new[-1][2] - s["origin"]) * rate)
            s["origin"] += gone / rate
            s["buf"] = max(0, s["buf"] - gone)
        if s["buf"] > most:
            s["origin"] += (s["buf"] - most // 2) / rate
            s["buf"], s["kept"] = most // 2, []
        s["audio"] = [x for x in s["audio"] if x[2] > s["origin"]]
        forms = {same_form(w[0]) for w in new}
        s["partial"] = [w for w in heard if same_form(w[0]) not in forms][-12:]
        return s, [(int(row.seq), "poll", new, s["partial"], s["origin"], s["buf"])]

    return step


class _Poll:
    """A hypothesis in the shape agree_step takes."""

    poll = 0

    def __init__(self, heard):
        self.words = [{"text": w[0], "t0": w[1], "t1": w[2]} for w in heard]


def polled(events: DataFrame, recognise, knobs: Knobs = Knobs(), unit: float = 1.0) -> DataFrame:
    """(talk, seq, what, stable, partial, origin, buf) of events (talk, seq, what, samples, audio, at)."""
    kind = events.schema["talk"].dataType.simpleString()
    schema = f"talk {kind}, seq long, what string, stable array<{POLL_WORD}>, partial array<{POLL_WORD}>, origin double, buf long"
    start, step = poll_start, poll_step(knobs, recognise, unit)
    return fold(events.select("talk", "seq", "what", "samples", "audio", "at"), ["talk"], ["seq"], schema, start, _typed(step))


POLL_WORD = "struct<text:string,t0:double,t1:double,p:double>"


def _typed(step):
    """Words of the output as Arrow takes them."""

    def run(state, row):
        state, out = step(state, _Plain(row))
        words = lambda ws: [{"text": w[0], "t0": float(w[1]), "t1": float(w[2]), "p": float(w[3])} for w in ws]
        return state, [(seq, what, words(a), words(b), float(origin), buf) for seq, what, a, b, origin, buf in out]

    return run


class _Plain:
    """A row whose audio items are lists."""

    def __init__(self, row):
        self.seq, self.what, self.samples, self.at = row.seq, row.what, row.samples, row.at
        self.audio = None if row.audio is None else [[*x.values()] if isinstance(x, dict) else list(x) for x in row.audio]


# -- live segments --------------------------------------------------------------------------------


def live_start() -> dict:
    return {"sid": 0, "open": None, "end": None, "spk": None}


def live_step(knobs: Knobs, unit: float = 1.0):
    """Segments as they grow: every message about them, with its rev. `unit` is a second in all times.

    Rows: seq, what, words (text, t0, t1, p), name, now. `stable` words are
    committed ones; `partial` words are shown behind what is committed and never
    close a segment; `floor` hands the floor to `name`, after the tail of the
    one before (words) is committed and their segment closed; `flush` closes;
    `tick` closes what has been open too long.

    Output: seq, t, sid, rev, final, stable, spk, spk_conf, text, tail, conf, t0, t1; t is `seg` or `floor`.
    """
    pause, span = knobs.pause_split * unit, knobs.max_segment * unit

    def fresh(s, now):
        s["sid"] += 1
        s["open"] = {"sid": s["sid"], "words": [], "rev": 0, "spk": s["spk"], "at": now}

    def event(s, seq, stable=True, final=False, tail=""):
        o = s["open"]
        o["rev"] += 1
        ws = o["words"]
        conf = sum(w[3] for w in ws) / len(ws) if ws else 0.0
        t0, t1 = (float(ws[0][1]), float(ws[-1][2])) if ws else (0.0, 0.0)
        out = (seq, "seg", o["sid"], o["rev"], final, stable, o["spk"], 1.0 if o["spk"] else 0.0, joined(ws), tail, conf, t0, t1)
        if final:
            s["open"] = None
        return out

    def push(s, row, out):
        for w in row.words:
            gap = w[1] - s["end"] if s["end"] is not None else 0
            s["end"] = w[2]
            if s["open"] is None:
                fresh(s, row.now)
            elif gap >= pause and s["open"]["words"]:
                out.append(event(s, row.seq, final=True))
                fresh(s, row.now)
            ws = s["open"]["words"]
            ws.append(list(w))
            n = len(ws)
            if (_CLOSED.search(w[0]) and n >= knobs.min_words) or n >= knobs.max_words or ws[-1][2] - ws[0][1] >= span or (w[0].endswith(",") and n >= knobs.clause_words):
                out.append(event(s, row.seq, final=True))
        if s["open"] and s["open"]["words"]:
            out.append(event(s, row.seq))

    def step(state, row):
        s = {**state, "open": state["open"] and {**state["open"], "words": [*state["open"]["words"]]}}
        out: list[tuple] = []
        held = s["open"] is not None and bool(s["open"]["words"])
        if row.what == "stable":
            push(s, row, out)
        elif row.what == "partial" and row.words:
            if s["open"] is None:
                fresh(s, row.now)
            out.append(event(s, row.seq, stable=False, tail=joined(row.words)))
        elif row.what == "flush" and held or row.what == "tick" and held and row.now - s["open"]["at"] >= span:
            out.append(event(s, row.seq, final=True))
        elif row.what == "floor":
            push(s, row, out)
            if s["open"] and s["open"]["words"]:
                out.append(event(s, row.seq, final=True))
            s["spk"], s["end"] = row.name, None
            out.append((row.seq, "floor", None, None, None, None, row.name, None, None, None, None, None, None))
        return s, out

    return step


def joined(ws: list[Word]) -> str:
    """Words with single spaces, none before punctuation."""
    return _BEFORE_MARK.sub(r"\1", " ".join(" ".join(w[0] for w in ws).split()))


_BEFORE_MARK = re.compile(r"\s+([,.!?;:…])")

LIVE = "seq long, t string, sid long, rev long, final boolean, stable boolean, spk string, spk_conf double, text string, tail string, conf double, t0 double, t1 double"


class LiveRow:
    """A row of live_step, with words as lists whatever Arrow made of them."""

    def __init__(self, seq, what, words, name, now):
        self.seq, self.what, self.now = seq, what, now
        self.name = name if isinstance(name, str) else None
        self.words = [[*x.values()] if isinstance(x, dict) else list(x) for x in (words if words is not None else ())]


def live_segments(events: DataFrame, knobs: Knobs = Knobs(), unit: float = 1.0) -> DataFrame:
    """All messages of a talk's segments, of events (talk, seq, what, words, name, now)."""
    kind = events.schema["talk"].dataType.simpleString()
    step = live_step(knobs, unit)
    rows = events.select("talk", "seq", "what", "words", "name", "now")
    return fold(rows, ["talk"], ["seq"], f"talk {kind}, {LIVE}", live_start, lambda state, row: step(state, LiveRow(int(row.seq), row.what, row.words, row.name, row.now)))


def pauses(words: DataFrame, speaker: str | None = None) -> DataFrame:
    """Time since the word before; 0 for the first one, of a talk or after a change of speaker."""
    order = Window.partitionBy("talk").orderBy("idx")
    before = F.lag("t1").over(order)
    if speaker:
        before = F.when(F.lag(speaker).over(order).eqNullSafe(F.col(speaker)), before)
    return words.withColumn("pause", F.coalesce(F.col("t0") - before, F.lit(0)))


def confidence(probs: Column) -> Column:
    """Mean probability of a segment's words; 0 for none."""
    every = F.aggregate(probs, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(probs) > 0, every / F.size(probs)).otherwise(0.0)


def open_tail(stable: DataFrame, latest: DataFrame, most: int = 12) -> DataFrame:
    """The last words of a hypothesis whose form is not among those just committed (talk, forms), wherever they stand."""
    rows = latest.join(stable, "talk", "left")
    forms = F.coalesce("forms", F.array())
    tail = F.filter("words", lambda w: ~F.array_contains(forms, X.norm(w["text"])))
    return rows.select("talk", F.when(F.size(tail) > most, F.slice(tail, -most, most)).otherwise(tail).alias("tail"))


def emitted(segments_: DataFrame) -> DataFrame:
    """Rows of a segment message: text with its open tail, stable length, rounded numbers; muted and empty ones go.

    segments_: talk, sid, text, tail, lang, conf, spk, spk_conf, t0, t1 (absolute), muted.
    """
    tidy = X.tidy(F.col("text"))
    return segments_.withColumn("text", tidy).where("text != '' and not muted").select(
        "talk",
        "sid",
        "spk",
        F.round("spk_conf", 2).alias("spk_conf"),
        F.round("t0", 2).alias("t0"),
        F.round("t1", 2).alias("t1"),
        F.concat_ws(" ", "text", F.when(F.col("tail") != "", F.col("tail"))).alias("text"),
        F.char_length("text").cast("long").alias("stable_len"),
        F.coalesce("lang", F.lit("auto")).alias("lang"),
        F.round("conf", 3).alias("conf"),
    )


def stats(segments_: DataFrame) -> DataFrame:
    """Per talk: duration, words, segments."""
    n = F.size(X.tokens(F.coalesce("text", F.lit("")))).cast("long")
    return segments_.groupBy("talk").agg(
        (F.max_by("t1", "sid") - F.min_by("t0", "sid")).alias("duration"), F.sum(n).alias("words"), F.count(F.lit(1)).alias("segments")
    )


def speaker_share(segments_: DataFrame) -> DataFrame:
    """Segments of each named speaker of a talk, their share in whole percent, and their place: most first, then who spoke first."""
    by = segments_.where("spk is not null").groupBy("talk", "spk").agg(F.count(F.lit(1)).alias("n"), F.min("sid").alias("__first"))
    talk = Window.partitionBy("talk")
    shared = by.withColumn("total", F.sum("n").over(talk)).withColumn("percent", F.bround(100 * F.col("n") / F.col("total")).cast("long"))
    return shared.withColumn("place", F.row_number().over(talk.orderBy(F.desc("n"), "__first")).cast("long")).drop("__first")


def top_terms(segments_: DataFrame, keys: list[str], considered: int = 40, kept: int = 10, stop=STOP_TERMS) -> DataFrame:
    """The most frequent terms, earlier ones first among equals; stop terms go after the first cut."""
    found = segments_.select(*keys, "sid", F.posexplode(X.terms(F.coalesce("text", F.lit("")))).alias("pos", "term"))
    counts = found.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("sid", "pos")).alias("__first"))
    by = Window.partitionBy(*keys)
    ranked = counts.withColumn("__r", F.row_number().over(by.orderBy(F.desc("n"), "__first"))).where(F.col("__r") <= considered)
    rest = ranked.where(~F.col("term").isin(*stop)).withColumn("place", F.row_number().over(by.orderBy("__r")).cast("long"))
    return rest.where(F.col("place") <= kept).select(*keys, "place", "term", "n")


def excerpts(segments_: DataFrame, terms: DataFrame, most: int = 6, least_words: int = 6) -> DataFrame:
    """For each of the first terms of a talk the first segment that holds it and isn't taken yet.

    The candidates of a talk come as one array of (term's place, segments that
    hold it, in order), folded once.
    """
    texts = segments_.where(F.size(X.tokens(F.coalesce("text", F.lit("")))) >= least_words).select("talk", "sid", F.lower("text").alias("low"))
    hits = texts.join(terms.where(F.col("place") <= most).select("talk", "place", "term"), "talk").where(F.contains("low", "term"))
    lists = hits.groupBy("talk", "place", "term").agg(F.array_sort(F.collect_list("sid")).alias("sids"))
    by_talk = lists.groupBy("talk").agg(F.array_sort(F.collect_list(F.struct("place", "term", "sids"))).alias("all"))
    none = F.lit([]).cast("array<struct<place:bigint,term:string,sid:bigint>>")

    def take(done, x):
        free = F.filter(x["sids"], lambda s: ~F.exists(done, lambda d: d["sid"] == s))
        pick = F.array(F.struct(x["place"].alias("place"), x["term"].alias("term"), F.try_element_at(free, F.lit(1)).alias("sid")))
        return F.when(F.size(free) > 0, F.concat(done, pick)).otherwise(done)

    return by_talk.select("talk", F.explode(F.aggregate("all", none, take)).alias("x")).select("talk", "x.place", "x.term", "x.sid")


def packed(segments_: DataFrame, most: int = 6000) -> DataFrame:
    """(talk, sid, chunk): segments packed in order into chunks of at most `most` characters, one line at least.

    A line is the text with its speaker in front; line feeds between are not counted.
    """
    line = F.concat(F.when(F.col("spk").isNotNull() & (F.col("spk") != ""), F.concat(F.lit("["), "spk", F.lit("] "))).otherwise(""), F.coalesce("text", F.lit("")))
    sized = segments_.select("talk", "sid", F.char_length(line).cast("long").alias("n"))
    by_talk = sized.groupBy("talk").agg(F.array_sort(F.collect_list(F.struct("sid", "n"))).alias("all"))
    start = F.struct(
        F.lit(0).cast("long").alias("chunk"), F.lit(0).cast("long").alias("used"), F.lit(False).alias("any"), F.lit([]).cast("array<struct<sid:bigint,chunk:bigint>>").alias("out")
    )

    def put(s, x):
        over = s["any"] & (s["used"] + x["n"] > most)
        chunk = s["chunk"] + over.cast("long")
        return F.struct(
            chunk.alias("chunk"),
            (F.when(over, 0).otherwise(s["used"]) + x["n"]).cast("long").alias("used"),
            F.lit(True).alias("any"),
            F.concat(s["out"], F.array(F.struct(x["sid"].alias("sid"), chunk.alias("chunk")))).alias("out"),
        )

    return by_talk.select("talk", F.explode(F.aggregate("all", start, put)["out"]).alias("x")).select("talk", "x.sid", "x.chunk")
