"""The revisioned log: what is current, what is stale, what is still to be translated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.schema import SEG_DEFAULTS

KEY = ["talk", "sid"]
#: What a `seg` message says of its segment beside text and speaker, and what it is where the message doesn't say.
OWN = {c: SEG_DEFAULTS.get(c) for c in ("final", "stable", "lang", "conf", "t0", "t1", "emitted_at")}


def judged(messages: DataFrame) -> DataFrame:
    """`seg`, `spk` and `edit` messages since a segment's first `seg`, with `accepted`, and `rev` as it is after them.

    A `seg` or `spk` message is accepted if its rev is above the segment's, so a
    late one never takes effect, and a speaker named before the segment is lost.
    An edit has no rev of its own and raises the segment's by one.

    With e the edits so far, the segment's rev less e is the highest of rev - e
    of all messages before, so no fold is needed.
    """
    order = Window.partitionBy(*KEY).orderBy("seq")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    edit = F.col("t") == "edit"
    own = messages.where(F.col("t").isin("seg", "spk", "edit"))
    begun = own.withColumn("__begun", F.max(F.col("t") == "seg").over(upto)).where("__begun").drop("__begun")
    rows = begun.withColumn("__e", F.sum(edit.cast("int")).over(upto))
    rows = rows.withColumn("__net", F.when(~edit, F.col("rev") - F.col("__e")))
    high = F.max("__net").over(before)
    accepted = edit | high.isNull() | (F.col("__net") > high)
    rows = rows.withColumns({"accepted": accepted, "__high": F.max("__net").over(upto)})
    return rows.withColumn("rev", F.when(edit, (F.col("__high") + F.col("__e")).cast(messages.schema["rev"].dataType)).otherwise(F.col("rev"))).drop("__e", "__net", "__high")


def current_segments(messages: DataFrame) -> DataFrame:
    """The last accepted `seg` as a whole, the speaker of the last accepted message that names one, the text of the last edit or `seg`."""
    rows = judged(messages).where("accepted")
    said = {c: d for c, d in OWN.items() if c in messages.columns}
    named = ["spk", *(["spk_conf"] if "spk_conf" in messages.columns else [])]
    when = lambda *kinds: F.when(F.col("t").isin(*kinds), F.col("seq"))
    last = rows.groupBy(*KEY).agg(
        F.max("rev").alias("rev"),
        F.max_by(F.struct(*said), when("seg")).alias("__s"),
        F.max_by(F.struct("text"), when("seg", "edit")).alias("__text"),
        F.max_by(F.struct(*named), when("seg", "spk")).alias("__spk"),
    )
    or_else = lambda c, d: (F.col(c) if d is None else F.coalesce(F.col(c), F.lit(d))).alias(c.split(".")[1])
    speaker = [or_else(f"__spk.{c}", 0.0 if c == "spk_conf" else None) for c in named]
    return last.select(*KEY, "rev", *(or_else(f"__s.{c}", d) for c, d in said.items()), or_else("__text.text", ""), *speaker)


def stale(messages: DataFrame) -> DataFrame:
    return judged(messages).where(~F.col("accepted")).drop("accepted")


def edit_messages(messages: DataFrame) -> DataFrame:
    """For each edit the `seg` message that tells of it: final and stable, with language, speaker and times as they were then."""
    upto = Window.partitionBy(*KEY).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = judged(messages).where("accepted")
    as_of = lambda c, *kinds: F.last(F.when(F.col("t").isin(*kinds), F.struct(c)), ignorenulls=True).over(upto)[c].alias(f"__{c}")
    times = [as_of(c, "seg") for c in ("t0", "t1") if c in messages.columns]
    known = rows.select("talk", "sid", "seq", "rev", "t", "text", as_of("lang", "seg"), as_of("spk", "seg", "spk"), *times)
    return known.where("t = 'edit'").select(
        F.lit("seg").alias("t"), *KEY, "seq", "rev", F.lit(True).alias("final"), F.lit(True).alias("stable"),
        F.col("__lang").alias("lang"), F.col("__spk").alias("spk"), "text", F.char_length("text").cast("long").alias("stable_len"),
        *(F.col(f"__{c}").alias(c) for c in ("t0", "t1") if c in messages.columns),
    )


def translations_kept(messages: DataFrame) -> DataFrame:
    """The last `tr` message of each (talk, sid, lang) since the last edit of its segment: talk, sid, lang, rev, text."""
    edited = judged(messages).where("t = 'edit'").groupBy(*KEY).agg(F.max("seq").alias("__at"))
    own = messages.where("t = 'tr'").join(edited, KEY, "left").where("__at is null or seq > __at")
    return latest(own, [*KEY, "lang"], "seq", ["rev", "text"])


def upsert_talks(updates: DataFrame, columns: list[str]) -> DataFrame:
    """Each column's last value that is not null; `started` is the first update; a talk is `live` until it is said to be otherwise."""
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))) for c in columns]
    last = [(F.coalesce(x, F.lit("live")) if c == "state" else x).alias(c) for c, x in zip(columns, last, strict=True)]
    return updates.groupBy("talk").agg(F.min("seq").alias("started"), *last)


def latest(rows: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """The row of each key that came last."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("__r")).select(*keys, *(f"__r.{c}" for c in columns))


def transcript(segments: DataFrame, since: int | None = None, finals_only: bool = True) -> DataFrame:
    kept = segments if since is None else segments.where(F.col("sid") > since)
    return kept.where("final") if finals_only else kept


def translated(segments: DataFrame, translations: DataFrame, lang: str, since: int | None = None) -> DataFrame:
    """Final segments with their translation, whatever its rev, else the original."""
    own = translations.where(F.col("lang") == lang).select(*KEY, F.col("text").alias("__tr"))
    rows = transcript(segments, since).join(own, KEY, "left")
    times = [c for c in ("t0", "t1") if c in segments.columns]
    return rows.select(*KEY, "rev", "spk", *times, F.coalesce("__tr", "text").alias("text"), F.col("__tr").isNull().alias("untranslated"))


def cache_misses(wanted: DataFrame, translations: DataFrame) -> DataFrame:
    """Of (talk, sid, lang, rev), those without a translation of that rev or a later one."""
    have = translations.select(*KEY, "lang", F.col("rev").alias("__rev"))
    same = [wanted[c] == have[c] for c in (*KEY, "lang")]
    return wanted.join(have, [*same, have["__rev"] >= wanted["rev"]], "left_anti")


def to_translate(messages: DataFrame) -> DataFrame:
    """Fresh final stable `seg` messages."""
    return judged(messages).where("accepted and t = 'seg' and final and stable").drop("accepted")


def last_rows(rows: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.withColumn("__n", rank).where(F.col("__n") <= n).drop("__n")


def unmuted(rows: DataFrame, is_mute: Column, is_unmute: Column) -> DataFrame:
    """Rows whose talk isn't muted by the last switch before them; switches themselves go."""
    upto = Window.partitionBy("talk").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    switch = F.when(is_mute, F.lit(True)).when(is_unmute, F.lit(False))
    muted = F.coalesce(F.last(switch, ignorenulls=True).over(upto), F.lit(False))
    return rows.withColumn("__muted", muted).where(~F.col("__muted") & ~is_mute & ~is_unmute).drop("__muted")


def pending(sent: DataFrame, acks: DataFrame, room: int) -> DataFrame:
    """Messages above the highest acknowledged seq; of more than `room` the newest, and the number dropped."""
    top = acks.groupBy("talk").agg(F.max("ack").alias("__ack"))
    open_ = sent.join(top, "talk", "left").where(F.col("seq") > F.coalesce("__ack", F.lit(-1)))
    by = Window.partitionBy("talk")
    rows = open_.withColumn("__n", F.row_number().over(by.orderBy(F.desc("seq")))).withColumn("dropped", F.greatest(F.count("seq").over(by) - room, F.lit(0)))
    return rows.where(F.col("__n") <= room).select("talk", "seq", "dropped")


def transmissions(events: DataFrame, room: int) -> DataFrame:
    """(talk, at, no, body, resent, dropped): what a store-and-forward link sends, and when.

    events: (talk, at, what, body, ack), what being send, ack (of all messages
    up to that number), up or down. Messages are numbered from 1; the last
    `room` that aren't acknowledged are kept, and sent again when the link comes
    up. All that is a running highest or count, so no fold is needed.
    """
    upto = Window.partitionBy("talk").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_ = lambda *k: F.col("what").isin(*k)
    rows = events.withColumns({"no": F.count(F.when(is_("send"), 1)).over(upto), "acked": F.coalesce(F.max(F.when(is_("ack"), F.col("ack"))).over(upto), F.lit(0))})
    rows = rows.withColumn("up", F.coalesce(F.last(F.when(is_("up", "down"), is_("up")), ignorenulls=True).over(upto), F.lit(False)))
    rows = rows.withColumn("dropped", F.count(F.when(is_("send") & (F.col("acked") <= F.col("no") - 1 - room), 1)).over(upto))
    sent = rows.where(is_("send"))
    first = sent.where("up").select("talk", "at", "no", "body", F.lit(False).alias("resent"), "dropped")
    low = F.greatest("acked", F.col("no") - room) + 1
    again = rows.where(is_("up")).where(low <= F.col("no")).select("talk", "at", F.explode(F.sequence(low, F.col("no"))).alias("no"), "dropped")
    again = again.join(sent.select("talk", "no", "body"), ["talk", "no"]).select("talk", "at", "no", "body", F.lit(True).alias("resent"), "dropped")
    return first.unionByName(again)


def relabelled(sent: DataFrame, labels: DataFrame) -> DataFrame:
    """`spk` messages of late labels (talk, sid, seq, spk, spk_conf, src) for sent segments (talk, sid, rev, spk).

    A label of an unknown segment, or one that changes nothing, goes; each
    other one raises the segment's rev by one.
    """
    by = Window.partitionBy(*KEY).orderBy("seq")
    known = labels.join(sent.select(*KEY, F.col("rev").alias("__rev"), F.col("spk").alias("__spk")), KEY)
    first = F.row_number().over(by) == 1
    was = F.when(first, F.col("__spk")).otherwise(F.lag("spk").over(by))
    changed = known.withColumn("was", was).where(~F.col("was").eqNullSafe(F.col("spk")))
    rev = F.col("__rev") + F.row_number().over(by)
    return changed.select(*KEY, "seq", rev.alias("rev"), "was", "spk", F.round("spk_conf", 2).alias("spk_conf"), "src")


def last_labels(sent: DataFrame, changes: DataFrame) -> DataFrame:
    """Sent segments with the rev, speaker and confidence of their last change."""
    last = changes.groupBy(*KEY).agg(F.max_by(F.struct(F.col("rev").alias("r"), F.col("spk").alias("s")), "seq").alias("__l"))
    rows = sent.join(last, KEY, "left")
    return rows.withColumns({"rev": F.coalesce("__l.r", "rev"), "spk": F.when(F.col("__l").isNull(), F.col("spk")).otherwise(F.col("__l.s"))}).drop("__l")


def translation_counters(asked: DataFrame) -> DataFrame:
    """Per talk: answers from the cache, calls of the engine that came back and their characters, and errors; asked: (talk, text, hit, failed)."""
    call = ~F.col("hit") & ~F.col("failed")
    return asked.groupBy("talk").agg(
        F.count_if("hit").alias("hits"),
        F.count_if(call).alias("calls"),
        F.sum(F.when(call, F.char_length("text")).otherwise(0)).alias("chars"),
        F.count_if(~F.col("hit") & F.col("failed")).alias("errors"),
    )
