"""All queries over the driver's tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern import config
from lectern.config import Knobs
from lectern.functions import text as X
from lectern.functions import vectors as V
from lectern.operators import floor, pubsub, revlog, scoring, speakers, timeline, words
from lectern.plans import edge
from lectern.session import materialised
from lectern.sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

KNOBS = Knobs()
#: The embeddings' labels tell nothing and no two are alike by the default, so their queries link at this cosine.
LOOSE = 0.3
DIM = 64


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# -- the log --------------------------------------------------------------------------------------


def _current(spark, sf):
    return revlog.current_segments(T.messages(spark, sf))


@query(f"WITH {T.CURRENT} SELECT talk, sid, rev, final, stable, lang, text, spk, spk_conf, conf, t0, t1, emitted_at FROM cur")
def current_segments(spark, sf):
    return _current(spark, sf)


@query(f"WITH {T.JUDGED} SELECT talk, sid, seq, t, rev FROM judged WHERE NOT accepted")
def stale_messages(spark, sf):
    return revlog.stale(T.messages(spark, sf)).select("talk", "sid", "seq", "t", "rev")


@query(f"""WITH {T.MSG}, u AS (
    SELECT talk, seq, CASE WHEN seq % 5 = 0 THEN text END AS title, CASE WHEN seq % 7 = 0 THEN lang END AS src_lang, CASE WHEN seq % 11 = 0 THEN 'ended' WHEN seq % 4 = 0 THEN 'live' END AS state FROM msg
) SELECT talk, min(seq) AS started, arg_max(title, seq) FILTER (WHERE title IS NOT NULL) AS title, arg_max(src_lang, seq) FILTER (WHERE src_lang IS NOT NULL) AS src_lang,
         coalesce(arg_max(state, seq) FILTER (WHERE state IS NOT NULL), 'live') AS state FROM u GROUP BY talk""")
def talk_upsert(spark, sf):
    return revlog.upsert_talks(_updates(spark, sf), ["title", "src_lang", "state"])


def _updates(spark, sf):
    return T.messages(spark, sf).selectExpr(
        "talk", "seq", "case when seq % 5 = 0 then text end as title", "case when seq % 7 = 0 then lang end as src_lang", "case when seq % 11 = 0 then 'ended' when seq % 4 = 0 then 'live' end as state"
    )


@query(f"""WITH {T.MSG}, u AS (
    SELECT talk, seq, CASE WHEN seq % 5 = 0 THEN text END AS title, CASE WHEN seq % 7 = 0 THEN lang END AS src_lang, CASE WHEN seq % 11 = 0 AND talk % 3 = 0 THEN 'ended' END AS state FROM msg
) SELECT talk, min(seq) AS started, arg_max(title, seq) FILTER (WHERE title IS NOT NULL) AS title, arg_max(src_lang, seq) FILTER (WHERE src_lang IS NOT NULL) AS src_lang,
         coalesce(arg_max(state, seq) FILTER (WHERE state IS NOT NULL), 'live') AS state FROM u GROUP BY talk ORDER BY started DESC""")
def talk_list(spark, sf):
    updates = _updates(spark, sf).withColumn("state", F.when((F.col("seq") % 11 == 0) & (F.col("talk") % 3 == 0), "ended"))
    return revlog.upsert_talks(updates, ["title", "src_lang", "state"]).orderBy(F.desc("started"))


@query(f"WITH {T.MSG}, u AS (SELECT talk, seq, CASE WHEN seq % 5 = 0 THEN text END AS title FROM msg WHERE talk = 7) SELECT talk, min(seq) AS started, arg_max(title, seq) FILTER (WHERE title IS NOT NULL) AS title FROM u GROUP BY talk")
def one_talk(spark, sf):
    return revlog.upsert_talks(_updates(spark, sf).where("talk = 7"), ["title"])


@query(f"""WITH {T.CURRENT}, {T.TR} SELECT cur.talk, cur.sid, cur.rev, cur.spk, cur.t0, cur.t1, coalesce(tr.text, cur.text) AS text, tr.text IS NULL AS untranslated
FROM cur LEFT JOIN tr ON tr.talk = cur.talk AND tr.sid = cur.sid AND tr.lang = 'de' WHERE final""")
def translated_transcript(spark, sf):
    return revlog.translated(_current(spark, sf), T.translations(spark, sf), "de")


@query(f"WITH {T.CURRENT} SELECT talk, sid, rev, final, stable, lang, text, spk, spk_conf, conf, t0, t1, emitted_at FROM cur WHERE final AND sid > 10 ORDER BY talk, sid")
def transcript_since(spark, sf):
    return revlog.transcript(_current(spark, sf), since=10).orderBy("talk", "sid")


@query(f"WITH {T.CURRENT}, {T.TR} SELECT cur.talk, cur.sid, coalesce(tr.text, cur.text) AS text FROM cur LEFT JOIN tr ON tr.talk = cur.talk AND tr.sid = cur.sid AND tr.lang = 'fr' WHERE final AND cur.sid > 25")
def translated_since(spark, sf):
    return revlog.translated(_current(spark, sf), T.translations(spark, sf), "fr", since=25).select("talk", "sid", "text")


@query(f"""WITH {T.CURRENT}, {T.TR}, want AS (SELECT talk, sid, rev, lang FROM (SELECT talk, sid, rev, lang AS own, unnest(['en', 'de', 'fr']) AS lang FROM cur WHERE final) WHERE lang <> own)
SELECT want.talk, want.sid, want.lang, want.rev FROM want WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.talk = want.talk AND tr.sid = want.sid AND tr.lang = want.lang AND tr.rev >= want.rev)""")
def translation_cache_misses(spark, sf):
    langs = F.explode(F.array(F.lit("en"), F.lit("de"), F.lit("fr")))
    wanted = _current(spark, sf).where("final").select("talk", "sid", "rev", F.col("lang").alias("own"), langs.alias("lang")).where("lang != own").drop("own")
    return revlog.cache_misses(wanted, T.translations(spark, sf)).select("talk", "sid", "lang", "rev")


@query(f"""WITH {T.CURRENT}, {T.TR} SELECT cur.talk, cur.sid, tr.lang, tr.text FROM cur JOIN tr ON tr.talk = cur.talk AND tr.sid = cur.sid AND tr.rev >= cur.rev""")
def translation_cache_hits(spark, sf):
    tr = T.translations(spark, sf).withColumnRenamed("rev", "have")
    return _current(spark, sf).select("talk", "sid", "rev").join(tr, ["talk", "sid"]).where("have >= rev").select("talk", "sid", "lang", "text")


@query(f"WITH {T.JUDGED} SELECT talk, sid, seq, rev, lang FROM judged WHERE accepted AND t = 'seg' AND final AND stable")
def translate_gate(spark, sf):
    return revlog.to_translate(T.messages(spark, sf)).select("talk", "sid", "seq", "rev", "lang")


@query(f"""WITH {T.JUDGED}, {T.COUNTED}, act AS (SELECT talk, lang FROM counted GROUP BY talk, lang HAVING arg_max(n, seq) > 0)
SELECT j.talk, j.sid, j.seq, a.lang AS target FROM judged j JOIN act a ON a.talk = j.talk AND a.lang <> j.lang WHERE accepted AND t = 'seg' AND final AND stable""")
def lang_targets(spark, sf):
    gate = revlog.to_translate(T.messages(spark, sf))
    return pubsub.targets(gate, pubsub.listeners(T.subscriptions(spark, sf))).select("talk", "sid", "seq", "target")


@query(f"WITH {T.CURRENT}, {T.TR}, x AS (SELECT cur.talk, cur.sid, coalesce(tr.text, cur.text) AS text, row_number() OVER (PARTITION BY cur.talk ORDER BY cur.sid DESC) AS k FROM cur LEFT JOIN tr ON tr.talk = cur.talk AND tr.sid = cur.sid AND tr.lang = 'en' WHERE final) SELECT talk, sid, text FROM x WHERE k <= 40")
def snapshot_last40(spark, sf):
    rows = revlog.translated(_current(spark, sf), T.translations(spark, sf), "en")
    return revlog.last_rows(rows, ["talk"], "sid", 40).select("talk", "sid", "text")


@query(f"""WITH {T.CURRENT}, {T.COUNTED}, act AS (SELECT DISTINCT talk, lang FROM counted WHERE op = 'attach' AND n = 1),
x AS (SELECT talk, sid, rev, lang, row_number() OVER (PARTITION BY talk ORDER BY sid DESC) AS k FROM cur WHERE final)
SELECT x.talk, x.sid, x.rev, act.lang AS target FROM x JOIN act ON act.talk = x.talk AND act.lang <> x.lang WHERE k <= 30""")
def backlog_last30(spark, sf):
    active = pubsub.activations(T.subscriptions(spark, sf)).select("talk", "lang").distinct()
    last = revlog.last_rows(_current(spark, sf).where("final"), ["talk"], "sid", 30)
    return pubsub.targets(last, active).select("talk", "sid", "rev", "target")


@query(f"WITH {T.MSG}, f AS (SELECT *, row_number() OVER (PARTITION BY talk ORDER BY seq DESC) AS k FROM msg WHERE t = 'seg' AND final), kept AS (SELECT *, row_number() OVER (PARTITION BY talk ORDER BY seq DESC) AS r FROM f WHERE k <= 200) SELECT talk, seq, sid, text FROM kept WHERE r <= 40")
def stage_replay(spark, sf):
    finals = T.messages(spark, sf).where("t = 'seg' and final")
    return revlog.last_rows(revlog.last_rows(finals, ["talk"], "seq", 200), ["talk"], "seq", 40).select("talk", "seq", "sid", "text")


@query(f"""WITH {T.MSG}, ack AS (SELECT talk, max(seq - 400) AS a FROM msg WHERE seq % 9 = 0 GROUP BY talk),
p AS (SELECT m.talk, m.seq, row_number() OVER (PARTITION BY m.talk ORDER BY m.seq DESC) AS k, count(*) OVER (PARTITION BY m.talk) AS c FROM msg m LEFT JOIN ack ON ack.talk = m.talk WHERE m.seq > coalesce(ack.a, -1))
SELECT talk, seq, greatest(c - 15, 0) AS dropped FROM p WHERE k <= 15""")
def pending_unacked(spark, sf):
    rows = T.messages(spark, sf)
    return revlog.pending(rows.select("talk", "seq"), rows.where("seq % 9 = 0").selectExpr("talk", "seq - 400 as ack"), 15)


@query(f"""WITH {T.MSG}, e AS (
    SELECT talk, seq AS p, sid, CASE WHEN t = 'seg' THEN 'send' WHEN t = 'tr' THEN 'ack' WHEN sid % 3 = 0 THEN 'down' ELSE 'up' END AS what,
           count(*) FILTER (WHERE t = 'seg') OVER (PARTITION BY talk ORDER BY seq) AS no, value FROM msg WHERE t IN ('seg', 'tr', 'health')
), r AS (
    SELECT *, coalesce(max(CASE WHEN what = 'ack' THEN greatest(no - value % 4, 0) END) OVER w, 0) AS acked,
           coalesce(last_value(CASE WHEN what IN ('up', 'down') THEN what = 'up' END IGNORE NULLS) OVER w, false) AS up FROM e WINDOW w AS (PARTITION BY talk ORDER BY p)
), d AS (
    SELECT *, count(*) FILTER (WHERE what = 'send' AND acked <= no - 6) OVER (PARTITION BY talk ORDER BY p) AS dropped FROM r
)
SELECT talk, p AS "at", no, sid AS body, false AS resent, dropped FROM d WHERE what = 'send' AND up
UNION ALL
SELECT u.talk, u.p, s.no, s.sid, true, u.dropped FROM d u JOIN d s ON s.talk = u.talk AND s.what = 'send' AND s.no BETWEEN greatest(u.acked, u.no - 5) + 1 AND u.no WHERE u.what = 'up'""")
def uplink_sent(spark, sf):
    """Segments go over a link that health messages switch; translations acknowledge, some late. The outbox holds five."""
    rows = T.messages(spark, sf).where("t in ('seg', 'tr', 'health')")
    what = F.when(F.col("t") == "seg", "send").when(F.col("t") == "tr", "ack").when(F.col("sid") % 3 == 0, "down").otherwise("up")
    told = F.count(F.when(F.col("t") == "seg", 1)).over(Window.partitionBy("talk").orderBy("seq"))
    events = rows.select("talk", F.col("seq").alias("at"), what.alias("what"), F.col("sid").alias("body"), F.greatest(told - F.col("value") % 4, F.lit(0)).alias("ack"))
    return revlog.transmissions(events, 5)


@query(f"WITH {T.MSG}, {T.COUNTED} SELECT talk, lang, arg_max(n, seq) AS n FROM counted GROUP BY talk, lang HAVING arg_max(n, seq) > 0")
def listeners(spark, sf):
    return pubsub.listeners(T.subscriptions(spark, sf))


@query(f"WITH {T.MSG}, {T.COUNTED} SELECT talk, lang, seq FROM counted WHERE op = 'attach' AND n = 1")
def lang_activations(spark, sf):
    return pubsub.activations(T.subscriptions(spark, sf))


@query(f"""WITH {T.MSG}, s AS (SELECT *, CASE WHEN t = 'health' AND value % 2 = 0 THEN true WHEN t = 'health' THEN false END AS m FROM msg),
x AS (SELECT *, coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY talk ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS muted FROM s)
SELECT talk, seq, sid FROM x WHERE NOT muted AND t <> 'health'""")
def mute_gate(spark, sf):
    switch, even = F.col("t") == "health", F.col("value") % 2 == 0
    return revlog.unmuted(T.messages(spark, sf), switch & even, switch & ~even).select("talk", "seq", "sid")


@query(f"WITH {T.MSG} SELECT talk, seq, unnest(list_distinct(['talk:' || talk || ':lang:' || lang, 'talk:' || talk || ':lang:en', 'talk:' || talk || ':ctl'])) AS topic FROM msg WHERE t = 'seg'")
def topic_fanout(spark, sf):
    return pubsub.fan_out(T.messages(spark, sf).where("t = 'seg'"), "en").select("talk", "seq", "topic")


@query(f"""WITH {T.MSG}, sw AS (SELECT talk, sid % 4 AS viewer, seq, lang FROM msg WHERE t = 'health'), h AS (SELECT *, lead(seq) OVER (PARTITION BY talk, viewer ORDER BY seq) AS upto FROM sw)
SELECT m.talk, h.viewer, m.seq, m.lang FROM msg m JOIN h ON h.talk = m.talk AND h.lang = m.lang AND m.seq > h.seq AND (h.upto IS NULL OR m.seq < h.upto) WHERE m.t = 'seg'""")
def viewer_feed(spark, sf):
    """Health messages stand for viewers who choose another language."""
    rows = T.messages(spark, sf)
    switches = rows.where("t = 'health'").selectExpr("talk", "sid % 4 as viewer", "seq", "lang")
    return pubsub.delivered(rows.where("t = 'seg'"), switches)


@query(f"""WITH {T.MSG}, d AS (SELECT talk, lang AS viewer, seq FROM msg WHERE t = 'seg'), r AS (SELECT talk, lang AS viewer, seq FROM msg WHERE t = 'tr'),
n AS (SELECT d.*, (SELECT count(*) FROM r WHERE r.talk = d.talk AND r.viewer = d.viewer AND r.seq < d.seq) AS turn FROM d)
SELECT talk, viewer, seq, row_number() OVER (PARTITION BY talk, viewer, turn ORDER BY seq) > 3 AS dropped FROM n""")
def bounded_queues(spark, sf):
    """A viewer for each language, who reads when a translation comes."""
    rows = T.messages(spark, sf).withColumn("viewer", F.col("lang"))
    return pubsub.bounded(rows.where("t = 'seg'"), rows.where("t = 'tr'"), 3)


@query(f"WITH {T.MSG}, l AS (SELECT talk, greatest(seq + value % 3 - emitted_at, 0) AS s, round((value % 5 / 4 + CAST(0.8 AS DOUBLE)) * 1000) AS lag FROM msg) SELECT talk, max(s) AS worst, sum(s) AS total, max(lag) AS lag_ms FROM l GROUP BY talk")
def latency(spark, sf):
    rows = T.messages(spark, sf)
    seen = V.latency((F.col("seq") + F.col("value") % 3).cast("double"), F.col("emitted_at"))
    lag = V.lag_ms(F.col("value") % 5 / 4, KNOBS.chunk)
    return rows.groupBy("talk").agg(F.max(seen).alias("worst"), F.sum(seen).alias("total"), F.max(lag).alias("lag_ms"))


@query("SELECT lang, name FROM (VALUES ('en', 'English'), ('ru', 'Русский'), ('sr', 'Srpski'), ('de', 'Deutsch'), ('fr', 'Français'), ('es', 'Español'), ('it', 'Italiano'), ('pt', 'Português'), ('tr', 'Türkçe'), ('zh', '中文'), ('ja', '日本語'), ('ar', 'العربية'), ('uk', 'Українська'), ('pl', 'Polski')) t(lang, name)")
def languages(spark, sf):
    return config.languages(spark)


@query(f"WITH {T.MSG} SELECT talk, lang AS key, arg_max(value, seq) AS value, max(seq) AS seq FROM msg WHERE t = 'health' GROUP BY talk, lang")
def health_latest(spark, sf):
    return pubsub.merged_health(T.messages(spark, sf).where("t = 'health'").withColumnRenamed("lang", "key"))


#: The log with edits, one segment's messages after the other.
EDITED = f"""{T.MSG}, {T.LOGGED}, o AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY talk, sid ORDER BY seq) AS k FROM logged WHERE t IN ('seg', 'spk', 'edit')
), st AS (
    SELECT talk, sid, k, seq, t, t = 'seg' AS ok, CASE WHEN t = 'seg' THEN rev END AS cur, CASE WHEN t = 'seg' THEN text END AS text, CASE WHEN t = 'seg' THEN spk END AS spk,
           CASE WHEN t = 'seg' THEN spk_conf END AS spk_conf, CASE WHEN t = 'seg' THEN {{'final': final, 'stable': stable, 'lang': lang, 'conf': conf, 't0': t0, 't1': t1, 'emitted_at': emitted_at}} END AS said FROM o WHERE k = 1
    UNION ALL
    SELECT talk, sid, k, seq, t, ok, CASE WHEN NOT ok THEN cur WHEN t = 'edit' THEN cur + 1 ELSE rev END, CASE WHEN ok AND t <> 'spk' THEN text ELSE old_text END,
           CASE WHEN ok AND t <> 'edit' THEN spk ELSE old_spk END, CASE WHEN ok AND t <> 'edit' THEN spk_conf ELSE old_conf END, CASE WHEN ok AND t = 'seg' THEN said ELSE old_said END
    FROM (
        SELECT o.talk, o.sid, o.k, o.seq, o.t, o.rev, o.text, o.spk, o.spk_conf, s.cur, s.text AS old_text, s.spk AS old_spk, s.spk_conf AS old_conf, s.said AS old_said,
               {{'final': o.final, 'stable': o.stable, 'lang': o.lang, 'conf': o.conf, 't0': o.t0, 't1': o.t1, 'emitted_at': o.emitted_at}} AS said,
               CASE o.t WHEN 'seg' THEN s.cur IS NULL OR o.rev > s.cur WHEN 'spk' THEN s.cur IS NOT NULL AND o.rev > s.cur ELSE s.cur IS NOT NULL END AS ok
        FROM st s JOIN o ON o.talk = s.talk AND o.sid = s.sid AND o.k = s.k + 1
    )
)"""


@query(f"""WITH RECURSIVE {EDITED}, l AS (SELECT *, row_number() OVER (PARTITION BY talk, sid ORDER BY k DESC) AS r FROM st WHERE cur IS NOT NULL)
SELECT talk, sid, cur AS rev, text, spk, spk_conf, said.final AS final, said.stable AS stable, said.lang AS lang, said.conf AS conf, said.t0 AS t0, said.t1 AS t1, said.emitted_at AS emitted_at FROM l WHERE r = 1""")
def edited_segments(spark, sf):
    return revlog.current_segments(T.logged(spark, sf))


@query(f"""WITH RECURSIVE {EDITED} SELECT 'seg' AS t, talk, sid, seq, cur AS rev, true AS final, true AS stable, said.lang AS lang, spk, text, CAST(length(text) AS BIGINT) AS stable_len, said.t0 AS t0, said.t1 AS t1
FROM st WHERE ok AND t = 'edit'""")
def edit_messages(spark, sf):
    return revlog.edit_messages(T.logged(spark, sf))


@query(f"""WITH RECURSIVE {EDITED}, e AS (SELECT talk, sid, max(seq) AS at FROM st WHERE ok AND t = 'edit' GROUP BY talk, sid)
SELECT m.talk, m.sid, m.lang, arg_max(m.rev, m.seq) AS rev, arg_max(m.text, m.seq) AS text FROM msg m LEFT JOIN e ON e.talk = m.talk AND e.sid = m.sid WHERE m.t = 'tr' AND (e.at IS NULL OR m.seq > e.at) GROUP BY ALL""")
def translations_after_edits(spark, sf):
    return revlog.translations_kept(T.logged(spark, sf))


#: Late labels of sent segments.
LATE = """late AS (
    SELECT m.talk, m.sid, m.seq, m.spk, round(m.spk_conf, 2) AS spk_conf, list_extract(['online', 'merge', 'refine'], m.seq % 3 + 1) AS src, c.rev AS had,
           CASE WHEN row_number() OVER w = 1 THEN c.spk ELSE lag(m.spk) OVER w END AS was
    FROM msg m JOIN cur c ON c.talk = m.talk AND c.sid = m.sid AND c.final AND c.sid % 5 <> 0 WHERE m.t = 'spk' WINDOW w AS (PARTITION BY m.talk, m.sid ORDER BY m.seq)
), changed AS (
    SELECT talk, sid, seq, had + row_number() OVER (PARTITION BY talk, sid ORDER BY seq) AS rev, was, spk, spk_conf, src FROM late WHERE was IS DISTINCT FROM spk
)"""


def _late(spark, sf):
    """Every fifth segment counts as not sent."""
    sent = _current(spark, sf).where("final and sid % 5 != 0").select("talk", "sid", "rev", "spk")
    labels = T.messages(spark, sf).where("t = 'spk'").withColumn("src", F.element_at(F.array(F.lit("online"), F.lit("merge"), F.lit("refine")), (F.col("seq") % 3 + 1).cast("int")))
    return sent, labels.select("talk", "sid", "seq", "spk", "spk_conf", "src")


@query(f"WITH {T.CURRENT}, {LATE} SELECT talk, sid, seq, rev, was, spk, spk_conf, src FROM changed")
def speaker_revisions(spark, sf):
    return revlog.relabelled(*_late(spark, sf))


@query(f"""WITH {T.CURRENT}, {LATE} SELECT c.talk, c.sid, coalesce(max(l.rev), c.rev) AS rev, coalesce(arg_max(l.spk, l.seq), c.spk) AS spk
FROM cur c LEFT JOIN changed l ON l.talk = c.talk AND l.sid = c.sid WHERE c.final AND c.sid % 5 <> 0 GROUP BY c.talk, c.sid, c.rev, c.spk""")
def relabelled_segments(spark, sf):
    sent, labels = _late(spark, sf)
    return revlog.last_labels(sent, revlog.relabelled(sent, labels))


@query(f"""WITH {T.CURRENT}, {T.TR}, a AS (SELECT cur.talk, cur.text, coalesce(tr.rev >= cur.rev, false) AS hit, cur.sid % 11 = 0 AS failed
    FROM cur LEFT JOIN tr ON tr.talk = cur.talk AND tr.sid = cur.sid AND tr.lang = 'fr' WHERE final)
SELECT talk, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit AND NOT failed) AS calls, CAST(coalesce(sum(length(text)) FILTER (WHERE NOT hit AND NOT failed), 0) AS BIGINT) AS chars,
       count(*) FILTER (WHERE NOT hit AND failed) AS errors FROM a GROUP BY talk""")
def translation_counters(spark, sf):
    """The engine is down for every eleventh segment."""
    tr = T.translations(spark, sf).where("lang = 'fr'").select("talk", "sid", F.col("rev").alias("have"))
    rows = _current(spark, sf).where("final").join(tr, ["talk", "sid"], "left").withColumn("hit", F.coalesce(F.col("have") >= F.col("rev"), F.lit(False)))
    return revlog.translation_counters(rows.withColumn("failed", F.col("sid") % 11 == 0))


@query(f"""WITH {T.MSG}, d AS (SELECT talk, sid, rev, t, min(seq) AS seq, count(*) AS times FROM msg GROUP BY talk, sid, rev, t) SELECT talk, sid, rev, t, seq, times FROM d""")
def redelivered(spark, sf):
    return T.messages(spark, sf).groupBy("talk", "sid", "rev", "t").agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("times"))


# -- frames and clocks ----------------------------------------------------------------------------


@query(f"WITH {T.FRAME} SELECT talk, ch, frame, max(level_db > -75) OVER (PARTITION BY talk, ch ORDER BY frame ROWS BETWEEN 18 PRECEDING AND CURRENT ROW) AS speech FROM frame")
def vad_hangover(spark, sf):
    kept = int(KNOBS.vad_hangover * KNOBS.sample_rate / KNOBS.frame_samples)
    return timeline.hangover(T.frames(spark, sf), ["talk", "ch"], F.col("level_db") > T.GATE_DB, kept).select("talk", "ch", "frame", "speech")


NOISE = """n AS (
    SELECT talk, ch, frame, level_db, level_db AS noise_db FROM frame WHERE frame = 0
    UNION ALL
    SELECT f.talk, f.ch, f.frame, f.level_db, n.noise_db + (f.level_db - n.noise_db) * CASE WHEN f.level_db - n.noise_db < 0 THEN CAST(0.2 AS DOUBLE) ELSE CAST(0.0003 AS DOUBLE) END
    FROM n JOIN frame f ON f.talk = n.talk AND f.ch = n.ch AND f.frame = n.frame + 1
)"""
_FRAME = T.FRAME.replace("frame AS", "frame AS MATERIALIZED", 1)


@query(f"WITH RECURSIVE {_FRAME}, {NOISE} SELECT talk, ch, frame, noise_db, level_db - noise_db AS snr FROM n")
def noise_floor(spark, sf):
    return floor.noise_floor(T.frames(spark, sf), ["talk", "ch"]).select("talk", "ch", "frame", "noise_db", "snr")


@query(f"""WITH {T.FRAME}, q AS (SELECT *, level_db < -60 AS quiet, row_number() OVER (PARTITION BY talk, ch ORDER BY frame) AS k FROM frame)
SELECT talk, ch, frame, k - coalesce(max(CASE WHEN NOT quiet THEN k END) OVER (PARTITION BY talk, ch ORDER BY frame), 0) AS run FROM q""")
def quiet_runs(spark, sf):
    return timeline.run_lengths(T.frames(spark, sf), ["talk", "ch"], F.col("level_db") < -60).select("talk", "ch", "frame", "run")


@query(f"""WITH {T.FRAME}, q AS (SELECT *, level_db < -60 AS quiet, row_number() OVER (PARTITION BY talk, ch ORDER BY frame) AS k FROM frame),
r AS (SELECT talk, ch, frame, k - coalesce(max(CASE WHEN NOT quiet THEN k END) OVER (PARTITION BY talk, ch ORDER BY frame), 0) AS run FROM q)
SELECT talk, ch, min(frame) AS frame FROM r WHERE run >= 12 GROUP BY talk, ch""")
def dead_channels(spark, sf):
    return timeline.dead_since(T.frames(spark, sf), ["talk", "ch"], F.col("level_db") < -60, 12)


#: Every two channels of a talk.
BLEED = """p AS (SELECT a.talk, a.ch AS x, b.ch AS y, a.frame, a.level_db AS a, b.level_db AS b FROM frame a JOIN frame b ON b.talk = a.talk AND b.frame = a.frame AND b.ch > a.ch),
w AS (SELECT talk, x, y, frame, count(*) OVER r AS n, avg(a) OVER r AS ma, avg(b) OVER r AS mb, avg(a * a) OVER r AS maa, avg(b * b) OVER r AS mbb, avg(a * b) OVER r AS mab FROM p
      WINDOW r AS (PARTITION BY talk, x, y ORDER BY frame ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
c AS (SELECT talk, x, y, frame, n, greatest(maa - ma * ma, 0) AS va, greatest(mbb - mb * mb, 0) AS vb, mab - ma * mb AS cov FROM w),
bleed AS (SELECT talk, x, y, frame, CASE WHEN n < 8 OR sqrt(va) < 1e-6 OR sqrt(vb) < 1e-6 THEN true ELSE cov / sqrt(va * vb) >= 0.6 END AS bleed FROM c)"""


@query(f"WITH {T.FRAME}, {BLEED} SELECT talk, x, y, frame, bleed FROM bleed")
def bleed_corr(spark, sf):
    return floor.channel_bleed(T.frames(spark, sf))


def _snr(spark, sf):
    """A steady noise of -85 dB, so that leaders don't hang on the fold."""
    return T.frames(spark, sf).withColumn("snr", F.col("level_db") + 85).withColumn("noise_db", F.lit(-85.0))


#: Leaders and overlaps of a table `s` (talk, ch, frame, snr); `bleed` as above.
LEAD = """act AS (SELECT *, row_number() OVER (PARTITION BY talk, frame ORDER BY snr DESC, ch) AS k FROM s WHERE snr >= 8),
lead AS (
    SELECT o.talk, o.frame, l.ch AS leader, l.snr, max(o.ch) FILTER (WHERE o.k = 2) AS second,
           coalesce(list(o.ch ORDER BY o.k) FILTER (WHERE o.k > 1 AND l.snr - o.snr < 6 AND NOT coalesce(bleed, true)), []) AS overlap
    FROM act o JOIN act l ON l.talk = o.talk AND l.frame = o.frame AND l.k = 1
    LEFT JOIN bleed b ON b.talk = o.talk AND b.frame = o.frame AND b.x = least(o.ch, l.ch) AND b.y = greatest(o.ch, l.ch) GROUP BY o.talk, o.frame, l.ch, l.snr
)"""


@query(f"WITH {T.FRAME}, {BLEED}, s AS (SELECT talk, ch, frame, level_db + 85 AS snr FROM frame), {LEAD} SELECT talk, frame, leader, snr, second, array_to_string(overlap, ',') AS near FROM lead")
def floor_rank_overlap(spark, sf):
    return floor.rivals(_snr(spark, sf)).select("talk", "frame", "leader", "snr", "second", F.array_join(F.col("overlap").cast("array<string>"), ",").alias("near"))


NOISE_SNR = "s AS MATERIALIZED (SELECT talk, ch, frame, level_db - noise_db AS snr FROM n)"
#: Who has the floor, frame by frame.
TURNS = """every AS MATERIALIZED (SELECT f.talk, f.frame, l.leader FROM (SELECT DISTINCT talk, frame FROM frame) f LEFT JOIN lead l ON l.talk = f.talk AND l.frame = f.frame),
ordered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY talk ORDER BY frame) AS k FROM every),
t AS (
    SELECT talk, CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS frame, CAST(NULL AS BIGINT) AS owner, CAST(NULL AS BIGINT) AS cand, 0 AS n, 0 AS lft, '' AS told FROM (SELECT DISTINCT talk FROM frame)
    UNION ALL
    SELECT talk, k, frame, CASE WHEN taken THEN leader WHEN freed THEN NULL ELSE owner END, CASE WHEN taken OR freed OR kept THEN NULL WHEN leader IS NOT NULL AND warm THEN leader ELSE cand END,
           CASE WHEN taken OR freed OR kept THEN 0 ELSE m END, CASE WHEN NOT warm THEN lft WHEN leader IS NOT NULL THEN 21 WHEN freed THEN 0 WHEN owner IS NOT NULL THEN lft - 1 ELSE lft END,
           CASE WHEN taken THEN 'taken' WHEN freed THEN 'released' ELSE '' END
    FROM (
        SELECT *, warm AND leader IS NOT NULL AND leader IS DISTINCT FROM owner AND m >= 4 AS taken, warm AND leader IS NULL AND owner IS NOT NULL AND lft <= 1 AS freed, warm AND leader IS NOT NULL AND leader IS NOT DISTINCT FROM owner AS kept
        FROM (SELECT t.talk, o.k, o.frame, o.leader, t.owner, t.cand, t.lft, o.k >= 31 AS warm, CASE WHEN o.k < 31 OR o.leader IS NULL THEN t.n WHEN o.leader IS NOT DISTINCT FROM t.cand THEN t.n + 1 ELSE 1 END AS m
              FROM t JOIN ordered o ON o.talk = t.talk AND o.k = t.k + 1)
    )
), told AS (SELECT t.talk, t.frame, t.owner, t.told AS reason FROM t WHERE told <> '')"""


def _noisy(spark, sf):
    return floor.noise_floor(T.frames(spark, sf), ["talk", "ch"])


@query(f"""WITH RECURSIVE {_FRAME}, {NOISE}, {BLEED}, {NOISE_SNR}, {LEAD}, {TURNS}
SELECT t.talk, t.frame, t.owner, t.reason, coalesce(array_to_string(l.overlap, ','), '') AS overlap, round(l.snr, 1) AS snr, l.second FROM told t LEFT JOIN lead l ON l.talk = t.talk AND l.frame = t.frame""")
def floor_events(spark, sf):
    told = floor.events(_noisy(spark, sf))
    return told.withColumn("overlap", F.array_join(F.col("overlap").cast("array<string>"), ","))


@query(f"""WITH RECURSIVE {_FRAME}, {NOISE}, {BLEED}, {NOISE_SNR}, {LEAD}, {TURNS},
o AS (SELECT talk, frame, array_to_string(overlap, ',') AS overlap FROM lead WHERE frame >= 30 UNION ALL SELECT talk, frame, '' FROM told WHERE owner IS NULL)
SELECT o.talk, arg_max(o.overlap, o.frame) AS overlap, (SELECT arg_max(struct_pack(owner := x.owner), x.frame).owner FROM told x WHERE x.talk = o.talk) AS owner FROM o GROUP BY o.talk""")
def floor_now(spark, sf):
    noisy = _noisy(spark, sf)
    now = floor.floor_status(floor.rivals(noisy), floor.events(noisy))
    return now.withColumn("overlap", F.array_join(F.col("overlap").cast("array<string>"), ","))


@query(f"""WITH {T.FRAME}, s AS (SELECT talk, ch, level_db + 85 AS snr, frame FROM frame), q AS (SELECT *, row_number() OVER (PARTITION BY talk, ch ORDER BY frame) AS k, snr < 8 AS quiet FROM s),
r AS (SELECT talk, ch, k - coalesce(max(CASE WHEN NOT quiet THEN k END) OVER (PARTITION BY talk, ch ORDER BY frame), 0) AS run FROM q)
SELECT s.talk, s.ch, round(arg_max(s.snr, s.frame), 1) AS snr, CAST(-85 AS DOUBLE) AS noise_db, coalesce(any_value(d.dead), false) AS dead
FROM s LEFT JOIN (SELECT DISTINCT talk, ch, true AS dead FROM r WHERE run >= 9) d ON d.talk = s.talk AND d.ch = s.ch GROUP BY s.talk, s.ch""")
def channel_status(spark, sf):
    snr = _snr(spark, sf)
    return floor.status(snr, timeline.dead_since(snr, ["talk", "ch"], F.col("snr") < KNOBS.open_snr, 9))


@query(f"""WITH RECURSIVE {_FRAME}, {NOISE}, {BLEED}, {NOISE_SNR}, {LEAD}, {TURNS}
SELECT talk, frame, CASE WHEN frame + 1 < 31 THEN 'mix' ELSE 'ch' || owner END AS input FROM t WHERE k > 0""")
def recogniser_input(spark, sf):
    return edge.heard(T.frames(spark, sf), replace(KNOBS, diarize="channel"))


@query(f"""WITH {T.FRAME}, a AS (SELECT talk, frame, max(level_db > -45) AS active FROM frame GROUP BY talk, frame)
SELECT talk, frame, CASE WHEN max(active) OVER (PARTITION BY talk ORDER BY frame ROWS BETWEEN 18 PRECEDING AND CURRENT ROW) THEN 'mix' END AS input FROM a""")
def gated_input(spark, sf):
    return edge.heard(T.frames(spark, sf))


@query(f"WITH {T.RUNS} SELECT talk, run, s0, a0, dur FROM runs")
def speech_runs(spark, sf):
    return timeline.speech_runs(T.gated(spark, sf), 5)


def _points(spark, sf):
    return T.messages(spark, sf).selectExpr("talk % 10 * 3 + seq % 3 as talk", "seq", "seq % 9000 - 40 as t")


@query(f"""WITH {T.RUNS}, p AS (SELECT user_id % 20 % 10 * 3 + event_id % 3 AS talk, event_id AS seq, event_id % 9000 - 40 AS t FROM events), first AS (SELECT talk, min(a0) AS a0 FROM runs GROUP BY talk)
SELECT p.talk, p.seq, p.t, coalesce(r.a0 + p.t - r.s0, f.a0, p.t) AS t_abs FROM p ASOF LEFT JOIN runs r ON r.talk = p.talk AND p.t >= r.s0 LEFT JOIN first f ON f.talk = p.talk""")
def speech_to_abs(spark, sf):
    return timeline.to_absolute(_points(spark, sf), timeline.speech_runs(T.gated(spark, sf), 5), "t", "t_abs").select("talk", "seq", "t", "t_abs")


@query(f"WITH {T.RUNS} SELECT talk, arg_max(a0 + dur, run) - CAST(sum(dur) AS BIGINT) AS dropped FROM runs GROUP BY talk")
def silence_dropped(spark, sf):
    return timeline.silence_dropped(timeline.speech_runs(T.gated(spark, sf), 5))


@query(f"""WITH {T.FRAME}, f AS (
    SELECT talk * 3 + ch AS talk, frame, level_db >= max(level_db) OVER (PARTITION BY talk, ch) - 85 AS speech, max(frame) OVER (PARTITION BY talk, ch) + 1 AS frames FROM frame
),
s AS (SELECT *, CASE WHEN coalesce(frame - lag(frame) OVER (PARTITION BY talk ORDER BY frame) - 1 >= 18, true) THEN 1 ELSE 0 END AS n FROM f WHERE speech),
g AS (SELECT *, sum(n) OVER (PARTITION BY talk ORDER BY frame) AS run FROM s),
r AS (SELECT talk, run, min(frame) AS i, max(frame) AS j, any_value(frames) AS frames FROM g GROUP BY talk, run),
e AS (SELECT talk, i * 32 AS a, 32 * CASE WHEN lead(run) OVER (PARTITION BY talk ORDER BY run) IS NULL AND frames - j - 1 < 18 THEN least(j + 2, frames) ELSE j + 1 END AS b FROM r),
c AS (SELECT talk, a, b, unnest(range(CAST(greatest(ceil((b - a) / 3500), 1) AS BIGINT))) AS k FROM e),
p AS (SELECT talk, a + k * 3500 AS t0, least(a + k * 3500 + 3500, b) AS t1 FROM c)
SELECT talk, t0, t1 FROM p WHERE t1 - t0 = 3500 OR t1 - t0 > 150""")
def pause_cut_segments(spark, sf):
    rows = T.frames(spark, sf).withColumn("talk", F.col("talk") * 3 + F.col("ch"))
    rows = rows.withColumn("speech", F.col("level_db") >= F.max("level_db").over(Window.partitionBy("talk")) - 85)
    return timeline.pause_cut(rows.select("talk", "frame", "speech"), 32, KNOBS.frames(KNOBS.pause_split), 3500, 150)


@query(f"""WITH {T.FRAME}, f AS (SELECT talk, ch, frame * 32 AS t, level_db FROM frame) SELECT talk, ch, t FROM f WHERE t < 4000 AND t + 32 > 1000""")
def tape_slice(spark, sf):
    rows = T.frames(spark, sf).selectExpr("talk", "ch", "frame * 32 as t", "cast(32 as bigint) as dur")
    return timeline.within(rows, F.lit(1000), F.lit(4000)).select("talk", "ch", "t")


@query(f"WITH {T.FRAME}, f AS (SELECT talk, ch, frame * 32 AS t FROM frame), m AS (SELECT *, max(t) OVER (PARTITION BY talk) AS n FROM f) SELECT talk, ch, t FROM m WHERE t > n - 3000")
def tape_retained(spark, sf):
    return timeline.retained(T.frames(spark, sf).selectExpr("talk", "ch", "frame * 32 as t"), 3000)


# -- words, segments, texts -----------------------------------------------------------------------


@query(f"WITH {T.WORD} SELECT talk, idx, CASE WHEN sid = lag(sid) OVER (PARTITION BY talk ORDER BY idx) THEN t0 - lag(t1) OVER (PARTITION BY talk ORDER BY idx) ELSE 0 END AS pause FROM word")
def word_pauses(spark, sf):
    """Each turn of a conversation is another speaker's."""
    return words.pauses(T.words(spark, sf), speaker="sid").select("talk", "idx", "pause")


@query(f"WITH {T.SEG} SELECT talk, arg_max(t1, sid) - arg_min(t0, sid) AS duration, CAST(sum(nw) AS BIGINT) AS words, count(*) AS segments FROM seg GROUP BY talk")
def segment_stats(spark, sf):
    return words.stats(T.segments(spark, sf))


@query(f"""WITH {T.SEG}, s AS (SELECT talk, spk, count(*) AS n, min(sid) AS f FROM seg WHERE spk IS NOT NULL GROUP BY talk, spk)
SELECT talk, spk, n, CAST(sum(n) OVER (PARTITION BY talk) AS BIGINT) AS total, CAST(round_even(100 * n / sum(n) OVER (PARTITION BY talk), 0) AS BIGINT) AS percent, row_number() OVER (PARTITION BY talk ORDER BY n DESC, f) AS place FROM s""")
def speaker_share(spark, sf):
    return words.speaker_share(T.segments(spark, sf))


@query(f"WITH {T.WORD} SELECT seg.talk, seg.sid, coalesce(round(avg(p / 10), 9), 0) AS conf FROM seg LEFT JOIN word ON word.talk = seg.talk AND word.sid = seg.sid GROUP BY seg.talk, seg.sid")
def segment_confidence(spark, sf):
    own = T.words(spark, sf).groupBy("talk", "sid").agg(F.collect_list(F.col("p") / 10).alias("probs"))
    rows = T.segments(spark, sf).select("talk", "sid").join(own, ["talk", "sid"], "left")
    return rows.select("talk", "sid", F.round(words.confidence(F.col("probs")), 9).alias("conf"))


_WORD = T.WORD.replace("word AS", "word AS MATERIALIZED", 1)


@query(rf"""WITH RECURSIVE {_WORD}, w AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY talk ORDER BY idx) AS k,
    regexp_matches(text, '[.!?…]+[»"'')\]]*$') AS stops, ends_with(text, ',') AS comma FROM word),
s AS (
    SELECT talk, k, 1 AS sid, idx AS first, 1 AS n, t0, t1, CASE WHEN t1 - t0 >= 3500 THEN 'span' END AS why FROM w WHERE k = 1
    UNION ALL
    SELECT talk, k, sid, first, n, t0, t1,
           CASE WHEN stops AND n >= 3 THEN 'sentence' WHEN n >= 18 THEN 'words' WHEN t1 - t0 >= 3500 THEN 'span' WHEN comma AND n >= 12 THEN 'clause' END
    FROM (
        SELECT w.talk, w.k, CASE WHEN fresh THEN s.sid + 1 ELSE s.sid END AS sid, CASE WHEN fresh THEN w.idx ELSE s.first END AS first, CASE WHEN fresh THEN 1 ELSE s.n + 1 END AS n,
               CASE WHEN fresh THEN w.t0 ELSE s.t0 END AS t0, w.t1, w.stops, w.comma
        FROM (SELECT s.*, w.idx AS widx, s.why IS NOT NULL OR w.t0 - s.t1 >= 600 AS fresh FROM s JOIN w ON w.talk = s.talk AND w.k = s.k + 1) s JOIN w ON w.talk = s.talk AND w.k = s.k + 1
    )
), e AS (
    SELECT *, row_number() OVER (PARTITION BY talk, sid ORDER BY k DESC) AS r, max(sid) OVER (PARTITION BY talk) AS top FROM s
)
SELECT talk, CAST(sid AS BIGINT) AS sid, first, CAST(n AS BIGINT) AS n, t0, t1, coalesce(why, CASE WHEN sid = top THEN 'open' ELSE 'pause' END) AS reason FROM e WHERE r = 1""")
def segmenter_close(spark, sf):
    return words.segments(T.words(spark, sf), unit=1000.0)


def _hypotheses(spark, sf):
    """Utterances of 24 words; each poll hears three words more, and every fourth spells its last word otherwise."""
    rank = F.row_number().over(Window.partitionBy("talk").orderBy("idx")) - 1
    rows = T.words(spark, sf).withColumn("u", F.expr("talk * 100000") + F.floor(rank / 24))
    own = rows.groupBy(F.col("u").alias("talk")).agg(F.array_sort(F.collect_list(F.struct("idx", "text", "t0", "t1"))).alias("all"))
    polls = own.withColumn("poll", F.explode(F.sequence(F.lit(1), F.ceil(F.size("all") / 3).cast("int"))))
    heard = F.slice("all", 1, F.col("poll") * 3)
    word = lambda w, i: F.struct(
        F.when((F.col("poll") % 4 == 0) & (i == F.size(heard) - 1), F.concat(w["text"], F.lit("x"))).otherwise(F.concat(w["text"], F.lit("!"))).alias("text"), w["t0"].cast("double").alias("t0"), w["t1"].cast("double").alias("t1")
    )
    return polls.select("talk", F.col("poll").cast("long").alias("poll"), F.transform(heard, word).alias("words"))


_FORM = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}_]', '', 'g')"
#: Words at the begin of two lists that have the same form.
_SAME = f"coalesce(list_position(list_transform(range(1, least(len(a), len(b)) + 1), lambda i: {_FORM.format('a[i].text')} = {_FORM.format('b[i].text')}), false) - 1, least(len(a), len(b)))"


@query(f"""WITH RECURSIVE {T.WORD}, u AS (SELECT talk * 100000 + (row_number() OVER (PARTITION BY talk ORDER BY idx) - 1) // 24 AS talk, idx, text, t0, t1 FROM word),
l AS (SELECT talk, list({{'text': text, 't0': t0, 't1': t1}} ORDER BY idx) AS every FROM u GROUP BY talk),
h AS MATERIALIZED (
    SELECT talk, poll, list_transform(every[:poll * 3], lambda w, i: {{'text': CASE WHEN poll % 4 = 0 AND i = least(poll * 3, len(every)) THEN w.text || 'x' ELSE w.text || '!' END, 't0': CAST(w.t0 AS DOUBLE), 't1': CAST(w.t1 AS DOUBLE)}}) AS ws
    FROM (SELECT *, unnest(range(1, CAST(ceil(len(every) / 3) AS BIGINT) + 1)) AS poll FROM l)
), p AS (
    SELECT talk, poll, ws AS kept, ws[:0] AS new FROM h WHERE poll = 1
    UNION ALL
    SELECT talk, poll, b[n + 1:], b[:n] FROM (SELECT *, {_SAME} AS n FROM (SELECT h.talk, h.poll, p.kept AS a, h.ws AS b FROM p JOIN h ON h.talk = p.talk AND h.poll = p.poll + 1))
)
SELECT talk, poll, generate_subscripts(new, 1) - 1 AS pos, unnest(new).text AS text, unnest(new).t0 AS t0, unnest(new).t1 AS t1 FROM p""")
def local_agreement(spark, sf):
    return words.committed(_hypotheses(spark, sf), KNOBS.agreement_n)


def _spelled(row, audio, _prompt, _origin):
    """A recogniser that knows the words in its buffer; in every fourth chunk it hears the last one otherwise."""
    return [*audio[:-1], [audio[-1][0] + "x", *audio[-1][1:]]] if audio and row.seq % 8 == 0 else audio


def _chunks(spark, sf):
    """Chunks of 800 ms with the words that end in them; every 25th is followed by a flush, every 40th by a reset."""
    rows = T.words(spark, sf).withColumn("c", F.expr("t1 div 800"))
    word = F.struct("text", F.col("t0").cast("double").alias("t0"), F.col("t1").cast("double").alias("t1"), (F.col("p") / 10).alias("p"))
    heard = rows.groupBy("talk", "c").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", word.alias("w")))), lambda x: x["w"]).alias("audio"))
    every = rows.groupBy("talk").agg(F.max("c").alias("n")).withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n")))).drop("n")
    feed = every.join(heard, ["talk", "c"], "left").select("talk", (F.col("c") * 2).alias("seq"), F.lit("feed").alias("what"), F.lit(12800).cast("long").alias("samples"), "audio", F.lit(0.0).alias("at"))
    stop = F.when(F.col("c") % 40 == 39, "reset").when(F.col("c") % 25 == 24, "flush")
    halt = every.withColumn("what", stop).where("what is not null").select(
        "talk", (F.col("c") * 2 + 1).alias("seq"), "what", F.lit(0).cast("long").alias("samples"), F.lit(None).cast(feed.schema["audio"].dataType).alias("audio"), ((F.col("c") + 1) * 800).cast("double").alias("at")
    )
    return feed.unionByName(halt)


@query(f"""WITH RECURSIVE {T.WORD}, wc AS (SELECT *, t1 // 800 AS c FROM word), n AS (SELECT talk, max(c) AS n FROM wc GROUP BY talk),
ch AS (SELECT talk, unnest(range(0, n + 1)) AS c FROM n),
heard AS (SELECT talk, c, list({{'text': text, 't0': t0, 't1': t1}} ORDER BY idx) AS audio FROM wc GROUP BY talk, c),
ev AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY talk ORDER BY seq) AS k FROM (
        SELECT ch.talk, ch.c * 2 AS seq, 'feed' AS what, coalesce(h.audio, []) AS audio, ch.c AS c FROM ch LEFT JOIN heard h ON h.talk = ch.talk AND h.c = ch.c
        UNION ALL SELECT talk, c * 2 + 1, CASE WHEN c % 40 = 39 THEN 'reset' ELSE 'flush' END, [], c FROM ch WHERE c % 40 = 39 OR c % 25 = 24)
), st AS (
    SELECT talk, CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS seq, '' AS what, CAST(0 AS BIGINT) AS origin, CAST(0 AS BIGINT) AS buf, CAST(NULL AS STRUCT(text VARCHAR, t0 BIGINT, t1 BIGINT)[]) AS kept,
           CAST([] AS STRUCT(text VARCHAR, t0 BIGINT, t1 BIGINT)[]) AS tail, CAST([] AS STRUCT(text VARCHAR, t0 BIGINT, t1 BIGINT)[]) AS audio, CAST([] AS STRUCT(text VARCHAR, t0 BIGINT, t1 BIGINT)[]) AS new FROM n
    UNION ALL
    SELECT talk, k, seq, what, CASE what WHEN 'reset' THEN (c + 1) * 800 WHEN 'flush' THEN origin ELSE origin + gone END, CASE what WHEN 'reset' THEN 0 WHEN 'flush' THEN buf ELSE greatest(buf - 16 * gone, 0) END,
           CASE WHEN what = 'feed' THEN b[m + 1:] END, CASE WHEN what = 'feed' THEN list_filter(b, lambda w: NOT list_contains(list_transform(new, lambda x: {_FORM.format('x.text')}), {_FORM.format('w.text')}))[-12:] ELSE [] END,
           CASE what WHEN 'reset' THEN [] WHEN 'flush' THEN held ELSE list_filter(held, lambda w: w.t1 > origin + gone) END, CASE WHEN what = 'feed' THEN new ELSE tail END
    FROM (
        SELECT *, CASE WHEN m > 0 THEN greatest(b[m].t1 - origin, 0) ELSE 0 END AS gone, b[:m] AS new FROM (
            SELECT *, CASE WHEN what = 'feed' AND a IS NOT NULL THEN {_SAME} ELSE 0 END AS m FROM (
                SELECT s.talk, e.k, e.seq, e.what, e.c, s.origin, CASE WHEN e.what = 'feed' THEN s.buf + 12800 ELSE s.buf END AS buf, s.kept AS a, s.tail, list_concat(s.audio, e.audio) AS held,
                       CASE WHEN e.seq % 8 = 0 THEN list_transform(list_concat(s.audio, e.audio), lambda w, i: {{'text': CASE WHEN i = len(s.audio) + len(e.audio) THEN w.text || 'x' ELSE w.text END, 't0': w.t0, 't1': w.t1}}) ELSE list_concat(s.audio, e.audio) END AS b
                FROM st s JOIN ev e ON e.talk = s.talk AND e.k = s.k + 1
            )
        )
    )
)
SELECT talk, seq, CASE what WHEN 'feed' THEN 'poll' ELSE what END AS what, array_to_string(list_transform(new, lambda w: w.text), ' ') AS stable, CASE WHEN what = 'feed' THEN array_to_string(list_transform(tail, lambda w: w.text), ' ') ELSE '' END AS partial,
       CAST(origin AS DOUBLE) AS origin, buf FROM st WHERE k > 0""")
def poll_buffer(spark, sf):
    found = words.polled(_chunks(spark, sf), _spelled, KNOBS, unit=1000.0)
    said = lambda c: F.array_join(F.transform(c, lambda w: w["text"]), " ").alias(c)
    return found.select("talk", "seq", "what", said("stable"), said("partial"), "origin", "buf")


def _live_events(spark, sf):
    """Each word is committed by itself; before every fifth it is shown as a guess, a new speaker has the floor after every 20th, and the clock ticks after every seventh."""
    k = F.row_number().over(Window.partitionBy("talk").orderBy("idx")).cast("long")
    rows = T.words(spark, sf).withColumn("k", k)
    word = F.array(F.struct("text", F.col("t0").cast("double").alias("t0"), F.col("t1").cast("double").alias("t1"), (F.col("p") / 10).alias("p")))
    none = F.array().cast("array<struct<text:string,t0:double,t1:double,p:double>>")
    row = lambda at, what, ws, name: F.struct((F.col("k") * 4 + at).alias("seq"), F.lit(what).alias("what"), ws.alias("words"), name.cast("string").alias("name"), (F.col("t1") + at).cast("double").alias("now"))
    all_ = F.array(
        F.when(F.col("k") % 5 == 0, row(0, "partial", word, F.lit(None))), row(1, "stable", word, F.lit(None)), F.when(F.col("k") % 7 == 0, row(2, "tick", none, F.lit(None))),
        F.when(F.col("k") % 20 == 0, row(3, "floor", none, F.when(F.col("k") % 60 != 0, F.concat(F.lit("ch"), (F.col("k") % 3).cast("string"))))),
    )
    return rows.select("talk", F.explode(F.filter(all_, lambda x: x.isNotNull())).alias("e")).select("talk", "e.*")


@query(rf"""WITH RECURSIVE {_WORD}, w AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY talk ORDER BY idx) AS k, regexp_matches(text, '[.!?…]+[»"'')\]]*$') AS stops, ends_with(text, ',') AS comma FROM word),
ev AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY talk ORDER BY seq) AS i FROM (
        SELECT *, k * 4 + phase AS seq, t1 + phase AS now, CASE WHEN phase = 3 AND k % 60 <> 0 THEN 'ch' || k % 3 END AS name FROM (
            SELECT *, unnest(list_filter([CASE WHEN k % 5 = 0 THEN 0 END, 1, CASE WHEN k % 7 = 0 THEN 2 END, CASE WHEN k % 20 = 0 THEN 3 END], lambda x: x IS NOT NULL)) AS phase FROM w))
), st AS (
    SELECT talk, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS sid, false AS isopen, CAST(0 AS BIGINT) AS rev, CAST([] AS STRUCT(text VARCHAR, t0 BIGINT, t1 BIGINT, p BIGINT)[]) AS ws, CAST(NULL AS VARCHAR) AS spk, CAST(0 AS BIGINT) AS opened,
           CAST(NULL AS BIGINT) AS last, CAST(NULL AS VARCHAR) AS next, CAST([] AS STRUCT(t VARCHAR, sid BIGINT, rev BIGINT, final BOOLEAN, stable BOOLEAN, spk VARCHAR, ws STRUCT(text VARCHAR, t0 BIGINT, t1 BIGINT, p BIGINT)[], tail VARCHAR)[]) AS out FROM (SELECT DISTINCT talk FROM w)
    UNION ALL
    SELECT talk, i, seq, sid2, CASE phase WHEN 1 THEN NOT done WHEN 0 THEN true WHEN 2 THEN isopen AND NOT ticked ELSE false END,
           CASE phase WHEN 0 THEN rev2 + 1 WHEN 1 THEN rev2 + 1 ELSE rev2 END, CASE phase WHEN 0 THEN ws2 WHEN 1 THEN CASE WHEN done THEN [] ELSE ws3 END WHEN 2 THEN CASE WHEN ticked THEN [] ELSE ws END ELSE [] END,
           spk2, opened2, CASE phase WHEN 1 THEN t1 WHEN 3 THEN NULL ELSE last END, CASE phase WHEN 3 THEN name ELSE next END,
           list_concat(
               CASE WHEN phase = 1 AND paused THEN [{{'t': 'seg', 'sid': sid, 'rev': rev + 1, 'final': true, 'stable': true, 'spk': spk, 'ws': ws, 'tail': ''}}] ELSE [] END,
               CASE WHEN phase = 0 THEN [{{'t': 'seg', 'sid': sid2, 'rev': rev2 + 1, 'final': false, 'stable': false, 'spk': spk2, 'ws': ws2, 'tail': text}}]
                    WHEN phase = 1 THEN [{{'t': 'seg', 'sid': sid2, 'rev': rev2 + 1, 'final': done, 'stable': true, 'spk': spk2, 'ws': ws3, 'tail': ''}}]
                    WHEN phase = 2 AND ticked THEN [{{'t': 'seg', 'sid': sid, 'rev': rev + 1, 'final': true, 'stable': true, 'spk': spk, 'ws': ws, 'tail': ''}}]
                    WHEN phase = 3 AND isopen AND len(ws) > 0 THEN [{{'t': 'seg', 'sid': sid, 'rev': rev + 1, 'final': false, 'stable': true, 'spk': spk, 'ws': ws, 'tail': ''}}, {{'t': 'seg', 'sid': sid, 'rev': rev + 2, 'final': true, 'stable': true, 'spk': spk, 'ws': ws, 'tail': ''}}] ELSE [] END,
               CASE WHEN phase = 3 THEN [{{'t': 'floor', 'sid': NULL, 'rev': NULL, 'final': NULL, 'stable': NULL, 'spk': name, 'ws': NULL, 'tail': NULL}}] ELSE [] END)
    FROM (
        SELECT *, phase = 1 AND (stops AND len(ws3) >= 3 OR len(ws3) >= 18 OR t1 - ws3[1].t0 >= 3500 OR comma AND len(ws3) >= 12) AS done FROM (
            SELECT *, phase < 2 AND (NOT isopen OR paused) AS fresh, CASE WHEN phase < 2 AND (NOT isopen OR paused) THEN sid + 1 ELSE sid END AS sid2, CASE WHEN phase < 2 AND (NOT isopen OR paused) THEN 0 ELSE rev END AS rev2,
                   CASE WHEN phase < 2 AND (NOT isopen OR paused) THEN next ELSE spk END AS spk2, CASE WHEN phase < 2 AND (NOT isopen OR paused) THEN now ELSE opened END AS opened2, CASE WHEN phase < 2 AND (NOT isopen OR paused) THEN [] ELSE ws END AS ws2,
                   list_append(CASE WHEN phase < 2 AND (NOT isopen OR paused) THEN [] ELSE ws END, {{'text': text, 't0': t0, 't1': t1, 'p': p}}) AS ws3 FROM (
                SELECT s.*  EXCLUDE (i, seq, out), e.i, e.seq, e.phase, e.text, e.t0, e.t1, e.p, e.stops, e.comma, e.now, e.name, e.phase = 1 AND s.isopen AND len(s.ws) > 0 AND coalesce(e.t0 - s.last >= 600, false) AS paused,
                       e.phase = 2 AND s.isopen AND len(s.ws) > 0 AND e.now - s.opened >= 3500 AS ticked FROM st s JOIN ev e ON e.talk = s.talk AND e.i = s.i + 1
            )
        )
    )
), o AS (SELECT talk, seq, unnest(out) AS x FROM st)
SELECT talk, seq, x.t AS t, x.sid AS sid, x.rev AS rev, x.final AS final, x.stable AS stable, x.spk AS spk, CASE WHEN x.t = 'seg' THEN CAST(CASE WHEN x.spk IS NULL THEN 0 ELSE 1 END AS DOUBLE) END AS spk_conf,
       CASE WHEN x.t = 'seg' THEN regexp_replace(array_to_string(list_transform(x.ws, lambda w: w.text), ' '), '\s+([,.!?;:…])', '\1', 'g') END AS text, x.tail AS tail,
       CASE WHEN x.t = 'seg' THEN coalesce(round(list_avg(list_transform(x.ws, lambda w: w.p / 10)), 9), 0) END AS conf, CASE WHEN x.t = 'seg' THEN coalesce(CAST(x.ws[1].t0 AS DOUBLE), 0) END AS t0, CASE WHEN x.t = 'seg' THEN coalesce(CAST(x.ws[-1].t1 AS DOUBLE), 0) END AS t1 FROM o""")
def live_segments(spark, sf):
    return words.live_segments(_live_events(spark, sf), KNOBS, unit=1000.0).withColumn("conf", F.round("conf", 9))


@query(r"""WITH x AS (SELECT turn, conv_id, list_filter(list_transform(regexp_split_to_array(text, '\s+'), lambda w: regexp_replace(lower(w), '[^\p{L}\p{N}_]', '', 'g')), lambda w: w <> '') AS ws FROM conversations)
SELECT conv_id, turn, len(ws) AS n, array_to_string(ws, ' ') AS normed FROM x""")
def norm_tokens(spark, sf):
    ws = X.norm_tokens(F.col("text"))
    return T.read(spark, sf, "conversations").select("conv_id", "turn", F.size(ws).cast("long").alias("n"), F.array_join(ws, " ").alias("normed"))


@query(r"""SELECT conv_id, turn, regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '\s+([,.!?;:…])', '\1', 'g') AS tidy, regexp_matches(trim(text), '[.!?…]+[»"'')\]]*$') AS closed FROM conversations""")
def join_words(spark, sf):
    return T.read(spark, sf, "conversations").select("conv_id", "turn", X.tidy(F.col("text")).alias("tidy"), X.ends_sentence(F.trim("text")).alias("closed"))


DEGENERATE = r"""toks AS (
    SELECT *, list_filter(list_transform(regexp_split_to_array(text, '\s+'), lambda w: regexp_replace(lower(w), '[^\p{L}\p{N}_]', '', 'g')), lambda w: w <> '') AS ws FROM dec
), deg AS (
    SELECT * EXCLUDE (ws), len(ws) >= 6 AND (len(list_distinct(ws)) <= 2 OR len(list_filter(range(1, len(ws) - 6),
        lambda i: ws[i:i+1] = ws[i+2:i+3] AND ws[i:i+1] = ws[i+4:i+5] AND ws[i:i+1] = ws[i+6:i+7])) > 0) AS degenerate FROM toks
)"""


@query(f"WITH {T.HYP}, {DEGENERATE} SELECT doc_id, degenerate FROM deg")
def degenerate_docs(spark, sf):
    return T.decoded(spark, sf).select("doc_id", X.is_degenerate(F.col("text")).alias("degenerate"))


@query(f"""WITH {T.HYP}, {DEGENERATE} SELECT doc_id, CASE WHEN trim(text) = '' THEN 'empty' WHEN no_speech >= 0.65 THEN 'no_speech' WHEN compression >= 2.4 THEN 'compression' WHEN degenerate THEN 'degenerate'
WHEN (no_speech >= 0.35 OR logprob <= -1) AND regexp_matches(text, '(?i)licensed\\s+under') THEN 'boilerplate' END AS reason FROM deg""".replace("\\\\", "\\"))
def halluc_verdict(spark, sf):
    reason = X.verdict(F.col("text"), F.col("no_speech"), F.col("logprob"), F.col("compression"), phrases=(r"licensed\s+under",))
    return T.decoded(spark, sf).select("doc_id", reason.alias("reason"))


@query(f"""WITH {T.HYP}, {DEGENERATE}, v AS (SELECT CASE WHEN trim(text) = '' THEN 'empty' WHEN no_speech >= 0.65 THEN 'no_speech' WHEN compression >= 2.4 THEN 'compression' WHEN degenerate THEN 'degenerate' END AS reason FROM deg)
SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM v GROUP BY ALL""")
def halluc_counts(spark, sf):
    reason = X.verdict(F.col("text"), F.col("no_speech"), F.lit(0.0), F.col("compression"), phrases=())
    return T.decoded(spark, sf).select(F.coalesce(reason, F.lit("kept")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


TERMS = r"""occ AS (
    SELECT talk, sid, unnest(ts) AS term, generate_subscripts(ts, 1) AS pos FROM (SELECT talk, sid, regexp_extract_all(lower(text), '[\p{L}\p{N}_][\p{L}\p{N}_-]{3,}[\p{L}\p{N}_]') AS ts FROM seg)
), cnt AS (
    SELECT talk, term, count(*) AS n, min(sid * 1000000 + pos) AS f FROM occ GROUP BY talk, term
), r40 AS (
    SELECT *, row_number() OVER (PARTITION BY talk ORDER BY n DESC, f) AS r FROM cnt
), top AS (
    SELECT talk, term, n, row_number() OVER (PARTITION BY talk ORDER BY r) AS place FROM r40 WHERE r <= 40 AND term NOT IN ('should', 'because', 'example')
)"""


@query(f"WITH {T.SEG}, {TERMS} SELECT talk, place, term, n FROM top WHERE place <= 10")
def top_terms(spark, sf):
    return words.top_terms(T.segments(spark, sf), ["talk"])


_MAT = TERMS.replace("top AS (", "top AS MATERIALIZED (", 1)


@query(rf"""WITH RECURSIVE {T.SEG}, {_MAT}, hit AS MATERIALIZED (
    SELECT s.talk, t.place, t.term, s.sid FROM seg s JOIN top t ON t.talk = s.talk AND t.place <= 6 AND contains(lower(s.text), t.term) WHERE s.nw > 5
), p AS (
    SELECT DISTINCT talk, CAST(0 AS BIGINT) AS place, '' AS term, CAST(NULL AS BIGINT) AS sid, CAST([] AS BIGINT[]) AS seen FROM seg
    UNION ALL
    SELECT talk, place, term, sid, CASE WHEN sid IS NULL THEN seen ELSE list_append(seen, sid) END
    FROM (SELECT p.talk, p.place + 1 AS place, any_value(h.term) AS term, min(h.sid) FILTER (WHERE NOT list_contains(p.seen, h.sid)) AS sid, p.seen FROM p LEFT JOIN hit h ON h.talk = p.talk AND h.place = p.place + 1 WHERE p.place < 6 GROUP BY p.talk, p.place, p.seen)
)
SELECT talk, place, term, sid FROM p WHERE sid IS NOT NULL""")
def extractive_pick(spark, sf):
    rows = T.segments(spark, sf)
    return words.excerpts(rows, words.top_terms(rows, ["talk"]))


@query(rf"""WITH RECURSIVE {T.SEG}, l AS MATERIALIZED (SELECT talk, sid, CAST(length('[' || spk || '] ' || text) AS BIGINT) AS n FROM seg), p AS (
    SELECT talk, sid, CAST(0 AS BIGINT) AS chunk, n AS used FROM l WHERE sid = 1
    UNION ALL
    SELECT l.talk, l.sid, CASE WHEN p.used + l.n > 900 THEN p.chunk + 1 ELSE p.chunk END, CASE WHEN p.used + l.n > 900 THEN l.n ELSE p.used + l.n END FROM p JOIN l ON l.talk = p.talk AND l.sid = p.sid + 1
) SELECT talk, sid, chunk FROM p""")
def chunk_pack(spark, sf):
    return words.packed(T.segments(spark, sf), 900)


#: Terms with targets by language; an empty map keeps the term as it is.
GLOSSARY = {"the": {"de": "DER"}, "this": {}, "there is": {"de": "es gibt"}, "is": {"de": "ist"}}


@query(r"""WITH RECURSIVE g AS (
    SELECT conv_id, turn, text AS rest, '' AS masked, '' AS restored, 0 AS i FROM conversations
    UNION ALL
    SELECT conv_id, turn, substr(rest, length(pre) + length(hit) + 1), masked || pre || '§' || i || '§',
           restored || pre || CASE lower(hit) WHEN 'the' THEN 'DER' WHEN 'there is' THEN 'es gibt' WHEN 'is' THEN 'ist' ELSE hit END, i + 1
    FROM (
        SELECT *, regexp_extract(rest, '^(?is)((?:.*?[^\p{L}\p{N}_])??)(there\ is|this|the|is)(?:[^\p{L}\p{N}_]|$)', 1) AS pre,
               regexp_extract(rest, '^(?is)((?:.*?[^\p{L}\p{N}_])??)(there\ is|this|the|is)(?:[^\p{L}\p{N}_]|$)', 2) AS hit FROM g
    ) WHERE hit <> ''
)
SELECT conv_id, turn, arg_max(masked || rest, i) AS masked, arg_max(restored || rest, i) AS restored, CAST(max(i) AS BIGINT) AS n FROM g GROUP BY conv_id, turn""")
def glossary_mask(spark, sf):
    targets = F.create_map(*(F.lit(x) for term, to in GLOSSARY.items() if to.get("de") for x in (term, to["de"])))
    rows = T.read(spark, sf, "conversations").withColumn("p", X.protect(F.col("text"), X.glossary_pattern([*GLOSSARY])))
    return rows.select("conv_id", "turn", "p.masked", X.restore(F.col("p.masked"), F.col("p.found"), targets).alias("restored"), F.size("p.found").cast("long").alias("n"))


@query(rf"""WITH {T.WORD}, {T.RUNS}, s AS (
    SELECT talk, sid, regexp_replace(trim(regexp_replace(string_agg(text, ' ' ORDER BY idx), '\s+', ' ', 'g')), '\s+([,.!?;:…])', '\1', 'g') AS text, max(text) FILTER (WHERE p = 1) AS tail,
           avg(p / 10) AS conf, min(t0) AS s0, max(t1) AS s1 FROM word GROUP BY talk, sid
), clock AS (
    SELECT *, talk % 30 AS tape FROM s
), first AS (
    SELECT talk, min(a0) AS a0 FROM runs GROUP BY talk
)
SELECT c.talk, c.sid, c.text || coalesce(' ' || c.tail, '') AS text, length(c.text) AS stable_len, CASE WHEN c.talk % 2 = 0 THEN 'en' ELSE 'auto' END AS lang, round(c.conf, 3) AS conf,
       's' || c.sid % 3 AS spk, round(c.sid % 16 / 16, 2) AS spk_conf, round(coalesce(x.a0 + c.s0 - x.s0, f.a0, c.s0) / 1000, 2) AS t0, round(coalesce(y.a0 + c.s1 - y.s0, f.a0, c.s1) / 1000, 2) AS t1
FROM clock c ASOF LEFT JOIN runs x ON x.talk = c.tape AND c.s0 >= x.s0 ASOF LEFT JOIN runs y ON y.talk = c.tape AND c.s1 >= y.s0 LEFT JOIN first f ON f.talk = c.tape
WHERE c.text <> '' AND c.sid % 7 <> 3""")
def emit_segments(spark, sf):
    """Muted while the fourth of every seven segments is sent; speech times of a conversation run on the clock of one of the thirty channels."""
    own = T.words(spark, sf).groupBy("talk", "sid").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda w: w["text"]), " ").alias("text"),
        F.max(F.when(F.col("p") == 1, F.col("text"))).alias("tail"),
        words.confidence(F.collect_list(F.col("p") / 10)).alias("conf"),
        F.min("t0").alias("t0"),
        F.max("t1").alias("t1"),
    )
    own = own.withColumns({
        "lang": F.when(F.col("talk") % 2 == 0, "en"), "muted": F.col("sid") % 7 == 3, "spk": F.concat(F.lit("s"), (F.col("sid") % 3).cast("string")), "spk_conf": F.col("sid") % 16 / 16,
        "conv": F.col("talk"), "talk": F.col("talk") % 30,
    })
    runs = timeline.speech_runs(T.gated(spark, sf), 5)
    timed = timeline.to_absolute(timeline.to_absolute(own, runs, "t0", "t0"), runs, "t1", "t1").withColumn("talk", F.col("conv"))
    return words.emitted(timed.withColumns({"t0": F.col("t0") / 1000, "t1": F.col("t1") / 1000}))


# -- voices ---------------------------------------------------------------------------------------


@query(f"WITH {T.VEC} SELECT a.talk, a.id AS a, b.id AS b FROM vec a JOIN vec b ON b.talk = a.talk AND a.id < b.id WHERE list_inner_product(a.v, b.v) >= 0.3")
def cosine_pairs(spark, sf):
    return speakers.pair_cosines(T.vectors(spark, sf), ["talk"], LOOSE).select("talk", "a", "b")


#: The enrolled voices of a talk: the mean of each label.
ENROLLED = """sums AS (SELECT talk, label, i, sum(v[i]) AS x FROM (SELECT *, unnest(range(1, 65)) AS i FROM vec) GROUP BY talk, label, i),
lens AS (SELECT talk, label, sqrt(sum(x * x)) AS n FROM sums GROUP BY talk, label),
mid AS MATERIALIZED (SELECT s.talk, s.label, list(s.x / l.n ORDER BY i) AS v FROM sums s JOIN lens l ON l.talk = s.talk AND l.label = s.label GROUP BY s.talk, s.label)"""


def _enrolled(spark, sf):
    return speakers.centroids(T.vectors(spark, sf), ["talk", "label"], DIM)


@query(f"WITH {T.VEC}, {ENROLLED} SELECT a.talk, a.label AS a, b.label AS b, round(list_inner_product(a.v, b.v), 6) AS cos FROM mid a JOIN mid b ON b.talk = a.talk AND a.label < b.label")
def separability(spark, sf):
    """How alike the enrolled voices of a talk are."""
    found = speakers.pair_cosines(_enrolled(spark, sf).select("talk", F.col("label").alias("id"), F.col("c").alias("v")), ["talk"])
    return found.select("talk", "a", "b", F.round("cos", 6).alias("cos"))


@query(f"""WITH {T.VEC}, p AS (SELECT a.label = b.label AS same, list_inner_product(a.v, b.v) AS c FROM vec a JOIN vec b ON b.talk = a.talk AND a.id < b.id)
SELECT same, round(min(c), 6) AS least, round(max(c), 6) AS most, count(*) AS pairs FROM p GROUP BY same""")
def similarity_range(spark, sf):
    found = speakers.cosine_range(T.vectors(spark, sf), ["talk"])
    return found.select("same", F.round("least", 6).alias("least"), F.round("most", 6).alias("most"), "pairs")


def _centres(spark, sf):
    """The enrolled voices, in order of their labels."""
    return _enrolled(spark, sf).select("talk", F.concat(F.lit("c"), F.col("label").cast("string")).alias("spk"), F.col("label").alias("place"), "c")


TOP2 = ENROLLED + """, top2 AS (
    SELECT talk, id, max(spk) FILTER (WHERE k = 1) AS best, max(sim) AS best_sim, coalesce(max(sim) FILTER (WHERE k = 2), -1) AS second_sim FROM (
        SELECT x.talk, x.id, 'c' || c.label AS spk, list_inner_product(x.v, c.v) AS sim, row_number() OVER (PARTITION BY x.talk, x.id ORDER BY list_inner_product(x.v, c.v) DESC, c.label) AS k
        FROM vec x JOIN mid c ON c.talk = x.talk
    ) WHERE k <= 2 GROUP BY talk, id
)"""


@query(f"WITH {T.VEC}, {TOP2} SELECT talk, id, best, round(best_sim, 6) AS best_sim, round(second_sim, 6) AS second_sim FROM top2")
def top2_centroid(spark, sf):
    found = speakers.two_best(T.vectors(spark, sf), _centres(spark, sf))
    return found.select("talk", "id", "best", F.round("best_sim", 6).alias("best_sim"), F.round("second_sim", 6).alias("second_sim"))


@query(f"""WITH {T.VEC}, {TOP2} SELECT id, round(1 / (1 + exp(-((best_sim - 0.68) + (best_sim - second_sim - 0.08)) / 0.06)), 9) AS conf, round(least(0.6, 1 / (1 + exp(-(0.68 - best_sim - 0.08) / 0.06))), 6) AS fresh,
1 / (1 + exp(-((best_sim - 0.68) + (best_sim - second_sim - 0.08)) / 0.06)) < 0.45 AS vetoed FROM top2""")
def confidence(spark, sf):
    found = speakers.two_best(T.vectors(spark, sf), _centres(spark, sf))
    conf = V.confidence(F.col("best_sim"), F.col("second_sim"))
    return found.select("id", F.round(conf, 9).alias("conf"), F.round(V.new_confidence(F.col("best_sim")), 6).alias("fresh"), (conf < KNOBS.min_conf).alias("vetoed"))


@query(f"""WITH {T.VEC}, c AS (SELECT talk, label, i, sum(v[i] * (id % 7 + 1)) AS x FROM (SELECT *, unnest(range(1, 65)) AS i FROM vec) GROUP BY talk, label, i),
n AS (SELECT talk, label, sqrt(sum(x * x)) AS n FROM c GROUP BY talk, label)
SELECT talk, label, i, round(x / n, 6) AS x FROM c JOIN n USING (talk, label)""")
def weighted_centroid(spark, sf):
    found = speakers.centroids(T.vectors(spark, sf), ["talk", "label"], DIM, (F.col("id") % 7 + 1).cast("double"))
    return found.select("talk", "label", F.posexplode("c").alias("i", "x")).select("talk", "label", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"))


@query(f"""WITH {T.VEC}, w AS (SELECT talk, id // 60 AS sid, id // 10 % 6 AS pos, CASE WHEN id // 10 % 6 < talk % 5 + 1 THEN 0 ELSE 1 END AS label, CAST((id // 10 % 6) * 750 + 1500 AS DOUBLE) AS t1, v FROM vec),
m AS (SELECT talk, sid, label, i, avg(v[i]) AS x FROM (SELECT *, unnest(range(1, 65)) AS i FROM w) GROUP BY ALL),
d AS (SELECT a.talk, a.sid, sum(a.x * b.x) / sqrt(sum(a.x * a.x) * sum(b.x * b.x)) AS c FROM m a JOIN m b ON b.talk = a.talk AND b.sid = a.sid AND b.i = a.i AND b.label = 1 WHERE a.label = 0 GROUP BY a.talk, a.sid)
SELECT w.talk, w.sid, (max(t1) FILTER (WHERE label = 0) + min(t1) FILTER (WHERE label = 1)) / 2 AS at FROM w JOIN d ON d.talk = w.talk AND d.sid = w.sid WHERE d.c < 0.68 GROUP BY w.talk, w.sid""")
def change_points(spark, sf):
    rows = T.vectors(spark, sf).selectExpr(
        "talk", "id div 60 as sid", "id div 10 % 6 as pos", "case when id div 10 % 6 < talk % 5 + 1 then 0 else 1 end as label", "cast(id div 10 % 6 * 750 + 1500 as double) as t1", "v"
    )
    return speakers.change_points(rows, DIM)


@query(f"WITH {T.SEG}, s AS (SELECT talk, sid, (t1 - t0) * 16 AS n FROM seg) SELECT talk, sid, unnest(CASE WHEN n >= 24000 THEN range(0, n - 24000 + 1, 12000) ELSE [0] END) AS start, n FROM s")
def sliding_windows(spark, sf):
    rows = T.segments(spark, sf).selectExpr("talk", "sid", "(t1 - t0) * 16 as n")
    size, hop = int(KNOBS.window * KNOBS.sample_rate), int(KNOBS.hop * KNOBS.sample_rate)
    return speakers.windows(rows, size, hop).select("talk", "sid", "start", "n")


@query(f"""WITH {T.FRAME}, c AS (SELECT *, frame // 46 AS chunk FROM frame), m AS (SELECT *, max(level_db) OVER (PARTITION BY talk, ch, chunk) AS top FROM c)
SELECT talk, ch, chunk, count(*) AS n FROM m WHERE level_db >= top - 60 AND level_db >= -70 GROUP BY talk, ch, chunk HAVING count(*) >= 5""")
def voiced_chunks(spark, sf):
    keys = ["talk", "ch", "chunk"]
    rows = T.frames(spark, sf).withColumn("chunk", F.expr("frame div 46"))
    return speakers.enough_voiced(speakers.voiced(rows, keys, 60.0, -70.0), keys, 5)


_LOOSE = Knobs(assign=LOOSE, merge=0.35, refine=1 - LOOSE)


def _roster(spark, sf):
    """Three voices known beforehand: the means of three labels."""
    found = speakers.centroids(T.vectors(spark, sf).where("label < 3"), ["label"], DIM)
    return {f"V{r['label']}": r["c"] for r in found.orderBy("label").collect()}


#: Voices in the order they came: name, vector, segments, and if they are enrolled.
_VOICES = "STRUCT(name VARCHAR, v DOUBLE[], n BIGINT, fixed BOOLEAN)[]"


#: The voices known beforehand.
ROSTER = """rs AS (SELECT label, i, sum(v[i]) AS x FROM (SELECT *, unnest(range(1, 65)) AS i FROM vec WHERE label < 3) GROUP BY label, i),
rl AS (SELECT label, sqrt(sum(x * x)) AS n FROM rs GROUP BY label), ro AS (SELECT label, list(x / n ORDER BY i) AS v FROM rs JOIN rl USING (label) GROUP BY label)"""
ONLINE = f"""o AS MATERIALIZED (SELECT talk, id, v, row_number() OVER (PARTITION BY talk ORDER BY id) AS k FROM vec),
st AS (
    SELECT talk, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS sid, CAST((SELECT list({{'name': 'V' || label, 'v': v, 'n': 1, 'fixed': true}} ORDER BY label) FROM ro) AS {_VOICES}) AS voices, CAST(0 AS BIGINT) AS named,
           CAST(NULL AS VARCHAR) AS raw, CAST(0 AS DOUBLE) AS conf FROM (SELECT DISTINCT talk FROM vec)
    UNION ALL
    SELECT talk, k, id, CASE WHEN known THEN list_transform(voices, lambda r, i: CASE WHEN i = pos AND NOT r.fixed THEN {{'name': r.name, 'v': learnt, 'n': r.n + 1, 'fixed': false}} ELSE r END)
                             WHEN len(voices) >= 8 THEN voices ELSE list_append(voices, {{'name': 'S' || (named + 1), 'v': x, 'n': 1, 'fixed': false}}) END,
           CASE WHEN known OR len(voices) >= 8 THEN named ELSE named + 1 END, CASE WHEN known OR len(voices) >= 8 THEN voices[pos].name ELSE 'S' || (named + 1) END,
           CASE WHEN known OR len(voices) >= 8 THEN 1 / (1 + exp(-((best - 0.3) + (best - second - 0.08)) / 0.06)) ELSE least(0.6, 1 / (1 + exp(-(0.3 - best - 0.08) / 0.06))) END
    FROM (
        SELECT *, list_transform(moved, lambda c: c / sqrt(list_inner_product(moved, moved))) AS learnt FROM (
            SELECT *, best >= 0.3 AS known, list_transform(voices[pos].v, lambda c, i: (1 - share) * c + share * x[i]) AS moved FROM (
                SELECT *, 1 / CAST(least(voices[pos].n + 1, 20) AS DOUBLE) AS share FROM (
                    SELECT *, list_position(sims, best) AS pos, coalesce(list_max(list_concat(sims[:list_position(sims, best) - 1], sims[list_position(sims, best) + 1:])), -1) AS second FROM (
                        SELECT *, list_max(sims) AS best FROM (
                            SELECT s.talk, o.k, o.id, o.v AS x, s.voices, s.named, list_transform(s.voices, lambda r: list_inner_product(r.v, o.v)) AS sims FROM st s JOIN o ON o.talk = s.talk AND o.k = s.k + 1
                        )
                    )
                )
            )
        )
    )
)"""


@query(f"""WITH RECURSIVE {T.VEC}, {ROSTER}, {ONLINE} SELECT talk, sid, raw, CASE WHEN conf >= 0.45 THEN raw END AS spk, round(conf, 3) AS conf FROM st WHERE k > 0""")
def online_clusters(spark, sf):
    """Without merges, which are a query of their own."""
    rows = T.vectors(spark, sf).select("talk", F.col("id").alias("sid"), "v")
    return speakers.online_labels(rows, replace(_LOOSE, merge_every=10**9), _roster(spark, sf))


#: A step hears a segment, or looks at one voice of a merge pass (todo), which comes after every tenth segment.
MERGES = f"""o AS MATERIALIZED (SELECT talk, id, v, row_number() OVER (PARTITION BY talk ORDER BY id) AS k FROM vec),
st AS (
    SELECT talk, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS sid, CAST([] AS {_VOICES}) AS voices, CAST(0 AS BIGINT) AS named, CAST([] AS VARCHAR[]) AS todo,
           CAST([] AS STRUCT(was VARCHAR, now VARCHAR)[]) AS alias, CAST(0 AS BIGINT) AS step FROM (SELECT DISTINCT talk FROM vec)
    UNION ALL
    SELECT talk, CASE WHEN hears THEN ok ELSE k END, CASE WHEN hears THEN id ELSE sid END,
           CASE WHEN NOT hears AND stay IS NULL THEN voices
                WHEN NOT hears THEN list_filter(list_transform(voices, lambda r, i: CASE WHEN i = stay THEN {{'name': r.name, 'v': list_transform(joint, lambda c: c / sqrt(list_inner_product(joint, joint))), 'n': r.n + voices[gone].n, 'fixed': false}} ELSE r END), lambda r, i: i <> gone)
                WHEN known THEN list_transform(voices, lambda r, i: CASE WHEN i = pos THEN {{'name': r.name, 'v': list_transform(moved, lambda c: c / sqrt(list_inner_product(moved, moved))), 'n': r.n + 1, 'fixed': false}} ELSE r END)
                WHEN len(voices) >= 8 THEN voices ELSE list_append(voices, {{'name': 'S' || (named + 1), 'v': x, 'n': 1, 'fixed': false}}) END,
           CASE WHEN NOT hears OR known OR len(voices) >= 8 THEN named ELSE named + 1 END,
           CASE WHEN NOT hears THEN todo[2:] WHEN ok % 10 <> 0 THEN [] WHEN known OR len(voices) >= 8 THEN list_transform(voices, lambda r: r.name) ELSE list_append(list_transform(voices, lambda r: r.name), 'S' || (named + 1)) END,
           CASE WHEN hears OR stay IS NULL THEN alias
                ELSE list_append(list_transform(alias, lambda a: {{'was': a.was, 'now': CASE WHEN a.now = voices[gone].name THEN voices[stay].name ELSE a.now END}}), {{'was': voices[gone].name, 'now': voices[stay].name}}) END,
           step + 1
    FROM (
        SELECT *, list_transform(voices[stay].v, lambda c, i: c * voices[stay].n + voices[gone].v[i] * voices[gone].n) AS joint,
               list_transform(voices[pos].v, lambda c, i: (1 - 1 / CAST(least(voices[pos].n + 1, 20) AS DOUBLE)) * c + 1 / CAST(least(voices[pos].n + 1, 20) AS DOUBLE) * x[i]) AS moved
        FROM (
            SELECT *, coalesce(list_max(sims) >= 0.3, false) AS known, list_position(sims, list_max(sims)) AS pos,
                   CASE WHEN other > 0 THEN CASE WHEN voices[other].n >= voices[own].n THEN own ELSE other END END AS gone,
                   CASE WHEN other > 0 THEN CASE WHEN voices[other].n >= voices[own].n THEN other ELSE own END END AS stay
            FROM (
                SELECT *, list_position(list_transform(voices, lambda r, i: own > 0 AND i <> own AND list_inner_product(r.v, voices[own].v) >= 0.12), true) AS other
                FROM (
                    SELECT s.*, o.k AS ok, o.id, o.v AS x, len(s.todo) = 0 AS hears, CASE WHEN o.k IS NOT NULL THEN list_transform(s.voices, lambda r: list_inner_product(r.v, o.v)) END AS sims,
                           CASE WHEN len(s.todo) > 0 THEN list_position(list_transform(s.voices, lambda r: r.name), s.todo[1]) END AS own
                    FROM st s LEFT JOIN o ON o.talk = s.talk AND o.k = s.k + 1 AND len(s.todo) = 0 WHERE len(s.todo) > 0 OR o.k IS NOT NULL
                )
            )
        )
    )
), al AS (
    SELECT talk, k, sid, unnest(alias).was AS was, unnest(alias).now AS now FROM (SELECT talk, k, any_value(sid) AS sid, arg_max(alias, step) AS alias FROM st GROUP BY talk, k)
)"""


@query(f"""WITH RECURSIVE {T.VEC}, {MERGES} SELECT a.talk, a.sid, a.was AS old, a.now AS new FROM al a LEFT JOIN al b ON b.talk = a.talk AND b.k = a.k - 1 AND b.was = a.was WHERE b.now IS DISTINCT FROM a.now""")
def merged_voices(spark, sf):
    """So many voices are alike here that each talk has merges, and chains of them."""
    rows = T.vectors(spark, sf).select("talk", F.col("id").alias("sid"), "v")
    return speakers.merges(rows, Knobs(assign=LOOSE, merge=0.12))


def _refined_sql(weight: str) -> str:
    """Average linkage pair by pair, names by tagged members, then greedily, then by number."""
    return f"""e AS (SELECT talk, id, v, CAST({weight} AS DOUBLE) AS w, row_number() OVER (PARTITION BY talk ORDER BY id) AS p FROM vec),
tg AS (SELECT e.talk, e.p, any_value(e.w) AS w, CASE WHEN max(list_inner_product(e.v, ro.v)) >= 0.3 THEN arg_max(ro.label, list_inner_product(e.v, ro.v)) ELSE -1 END AS tag FROM e, ro GROUP BY e.talk, e.p),
pr AS MATERIALIZED (SELECT a.talk, a.p AS a, b.p AS b, a.w * b.w AS ww, 1 - list_inner_product(a.v, b.v) AS d FROM e a JOIN e b ON b.talk = a.talk AND b.p > a.p),
wl AS MATERIALIZED (SELECT talk, list(tag ORDER BY p) AS tags, list(p ORDER BY p) AS home FROM tg GROUP BY talk),
cl AS (
    SELECT talk, 0 AS k, home, tags FROM wl
    UNION ALL
    SELECT talk, k + 1, list_transform(home, lambda h: CASE WHEN h = j THEN i ELSE h END), tags FROM (
        SELECT *, row_number() OVER (PARTITION BY talk ORDER BY far, i, j) AS r FROM (
            SELECT c.talk, any_value(c.k) AS k, any_value(c.home) AS home, any_value(c.tags) AS tags, least(c.home[pr.a], c.home[pr.b]) AS i, greatest(c.home[pr.a], c.home[pr.b]) AS j, sum(pr.ww * pr.d) / sum(pr.ww) AS far,
                   max(CASE WHEN c.home[pr.a] < c.home[pr.b] THEN c.tags[pr.a] ELSE c.tags[pr.b] END) AS ti, max(CASE WHEN c.home[pr.a] < c.home[pr.b] THEN c.tags[pr.b] ELSE c.tags[pr.a] END) AS tj
            FROM cl c JOIN pr ON pr.talk = c.talk WHERE c.home[pr.a] <> c.home[pr.b] GROUP BY c.talk, least(c.home[pr.a], c.home[pr.b]), greatest(c.home[pr.a], c.home[pr.b])
        ) WHERE NOT (ti >= 0 AND tj >= 0 AND ti <> tj)
    ) WHERE r = 1 AND far <= 0.7
), fin AS (SELECT talk, unnest(home) AS home, unnest(tags) AS tag, generate_subscripts(home, 1) AS p FROM (SELECT talk, arg_max(home, k) AS home, any_value(tags) AS tags FROM cl GROUP BY talk)),
num AS (SELECT talk, p, tag, dense_rank() OVER (PARTITION BY talk ORDER BY home) - 1 AS c FROM fin),
cs AS (SELECT n.talk, n.c, i, sum(e.v[i] * e.w) AS x FROM num n JOIN e ON e.talk = n.talk AND e.p = n.p, range(1, 65) t(i) GROUP BY n.talk, n.c, i),
mid AS MATERIALIZED (SELECT talk, c, list(x / len ORDER BY i) AS v FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY talk, c)) AS len FROM cs) GROUP BY talk, c),
ct AS (SELECT talk, c, max(tag) AS tag FROM num GROUP BY talk, c),
off AS MATERIALIZED (SELECT m.talk, m.c, ro.label, row_number() OVER (PARTITION BY m.talk ORDER BY list_inner_product(m.v, ro.v) DESC, m.c, ro.label) AS n FROM mid m JOIN ct ON ct.talk = m.talk AND ct.c = m.c AND ct.tag < 0, ro WHERE list_inner_product(m.v, ro.v) >= 0.3),
gr AS (
    SELECT talk, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(c BIGINT, label BIGINT)[]) AS got, CAST(coalesce(list(tag) FILTER (WHERE tag >= 0), []) AS BIGINT[]) AS used FROM ct GROUP BY talk
    UNION ALL
    SELECT talk, n, CASE WHEN ok THEN list_append(got, {{'c': c, 'label': label}}) ELSE got END, CASE WHEN ok THEN list_append(used, label) ELSE used END
    FROM (SELECT g.talk, o.n, o.c, o.label, g.got, g.used, NOT list_contains(g.used, o.label) AND NOT list_contains(list_transform(g.got, lambda x: x.c), o.c) AS ok FROM gr g JOIN off o ON o.talk = g.talk AND o.n = g.n + 1)
), gn AS (SELECT talk, unnest(got) AS x FROM (SELECT talk, arg_max(got, n) AS got FROM gr GROUP BY talk)),
refined AS (
    SELECT e.talk, e.id AS sid, CASE WHEN ct.tag >= 0 THEN 'V' || ct.tag WHEN gn.x IS NOT NULL THEN 'V' || gn.x.label ELSE 'R' || (n.c + 1) END AS spk, round(greatest(least(list_inner_product(e.v, m.v), 1), 0), 3) AS conf
    FROM e JOIN num n ON n.talk = e.talk AND n.p = e.p JOIN ct ON ct.talk = n.talk AND ct.c = n.c JOIN mid m ON m.talk = n.talk AND m.c = n.c LEFT JOIN gn ON gn.talk = n.talk AND gn.x.c = n.c
)"""


@query(f"WITH RECURSIVE {T.VEC}, {ROSTER}, {_refined_sql('id % 5 + 1')} SELECT talk, sid, spk, conf FROM refined")
def refined_labels(spark, sf):
    rows = T.vectors(spark, sf).select("talk", F.col("id").alias("sid"), "v", (F.col("id") % 5 + 1).cast("double").alias("weight"))
    return speakers.refined_labels(rows, _LOOSE, _roster(spark, sf))


@query(f"""WITH RECURSIVE {T.VEC}, {ROSTER}, {ONLINE}, {_refined_sql('1')}, onl AS (SELECT talk, sid, CASE WHEN conf >= 0.45 THEN raw END AS was FROM st WHERE k > 0)
SELECT onl.talk, onl.sid, onl.was, refined.spk AS now, refined.conf FROM onl JOIN refined ON refined.talk = onl.talk AND refined.sid = onl.sid WHERE onl.was IS DISTINCT FROM refined.spk ORDER BY onl.talk, onl.sid""")
def label_fixes(spark, sf):
    rows = T.vectors(spark, sf).select("talk", F.col("id").alias("sid"), "v", F.lit(1.0).alias("weight"))
    known = _roster(spark, sf)
    return speakers.differing(speakers.online_labels(rows.drop("weight"), replace(_LOOSE, merge_every=10**9), known), speakers.refined_labels(rows, _LOOSE, known))


@query(f"""WITH {T.MSG}, s AS (SELECT talk, sid, seq, spk FROM msg WHERE t = 'spk') SELECT talk, sid, seq, CASE spk WHEN 's3' THEN 's1' WHEN 's4' THEN 's1' ELSE spk END AS spk FROM s""")
def merged_history(spark, sf):
    rows = T.messages(spark, sf).where("t = 'spk'").select("talk", "sid", "seq", "spk")
    aliases = rows.select("talk").distinct().withColumn("old", F.explode(F.array(F.lit("s3"), F.lit("s4")))).withColumn("new", F.lit("s1"))
    return speakers.realias(rows, aliases).select("talk", "sid", "seq", "spk")


# -- scoring --------------------------------------------------------------------------------------


def _grid(spark, sf):
    return materialised(scoring.grid(*T.spans(spark, sf), 10, int(KNOBS.collar * 100)))


@query(f"WITH {T.GRID} SELECT scenario, count(*) AS cells, count(ref) AS ref_cells, count(hyp) AS hyp_cells, CAST(sum(cell) AS BIGINT) AS checksum FROM grid GROUP BY scenario")
def der_grid(spark, sf):
    n, total = F.col("n"), lambda c: F.sum(F.when(F.col(c).isNotNull(), F.col("n")).otherwise(0))
    checksum = F.sum(F.expr("n * (2 * cell + n - 1) div 2"))
    return _grid(spark, sf).groupBy("scenario").agg(F.sum(n).alias("cells"), total("ref").alias("ref_cells"), total("hyp").alias("hyp_cells"), checksum.alias("checksum"))


@query(f"WITH {T.GRID} SELECT scenario, hyp, ref, count(*) AS n FROM grid WHERE ref IS NOT NULL AND hyp IS NOT NULL GROUP BY scenario, hyp, ref")
def der_overlaps(spark, sf):
    return scoring.overlaps(_grid(spark, sf))


#: Every one-to-one mapping of up to three hypothesis labels, by its overlap.
BEST = """ov AS (
    SELECT scenario, hyp, ref, count(*) AS n FROM grid WHERE ref IS NOT NULL AND hyp IS NOT NULL GROUP BY scenario, hyp, ref
), o AS (
    SELECT scenario, hyp, ref, n FROM ov UNION ALL SELECT DISTINCT scenario, hyp, CAST(NULL AS VARCHAR), 0 FROM (SELECT scenario, unnest(['h0', 'h1', 'h2']) AS hyp FROM (SELECT DISTINCT scenario FROM grid))
), best AS (
    SELECT a.scenario, max(a.n + b.n + c.n) AS mapped FROM o a JOIN o b ON b.scenario = a.scenario AND b.hyp = 'h1' AND (a.ref IS NULL OR b.ref IS NULL OR a.ref <> b.ref)
    JOIN o c ON c.scenario = a.scenario AND c.hyp = 'h2' AND (a.ref IS NULL OR c.ref IS NULL OR a.ref <> c.ref) AND (b.ref IS NULL OR c.ref IS NULL OR b.ref <> c.ref) WHERE a.hyp = 'h0' GROUP BY a.scenario
)"""


@query(f"WITH {T.GRID}, {BEST} SELECT scenario, CAST(mapped AS BIGINT) AS mapped FROM best WHERE mapped > 0")
def der_optimal_map(spark, sf):
    overlap = scoring.overlaps(_grid(spark, sf))
    chosen = overlap.join(scoring.mapping(overlap), ["scenario", "hyp"]).where("ref = mapped")
    return chosen.groupBy("scenario").agg(F.sum("n").alias("mapped"))


DER = """der AS (
    SELECT scenario, count(ref) AS total, count(*) FILTER (WHERE ref IS NOT NULL AND hyp IS NULL) AS miss, count(*) FILTER (WHERE ref IS NULL AND hyp IS NOT NULL) AS false_alarm,
           count(*) FILTER (WHERE ref IS NOT NULL AND hyp IS NOT NULL) - CAST(any_value(mapped) AS BIGINT) AS confusion FROM grid JOIN best USING (scenario) GROUP BY scenario
), scored AS (
    SELECT scenario, total, CASE WHEN total > 0 THEN miss ELSE 0 END AS miss, CASE WHEN total > 0 THEN false_alarm ELSE 0 END AS false_alarm, CASE WHEN total > 0 THEN confusion ELSE 0 END AS confusion,
           CASE WHEN total > 0 THEN (miss + false_alarm + confusion) / total ELSE 0 END AS der FROM der
)"""


def _scores(spark, sf):
    counted = _grid(spark, sf)
    return scoring.components(counted, scoring.mapping(scoring.overlaps(counted)))


@query(f"WITH {T.GRID}, {BEST}, {DER} SELECT scenario, total, miss, false_alarm, confusion, confusion AS wrong_name, round(der, 9) AS der FROM scored")
def der_components(spark, sf):
    return _scores(spark, sf).withColumn("der", F.round("der", 9))


@query(f"WITH {T.GRID} SELECT scenario, count(DISTINCT ref) AS ref_speakers, count(DISTINCT hyp) AS hyp_speakers FROM grid GROUP BY scenario")
def der_speakers(spark, sf):
    return scoring.label_counts(_grid(spark, sf))


@query(f"""WITH {T.GRID}, {BEST}, {DER} SELECT scenario, 'online' AS kind, CASE WHEN scenario % 3 = 0 THEN 'new' WHEN der > (scenario % 5) * 0.05 + 0.02 THEN 'worse' ELSE 'ok' END AS state FROM scored""")
def baseline_regressions(spark, sf):
    now = materialised(_scores(spark, sf).select("scenario", F.lit("online").alias("kind"), "der"))
    base = now.where("scenario % 3 != 0").select("scenario", "kind", ((F.col("scenario") % 5) * 0.05).alias("der"))
    return scoring.regressions(now, base, KNOBS.tolerance).select("scenario", "kind", "state")
