"""The driver's tables in the shapes the operators take, in Spark and as common table expressions.

Times are whole milliseconds, so that both engines count alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr(
        "user_id % 20 as talk",
        "event_id as seq",
        "event_id % 37 as sid",
        "cast(floor(value) as bigint) % 6 + 1 as rev",
        "case event_type when 'view' then 'seg' when 'click' then 'seg' when 'purchase' then 'spk' when 'signup' then 'tr' else 'health' end as t",
        "event_type || props as text",
        "event_id % 3 <> 0 as final",
        "event_id % 2 = 0 as stable",
        "element_at(array('en', 'ru', 'de', 'fr'), cast(event_id % 4 as int) + 1) as lang",
        "'s' || cast(event_id div 4 % 5 as string) as spk",
        "cast(floor(value) as bigint) as value",
        "event_id % 8 / 8 as spk_conf",
        "event_id % 16 / 16 as conf",
        "event_id * 2 / 4 as t0",
        "event_id * 2 / 4 + 1.5d as t1",
        "event_id + 0.25d as emitted_at",
    )


def logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with edits: some health messages edit the text of their segment instead."""
    edit = (F.col("t") == "health") & (F.col("value") % 3 == 0)
    return messages(spark, sf_dir).withColumns({"text": F.when(edit, F.concat(F.lit("edited "), F.col("seq").cast("string"))).otherwise(F.col("text")), "t": F.when(edit, "edit").otherwise(F.col("t"))})


LOGGED = """logged AS (
    SELECT * EXCLUDE (t, text), CASE WHEN t = 'health' AND value % 3 = 0 THEN 'edit' ELSE t END AS t, CASE WHEN t = 'health' AND value % 3 = 0 THEN 'edited ' || seq ELSE text END AS text FROM msg
)"""

MSG = """msg AS (
    SELECT user_id % 20 AS talk, event_id AS seq, event_id % 37 AS sid, CAST(floor(value) AS BIGINT) % 6 + 1 AS rev,
           CASE event_type WHEN 'view' THEN 'seg' WHEN 'click' THEN 'seg' WHEN 'purchase' THEN 'spk' WHEN 'signup' THEN 'tr' ELSE 'health' END AS t,
           event_type || props AS text, event_id % 3 <> 0 AS final, event_id % 2 = 0 AS stable,
           list_extract(['en', 'ru', 'de', 'fr'], event_id % 4 + 1) AS lang, 's' || (event_id // 4 % 5) AS spk, CAST(floor(value) AS BIGINT) AS value,
           event_id % 8 / 8 AS spk_conf, event_id % 16 / 16 AS conf, event_id * 2 / 4 AS t0, event_id * 2 / 4 + CAST(1.5 AS DOUBLE) AS t1, event_id + CAST(0.25 AS DOUBLE) AS emitted_at
    FROM events
)"""

JUDGED = (
    MSG
    + """, begun AS (
    SELECT *, max(t = 'seg') OVER (PARTITION BY talk, sid ORDER BY seq) AS b FROM msg WHERE t IN ('seg', 'spk')
), judged AS (
    SELECT * EXCLUDE (b), coalesce(rev > max(rev) OVER (PARTITION BY talk, sid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS accepted
    FROM begun WHERE b
)"""
)

CURRENT = (
    JUDGED
    + """, cur AS (
    SELECT talk, sid, max(rev) AS rev, arg_max(final, seq) FILTER (WHERE t = 'seg') AS final, arg_max(stable, seq) FILTER (WHERE t = 'seg') AS stable,
           arg_max(lang, seq) FILTER (WHERE t = 'seg') AS lang, arg_max(text, seq) FILTER (WHERE t = 'seg') AS text, arg_max(spk, seq) AS spk, arg_max(spk_conf, seq) AS spk_conf,
           arg_max(conf, seq) FILTER (WHERE t = 'seg') AS conf, arg_max(t0, seq) FILTER (WHERE t = 'seg') AS t0, arg_max(t1, seq) FILTER (WHERE t = 'seg') AS t1,
           arg_max(emitted_at, seq) FILTER (WHERE t = 'seg') AS emitted_at
    FROM judged WHERE accepted GROUP BY talk, sid
)"""
)


def translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last `tr` message of each (talk, sid, lang)."""
    own = messages(spark, sf_dir).where("t = 'tr'").groupBy("talk", "sid", "lang").agg(F.max_by(F.struct("rev", "text"), "seq").alias("x"))
    return own.select("talk", "sid", "lang", "x.rev", "x.text")


TR = """tr AS (
    SELECT talk, sid, lang, arg_max(rev, seq) AS rev, arg_max(text, seq) AS text FROM msg WHERE t = 'tr' GROUP BY talk, sid, lang
)"""


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).selectExpr("talk", "lang", "seq", "case when value % 2 = 0 then 'attach' else 'detach' end as op")


SUBS = "subs AS (SELECT talk, lang, seq, CASE WHEN value % 2 = 0 THEN 'attach' ELSE 'detach' END AS op FROM msg)"
COUNTED = (
    SUBS
    + """, free AS (
    SELECT *, sum(CASE WHEN op = 'attach' THEN 1 ELSE -1 END) OVER (PARTITION BY talk, lang ORDER BY seq) AS f FROM subs
), counted AS (
    SELECT talk, lang, seq, op, CAST(f - least(0, min(f) OVER (PARTITION BY talk, lang ORDER BY seq)) AS BIGINT) AS n FROM free
)"""
)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    nw = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).cast("long")
    rows = read(spark, sf_dir, "conversations").withColumn("nw", nw)
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    t0 = 400 * F.coalesce(F.sum("nw").over(before), F.lit(0)) + 700 * F.col("turn")
    return rows.select(
        F.col("conv_id").alias("talk"), (F.col("turn") + 1).alias("sid"), F.col("turn"), F.col("role").alias("spk"), "text", "nw", t0.alias("t0")
    ).withColumn("t1", F.col("t0") + 400 * F.col("nw"))


SEG = r"""seg AS (
    SELECT conv_id AS talk, turn + 1 AS sid, turn, role AS spk, text, nw,
           CAST(400 * coalesce(sum(nw) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 700 * turn AS BIGINT) AS t0,
           CAST(400 * coalesce(sum(nw) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 700 * turn + 400 * nw AS BIGINT) AS t1
    FROM (SELECT *, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS BIGINT) AS nw FROM conversations)
)"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(talk, sid, idx, text, t0, t1, p): idx counts through the talk, p is a tenth of a probability."""
    own = segments(spark, sf_dir).select(
        "talk", "sid", F.col("t0").alias("s0"), F.posexplode(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("pos", "w")
    )
    return own.selectExpr("talk", "sid", "sid * 100000 + pos as idx", "w as text", "s0 + 400 * pos as t0", "s0 + 400 * pos + 350 as t1", "cast(length(w) % 10 + 1 as bigint) as p")


WORD = (
    SEG
    + r""", word AS (
    SELECT talk, sid, sid * 100000 + pos AS idx, w AS text, t0 + 400 * pos AS t0, t0 + 400 * pos + 350 AS t1, CAST(length(w) % 10 + 1 AS BIGINT) AS p
    FROM (
        SELECT talk, sid, t0, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos
        FROM (SELECT *, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS ws FROM seg)
    )
)"""
)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(talk, ch, frame, level_db): 10 talks of 3 channels, levels that both engines compute alike."""
    rows = read(spark, sf_dir, "events").selectExpr("user_id % 10 as talk", "user_id % 3 as ch", "event_id", "-90 + value / 5 as level_db")
    frame = F.row_number().over(Window.partitionBy("talk", "ch").orderBy("event_id")).cast("long") - 1
    return rows.withColumn("frame", frame).select("talk", "ch", "frame", "level_db")


FRAME = """frame AS (
    SELECT user_id % 10 AS talk, user_id % 3 AS ch, row_number() OVER (PARTITION BY user_id % 10, user_id % 3 ORDER BY event_id) - 1 AS frame,
           -90 + value / 5 AS level_db
    FROM events
)"""

#: A level that about a fifth of the frames exceed.
GATE_DB = -75.0


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(talk, t, dur) in ms of the frames that pass the gate; each channel counts as a talk, by talk * 3 + ch."""
    return frames(spark, sf_dir).where(F.col("level_db") > GATE_DB).selectExpr("talk * 3 + ch as talk", "frame * 32 as t", "cast(32 as bigint) as dur")


RUNS = (
    FRAME
    + """, gated AS (
    SELECT talk * 3 + ch AS talk, frame * 32 AS t, 32 AS dur FROM frame WHERE level_db > -75
), fresh AS (
    SELECT *, CASE WHEN coalesce(abs(t - lag(t + dur) OVER (PARTITION BY talk ORDER BY t)) > 5, true) THEN 1 ELSE 0 END AS f FROM gated
), numbered AS (
    SELECT *, sum(f) OVER (PARTITION BY talk ORDER BY t) AS run FROM fresh
), bare AS (
    SELECT talk, CAST(run AS BIGINT) AS run, min(t) AS a0, CAST(sum(dur) AS BIGINT) AS dur FROM numbered GROUP BY talk, run
), runs AS (
    SELECT talk, run, CAST(coalesce(sum(dur) OVER (PARTITION BY talk ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s0, a0, dur FROM bare
)"""
)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") % 10).alias("talk"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("long").alias("label")
    )


VEC = "vec AS (SELECT vec_id % 10 AS talk, vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, CAST(label AS BIGINT) AS label FROM embeddings)"


def spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Reference and hypothesis spans; the hypothesis is late by up to 260 ms and knows nothing in every fifth turn."""
    own = segments(spark, sf_dir).withColumn("scenario", F.col("talk"))
    ref = own.selectExpr("scenario", "turn as ord", "spk", "t0", "t1")
    hyp = own.selectExpr(
        "scenario", "turn as ord", "case when turn % 5 = 4 then null else 'h' || cast(turn div 2 % 3 as string) end as spk", "t0 + turn % 3 * 130 as t0", "t1 + turn % 3 * 130 as t1"
    )
    return ref, hyp


GRID = (
    SEG
    + """, ref AS (
    SELECT talk AS scenario, turn AS ord, spk, t0, t1 FROM seg
), hyp AS (
    SELECT talk AS scenario, turn AS ord, CASE WHEN turn % 5 = 4 THEN NULL ELSE 'h' || (turn // 2 % 3) END AS spk, t0 + turn % 3 * 130 AS t0, t1 + turn % 3 * 130 AS t1 FROM seg
), rc AS (
    SELECT scenario, cell, arg_max(spk, ord) AS ref FROM (SELECT *, unnest(range(t0 // 10, t1 // 10)) AS cell FROM ref WHERE spk IS NOT NULL) GROUP BY scenario, cell
), hc AS (
    SELECT scenario, cell, arg_max(spk, ord) AS hyp FROM (SELECT *, unnest(range(t0 // 10, t1 // 10)) AS cell FROM hyp WHERE spk IS NOT NULL) GROUP BY scenario, cell
), edge AS (
    SELECT DISTINCT scenario, unnest(range(t // 10 - 25, t // 10 + 26)) AS cell FROM (SELECT scenario, t0 AS t FROM ref UNION ALL SELECT scenario, t1 FROM ref)
), grid AS (
    SELECT scenario, cell, ref, hyp FROM (SELECT * FROM rc FULL JOIN hc USING (scenario, cell)) ANTI JOIN edge USING (scenario, cell)
)"""
)


def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as decoded text with made-up doubts of the recogniser."""
    return read(spark, sf_dir, "documents").selectExpr(
        "doc_id", "text", "(doc_id % 100) / 100 as no_speech", "-(doc_id % 30) / 10 as logprob", "1 + (doc_id % 20) / 10 as compression"
    )


HYP = "dec AS (SELECT doc_id, text, (doc_id % 100) / 100 AS no_speech, -(doc_id % 30) / 10 AS logprob, 1 + (doc_id % 20) / 10 AS compression FROM documents)"
