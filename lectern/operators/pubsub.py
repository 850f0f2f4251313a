"""Who listens to what."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.text import control_topic, topic


def counted(subscriptions: DataFrame) -> DataFrame:
    """Each (talk, lang, seq, op) row with the listeners after it; a detach at zero stays at zero.

    A walk that is held at zero is the free walk less its lowest point below
    zero, so no fold is needed.
    """
    upto = Window.partitionBy("talk", "lang").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.when(F.col("op") == "attach", 1).otherwise(-1)
    free = subscriptions.withColumn("__free", F.sum(step).over(upto))
    return free.withColumn("n", F.col("__free") - F.least(F.lit(0), F.min("__free").over(upto))).drop("__free")


def listeners(subscriptions: DataFrame) -> DataFrame:
    last = counted(subscriptions).groupBy("talk", "lang").agg(F.max_by("n", "seq").alias("n"))
    return last.where("n > 0")


def activations(subscriptions: DataFrame) -> DataFrame:
    """Rows at which a language gets its first listener."""
    return counted(subscriptions).where("op = 'attach' and n = 1").select("talk", "lang", "seq")


def targets(messages: DataFrame, active: DataFrame) -> DataFrame:
    """Languages a message is to be translated into: those with listeners, less its own."""
    return messages.join(active.select("talk", F.col("lang").alias("target")), "talk").where("target != lang")


def fan_out(messages: DataFrame, source_lang: str) -> DataFrame:
    """One row for each topic a message goes to."""
    talk = F.col("talk")
    topics = F.array_distinct(F.array(topic(talk, F.col("lang")), topic(talk, F.lit(source_lang)), control_topic(talk)))
    return messages.withColumn("topic", F.explode(topics))


def delivered(messages: DataFrame, switches: DataFrame) -> DataFrame:
    """(talk, viewer, seq, lang) of the messages a viewer gets: those in the language the viewer chose last before them.

    messages: (talk, seq, lang); switches: (talk, viewer, seq, lang).
    """
    order = Window.partitionBy("talk", "viewer").orderBy("seq")
    held = switches.select("talk", "viewer", "lang", F.col("seq").alias("__from"), F.lead("seq").over(order).alias("__to"))
    rows = messages.select("talk", "seq", "lang").join(held, ["talk", "lang"])
    return rows.where("seq > __from and (__to is null or seq < __to)").select("talk", "viewer", "seq", "lang")


def bounded(deliveries: DataFrame, drains: DataFrame, room: int = 500) -> DataFrame:
    """(talk, viewer, seq, dropped): a viewer's queue holds `room` messages, and what comes while it is full is dropped.

    deliveries: (talk, viewer, seq); drains: (talk, viewer, seq), at which a
    viewer reads all that waits.
    """
    rows = deliveries.select("talk", "viewer", "seq", F.lit(0).alias("__read")).unionByName(drains.select("talk", "viewer", "seq", F.lit(1).alias("__read")))
    upto = Window.partitionBy("talk", "viewer").orderBy("seq", F.desc("__read"))
    turn = rows.withColumn("__turn", F.sum("__read").over(upto)).where("__read = 0")
    place = F.row_number().over(Window.partitionBy("talk", "viewer", "__turn").orderBy("seq"))
    return turn.select("talk", "viewer", "seq", (place > room).alias("dropped"))


def merged_health(reports: DataFrame) -> DataFrame:
    """The last value of each key of a talk."""
    return reports.groupBy("talk", "key").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))
