"""The message log as JSON lines: explicit schema, defaults, no inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.schema import MESSAGE, SEG_DEFAULTS


def parsed(lines: DataFrame, column: str = "value", *others: str) -> DataFrame:
    """Message rows of JSON lines, with other columns of the lines; lines that are no JSON and messages without talk or type go."""
    rows = lines.select(F.from_json(F.col(column).cast("string"), MESSAGE).alias("m"), *others).select("m.*", *others)
    filled = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in SEG_DEFAULTS.items()}
    return rows.where("talk is not null and t is not null").withColumns(filled)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark.read.text(path))


def stream_log(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    return parsed(spark.readStream.format("text").option("maxFilesPerTrigger", files_at_once).load(path))


def written(rows: DataFrame, *columns: str) -> Column | DataFrame:
    """Rows as JSON lines, nulls left out."""
    return rows.select(F.to_json(F.struct(*(columns or rows.columns))).alias("value"))


def stamped(rows: DataFrame, talk: str, now: Column) -> DataFrame:
    """Talk and time of emission where they are not given."""
    return rows.withColumn("talk", F.coalesce("talk", F.lit(talk))).withColumn("emitted_at", F.coalesce("emitted_at", now.cast("double")))


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """(scenario, kind, der) of a JSON file {"scenarios": {name: {kind: der}}}."""
    rows = spark.read.schema("scenarios map<string, map<string, double>>").option("multiLine", True).json(path)
    inner = rows.select(F.explode("scenarios").alias("scenario", "kinds"))
    return inner.select("scenario", F.explode("kinds").alias("kind", "der"))
