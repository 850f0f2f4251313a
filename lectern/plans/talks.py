"""Whole jobs over the log: translation with an injected engine, summaries, speaker evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.config import LANGS, Knobs
from lectern.functions import text as X
from lectern.operators import pubsub, revlog, scoring, words
from lectern.session import materialised

#: What is put before a part of a talk, notes that become one, and characters of one that are kept.
PART = "Notes of this part of a talk; no numbers that are not in it.\n"
FAN_IN, NOTE_CHARS = 8, 3_000

#: Engine: texts, source and target language to translations; None where it fails.
Engine = Callable[[list[str], list[str], list[str]], list[str | None]]


def translate(wanted: DataFrame, translations: DataFrame, glossary: dict[str, dict[str, str]], engine: Engine, parallel: int = 6) -> DataFrame:
    """(talk, sid, lang, rev, text) for what the translations don't hold yet.

    wanted: (talk, sid, rev, lang, own_lang, text). Terms of the glossary are
    masked for the engine and come back in the target language; a failed call
    shows the original. At most `parallel` calls run at once.
    """
    todo = revlog.cache_misses(wanted, translations)
    pattern = X.glossary_pattern([*glossary]) if glossary else r"(?!)()"
    rows = todo.withColumn("p", X.protect(F.col("text"), pattern)).repartition(parallel)  # only the calls, not what comes before

    @F.pandas_udf("string")
    def call(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, own, lang in parts:
            yield pd.Series(engine(text.tolist(), own.tolist(), lang.tolist()))

    by_lang = F.lit(None).cast("map<string,string>")
    for lang in LANGS:
        pairs = [F.lit(x) for term, to in glossary.items() if to.get(lang) for x in (term, to[lang])]
        by_lang = F.when(F.col("lang") == lang, F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).otherwise(by_lang)
    done = rows.withColumn("made", call("p.masked", "own_lang", "lang")).withColumn("targets", F.coalesce(by_lang, F.create_map().cast("map<string,string>")))
    back = X.restore(F.col("made"), F.col("p.found"), F.col("targets"))
    return done.select("talk", "sid", "lang", "rev", F.coalesce(back, "text").alias("text"), F.col("made").isNull().alias("failed"))


def wanted_translations(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """What is to be translated: fresh final stable messages, for each language with listeners but their own."""
    gate = pubsub.targets(revlog.to_translate(messages), pubsub.listeners(subscriptions))
    return gate.select("talk", "sid", "rev", F.col("target").alias("lang"), F.col("lang").alias("own_lang"), "text")


def _asked(rows: DataFrame, model: Callable[[str, int], str], lead, tokens: int) -> DataFrame:
    """(talk, place, note) of rows (talk, place, text), each row a call in a task of its own choosing; null where text is null or the model fails."""

    @F.pandas_udf("string")
    def call(texts: pd.Series) -> pd.Series:
        def one(text):
            try:
                return None if text is None else model(text, tokens)[:NOTE_CHARS]
            except Exception:  # any failure of the injected model
                return None

        return texts.map(one, na_action="ignore").astype(object).where(texts.notna(), None)

    dealt = rows.withColumn("prompt", F.concat(lead, "text")).repartition("talk", "place")
    return dealt.select("talk", "place", call("prompt").alias("note"))


def condensed(texts: DataFrame, titles: DataFrame, model: Callable[[str, int], str], most: int) -> DataFrame:
    """(talk, written): a model's summary of the chunks (talk, chunk, text) of a talk, as a tree of calls.

    Each chunk, and each piece of `most` characters of a longer one, gets notes
    of its own; FAN_IN notes become one, until a talk has so many at most, of
    which the summary is made. No prompt holds more than `most` characters of a
    talk or FAN_IN notes of NOTE_CHARS; all calls of a level are tasks of one
    job. A talk one of whose calls fails has null.
    """
    cuts = F.sequence(F.lit(0), F.greatest(F.ceil(F.char_length("text") / most) - 1, F.lit(0)).cast("int"))
    pieces = texts.select("talk", "chunk", "text", F.explode(cuts).alias("k")).select("talk", "chunk", "k", F.substring(F.col("text"), F.col("k") * most + 1, F.lit(most)).alias("text"))
    place = F.row_number().over(Window.partitionBy("talk").orderBy("chunk", "k")) - 1
    level = materialised(_asked(pieces.withColumn("place", place), model, F.lit(PART), 600))

    def joined(rows, group):
        whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "note"))), lambda x: x["note"]), "\n\n")
        return rows.groupBy("talk", group.alias("own")).agg(F.when(F.count("note") == F.count(F.lit(1)), whole).alias("text")).withColumnRenamed("own", "place")

    while (level.agg(F.max("place")).first()[0] or 0) >= FAN_IN:
        level = materialised(_asked(joined(level, F.floor(F.col("place") / FAN_IN).cast("int")), model, F.lit(PART), 600))
    last = joined(level, F.lit(0)).join(titles.select("talk", "title"), "talk")
    lead = F.concat(F.lit("Summary of the talk '"), "title", F.lit("' from these notes.\n"))
    return _asked(last, model, lead, 1200).select("talk", F.col("note").alias("written"))


def summaries(segments: DataFrame, titles: DataFrame, model: Callable[[str, int], str] | None = None, most: int = 6000) -> DataFrame:
    """(talk, summary). Without a model, or where it fails: key terms and the excerpts that hold them.

    model(prompt, tokens): notes of each chunk first, then notes of notes, then one text (condensed).
    segments: (talk, sid, spk, text, t0, t1 in ms); talks without segments get a fixed text.
    """
    terms = words.top_terms(segments, ["talk"])
    picks = words.excerpts(segments, terms).join(segments.select("talk", "sid", "text"), ["talk", "sid"])
    listed = terms.groupBy("talk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda x: x["term"]), ", ").alias("terms"))
    quoted = picks.groupBy("talk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: F.concat(F.lit("- "), x["text"])), "\n").alias("quotes"))
    shares = words.speaker_share(segments).groupBy("talk").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "spk", "n", "total"))), lambda x: F.format_string("%s: %d%%", x["spk"], F.bround(x["n"] * 100.0 / x["total"]).cast("int"))), " · ").alias("share")
    )
    stats = words.stats(segments).withColumn("minutes", F.col("duration") / 60000.0)
    plain = F.concat(F.lit("## Key terms\n"), F.coalesce("terms", F.lit("")), F.lit("\n\n## Excerpts\n"), F.coalesce("quotes", F.lit("")))
    chunks = segments.join(words.packed(segments, most), ["talk", "sid"])
    line = F.concat(F.when(F.col("spk").isNotNull(), F.concat(F.lit("["), "spk", F.lit("] "))).otherwise(""), F.coalesce("text", F.lit("")))
    texts = chunks.groupBy("talk", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sid", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    rows = titles.select("talk", F.coalesce("title", F.col("talk").cast("string")).alias("title"))
    parts = (stats, listed, quoted, shares, *([condensed(texts, rows, model, most)] if model else []))
    for part in parts:
        rows = rows.join(part, "talk", "left")
    body = F.coalesce("written", plain) if model else plain
    foot = F.concat(F.format_string("%.0f min, %d words, %d segments", "minutes", "words", "segments"), F.coalesce(F.concat(F.lit("\n\n"), "share"), F.lit("")))
    full = F.concat(F.lit("# "), "title", F.lit("\n\n"), body, F.lit("\n\n---\n"), foot, F.lit("\n\nDraft, made by machine from recognised speech; to be checked."))
    return rows.select("talk", F.when(F.col("segments").isNull(), "The transcript is empty.").otherwise(full).alias("summary"))


def evaluate(reference: DataFrame, labels: dict[str, DataFrame], baseline: DataFrame, knobs: Knobs = Knobs()) -> DataFrame:
    """Error rates of each kind of labels (spans in ms) against the baseline."""
    out = None
    for kind, spans in labels.items():
        counted = scoring.grid(reference, spans, 10, int(knobs.collar * 100))
        found = scoring.components(counted, scoring.mapping(scoring.overlaps(counted))).withColumn("kind", F.lit(kind))
        out = found if out is None else out.unionByName(found)
    return scoring.regressions(out, baseline, knobs.tolerance)


def exit_code(compared: DataFrame, known: list[str], asked: str | None = None) -> int:
    """As a command would end: 2 for a scenario nobody knows, 1 if any is worse than its baseline, else 0."""
    if asked is not None and asked not in known:
        return 2
    rows = compared if asked is None else compared.where(F.col("scenario") == asked)
    return int(not rows.where("state = 'worse'").isEmpty())


def new_baseline(scores: DataFrame, tolerance: float) -> dict:
    """The scores as a baseline document; scenarios are few."""
    found: dict = {}
    for r in scores.select("scenario", "kind", "der").collect():
        found.setdefault(str(r["scenario"]), {})[r["kind"]] = round(r["der"], 4)
    return {"scenarios": {k: dict(sorted(v.items())) for k, v in sorted(found.items())}, "tolerance": tolerance}
