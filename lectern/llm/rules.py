"""Quality rules whose limits come from the corpus: sketches of each language and source instead of fixed cutoffs.

Each document gets a few whole numbers (measures). Every rule rates them as a
share in ten thousandths. The rates of a language and source are kept in a
quantile sketch: counts of rates, of which only the SKETCH_BITS leading bits
are kept, so a quantile is at most a 64th below the true one. Sketches merge by
adding counts: Spark merges those of its tasks, and a language and source of
few documents uses the merged sketch of its language, a language of few that of
all documents. From the quartiles follow an upper and a lower fence, which are
joined to the documents. A document fails a rule if it lies outside the fences
by more than chance makes a document of its length differ.

All steps are DataFrame expressions on whole texts; only the measures, a few
numbers for each document, are materialised, shuffled and joined.

Defined results: a null text is the empty text; documents without words take no
part in the sketches and fail the base rules; null languages and sources are
values of their own; each repeated row has its row; an empty table gives an
empty table; other columns stay, but those named as results are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import WORD, cut, free_name, rejoin

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
#: Words of a window that counts as repeated.
WINDOW_WORDS = 5
#: Leading bits of a rate that a sketch keeps.
SKETCH_BITS = 7
#: Documents below which a group uses the sketch of its language, and that of all.
LEAST_DOCS = 100
#: Quartile distances between a quartile and its fence.
REACH = 3

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: By rule: what is counted, and by what it is divided.
RATES = {
    "word_length": ("word_chars", "n_words"),
    "symbols": ("n_symbols", "n_words"),
    "repeats": ("n_repeat_words", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
}
#: By rule: what a rate may differ by chance in a document of one word (or line), in ten thousandths; that of n is less by sqrt(n).
NOISE = {"word_length": 100_000, "symbols": 10_000, "repeats": 40_000, "dup_lines": 15_000}
#: Rules with a lower fence as well.
BELOW = ("word_length",)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text and with MEASURES and n_lines (lines that hold a word), all of whole texts."""
    own = free_name("__t", docs.columns)
    words, hashes, windows, lines = (free_name(x, docs.columns) for x in ("__w", "__h", "__g", "__l"))
    t = F.col(own)
    rest = [c for c in docs.columns if c not in (text, *MEASURES, "n_lines")]
    rows = docs.select(*rest, F.coalesce(F.col(text), F.lit("")).alias(own))
    trimmed = F.btrim(t, F.lit(BLANKS))
    rows = rows.select(
        *rest,
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.char_length(t) - F.regexp_count(t, F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD)).alias(lines),
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+", -1)).alias(words),
    )
    rows = rows.select(
        *rest, "n_symbols", "word_chars",
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(words).cast("long").alias("n_words"),
        F.transform(words, lambda x: F.xxhash64(x)).alias(hashes),
    )
    at = lambda i, k: F.get(F.col(hashes), i + k)
    starts = F.sequence(F.lit(0), (F.col("n_words") - WINDOW_WORDS).cast("int"))
    whole = F.transform(starts, lambda i: F.xxhash64(*(at(i, k) for k in range(WINDOW_WORDS))))
    rows = rows.withColumn(windows, F.when(F.col("n_words") >= WINDOW_WORDS, whole).otherwise(F.array().cast("array<bigint>")))
    several = F.size(F.array_distinct(windows)) < F.size(windows)
    # each step is a column of its own, so that it is made once; most documents have no repeated window and skip all of them
    rows = rows.withColumn(windows, F.when(several, F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    rows = rows.withColumn(windows, _repeating(F.col(windows)))
    rows = rows.withColumn("n_repeat_words", F.coalesce(_union(F.col(windows)), F.lit(0)).cast("long"))
    return rows.select(*rest, *MEASURES, "n_lines")


def _repeating(placed: Column) -> Column:
    """Places, in order, of the windows that occur more than once; placed: (h, i) of all windows, in order."""
    own = lambda x, k: F.when((x["h"] == F.get(placed, k - 1)["h"]) | (x["h"] == F.get(placed, k + 1)["h"]), x["i"])
    return F.sort_array(F.array_compact(F.transform(placed, own)))


def _union(places: Column) -> Column:
    """Words in the union of the windows that begin at these places."""
    ahead = F.zip_with(F.slice(places, 2, F.size(places)), places, lambda b, a: F.when(b.isNull(), WINDOW_WORDS).otherwise(F.least(b - a, F.lit(WINDOW_WORDS))))
    return F.aggregate(ahead, F.lit(0), lambda s, x: s + x)


def base_failed() -> Column:
    """The fixed base rules."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _rate(rule: str) -> Column:
    """The rate in ten thousandths, rounded down; null where there is nothing to divide by."""
    top, bottom = RATES[rule]
    return F.when(F.col(bottom) > 0, F.floor(F.lit(10_000) * F.col(top) / F.col(bottom)).cast("long"))


def _bucket(v: Column) -> Column:
    """v with all but its SKETCH_BITS leading bits cleared."""
    drop = F.greatest(F.length(F.bin(v)) - SKETCH_BITS, F.lit(0)).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", v, drop), drop)


def sketches(measured: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, rule, bucket, n): the sketches of each group."""
    rows = measured.select(*keys, F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), _rate(r).alias("v")) for r in RATES))).alias("x"))
    rows = rows.where("x.v is not null").select(*keys, F.col("x.rule").alias("rule"), _bucket(F.col("x.v")).alias("bucket"))
    return rows.groupBy(*keys, "rule", "bucket").agg(F.count(F.lit(1)).alias("n"))


def merged(found: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Sketches of the coarser groups `keys`: counts add up."""
    return found.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))


def quartiles(found: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, rule, docs, low, high): number of documents, lower and upper quartile."""
    group = Window.partitionBy(*keys, "rule")
    rows = found.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("docs", F.sum("n").over(group))
    reached = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("docs"), F.col("bucket")))
    return rows.groupBy(*keys, "rule").agg(F.first("docs").alias("docs"), reached(1).alias("low"), reached(3).alias("high"))


def fences(found: DataFrame, lang: str, source: str) -> DataFrame:
    """(lang, source, {rule}_low, {rule}_high): what lies outside fails the rule; found: sketches by language and source."""
    by_lang = merged(found, (lang,))
    own, coarse, all_ = quartiles(found, (lang, source)), quartiles(by_lang, (lang,)), quartiles(merged(by_lang, ()), ())
    named = lambda df, p: df.select(*(F.col(c).alias(p + c) for c in df.columns))
    rows = own.join(named(coarse, "l_"), (F.col("l_rule") == F.col("rule")) & F.col("l_" + lang).eqNullSafe(F.col(lang))).join(named(all_, "a_"), F.col("a_rule") == F.col("rule"))
    pick = lambda c: F.when(F.col("docs") >= LEAST_DOCS, F.col(c)).when(F.col("l_docs") >= LEAST_DOCS, F.col("l_" + c)).otherwise(F.col("a_" + c))
    rows = rows.select(lang, source, "rule", pick("low").alias("low"), pick("high").alias("high"))
    far = REACH * (F.col("high") - F.col("low"))
    rows = rows.select(lang, source, "rule", (F.col("low") - far).alias("low"), (F.col("high") + far).alias("high"))
    side = lambda r, c: F.max(F.when(F.col("rule") == r, F.col(c))).alias(f"{r}_{c}")
    return rows.groupBy(lang, source).agg(*(side(r, c) for r in RATES for c in ("low", "high")))


def _outside(rule: str, names: dict[str, str]) -> Column:
    """Whether a document's rate lies outside the fences by more than its length explains."""
    rate, size = _rate(rule), F.col(RATES[rule][1])
    beyond = lambda by: (by > 0) & (by * by * size > NOISE[rule] ** 2)
    out = beyond(rate - F.col(names[f"{rule}_high"]))
    if rule in BELOW:
        out = out | beyond(F.col(names[f"{rule}_low"]) - rate)
    return F.coalesce(out, F.lit(False))


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """docs without the text, with MEASURES, base_failed, the failed adaptive rules (failed: array) and kept."""
    key_l, key_s = (free_name(x, [*docs.columns, *MEASURES]) for x in ("__lang", "__source"))
    # null keys meet: each key is a structure, which is not null itself
    keyed = docs.withColumns({key_l: F.struct(F.col(lang).alias("k")), key_s: F.struct(F.col(source).alias("k"))})
    rows = cut(measures(keyed, text))
    limits = fences(sketches(rows, (key_l, key_s)), key_l, key_s)
    names = {c: free_name(f"__{c}", rows.columns) for c in limits.columns if c not in (key_l, key_s)}
    met = rejoin(rows, limits.withColumnsRenamed(names), [key_l, key_s], "left")
    failed = F.array_compact(F.array(*(F.when(_outside(r, names), F.lit(r)) for r in RATES)))
    out = met.withColumn("base_failed", base_failed()).withColumn("failed", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
    keep = [c for c in docs.columns if c not in (text, *MEASURES, "n_lines", "base_failed", "failed", "kept")]
    return out.select(*keep, *MEASURES, "n_lines", "base_failed", "failed", "kept")
