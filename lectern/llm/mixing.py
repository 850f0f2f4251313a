"""Mixing sources to target weights by entropy balancing.

Every document d of n words has a rate x, the copies wanted of it. Of all rates
between 0 and MOST that give each source its target of words, those closest to
1 in relative entropy are wanted: least sum of x * log(x) - x + 1, under sum of
n * x = target for each source. The dual of that problem is convex and has a
multiplier m for each source; a document's rate is its exponential tilt
exp(m * n), at most MOST. So a source gains or loses words by its longer
documents first, which leaves the rates of most documents near 1.

The dual is solved by Newton steps for all sources together. Each step sums
gradient and Hessian in Spark over the documents, by the numbers of documents
of each size, which are all the dual depends on. A step that leaves the bracket
known so far is replaced by halving the bracket, so that every source converges;
the steps end when all gradients are below a tolerance.

Rates become whole copies so that errors do not add up: a source's documents
fall into classes of like size and rate, and from the largest class to the
smallest each takes as many copies as its rates ask for and the error so far;
within a class the documents with another copy are those first by a hash. Hot
sources are split by class and by hash, and counted before they are shuffled.

Defined results: a null text has size 0, and documents of size 0 take 0 and
aren't repeated; texts are counted whole, however long; a null source is a
source, the last in order; repeated rows count and are taken row by row; rows
with null keys are told apart by their texts; without any words all targets are
0; an empty table gives an empty table; other columns stay, whatever their
names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import WORD, cut, numbered, packed, rejoin

#: Weights by place of the source, repeating.
WEIGHTS = (1, 2, 3)
#: Times a source's size that its target, and a document's size that its taken words, may be at most.
MOST = 3
#: Size classes to a doubling, and documents (of all) to a hash bucket.
CLASSES, BUCKET_DOCS = 4, 4000
#: Gradient of a source, relative to its target, at which the Newton steps end; and steps, at most (the bracket halves).
TOLERANCE, STEPS = 1e-12, 200
#: Sources up to which their multipliers are broadcast: 20,000 x 200 B, 4 MB.
BROADCAST_SOURCES = 20_000

_EXACT = "decimal(38,10)"  # sums in any order agree


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _name(source: str) -> Column:
    """A key for the source that is not null: 's' and its name, or 'n'."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))


def targets(sizes: DataFrame) -> DataFrame:
    """(name, source_size, target) of (name, source, source_size), one row a source.

    The level at which all weights fill up is found by a sum over the sources
    for each round in which some of them reach their bound.
    """
    at = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("n") % len(WEIGHTS)).cast("int") + 1)
    rows = numbered(sizes, F.col("source").asc_nulls_last()).select("name", "source_size", at.cast("double").alias("weight"))
    bound = MOST * F.col("source_size")
    level = -1.0
    while True:
        full = bound <= level * F.col("weight")
        total, held, free = rows.select(
            F.sum("source_size"), F.sum(F.when(full, bound).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))
        ).first()
        if not free:
            break
        reached = (total - held) / free
        if reached <= level:
            break
        level = reached
    return rows.select("name", "source_size", F.least(bound.cast("double"), F.lit(max(level, 0.0)) * F.col("weight")).alias("target"))


def rate(multiplier: Column, size: Column) -> Column:
    """The tilted rate of a document; rounded, so that a rate of a whole number is one."""
    tilt = multiplier * size
    return F.when(tilt >= math.log(MOST), float(MOST)).otherwise(F.round(F.exp(tilt), 9))


def balance(sizes: DataFrame, goals: DataFrame) -> tuple[DataFrame, int]:
    """(name, multiplier) of each source by Newton's method on the dual, and the steps it took.

    A step reads a row for each size of a source and leaves a row for each source, packed by their numbers.

    sizes: (name, size, n), the numbers of documents of each size above 0;
    goals: (name, source_size, target), targets above 0 and at most MOST times
    the size. Where the target is that bound all rates are MOST.
    """
    top = F.lit(math.log(MOST))  # of one word: there all rates are MOST
    low = F.least(F.lit(0.0), F.log(F.col("target") / F.col("source_size")))
    full = F.col("target") >= MOST * F.col("source_size") * (1 - 1e-15)
    start = F.when(full, top).otherwise(F.lit(0.0))
    state = cut(goals.select("name", F.col("target").cast("double").alias("target"), start.alias("m"), low.alias("lo"), top.alias("hi"), full.alias("done")))
    sources = state.count()
    few = sources <= BROADCAST_SOURCES
    state, sizes = packed(state, sources), packed(sizes, sizes.count())
    for step in range(1, STEPS + 1):
        active = state.where("not done").select("name", "m")
        tilt = F.col("m") * F.col("size")
        inner = tilt < top
        taken = F.col("n") * F.col("size") * F.when(inner, F.exp(tilt)).otherwise(float(MOST))
        slope = F.when(inner, F.col("n") * F.col("size") * F.col("size") * F.exp(tilt)).otherwise(0.0)
        sums = (
            sizes.join(F.broadcast(active) if few else active, "name")
            .groupBy("name")
            .agg(F.sum(taken.cast(_EXACT)).cast("double").alias("taken"), F.sum(slope.cast(_EXACT)).cast("double").alias("slope"))
        )
        gradient = F.col("taken") - F.col("target")
        lo = F.when(gradient < 0, F.col("m")).otherwise(F.col("lo"))
        hi = F.when(gradient > 0, F.col("m")).otherwise(F.col("hi"))
        newton = F.when(F.col("slope") > 0, F.col("m") - gradient / F.col("slope"))
        # sources that are done have no sums, and stay as they are
        done = F.coalesce((F.abs(gradient) <= TOLERANCE * F.col("target")) | (F.col("hi") - F.col("lo") <= 1e-17), F.lit(True))
        moved = F.when((newton > F.col("lo")) & (newton < F.col("hi")), newton).otherwise((F.col("lo") + F.col("hi")) / 2)
        stepped = state.join(F.broadcast(sums) if few else sums, "name", "left").withColumn("lo", lo).withColumn("hi", hi).withColumn("done", done)
        stepped = stepped.withColumn("m", F.when(F.col("done"), F.col("m")).otherwise(moved))
        state = packed(cut(stepped.select(*state.columns)), sources)
        if state.where("not done").isEmpty():
            break
    return state.select("name", F.col("m").alias("multiplier")), step


def _shared(cells: DataFrame, group: list[str], part: str, n: str, extra: str, out: str) -> DataFrame:
    """cells with `out`, their parts of the group's `extra`, dealt in order of `part` by their numbers `n`."""
    upto = F.sum(n).over(Window.partitionBy(*group).orderBy(part))
    every = F.sum(n).over(Window.partitionBy(*group))
    rows = cells.withColumn("__upto", upto).withColumn("__every", every)
    return rows.withColumn(out, F.expr(f"{extra} * __upto div __every - {extra} * (__upto - {n}) div __every")).drop("__upto", "__every")


def assign(rows: DataFrame, narrow: DataFrame, key: str, source: str, size: str, mark: str) -> DataFrame:
    """rows with source_size, target and copies (of each document, whole); `mark` tells texts apart.

    narrow has the named columns of the same rows, materialised.
    """
    buckets = max(1, math.ceil(narrow.count() / BUCKET_DOCS))
    wide = math.isqrt(buckets - 1) + 1  # buckets to a block of buckets
    counted = cut(narrow.withColumn("__name", _name(source)).groupBy("__name", size).agg(F.count(F.lit(1)).alias("n"), F.first(source, ignorenulls=True).alias("source")))
    sizes = counted.groupBy(F.col("__name").alias("name")).agg(F.first("source", ignorenulls=True).alias("source"), F.sum(F.col("n") * F.col(size)).alias("source_size"))
    goal = cut(targets(sizes))
    multipliers, _ = balance(counted.where(F.col(size) > 0).select(F.col("__name").alias("name"), F.col(size).cast("double").alias("size"), "n"), goal.where("source_size > 0"))
    goal = cut(goal.join(multipliers, "name", "left").select(F.col("name").alias("__name"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), "multiplier"))

    hashed = F.md5(F.concat_ws("|", F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(size).cast("string"), F.col(mark)))
    own_rate = F.when(F.col(size) > 0, rate(F.col("multiplier"), F.col(size).cast("double"))).otherwise(0.0)
    few = goal.count() <= BROADCAST_SOURCES

    def dealt(part):
        named = part.withColumn("__name", _name(source))
        return (
            (named.join(F.broadcast(goal), "__name") if few else rejoin(named, goal, ["__name"]))
            .withColumn("__rate", own_rate)
            .withColumn("__whole", F.floor("__rate").cast("int"))
            .withColumn("__part", (F.col("__rate") - F.col("__whole")).cast(_EXACT))
            .withColumn("__class", F.when(F.col("__part") > 0, F.floor(F.log2(F.col(size).cast("double")) * CLASSES).cast("int")).otherwise(-1))
            .withColumn("__hash", hashed)
            .withColumn("__bucket", (F.conv(F.substring("__hash", 1, 8), 16, 10).cast("long") % buckets).cast("int"))
            .drop("multiplier", "__rate")
        )

    group = ["__name", "__class", "__whole"]
    want = F.sum((F.col("__part") * F.col(size).cast("decimal(20,0)")).cast(_EXACT))
    cells = cut(dealt(narrow).where("__class >= 0").groupBy(*group, "__bucket").agg(F.count(F.lit(1)).alias("__n"), F.sum(size).alias("__w"), want.alias("__want")))

    classes = cells.groupBy(*group).agg(*(F.sum(x).cast("double").alias(x[2:]) for x in ("__n", "__w", "__want")))
    each = F.struct(F.col("__class").alias("c"), F.col("__whole").alias("k"), "n", "w", "want")
    folded = classes.groupBy("__name").agg(F.sort_array(F.collect_list(each), asc=False).alias("all"))  # a row for each class of a source
    none = F.struct(F.lit(0.0).alias("carry"), F.lit([]).cast("array<struct<c:int,k:int,extra:bigint>>").alias("out"))

    def take(state, x):
        due = x["want"] + state["carry"]
        extra = F.least(F.greatest(F.round(due * x["n"] / x["w"]), F.lit(0.0)), x["n"])
        return F.struct(
            (due - extra * x["w"] / x["n"]).alias("carry"),
            F.concat(state["out"], F.array(F.struct(x["c"].alias("c"), x["k"].alias("k"), extra.cast("long").alias("extra")))).alias("out"),
        )

    extras = folded.select("__name", F.explode(F.aggregate("all", none, take)["out"]).alias("x"))
    extras = extras.select("__name", F.col("x.c").alias("__class"), F.col("x.k").alias("__whole"), F.col("x.extra").alias("__due"))
    # a class's further copies are shared out to blocks of its buckets by their numbers of documents, then to buckets
    blocked = cells.withColumn("__block", F.expr(f"__bucket div {wide}"))
    blocks = blocked.groupBy(*group, "__block").agg(F.sum("__n").alias("__n")).join(extras, group)
    blocks = _shared(blocks, group, "__block", "__n", "__due", "__own").select(*group, "__block", "__own")
    shared = _shared(blocked.join(blocks, [*group, "__block"]), [*group, "__block"], "__bucket", "__n", "__own", "__extra")
    cell = [*group, "__bucket"]
    place = F.row_number().over(Window.partitionBy(*cell).orderBy("__hash", F.col(key), F.col(size)))
    keep = [*rows.columns, F.col("__source_size").alias("source_size"), F.col("__target").alias("target")]
    placed = dealt(rows).join(shared.select(*cell, "__extra"), cell, "left").withColumn("__place", place)
    further = (F.col("__place") <= F.coalesce("__extra", F.lit(0))).cast("int")
    return placed.select(*keep, (F.col("__whole") + further).cast("long").alias("copies"))


def _described(key: str, source: str, text: str) -> list[Column]:
    """What the mix looks at: key, source, size and a mark of the text."""
    return [F.col(key).alias("__key"), F.col(source).alias("__source"), words(text).alias("__size"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("__mark")]


def plan(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Per document: key, size, source_size, target, taken (words, repeats counted)."""
    sized = cut(docs.select(*_described(key, source, text)))
    found = assign(sized, sized, "__key", "__source", "__size", "__mark").withColumnsRenamed({"__key": "key", "__size": "size"})
    return found.select(F.col("key").alias(key), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def repeat(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """docs as the mix takes them: a row for each copy."""
    described = _described(key, source, text)
    rows = docs.select(*described, F.struct(*docs.columns).alias("__row"))
    found = assign(rows, cut(docs.select(*described)), "__key", "__source", "__size", "__mark").select("__row", "copies")
    return found.where("copies > 0").select("__row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("__row.*")
