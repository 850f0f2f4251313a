"""Line dedup: later copies of repeated line runs are deleted.

The texts are one long sequence of line ids. A run of lines goes if it has
enough words and begins at an earlier place too. Each line of such a run lies in
a least run within it: either one that begins at a place and ends with the line
that brings enough words, or one that ends at a place and begins with the last
line that does. (If the lines from the run's begin to this one have enough
words, then the least run that ends here is within the run; if not, the least
run that begins with it reaches this line.) A least run of the run repeats at an
earlier place as the run does, and is such a run itself, so all lines of the
repeated least runs are what goes.

Prefix doubling names the runs of 1, 2, 4, ... lines at every place by the names
of their halves, as 128-bit hashes, so that no level needs a global order; a run
between two of these lengths is named by the two that cover it. Runs of equal
name are an LCP interval of the suffix array, cut at their length; the earliest
place of an interval stays. Lines that occur once are left out before: no
repeated run reaches across them.

All steps are DataFrame operations on numbers; texts are read twice, to number
the lines and to write the rest. Hot lines and hot runs are aggregated before
they are shuffled and joined by keys that adaptive execution can split.

Defined results: the earliest place is that of the smallest key, null keys
last; rows that agree in key and text are one document and fare alike; a null
text has no lines and stays null; a text all of whose lines go becomes empty;
an empty table gives an empty table; lines are compared as they are, of any
length; other columns stay, whatever their names, but one that is named as the
count of deleted lines is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import WORD, cut, free_name, numbered, rejoin

#: Words that a repeated run has at least.
LEAST_WORDS = 50


def _places(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
    """Documents in order of their keys: (u1, u2, doc, lines), and a stride above the lines of any."""
    line = lambda x: F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2"), F.regexp_count(x, F.lit(WORD)).cast("long").alias("w"))
    rows = docs.where(F.col(text).isNotNull()).select(
        F.col(key).alias("key"), *_identity(key, text), F.transform(F.split(text, "\n", -1), line).alias("lines")
    )
    rows = numbered(cut(rows).dropDuplicates(["u1", "u2"]), F.col("key").asc_nulls_last(), F.col("u1"), F.col("u2"))
    stride = (rows.agg(F.max(F.size("lines"))).first()[0] or 0) + 1
    return rows.select("u1", "u2", F.col("n").alias("doc"), "lines"), stride


def _identity(key: str, text: str):
    """A document's identity: 128 bits of its key and text."""
    own = F.coalesce(F.col(key).cast("string"), F.lit("\x00"))
    return F.xxhash64(own, text).alias("u1"), F.xxhash64(F.lit(1), text, own).alias("u2")


def _chains(lines: DataFrame, stride: int) -> DataFrame:
    """(chain, g, h1, h2, lo, hi): stretches of lines that occur several times, with the words of a chain before and up to each line."""
    keys = ["h1", "h2"]
    several = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    rows = rejoin(lines, several, keys).withColumn("doc", F.expr(f"g div {stride}"))
    chain = F.col("g") - F.row_number().over(Window.partitionBy("doc").orderBy("g"))
    hi = F.sum("w").over(Window.partitionBy("doc", "chain").orderBy("g"))
    return rows.withColumn("chain", chain).withColumn("hi", hi).select("chain", "g", *keys, (F.col("hi") - F.col("w")).alias("lo"), "hi")


def _least_runs(chains: DataFrame, least: int) -> DataFrame:
    """(g, size): from and to each place the shortest run within its chain that has `least` words."""
    row = lambda at, kind: chains.select("chain", "g", at.alias("at"), F.lit(kind).alias("kind"))
    seen = F.last(F.when(F.col("kind") == 1, F.col("g")), ignorenulls=True)

    def met(wanted, there, *order):
        before = Window.partitionBy("chain").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return row(wanted, 0).unionByName(row(there, 1)).withColumn("other", seen.over(before)).where("kind = 0 and other is not null")

    ends = met(F.col("lo") + least, F.col("hi"), F.desc("at"), F.desc("kind"), F.desc("g"))
    begins = met(F.col("hi") - least, F.col("lo"), F.col("at"), F.desc("kind"), F.col("g"))
    size = lambda a, b: F.greatest(b - a + 1, F.lit(1).cast("long")).alias("size")
    g, other = F.col("g"), F.col("other")
    return ends.select("g", size(g, other)).unionByName(begins.select(F.least(g, other).alias("g"), size(other, g))).distinct()


def _names(chains: DataFrame, levels: int) -> DataFrame:
    """(g, names): by k the name of the run of 2^k lines at each place; what reaches beyond the chain has a name that no run uses."""
    order = Window.partitionBy("chain").orderBy("g")
    rows = chains.select("chain", "g", F.col("h1").alias("x0"), F.col("h2").alias("y0"))
    for k in range(1, levels):
        x, y = F.col(f"x{k - 1}"), F.col(f"y{k - 1}")
        x2, y2 = (F.lead(c, 1 << (k - 1)).over(order) for c in (x, y))
        rows = rows.withColumns({f"x{k}": F.xxhash64(x, y, x2, y2), f"y{k}": F.xxhash64(y2, x2, F.lit(k), y, x)})
    return rows.select("g", F.array(*(F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in range(levels))).alias("names"))


def _later(chains: DataFrame, least: int) -> DataFrame | None:
    """(g, size): least runs that begin at an earlier place too; of no rows None."""
    runs = cut(_least_runs(chains, least))
    longest = runs.agg(F.max("size")).first()[0]
    if longest is None:
        return None
    names = _names(chains, longest.bit_length())
    k = (F.length(F.bin("size")) - 1).cast("int")
    own = runs.join(names.hint("merge"), "g").withColumn("k", k).withColumn("a", F.get("names", F.col("k"))).drop("names")
    tail = names.select(F.col("g").alias("end"), F.col("names").alias("tails"))
    both = own.withColumn("end", F.col("g") + F.col("size") - F.expr("shiftleft(1L, k)")).join(tail.hint("merge"), "end")
    b = F.get("tails", F.col("k"))
    whole = both.withColumn("b", b).select(
        "g", "size", F.xxhash64("size", "a.x", "a.y", "b.x", "b.y").alias("n1"), F.xxhash64("b.y", "b.x", "size", "a.y", "a.x").alias("n2")
    )
    keys = ["size", "n1", "n2"]
    whole = cut(whole)
    heads = whole.groupBy(*keys).agg(F.min("g").alias("head"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    return rejoin(whole, heads, keys).where("head < g").select("g", "size")


def repeated_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """(u1, u2, keep): of each document that loses lines, what stays, as (from, lines) from 1."""
    places, stride = _places(docs, key, text)
    lines = places.select("doc", F.posexplode("lines").alias("pos", "line")).select((F.col("doc") * stride + F.col("pos")).alias("g"), "line.*")
    chains = cut(_chains(lines, stride))
    runs = _later(chains, least_words)
    if runs is None:
        return places.where("false").select("u1", "u2", F.array(F.struct(F.lit(1).alias("a"), F.lit(1).alias("n"))).alias("keep"))
    own = runs.select(
        F.expr(f"g div {stride}").alias("doc"), (F.col("g") % stride).alias("a"), (F.col("g") % stride + F.col("size")).alias("b")
    )
    # merge the overlapping runs of a document, then take what lies between them
    order = Window.partitionBy("doc").orderBy("a")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("reach").isNull() | (F.col("a") > F.col("reach")), 1).otherwise(0)).over(order)
    merged = own.withColumn("reach", reach).withColumn("island", island).groupBy("doc", "island").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    gone = merged.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("gone"))
    start = F.concat(F.array(F.lit(0).cast("long")), F.col("gone.b"))
    end = F.concat(F.col("gone.a"), F.array(F.size("lines").cast("long")))
    keep = F.transform(F.arrays_zip(start.alias("a"), end.alias("b")), lambda x: F.struct((x["a"] + 1).cast("int").alias("a"), (x["b"] - x["a"]).cast("int").alias("n")))
    return cut(gone.join(places, "doc").select("u1", "u2", F.filter(keep, lambda x: x["n"] > 0).alias("keep")))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, removed: str | None = None) -> DataFrame:
    """docs without later copies of repeated runs; `removed` names a column for the number of deleted lines."""
    n1, n2, own_keep = (free_name(x, docs.columns) for x in ("__u1", "__u2", "__keep"))
    kept = repeated_runs(docs, key, text, least_words).toDF(n1, n2, own_keep)
    u1, u2 = _identity(key, text)
    rows = docs.withColumn(n1, u1).withColumn(n2, u2).join(kept, [n1, n2], "left")
    lines, keep = F.split(text, "\n", -1), F.col(own_keep)
    rest = F.array_join(F.flatten(F.transform(keep, lambda x: F.slice(lines, x["a"], x["n"]))), "\n")
    out = rows
    if removed:
        left = F.aggregate(keep, F.lit(0), lambda a, x: a + x["n"])
        out = out.withColumn(removed, F.when(keep.isNull(), 0).otherwise(F.size(lines) - left).cast("long"))
    return out.withColumn(text, F.when(keep.isNull(), F.col(text)).otherwise(rest)).select(*(c for c in docs.columns if c != removed), *([removed] if removed else []))
