"""Connected components of an edge list, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import cut, packed, rejoin, tidy

#: Edges from which joins are dealt anew, so that Spark may split a hub; fewer fit a task whatever their keys.
SPLIT_EDGES = 1_000_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node that node is connected to; only nodes with an edge come.

    edges: (a, b) of one type. Large-star and small-star steps alternate until
    nothing changes; each hooks nodes to the least neighbour, so the number of
    rounds grows with the logarithm of a component's length. Up to SPLIT_EDGES
    a round is two shuffles, and what it reads and leaves is packed by its rows;
    beyond it a hub's edges are aggregated before they are shuffled and meet the
    result in a join that deals them anew (rejoin), so that Spark splits a hub.
    """
    now = cut(edges.where("a != b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    last = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if state == last or not state[0]:
            break
        last = state
        now = cut(_round_split(now) if state[0] > SPLIT_EDGES else packed(_round(packed(now, state[0])), state[0]))
        tidy(now.sparkSession)
    roots = now.select(F.col("u").alias("node")).distinct().join(now.select(F.col("v").alias("node")), "node", "left_anti")
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).union(roots.select("node", F.col("node").alias("root")))


def _both(now: DataFrame) -> DataFrame:
    """(x, y): each edge from either end, of one scan."""
    ends = F.array(F.struct(F.col("v").alias("x"), F.col("u").alias("y")), F.struct(F.col("u").alias("x"), F.col("v").alias("y")))
    return now.select(F.inline(ends))


def _round(now: DataFrame) -> DataFrame:
    """A large-star and a small-star step in two shuffles, one by each end; no more rows come out than go in.

    What is dealt by v is distinct by (v, u) without being dealt anew. A hub's
    edges are in one task, so this is for no more than SPLIT_EDGES. Rows may
    repeat until the last round, in which each v has one u.
    """
    x, v = Window.partitionBy("x"), Window.partitionBy("v")
    large = _both(now).withColumn("m", F.least("x", F.min("y").over(x))).where("y > x")
    large = large.select(F.col("y").alias("v"), F.col("m").alias("u")).repartition("v").distinct()
    place = F.row_number().over(v.orderBy("u"))
    small = large.withColumns({"m": F.min("u").over(v.orderBy("u")), "place": place})
    hooked = F.when(F.col("place") == 1, F.col("v")).otherwise(F.col("u"))
    return small.select(hooked.alias("v"), F.col("m").alias("u"))


def _round_split(now: DataFrame) -> DataFrame:
    """The same steps by aggregates that are joined back, so that a hub can be split."""
    both = _both(now)
    least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
    large = rejoin(both, least, ["x"]).where("y > x").select(F.col("y").alias("v"), F.col("m").alias("u")).distinct()
    small_least = large.groupBy("v").agg(F.min("u").alias("m"))
    hooked = rejoin(large, small_least, ["v"]).where("u != m").select(F.col("u").alias("v"), F.col("m").alias("u"))
    return hooked.union(small_least.select("v", F.col("m").alias("u"))).distinct()
