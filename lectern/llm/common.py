"""What the operators of this subpackage share: tables, lineage cuts, word rule."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the reliable checkpoint folder and drop its lineage.

    The folder is the one the session names in spark.checkpoint.dir. Only where
    that is unset and the master is local (tests) a temporary folder is chosen.
    Files of superseded checkpoints go with their data frames if the session
    sets spark.cleaner.referenceTracking.cleanCheckpoints (see tidy).
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="lectern-ckpt-"))
    return df.checkpoint(eager=True)


#: Narrow rows (numbers only) that one task takes where a table is packed.
PACKED_ROWS = 25_000


def packed(df: DataFrame, rows: int) -> DataFrame:
    """df, of so many narrow rows, in no more tasks than they need: small tables of iterations otherwise keep the partitions of a large shuffle."""
    return df.coalesce(max(1, -(-rows // PACKED_ROWS)))


def crc_mod(column: str, modulus: int):
    """crc32 of the value written as text, modulo `modulus`."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner find what a finished round has left.

    Superseded checkpoints and shuffle files go only after the driver has
    collected its garbage, which an idle driver with a fair heap puts off.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def free_name(name: str, taken: list[str]) -> str:
    """name, with underscores before it until no column of `taken` has it, in any case."""
    own = {c.lower() for c in taken}
    while name.lower() in own:
        name = "_" + name
    return name


def rejoin(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys and their hash.

    An aggregate is already dealt by its keys, so a plain join with it leaves
    it where it is, and a frequent key of the left side fills one task. With
    the hash among the join's keys both sides are dealt anew, which lets
    adaptive execution split the frequent key and repeat its one right row. The
    right side has no proven bound, so it isn't broadcast.
    """
    own = F.xxhash64(*keys)
    return left.withColumn("__k", own).join(right.withColumn("__k", own).hint("merge"), ["__k", *keys], how).drop("__k")


def ordered(df: DataFrame, *keys) -> DataFrame:
    """df sorted over all partitions, with `n`, a number that rises in the order of keys (with gaps).

    The result is materialised, since the numbers depend on the partitions.
    """
    return cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("n", F.monotonically_increasing_id()))


def numbered(df: DataFrame, *keys) -> DataFrame:
    """df with `n`, its place in the order of keys: 0, 1, 2 and so on.

    What comes to the driver is a count for each partition.
    """
    rows, shift = ordered(df, *keys), 33  # monotonically_increasing_id: partition, then row in it
    part = F.shiftright("n", shift).cast("int")
    counts = {r["p"]: r["c"] for r in rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("c")).collect()}
    before = [0]
    for p in range(max(counts, default=-1)):
        before.append(before[-1] + counts.get(p, 0))
    start = F.element_at(F.array(*map(F.lit, before)), part + 1)
    return rows.withColumn("n", (start + F.col("n").bitwiseAND(F.lit((1 << shift) - 1))).cast("long"))
