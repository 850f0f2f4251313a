"""Diarization error on a grid of time cells."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Cells of a bin; spans and pieces meet within bins, so no span is compared with a whole talk.
BIN = 3000


def _binned(spans: DataFrame) -> DataFrame:
    """Spans [a, b) of cells, once for each bin they touch."""
    bins = F.sequence(F.floor(F.col("a") / BIN), F.floor((F.col("b") - 1) / BIN))
    return spans.where("b > a").withColumn("bin", F.explode(bins))


def pieces(spans: list[DataFrame]) -> DataFrame:
    """(scenario, cell, end, bin): cells between neighbouring edges of any span; nothing changes within a piece."""
    edges = None
    for part in spans:
        own = part.where("b > a").select("scenario", F.explode(F.array("a", "b")).alias("cell"))
        edges = own if edges is None else edges.union(own)
    ends = edges.groupBy("scenario").agg(F.floor(F.min("cell") / BIN).alias("lo"), F.floor(F.max("cell") / BIN).alias("hi"))
    borders = ends.select("scenario", F.explode(F.transform(F.sequence("lo", "hi"), lambda i: i * BIN)).alias("cell"))
    cuts = edges.union(borders).distinct()
    end = F.lead("cell").over(Window.partitionBy("scenario").orderBy("cell"))
    return cuts.withColumn("end", end).where("end is not null").withColumn("bin", F.floor(F.col("cell") / BIN))


def _covering(parts: DataFrame, spans: DataFrame) -> DataFrame:
    return parts.join(_binned(spans), ["scenario", "bin"]).where("a <= cell and end <= b")


def _label(parts: DataFrame, spans: DataFrame, name: str) -> DataFrame:
    """The label of the last span over a piece."""
    return _covering(parts, spans).groupBy("scenario", "cell").agg(F.max_by("spk", "ord").alias(name))


def grid(reference: DataFrame, hypothesis: DataFrame, step: int, collar: int) -> DataFrame:
    """(scenario, cell, n, ref, hyp): runs of n cells from `cell` on that count and have either label.

    spans: (scenario, ord, spk, t0, t1) in the unit of step; no one's spans
    don't count. Cells within `collar` cells of a boundary of the reference
    aren't scored. Rows grow with the spans, not with the time they take.
    """
    cell = lambda t: F.floor(F.col(t) / step)
    in_cells = lambda spans: spans.where("spk is not null").select("scenario", "ord", "spk", cell("t0").alias("a"), cell("t1").alias("b"))
    ref, hyp = in_cells(reference), in_cells(hypothesis)
    edge = reference.select("scenario", F.explode(F.array(cell("t0"), cell("t1"))).alias("i"))
    unscored = edge.select("scenario", (F.col("i") - collar).alias("a"), (F.col("i") + collar + 1).alias("b"))
    parts = pieces([ref, hyp, unscored])
    out = parts.join(_label(parts, ref, "ref"), ["scenario", "cell"], "left").join(_label(parts, hyp, "hyp"), ["scenario", "cell"], "left")
    out = out.join(_covering(parts, unscored).select("scenario", "cell").distinct(), ["scenario", "cell"], "left_anti")
    return out.where("ref is not null or hyp is not null").select("scenario", "cell", (F.col("end") - F.col("cell")).alias("n"), "ref", "hyp")


def overlaps(counted: DataFrame) -> DataFrame:
    return counted.where("ref is not null and hyp is not null").groupBy("scenario", "hyp", "ref").agg(F.sum("n").alias("n"))


def best_mapping(overlap: dict[tuple[str, str], int]) -> dict[str, str]:
    """The one-to-one mapping of hypothesis to reference labels of the largest overlap; nothing maps without overlap.

    Potentials and shortest augmenting paths: cubic in the labels. Of equal
    mappings the one that a fixed order of labels leads to.
    """
    hyps, refs = sorted({h for h, _ in overlap}), sorted({r for _, r in overlap})
    n, m = len(hyps), max(len(hyps), len(refs))
    cost = [[-overlap.get((h, refs[j]), 0) if j < len(refs) else 0 for j in range(m)] for h in hyps]
    u, v, match = [0] * (n + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    cur = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if cur < least[j]:
                        least[j], way[j] = cur, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if not match[j0]:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    return {hyps[match[j] - 1]: refs[j - 1] for j in range(1, len(refs) + 1) if match[j] and overlap.get((hyps[match[j] - 1], refs[j - 1]), 0)}


def mapping(overlap: DataFrame) -> DataFrame:
    """(scenario, hyp, mapped) by the best mapping of each scenario; a scenario's labels are few."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = best_mapping({(h, r): int(n) for h, r, n in zip(rows["hyp"], rows["ref"], rows["n"], strict=True)})
        return pd.DataFrame([(*key, h, r) for h, r in found.items()], columns=["scenario", "hyp", "mapped"])

    kind = overlap.schema["scenario"].dataType.simpleString()
    return overlap.groupBy("scenario").applyInPandas(one, f"scenario {kind}, hyp string, mapped string")


def components(counted: DataFrame, mapped: DataFrame, confident: list[str] | None = None) -> DataFrame:
    """Cells of each kind of error and their rate; a scenario without reference speech has zeros throughout."""
    rows = counted.join(mapped, ["scenario", "hyp"], "left")
    ref, hyp = F.col("ref").isNotNull(), F.col("hyp").isNotNull()
    wrong = ref & hyp & ~F.col("mapped").eqNullSafe(F.col("ref"))
    named = F.lit(True) if confident is None else F.col("hyp").isin(*confident)
    kinds = {"total": ref, "miss": ref & ~hyp, "false_alarm": ~ref & hyp, "confusion": wrong, "wrong_name": wrong & named}
    counts = rows.groupBy("scenario").agg(*(F.sum(F.when(is_kind, F.col("n")).otherwise(0)).alias(kind) for kind, is_kind in kinds.items()))
    heard = F.col("total") > 0
    kept = [F.when(heard, F.col(c)).otherwise(0).alias(c) for c in ("miss", "false_alarm", "confusion", "wrong_name")]
    rate = F.when(heard, (F.col("miss") + F.col("false_alarm") + F.col("confusion")) / F.col("total")).otherwise(0.0)
    return counts.select("scenario", "total", *kept, rate.alias("der"))


def report_line(scores: DataFrame) -> DataFrame:
    part = lambda c: F.col(c) * 100.0 / F.greatest(F.col("total"), F.lit(1))
    return scores.select("scenario", F.format_string("DER %.1f%% (miss %.1f%%, FA %.1f%%, conf %.1f%%)", F.col("der") * 100, part("miss"), part("false_alarm"), part("confusion")).alias("line"))


def regressions(current: DataFrame, baseline: DataFrame, tolerance: float) -> DataFrame:
    """(scenario, kind, der, base, state): 'worse' beyond the tolerance, 'new' without a baseline, else 'ok'."""
    rows = current.join(baseline.select("scenario", "kind", F.col("der").alias("base")), ["scenario", "kind"], "left")
    state = F.when(F.col("base").isNull(), "new").when(F.col("der") > F.col("base") + tolerance, "worse").otherwise("ok")
    return rows.withColumn("state", state)


def label_counts(counted: DataFrame) -> DataFrame:
    return counted.groupBy("scenario").agg(F.count_distinct("ref").alias("ref_speakers"), F.count_distinct("hyp").alias("hyp_speakers"))


