"""Speaker attribution: windows, centroids, online and retrospective clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from lectern.config import Knobs
from lectern.functions.vectors import dot, mean_vector, unit
from lectern.operators.folds import fold


def windows(chunks: DataFrame, size: int, hop: int) -> DataFrame:
    """(…, start, end) of the windows of chunks (…, n): no partial one, but one short one if the chunk is shorter."""
    starts = F.when(F.col("n") >= size, F.sequence(F.lit(0).cast("long"), (F.col("n") - size).cast("long"), F.lit(hop).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    rows = chunks.withColumn("start", F.explode(starts))
    return rows.withColumn("end", F.least(F.col("start") + size, F.col("n")).cast("long"))


def voiced(frames: DataFrame, keys: list[str], range_db: float, floor_db: float) -> DataFrame:
    """Frames within range_db of the loudest of their chunk and not below floor_db."""
    loudest = F.max("level_db").over(Window.partitionBy(*keys))
    return frames.withColumn("__max", loudest).where((F.col("level_db") >= F.col("__max") - range_db) & (F.col("level_db") >= floor_db)).drop("__max")


def enough_voiced(frames: DataFrame, keys: list[str], need: int) -> DataFrame:
    """Chunks with `need` voiced frames at least."""
    return frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= need)


#: Vectors in a shard; two shards meet in one task.
SHARD_ROWS = 4096
#: Cosines nearer than this to a threshold are summed again in the order of the entries.
CLOSE = 1e-9


def _met_shards(vectors: DataFrame, keys: list[str], extra: list[str], f, schema: str, shard_rows: int) -> DataFrame:
    """f of each two shards of a group: f(key, left, right, cos) over blocks of rows, with the products of their vectors.

    Vectors that are null or hold a null have none (nan and `bare`). A pair of rows meets once, in either order.
    """
    rows = vectors.where(" and ".join(f"`{k}` is not null" for k in [*keys, "id"]))
    bare = F.coalesce(F.col("v").isNull() | F.exists("v", lambda x: x.isNull()), F.lit(True))
    counts = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("__n"))
    dealt = rows.join(counts, keys).select(*keys, "id", *extra, "v", bare.alias("bare"), F.pmod(F.xxhash64("id"), F.col("__n")).alias("p"), "__n")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)).alias("o")
    met = dealt.select(*keys, "id", *extra, "v", "bare", "p", other).select(*keys, "id", *extra, "v", "bare", "p", F.least("p", "o").alias("__x"), F.greatest("p", "o").alias("__y"))

    def one(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        dim = max((len(x) for x in table["v"] if x.is_valid), default=0)
        own = table.drop_columns(["v"]).to_pandas()
        flat = np.full((len(own), dim), np.nan)
        good = np.flatnonzero(~own["bare"].to_numpy())
        if len(good):
            flat[good] = table["v"].combine_chunks().take(pa.array(good)).flatten().to_numpy(zero_copy_only=False).reshape(len(good), dim)
        x, y = (np.flatnonzero(own["p"].to_numpy() == p.as_py()) for p in key[-2:])
        out = []
        for at in range(0, len(x), 256):
            left = x[at : at + 256]
            right = x[at:] if key[-1] == key[-2] else y
            cos = flat[left] @ flat[right].T
            fresh = np.arange(len(right)) > np.arange(len(left))[:, None] if key[-1] == key[-2] else np.ones(cos.shape, bool)
            out.append(f(key[:-2], own, flat, left, right, cos, fresh))
        return pa.Table.from_pandas(pd.concat(out), schema=arrow, preserve_index=False) if out else arrow.empty_table()

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return met.groupBy(*keys, "__x", "__y").applyInArrow(one, schema)


def _kind(df: DataFrame, name: str) -> str:
    return f"`{name}` {df.schema[name].dataType.simpleString()}"


def pair_cosines(vectors: DataFrame, keys: list[str], at_least: float | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(keys, a, b, cos) of each pair a < b of unit vectors (keys, id, v) within their group."""
    kind = vectors.schema["id"].dataType.simpleString()
    schema = ", ".join([*(_kind(vectors, k) for k in keys), f"a {kind}", f"b {kind}", "cos double"])

    def pairs(key, own, flat, left, right, cos, fresh):
        bare = own["bare"].to_numpy()
        if at_least is not None:
            i, j = np.nonzero(fresh & (np.abs(cos - at_least) <= CLOSE))
            if len(i):
                cos[i, j] = np.cumsum(flat[left[i]] * flat[right[j]], axis=1)[:, -1]
            fresh = fresh & ~(cos < at_least) & ~(bare[left][:, None] | bare[right])
        i, j = np.nonzero(fresh)
        ids = own["id"].to_numpy()
        a, b = ids[left[i]], ids[right[j]]
        turned = a > b
        found = pd.DataFrame({"a": np.where(turned, b, a), "b": np.where(turned, a, b), "cos": cos[i, j]})
        none = bare[left[i]] | bare[right[j]]
        if none.any():
            found["cos"] = found["cos"].astype(object).where(~none, None)
        for at, (k, value) in enumerate(zip(keys, key, strict=True)):
            found.insert(at, k, value.as_py() if hasattr(value, "as_py") else value)
        return found[(a != b)]

    return _met_shards(vectors.select(*keys, "id", "v"), keys, [], pairs, schema, shard_rows)


def cosine_range(vectors: DataFrame, keys: list[str], shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(same, least, most, pairs): least and most similar pair of unit vectors (keys, id, label, v) of a group, by whether their labels agree; no pair is written out."""

    def ends(_, own, flat, left, right, cos, fresh):
        label, ids, bare = own["label"].to_numpy(dtype=float, na_value=np.nan), own["id"].to_numpy(), own["bare"].to_numpy()
        la, lb = label[left][:, None], label[right]
        fresh = fresh & (ids[left][:, None] != ids[right])
        unknown, ok, out = np.isnan(la) | np.isnan(lb), ~(bare[left][:, None] | bare[right]), []
        for same, of in ((True, (la == lb) & ~unknown), (False, (la != lb) & ~unknown), (None, unknown)):
            n, some = int((fresh & of).sum()), cos[fresh & of & ok]
            if n:
                out.append((same, float(np.fmin.reduce(some)) if len(some) else None, float(np.max(some)) if len(some) else None, n))
        return pd.DataFrame(out, columns=["same", "least", "most", "pairs"])

    schema = "same boolean, least double, most double, pairs long"
    parts = _met_shards(vectors.select(*keys, "id", F.col("label").cast("long").alias("label"), "v"), keys, ["label"], ends, schema, shard_rows)
    return parts.groupBy("same").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("pairs").alias("pairs"))


def two_best(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """(id, best, best_sim, second_sim) against the centroids (spk, place, c) of the same talk; ties go to the earlier place."""
    rows = vectors.select("talk", "id", "v").join(centroids.select("talk", "spk", "place", "c"), "talk").select("talk", "id", "spk", "place", dot(F.col("v"), F.col("c")).alias("sim"))
    rank = F.row_number().over(Window.partitionBy("talk", "id").orderBy(F.desc("sim"), "place"))
    top = rows.withColumn("__r", rank).where(F.col("__r") <= 2)
    first, second = F.when(F.col("__r") == 1, F.col("spk")), F.when(F.col("__r") == 2, F.col("sim"))
    return top.groupBy("talk", "id").agg(F.max(first).alias("best"), F.max("sim").alias("best_sim"), F.coalesce(F.max(second), F.lit(-1.0)).alias("second_sim"))


def centroids(vectors: DataFrame, keys: list[str], dim: int, weight: Column | None = None) -> DataFrame:
    return vectors.groupBy(*keys).agg(mean_vector(dim, "v", weight).alias("c"))


def change_points(labelled: DataFrame, dim: int, knobs: Knobs = Knobs()) -> DataFrame:
    """(talk, sid, at) of segments whose windows (pos, label, t1, v) change their label once, to a different voice.

    The change lies between the ends of the last window before and the first after.
    """
    by = Window.partitionBy("talk", "sid").orderBy("pos")
    changed = F.coalesce((F.col("label") != F.lag("label").over(by)).cast("int"), F.lit(0))
    rows = labelled.withColumn("__c", changed).withColumn("side", F.sum("__c").over(by))
    side = lambda k, x: F.when(F.col("side") == k, x)
    mean = lambda k: unit(F.array(*(F.sum(side(k, F.col("v")[i])) / F.count(side(k, F.lit(1))) for i in range(dim))))
    both = rows.groupBy("talk", "sid").agg(
        F.max("side").alias("changes"), mean(0).alias("a"), mean(1).alias("b"), F.max(side(0, F.col("t1"))).alias("x"), F.min(side(1, F.col("t1"))).alias("y")
    )
    return both.where((F.col("changes") == 1) & (dot(F.col("a"), F.col("b")) < knobs.assign)).select("talk", "sid", ((F.col("x") + F.col("y")) / 2).alias("at"))


# -- online ---------------------------------------------------------------------------------------


def _unit(v: np.ndarray) -> np.ndarray | None:
    norm = float(np.linalg.norm(v))
    return v / norm if norm > 1e-9 else None


class Registry:
    """Known voices in the order they came; plain data in `state`: [name, vector, count, enrolled] rows, aliases, numbers."""

    def __init__(self, state: dict, knobs: Knobs):
        self.knobs, self.state = knobs, state
        self.rows = [[name, np.asarray(v, float), n, fixed] for name, v, n, fixed in state["rows"]]

    @staticmethod
    def empty(enrolled: dict | None = None) -> dict:
        return {"rows": [[name, [*map(float, v)], 1, True] for name, v in (enrolled or {}).items()], "alias": {}, "named": 0, "since": 0}

    def saved(self) -> dict:
        return {**self.state, "rows": [[name, v.tolist(), n, fixed] for name, v, n, fixed in self.rows]}

    def _sure(self, best: float, second: float) -> float:
        k = self.knobs
        return self._squash((best - k.assign) + (best - second - k.margin_ref))

    def _squash(self, x: float) -> float:
        return float(1 / (1 + np.exp(-x / max(self.knobs.conf_temp, 1e-6))))

    def observe(self, v: np.ndarray, learn: bool = True) -> tuple[str | None, float]:
        """The voice and the confidence; an unknown voice is added while there is room and learning is on."""
        sims = [float(r[1] @ v) for r in self.rows]
        order = sorted(range(len(sims)), key=lambda i: (-sims[i], i))
        best = sims[order[0]] if order else -1.0
        second = sims[order[1]] if len(order) > 1 else -1.0
        known = bool(order) and best >= self.knobs.assign
        if known and learn:
            self._learn(self.rows[order[0]], v)
        if known or not learn or len(self.rows) >= self.knobs.max_speakers:
            return (self.rows[order[0]][0] if order else None), self._sure(best, second)
        self.state = {**self.state, "named": self.state["named"] + 1}
        name = f"S{self.state['named']}"
        self.rows.append([name, v.copy(), 1, False])
        return name, min(self.knobs.new_conf_cap, self._squash(self.knobs.assign - best - self.knobs.margin_ref))

    def _learn(self, row: list, v: np.ndarray) -> None:
        """A moving mean whose newest share never falls below that of the window; enrolled voices stay."""
        if row[3]:
            return
        share = 1 / min(row[2] + 1, max(2, self.knobs.adapt_window))
        row[1] = next((u for u in [_unit((1 - share) * row[1] + share * v)] if u is not None), row[1])
        row[2] += 1

    def merge(self) -> None:
        """One pass over the unnamed voices: each joins the first voice that is close enough, the larger one stays."""
        for name in [r[0] for r in self.rows if not r[3]]:
            own = next((r for r in self.rows if r[0] == name), None)
            if own is None:
                continue
            other = next((r for r in self.rows if r[0] != name and float(own[1] @ r[1]) >= self.knobs.merge), None)
            if other is None:
                continue
            gone, stays = (own, other) if other[3] or other[2] >= own[2] else (other, own)
            if not stays[3]:
                joint = _unit(stays[1] * stays[2] + gone[1] * gone[2])
                stays[1] = stays[1] if joint is None else joint
            stays[2] += gone[2]
            self.rows = [r for r in self.rows if r is not gone]
            alias = {k: (stays[0] if to == gone[0] else to) for k, to in self.state["alias"].items()}
            self.state = {**self.state, "alias": {**alias, gone[0]: stays[0]}}


def assign_step(knobs: Knobs):
    """A segment's label. Row: sid, v (unit mean of its windows). Output: sid, raw label, label or null, confidence."""

    def step(state, row):
        voices = Registry(state, knobs)
        spk, conf = voices.observe(np.asarray(row.v, float))
        voices.state = {**voices.state, "since": voices.state["since"] + 1}
        if voices.state["since"] >= knobs.merge_every:
            voices.state = {**voices.state, "since": 0}
            voices.merge()
            spk = voices.state["alias"].get(spk, spk)
        shown = spk if conf >= knobs.min_conf else None
        return voices.saved(), [(int(row.sid), spk, shown, round(conf, 3))]

    return step


def online_labels(vectors: DataFrame, knobs: Knobs = Knobs(), enrolled: dict | None = None) -> DataFrame:
    """(talk, sid, raw, spk, conf) of unit vectors (talk, sid, v) in the order of sid."""
    kind = vectors.schema["talk"].dataType.simpleString()
    schema = f"talk {kind}, sid long, raw string, spk string, conf double"
    return fold(vectors.select("talk", "sid", "v"), ["talk"], ["sid"], schema, lambda: Registry.empty(enrolled), assign_step(knobs))


def merges(vectors: DataFrame, knobs: Knobs = Knobs(), enrolled: dict | None = None) -> DataFrame:
    """(talk, sid, old, new): after segment `sid` the voice `old` turned out to be `new`; a chain comes as its last link."""
    inner = assign_step(knobs)

    def step(state, row):
        before = state["alias"]
        state, _ = inner(state, row)
        return state, [(int(row.sid), old, new) for old, new in state["alias"].items() if before.get(old) != new]

    kind = vectors.schema["talk"].dataType.simpleString()
    return fold(vectors.select("talk", "sid", "v"), ["talk"], ["sid"], f"talk {kind}, sid long, old string, new string", lambda: Registry.empty(enrolled), step)


def late_labels(online: DataFrame, merged: DataFrame, refined: DataFrame) -> DataFrame:
    """Labels in the order they become known: (talk, sid, seq, spk, spk_conf, src), src being online, merge or refine.

    A merge relabels every earlier segment of the old voice and keeps its
    confidence; what the look back says comes last, in order of the segments.
    """
    kept = online.where("spk is not null")
    first = kept.select("talk", "sid", (F.col("sid") * 2).alias("seq"), "spk", F.col("conf").alias("spk_conf"), F.lit("online").alias("src"))
    own = merged.select("talk", F.col("sid").alias("__at"), F.col("old").alias("raw"), "new")
    joined = kept.select("talk", "sid", "raw", "conf").join(own, ["talk", "raw"]).where("sid <= __at")
    again = joined.select("talk", "sid", (F.col("__at") * 2 + 1).alias("seq"), F.col("new").alias("spk"), F.col("conf").alias("spk_conf"), F.lit("merge").alias("src"))
    end = F.max("sid").over(Window.partitionBy("talk"))
    last = refined.select("talk", "sid", ((end + 1) * 2 + F.col("sid")).alias("seq"), "spk", F.col("conf").alias("spk_conf"), F.lit("refine").alias("src"))
    return first.unionByName(again).unionByName(last)


def realias(labels: DataFrame, aliases: DataFrame) -> DataFrame:
    """Labels with merged voices (talk, old, new) under the name that stayed."""
    own = aliases.select("talk", F.col("old").alias("spk"), F.col("new").alias("__new"))
    return labels.join(own, ["talk", "spk"], "left").withColumn("spk", F.coalesce("__new", "spk")).drop("__new")


def differing(online: DataFrame, refined: DataFrame) -> DataFrame:
    """Segments whose refined label isn't the online one."""
    own = refined.select("talk", "sid", F.col("spk").alias("now"), "conf")
    both = online.select("talk", "sid", F.col("spk").alias("was")).join(own, ["talk", "sid"])
    return both.where(~F.col("was").eqNullSafe(F.col("now"))).orderBy("talk", "sid")


# -- in retrospect --------------------------------------------------------------------------------


#: Distances that differ by less are equal; sums of the same vectors in another order do.
TIE = 1e-12
#: Distances that are held at once.
CELLS = 2_000_000


def average_linkage(v: np.ndarray, weight: np.ndarray, limit: float, tag: np.ndarray | None = None) -> np.ndarray:
    """Cluster number of each unit vector; clusters join while the weighted mean distance is at most `limit`.

    Vectors of different tags (from 0; -1 is none) never share a cluster. Of
    equal distances the first pair in order joins. The cluster's row is its
    first member's.

    The weighted mean distance of two clusters is 1 less the product of their
    weighted means, so means are all that is kept, no table of distances. Each
    row knows its nearest later row. A join brings nothing nearer than the
    nearer of its two rows was, so what a row knew stays a lower bound if that
    row has joined; it looks again only once its bound is the least of all.
    """
    n = len(v)
    mean, size, tags = np.array(v, float), weight.astype(float).copy(), np.full(n, -1) if tag is None else np.asarray(tag).copy()
    home, row = np.arange(n), np.arange(n)
    gone, near, least, stale = np.zeros(n), np.full(n, n), np.full(n, np.inf), np.zeros(n, bool)

    def look(at: int, to: int) -> None:
        """The first nearest of the rows after each of at to `to`, that one not included."""
        far = 1.0 - mean[at:to] @ mean[at:].T + gone[at:]
        far[np.arange(len(mean) - at) <= np.arange(to - at)[:, None]] = np.inf
        own = tags[at:to, None]
        if (own >= 0).any():
            far[(own >= 0) & (tags[at:] >= 0) & (own != tags[at:])] = np.inf
        far[far > limit] = np.inf
        low = far.min(1)
        near[at:to] = at + (far <= low[:, None] + TIE).argmax(1)
        least[at:to], stale[at:to] = np.round(low, 12), False

    step = max(1, CELLS // max(n, 1))
    for i in range(0, n, step):
        look(i, min(n, i + step))
    left = n
    while left > 1:
        i = int(np.argmin(least))
        if least[i] == np.inf:
            break
        if stale[i]:
            look(i, i + 1)
            continue
        j = int(near[i])
        mean[i] = (size[i] * mean[i] + size[j] * mean[j]) / (size[i] + size[j])
        size[i] += size[j]
        tags[i], tags[j] = max(tags[i], tags[j]), -1
        home[row[j]] = row[i]
        gone[j], least[j] = np.inf, np.inf
        stale |= (near == i) | (near == j)
        stale[i], left = True, left - 1
        if left < 0.7 * len(row):
            kept = gone == 0
            near = np.append(np.cumsum(kept) - 1, len(row))[near]
            mean, size, tags, row, gone, near, least, stale = (x[kept] for x in (mean, size, tags, row, gone, near, least, stale))
    for k in range(n):  # a row joins an earlier one, whose home is known by then
        home[k] = home[home[k]]
    return np.unique(home, return_inverse=True)[1] if n else home


def _named(groups: np.ndarray, middle: dict, tag: np.ndarray, roster: list[str], known: np.ndarray, knobs: Knobs) -> dict[int, str]:
    """Names of clusters: by their tagged members, then greedily one to one by likeness, then by number."""
    top = np.full(int(groups.max()) + 1, -1)
    np.maximum.at(top, groups, tag)
    names = {k: roster[int(top[k])] for k in middle if top[k] >= 0}
    used = set(names.values())
    offers = [(-float(c @ e), k, i) for k, c in middle.items() if k not in names for i, e in enumerate(known)]
    for worse, k, i in sorted(offers, key=lambda o: o[0]):
        if -worse >= knobs.assign and k not in names and roster[i] not in used:
            names[k] = roster[i]
            used.add(roster[i])
    return {k: names.get(k, f"R{k + 1}") for k in middle}


def refined_labels(vectors: DataFrame, knobs: Knobs = Knobs(), enrolled: dict | None = None, limit: float | None = None) -> DataFrame:
    """(talk, sid, spk, conf) from all unit vectors (talk, sid, v, weight) of a talk at once; talks of one segment have none."""
    roster = sorted(enrolled or {})
    known = np.array([enrolled[name] for name in roster], float) if roster else np.zeros((0, 0))
    limit = knobs.refine if limit is None else limit
    kind = vectors.schema["talk"].dataType.simpleString()

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("sid", kind="stable")
        out = []
        if len(rows) > 1:
            v, w = np.stack(rows["v"].to_list()).astype(float), np.maximum(rows["weight"].to_numpy(float), 0.1)
            tag = np.full(len(v), -1)
            if roster:
                sims = v @ known.T
                tag = np.where(sims.max(1) >= knobs.assign, sims.argmax(1), -1)
            groups = average_linkage(v, w, limit, tag)
            sums = np.zeros((int(groups.max()) + 1, v.shape[1]))
            np.add.at(sums, groups, v * w[:, None])
            middle = {k: u for k, x in enumerate(sums) if (u := _unit(x)) is not None}
            names = _named(groups, middle, tag, roster, known, knobs)
            for sid, k, own in zip(rows["sid"], groups, v, strict=True):
                if int(k) in names:
                    out.append((*key, int(sid), names[int(k)], round(float(np.clip(own @ middle[int(k)], 0, 1)), 3)))
        return pd.DataFrame(out, columns=["talk", "sid", "spk", "conf"])

    return vectors.select("talk", "sid", "v", "weight").groupBy("talk").applyInPandas(one, f"talk {kind}, sid long, spk string, conf double")
