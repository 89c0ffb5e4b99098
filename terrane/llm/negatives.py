"""Hard-negative mining by a vertical scan of columnar dimensions (BOND).

Vectors lie in shards of one label each, dimension by dimension, with the
smallest and largest value of every dimension. An anchor reads a shard's
dimensions in descending order of its own magnitudes. After some dimensions,
what the unread ones can still add lies between sums of the anchor's weights
times their extremes; candidates whose bounds can't meet the wanted ranks or
score windows leave the candidate bitmap, and later dimensions are read for
those left alone. When all dimensions are read, scores are exact.

Shards hold like vectors (signs of fixed projections, more of them as the table
grows) and a bounded number of rows. The same extremes bound an anchor's
scores in a whole shard: an anchor first reads the shard of the highest bound,
and then only those shards whose bounds reach what it has found. A shard's rows
travel once for every ``GUESTS`` anchors that read it, anchors one by one.

First the positives (the best other rows of the anchor's label) are found, then
for each of them the best rows of other labels whose score lies in a window
given in percent of the positive's score.

Edge cases: rows with a null id, label or vector, or with a null or non-finite
component, take no part; a label of any share of the rows and equal vectors in
any number are split over shards; vectors of unlike length: missing components
count as 0; a repeated id is a candidate of its own, and an anchor of its own;
ties go to the smaller id; a positive of score 0 or less has the window that the
percentages give (below 0: none); an anchor without positives has no rows; an
empty table gives no rows; other columns are ignored. A
hundred times a score has to fit into 64 bits.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.common import mix64, small_batches
from terrane.session import materialize

SCALE = 256.0
SHARD = 16_384          # rows per shard, about
MOST_SIGNS = 16
GUESTS = 20_000         # anchors that one copy of a shard serves, about
BLOCK = 512             # shards whose extremes stand in one row
LOW, HIGH = 30, 90      # percent of the positive's score

_RESULT = ("anchor_id long, anchor_row long, positive_id long, positive_rank int, rank int, negative_id long, "
           "positive_score long, negative_score long")
_EXACT = 2.0 ** 46      # floats hold 100 times a score exactly below this


# --- the scan --------------------------------------------------------------

class Columns:
    """A shard: one row of ``data`` per dimension, with its extremes."""

    def __init__(self, data: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        self.data, self.ids, self.rows = data, ids, rows
        self.low, self.high = extremes(data)
        self.top = float(max(np.abs(self.low).max(initial=0), np.abs(self.high).max(initial=0)))

    def fit(self, q: np.ndarray) -> np.ndarray:
        """``q`` as long as the shard has dimensions; exact in floats where
        the products allow, else in 64-bit integers."""
        q = fitted(q, len(self.data))
        exact = float(np.abs(q).max(initial=0)) * self.top * max(len(q), 1) < _EXACT
        return q.astype(np.float64) if exact else q


def extremes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if data.shape[1] == 0:
        return np.zeros(len(data), np.int64), np.zeros(len(data), np.int64)
    return data.min(axis=1).astype(np.int64), data.max(axis=1).astype(np.int64)


def fitted(q: np.ndarray, dim: int) -> np.ndarray:
    return np.pad(q[:dim], (0, max(0, dim - len(q))))


def kth_largest(x: np.ndarray, k: int) -> float:
    return np.partition(x, len(x) - k)[len(x) - k]


class TopRanks:
    """Keeps what may be among the k best, and at least ``floor``."""

    def __init__(self, k: int, floor: int | None):
        self.k, self.floor = k, floor

    def keep(self, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        least = -np.inf if self.floor is None else self.floor
        if len(lower) >= self.k:
            least = max(least, kth_largest(lower, self.k))
        return upper >= least

    def pick(self, score: np.ndarray, ids: np.ndarray) -> list[tuple[int, np.ndarray]]:
        if self.floor is not None:
            ok = np.flatnonzero(score >= self.floor)
            return [(0, ok[np.lexsort((ids[ok], -score[ok]))][:self.k])]
        return [(0, np.lexsort((ids, -score))[:self.k])]


class Windows:
    """Keeps what may be among the k best within LOW to HIGH percent of a
    positive's score, for any of the positives."""

    def __init__(self, k: int, positives: list[int], floors: list[int | None]):
        self.k, self.each = k, list(zip(positives, floors))

    def keep(self, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        alive = np.zeros(len(lower), bool)
        lo, hi = lower * 100, upper * 100
        for p, floor in self.each:
            may = (hi >= LOW * p) & (lo <= HIGH * p)
            sure = np.flatnonzero((lo >= LOW * p) & (hi <= HIGH * p))
            least = -np.inf if floor is None else floor
            if len(sure) >= self.k:
                least = max(least, kth_largest(lower[sure], self.k))
            alive |= may & (upper >= least)
        return alive

    def pick(self, score: np.ndarray, ids: np.ndarray) -> list[tuple[int, np.ndarray]]:
        out = []
        for i, (p, floor) in enumerate(self.each):
            ok = (score * 100 >= LOW * p) & (score * 100 <= HIGH * p)
            if floor is not None:
                ok &= score >= floor
            ok = np.flatnonzero(ok)
            out.append((i, ok[np.lexsort((ids[ok], -score[ok]))][:self.k]))
        return out


def vertical_scan(q: np.ndarray, shard: Columns, rule, but: int | None = None) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(which, candidates, scores) by ``rule``, reading the dimensions in
    descending order of |q|; ``but``: the row left out."""
    q = shard.fit(q)
    order = np.argsort(-np.abs(q), kind="stable")
    q = q[order]
    low, high = shard.low[order].astype(q.dtype), shard.high[order].astype(q.dtype)
    # what the dimensions from each place on can add
    rest = lambda x: np.concatenate((np.cumsum(x[::-1])[::-1], x[:1] * 0))
    least, most = rest(np.minimum(q * low, q * high)), rest(np.maximum(q * low, q * high))
    alive = np.ones(len(shard.ids), bool) if but is None else shard.rows != but
    at = np.flatnonzero(alive)
    score = np.zeros(len(at), q.dtype)
    done, step = 0, 4
    while done < len(q) and len(at):
        dims = order[done:done + step]
        read = shard.data[dims]
        read = read if len(at) == len(alive) else read[:, at]
        score = score + q[done:done + step] @ read.astype(q.dtype)
        done += len(dims)
        step = min(2 * step, 16)
        keep = rule.keep(score + least[done], score + most[done])
        at, score = at[keep], score[keep]
    score = score.astype(np.int64)
    return [(i, at[x], score[x]) for i, x in rule.pick(score, shard.ids[at])]


# --- tables ----------------------------------------------------------------

def quantised(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """vec_id, row, label, signs, v (little-endian 64-bit floor(SCALE x)) of
    the rows that take part, stored."""
    x = F.col(vector)
    sound = (F.col(key).isNotNull() & F.col(label).isNotNull() & x.isNotNull()
             & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))
    slim = (vectors.withColumn("__row", F.monotonically_increasing_id()).filter(sound)
            .select(F.col(key).cast("long").alias("vec_id"), F.col("__row").alias("row"),
                    F.col(label).cast("long").alias("label"),
                    F.transform(x, lambda e: F.floor(e.cast("double") * SCALE).cast("long")).alias("x")))

    def pack(batches):
        for b in batches:
            lists = b.column(3)
            flat = lists.flatten().to_numpy().astype("<i8")
            cuts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            vs = [flat[x:y] for x, y in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array([_signs(v) for v in vs], pa.int64()),
                 pa.array([v.tobytes() for v in vs], pa.binary())], ["vec_id", "row", "label", "signs", "v"])

    return materialize(slim.mapInArrow(pack, "vec_id long, row long, label long, signs long, v binary"), "neg-vectors")


@lru_cache(8)
def _projections(dim: int) -> np.ndarray:
    s = mix64(np.arange(1, dim * MOST_SIGNS + 1, dtype=np.uint64)).astype(np.int64) % 1000 / 1000.0
    return s.reshape(dim, MOST_SIGNS)


def _signs(v: np.ndarray) -> int:
    """Signs of fixed projections, as bits."""
    return int(((v @ _projections(len(v))) > 0) @ (1 << np.arange(MOST_SIGNS)))


def shard_table(rows: DataFrame, size: int) -> DataFrame:
    """One stored row per shard: of one label, one pattern of signs and about
    ``size`` rows at most."""
    n = rows.count()
    bits = min(MOST_SIGNS, max(0, int(np.log2(max(1.0, n / size))) - 3))
    cell = F.col("signs").bitwiseAND((1 << bits) - 1)
    placed = rows.withColumn("cell", cell)
    cells = materialize(placed.groupBy("label", "cell").agg(F.ceil(F.count("*") / size).alias("subs")), "neg-cells")
    placed = placed.join(cells, ["label", "cell"]).withColumn("sub", F.pmod(F.xxhash64("row"), "subs"))

    def pack(t: pa.Table) -> pa.Table:
        vs = [np.frombuffer(v, "<i8") for v in t.column("v").to_pylist()]
        dim = max(map(len, vs))
        data = np.zeros((dim, len(vs)), "<i8")
        for i, v in enumerate(vs):
            data[:len(v), i] = v
        low, high = extremes(data)
        head = t.slice(0, 1)
        return pa.table({
            "label": head.column("label"), "cell": head.column("cell"), "sub": head.column("sub"),
            "n": pa.array([len(vs)], pa.int64()), "dim": pa.array([dim], pa.int32()),
            **{k: pa.array([x.astype("<i8").tobytes()], pa.binary()) for k, x in (
                ("ids", t.column("vec_id").to_numpy()), ("rows", t.column("row").to_numpy()), ("data", data),
                ("low", low), ("high", high))}})

    packed = placed.select("label", "cell", "sub", "vec_id", "row", "v").groupBy("label", "cell", "sub").applyInArrow(
        pack, "label long, cell long, sub long, n long, dim int, ids binary, rows binary, data binary, "
              "low binary, high binary")
    return materialize(packed.withColumn("shard", F.monotonically_increasing_id()), "neg-shards")


def _meet(holders: DataFrame, guests: DataFrame, run, schema: str) -> DataFrame:
    """Rows of ``run(holder, guest)`` for all guests of a holder (shard). A
    holder's row goes to as many tasks as its guests need; there it stands
    before them, and they follow one by one."""
    load = materialize(guests.groupBy("shard").agg(F.ceil(F.count("*") / GUESTS).alias("parts")), "neg-load")
    tasks = load.agg(F.sum("parts")).first()[0] or 1
    held = (holders.join(load, "shard")
            .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
            .withColumn("guest", F.lit(0)))
    came = (guests.join(load, "shard").withColumn("part", F.pmod(F.xxhash64("anchor"), "parts")).drop("parts")
            .withColumn("guest", F.lit(1)))
    both = held.unionByName(came, allowMissingColumns=True)
    names = [f.split()[0] for f in schema.split(", ")]

    def work(batches):
        holder = None
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["guest"] == 0:
                    holder = r
                elif holder is not None and holder["shard"] == r["shard"]:
                    out += run(holder, r)
            cols = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    return (both.repartition(int(tasks), "shard", "part").sortWithinPartitions("shard", "part", "guest")
            .mapInArrow(work, schema))


def _vector(r: dict) -> np.ndarray:
    return np.frombuffer(r["v"], "<i8")


def _bounds(holder: dict, r: dict) -> tuple[dict, np.ndarray, np.ndarray]:
    """(block, lowest, highest score) of an anchor over a block's shards."""
    if "block" not in holder:                     # opened once, by its first guest
        dim = holder["dim"]
        shards, labels = (np.array(holder[c]) for c in ("shards", "labels"))
        sides = (np.stack([fitted(np.frombuffer(x, "<i8"), dim) for x in holder[c]]) for c in ("lows", "highs"))
        holder["block"] = dict(zip(("shards", "labels", "low", "high"), (shards, labels, *sides)))
    block = holder["block"]
    q = fitted(_vector(r), holder["dim"])
    exact = float(np.abs(q).max(initial=0)) * float(np.abs([block["low"], block["high"]]).max(initial=0)) * max(len(q), 1)
    q = q.astype(np.float64) if exact < _EXACT else q
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    low, high = block["low"].astype(q.dtype), block["high"].astype(q.dtype)
    return block, low @ up + high @ down, high @ up + low @ down


def _wanted(block: dict, r: dict, lower: np.ndarray, upper: np.ndarray, same: bool) -> np.ndarray:
    """The shards that may hold what an anchor still looks for."""
    ok = (block["labels"] == r["label"]) == same
    if r["first"] is not None:
        ok &= block["shards"] != r["first"]
    return ok & _rule(r, same, 1 << 62).keep(lower, upper)


def _rule(r: dict, same: bool, k: int):
    return TopRanks(k, r["floors"][0] if r["floors"] else None) if same else Windows(
        k, r["positives"], r["floors"] or [None] * len(r["positives"]))


def _search(anchors: DataFrame, shards: DataFrame, blocks: DataFrame, n_blocks: int, same: bool, k: int) -> DataFrame:
    """anchor, which, vec_id, row, score: the k best of every anchor and rule,
    from the shard of the highest bound and then from all that can add to it.
    ``anchors``: anchor (its row), label, v, positives."""
    all_blocks = F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))
    over = lambda df: df.withColumn("shard", F.explode(all_blocks))

    def best(holder, r):
        block, lower, upper = _bounds(holder, r)
        ok = np.flatnonzero(_wanted(block, r, lower, upper, same))
        if not len(ok):
            return []
        top = ok[np.argmax(upper[ok])]
        return [(r["anchor"], int(block["shards"][top]), int(upper[top]))]

    def every(holder, r):
        block, lower, upper = _bounds(holder, r)
        return [(r["anchor"], int(s)) for s in block["shards"][_wanted(block, r, lower, upper, same)]]

    def scan(holder, r):
        if "columns" not in holder:               # opened once, by its first guest
            data = np.frombuffer(holder["data"], "<i8").reshape(holder["dim"], holder["n"])
            holder["columns"] = Columns(data, *(np.frombuffer(holder[c], "<i8") for c in ("ids", "rows")))
        c = holder["columns"]
        return [(r["anchor"], i, int(c.ids[x]), int(c.rows[x]), int(s))
                for i, at, score in vertical_scan(_vector(r), c, _rule(r, same, k), r["anchor"])
                for x, s in zip(at, score)]

    none = anchors.withColumn("first", F.lit(None).cast("long")).withColumn("floors", F.lit(None).cast("array<long>"))
    found = "anchor long, which long, vec_id long, row long, score long"
    bounds = _meet(blocks, over(none), best, "anchor long, shard long, bound long")
    first = materialize(bounds.groupBy("anchor").agg(F.max(F.struct("bound", "shard")).alias("b"))
                        .select("anchor", F.col("b.shard").alias("first")), "neg-first")
    one = materialize(_meet(shards, none.drop("first").join(first, "anchor").withColumn("shard", F.col("first")),
                            scan, found), "neg-found-first")
    full = (one.groupBy("anchor", "which").agg(F.count("*").alias("n"), F.min("score").alias("least"))
            .withColumn("least", F.when(F.col("n") >= k, F.col("least"))))
    whole = full.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("which", "least"))).alias("m"))
    wide = (F.array(F.element_at("m", F.lit(0).cast("long"))) if same else F.transform(
        F.sequence(F.lit(0), F.size("positives") - 1), lambda i: F.element_at("m", i.cast("long"))))
    then = materialize(anchors.join(first, "anchor").join(whole, "anchor", "left")
                       .withColumn("floors", wide).drop("m"), "neg-then")
    routes = materialize(_meet(blocks, over(then), every, "anchor long, shard long"), "neg-routes")
    two = _meet(shards, then.join(routes, "anchor"), scan, found)
    w = Window.partitionBy("anchor", "which").orderBy(F.desc("score"), "vec_id", "row")
    return materialize(one.unionByName(two).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k),
                       "neg-found")


def hard_negatives(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                   every: int = 100, positives: int = 5, k: int = 10, size: int = SHARD) -> DataFrame:
    """anchor_id, anchor_row, positive_id, positive_rank, rank, negative_id,
    positive_score, negative_score; anchors are the rows whose id is divisible
    by ``every``."""
    small_batches(vectors.sparkSession)
    rows = quantised(vectors, key, vector, label)
    shards = shard_table(rows, size)
    one = F.struct("shard", "label", "low", "high")
    # a block is a row with the extremes of some BLOCK shards
    n_blocks = -(-shards.count() // BLOCK)
    blocks = materialize(
        shards.withColumn("block", F.pmod(F.xxhash64("shard"), F.lit(max(1, n_blocks)))).groupBy("block").agg(F.max("dim").alias("dim"), F.collect_list(one).alias("s"))
        .select(F.col("block").alias("shard"), "dim", F.col("s.shard").alias("shards"), F.col("s.label").alias("labels"),
                F.col("s.low").alias("lows"), F.col("s.high").alias("highs")), "neg-blocks")
    if not n_blocks:
        return vectors.sparkSession.createDataFrame([], _RESULT)
    anchors = materialize(rows.filter(F.col("vec_id") % every == 0)
                          .select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "v"),
                          "neg-anchors")
    plain = anchors.drop("anchor_id")
    near = _search(plain.withColumn("positives", F.lit(None).cast("array<long>")), shards, blocks, n_blocks, True, positives)
    listed = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("p"))
    asked = materialize(plain.join(listed, "anchor").withColumn("positives", F.col("p.score")).drop("p"), "neg-asked")
    far = _search(asked, shards, blocks, n_blocks, False, k)
    return (far.withColumn("positive_rank", (F.col("which") + 1).cast("int"))
            .select("anchor", "positive_rank", "rank", F.col("vec_id").alias("negative_id"),
                    F.col("score").alias("negative_score"))
            .join(near.select("anchor", F.col("rank").alias("positive_rank"), F.col("vec_id").alias("positive_id"),
                              F.col("score").alias("positive_score")), ["anchor", "positive_rank"])
            .join(anchors.select("anchor", "anchor_id"), "anchor")
            .select("anchor_id", F.col("anchor").alias("anchor_row"), "positive_id", "positive_rank",
                    F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))
