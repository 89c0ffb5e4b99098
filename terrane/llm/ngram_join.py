"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct 5-word shingles (the whole sequence if
shorter). All sets are ordered alike, rarest shingles first, by a count sketch
over every document. With threshold t, the prefix of length
n - ceil(t n) + l of each of two sets with similarity t or more shares at
least l shingles. Each document picks its own l by estimated cost: a longer
prefix costs postings, but asks a candidate for more shared shingles. A pair
is a candidate if its prefixes share min(l) shingles, and as many as its
sizes leave necessary beyond the longer of the two rests. Candidates are
verified on the whole sets.

Hot groups. Equal sets are one node from the start. Of the nodes that share a
shingle, each is first compared with one pivot, the least changed; verified
links make stars. After that only pairs between different stars are left to
compare, and of these only pairs with one side outside the token's largest star
are made, at tokens whose rank allows the shared number. A group of thousands
of near copies so costs about one comparison per copy and shingle, and no link
between different stars is missed.

Shingles and sets are compared by 64-bit hashes.

Edge cases: null, empty and blank texts have an empty set, are linked with
nothing and are a component of their own; equal texts and repeated rows are
linked; rows without an id count as copies, and give no id to a component; an
empty table gives no rows; other columns play no part. A task holds an Arrow
batch, one text's words, a sketch of fixed size, and one bucket of postings
(some BUCKET_SHINGLES shingles' prefixes, as the number of buckets follows the
corpus) or the nodes of the sets that it has made.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.common import NUMBER, fanout, mix64, numbered, utf8_of
from terrane.llm.components import connected_components
from terrane.session import materialize, scratch

WORDS = 5
PERCENT = 80
SKETCH_BITS = 20
SLICE_BITS = 12
MAX_MATCH = 8
HOT = 100_000                 # postings of a token (by the sketch) beyond which it goes by rows
_KNOWN_WORDS = 200_000
BUCKET_SHINGLES = 4_000_000   # shingles (all of a set, not the prefix) per bucket of postings, about
GUESTS = 2_000                # sets that one copy of a pivot's set is compared with, about
_ARROW_NUMBER = pa.struct([("file", pa.int64()), ("at", pa.int64())])

_K = mix64(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)
_SHORT = mix64(np.arange(101, 101 + WORDS, dtype=np.uint64))


class _WordHash(dict):
    def __missing__(self, word):
        import xxhash
        if len(self) > _KNOWN_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hash = _WordHash()


def shingle_set(raw: bytes, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a UTF-8 text."""
    words = raw.lower().split()               # bytes: A-Z and ASCII white space only
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(w)
    if n == 0:
        return w
    if n < WORDS:
        return mix64((w * _K[:n]).sum(keepdims=True, dtype=np.uint64) + _SHORT[n])
    s = w[:n - WORDS + 1] * _K[0]
    for i in range(1, WORDS):
        s += w[i:n - WORDS + 1 + i] * _K[i]
    s = np.sort(mix64(s))
    return s[np.concatenate(([True], s[1:] != s[:-1]))]


def node_of(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _needed(n):
    """Smallest overlap of a set of n with any set it links to: ceil(t n)."""
    return -(-PERCENT * n // 100)


def _nullable(number: pa.Array) -> pa.Array:
    """Row numbers in the one type that all batches have."""
    return pa.StructArray.from_arrays([number.field("file"), number.field("at")], fields=list(_ARROW_NUMBER))


def sets_and_sketch(docs: DataFrame, row_id: str | None = None) -> DataFrame:
    """One row per document (doc_id, n, node, and its ``row_id`` as row) and,
    per task, slices of its sketch of shingle counts (slice, counts)."""
    number = [] if row_id is None else ["row"]

    def run(batches):
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        for b in batches:
            ns, nodes = [], []
            for raw in utf8_of(b.column(1)):
                s = shingle_set(raw, _hash)
                ns.append(len(s))
                nodes.append(node_of(s) if len(s) else None)
                np.add.at(sketch, (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), np.uint32(1))
            none = pa.nulls(len(ns), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ns, pa.int64()), pa.array(nodes, pa.int64()), none,
                 pa.nulls(len(ns), pa.binary()), *map(_nullable, b.columns[2:])], ["doc_id", "n", "node", "slice", "counts", *number])
        parts = sketch.reshape(-1, 1 << SLICE_BITS)
        some = np.flatnonzero(parts.any(1))
        none = pa.nulls(len(some), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [none, none, none, pa.array(some, pa.int32()),
             pa.array([zlib.compress(parts[i].tobytes(), 1) for i in some], pa.binary()),
             *(pa.nulls(len(some), _ARROW_NUMBER) for _ in number)],
            ["doc_id", "n", "node", "slice", "counts", *number])

    taken = [F.col(row_id).alias("row")] if number else []
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *taken).mapInArrow(
        run, "doc_id long, n long, node long, slice int, counts binary" + f", row {NUMBER}" * len(number))


def _summed_sketch(slices: DataFrame) -> np.ndarray:
    """The counts of all tasks; what reaches the driver has a fixed size."""

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(1 << SLICE_BITS, np.uint64)
        for c in t.column("counts").to_pylist():
            total += np.frombuffer(zlib.decompress(c), np.uint32)
        total = np.minimum(total, np.uint64(2 ** 32 - 1)).astype(np.uint32)
        return pa.table({"slice": t.column("slice")[:1], "counts": pa.array([zlib.compress(total.tobytes(), 1)])})

    out = np.zeros((1 << SKETCH_BITS - SLICE_BITS, 1 << SLICE_BITS), np.uint32)
    summed = slices.select("slice", "counts").groupBy("slice").applyInArrow(add, "slice int, counts binary")
    for r in summed.collect():
        out[r["slice"]] = np.frombuffer(zlib.decompress(r["counts"]), np.uint32)
    return out.reshape(-1)


def prefix(s: np.ndarray, sketch: np.ndarray, noise: float) -> tuple[np.ndarray, int]:
    """(the set's prefix, rarest first, and the matches l it asks for)."""
    n = len(s)
    count = sketch[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    order = np.lexsort((s, count))
    base = n - _needed(n)
    most = min(MAX_MATCH, n - base)
    # what a token's list is expected to hold besides chance neighbours in its counter
    extra = np.cumsum(np.maximum(count[order[:base + most]] - noise, 0.0))
    ls = np.arange(1, most + 1)
    scanned = extra[base + ls - 1]
    l = int(ls[np.argmin(base + ls + scanned + 20 * scanned / ls)])
    return s[order[:base + l]], l


def _postings(docs: DataFrame, sketch: np.ndarray, hot: int, buckets: int) -> DataFrame:
    """Rows of two kinds: blobs (bucket, data), and single postings (token,
    node, n, l) of tokens whose counter exceeds ``hot``. A blob has one task's postings of a bucket, sorted
    by token; tokens are cut to 48 bits there, which can only add candidates."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(sketch)
    load = float(sketch.mean())
    noise = load + 3 * load ** 0.5
    flush = 400_000

    def blobs(parts, nodes):
        token = np.concatenate([p for p, _ in parts])
        owner = np.repeat(np.arange(len(parts)), [len(p) for p, _ in parts])
        table = np.array(nodes, np.int64)                       # node, n, l
        key = token >> np.uint64(16)
        bucket = (mix64(token) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((key, bucket))
        key, owner, bucket = key[order], owner[order], bucket[order]
        cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        names, datas = [], []
        for lo, hi in zip(cuts, [*cuts[1:], len(key)]):
            k = key[lo:hi]
            used, where = np.unique(owner[lo:hi], return_inverse=True)
            names.append(int(bucket[lo]))
            datas.append(zlib.compress(b"".join((
                np.array([len(k), len(used)], "<u8").tobytes(),
                np.diff(k, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(),
                where.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), table[used].tobytes())), 1))
        n = len(names)
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.int32()), pa.array(datas, pa.binary()), *(pa.nulls(n, pa.int64()),) * 4],
            ["bucket", "data", "token", "node", "n", "l"])

    def run(batches):
        counts = sent.value
        seen, parts, nodes, size = set(), [], [], 0
        for b in batches:
            hots = []
            for raw in utf8_of(b.column(0)):
                s = shingle_set(raw, _hash)
                if not len(s):
                    continue
                node = node_of(s)
                if node in seen:
                    continue
                seen.add(node)
                p, l = prefix(s, counts, noise)
                much = counts[(p >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] > hot
                hots += [(int(t >> np.uint64(16)), node, len(s), l) for t in p[much]]
                parts.append((p[~much], node))
                nodes.append((node, len(s), l))
                size += len(p) - int(much.sum())
                if size > flush:
                    # a blob holds a bounded number of postings
                    yield blobs(parts, nodes)
                    parts, nodes, size, seen = [], [], 0, set()
            if hots:
                cols = list(zip(*hots))
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(hots), pa.int32()), pa.nulls(len(hots), pa.binary()),
                     *(pa.array(c, pa.int64()) for c in cols)],
                    ["bucket", "data", "token", "node", "n", "l"])
        if size:
            yield blobs(parts, nodes)

    return docs.select("text").mapInArrow(
        run, "bucket int, data binary, token long, node long, n long, l long")


def _opened(data: bytes):
    raw = zlib.decompress(data)
    n, m = np.frombuffer(raw, "<u8", 2).tolist()
    at = 16
    diff = np.frombuffer(raw, np.uint8, n * 8, at).reshape(8, n).T.copy().view("<u8").reshape(-1)
    at += n * 8
    where = np.frombuffer(raw, np.uint8, n * 4, at).reshape(4, n).T.copy().view("<u4").reshape(-1)
    at += n * 4
    table = np.frombuffer(raw, np.int64, m * 3, at).reshape(m, 3)
    return np.cumsum(diff, dtype=np.uint64), table[where]


def shared_postings(docs: DataFrame, sketch: np.ndarray, hot: int, buckets: int) -> DataFrame:
    """token, node, n, l, df, rank, s of the prefix tokens that a node shares with
    another of fitting size; ``df`` nodes hold the token, the node has ``s`` such
    tokens, and ``rank`` more frequent ones."""
    made = materialize(_postings(docs, sketch, hot, buckets), "postings")

    def meet(t: pa.Table) -> pa.Table:
        opened = [_opened(d) for d in t.column("data").to_pylist()]
        token = np.concatenate([k for k, _ in opened])
        rest = np.concatenate([r for _, r in opened])
        order = np.lexsort((rest[:, 0], token))
        token, rest = token[order], rest[order]
        fresh = np.concatenate(([True], (token[1:] != token[:-1]) | (rest[1:, 0] != rest[:-1, 0])))
        token, rest = token[fresh], rest[fresh]
        _, where, df = np.unique(token, return_inverse=True, return_counts=True)
        # a posting is of use if another holder of the token has a size it can
        # link to: by size, that is the one before it or the one after
        order = np.lexsort((rest[:, 1], token))
        token, rest, where = token[order], rest[order], where[order]
        near = (token[1:] == token[:-1]) & (rest[:-1, 1] * 100 >= rest[1:, 1] * PERCENT)
        keep = np.concatenate((near, [False])) | np.concatenate(([False], near))
        return pa.table({"token": pa.array(token[keep].astype(np.int64)),
                         **{c: pa.array(rest[keep, i]) for i, c in enumerate(("node", "n", "l"))},
                         "df": pa.array(df[where][keep])})

    quiet = (made.filter(F.col("bucket").isNotNull()).select("bucket", "data").groupBy("bucket")
             .applyInArrow(meet, "token long, node long, n long, l long, df long"))
    loud = materialize(made.filter(F.col("token").isNotNull()).select("token", "node", "n", "l").distinct(), "loud")
    held = materialize(loud.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"), "loud-tokens")
    met = materialize(quiet.unionByName(loud.join(held, "token").select("token", "node", "n", "l", "df")), "met")
    # a node's shared tokens, the most frequent first: as many as a text has
    frequent = Window.partitionBy("node").orderBy(F.desc("df"), "token")
    return (met.withColumn("rank", F.row_number().over(frequent) - 1)
            .withColumn("s", F.count("*").over(Window.partitionBy("node"))))


def _least_shared():
    """Prefix tokens that a and b must share, from n_a, l_a, n_b, l_b."""
    need = lambda n: F.ceil(F.col(n) * PERCENT / 100)
    both = F.ceil((F.col("n_a") + F.col("n_b")) * PERCENT / (100 + PERCENT))
    rest = F.greatest(need("n_a") - F.col("l_a"), need("n_b") - F.col("l_b"))
    return F.greatest(F.least("l_a", "l_b"), both - rest)


def _sizes_fit():
    return ((F.col("n_a") * 100 >= F.col("n_b") * PERCENT) & (F.col("n_b") * 100 >= F.col("n_a") * PERCENT))


def verified(pairs: DataFrame, docs: DataFrame, owners: DataFrame) -> DataFrame:
    """The pairs (a, b) with a similarity of the threshold or more, on whole
    sets. ``owners``: node, owner (a document that has the set).

    A set b travels once per pair. A set a, which many pairs may share, travels
    once per GUESTS of its pairs; it stands before their b in a task, where
    they follow one by one."""
    with scratch(docs.sparkSession):
        return materialize(_verified(pairs, docs, owners), "verified", keep=True)


def _verified(pairs: DataFrame, docs: DataFrame, owners: DataFrame) -> DataFrame:
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    chosen = materialize(wanted.join(owners.hint("merge"), "node").select("owner").distinct(), "owners")

    def sets(batches):
        seen = set()
        for b in batches:
            found = {node_of(x): x.tobytes() for x in (shingle_set(raw, _hash) for raw in utf8_of(b.column(0)))
                     if len(x)}
            fresh = [k for k in found if k not in seen]
            seen.update(fresh)
            yield pa.RecordBatch.from_arrays([pa.array(fresh, pa.int64()),
                                              pa.array([found[k] for k in fresh], pa.binary())], ["node", "shingles"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    have = (slim.join(chosen, F.col("doc_id").eqNullSafe(F.col("owner")), "left_semi").select("text")
            .mapInArrow(sets, "node long, shingles binary"))
    have = materialize(have, "sets")
    # only rows that repeat an id bring a set twice
    n = have.agg(F.count("*").alias("all"), F.countDistinct("node").alias("own")).first()
    if n["all"] > n["own"]:
        have = materialize(have.dropDuplicates(["node"]), "sets-once")

    load = materialize(pairs.groupBy("a").agg(F.ceil(F.count("*") / GUESTS).alias("parts")), "pair-load")
    held = (load.hint("merge").join(have.withColumnRenamed("node", "a"), "a")
            .select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"),
                    F.lit(None).cast("long").alias("b"), "shingles"))
    # both sides of each join are stored tables, so Spark can split a hot node
    came = (pairs.join(load.hint("merge"), "a")
            .select("a", F.pmod(F.xxhash64("b"), "parts").alias("part"), "b"))
    came = (came.join(have.select(F.col("node").alias("b"), "shingles").hint("merge"), "b")
            .select("a", "part", "b", "shingles"))

    def judge(batches):
        pivot = s = None
        for batch in batches:
            at, ok = [], []
            for a, b, raw in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                x = np.frombuffer(raw, np.uint64)
                if b is None:
                    pivot, s = a, x
                    continue
                if a != pivot:
                    raise RuntimeError("a set came without the one it is to be compared with")
                both = len(np.intersect1d(s, x, assume_unique=True))
                if 100 * both >= PERCENT * (len(s) + len(x) - both):
                    at.append(a)
                    ok.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(ok, pa.int64())], ["a", "b"])

    return (held.unionByName(came).repartition(fanout(docs.sparkSession), "a", "part")
            .sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()).mapInArrow(judge, "a long, b long"))


def _star_links(shared: DataFrame, docs: DataFrame, owners: DataFrame, nodes: DataFrame) -> DataFrame:
    """Verified links of nodes with a pivot of a token: the node that has the
    fewest prefix tokens to itself, as the least changed copy of a group has."""
    own = F.least(F.col("n"), F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + F.col("l")) - F.col("s")
    pivots = materialize(shared.groupBy("token").agg(F.min(F.struct(own.alias("own"), "node")).alias("p"))
                         .select("token", F.col("p.node").alias("a")), "pivots")
    near = (shared.select("token", F.col("node").alias("b")).join(pivots.hint("merge"), "token").filter("a <> b")
            .groupBy("a", "b").agg(F.count("*").alias("c")))
    pairs = _with_sizes(near, nodes).filter(_sizes_fit() & (F.col("c") >= _least_shared())).select("a", "b")
    return verified(materialize(pairs, "star-pairs"), docs, owners)


def _with_sizes(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    for side in "ba":
        pairs = pairs.join(nodes.select(*(F.col(x).alias(side if x == "node" else f"{x}_{side}")
                                          for x in nodes.columns)).hint("merge"), side)
    return pairs


def _cross_links(shared: DataFrame, stars: DataFrame, docs: DataFrame, owners: DataFrame,
                 nodes: DataFrame) -> DataFrame:
    """Verified links between nodes of different stars.

    Two nodes that must share k prefix tokens have a rarest shared token with
    k - 1 more frequent ones at least before it in both: a pair is made only
    at tokens whose rank allows that, which the frequent tokens do not."""
    slim = shared.select("token", "node", "n", "l", "rank")
    placed = materialize(slim.join(stars.hint("merge"), "node", "left").withColumn("star", F.coalesce("star", "node")), "placed")
    per = placed.groupBy("token", "star").agg(F.count("*").alias("m"))
    mixed = materialize(per.groupBy("token").agg(F.max(F.struct("m", "star")).alias("p"), F.count("*").alias("k"))
                        .filter("k > 1").select("token", F.col("p.star").alias("main")), "mixed")
    member = materialize(placed.join(mixed.hint("merge"), "token"), "members")
    side = lambda s: member.select("token", "main", *(
        F.col(x).alias(f"{x}_{s}") for x in ("node", "n", "l", "rank", "star")))
    left, right = side("a").filter("star_a <> main").drop("main"), side("b")
    made = left.join(right.hint("merge"), "token").filter(
        (F.col("star_a") != F.col("star_b")) & ((F.col("star_b") == F.col("main")) | (F.col("node_a") < F.col("node_b")))
        & _sizes_fit() & (F.least("rank_a", "rank_b") + 1 >= _least_shared()))
    pairs = materialize(made.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
                        .distinct(), "cross-made")
    tokens = materialize(shared.groupBy("node").agg(F.collect_set("token").alias("tokens")), "node-tokens")
    both = pairs.join(tokens.select(F.col("node").alias("a"), F.col("tokens").alias("t_a")).hint("merge"), "a")
    both = materialize(both, "cross-a").join(
        tokens.select(F.col("node").alias("b"), F.col("tokens").alias("t_b")).hint("merge"), "b")
    counted = both.select("a", "b", F.size(F.array_intersect("t_a", "t_b")).alias("c"))
    chosen = _with_sizes(materialize(counted, "cross-counted"), nodes).filter(F.col("c") >= _least_shared())
    return verified(materialize(chosen.select("a", "b"), "cross-pairs"), docs, owners)


def _placed_classes(docs: DataFrame, hot: int, row_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Two stored tables: doc_id, n, node of every row, and node, owner (the
    class's smallest id), root (its component) of every class. With ``row_id``
    the rows have their number as ``row``, and a class that of its first row
    by (id, number), ids before nulls. What else was stored on the way is
    removed. The joined sides grow with the corpus: none is broadcast."""
    spark = docs.sparkSession
    first = materialize(sets_and_sketch(docs, row_id), "shingle-sets")
    number = [] if row_id is None else ["row"]
    rows = first.filter(F.col("n").isNotNull()).select("doc_id", "n", "node", *number)
    with scratch(spark):
        return rows, materialize(_classes(docs, rows, first, hot, number), "placed-classes", keep=True)


def _classes(docs: DataFrame, rows: DataFrame, first: DataFrame, hot: int, number: list[str]) -> DataFrame:
    spark = docs.sparkSession
    sketch = _summed_sketch(first.filter(F.col("slice").isNotNull()))
    shingles = rows.agg(F.sum("n")).first()[0] or 0
    with scratch(spark):
        shared = materialize(shared_postings(docs, sketch, hot, max(fanout(spark), shingles // BUCKET_SHINGLES)),
                             "shared", keep=True)
    classes = rows.filter("n > 0").groupBy("node")
    if number:
        classes = (classes.agg(_first_row("doc_id").alias("f"))
                   .select("node", F.col("f.id").alias("owner"), F.col("f.row").alias("row")))
    else:
        classes = classes.agg(F.min("doc_id").alias("owner"))
    owned = materialize(classes, "classes")
    owners = owned.select("node", "owner")
    nodes = materialize(shared.select("node", "n", "l").distinct(), "nodes")
    with scratch(spark):
        star = materialize(_star_links(shared, docs, owners, nodes), "star-links", keep=True)
    # a node's star: its smallest verified pivot, and that one's in turn
    up = materialize(star.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("star")), "stars-1")
    over = up.select(F.col("node").alias("star"), F.col("star").alias("top"))
    stars = materialize(up.join(over.hint("merge"), "star", "left")
                        .select("node", F.coalesce("top", "star").alias("star")), "stars")
    with scratch(spark):
        cross = materialize(_cross_links(shared, stars, docs, owners, nodes), "cross-links", keep=True)
    # components of whole stars: links within a star are contracted
    at = lambda c: stars.select(F.col("node").alias(c), F.col("star").alias(f"star_{c}")).hint("merge")
    links = (star.unionByName(cross).join(at("a"), "a", "left").join(at("b"), "b", "left")
             .select(F.coalesce("star_a", "a").alias("a"), F.coalesce("star_b", "b").alias("b")))
    with scratch(spark):
        roots = materialize(connected_components(links), "roots", keep=True).withColumnRenamed("node", "star")
    return (owned.join(stars.hint("merge"), "node", "left").withColumn("star", F.coalesce("star", "node"))
            .join(roots.hint("merge"), "star", "left")
            .select("node", "owner", F.coalesce("root", "star").alias("root"), *number))


def _first_row(key: str):
    """The first row by (id, number), ids before nulls."""
    return F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), "row"))


def near_copy_components(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles, node (the set's class), component_id of every
    document."""
    rows, placed = _placed_classes(docs, hot)
    with scratch(docs.sparkSession):
        least = materialize(placed.groupBy("root").agg(F.min("owner").alias("component_id")), "least-ids")
        final = materialize(placed.join(least.hint("merge"), "root").select("node", "component_id"),
                            "class-components", keep=True)
    return (rows.join(final.hint("merge"), "node", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), "node",
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id,
    of repeated rows with that id the first, and a row without an id only where
    no row of the component has one. Rows without words stay. Rows are told
    apart by a number (``numbered``), so other texts under a dropped row's id
    are untouched. Only the numbers of the dropped rows stay on disk."""
    taken = numbered(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("input"))
    with scratch(docs.sparkSession):
        rows, placed = _placed_classes(taken.select("input.doc_id", "input.text", "number"), HOT, "number")
        first = placed.groupBy("root").agg(_first_row("owner").alias("f")).select("root", F.col("f.row").alias("first"))
        stays = materialize(placed.select("node", "root").join(first.hint("merge"), "root").select("node", "first"), "stays")
        gone = materialize(rows.filter("n > 0").join(stays.hint("merge"), "node").filter("row <> first").select("row"),
                           "near-copies", keep=True)
    return (taken.join(gone, taken["number"] == gone["row"], "left_anti")
            .select(*[F.col("input").getField(c).alias(c) for c in docs.columns]))
