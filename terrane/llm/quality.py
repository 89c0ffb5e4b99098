"""Quality classifier: a factorisation machine over hashed words, structure
statistics and text metadata.

A document is a sparse vector x: its distinct words hashed into a fixed space,
continuous statistics of its layout (letter case, symbols, repeats, lines) and
of its size, and one indicator per statistic for the quantile it falls in. The
score is the logistic of w0 + <w, x> + sum over pairs <v_i, v_j> x_i x_j, and
the pair sum is taken in linear time as half of (sum of v x) squared minus the
sum of (v x) squared. The inputs come from the text alone.

The machine is fitted in one task on a bounded sample of labelled rows
(``SAMPLE_ROWS``, those with the smallest hash of the id) and scores every row.

Edge cases: null and empty texts are scored by their (empty) statistics; rows
without labels are scored like all others; with no labelled rows at all every
score is 0.5; repeated rows get repeated results; an empty table gives none;
columns of the input named score or predicted are replaced, others pass.
"""

from __future__ import annotations

import io
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.llm.common import utf8_of

SAMPLE_ROWS = 6_000       # labelled rows the machine is fitted on, at most
WORD_SPACE = 1 << 14
FACTORS = 8
UPDATES = 2_000           # gradient steps, whatever the size of the sample
BINS = 8
THRESHOLD = 0.3
N_STATS = 16

_UPPER, _LOWER = slice(65, 91), slice(97, 123)
_SYMBOLS = np.frombuffer(b"#$%&*@^~<>{}[]=+\\/_`", np.uint8)


def statistics_and_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(statistics of a UTF-8 text, distinct word buckets)."""
    n = len(raw)
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    lines = raw.split(b"\n")
    distinct = set(words)
    m = max(len(words), 1)
    letters = c[_UPPER].sum() + c[_LOWER].sum()
    d = max(n, 1)
    again = sum(a == b for a, b in zip(words, words[1:]))
    low_starts = sum(x[:1].islower() for x in lines)
    stats = np.array([
        c[_UPPER].sum() / max(letters, 1), c[48:58].sum() / d, c[33] / m, c[124] / m,
        c[_SYMBOLS].sum() / m, (c[44] + c[46]) / m, c[128:].sum() / d, len(distinct) / m,
        again / m, np.log1p(n) / 12, np.log1p(len(lines)) / 6, len(set(lines)) / len(lines),
        n / m / 12, low_starts / len(lines), np.log1p(len(words)) / 10, float(n == 0)])
    buckets = np.unique(np.fromiter((zlib.crc32(w.lower()) for w in distinct), np.int64,
                                    len(distinct)) % WORD_SPACE)
    return stats, buckets


class FactorisationMachine:
    def __init__(self, mean, scale, edges, w0, w, v):
        self.mean, self.scale, self.edges = mean, scale, edges      # statistics: standardising, quantiles
        self.w0, self.w, self.v = w0, w, v

    @staticmethod
    def size() -> int:
        return WORD_SPACE + N_STATS + N_STATS * (BINS + 1)

    def vector(self, stats, buckets):
        """Feature numbers and values of a document."""
        z = np.clip((stats - self.mean) / self.scale, -3, 3)
        bins = (stats[:, None] > self.edges).sum(1)
        at = np.concatenate((buckets, WORD_SPACE + np.arange(N_STATS),
                             WORD_SPACE + N_STATS + np.arange(N_STATS) * (BINS + 1) + bins))
        values = np.concatenate((np.full(len(buckets), 1 / np.sqrt(max(len(buckets), 1))), z / 4,
                                 np.full(N_STATS, 0.25)))
        return at, values

    def score(self, stats, buckets) -> float:
        at, x = self.vector(stats, buckets)
        vx = self.v[at] * x[:, None]
        s = vx.sum(0)
        y = self.w0 + self.w[at] @ x + 0.5 * ((s * s).sum() - (vx * vx).sum())
        return float(1 / (1 + np.exp(-np.clip(y, -30, 30))))

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, mean=self.mean, scale=self.scale, edges=self.edges,
                            w0=self.w0, w=self.w.astype(np.float32), v=self.v.astype(np.float32))
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> FactorisationMachine:
        z = np.load(io.BytesIO(data))
        return cls(z["mean"], z["scale"], z["edges"], float(z["w0"]),
                   z["w"].astype(np.float64), z["v"].astype(np.float64))

    @classmethod
    def fit(cls, texts: list[bytes], labels: np.ndarray, rate=0.1, decay=2e-5, batch=32) -> FactorisationMachine:
        """AdaGrad on the logistic loss; the order and start values are seeded."""
        docs = [statistics_and_words(t) for t in texts]
        stats = np.array([s for s, _ in docs])
        qs = np.quantile(stats, np.linspace(0, 1, BINS + 2)[1:-1], axis=0).T
        rng = np.random.default_rng(7)
        size = cls.size()
        fm = cls(stats.mean(0), stats.std(0) + 1e-6, qs, 0.0, np.zeros(size),
                 rng.normal(0, 0.02, (size, FACTORS)))
        rows = [fm.vector(s, b) for s, b in docs]
        y = labels.astype(float)
        share = np.clip(y.mean(), 0.01, 0.99)
        fm.w0 = float(np.log(share / (1 - share)))
        g0, gw, gv = 1.0, np.full(size, 1e-2), np.full((size, FACTORS), 1e-2)
        for _ in range(max(1, UPDATES // -(-len(rows) // batch))):
            order = rng.permutation(len(rows))
            for lo in range(0, len(order), batch):
                some = order[lo:lo + batch]
                lens = np.array([len(rows[i][0]) for i in some])
                at = np.concatenate([rows[i][0] for i in some])
                x = np.concatenate([rows[i][1] for i in some])
                first = np.cumsum(lens) - lens
                vx = fm.v[at] * x[:, None]
                s = np.add.reduceat(vx, first)
                out = (fm.w0 + np.add.reduceat(fm.w[at] * x, first)
                       + 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), first)))
                err = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[some]) / len(some)
                e = np.repeat(err, lens)
                # one gradient per feature that occurs in the batch
                used, where = np.unique(at, return_inverse=True)
                dw = np.bincount(where, e * x, len(used)) + decay * fm.w[used]
                d = (e * x)[:, None] * (np.repeat(s, lens, axis=0) - vx)
                dv = np.stack([np.bincount(where, d[:, f], len(used)) for f in range(FACTORS)], 1)
                dv += decay * fm.v[used]
                gw[used] += dw * dw
                gv[used] += dv * dv
                g0 += err.sum() ** 2
                fm.w[used] -= rate * dw / np.sqrt(gw[used])
                fm.v[used] -= rate * dv / np.sqrt(gv[used])
                fm.w0 -= rate * err.sum() / np.sqrt(g0)
        return fm


def held_out():
    """Rows of the fold no label of which is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> bytes | None:
    """The machine fitted on ``sample_rows`` labelled rows at most, none of the
    held-out fold; None without labelled rows. The sample is fitted in one
    task; its size is the bound on what that task holds."""
    chosen = (labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
              .groupBy(F.col("doc_id").cast("long").alias("label_id"))
              .agg(F.max("quality").cast("int").alias("quality"))
              .orderBy(F.xxhash64("label_id"), "label_id").limit(sample_rows))
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
            .dropDuplicates(["doc_id"]).select("doc_id", "text", "quality"))

    def fit(t: pa.Table) -> pa.Table:
        t = t.sort_by("doc_id")
        fm = FactorisationMachine.fit(utf8_of(t.column("text").combine_chunks()),
                                      np.array(t.column("quality").to_pylist()))
        return pa.table({"model": pa.array([fm.to_bytes()], pa.binary())})

    found = rows.groupBy(F.lit(0).alias("all")).applyInArrow(fit, "model binary").collect()
    return bytes(found[0]["model"]) if found else None


def quality_scores(docs: DataFrame, model: bytes | None, keep_text: bool = True) -> DataFrame:
    """``docs`` (with or without its text) plus score and predicted; Arrow
    batches go through the machine."""
    own = {"score", "predicted", *([] if keep_text else ["text"])}
    kept = [f for f in docs.schema.fields if f.name not in own]
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    text_at = docs.columns.index("text")
    places = [docs.columns.index(f.name) for f in kept]
    names = [f.name for f in kept]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        fm = FactorisationMachine.from_bytes(sent.value) if sent.value else None
        for b in batches:
            scores = [fm.score(*statistics_and_words(t)) if fm else 0.5 for t in utf8_of(b.column(text_at))]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in places), pa.array(scores, pa.float64()),
                 pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())],
                [*names, "score", "predicted"])

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return quality_scores(slim, fit_quality(docs, labels), keep_text=False)
