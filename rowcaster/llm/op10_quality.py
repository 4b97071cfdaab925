"""Quality classifier: random-indexing vectors pooled per document, and a two-layer network.

Texts are cut into units: lower-case runs of letters, digits or other marks, and the shape of
each word. Every unit has a sparse random index vector that follows from its hash. A unit's
context vector is the sum of the index vectors of the units around it, learned from the texts
of all documents into a table of ``TABLE`` hashed rows. A document is the mean of
the index and of the context vectors of all its units, with their lengths; a network of two
layers (numpy) maps it to a logit, which a temperature fitted on rows that the network did not
see turns into a probability.

The network and its temperature are learned from at most ``SAMPLE`` documents, taken by a hash of the id. Defined
results: empty and null texts have the zero vector and are scored like any other. Without
labels of both kinds every score is 0.5. Null labels are not learned from. Rows with one
``doc_id`` are scored one by one; a null ``doc_id`` is scored but cannot be labelled. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .frames import bounded

SAMPLE = 12_000  # labelled documents that are learned from
TABLE, DIM, ONES, AROUND = 1 << 14, 32, 3, 2
WIDTH = 2 * DIM + 4

KINDS = np.full(256, 3, np.uint8)  # other marks
KINDS[T.SPACE] = 0
KINDS[[*range(0x30, 0x3A)]] = 2
KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def units(b: T.Batch) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each unit in order, and the number of the first unit of each text."""
    if not len(b.data):
        return np.zeros(0, np.uint64), np.zeros(len(b) + 1, np.int64)
    kind = KINDS[b.data]
    cut = np.zeros(len(kind) + 1, bool)
    cut[b.offsets] = True
    cut[1:-1] |= kind[1:] != kind[:-1]
    cut[-1] = True
    edges = np.flatnonzero(cut)
    start, end = edges[:-1], edges[1:]
    solid = kind[start] != 0
    start, end = start[solid], end[solid]
    h = T.span_hash(T.LOWER[b.data], start, end, seed=10)
    w = T.words(b)
    upper = (b.data >= 65) & (b.data < 91)
    ups = T.per_text(upper, np.append(w.start, len(b.data))) if len(w.start) else np.zeros(0, np.int64)
    size = w.end - w.start
    shape = np.minimum(ups, 3) * 16 + np.minimum(size // 4, 7) * 2 + (ups == size)
    shapes = T.mix(shape.astype(np.uint64) + np.uint64(1 << 40))
    at = np.concatenate([start, w.start])
    order = np.argsort(at, kind="stable")
    return np.concatenate([h, shapes])[order], np.searchsorted(at[order], b.offsets)


def index_vectors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the entries of the index vector of each unit."""
    place = np.stack([(h >> np.uint64(8 * j)) & np.uint64(DIM - 1) for j in range(ONES)], axis=1).astype(np.int64)
    sign = np.stack([(h >> np.uint64(40 + j)) & np.uint64(1) for j in range(ONES)], axis=1).astype(np.float32) * 2 - 1
    return place, sign


def learn_contexts(documents: DataFrame) -> np.ndarray:
    """The context table: sums over the documents, one partial table per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(TABLE * DIM)
        for batch in batches:
            for piece in T.slices(batch, "text", 1 << 20):
                h, first = units(T.batch_of(piece.column("text")))
                row = (h % np.uint64(TABLE)).astype(np.int64) * DIM
                place, sign = index_vectors(h)
                doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
                for step in range(1, AROUND + 1):
                    same = np.flatnonzero(doc[step:] == doc[:-step])
                    for a, c in ((same, same + step), (same + step, same)):
                        cell = (row[a][:, None] + place[c]).ravel()
                        table += np.bincount(cell, weights=sign[c].ravel(), minlength=len(table))
        table = table.reshape(TABLE, DIM)
        seen = np.flatnonzero(np.abs(table).sum(axis=1))
        values = pa.FixedSizeListArray.from_arrays(pa.array(table[seen].ravel()), DIM).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), values], ["unit", "v"])

    parts = bounded(documents.select("text")).mapInArrow(run, "unit int, v array<double>")
    sums = parts.groupBy("unit").agg(*[F.sum(F.get("v", F.lit(i))).alias(f"v{i}") for i in range(DIM)])
    out = np.zeros((TABLE, DIM), np.float32)
    for r in sums.collect():  # at most TABLE rows
        out[r["unit"]] = r[1:]
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.maximum(norm, 1e-9)


def pooled(texts: pa.Array, contexts: np.ndarray) -> np.ndarray:
    """A vector for each text: directions and logarithmic lengths of its two means."""
    b = T.batch_of(texts)
    h, first = units(b)
    n = np.diff(first)
    out = np.zeros((len(b), WIDTH), np.float32)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    doc = np.repeat(np.arange(len(b)) * DIM, n)
    place, sign = index_vectors(h)
    own = sum(np.bincount(doc + place[:, j], weights=sign[:, j], minlength=len(b) * DIM) for j in range(ONES))
    row = (h % np.uint64(TABLE)).astype(np.int64)
    around = np.zeros((len(full), DIM), np.float32)
    for begin in range(0, len(full), 32):  # some texts at a time, as units are spread out here
        some = full[begin : begin + 32]
        lo, hi = first[some[0]], first[some[-1] + 1]
        around[begin : begin + 32] = np.add.reduceat(contexts[row[lo:hi]], first[some] - lo, axis=0)
    for part, v in enumerate((own.reshape(len(b), DIM)[full], around)):
        mean = v / n[full][:, None]
        length = np.linalg.norm(mean, axis=1)
        out[full, part * DIM : (part + 1) * DIM] = mean / np.maximum(length, 1e-6)[:, None] * 4
        out[full, 2 * DIM + part] = np.log(length + 1e-3)
    # units equal to the one two before them: words in a row that repeat
    twice = np.zeros(len(h), np.int64)
    twice[2:] = (h[2:] == h[:-2]) & (doc[2:] == doc[:-2])
    out[full, 2 * DIM + 2] = (T.per_text(twice, first)[full] / n[full]) * 4
    out[full, 2 * DIM + 3] = np.log1p(n[full]) / 4
    return out


@dataclass
class Network:
    """A hidden layer of rectified units, one output, and a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.maximum(z @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 48, epochs: int = 30, seed: int = 1) -> Network:
    """Adam on the cross-entropy of four fifths of the rows; the rest fits the temperature."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    rest, fit = order[: len(x) // 5], order[len(x) // 5 :]
    mean, scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-3
    z, t = ((x - mean) / scale).astype(np.float64), y.astype(np.float64)
    w = [rng.normal(0, (2 / z.shape[1]) ** 0.5, (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, hidden), np.zeros(1)]
    first, second, step = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w], 0
    for epoch in range(epochs):
        rate = 2e-3 * (1 - epoch / epochs) + 1e-4
        for at in np.array_split(rng.permutation(fit), max(1, len(fit) // 128)):
            a = z[at]
            hid = np.maximum(a @ w[0] + w[1], 0)
            err = (1 / (1 + np.exp(-np.clip(hid @ w[2] + w[3][0], -40, 40))) - t[at]) / len(at)
            back = np.outer(err, w[2]) * (hid > 0)
            grads = [a.T @ back + 1e-4 * w[0], back.sum(axis=0), hid.T @ err + 1e-4 * w[2], np.array([err.sum()])]
            step += 1
            for v, g, m, s in zip(w, grads, first, second):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, w[0], w[1], w[2], float(w[3][0]))
    raw, best = net.logit(x[rest]), np.inf
    for temperature in np.geomspace(0.25, 8, 41) if len(rest) else ():
        loss = np.logaddexp(0, -raw / temperature * (2 * t[rest] - 1)).mean()
        if loss < best:
            best, net.temperature = loss, float(temperature)
    return net


def with_vectors(documents: DataFrame, contexts: np.ndarray) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(contexts)  # TABLE x DIM numbers, 4 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in T.slices(batch, "text", 1 << 20):
                v = pooled(piece.column("text"), shared.value)
                cells = pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), WIDTH).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([piece.column("quality"), cells], ["quality", "v"])

    return bounded(documents.select("quality", "text")).mapInArrow(run, "quality int, v array<float>")


def quality_scores(documents: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    spark = documents.sparkSession
    usable = labels.where(F.col("quality").isin(0, 1) & ~held_out()).select("doc_id", "quality")
    n = usable.count()
    rank = F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1 << 30)) / float(1 << 30)
    chosen = usable.where(rank < min(1.0, size / max(n, 1))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # at most about ``size`` short rows
    sample = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("quality").cast("int").alias("quality"), "text")
    # an id may have any number of rows
    sample = sample.orderBy(F.xxhash64("doc_id", "text", F.lit(11)), "doc_id", "text").limit(2 * size).repartition(16)
    contexts = learn_contexts(documents)
    rows = with_vectors(sample, contexts).collect()  # at most 2 * ``size`` rows of WIDTH numbers
    x = np.array([r["v"] for r in rows], np.float32).reshape(len(rows), WIDTH)
    y = np.array([r["quality"] for r in rows])
    order = np.lexsort(np.column_stack([x, y]).T)  # reruns agree whatever order rows come in
    net = train(x[order], y[order]) if len(set(y.tolist())) == 2 else None
    shared = spark.sparkContext.broadcast(contexts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in T.slices(batch, "text", 1 << 20):
                score = net.score(pooled(piece.column("text"), shared.value)) if net else np.full(piece.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("held_out"), pa.array(score.astype(np.float64))], ["doc_id", "held_out", "score"])

    scored = bounded(documents.select("doc_id", held_out().alias("held_out"), "text")).mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
