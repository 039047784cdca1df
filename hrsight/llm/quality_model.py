"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

Word vectors. Every token falls in one of `BUCKETS` hash buckets; a bucket has a
fixed sparse random index vector (two entries of +-1 among `DIMS`). A bucket's
vector is the sum of the index vectors of the two tokens on either side of all
its occurrences in all documents. The sums are whole numbers, so the order of
tasks and a retried task change nothing; a task hands on at most one matrix of
`BUCKETS x (DIMS + 1)` counts in blocks, and blocks are summed by streaming.

Pooling. Rows are scaled to length one and weighted by a / (a + frequency); a
document is their mean and spread, and the mean agreement of neighbours.

Network. Two layers in numpy (tanh, then one logistic unit), trained by Adam on
at most `sample` labelled rows (those with the smallest id hash). A part of them
is set aside to fit the temperature by which the logits are divided.

Defined results: a null or empty text is the zero vector, and has a score as
others have; without labels of both kinds every score is the share of label 1
(0.5 without any); rows with a null id are scored and never learned from;
several labels of one id count as the lowest; other columns are no inputs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hrsight.llm.tasks import _arrow_schema, map_arrow, pieces, saved, ship
from hrsight.llm.textnp import U64, mix64, tokens_of

BUCKETS, DIMS, NONZERO, REACH, BLOCKS = 1 << 14, 32, 2, 2, 64
INPUTS = 2 * DIMS + 1


def index_vectors():
    """(positions, signs) of each bucket's non-zero entries."""
    h = mix64(np.arange(BUCKETS * NONZERO, dtype=U64) + U64(0x51ED270B)).reshape(BUCKETS, NONZERO)
    return (h % U64(DIMS)).astype(np.int64), np.where(h >> U64(63), 1.0, -1.0)


def buckets_of(texts):
    h, first = tokens_of(texts)
    return (h % U64(BUCKETS)).astype(np.int64), first


def context_counts(texts, where, signs, total):
    """Add the texts' (bucket, dimension) sums and bucket counts to `total`."""
    b, first = buckets_of(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    at, weight = [b * (DIMS + 1) + DIMS], [np.ones(len(b))]
    for gap in range(1, REACH + 1):
        same = owner[gap:] == owner[:-gap]
        x, y = b[gap:][same], b[:-gap][same]
        for me, other in ((x, y), (y, x)):
            for k in range(NONZERO):
                at.append(me * (DIMS + 1) + where[other, k])
                weight.append(signs[other, k])
    total += np.bincount(np.concatenate(at), weights=np.concatenate(weight), minlength=len(total)).astype(np.int64)


def corpus_counts(texts: DataFrame) -> np.ndarray:
    """The BUCKETS x (DIMS + 1) sums over all texts; the last column counts occurrences."""
    schema = pa.schema([("block", pa.int32()), ("sums", pa.binary())])

    def count(batches):
        where, signs = index_vectors()
        total = np.zeros(BUCKETS * (DIMS + 1), dtype=np.int64)
        for batch in batches:
            for _, part in pieces(batch, "text"):
                context_counts(part, where, signs, total)
        rows = [(i, x) for i, x in enumerate(np.split(total, BLOCKS)) if x.any()]
        small = total.size == 0 or np.abs(total).max() < 1 << 31
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array(
            [x.astype("<i4" if small else "<i8").tobytes() for _, x in rows], pa.binary())], schema=schema)

    def add(batches):
        size, total = BUCKETS * (DIMS + 1) // BLOCKS, {}
        for batch in batches:
            for i, raw in zip(*(c.to_pylist() for c in batch.columns)):
                x = np.frombuffer(raw, dtype="<i4" if len(raw) == 4 * size else "<i8")
                total[i] = total.get(i, 0) + x.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(
            [x.astype("<i8").tobytes() for x in total.values()], pa.binary())], schema=schema)

    ship(texts.sparkSession)
    ddl = "block int, sums binary"
    rows = texts.mapInArrow(count, ddl).repartition("block").mapInArrow(add, ddl).collect()  # BLOCKS rows at most
    out = np.zeros((BLOCKS, BUCKETS * (DIMS + 1) // BLOCKS), dtype=np.int64)
    for r in rows:
        out[r.block] = np.frombuffer(bytes(r.sums), dtype="<i8")
    return out.reshape(BUCKETS, DIMS + 1)


def word_vectors(counts: np.ndarray, smooth: float = 1e-3):
    """(unit vectors, weights) of the buckets."""
    v = counts[:, :DIMS].astype(np.float64)
    v /= np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-9)
    share = counts[:, DIMS] / max(1, counts[:, DIMS].sum())
    return v.astype(np.float32), (smooth / (smooth + share)).astype(np.float32)


def pooled(texts, vectors, weights):
    """len(texts) x INPUTS: weighted mean and spread of the tokens' vectors, agreement of neighbours."""
    b, first = buckets_of(texts)
    n = np.diff(first)
    out = np.zeros((len(texts), INPUTS), dtype=np.float32)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    v, w = vectors[b], weights[b][:, None]
    cut = first[:-1][some]
    mass = np.add.reduceat(w, cut)
    mean = np.add.reduceat(v * w, cut) / mass
    square = np.add.reduceat(v * v * w, cut) / mass
    agree = np.append((v[1:] * v[:-1]).sum(axis=1), 0.0)
    agree[first[1:][some] - 1] = 0.0
    out[some, :DIMS] = mean
    out[some, DIMS:2 * DIMS] = np.sqrt(np.maximum(square - mean * mean, 0))
    out[some, 2 * DIMS] = np.add.reduceat(agree, cut) / np.maximum(1, n[some] - 1)
    return out


class Network:
    """x -> tanh(x W1 + b1) -> logit / temperature -> probability."""

    def __init__(self, mean, scale, w1, b1, w2, b2, temperature=1.0):
        self.mean, self.scale, self.w1, self.b1, self.w2, self.b2, self.temperature = mean, scale, w1, b1, w2, b2, temperature

    def logits(self, x):
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x):
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def fit(x, y, hidden=32, epochs=30, batch=256, rate=3e-3, decay=1e-4, seed=7) -> Network:
    """Train on rows 0, 1, 2, 3 of every five; fit the temperature on the fifth."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    rng = np.random.default_rng(seed)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 0.5
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(INPUTS), np.ones(INPUTS))
    p = [rng.normal(0, INPUTS ** -0.5, (INPUTS, hidden)), np.zeros(hidden), rng.normal(0, hidden ** -0.5, hidden),
         np.array(np.log(share / (1 - share)))]
    if len(y) < 20 or y.min() == y.max():
        p[2] = np.zeros(hidden)
        return Network(mean, scale, *p)
    held = np.arange(len(y)) % 5 == 4
    tx, ty = (x[~held] - mean) / scale, y[~held]
    m1, m2 = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(ty))
        for i in range(0, len(order), batch):
            rows = order[i:i + batch]
            a = np.tanh(tx[rows] @ p[0] + p[1])
            err = (1 / (1 + np.exp(-np.clip(a @ p[2] + p[3], -50, 50))) - ty[rows]) / len(rows)
            back = np.outer(err, p[2]) * (1 - a * a)
            grads = [tx[rows].T @ back + decay * p[0], back.sum(axis=0), a.T @ err + decay * p[2], err.sum()]
            step += 1
            for j, g in enumerate(grads):
                m1[j] = 0.9 * m1[j] + 0.1 * g
                m2[j] = 0.999 * m2[j] + 0.001 * g * g
                p[j] = p[j] - rate * (1 - epoch / epochs) * (m1[j] / (1 - 0.9 ** step)) / (np.sqrt(m2[j] / (1 - 0.999 ** step)) + 1e-8)
    net = Network(mean, scale, *p)
    z, t = net.logits(x[held]), y[held]
    if len(t) and t.min() != t.max():
        loss = lambda k: np.logaddexp(0, np.where(t > 0, -1, 1) * z / np.exp(k)).mean()
        lo, hi = np.log(0.25), np.log(8.0)
        for _ in range(40):  # the loss has one valley in log temperature
            a, b = lo + 0.382 * (hi - lo), lo + 0.618 * (hi - lo)
            lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
        net.temperature = float(np.exp((lo + hi) / 2))
    return net


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          folds: int = 5, sample: int = 50_000, cut: float = 0.3) -> DataFrame:
    """Per input row: id, held_out, score, predicted. Rows whose crc32(id as text) mod `folds` is 0 are never learned from."""
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    spark = docs.sparkSession
    vectors = spark.sparkContext.broadcast(word_vectors(corpus_counts(src.select("text"))))

    def pool(batch, texts):
        x = pooled(texts, *vectors.value)
        yield {"id": batch.column(0), "x": [r.tobytes() for r in x]}

    id_type = src.schema["id"].dataType.simpleString()
    rows = saved(map_arrow(src, "text", pool, f"id {id_type}, x binary"), "pooled")
    fold = F.crc32(F.col("id").cast("string")) % folds
    truth = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("y")) \
        .where("id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg(F.min("y").alias("y"))
    learned = (rows.join(truth, "id").where(fold != 0).select("id", "y", "x", F.xxhash64("id", "x").alias("o"))
               .orderBy("o", "id", "x").limit(sample).collect())
    x = np.array([np.frombuffer(bytes(r.x), dtype="<f4") for r in learned]).reshape(-1, INPUTS)
    net = fit(x, np.array([float(r.y) for r in learned]))
    shared = spark.sparkContext.broadcast(net)
    schema = _arrow_schema(spark, f"id {id_type}, score double")

    def apply(batches):
        for batch in batches:
            got = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<f4").reshape(-1, INPUTS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(got.astype(np.float64)))], schema=schema)

    out = rows.mapInArrow(apply, f"id {id_type}, score double")
    return out.select(F.col("id").alias(id_col), F.coalesce(F.crc32(F.col("id").cast("string")) % folds == 0, F.lit(False)).alias("held_out"),
                      "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def op5(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
