"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

A text is a vector of log-scaled counts of hashed byte pairs and triples, weighted by
inverse document frequency; frequencies and the mean are those of all documents (sums of
4,096 cells a partition). A truncated SVD of at most `fit_rows` labelled rows (the
smallest by a hash of the id, spread evenly over both labels) gives the latent
space. It is fitted in one task, whose input is bounded by fit_rows; the sample's unit
vectors and labels are broadcast, so their size is fixed by fit_rows and rank whatever the
input. Every document, labelled or not, is projected
and compared with all of them in one exact product a block; the `neighbours` most
similar vote for their label with the similarity's power `sharpness` as weight. Neighbours
that tie for the last places share them evenly, so scores don't depend on any order.

Only the text enters a score. Null and empty texts are the zero vector, which meets
every neighbour alike: their score is the share of label 1 in the sample. Without
any labelled row every score is 0.5. Repeated rows score alike; in the sample a repeated
id counts once. Empty tables give an empty result, very long texts are read whole, other columns
of docs come back unchanged but for one named score, which is replaced.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches
from .hashing import chunks, release

FEATURES = 4096
DAMP = 300.0  # bytes added to each length, so that the few pairs of a short text don't loom
_U32 = np.uint32


def _hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of each byte pair and triple inside a text."""
    if len(data) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = data.astype(_U32)
    row = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    pair = x[:-1] << _U32(8) | x[1:]
    triple = pair[:-1] << _U32(8) | x[2:]
    slot = lambda v, salt: ((v * _U32(0x9E3779B1) + _U32(salt)) >> _U32(21)).astype(np.int32)  # noqa: E731  11 bits
    in2, in3 = row[:-1] == row[1:], row[:-2] == row[2:]
    return np.concatenate([row[:-1][in2], row[:-2][in3]]), np.concatenate([slot(pair, 1)[in2], slot(triple, 7)[in3] + FEATURES // 2])


def features(batch: pa.RecordBatch) -> np.ndarray:
    """Log-scaled counts relative to the length, one row a text."""
    parts = [np.zeros((0, FEATURES), np.float32)]
    for i, j, data, bounds in chunks(batch):
        row, slot = _hashes(data, bounds)
        counts = np.bincount(row.astype(np.int64) * FEATURES + slot, minlength=(j - i) * FEATURES).reshape(j - i, FEATURES)
        n = np.diff(bounds)[:, None] + DAMP
        parts.append(np.log1p(counts * (1000.0 / n)).astype(np.float32))
    return np.concatenate(parts)


def _axes(z: np.ndarray, rank: int) -> np.ndarray:
    """Leading right singular vectors, by a randomised range finder with power iterations: little memory, fixed seed."""
    rank = min(rank, *z.shape) if len(z) else 0
    if not rank:
        return np.zeros((FEATURES, 1), np.float32)
    y = z @ np.random.default_rng(5).standard_normal((z.shape[1], min(rank + 32, *z.shape)), np.float32)
    for _ in range(4):
        y = z @ (z.T @ np.linalg.qr(y)[0])
    _, _, v = np.linalg.svd(np.linalg.qr(y)[0].T @ z, full_matrices=False)
    return np.ascontiguousarray(v[:rank].T)


class Model:
    """Latent space and labelled sample. idf and mean: of all documents."""

    def __init__(self, x: np.ndarray, y: np.ndarray, idf: np.ndarray, mean: np.ndarray, rank: int, neighbours: int, sharpness: float):
        self.y, self.neighbours, self.sharpness = y.astype(np.float32), neighbours, sharpness
        self.prior = float(y.mean()) if len(y) else 0.5
        # votes of a label that is rarer in the sample count for more
        self.weight = np.where(y == 1, 0.5 / max(self.prior, 1e-9), 0.5 / max(1 - self.prior, 1e-9))
        self.idf, self.mean = idf.astype(np.float32), mean.astype(np.float32)
        z = x * self.idf
        z -= self.mean
        self.axes = _axes(z, rank)
        del z
        self.known = self._latent(x)

    def _latent(self, x: np.ndarray) -> np.ndarray:
        z = x * self.idf
        z -= self.mean
        z = z @ self.axes
        norm = np.linalg.norm(z, axis=1, keepdims=True)
        return np.where(norm > 0, z / np.maximum(norm, 1e-12), 0).astype(np.float32)

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        k = min(self.neighbours, len(self.y))
        some = (x.sum(axis=1) > 0) & (k > 0)
        z = self._latent(x[some])
        got = np.zeros(len(z))
        votes = np.stack([self.weight * self.y, self.weight], axis=1)
        power = lambda s: np.maximum(s, 1e-6).astype(np.float64) ** self.sharpness
        for at in range(0, len(z), 512):
            sim = z[at : at + 512] @ self.known.T
            best = np.argpartition(-sim, k - 1, axis=1)[:, :k]
            near = np.take_along_axis(sim, best, axis=1)
            last = near.min(axis=1, keepdims=True)
            above = near > last
            total = ((power(near) * above)[:, :, None] * votes[best]).sum(axis=1)
            tie = sim == last
            share = (k - above.sum(axis=1)) / tie.sum(axis=1)
            total += (power(last[:, 0]) * share)[:, None] * (tie @ votes)
            got[at : at + 512] = total[:, 0] / total[:, 1]
        out[some] = got
        return out


def corpus_weights(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Inverse document frequency of each feature and mean weighted vector, over all documents."""

    def run(batches):
        n, df, total = 0, np.zeros(FEATURES, np.int64), np.zeros(FEATURES)
        for b in batches:
            for i in range(0, len(b), 256):
                x = features(b.slice(i, 256))
                n += len(x)
                df += (x > 0).sum(axis=0)
                total += x.sum(axis=0, dtype=np.float64)
        slot = np.arange(FEATURES + 1, dtype=np.int32)
        yield pa.record_batch([pa.array(slot), pa.array(np.append(df, n)), pa.array(np.append(total, 0.0))], ["slot", "df", "total"])

    sums = docs.select("text").mapInArrow(run, "slot int, df long, total double").groupBy("slot")
    got = sums.agg(F.sum("df").alias("df"), F.sum(F.col("total").cast("decimal(38,9)")).cast("double").alias("total")).toArrow().sort_by("slot")
    df, total = (got[c].to_numpy().astype(np.float64) for c in ("df", "total"))  # FEATURES + 1 rows, or none
    n = df[-1] if len(df) else 0.0
    df, total = (df[:-1], total[:-1]) if len(df) else (np.zeros(FEATURES), np.zeros(FEATURES))
    idf = np.log((1.0 + n) / (1.0 + df)) + 1
    return idf, total * idf / max(n, 1.0)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 4000, rank: int = 96, neighbours: int = 15, sharpness: float = 4.0) -> Model:
    """Model of docs(doc_id, text) and labels(doc_id, quality); other labels than 0 and 1 are left out.

    The sample is drawn from the labels alone: at most fit_rows ids, which are then
    broadcast to the documents, so no text is shuffled.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    idf, mean = corpus_weights(docs)
    known = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    known = known.withColumn("h", F.xxhash64("doc_id"))
    # half the rows from either label, so that a rare label has neighbours too
    parts = [known.where(f"quality = {q}").orderBy("h", "doc_id").limit(fit_rows // 2) for q in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]).select("doc_id", "h", "quality"))
    rows = docs.join(chosen, "doc_id").select("h", "quality", "text")

    def vectors(batches):
        for b in batches:
            x = features(b).astype(np.float16)
            yield pa.record_batch([b.column(0), b.column(1), pa.array([v.tobytes() for v in x], pa.binary())], ["h", "quality", "x"])

    def model(batches):
        got = [(np.frombuffer(v, np.float16), q) for b in batches for v, q in zip(b.column(2).to_pylist(), b.column(1).to_pylist())]
        x = np.array([v for v, _ in got], np.float32).reshape(len(got), FEATURES)
        made = Model(x, np.array([q for _, q in got], np.int32), idf, mean, rank, neighbours, sharpness)
        yield pa.record_batch([pa.array([pickle.dumps(made)], pa.binary())], ["model"])
        release()

    sample = rows.mapInArrow(vectors, "h long, quality int, x binary").groupBy("h", "quality").agg(F.min("x").alias("x"))
    one = sample.repartition(1).sortWithinPartitions("h", "quality").mapInArrow(model, "model binary").toArrow()
    return pickle.loads(one["model"][0].as_py())


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a column score; other columns come back unchanged."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    docs = docs.drop("score") if "score" in docs.columns else docs

    def run(batches):
        m = shared.value
        for b in batches:
            s = np.concatenate([np.zeros(0), *[m.score(features(b.slice(i, 256))) for i in range(0, len(b), 256)]])
            yield pa.record_batch([*b.columns, pa.array(s, pa.float64())], [*b.schema.names, "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
