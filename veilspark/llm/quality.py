"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

A document is two blocks of hashed counts: its words (A-Z lower-cased) in ``WORDS`` features, and in ``dims`` features the
words' shapes (``Aa.``, ``a%``, ``A!``: classes of bytes, runs collapsed), pairs of neighbouring shapes and whether a word
repeats the one before. Counts are damped by log, each block is scaled to a length of its own (``SHARE`` for words),
weighted by inverse document frequency and projected on the leading singular vectors of the sample. The vectors of the
sample are broadcast (``2 * bound`` rows of ``rank`` floats, a proven bound, and the projection); each executor computes
the exact cosine of every document with all of them in blocks, and the ``k`` nearest vote with weights that grow with the
cosine.

The sample has one row an id (the least text; the larger label), so ``bound`` holds whatever repeats. Defined results: null
and empty texts have the zero vector and score the share of label 1 among all labels outside the held-out fold; with no
labels at all every score is 0.5. Repeated rows get equal scores; long texts are counted whole; extra columns stay. Of
neighbours at equal cosine, those earlier in the sample, which is ordered by id, vote.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import textops as X

MOD, REM, THRESHOLD = 4, 2, 0.7
WORDS, SHARE = 2048, 0.25
U = np.uint64


def counts(slab: X.Slab, dims: int) -> np.ndarray:
    """float32 (documents, dims + WORDS): hashed counts of the slab's documents, shapes before words."""
    starts, ends, doc = slab.words(lower=False)
    wide = dims + WORDS
    if not len(starts):
        return np.zeros((slab.n, wide), np.float32)
    word = X.range_hash(X.LOWER[slab.data], starts, ends)
    shape = X.SHAPE[slab.data]
    keep = np.ones(len(shape), bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[starts] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    form = X.range_hash(shape[keep], at[starts], at[ends])
    follows = np.zeros(len(doc), bool)
    follows[1:] = doc[1:] == doc[:-1]
    same = follows & (word == np.roll(word, 1))
    with np.errstate(over="ignore"):
        pair = X.mix(form * U(3) + np.roll(form, 1) * U(5) + same.astype(U))
    feats = np.concatenate([form % U(dims), pair[follows] % U(dims), np.full(int(same.sum()), 0, U), U(dims) + word % U(WORDS)]).astype(np.int64)
    docs = np.concatenate([doc, doc[follows], doc[same], doc])
    return np.bincount(docs * wide + feats, minlength=slab.n * wide).reshape(slab.n, wide).astype(np.float32)


def damped(c: np.ndarray) -> np.ndarray:
    """Logs of counts, each block scaled to its length."""
    z = np.log1p(c)
    for block, length in ((z[:, :-WORDS], 1.0), (z[:, -WORDS:], SHARE)):
        block *= length / np.maximum(np.sqrt(np.einsum("ij,ij->i", block, block)), 1e-9)[:, None]
    return z


def _sample_features(dims: int):
    def run(batches):
        for b in batches:
            for s in X.slabs(b.column("text")):
                for lo in range(s.n):
                    one = X.Slab(0, s.data[s.offsets[lo] : s.offsets[lo + 1]], np.array([0, s.offsets[lo + 1] - s.offsets[lo]]))
                    row = counts(one, dims)[0]
                    at = np.flatnonzero(row)
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(s.first + lo, 1), b.column("y").slice(s.first + lo, 1), pa.array([at.astype(np.int32)], pa.list_(pa.int32())), pa.array([row[at]], pa.list_(pa.float32()))], names=["doc_id", "y", "i", "v"])

    return run


class Model:
    """idf * projection, reference vectors and their labels."""

    def __init__(self, proj, refs, y, prior, k, sharp):
        self.proj, self.refs, self.y, self.prior, self.k, self.sharp = proj, refs, y, prior, k, sharp

    def scores(self, c: np.ndarray) -> np.ndarray:
        if not len(self.y):
            return np.full(len(c), self.prior)
        z = damped(c) @ self.proj
        norm = np.linalg.norm(z, axis=1, keepdims=True)
        cos = (z / np.maximum(norm, 1e-9)) @ self.refs.T
        k = min(self.k, len(self.y))
        least = np.partition(cos, len(self.y) - k, axis=1)[:, len(self.y) - k, None]
        near = cos > least
        # of those at the k-th cosine, the first fill up
        tied = cos == least
        near |= tied & (np.cumsum(tied, 1) <= k - near.sum(1, keepdims=True))
        row, at = np.nonzero(near)
        w = np.exp(self.sharp * (cos[row, at].astype(np.float64) - 1.0))
        out = np.bincount(row, w * self.y[at], len(c)) / np.maximum(np.bincount(row, w, len(c)), 1e-300)
        return np.where(norm[:, 0] < 1e-9, self.prior, np.clip(out, 0, 1))


def fit(docs: DataFrame, labels: DataFrame, bound: int = 2000, dims: int = 2048, rank: int = 64, k: int = 15, sharp: float = 8.0, seed: int = 7) -> Model:
    """At most ``bound`` documents a class outside the held-out fold; only their hashed counts come to the driver."""
    C.give_back(docs.sparkSession)
    drawn = C.labelled(docs, labels, "quality", MOD, REM, bound).select(F.col("doc_id").cast("long").alias("doc_id"), "y", "text")
    rows = drawn.mapInArrow(_sample_features(dims), "doc_id long, y int, i array<int>, v array<float>").toArrow().sort_by("doc_id")
    C.give_back(docs.sparkSession)
    y = np.asarray(rows.column("y").to_pylist(), np.float64)
    if not len(y):
        return Model(None, None, y, 0.5, k, sharp)
    at, value = (rows.column(x).combine_chunks() for x in ("i", "v"))
    cut, at, value = at.offsets.to_numpy(), at.values.to_numpy(), value.values.to_numpy()
    z = np.zeros((len(y), dims + WORDS), np.float32)
    for n in range(len(y)):
        z[n, at[cut[n] : cut[n + 1]]] = value[cut[n] : cut[n + 1]]
    held = np.bincount(at[cut[0] : cut[-1]], minlength=z.shape[1])
    del rows, at, value
    for lo in range(0, len(y), 256):
        z[lo : lo + 256] = damped(z[lo : lo + 256])
    share = labels.where(F.col("quality").isin(0, 1) & ~C.held_out(MOD, REM)).agg(F.avg("quality")).first()[0]
    idf = (np.log((1 + len(y)) / (1 + held)) + 0.3).astype(np.float32)
    z *= idf
    rng = np.random.default_rng(seed)
    r = min(rank, *z.shape)
    q = np.linalg.qr(z @ rng.standard_normal((z.shape[1], min(r + 16, min(z.shape)))).astype(np.float32))[0]
    for _ in range(3):
        q = np.linalg.qr(z @ (z.T @ q))[0]
    basis = np.linalg.svd(q.T @ z, full_matrices=False)[2][:r].T
    refs = z @ basis
    del z
    X.release()
    norm = np.linalg.norm(refs, axis=1)
    good = norm > 1e-9
    return Model((idf[:, None] * basis).astype(np.float32), (refs[good] / norm[good, None]).astype(np.float32), y[good], float(share if share is not None else y.mean()), k, sharp)


def score(docs: DataFrame, model: Model, out: str = "score", dims: int = 2048) -> DataFrame:
    """``docs`` with its columns and ``out``; one narrow pass, no shuffle."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches):
        m = shared.value
        for b in batches:
            found = [np.zeros(0)]
            for s in X.slabs(b.column(place), 1 << 19):
                for lo in range(0, s.n, 256):
                    hi = min(s.n, lo + 256)
                    part = X.Slab(0, s.data[s.offsets[lo] : s.offsets[hi]], s.offsets[lo : hi + 1] - s.offsets[lo])
                    found.append(m.scores(counts(part, dims)))
            yield X.append(b, **{out: pa.array(np.concatenate(found), pa.float64())})
        X.release()

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(out, DoubleType())]))


def op1_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    model = fit(docs, C.table(spark, sf_dir, "labels"))
    got = score(docs.select("doc_id", F.col("text").cast("string").alias("text")), model)
    return got.select("doc_id", C.held_out(MOD, REM).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
