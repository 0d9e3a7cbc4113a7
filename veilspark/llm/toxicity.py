"""Toxicity: a factorization machine over hashed terms.

Terms are a document's distinct words (A-Z lower-cased, ASCII punctuation at either end dropped) and the first five
bytes of longer words, hashed to ``2**bits`` columns. The score is the logistic of

    w0 + sum_j w_j x_j + 1/2 sum_f [ (sum_j v_jf x_j)^2 - sum_j v_jf^2 x_j^2 ]

so a pair of terms (an insult and a group mentioned) weighs more or less than the two alone. Every term that the sample
has in ``least`` documents takes part, with an x_j of FLOOR at least and 1 at most: it counts the more the further its
shares in the classes differ, or those of documents that hold it together with another term, if the pair says clearly
more than either of the two.
The model is fitted on the driver by AdaGrad over a bounded sample of one row an id (the least text, the larger label);
both classes weigh the same in the loss, so 0.5 is where a text speaks as much for one as for the other. What is broadcast
is ``2**bits * (2 + factors)`` float32 values, whatever the input.

Defined results: null and empty texts, and texts without a term that takes part, score the share of label 1 among all
labels outside the held-out fold; without labels of both classes every score is that share (0.0 without any label).
Repeated rows get equal scores; long texts are scored whole; extra columns stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import common as C
from . import textops as X

MOD, REM, THRESHOLD = 5, 0, 0.5
#: x of a term that tells nothing by itself or in a pair.
FLOOR = 0.05
U = np.uint64
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def terms(slab: X.Slab, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, term) without repeats, by document."""
    inside = np.zeros(len(slab.data) + 2, bool)
    slab.data = X.LOWER[slab.data]
    inside[1:-1] = _WORD[slab.data]
    begin, end = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cut = slab.offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(slab.data))]
    cut = cut[inside[cut] & inside[cut + 1]]
    begin[cut] = True
    end[cut - 1] = True
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    doc = np.searchsorted(slab.offsets, starts, side="right") - 1
    if not len(starts):
        return doc, starts
    long = ends - starts > 5
    term = np.concatenate([X.range_hash(slab.data, starts, ends), X.mix(X.range_hash(slab.data, starts[long], starts[long] + 5) + U(1))]) & U((1 << bits) - 1)
    both = np.unique((np.concatenate([doc, doc[long]]).astype(U) << U(bits)) | term)
    return (both >> U(bits)).astype(np.int64), (both & U((1 << bits) - 1)).astype(np.int64)


class Model:
    def __init__(self, w0: float, w, v, x, share: float = 0.0):
        self.w0, self.w, self.v, self.x, self.share = w0, w, v, x, share

    def scores(self, n: int, doc: np.ndarray, term: np.ndarray) -> np.ndarray:
        if self.w is None:
            return np.full(n, self.share)
        z = np.full(n, self.w0, np.float64)
        live = self.x[term] > 0
        doc, term = doc[live], term[live]
        if len(doc):
            x = self.x[term]
            z += np.bincount(doc, self.w[term] * x, n)
            for f in range(self.v.shape[0]):
                a = self.v[f][term] * x
                z += 0.5 * (np.bincount(doc, a, n) ** 2 - np.bincount(doc, a * a, n))
        return np.where(np.bincount(doc, minlength=n) > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), self.share)


def _root_g(c1, c0, n1: float, n0: float):
    """Square root of the likelihood ratio of counts in the classes against equal shares."""
    n, c = n1 + n0, c1 + c0
    g = 0.0
    for a, e in ((c1, c * (n1 / n)), (c0, c * (n0 / n)), (n1 - c1, (n - c) * (n1 / n)), (n0 - c0, (n - c) * (n0 / n))):
        g = g + a * np.log(np.maximum(a, 1e-9) / np.maximum(e, 1e-9))
    return np.sqrt(np.maximum(2 * g, 0))


def paired(docs: list[np.ndarray], y: np.ndarray, size: int, least: int, strong: float = 8.0, more: float = 3.0, block: int = 256) -> np.ndarray:
    """Each term's largest root of G over the pairs that it is in and that exceed ``strong``, and both terms by ``more``.

    Terms too rare to reach ``strong`` in any pair are left out of the counts, which loses nothing.
    """
    n1 = float(y.sum())
    n0 = len(y) - n1
    few = np.arange(1.0, min(n1, n0) + 1)
    least = max(least, 1 + int((_root_g(few, 0 * few, min(n1, n0), max(n1, n0)) < strong).sum()))
    flat, row = np.concatenate(docs), np.repeat(np.arange(len(docs)), [len(t) for t in docs])
    ids = np.flatnonzero(np.bincount(flat, minlength=size) >= least)
    col = np.full(size, -1)
    col[ids] = np.arange(len(ids))
    row, flat = row[col[flat] >= 0], col[flat[col[flat] >= 0]]
    order = np.argsort(-y, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    m = np.zeros((len(docs), len(ids)), bool)
    m[place[row], flat] = True
    k = int(n1)
    one = _root_g(m[:k].sum(0).astype(float), m[k:].sum(0).astype(float), n1, n0)
    best = np.zeros(len(ids))
    for lo in range(0, len(ids), block):
        a = m[:, lo : lo + block].astype(np.float32)
        for at in range(lo, len(ids), block):
            b = m[:, at : at + block].astype(np.float32)
            c1, c0 = a[:k].T @ b[:k], a[k:].T @ b[k:]
            c = c1 + c0
            i, j = np.nonzero((c1 * n0 - c0 * n1) ** 2 * len(y) * 3 >= strong**2 * n1 * n0 * c * (len(y) - c) + 1)
            z = _root_g(c1[i, j].astype(float), c0[i, j].astype(float), n1, n0)
            i, j = i + lo, j + at
            ok = (z >= strong) & (z >= np.maximum(one[i], one[j]) + more)
            np.maximum.at(best, i[ok], z[ok])
            np.maximum.at(best, j[ok], z[ok])
    out = np.zeros(size)
    out[ids] = best
    return out


def train(docs: list[np.ndarray], y: np.ndarray, bits: int, factors: int, epochs: int, least: int, differ: float, rate: float, decay: float, seed: int, share: float = 0.0) -> Model:
    """docs: each document's distinct terms. Classes weigh the same in the loss; ``share`` is what a text without terms scores."""
    size = 1 << bits
    seen = np.bincount(np.concatenate(docs), minlength=size)
    toxic = np.bincount(np.concatenate([t for t, k in zip(docs, y) if k == 1]), minlength=size)
    n1 = float(y.sum())
    p1, p0 = toxic / n1, (seen - toxic) / (len(y) - n1)
    p = np.clip(seen / len(y), 1e-9, 1 - 1e-9)
    z = np.abs(p1 - p0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / (len(y) - n1)))
    strength = np.maximum(np.where(z >= differ, z, 0.0), paired(docs, y, size, least))
    x = np.where(seen >= least, np.clip(strength / 8, FLOOR, 1.0), 0.0).astype(np.float32)
    rng = np.random.default_rng(seed)
    w, v, w0 = np.zeros(size, np.float32), (rng.standard_normal((factors, size)) * 0.01).astype(np.float32), 0.0
    gw, gv, g0 = np.full(size, 1e-6, np.float32), np.full((factors, size), 1e-6, np.float32), 1e-6
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for lo in range(0, len(order), 32):
            pick = order[lo : lo + 32]
            t = np.concatenate([docs[i] for i in pick])
            d = np.repeat(np.arange(len(pick)), [len(docs[i]) for i in pick])
            t, d = t[x[t] > 0], d[x[t] > 0]
            xt = x[t]
            vt = v[:, t] * xt
            s = np.stack([np.bincount(d, r, len(pick)) for r in vt])
            sq = np.stack([np.bincount(d, r * r, len(pick)) for r in vt])
            z = w0 + np.bincount(d, w[t] * xt, len(pick)) + 0.5 * (s * s - sq).sum(0)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) * weight[pick] / len(pick)
            used, inv = np.unique(t, return_inverse=True)
            dw = np.bincount(inv, g[d] * xt, len(used)) + decay * w[used]
            gw[used] += dw * dw
            w[used] -= rate * dw / np.sqrt(gw[used])
            for f in range(factors):
                dv = np.bincount(inv, g[d] * xt * (s[f][d] - vt[f]), len(used)) + decay * v[f, used]
                gv[f, used] += dv * dv
                v[f, used] -= 0.2 * rate * dv / np.sqrt(gv[f, used])
            g0 += g.sum() ** 2
            w0 -= rate * g.sum() / np.sqrt(g0)
    return Model(float(w0), w, v, x, share)


def fit(docs: DataFrame, labels: DataFrame, bound: int = 2000, bits: int = 17, factors: int = 4, epochs: int = 6, least: int = 3, differ: float = 3.0, rate: float = 0.1, decay: float = 1e-4, seed: int = 11) -> Model:
    """At most ``bound`` documents a class outside the held-out fold; their hashed terms come to the driver."""
    def run(batches):
        for b in batches:
            for s in X.slabs(b.column("text")):
                doc, term = terms(s, bits)
                cut = np.searchsorted(doc, np.arange(s.n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(s.first, s.n), b.column("y").slice(s.first, s.n), pa.ListArray.from_arrays(pa.array(cut), pa.array(term.astype(np.int32)))], names=["doc_id", "y", "t"])

    C.give_back(docs.sparkSession)
    drawn = C.labelled(docs, labels, "toxic", MOD, REM, bound).select(F.col("doc_id").cast("long").alias("doc_id"), "y", "text")
    rows = drawn.mapInArrow(run, "doc_id long, y int, t array<int>").toArrow().sort_by("doc_id")
    C.give_back(docs.sparkSession)
    y = rows.column("y").to_numpy().astype(np.float64)
    share = labels.where(F.col("toxic").isin(0, 1) & ~C.held_out(MOD, REM)).agg(F.avg("toxic")).first()[0] or 0.0
    if not len(y) or y.min() == y.max():
        return Model(0.0, None, None, None, float(y.mean()) if len(y) else float(share))
    lists = rows.column("t").combine_chunks()
    off, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    each = [flat[off[i] : off[i + 1]] for i in range(len(y))]
    model = train(each, y, bits, factors, epochs, least, differ, rate, decay, seed, float(share))
    del rows, lists, off, flat, each
    X.release()
    return model


def score(docs: DataFrame, model: Model, out: str = "score", bits: int = 17) -> DataFrame:
    """``docs`` with its columns and ``out``; one narrow pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches):
        m = shared.value
        for b in batches:
            found = [np.zeros(0)] + [m.scores(s.n, *terms(s, bits)) for s in X.slabs(b.column(place))]
            yield X.append(b, **{out: pa.array(np.concatenate(found), pa.float64())})
        X.release()

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(out, DoubleType())]))


def op9_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    model = fit(docs, C.table(spark, sf_dir, "labels"))
    got = score(docs.select("doc_id", F.col("text").cast("string").alias("text")), model)
    return got.select("doc_id", C.held_out(MOD, REM).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
