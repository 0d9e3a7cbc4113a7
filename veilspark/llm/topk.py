"""Exact top-k by inner product: a pivot-distance index.

Largest inner product becomes smallest distance by one more component: v' = (v, sqrt(M^2 - |v|^2)) and q' = (q, 0) give
|q' - v'|^2 = |q|^2 + M^2 - 2 q.v, M being the largest norm. Vectors are keyed by their nearest pivot and their distance to
it. A query first searches one group of its own pivot, which bounds its k-th score from below; it then visits only pivots
whose nearest possible vector, by the triangle inequality, could score as much, and within a group goes through annuli
sorted by how near they can come, until no annulus left can score as much as its k-th best. The result is exact.

A pivot's vectors are dealt to groups of about ``group`` rows and its queries to blocks of about ``block``, so no task
holds a pivot, however many vectors are alike. The index keeps every vector; pivots are chosen from a bounded sample of
4096. What the driver and the broadcasts hold is ``pivots`` rows; the sizes of groups, a row a group, are joined.

Defined results: vectors null or with null or non-finite components take no part, as query or candidate; shorter vectors
count as filled with zeros; rows that share the query's id are its own; ties go to the smaller id; fewer candidates than
k: all; without queries or candidates no rows. Scores are exact while they fit 53 bits. Rows that repeat an id with a
vector each are candidates each, so an id may take two ranks; extra columns, whatever their names, play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from . import vectors as V

EPS = 1e-6


def best(qi, score, ids, k):
    """The k best of each query among (query, score, id) triples: positions, by query, score down and id up."""
    order = np.lexsort((ids, -score, qi))
    q = qi[order]
    first = np.searchsorted(q, q)
    return order[np.arange(len(q)) - first < k]


def search(q: np.ndarray, qid: np.ndarray, least: np.ndarray, v: np.ndarray, vid: np.ndarray, r: np.ndarray, pivot: np.ndarray, top: float, k: int, ring: int = 256):
    """Triples of the k best of v for each q, given v's distances r to the pivot and lower bounds of the k-th scores."""
    order = np.argsort(r, kind="stable")
    v, vid, r = v[order], vid[order], r[order]
    far = np.sqrt(V.squared(q, np.zeros((1, q.shape[1])))[:, 0] + top * top)
    to_pivot = np.sqrt(V.squared(np.hstack([q, np.zeros((len(q), 1))]), pivot[None])[:, 0])
    rings = [(lo, min(lo + ring, len(v))) for lo in range(0, len(v), ring)]
    gap = np.stack([np.maximum(0, np.maximum(r[lo] - to_pivot, to_pivot - r[hi - 1])) for lo, hi in rings], 1)
    bound = (far[:, None] ** 2 - np.maximum(gap - EPS * (1 + top), 0) ** 2) / 2
    kth = least.astype(np.float64).copy()
    bq, bs, bi = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    # annuli sorted by the bound, each query's own order: step t looks at every query's t-th best annulus
    plan = np.argsort(-bound, axis=1, kind="stable")
    open_ = np.ones(len(q), bool)
    for t in range(len(rings)):
        at = plan[:, t]
        open_ &= bound[np.arange(len(q)), at] + EPS * (1 + np.abs(kth, where=np.isfinite(kth), out=np.zeros(len(q)))) >= kth
        if not open_.any():
            break
        found = []
        for j in np.unique(at[open_]):
            lo, hi = rings[j]
            who = np.flatnonzero(open_ & (at == j))
            s = np.rint(q[who] @ v[lo:hi].T)
            a, b = np.nonzero((s >= kth[who][:, None]) & (qid[who][:, None] != vid[lo:hi][None]))
            found.append((who[a], s[a, b], vid[lo:hi][b]))
        bq, bs, bi = (np.concatenate([x, *y]) for x, y in zip((bq, bs, bi), zip(*found)))
        keep = best(bq, bs, bi, k)
        bq, bs, bi = bq[keep], bs[keep], bi[keep]
        n = np.bincount(bq, minlength=len(q))
        full = n >= k
        if full.any():
            low = np.full(len(q), np.inf)
            np.minimum.at(low, bq, bs)
            kth[full] = np.maximum(kth[full], low[full])
    return bq, bs, bi


def top_k(vectors: DataFrame, query: F.Column, k: int = 5, scale: float = 256.0, pivots: int = 24, group: int = 4096, block: int = 1024, sample: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of (vec_id, embedding) that ``query`` selects, against all rows."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col("vec_id").isNotNull() & V.usable()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"), F.coalesce(query, F.lit(False)).alias("asks"))
    quant = F.transform("x", lambda c: F.floor(c * scale).cast("double"))
    stats = rows.agg(F.max(F.size("x")), F.max(F.aggregate(quant, F.lit(0.0), lambda a, b: a + b * b))).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not stats[0]:
        return spark.createDataFrame([], schema)
    dim, top = stats[0], float(np.sqrt(stats[1])) + 1e-9

    def lifted(x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(top * top - (x * x).sum(1), 0))[:, None]])

    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("x").toArrow()
    centre = V.spread(lifted(np.floor(scale * V.matrix(drawn.column("x"), dim))), pivots, 4)
    shared = spark.sparkContext.broadcast(centre)

    def keyed(batches):
        for b in batches:
            x = np.floor(scale * V.matrix(b.column("x"), dim))
            own, r = V.nearest(lifted(x), shared.value)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("asks"), pa.array(own.astype(np.int32)), pa.array(r), V.raw(x)], names=["vec_id", "asks", "pivot", "r", "x"])

    index = C.materialize(rows.mapInArrow(keyed, "vec_id long, asks boolean, pivot int, r double, x binary"), "pivot-index")
    meta = {r["pivot"]: r for r in index.groupBy("pivot").agg(F.count("*").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi"), F.sum(F.col("asks").cast("long")).alias("q")).collect()}
    parts = spark.createDataFrame([(p, -(-m["n"] // group)) for p, m in meta.items()], "pivot int, parts int")
    index = index.join(F.broadcast(parts), "pivot").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    asks = index.where("asks").select(F.col("vec_id").alias("qid"), F.col("pivot").alias("home"), F.col("x").alias("q"))

    def visit(plan: DataFrame) -> DataFrame:
        """plan: qid, q, least, pivot, part. The k best in that group of vectors, for each."""
        sizes = plan.groupBy("pivot", "part").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
        plan = plan.join(sizes, ["pivot", "part"]).withColumn("blk", F.pmod(F.xxhash64("qid"), F.col("blocks")).cast("int"))
        held = index.select("vec_id", "pivot", "part", "r", "x").join(sizes, ["pivot", "part"]).withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

        def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                z = np.zeros(0, np.int64)
                return pa.table({"qid": z, "score": z, "vec_id": z})
            c = shared.value[key[0].as_py()]
            qid, vid = left.column("qid").to_numpy(), right.column("vec_id").to_numpy()
            i, s, v = search(V.from_raw(left.column("q"), dim), qid, left.column("least").to_numpy(), V.from_raw(right.column("x"), dim), vid, right.column("r").to_numpy(), c, top, k)
            return pa.table({"qid": qid[i], "score": s.astype(np.int64), "vec_id": v})

        keys = ["pivot", "part", "blk"]
        got = plan.select(*keys, "qid", "q", "least").groupBy(*keys).cogroup(held.select(*keys, "vec_id", "r", "x").groupBy(*keys)).applyInArrow(run, "qid long, score long, vec_id long")
        w = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
        return got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    lowest = F.lit(float("-inf"))
    seed = asks.join(F.broadcast(parts.withColumnRenamed("pivot", "home")), "home").select("qid", "q", F.col("home").alias("pivot"), F.pmod(F.xxhash64("qid"), F.col("parts")).cast("int").alias("part"), lowest.alias("least"))
    floor = visit(seed).groupBy("qid").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("least"))
    asks = asks.join(floor, "qid", "left").withColumn("least", F.coalesce("least", lowest))
    near = [(p, m["lo"], m["hi"]) for p, m in sorted(meta.items())]

    def route(batches):
        """Each query to the pivots that could hold as good a vector as its bound."""
        for b in batches:
            q, least = V.from_raw(b.column("q"), dim), b.column("least").to_numpy()
            to = np.sqrt(V.squared(np.hstack([q, np.zeros((len(q), 1))]), shared.value))
            far2 = (q * q).sum(1) + top * top
            take, pivot = [], []
            for p, lo, hi in near:
                gap = np.maximum(0, np.maximum(lo - to[:, p], to[:, p] - hi) - EPS * (1 + top))
                take.append(np.flatnonzero((far2 - gap * gap) / 2 + EPS * (1 + far2) >= least))
                pivot.append(np.full(len(take[-1]), p, np.int32))
            i = pa.array(np.concatenate(take))
            yield pa.RecordBatch.from_arrays([b.column("qid").take(i), b.column("q").take(i), b.column("least").take(i), pa.array(np.concatenate(pivot))], names=["qid", "q", "least", "pivot"])

    routed = C.materialize(asks.select("qid", "q", "least").mapInArrow(route, "qid long, q binary, least double, pivot int"), "pivot-routes")
    groups = routed.join(F.broadcast(parts), "pivot").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return visit(groups).select(F.col("qid").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(C.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
