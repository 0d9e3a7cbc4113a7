"""Near-duplicate vectors by product quantisation.

Vectors are scaled to length one. ``lists`` coarse centres and, for the residuals, ``codes`` centres in each of ``subspaces``
subspaces are fitted on a sample of 64 vectors a list; every vector goes to its nearest list with its residual's codes and its
own quantisation error. Lists grow with the root of the number of vectors (64 for 50,000; 8 to 2,048) and probes with the
root of that of lists (12 of 64), so that the work grows with the power 1.75 and the broadcast is bounded. A vector is compared in the ``probes`` lists nearest to it: a table of its residual's distances to
the codes gives the asymmetric distance to every member by look-up, members that even their quantisation error can't bring
within the threshold are left out, and the rest are decided by their exact cosine in double precision. Only vectors with
equal labels meet. The look-up never loses a pair; a pair is lost only if neither vector probes the other's list.

Equal vectors with equal labels are one, with a multiplicity. Hot (label, list) groups are dealt to tiles of about
``tile`` members against ``tile`` queries, so no task holds a group. Tiles emit a count a vector and a spanning forest of
their links, never pairs; components come from the forests.

Defined results: vectors null, of length zero or 0-norm, with null or non-finite components, and rows without label link
with nothing: n_links 0, component_id their own id. Repeated rows of one id and vector count as other vectors of that id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import vectors as V

LEAST = 0.93


class Quantiser:
    def __init__(self, points: np.ndarray, lists: int, subspaces: int, codes: int):
        self.coarse = V.spread(points, lists, 6)
        dim = points.shape[1]
        cut = np.linspace(0, dim, min(subspaces, dim) + 1).astype(int)
        self.spans = list(zip(cut[:-1].tolist(), cut[1:].tolist()))
        rest = points - self.coarse[V.nearest(points, self.coarse)[0]]
        self.books = [V.spread(rest[:, a:b], codes, 4) for a, b in self.spans]

    def encode(self, x: np.ndarray, probes: int):
        d = V.squared(x, self.coarse)
        probes = min(probes, d.shape[1])
        near = np.argsort(d, axis=1, kind="stable")[:, :probes]
        rest = x - self.coarse[near[:, 0]]
        code = np.stack([V.nearest(rest[:, a:b], book)[0] for (a, b), book in zip(self.spans, self.books)], 1).astype(np.uint8)
        back = np.hstack([book[code[:, s]] for s, book in enumerate(self.books)])
        return near, code, np.sqrt(((rest - back) ** 2).sum(1))

    def estimate(self, x: np.ndarray, which: int, code: np.ndarray) -> np.ndarray:
        """Distances of x to the quantised members of a list, by look-up."""
        rest = x - self.coarse[which]
        total = np.zeros((len(x), len(code)))
        for s, ((a, b), book) in enumerate(zip(self.spans, self.books)):
            total += V.squared(rest[:, a:b], book)[:, code[:, s]]
        return np.sqrt(total)


def link_block(quant: Quantiser, which: int, x: np.ndarray, y: np.ndarray, code: np.ndarray, err: np.ndarray, least: float) -> np.ndarray:
    """Boolean (x, y): exact cosine at least ``least``; look-ups rule most pairs out first."""
    reach = np.sqrt(2 - 2 * least) + 1e-6
    maybe = quant.estimate(x, which, code) <= reach + err[None]
    out = np.zeros(maybe.shape, bool)
    rows, cols = np.flatnonzero(maybe.any(1)), np.flatnonzero(maybe.any(0))
    if len(rows):
        out[np.ix_(rows, cols)] = (x[rows] @ y[cols].T >= least) & maybe[np.ix_(rows, cols)]
    return out


def near_duplicates(vectors: DataFrame, least: float = LEAST, lists: int | None = None, probes: int | None = None, subspaces: int = 8, codes: int = 64, tile: int = 2048) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"), V.usable().alias("ok"))
    rows = every.where(F.col("ok") & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    dim, many = rows.agg(F.max(F.size("x")), F.count("*")).first()
    dim = dim or 0
    lists = lists or min(2048, max(8, round(64 * (many / 50_000) ** 0.5)))
    probes = probes or min(lists, max(6, round(12 * (lists / 64) ** 0.5)))
    alone = every.select("vec_id").withColumn("none", F.lit(0).cast("long"))
    if not dim:
        return alone.select("vec_id", F.col("none").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))

    def unit(x: np.ndarray) -> np.ndarray:
        peak = np.abs(x).max(1, keepdims=True)
        x = x / np.where(peak > 0, peak, 1)
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(n > 0, n, 1)

    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(2048, 64 * lists)).select("x").toArrow()
    points = unit(V.matrix(drawn.column("x"), dim))
    shared = spark.sparkContext.broadcast(Quantiser(points, lists, subspaces, codes))

    def encoded(batches):
        quant = shared.value
        for b in batches:
            x = unit(V.matrix(b.column("x"), dim))
            live = np.flatnonzero(np.abs(x).max(1) > 0) if len(x) else np.zeros(0, int)
            x = x[live]
            near, code, err = quant.encode(x, probes)
            take = lambda c: b.column(c).take(pa.array(live))
            yield pa.RecordBatch.from_arrays([take("vec_id"), take("label"), pa.array([hashlib.md5(r.tobytes()).digest() for r in np.ascontiguousarray(x)], pa.binary()), pa.array(list(near.astype(np.int32)), pa.list_(pa.int32())), V.raw(code), pa.array(err), V.raw(x)], names=["vec_id", "label", "same", "near", "code", "err", "x"])

    full = C.materialize(rows.mapInArrow(encoded, "vec_id long, label long, same binary, near array<int>, code binary, err double, x binary"), "pq")
    classes = C.materialize(full.groupBy("label", "same").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")), "pq-classes")
    reps = full.join(classes, [full.label == classes.label, full.same == classes.same, full.vec_id == classes.rep]).select(full.label, full.same, "rep", "weight", "near", "code", "err", "x").dropDuplicates(["label", "same"])
    reps = C.materialize(reps.withColumn("rid", F.xxhash64("label", "same")).drop("same"), "pq-reps")
    held = reps.withColumn("list", F.col("near")[0])
    asks = reps.withColumn("list", F.explode("near"))
    tiles = C.materialize(
        held.groupBy("label", "list").agg(F.ceil(F.count("*") / tile).cast("int").alias("ny"))
        .join(asks.groupBy("label", "list").agg(F.ceil(F.count("*") / tile).cast("int").alias("nx")), ["label", "list"]), "pq-tiles")
    cols = ["label", "list", "tx", "ty", "rid", "rep", "weight", "near", "code", "err", "x"]
    left = asks.join(tiles, ["label", "list"]).withColumn("tx", F.pmod("rid", F.col("nx")).cast("int")).withColumn("ty", F.explode(F.sequence(F.lit(0), F.col("ny") - 1))).select(cols)
    right = held.join(tiles, ["label", "list"]).withColumn("ty", F.pmod("rid", F.col("ny")).cast("int")).withColumn("tx", F.explode(F.sequence(F.lit(0), F.col("nx") - 1))).select(cols).toDF(*[f"{c}_" for c in cols])

    def run(key, a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            z = np.zeros(0, np.int64)
            return pa.table({"rid": z, "rep": z, "links": z, "low": z})
        b = b.rename_columns(a.column_names)
        quant, which = shared.value, key[1].as_py()
        xi, yi = a.column("rep").to_numpy(), b.column("rep").to_numpy()
        xr, yr = a.column("rid").to_numpy(), b.column("rid").to_numpy()
        x, y = V.from_raw(a.column("x"), dim), V.from_raw(b.column("x"), dim)
        code, err = V.from_raw(b.column("code"), len(quant.spans), np.uint8), b.column("err").to_numpy()
        home = np.array([r[0] for r in a.column("near").to_pylist()])
        meets = np.zeros((len(yi), len(quant.coarse)), bool)
        for i, r in enumerate(b.column("near").to_pylist()):
            meets[i, r] = True
        wx, wy = a.column("weight").to_numpy(), b.column("weight").to_numpy()
        nx, ny = np.zeros(len(xi), np.int64), np.zeros(len(yi), np.int64)
        blocks = []
        for lo in range(0, len(xi), 512):
            hi = min(len(xi), lo + 512)
            hit = link_block(quant, which, x[lo:hi], y, code, err, LEAST if least is None else least)
            # a pair that both lists see counts in the smaller; within a list each side counts the other once
            away = home[lo:hi] != which
            hit[away] &= ~(meets[:, home[lo:hi][away]].T & (home[lo:hi][away] < which)[:, None])
            hit &= ~((xr[lo:hi][:, None] == yr[None]) & ~away[:, None])
            nx[lo:hi] = hit @ wy
            ny += (hit & away[:, None]).T @ wx[lo:hi]
            blocks.append(np.packbits(hit, axis=1))
        lx, ly = xi.copy(), yi.copy()
        while True:  # the smallest id over the tile's links
            before = lx.sum() + ly.sum()
            for n, p in enumerate(blocks):
                hit = np.unpackbits(p, axis=1, count=len(yi)).astype(bool)
                part = lx[n * 512 : n * 512 + len(hit)]
                r = np.flatnonzero(hit.any(1))
                if len(r):
                    h = hit[r]
                    part[r] = np.minimum(part[r], np.where(h, ly[None], np.iinfo(np.int64).max).min(1))
                    ly = np.minimum(ly, np.where(h, part[r][:, None], np.iinfo(np.int64).max).min(0))
            if lx.sum() + ly.sum() == before:
                break
        n = np.concatenate([nx, ny])
        ids, low, rid = np.concatenate([xi, yi]), np.concatenate([lx, ly]), np.concatenate([xr, yr])
        keep = (n > 0) | (low != ids)
        return pa.table({"rid": rid[keep], "rep": ids[keep], "links": n[keep], "low": low[keep]})

    keys = ["label", "list", "tx", "ty"]
    found = C.materialize(left.groupBy(*keys).cogroup(right.groupBy(*[f"{k}_" for k in keys])).applyInArrow(run, "rid long, rep long, links long, low long"), "pq-found")
    comp = C.components(found.where("low != rep").select("rep", "low").distinct(), "rep", "low")
    counted = found.groupBy("rid").agg(F.sum("links").alias("links"))
    per = (
        classes.withColumn("rid", F.xxhash64("label", "same")).join(counted, "rid", "left").join(comp, F.col("rep") == F.col("node"), "left")
        .select("label", "same", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("comp", "rep").alias("component_id"))
    )
    linked = full.select("vec_id", "label", "same").join(per, ["label", "same"]).select("vec_id", "n_links", "component_id")
    rest = alone.where("vec_id is null").unionByName(every.where("vec_id is not null").select("vec_id").exceptAll(full.select("vec_id")).withColumn("none", F.lit(0).cast("long")))
    out = linked.unionByName(rest.select("vec_id", F.col("none").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op10_pq_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.table(spark, sf_dir, "embeddings"))
