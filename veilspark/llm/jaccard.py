"""N-gram Jaccard join by signature trees.

A document's set is the 64-bit hashes of its distinct word n-grams. Documents with equal sets are one class. Classes are
routed by bands of min-hashes of the whole set (every band key of every class is kept; none is capped); what is
connected by shared keys is a candidate cluster, and every link lies within one but for a probability of at most
``(1 - J**rows)**bands`` a pair: 7e-9 at 0.85 with 5 rows in 32 bands, 7e-10 at 0.8 with 4 in 40.

Inside a cluster a signature tree does the join: leaves are documents, every node holds the OR of its documents' hashed
bitmaps and the range of their sizes. A traversal of pairs of nodes drops a pair if the most its members could share (the
common bits, plus the smaller of both sides' largest count of tokens beyond their bits) is too little for the smallest
sizes below them, or if the sizes alone rule a link out. Pairs of documents that survive are decided exactly on their
sets; pairs that are connected already are skipped, as only the components are asked for.

Clusters too large for a task (``chunk`` documents or ``load`` n-grams) are dealt to chunks, twice, by different hashes.
After that, members outside their cluster's largest component are joined with every chunk, in blocks; so every pair of a
cluster is compared or known to be connected, and no task ever holds a cluster. Small clusters share tasks.

Defined results: null or empty text, or one without words: size 0, linked with nothing; fewer words than n: the whole
sequence is the one n-gram; a null id: component null; rows that share an id are one node; extra columns play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import textops as X

U = np.uint64


def sets(slab: X.Slab, n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each document of the slab."""
    starts, ends, doc = slab.words(lower=True)
    word = X.range_hash(slab.data, starts, ends) if len(starts) else np.zeros(0, U)
    cut = np.searchsorted(doc, np.arange(slab.n + 1))
    with np.errstate(over="ignore"):
        k = len(word)
        gram = np.zeros(max(0, k - n + 1), U)
        for i in range(n):
            gram = X.mix(gram * U(0x9E3779B97F4A7C15) + word[i : k - n + 1 + i]) if len(gram) else gram
        out = []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            if b - a >= n:
                out.append(np.unique(gram[a : b - n + 1]))
            elif b > a:
                h = np.full(1, b - a, U)
                for w in word[a:b]:
                    h = X.mix(h * U(0xD6E8FEB86659FD93) + w)
                out.append(h)
            else:
                out.append(np.zeros(0, U))
    return out


def mark(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


class Bands:
    """Band keys of a set: ``bands`` hashes of ``rows`` min-hashes each."""

    def __init__(self, rows: int, bands: int, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(0, 1 << 32, rows * bands, dtype=np.uint64) | U(1)).astype(np.uint32)
        self.b = rng.integers(0, 1 << 32, rows * bands, dtype=np.uint64).astype(np.uint32)
        self.rows, self.bands = rows, bands
        self.salt = X.mix(np.arange(1, bands + 1, dtype=U))

    def keys(self, s: np.ndarray) -> np.ndarray:
        low = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        x = X.mix(s)
        hi, lo = (x >> U(32)).astype(np.uint32), x.astype(np.uint32)
        with np.errstate(over="ignore"):
            for i in range(0, len(s), 1024):
                # two words of the hash, so that the order isn't linear in one of them
                h = lo[i : i + 1024, None] * self.a + self.b
                h ^= hi[i : i + 1024, None] >> np.uint32(7)
                h *= np.uint32(0x85EBCA6B)
                h ^= h >> np.uint32(15)
                np.minimum(low, h.min(0), out=low)
            key = self.salt.copy()
            for r in low.reshape(self.bands, self.rows).T.astype(U):
                key = X.mix(key * U(0x9E3779B97F4A7C15) + r)
        return key.astype(np.int64)


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


class Tree:
    """Levels of nodes over documents sorted by size; level 0 is the documents."""

    FAN = 8

    def __init__(self, each: list[np.ndarray]):
        self.n = np.array([len(s) for s in each], np.int64)
        width = int(np.clip(1 << int(4 * max(1, np.median(self.n))).bit_length(), 256, 1 << 15))
        bits = np.zeros((len(each), width), bool)
        for i, s in enumerate(each):
            bits[i, (s % U(width)).astype(np.int64)] = True
        extra = self.n - bits.sum(1)
        level = (np.packbits(bits, axis=1).view(np.uint64), self.n, self.n, extra)
        self.levels = [level]
        while len(level[1]) > 1:
            cut = np.arange(0, len(level[1]), self.FAN)
            level = (np.bitwise_or.reduceat(level[0], cut), np.minimum.reduceat(level[1], cut), np.maximum.reduceat(level[2], cut), np.maximum.reduceat(level[3], cut))
            self.levels.append(level)

    def survivors(self, k: int, x: np.ndarray, y: np.ndarray, num: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bits, lo, hi, extra = self.levels[k]
        fits = (100 * hi[x] >= num * lo[y]) & (100 * hi[y] >= num * lo[x])
        x, y = x[fits], y[fits]
        most = np.zeros(len(x), np.int64)
        step = max(1, (1 << 21) // bits.shape[1])
        for i in range(0, len(x), step):
            most[i : i + step] = np.bitwise_count(bits[x[i : i + step]] & bits[y[i : i + step]]).sum(1)
        most = np.minimum(most + np.minimum(extra[x], extra[y]), np.minimum(hi[x], hi[y]))
        ok = most * (100 + num) >= num * (lo[x] + lo[y])
        return x[ok], y[ok], most[ok]

    def pairs(self, num: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of documents that could link, with the most they could share."""
        x = y = np.zeros(1, np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            x, y, most = self.survivors(k, x, y, num)
            if k == 0:
                return x, y, most
            size = len(self.levels[k - 1][1])
            step = np.arange(self.FAN)
            cx = (x[:, None, None] * self.FAN + step[None, :, None]) + np.zeros((1, 1, self.FAN), np.int64)
            cy = (y[:, None, None] * self.FAN + step[None, None, :]) + np.zeros((1, self.FAN, 1), np.int64)
            ok = (cx < size) & (cy < size) & ((cx < cy) if k == 1 else (cx <= cy))
            x, y = cx[ok], cy[ok]
        return x, y, np.zeros(0, np.int64)


def join(each: list[np.ndarray], num: int, known: np.ndarray | None = None, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what the pairs with Jaccard >= num / 100 connect. ``known``: members with equal numbers are connected already; ``side``: only pairs with a True side are asked for."""
    if len(each) < 2:
        return []
    size = np.array([len(s) for s in each])
    order = np.lexsort((np.array([int(s[0]) if len(s) else 0 for s in each], dtype=np.uint64), size))
    forest = Forest(len(each))
    if known is not None:
        first: dict[int, int] = {}
        for i, k in enumerate(known.tolist()):
            forest.join(first.setdefault(k, i), i)
    x, y, most = Tree([each[i] for i in order]).pairs(num)
    x, y = order[x], order[y]
    if side is not None:
        ok = side[x] | side[y]
        x, y, most = x[ok], y[ok], most[ok]
    out = []
    total = size[x] + size[y]
    # the likeliest first: they connect most, and connected pairs need no look
    by = np.argsort(-(most / np.maximum(total - most, 1)), kind="stable")
    for i, j, t in zip(x[by].tolist(), y[by].tolist(), total[by].tolist()):
        if forest.root(i) != forest.root(j):
            a, b = (each[i], each[j]) if size[i] <= size[j] else (each[j], each[i])
            at = np.searchsorted(b, a)
            at[at == len(b)] = 0
            both = int((b[at] == a).sum())
            if (100 + num) * both >= num * t:
                forest.join(i, j)
                out.append((i, j))
    return out


def _linked(num: int, n: int):
    """One task's clusters: rows (doc_id, sig, text, cid, chunk, comp, side) to links (a, b)."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("cid", "ascending"), ("chunk", "ascending"), ("doc_id", "ascending")]).combine_chunks()
        each = [s for slab in X.slabs(t.column("text")) for s in sets(slab, n)]
        ids, cid, chunk = (t.column(c).to_numpy() for c in ("doc_id", "cid", "chunk"))
        sig, comp, side = t.column("sig").to_pylist(), t.column("comp").to_numpy(), t.column("side").to_numpy(zero_copy_only=False)
        # of rows that share an id, the one with the class's set; each once
        good, seen = [], set()
        for i in range(len(ids)):
            key = (int(cid[i]), int(chunk[i]), sig[i], bool(side[i]))
            if key not in seen and mark(each[i]) == sig[i]:
                seen.add(key)
                good.append(i)
        a, b = [], []
        at = 0
        while at < len(good):
            end = at
            while end < len(good) and cid[good[end]] == cid[good[at]] and chunk[good[end]] == chunk[good[at]]:
                end += 1
            g = good[at:end]
            known = comp[g]
            for i, j in join([each[x] for x in g], num, known if (known >= 0).any() else None, side[g] if side[g].any() else None):
                a.append(int(ids[g[i]]))
                b.append(int(ids[g[j]]))
            at = end
        X.release()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def jaccard_components(docs: DataFrame, n: int = 4, num: int = 85, rows: int = 5, bands: int = 32, chunk: int = 1024, load: int = 400_000) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; links at Jaccard >= num / 100."""

    def described(batches):
        make = Bands(rows, bands)
        for b in batches:
            size, sig, keys = [], [], []
            for slab in X.slabs(b.column("text")):
                for s in sets(slab, n):
                    size.append(len(s))
                    sig.append(mark(s))
                    keys.append(make.keys(s).tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size, pa.int64()), pa.array(sig, pa.binary()), pa.array(keys, pa.binary())], names=["doc_id", "n", "sig", "keys"])
        X.release()

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    every = C.materialize(text.mapInArrow(described, "doc_id long, n long, sig binary, keys binary"), "ngrams")
    real = every.where("n > 0 and doc_id is not null")
    classes = C.materialize(real.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys")), "ngram-classes")

    def opened(batches):
        for b in batches:
            k = b"".join(b.column("keys").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("rep").to_numpy(), bands)), pa.array(np.frombuffer(k, np.int64))], names=["rep", "key"])

    keyed = C.materialize(classes.select("rep", "keys").mapInArrow(opened, "rep long, key long"), "ngram-keys")
    shared = keyed.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("key", "low")
    near = keyed.join(shared, "key").where("rep > low").select("rep", "low").distinct()
    clusters = C.components(near, "rep", "low").select(F.col("node").alias("rep"), F.col("comp").alias("cid"))
    members = C.materialize(clusters.join(classes.select("rep", "sig", "n"), "rep"), "ngram-clusters")
    sized = members.groupBy("cid").agg(F.count("*").alias("m"), F.sum("n").alias("load")).withColumn("chunks", F.greatest(F.ceil(F.col("m") / chunk), F.ceil(F.col("load") / load)).cast("int"))
    sized = C.materialize(sized.select("cid", "chunks"), "ngram-sizes")
    total = members.agg(F.count("*"), F.sum("n")).first()
    tasks = max(1, -(-(total[0] or 0) // 512), -(-(total[1] or 0) // (load // 2)))
    placed = members.join(sized, "cid")
    dealt = placed.select(
        F.col("rep").alias("doc_id"), "sig", "cid", "chunks",
        F.explode(F.when(F.col("chunks") > 1, F.array(F.pmod(F.xxhash64("rep", F.lit(1)), F.col("chunks")), F.pmod(F.xxhash64("rep", F.lit(2)), F.col("chunks")) + F.col("chunks"))).otherwise(F.array(F.lit(0).cast("long")))).alias("chunk"),
    )
    dealt = dealt.withColumn("task", F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("cid"), F.lit(tasks))).otherwise(F.xxhash64("cid", "chunk")))
    dealt = dealt.withColumns({"comp": F.lit(-1).cast("long"), "side": F.lit(False)})
    found_schema, cols = "a long, b long", ["doc_id", "sig", "text", "cid", "chunk", "comp", "side"]

    def linked(rows_: DataFrame) -> DataFrame:
        return rows_.join(text, "doc_id").select("task", *cols).groupBy("task").applyInArrow(lambda t: _linked(num, n)(t.select(cols)), found_schema)

    links = C.materialize(linked(dealt), "ngram-links")
    comp = C.materialize(C.components(links, "a", "b"), "ngram-comp")
    big = placed.where("chunks > 1").join(comp, F.col("rep") == F.col("node"), "left").select(F.col("rep").alias("doc_id"), "sig", "n", "cid", "chunks", F.coalesce("comp", "rep").alias("comp"))
    big = C.materialize(big, "ngram-big")
    if big.limit(1).count():
        main = big.groupBy("cid", "comp").agg(F.count("*").alias("k")).groupBy("cid").agg(F.max_by("comp", F.struct("k", F.negative("comp"))).alias("main"))
        loose = big.join(main, "cid").where("comp != main").drop("main")
        counts = loose.groupBy("cid").agg(F.greatest(F.ceil(F.count("*") / (chunk // 2)), F.ceil(F.sum("n") / load)).cast("int").alias("blocks"))
        loose = loose.join(counts, "cid").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col("blocks"))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1).cast("array<bigint>"))).withColumn("side", F.lit(True))
        all_ = big.join(counts, "cid").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("chunks"))).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1).cast("array<bigint>"))).withColumn("side", F.lit(False))
        keep = ["doc_id", "sig", "cid", "comp", "side", "block", "part", "chunks"]
        both = loose.select(keep).unionByName(all_.select(keep)).withColumn("chunk", F.col("block") * F.col("chunks") + F.col("part")).withColumn("task", F.xxhash64("cid", "chunk"))
        more = C.materialize(linked(both.select("doc_id", "sig", "cid", "chunk", "comp", "side", "task")), "ngram-links")
        comp = C.components(links.unionByName(more), "a", "b")
    final = classes.select("sig", "rep").join(comp, F.col("rep") == F.col("node"), "left").select("sig", F.coalesce("comp", "rep").alias("component_id"))
    out = real.select("doc_id", F.col("n").alias("n_shingles"), "sig").join(final, "sig").select("doc_id", "n_shingles", "component_id")
    rest = every.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(rest)


def op3_signature_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(C.table(spark, sf_dir, "documents"))
