"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of tokens; a window (a sequence of ``size`` tokens) takes from each queue its target share, and
what a queue gets too little or too much by rounding is its deficit, carried to the next window. Queues that run dry leave
the round and the others' shares grow. With whole tokens the deficits have a closed form: after w of a phase's W windows,
queue i has given floor(w * N_i / W) - floor(w * N_(i-1) / W) tokens, N being running totals of the queues' tokens in the
phase. So any task can start at any window with exactly the deficits that one sequential run would carry there, and no
window needs to see another.

1. Texts are encoded once and written with their token offsets inside (partition, source).
2. Sums a (partition, source) give each pair's place in its queue, by windows over those sums, never over documents.
   Sources with a share under ``1 / 256`` that no target names share one queue at the driver, so that at most 256 totals
   come there. Inside it every source is a queue again: a binary tree over the sources, kept in a table, deals the shared
   queue's places out in pairs (the left one has given floor(x * L / (L + R)) of the first x), also in closed form.
3. The driver lays out phases (at most two a queue); the written rows join their places and are cut.

Targets are shares by source, sources without one share what is left in proportion; a share over zero counts as two tokens a
window at least, sources of target zero wait until all others are dry, and size / 4 sources can be named. Without targets the sources' own shares, so that all queues run dry together and only the very
last window is padded. Defined results: null text is empty, its document is the end token alone; a null source queues
as ''; repeated rows are packed each; an empty table gives no pieces. Ties have no part: queues run in input order.
"""

from __future__ import annotations

import bisect
import itertools
import json
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from . import common as C
from . import textops as X
from . import wordids as W

SIZE, END, QUEUES = 4096, 2, 256


class WordCodec:
    """Ids by the tokenizers library, a distinct word once: new words are encoded as one text and parted at the tokens
    that end a word."""

    def __init__(self, path: str | None = None):
        from tokenizers import Tokenizer

        self.path = path or bpe.default_path()
        self.library = Tokenizer.from_file(self.path)
        with open(self.path, encoding="utf-8") as f:
            spec = json.load(f)
        added, suffix = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}, spec["model"].get("end_of_word_suffix") or ""
        text = {i: t for t, i in spec["model"]["vocab"].items()}
        top = max(max(text), *added.values()) + 1 if added else max(text) + 1
        self.ends = np.array([suffix != "" and text.get(i, "").endswith(suffix) for i in range(top)])
        self.kind, self.added, self.slow = "<u2" if top <= 65536 else "<u4", added, None
        self.table = W.WordTable(self.learn, self.cut, list(added), kind=self.kind)

    def cut(self, text: str) -> list[str]:
        self.slow = self.slow or bpe.Codec(self.path)
        return self.slow.cut(text)

    def learn(self, words: list[str]) -> list[list[int]]:
        out = []
        for lo in range(0, len(words), 20_000):
            part = words[lo : lo + 20_000]
            ids = np.array(self.library.encode(" ".join(part), add_special_tokens=False).ids, np.int64)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(part) and cut[-1] == len(ids):
                ids = ids.tolist()
                out += [ids[a:b] for a, b in zip([0, *cut[:-1].tolist()], cut.tolist())]
            else:
                out += [self.library.encode(w, add_special_tokens=False).ids for w in part]
        return out


_codecs: dict[str, WordCodec] = {}


def codec(path: str | None = None) -> WordCodec:
    key = path or bpe.default_path()
    if key not in _codecs:
        _codecs[key] = WordCodec(key)
    return _codecs[key]


def encoded(docs: DataFrame, path: str | None = None, end: int = END) -> DataFrame:
    """doc_id, src, n, ids, part, at: ``at`` counts the source's tokens before the document in its partition."""

    def run(batches):
        table, part, given = codec(path).table, TaskContext.get().partitionId(), {}
        for b in batches:
            for slab in X.slabs(b.column("text")):
                ids, cut, _ = table.encode(slab, end)
                n, src, at = np.diff(cut), b.column("src").slice(slab.first, slab.n), []
                for s, k in zip(src.to_pylist(), n.tolist()):
                    x = given.get(s, 0)
                    at.append(x)
                    given[s] = x + k
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(slab.first, slab.n), src, pa.array(n), W.binary(ids, cut), pa.array([part] * slab.n, pa.int32()), pa.array(at, pa.int64())], names=["doc_id", "src", "n", "ids", "part", "at"])
        X.release()

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("src"))
    return rows.mapInArrow(run, "doc_id long, src string, n long, ids binary, part int, at long")


def phases(totals: list[int], weights: list[Fraction], size: int) -> list[tuple[int, int, list[int], list[int]]]:
    """(first window, windows, tokens of each queue, tokens of each queue before): whole windows, but for the last."""
    left, used, out, at = list(totals), [0] * len(totals), [], 0
    while sum(left):
        live = [i for i, r in enumerate(left) if r and weights[i]]
        # what has target zero waits until all else is dry, and then goes in proportion
        given = weights if live else left
        live = live or [i for i, r in enumerate(left) if r]
        raw = {i: max(Fraction(given[i]), Fraction(2, size) * sum(given[j] for j in live)) for i in live}
        share = {i: w / sum(raw.values()) for i, w in raw.items()}
        n = [0] * len(left)
        if sum(left[i] for i in live) <= size:
            # the last window of what is live; what waits fills it up
            w, n = 1, [r if i in share else 0 for i, r in enumerate(left)]
            for i, r in enumerate(left):
                n[i] += min(r - n[i], size - sum(n))
        else:
            w = max(1, int(min(left[i] / share[i] for i in live) // size))
            for i in live:
                n[i] = min(left[i], int(w * size * share[i]))
            short = w * size - sum(n)
            while short > 0:
                spare = sorted((i for i in live if left[i] > n[i]), key=lambda i: (n[i] - w * size * share[i], i))
                each = max(1, short // len(spare))
                for i in spare:
                    more = min(each, short, left[i] - n[i])
                    n[i] += more
                    short -= more
        out.append((at, w, n, list(used)))
        at += w
        for i, k in enumerate(n):
            left[i] -= k
            used[i] += k
    return out


class Cutter:
    """Where queue i's tokens go."""

    def __init__(self, plan):
        self.plan = plan
        self.cum = [[0, *np.cumsum(np.array(n, object)).tolist()] for _, _, n, _ in plan]
        k = len(plan[0][2]) if plan else 0
        self.begin = [[p[3][i] for p in plan] for i in range(k)]

    def pieces(self, i: int, a: int, b: int):
        """(token, tokens, window, place in the window) of the queue's tokens a to b."""
        while a < b:
            k = bisect.bisect_right(self.begin[i], a) - 1
            first, w_all, n, used = self.plan[k]
            lo, hi = self.cum[k][i], self.cum[k][i + 1]
            edge = lambda w: used[i] + w * hi // w_all - w * lo // w_all
            w = min(w_all - 1, (a - used[i]) * w_all // n[i])
            while edge(w) > a:
                w -= 1
            while edge(w + 1) <= a:
                w += 1
            stop = min(b, edge(w + 1))
            yield a, stop - a, first + w, (w + 1) * lo // w_all - w * lo // w_all + a - edge(w)
            a = stop


def paths(whole: DataFrame) -> DataFrame:
    """src, path: from a source's leaf up, whether it is the right one of two, and the tokens of it and of the other."""
    rows = C.materialize(whole.withColumn("bucket", F.pmod(F.xxhash64("src"), F.lit(1024))).withColumn("one", F.lit(1)), "packing-tail")
    base = C.running_base(rows.groupBy("bucket").agg(F.count("*").alias("c")).withColumn("all_", F.lit(0)), ["all_"], "bucket", "c", "base")
    ranks = C.running_base(rows, ["bucket"], "src", "one", "inner").join(base.select("bucket", "base"), "bucket").select("src", "n", (F.col("base") + F.col("inner")).alias("rank"))
    depth = max(0, rows.count() - 1).bit_length()
    if not depth:
        return ranks.select("src", F.expr("cast(array() AS array<struct<k:int,right:boolean,own:bigint,other:bigint>>)").alias("path"))
    ranks = C.materialize(ranks, "packing-ranks")
    at = ranks.select("src", "n", "rank", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("k")).withColumn("node", F.expr("shiftright(rank, k)"))
    sums = C.materialize(at.groupBy("k", "node").agg(F.sum("n").alias("own")), "packing-nodes")
    other = sums.select("k", F.col("node").bitwiseXOR(F.lit(1)).alias("node"), F.col("own").alias("other"))
    both = sums.join(other, ["k", "node"], "left").na.fill({"other": 0})
    step = F.struct("k", (F.col("node") % 2 == 1).alias("right"), "own", "other")
    return at.join(both, ["k", "node"]).groupBy("src").agg(F.sort_array(F.collect_list(step)).alias("path"))


def climb(path, a: int, b: int):
    """(token, tokens, place) of a source's tokens a to b in the shared queue."""
    total = max((s["own"] + s["other"] for s in path), default=0)
    t = np.arange(a, b, dtype=np.int64 if (total + 1) ** 2 < 1 << 62 else object)
    for s in path:
        if s["other"]:
            own, pair = s["own"], s["own"] + s["other"]
            t = t * pair // own if s["right"] else -(-(t + 1) * pair // own) - 1
    cut = [0, *(np.flatnonzero((t[1:] - t[:-1]) != 1) + 1).tolist(), b - a]
    for lo, hi in zip(cut, cut[1:]):
        yield a + lo, hi - lo, int(t[lo])


def pack(docs: DataFrame, size: int = SIZE, targets: dict[str, float] | None = None, path: str | None = None) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (as 32-bit integers)."""
    spark = docs.sparkSession
    rows = C.materialize(encoded(docs, path), "packing")
    sums = C.materialize(rows.groupBy("part", "src").agg(F.sum("n").alias("n")), "packing-sums")
    all_n = sums.agg(F.sum("n")).first()[0] or 0
    whole = sums.groupBy("src").agg(F.sum("n").alias("n"))
    limit, named = max(1, min(QUEUES, size // 4)), sorted(targets or {})
    if len(named) > size // 4:
        raise ValueError(f"at most {size // 4} sources can be named in windows of {size} tokens")
    own = F.col("src").isin(named) if targets is not None else F.col("n") >= max(1, -(-all_n // limit))
    large = {r["src"]: r["n"] for r in whole.where(own).collect()}
    if targets is None:
        # what is left over gives two tokens a window, or takes the smallest queue in
        while large and 0 < all_n - sum(large.values()) < -(-2 * all_n // size):
            large.pop(min(large, key=lambda s: (large[s], s)))
    names = sorted(large)
    totals = [large[s] for s in names] + [all_n - sum(large.values())]
    if targets is None:
        weights = [Fraction(t) for t in totals]
    else:
        weights = [Fraction(str(targets[s])) for s in names]
        weights.append(max(Fraction(0), 1 - sum(weights)))
    tail = len(names)
    queue = spark.createDataFrame([(s, i) for i, s in enumerate(names)], "src string, queue int")
    sums = sums.join(F.broadcast(queue), "src", "left").na.fill({"queue": tail})
    places = C.running_base(sums, ["src"], "part", "n", "base").select("part", "src", "queue", "base")
    if totals[tail]:
        places = places.join(paths(whole.join(F.broadcast(queue), "src", "left_anti")), "src", "left")
    shared = spark.sparkContext.broadcast(Cutter(phases(totals, weights, size)))

    def run(batches):
        cutter, kind = shared.value, codec(path).kind
        for b in batches:
            out = [[] for _ in range(8)]
            for doc, n, ids, a, q, steps in zip(*[b.column(c).to_pylist() for c in ("doc_id", "n", "ids", "a", "queue")], b.column("path").to_pylist() if "path" in b.schema.names else itertools.repeat(None)):
                x = np.frombuffer(ids, kind).astype("<u4").tobytes()
                for t, many, first in climb(steps, a, a + n) if steps else [(a, n, a)]:
                    for at, length, window, place in cutter.pieces(q, first, first + many):
                        begin = t - a + at - first
                        piece = x[begin * 4 : (begin + length) * 4]
                        for col, v in zip(out, (doc, begin, length, zlib.crc32(piece), n, window, place, piece)):
                            col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out[:7]] + [pa.array(out[7], pa.binary())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    placed = rows.join(places, ["part", "src"]).select("doc_id", "n", "ids", (F.col("base") + F.col("at")).alias("a"), "queue", *[c for c in places.columns if c == "path"])
    return placed.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def op2_packing_drr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(C.table(spark, sf_dir, "documents")).drop("ids")
