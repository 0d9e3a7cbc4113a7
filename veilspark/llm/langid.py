"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over bounded labelled text. A text is parsed into phrases, each the longest
match in the language's automaton, across words; a phrase costs the bits of a place in that language's sample and of one
more byte, so phrases are normalised by the sample's size, and the language whose phrases cost least wins (ties: the smaller
name). Before, A-Z are lower-cased and runs of ASCII white space become one blank, one at either end. A text is parsed in
blocks of ``BLOCK`` bytes, and phrases end where blocks do; so all blocks of a slab, in all languages, go forward together,
one byte a step, in numpy arrays.

The sample is at most ``chars`` bytes a language, from at most ``bound`` documents, drawn by a hash of the id, one row an id;
each gives one passage, the longer the fewer they are. All languages are learned; with more than ``total / chars`` of them
each has ``total / languages`` bytes. Automata are built on the driver and broadcast as one table of rows laid over each
other (``base``, ``owner``, ``to``): at most about 60 bytes a byte of sample, 50 MB in all.

Defined results: null text or text without any letter: ``und`` with score 0. With no labels: ``und``, 0. The score is the
runner-up's cost over the sum of both (0.5: no difference; 1.0 with one language learned). Repeated rows are predicted alike,
and rows that share an id teach once, by their least text; long texts are parsed whole; extra columns stay and play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from . import common as C
from . import textops as X

MOD, REM, BLOCK = 4, 2, 1024


def automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of ``text``; state 0 is the root."""
    go, link, length, last = [{}], [-1], [0], 0
    for c in text:
        new = len(go)
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return go


def laid_over(src: np.ndarray, sym: np.ndarray, dst: np.ndarray, states: int, width: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, owner, to): the edge of ``s`` by ``c`` is at base[s] + c, where owner is s; edges sorted by src."""
    degree = np.bincount(src, minlength=states)
    first = np.cumsum(degree) - degree
    size = 2 * len(src) + 2 * width
    owner, to, base = np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(states, np.int32)
    rng = np.random.default_rng(seed)
    # states of many edges first, each class in rounds of random places; whoever meets a taken place tries again
    for lo, hi in ((17, 1 << 30), (5, 17), (2, 5)):
        left = np.flatnonzero((degree >= lo) & (degree < hi))
        while len(left):
            n = degree[left]
            start = np.cumsum(n) - n
            edge = np.repeat(first[left] - start, n) + np.arange(n.sum())
            spot = np.repeat(rng.integers(0, size - width, len(left)), n)
            at = spot + sym[edge]
            claim = np.full(size, -1, np.int64)
            claim[at] = np.arange(len(at))
            good = np.logical_and.reduceat((owner[at] < 0) & (claim[at] == np.arange(len(at))), start)
            keep = np.repeat(good, n)
            owner[at[keep]], to[at[keep]] = src[edge[keep]], dst[edge[keep]]
            base[left[good]] = spot[start[good]]
            left = left[~good]
    one = first[degree == 1]
    free = np.flatnonzero(owner[width:] < 0)[: len(one)] + width
    owner[free], to[free] = src[one], dst[one]
    base[src[one]] = free - sym[one]
    return base, owner, to


class Parser:
    """Cross-parsing of many texts in several languages. Symbols: 0 ends a block, 1 is a byte that no language has."""

    def __init__(self, sample: dict[str, bytes]):
        self.langs = sorted(sample)
        seen = sorted(set().union(*sample.values())) if sample else []
        self.symbol = np.ones(256, np.uint8 if len(seen) < 254 else np.int16)
        self.symbol[seen] = np.arange(2, len(seen) + 2)
        width = len(seen) + 2
        src, sym, dst, roots, at = [], [], [], [], 0
        for x in self.langs:
            go = automaton(sample[x])
            n = np.fromiter(map(len, go), np.int64, len(go))
            src.append(np.repeat(np.arange(len(go)), n) + at)
            sym.append(self.symbol[np.fromiter((c for g in go for c in g), np.int64, int(n.sum()))].astype(np.int64))
            dst.append(np.fromiter((t for g in go for t in g.values()), np.int64, int(n.sum())) + at)
            roots.append(at)
            at += len(go)
        self.root = np.array(roots, np.int32)
        if not self.langs:
            return
        src, sym, dst = map(np.concatenate, (src, sym, dst))
        self.base, self.owner, self.to = laid_over(src, sym, dst, at, width)
        # from the root by each symbol, and the phrase that an unknown byte is
        self.fresh = np.repeat(self.root[:, None], width, 1)
        self.alone = np.ones((len(roots), width), np.int32)
        self.alone[:, 0] = 0
        for k, r in enumerate(roots):
            edge = slice(*np.searchsorted(src, [r, r + 1]))
            self.fresh[k, sym[edge]] = dst[edge]
            self.alone[k, sym[edge]] = 0
        self.bits = np.array([8 + np.log2(len(sample[x]) + 1) for x in self.langs])

    def blocks(self, slab: X.Slab) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of each block, a column a block, longest first, with at least one 0 below; document of each block)."""
        data = X.LOWER[slab.data]
        blank = X.SPACE[data]
        data = np.where(blank, np.uint8(32), data)
        keep = ~blank
        keep[1:] |= ~blank[:-1]
        keep[:1] = True
        size = np.diff(slab.offsets)
        cut = slab.offsets[:-1][size > 0]
        keep[cut] = True
        # one blank before and after each text, unless it has one
        many = np.add.reduceat(keep, cut).astype(np.int64) if len(cut) else np.zeros(0, np.int64)
        ends = np.cumsum(many)
        flat = data[keep]
        lead, trail = (flat[ends - many] != 32), (flat[ends - 1] != 32)
        whole = many + lead + trail
        after = np.cumsum(whole)
        text = np.full(int(whole.sum()), 32, np.uint8)
        text[np.arange(len(flat)) + np.repeat(after - whole + lead - (ends - many), many)] = flat
        each = -(-whole // BLOCK)
        doc = np.repeat(np.flatnonzero(size > 0), each)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
        begin = np.repeat(after - whole, each) + k * BLOCK
        length = np.minimum(BLOCK, np.repeat(after, each) - begin)
        order = np.argsort(-length, kind="stable")
        begin, length, doc = begin[order], length[order], doc[order]
        out = np.zeros((len(doc), BLOCK + 1), self.symbol.dtype)
        fill = np.arange(BLOCK + 1)[None] < length[:, None]
        text = self.symbol[text]
        out[fill] = text[(begin[:, None] + np.arange(BLOCK + 1)[None])[fill]]
        return np.ascontiguousarray(out[:, : (int(length.max()) + 1 if len(length) else 0)].T), doc

    def counts(self, slab: X.Slab) -> np.ndarray:
        """(documents, languages): phrases of each text in each language."""
        out = np.zeros((slab.n, len(self.langs)), np.int64)
        if not self.langs or not len(slab.data):
            return out
        grid, doc = self.blocks(slab)
        phrases = np.zeros((len(self.langs), len(doc)), np.int64)
        for lo in range(0, len(doc), 4096):
            part = grid[:, lo : lo + 4096]
            used = (part != 0).sum(0)
            live = np.searchsorted(-used, -np.arange(len(part)), side="right")
            state = np.repeat(self.root[:, None], part.shape[1], 1)
            count = np.zeros(state.shape, np.int32)
            for t in range(int(used.max()) + 1):
                # blocks whose last symbol came the step before still end their phrase
                n = part.shape[1] if t == 0 else int(live[t - 1])
                c, s = part[t, :n].astype(np.intp), state[:, :n]
                at = self.base.take(s)
                at += c[None].astype(np.int32)
                lost = self.owner.take(at) != s
                new = self.to.take(at)
                k, i = np.nonzero(lost)
                if len(k):
                    ck = c[i]
                    count[k, i] += (s[k, i] != self.root[k]) + self.alone[k, ck]
                    new[k, i] = self.fresh[k, ck]
                state[:, :n] = new
            phrases[:, lo : lo + 4096] = count
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(doc, phrases[k], slab.n)
        return out


def fit(docs: DataFrame, bound: int = 300, chars: int = 100_000, total: int = 800_000) -> dict[str, bytes]:
    """Sample text by language, from documents outside the held-out fold with a language and a text."""
    spark, scale = docs.sparkSession, 1 << 30
    known = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = known.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~C.held_out(MOD, REM))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.02).alias("n")).collect()}
    if not counts:
        return {}
    chars = max(1, min(chars, total // len(counts)))
    # of each language about three times as many ids as are wanted, then the first of them by hash
    share = {x: -(-chars // max(1, min(bound, int(n * 0.9)))) for x, n in counts.items()}
    plan = spark.createDataFrame([(x, min(scale, 3 * bound * scale // max(1, n) + 1), share[x]) for x, n in counts.items()], "lang string, cut_ long, share_ int")
    drawn = known.join(F.broadcast(plan), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < F.col("cut_"))
    # a passage of the text, where a hash of the id says
    start = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.greatest(F.length("text") - F.col("share_"), F.lit(0)) + 1).cast("int") + 1
    drawn = drawn.select("doc_id", "lang", F.substring(F.col("text"), start, F.col("share_")).alias("cut"))
    once = drawn.groupBy("lang", "doc_id").agg(F.min("cut").alias("cut"))
    w = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    rows = once.withColumn("rn_", F.row_number().over(w)).where(F.col("rn_") <= bound).toArrow().sort_by([("lang", "ascending"), ("rn_", "ascending")])
    out: dict[str, list[bytes]] = {}
    for lang, cut in zip(rows.column("lang").to_pylist(), rows.column("cut").to_pylist()):
        out.setdefault(lang, []).append(b" ".join(cut.translate(_LOWER).encode().split()))
    return {k: (b" " + b" ".join(v) + b" ")[:chars] for k, v in out.items()}


_LOWER = {c: c + 32 for c in range(65, 91)}


def predict(docs: DataFrame, sample: dict[str, bytes], lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with its columns and both of these; one narrow pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(Parser(sample))
    place = docs.columns.index("text")

    def run(batches):
        parser = shared.value
        names = np.array([*parser.langs, "und"], object)
        for b in batches:
            col = b.column(place)
            lettered = pc.fill_null(pc.match_substring_regex(pc.fill_null(col, ""), r"\pL"), False).to_numpy(zero_copy_only=False)
            pred, score = [np.zeros(0, np.int64)], [np.zeros(0)]
            for s in X.slabs(col, 1 << 21):
                if not parser.langs:
                    pred.append(np.zeros(s.n, np.int64))
                    score.append(np.zeros(s.n))
                    continue
                c = parser.counts(s) * parser.bits
                best = c.argmin(1)
                low = c[np.arange(s.n), best]
                c[np.arange(s.n), best] = np.inf
                nxt = c.min(1)
                pred.append(best)
                score.append(nxt / np.maximum(nxt + low, 1) if len(parser.langs) > 1 else np.ones(s.n))
            best, sc = np.concatenate(pred), np.concatenate(score)
            none = ~lettered | (len(parser.langs) == 0)
            yield X.append(b, **{lang_col: pa.array(names[np.where(none, len(parser.langs), best)], pa.string()), score_col: pa.array(np.where(none, 0.0, sc), pa.float64())})
        X.release()

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(lang_col, StringType()), StructField(score_col, DoubleType())]))


def op7_language_crossparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    got = predict(docs.select("doc_id", F.col("text").cast("string").alias("text")), fit(docs))
    return got.select("doc_id", C.held_out(MOD, REM).alias("held_out"), "lang_pred", "score")
