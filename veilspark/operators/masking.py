"""Masking by a dictionary, and restoring."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import patterns as P
from ..functions import text as T
from .detect import prefix_of
from .graph import materialize, numbered, small

#: A run of digits or of other word signs: where a bounded value stands in a text, its first run is a run of the text.
RUN = r"(?U)\d+|[\w&&[^\d]]+"


def number_tokens(found: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(session_id, value, type, token, seen): new values get the next number of their prefix in order of first sight.

    found: session_id, value, type, seen (a sortable place). known: session_id, token, original_form, entity_type of any
    status; their numbers are never given again, and their values keep their tokens. A value found with two types keeps
    the one seen first.
    """
    first = found.groupBy("session_id", "value").agg(F.min(F.struct("seen", "type")).alias("m")).select("session_id", "value", "m.type", "m.seen")
    first = first.withColumn("prefix", prefix_of(F.col("type")))
    if known is not None:
        have = known.select("session_id", F.col("original_form").alias("value"), F.col("entity_type").alias("type"), F.col("token").alias("old")).distinct()
        top = known.select("session_id", F.regexp_extract("token", r"^\[?(.*)_[0-9]+\]?$", 1).alias("prefix"), F.regexp_extract("token", r"_([0-9]+)\]?$", 1).try_cast("bigint").alias("n"))
        top = top.groupBy("session_id", "prefix").agg(F.max("n").alias("top"))
        first = first.join(have, ["session_id", "value", "type"], "left").join(top, ["session_id", "prefix"], "left")
    else:
        first = first.withColumns({"old": F.lit(None).cast("string"), "top": F.lit(None).cast("bigint")})
    first = numbered(first, ["session_id", "prefix"], [F.col("old").isNotNull(), "seen", "value"], "n_")
    token = F.coalesce("old", F.concat("prefix", F.lit("_"), (F.coalesce("top", F.lit(0)) + F.col("n_")).cast("string")))
    return first.select("session_id", "value", "type", token.alias("token"), "seen")


def bounded(key: str) -> str:
    """The pattern of a key: a digit at its edge needs no digit beside it, another letter none of ``\\w``."""
    pre = r"(?<!\d)" if key[:1].isdigit() else r"(?<!\w)" if key[:1].isalnum() else ""
    post = r"(?!\d)" if key[-1:].isdigit() else r"(?!\w)" if key[-1:].isalnum() else ""
    return pre + re.escape(key) + post


class Replacer:
    """Longest key first, one pass. Keys are found by the word or sign they begin with, so that a text is matched only
    against keys that could begin where it stands; a long dictionary costs no more a place than a short one."""

    HEAD = re.compile(r"\w+|[^\w\s]|\s")

    def __init__(self, pairs: dict[str, str]):
        heads: dict[str, list[str]] = {}
        for k in sorted((k for k in pairs if k), key=len, reverse=True):
            heads.setdefault(k[:2], []).append(k)
        self.pairs = pairs
        self.rx = {h: re.compile("|".join(map(bounded, ks))) for h, ks in heads.items()}
        self.any = re.compile("|".join(sorted(map(re.escape, heads), key=len, reverse=True))) if heads else None

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        out, at = [], 0
        while self.any is not None and (m := self.any.search(text, at)):
            best = None
            for h in (text[m.start() : m.start() + 2], text[m.start() : m.start() + 1]):
                if h in self.rx and (x := self.rx[h].match(text, m.start())) and (best is None or x.end() > best.end()):
                    best = x
            if best is None:
                at = m.start() + 1
            else:
                out.append((best.start(), best.end(), self.pairs[best[0]]))
                at = best.end()
        return out

    def apply(self, text: str) -> str:
        out, last = [], 0
        for s, e, v in self.spans(text):
            out += [text[last:s], v]
            last = e
        return "".join(out) + text[last:]


def _masked(text: str | None, pairs: dict[str, str], held: dict) -> str | None:
    if not text or not pairs:
        return text
    key = frozenset(pairs.items())
    if key not in held:
        if len(held) > 2000:
            held.clear()
        held[key] = Replacer(pairs)
    return held[key].apply(text)


def mask(docs: DataFrame, pairs: DataFrame, text: str = "text", out: str = "masked", most: int = 200_000) -> DataFrame:
    """Every bounded occurrence of every value in its session's texts becomes its token.

    docs: session_id, a text and more; pairs: session_id, value, token. Only values whose first run a document holds are
    tried on it. Up to ``most`` pairs, counted, are broadcast, and masking is one narrow pass; a larger dictionary meets
    the documents by an equi-join on that run, so neither side is collected whole. Of a value's tokens the first counts.
    """
    word = F.coalesce(F.nullif(F.regexp_extract("value", RUN, 0), F.lit("")), F.lit(""))
    pairs = pairs.where("value != ''").groupBy("session_id", "value").agg(F.min("token").alias("token"))
    pairs, few = small(pairs.withColumn("word", word), "mask-pairs", most)
    if few:
        return _mask_broadcast(docs, pairs, text, out)
    keyed = materialize(docs.withColumn("key_", F.monotonically_increasing_id()), "mask-texts")
    runs = F.array_union(F.regexp_extract_all(F.col(text), F.lit(RUN), 0), F.array(F.lit("")))
    words = keyed.select("session_id", "key_", F.explode(F.array_distinct(runs)).alias("word"))
    mine = words.join(pairs, ["session_id", "word"]).groupBy("session_id", "key_").agg(F.collect_list(F.struct("value", "token")).alias("pairs_"))
    joined = keyed.join(mine.drop("session_id"), "key_", "left").select(*docs.columns, "pairs_")
    place, have, names = joined.columns.index(text), joined.columns.index("pairs_"), [*docs.columns, out]

    def run(batches):
        held: dict = {}
        for b in batches:
            got = [_masked(t, {x["value"]: f"[{x['token']}]" for x in p or ()}, held) for t, p in zip(b.column(place).to_pylist(), b.column(have).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(b.columns) if i != have), pa.array(got, pa.string())], names=names)

    return joined.mapInArrow(run, StructType([*docs.schema.fields, StructField(out, StringType())]))


def _mask_broadcast(docs: DataFrame, pairs: DataFrame, text: str, out: str) -> DataFrame:
    spark = docs.sparkSession
    table: dict = {}
    for r in pairs.collect():
        table.setdefault(r["session_id"], {}).setdefault(r["word"], []).append((r["value"], f"[{r['token']}]"))
    shared = spark.sparkContext.broadcast(table)
    place, session, names = docs.columns.index(text), docs.columns.index("session_id"), [*docs.columns, out]
    word = re.compile(r"\d+|[^\W\d]+")

    def run(batches):
        held: dict = {}
        for b in batches:
            got = []
            for t, s in zip(b.column(place).to_pylist(), b.column(session).to_pylist()):
                words = shared.value.get(s)
                if not t or not words:
                    got.append(t)
                    continue
                there = words.keys() & {*word.findall(t), ""} if len(words) > 50 else [w for w in words if w in t]
                got.append(_masked(t, {v: k for w in there for v, k in words[w] if v in t}, held))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())], names=names)

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(out, StringType())]))


def restore(texts: DataFrame, values: DataFrame, text: str = "text", out: str = "restored") -> DataFrame:
    """Tokens, however loosely written, become their session's values; unknown tokens stay.

    texts: session_id, a text and more; values: session_id, token, value (one row a token). The text is split at its
    tokens, tokens are joined by equality, and the pieces put together again.
    """
    keyed = texts.withColumn("key_", F.xxhash64(*texts.columns))
    found = F.regexp_extract_all(F.col(text), F.lit(T.LOOSE), 0)
    each = keyed.select("session_id", "key_", F.explode(F.array_distinct(F.transform(found, T.token_of))).alias("token")).distinct()
    known = each.join(values.select("session_id", "token", "value"), ["session_id", "token"]).groupBy("session_id", "key_").agg(F.map_from_entries(F.collect_list(F.struct("token", "value"))).alias("map_"))
    pieces = F.split(F.col(text), T.LOOSE)
    whole = F.array_join(F.zip_with(pieces, found, lambda p, t: F.concat(F.coalesce(p, F.lit("")), F.coalesce(F.element_at("map_", T.token_of(t)), t, F.lit("")))), "")
    return keyed.join(known, ["session_id", "key_"], "left").withColumn(out, F.when(F.col("map_").isNull(), F.col(text)).otherwise(whole)).select(*texts.columns, out)


def aliases_resolved(aliases: DataFrame, rounds: int = 20) -> DataFrame:
    """(session_id, old_token, new_token) followed to the end; pointer jumping, so chains of 2**k need k rounds."""
    now = aliases.select("session_id", "old_token", "new_token")
    for _ in range(rounds):
        nxt = now.select("session_id", F.col("old_token").alias("new_token"), F.col("new_token").alias("far"))
        moved = Observation()
        step = now.join(nxt, ["session_id", "new_token"], "left").observe(moved, F.count("far").alias("n"))
        now = materialize(step.select("session_id", "old_token", F.coalesce("far", "new_token").alias("new_token")), "aliases")
        if not moved.get["n"]:
            break
    return now


def leaks(outputs: DataFrame, originals: DataFrame, limit: int | None = None) -> DataFrame:
    """(doc_id, value): values of the session that a document's output still holds, bounded as in masking; at most ``limit`` a document if given, for display.

    outputs: session_id, doc_id, text; originals: session_id, value. Candidates meet on the value's first word.
    """
    vals, few = small(originals.where("value != ''").select("session_id", "value", F.regexp_extract("value", RUN, 0).alias("word")).distinct(), "leak-values")
    vals = F.broadcast(vals) if few else vals
    words = outputs.select("session_id", "doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(RUN), 0))).alias("word"))
    cand = words.join(vals, ["session_id", "word"]).select("session_id", "doc_id", "value").distinct()
    # texts meet their few candidates only, never their words
    cand = cand.join(outputs.select("session_id", "doc_id", "text"), ["session_id", "doc_id"]).where(F.contains("text", "value"))
    quoted = F.regexp_replace("value", r"([^0-9A-Za-zА-Яа-яЁё_ ])", r"\\$1")
    first, last = F.left("value", F.lit(1)), F.right("value", F.lit(1))
    pre = F.when(first.rlike("[0-9]"), "(?<![0-9])").when(first.rlike(r"(?U)\w"), r"(?<!\w)").otherwise("")
    post = F.when(last.rlike("[0-9]"), "(?![0-9])").when(last.rlike(r"(?U)\w"), r"(?!\w)").otherwise("")
    hit = cand.where(F.regexp_like("text", F.concat(F.lit("(?U)"), pre, quoted, post))).select("doc_id", "value").distinct()
    if limit is None:
        return hit
    w = Window.partitionBy("doc_id").orderBy("value")
    return hit.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit).drop("rn")


def has_token(c) -> Column:
    """A token, even with its closing bracket cut off, stands in the text."""
    return (F.col(c) if isinstance(c, str) else c).rlike(r"\[(?:" + "|".join(P.TOKEN_PREFIXES) + r")_[0-9]")
