"""Personal data by bootstrapped contextual extraction, in DataFrame and SQL functions alone.

Seeds are the base patterns' finds (e-mail, IP, card, phone), whatever they look like. A pattern is the word and separator
(blanks, one of ``=:#``, a quote) before a seed or before an identifier-like token (at least six characters and three
digits); runs of blanks, up to 64, count as one. Patterns and values form a weighted graph over the whole corpus.
Scores go round a fixed number of times: a pattern scores the mean of its distinct values' scores, if enough of them are
seeds or follow a pattern that was confident in the round before, so that what is found teaches further patterns; a value
scores 1 if it is a seed, else the best score of its patterns, damped, else 0. Tokens after patterns that end at
``confident`` or more are found as kind ``id``; found spans never touch a base one.

Plan: one narrow pass with the regular expressions, written without the texts; aggregates by pattern and by value (both
with map-side sums; AQE splits a hot side of their joins); found spans come back by a key of id and text.

Positions: matches of a context-free pattern, taken left to right, are the first occurrences after the match before, so
``locate`` recovers offsets in code points. Quantifiers are possessive where that can't change a match, and a run is
entered only at its start or where the last match ended, so long runs take linear time and no recursion.

Defined results: null and empty text have no spans; rows with equal id and text have equal spans; extra columns play no
part. Digits of a part of an address may have leading zeros.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"
CARD = r"[0-9](?:[\\x20-]?[0-9])++"
PHONE = r"\\+[0-9][\\x20().0-9-]+[0-9]"
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
QUOTE = r"[\\x22\\x27]"
#: What may stand between a word and a value; never nothing.
SEP = rf"(?:{QUOTE}?+[ ]{{0,64}}+[=:#][ ]{{0,64}}+{QUOTE}?+|[ ]{{1,64}}+{QUOTE}?+|{QUOTE})"
TOKEN = rf"(?<![\\pL_])[\\pL_]++{SEP}(?=(?:[A-Za-z._@+-]*+[0-9]){{3}})\\+?+[A-Za-z0-9][A-Za-z0-9._@+-]*+"
#: Characters before a seed that hold the longest pattern.
LEFT = 168


def _positions(pattern: str, when: str) -> str:
    """SQL for the places of all matches, in order."""
    return f"""aggregate(CASE WHEN {when} THEN regexp_extract_all(text_, r'{pattern}', 0) ELSE cast(array() AS array<string>) END,
      named_struct('p', 0, 'o', cast(array() AS array<struct<s:int,e:int,m:string>>)),
      (a, m) -> named_struct('p', locate(m, text_, a.p + 1) - 1 + length(m),
        'o', concat(a.o, array(named_struct('s', locate(m, text_, a.p + 1) - 1, 'e', locate(m, text_, a.p + 1) - 1 + length(m), 'm', m)))),
      a -> a.o)""".replace("\\\\", "\\")


#: Base patterns, what a text must hold for them, and what a match must satisfy.
BASE = {
    "email": (EMAIL, "contains(text_, '@')", "true"),
    "ip": (IP, "digits_", f"x.m rlike r'^{PART}[.]{PART}[.]{PART}[.]{PART}$'"),
    "card": (CARD, "digits_", "length(translate(x.m, ' -', '')) BETWEEN 16 AND 19 AND luhn_check(translate(x.m, ' -', ''))"),
    "phone": (PHONE, "digits_ AND contains(text_, '+')", "length(regexp_replace(x.m, '[^0-9]', '')) BETWEEN 8 AND 15"),
}


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, key_, a column of spans for each kind, ``near``: tokens after patterns, with their pattern and value, and
    ``seeds``: base spans' patterns and values."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text_"))
    rows = rows.withColumns({"digits_": F.col("text_").rlike("[0-9]"), "key_": F.xxhash64("text_")})
    rows = rows.withColumns({f"all_{k}": F.expr(_positions(p, w)) for k, (p, w, _) in BASE.items()} | {"all_near": F.expr(_positions(TOKEN, "digits_"))})
    rows = rows.withColumns({k: F.expr(f"transform(filter(all_{k}, x -> {ok}), x -> named_struct('s', x.s, 'e', x.e, 'm', x.m))") for k, (_, _, ok) in BASE.items()})
    sep = SEP.replace("\\\\", "\\")
    near = rf"""filter(transform(all_near, x -> named_struct(
        's', x.e - length(regexp_extract(x.m, r'\+?[A-Za-z0-9][A-Za-z0-9._@+-]*$', 0)),
        'e', x.e - length(regexp_extract(x.m, '[._@+-]*$', 0)),
        'pattern', lower(regexp_replace(regexp_extract(x.m, r'^([\pL_]+{sep})', 1), ' +', ' ')),
        'value', regexp_replace(regexp_extract(x.m, r'\+?[A-Za-z0-9][A-Za-z0-9._@+-]*$', 0), '[._@+-]+$', ''))),
      x -> length(x.value) >= 6 AND length(x.pattern) BETWEEN 3 AND 32)"""
    seeds = rf"""filter(transform(concat(email, ip, card, phone), x -> named_struct(
        'pattern', lower(regexp_replace(regexp_extract(substring(text_, greatest(x.s - {LEFT}, 0) + 1, least(x.s, {LEFT})), r'(?<![\pL_])([\pL_]++{sep})\z', 1), ' +', ' ')),
        'value', x.m)), x -> length(x.pattern) BETWEEN 3 AND 32)"""
    return rows.select("doc_id", "key_", *KINDS, F.expr(near).alias("near"), F.expr(seeds).alias("seeds"))


def scored_patterns(rows: DataFrame, rounds: int = 3, least: int = 5, confident: float = 0.8, damp: float = 0.9) -> DataFrame:
    """Patterns with a final score of at least ``confident``, from scanned rows."""
    touched = "exists(concat(email, ip, card, phone), b -> b.s < n.e AND n.s < b.e)"
    # a token that starts with a base span is in the graph as that span
    tokens = "filter(near, n -> NOT exists(concat(email, ip, card, phone), b -> b.s = n.s))"
    edges = (
        rows.select(F.expr(f"""explode(concat(
            transform({tokens}, n -> named_struct('pattern', n.pattern, 'value', n.value, 'seed', {touched})),
            transform(seeds, n -> named_struct('pattern', n.pattern, 'value', n.value, 'seed', true)))) AS x""")).select("x.*")
        .groupBy("pattern", "value").agg(F.max("seed").alias("seed"))
    )
    edges = C.materialize(edges, "pii-graph")
    scores = None
    for _ in range(rounds + 1):
        # the first time only seeds are known
        now = edges.join(scores, "pattern", "left") if scores is not None else edges.withColumn("score", F.lit(None).cast("double"))
        value = now.groupBy("value").agg(
            F.max(F.when(F.col("seed"), 1.0).otherwise(F.coalesce(F.col("score") * damp, F.lit(0.0)))).alias("vs"),
            F.max(F.col("seed") | (F.coalesce("score", F.lit(0.0)) >= confident)).alias("known"),
        )
        scores = (
            edges.join(value, "value").groupBy("pattern").agg(F.round(F.avg("vs"), 9).alias("score"), F.sum(F.col("known").cast("long")).alias("support"))
            .where(F.col("support") >= least).select("pattern", "score")
        )
    return scores.where(F.col("score") >= confident)


def found_spans(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """doc_id, key_, found: sorted spans of tokens after confident patterns that touch no base span."""
    free = "filter(near, n -> NOT exists(concat(email, ip, card, phone), b -> b.s < n.e AND n.s < b.e))"
    one = rows.select("doc_id", "key_", F.expr(f"explode({free}) AS n")).select("doc_id", "key_", "n.s", "n.e", "n.pattern")
    hit = one.join(patterns.select("pattern"), "pattern", "left_semi").select("doc_id", "key_", "s", "e").distinct()
    return hit.groupBy("doc_id", "key_").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("found"))


def extract(docs: DataFrame, **options) -> DataFrame:
    """doc_id, key_, email, ip, card, phone, found of every row."""
    rows = C.materialize(scanned(docs), "pii")
    found = found_spans(rows, scored_patterns(rows, **options)).select(F.col("doc_id").alias("d_"), F.col("key_").alias("k_"), "found")
    got = rows.join(found, rows.doc_id.eqNullSafe(found.d_) & (rows.key_ == found.k_), "left")
    return got.select("doc_id", "key_", *KINDS, F.coalesce("found", F.expr("cast(array() AS array<struct<s:int,e:int>>)")).alias("found"))


def _text(kinds) -> F.Column:
    return F.array_join(F.concat(*[F.expr(f"transform({c}, x -> concat('{k}:', x.s, ':', x.e))") for c, k in kinds]), ",")


def redact(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; overlapping spans become one."""
    spans = extract(docs.select("doc_id", "text"), **options)
    every = F.array_sort(F.concat(*[F.expr(f"transform({c}, x -> named_struct('s', x.s, 'e', x.e, 'k', '{k}'))") for c, k in [*((k, k) for k in KINDS), ("found", "id")]]))
    spans = spans.where(F.size("email") + F.size("ip") + F.size("card") + F.size("phone") + F.size("found") > 0).select(F.col("doc_id").alias("d_"), F.col("key_").alias("k_"), every.alias("spans_")).dropDuplicates(["d_", "k_"])
    new = F.expr("""aggregate(spans_, named_struct('p', 0, 'o', ''), (a, x) -> CASE WHEN x.e <= a.p THEN a ELSE
      named_struct('p', x.e, 'o', concat(a.o, substring(text, a.p + 1, greatest(x.s - a.p, 0)), CASE WHEN x.s < a.p THEN '' ELSE concat('[', upper(x.k), ']') END)) END,
      a -> concat(a.o, substring(text, a.p + 1)))""")
    got = docs.join(spans, docs["doc_id"].eqNullSafe(spans["d_"]) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == spans["k_"]), "left")
    return got.withColumn("text", F.when(F.col("spans_").isNull(), F.col("text")).otherwise(new)).select(docs.columns)


def op5_bootstrap_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = extract(C.table(spark, sf_dir, "documents"))
    return got.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_text([(k, k) for k in KINDS]), 256).alias("base_sha256"),
        _text([*((k, k) for k in KINDS), ("found", "id")]).alias("spans"),
    )
