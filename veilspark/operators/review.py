"""Review of found values by a model that is handed in: what it is asked, and what of its answer is taken.

A model is a function of DataFrame to DataFrame (session_id, part, found, lines) to (session_id, part, answer), the answer
being JSON; none is built in. Its proposals are checked by the rules here, so a wrong answer can't unmask a name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import render as R
from . import entities

KINDS, BATCH, BLOCKS, BLOCK = ("ФИО", "ЮЛ", "АДРЕС"), 40, 3, 4000
ANSWER = "drop array<int>, merge array<array<int>>, add array<struct<text:string,type:string>>"
# The model's names of types.
TYPES = {
    "FIO": "ФИО", "YUL": "ЮЛ", "ADDR": "АДРЕС", "ADDR_PHYS": "АДРЕС", "ADDR_CORP": "АДРЕС", "PASSPORT": "ПАСПОРТ", "DOB": "ДАТАРОЖД", "PHONE": "ТЕЛЕФОН", "PHONE_NUMBER": "ТЕЛЕФОН", "TEL": "ТЕЛЕФОН",
    "EMAIL": "EMAIL", "INN": "ИНН", "OGRN": "ОГРН", "ACCOUNT": "РС",
}


def entries(mappings: DataFrame, texts: DataFrame, size: int = BATCH) -> DataFrame:
    """(session_id, part, i, token, type, value, context): the first form of each token of the three kinds, in batches.

    mappings: session_id, id, token, original_form, entity_type; texts: session_id, text (one a session).
    """
    first = mappings.where(F.col("entity_type").isin(*KINDS)).groupBy("session_id", "token").agg(F.min(F.struct("id", "entity_type", "original_form")).alias("m"))
    w = Window.partitionBy("session_id").orderBy("id")
    rows = first.select("session_id", "token", F.col("m.id").alias("id"), F.col("m.entity_type").alias("type"), F.col("m.original_form").alias("value")).withColumn("n", F.row_number().over(w) - 1)
    rows = rows.join(texts.select("session_id", "text"), "session_id", "left").withColumn("context", R.context_line(F.coalesce("text", F.lit("")), "value"))
    return rows.select("session_id", F.floor(F.col("n") / size).cast("int").alias("part"), (F.col("n") % size + 1).cast("int").alias("i"), "token", "type", "value", "context")


def blocks(masked: DataFrame, size: int = BLOCK, most: int = BLOCKS) -> DataFrame:
    """(session_id, part, lines): suspicious lines of a session's masked text in blocks of about ``size`` characters."""
    lines = F.filter(F.transform(F.split("text", "\n"), F.trim), L.suspicious)
    start = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))

    def step(a, x):
        full = (F.length(a["cur"]) + F.length(x) > size) & (a["cur"] != "")
        return F.struct(F.when(full, F.concat(x, F.lit("\n"))).otherwise(F.concat(a["cur"], x, F.lit("\n"))).alias("cur"), F.when(full, F.concat(a["out"], F.array(a["cur"]))).otherwise(a["out"]).alias("out"))

    packed = F.aggregate(lines, start, step, lambda a: F.when(a["cur"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(a["cur"]))))
    return masked.select("session_id", F.posexplode(F.slice(packed, 1, most)).alias("part", "lines"))


def requests(found: DataFrame, lines: DataFrame) -> DataFrame:
    """(session_id, part, found, lines): one request a batch and a block; what there is more of goes alone."""
    one = F.concat(F.col("i").cast("string"), F.lit(". «"), F.col("value"), F.lit("» — контекст: "), F.when(F.col("context") == "", "-").otherwise(F.col("context")))
    listed = found.groupBy("session_id", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", one.alias("t")))), lambda x: x["t"]), "\n").alias("found"))
    return listed.join(lines, ["session_id", "part"], "full").na.fill("-", ["found", "lines"])


def proposals(found: DataFrame, answers: DataFrame, masked: DataFrame, mappings: DataFrame) -> DataFrame:
    """(session_id, op, token, into, value, type): what of the answers holds: ``remove`` and ``merge`` of found values,
    ``add`` of missed ones.

    Numbers outside the batch are dropped; nothing like a name is unmasked; persons merge only if their surnames agree and
    nothing contradicts; a pair is proposed once, and never with a token to be removed. Added texts must stand in the
    masked text, be new, of a known type and shape.
    """
    a = answers.select("session_id", "part", F.from_json("answer", ANSWER).alias("a"))
    drop = a.select("session_id", "part", F.explode("a.drop").alias("i")).join(found, ["session_id", "part", "i"]).where(L.safe_to_unmask("value", "type"))
    drop = drop.select("session_id", F.lit("remove").alias("op"), "token", F.lit(None).cast("string").alias("into"), L.category("value").alias("value"), "type").distinct()
    pair = a.select("session_id", "part", F.explode("a.merge").alias("m")).where("size(m) = 2 AND m[0] <> m[1]").select("session_id", "part", F.expr("m[0]").alias("i"), F.expr("m[1]").alias("j"))
    left = found.select("session_id", "part", "i", F.col("token").alias("ta"), F.col("type").alias("ka"), F.col("value").alias("va"))
    right = found.select("session_id", "part", F.col("i").alias("j"), F.col("token").alias("tb"), F.col("type").alias("kb"), F.col("value").alias("vb"))
    pair = pair.join(left, ["session_id", "part", "i"]).join(right, ["session_id", "part", "j"]).where("ka = kb AND ta <> tb").withColumns({"pa": entities.person("va"), "pb": entities.person("vb")})
    pair = pair.where((F.col("ka") != "ФИО") | (F.col("pa.surname").isNotNull() & F.coalesce(F.col("pa.surname") == F.col("pb.surname"), F.lit(False)) & entities.compatible(F.col("pa"), F.col("pb"))))
    pair = pair.groupBy("session_id", F.least("ta", "tb").alias("x"), F.greatest("ta", "tb").alias("y")).agg(F.min(F.struct("part", "i", "ta", "tb", "ka")).alias("m")).select("session_id", "m.*")
    gone = drop.select("session_id", F.col("token").alias("g")).distinct()
    pair = pair.join(gone.withColumnRenamed("g", "ta"), ["session_id", "ta"], "left_anti").join(gone.withColumnRenamed("g", "tb"), ["session_id", "tb"], "left_anti")
    merge = pair.select("session_id", F.lit("merge").alias("op"), F.col("ta").alias("token"), F.col("tb").alias("into"), F.lit(None).cast("string").alias("value"), F.col("ka").alias("type"))
    table = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    add = a.select("session_id", F.explode("a.add").alias("e")).select("session_id", F.trim("e.text").alias("value"), table[F.upper("e.type")].alias("type")).where("type IS NOT NULL AND length(value) >= 3").distinct()
    add = add.join(masked.select("session_id", "text"), "session_id").where(F.contains("text", "value") & ~F.col("value").rlike(r"\[[A-Z]+_\d+"))
    add = add.join(mappings.select("session_id", F.col("original_form").alias("value")), ["session_id", "value"], "left_anti")
    w = F.filter(L.words_of("value"), lambda x: F.length(x) > 1)
    shaped = (
        ~L.not_pii("value", "type") & ~L.role_or_position("value") & ~L.public_body("value") & ((F.col("type") != "ФИО") | ((F.size(w) > 0) & F.forall(w, L.name_like)))
        & (~F.col("type").isin("ТЕЛЕФОН", "ИНН", "ОГРН", "РС") | (F.length(F.regexp_replace("value", "[^0-9]", "")) >= 7)) & ((F.col("type") != "ДАТАРОЖД") | L.birth_near("text", "value"))
    )
    add = add.where(shaped).select("session_id", F.lit("add").alias("op"), F.lit(None).cast("string").alias("token"), F.lit(None).cast("string").alias("into"), "value", "type")
    return drop.unionByName(merge).unionByName(add)


def review(mappings: DataFrame, texts: DataFrame, masked: DataFrame, model: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Proposals for a person to judge, from one model request a batch."""
    found = entries(mappings, texts)
    return proposals(found, model(requests(found, blocks(masked))), masked, mappings)


def shown(proposed: DataFrame, mappings: DataFrame) -> DataFrame:
    """Proposals with the values of their tokens beside them; those of tokens that a session no longer has go."""
    forms = mappings.groupBy("session_id", "token").agg(F.min_by("original_form", "id").alias("form"))
    first = proposed.join(forms.withColumnRenamed("form", "token_value"), ["session_id", "token"], "left")
    both = first.join(forms.withColumnsRenamed({"token": "into", "form": "into_value"}), ["session_id", "into"], "left")
    whole = F.when(F.col("op") == "add", F.lit(True)).when(F.col("op") == "merge", F.col("token_value").isNotNull() & F.col("into_value").isNotNull()).otherwise(F.col("token_value").isNotNull())
    return both.where(whole).select("session_id", "op", "token", "into", F.coalesce("token_value", "value").alias("value"), "into_value", "type")
