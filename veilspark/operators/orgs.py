"""Further names of known companies and persons: abbreviations, distinctive words, lone surnames, plates in pictures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import patterns as P
from ..functions import text as T
from . import entities

ABBREVIATION = r"\[(YUL_\d+)\]»?[^\[\]\n(]{0,40}?\(([A-ZА-ЯЁ][A-ZА-ЯЁ0-9&\-]{1,8})\)"
CAPITALISED = r"(?<![\p{L}0-9_\[])(?:[А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)?|[А-ЯЁ]{3,})(?![\p{L}0-9_\]])"


def abbreviations(masked: DataFrame, text: str = "masked") -> DataFrame:
    """(session_id, value, token): what stands in brackets behind a masked company, unless it is a legal form."""
    found = masked.select("session_id", F.explode(F.arrays_zip(F.regexp_extract_all(text, F.lit(ABBREVIATION), 1).alias("token"), F.regexp_extract_all(text, F.lit(ABBREVIATION), 2).alias("value"))).alias("x"))
    found = found.select("session_id", "x.value", "x.token").where(~F.col("value").rlike("^(?:" + P.SHORT_FORMS + ")$"))
    return found.groupBy("session_id", "value").agg(F.min("token").alias("token"))


def company_words(mappings: DataFrame) -> DataFrame:
    """(session_id, value, token): distinctive words of companies' forms, Latin or abbreviations, never corporate nouns.

    A word of several companies goes to the lowest token. mappings: session_id, token, original_form, entity_type.
    """
    w = mappings.where(F.col("entity_type").isin(*P.ORG_TYPES)).select("session_id", "token", F.explode(F.regexp_extract_all("original_form", F.lit(r"[A-Za-zА-ЯЁа-яё][A-Za-zА-ЯЁа-яё0-9&\-]*"), 0)).alias("value"))
    latin, abbr = F.col("value").rlike(r"^[A-Z][\x00-\x7f]+$"), F.col("value").rlike(r"^[A-ZА-ЯЁ0-9&\-]{3,8}$")
    w = w.where((F.length("value") >= 2) & ~F.col("value").isin(*P.GENERIC_LATIN) & ~F.col("value").rlike("^(?:" + P.SHORT_FORMS + ")$") & (latin | abbr))
    return w.groupBy("session_id", "value").agg(F.min_by("token", F.struct(entities.token_number("token"), "token")).alias("token"))


def known_surnames(mappings: DataFrame) -> DataFrame:
    """(session_id, surname, token): surnames that exactly one person of the session has."""
    p = mappings.where(F.col("entity_type").isin(*P.PERSON_TYPES)).select("session_id", "token", entities.person("original_form")["surname"].alias("surname"))
    p = p.where(F.length("surname") >= 3).groupBy("session_id", "surname").agg(F.min("token").alias("token"), F.max("token").alias("last"))
    return p.where("token = last").drop("last")


def lone_surnames(texts: DataFrame, mappings: DataFrame, text: str = "text") -> DataFrame:
    """(session_id, value, token): capitalised words whose surname key is that of exactly one known person; no first
    names, no patronymics, nothing that doesn't end like a surname."""
    words = texts.select("session_id", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(CAPITALISED), 0))).alias("value")).distinct()
    low = T.folded("value")
    words = words.where(low.rlike(P.SURNAME_END.replace("ё", "е")) & ~low.isin(*L._FORMS) & ~low.rlike("^[а-я]{3,}" + P.PATRONYMIC.replace("ё", "") + "$"))
    return words.withColumn("surname", T.surname_key("value")).join(known_surnames(mappings), ["session_id", "surname"]).select("session_id", "value", "token")


def plates_in_pictures(lines: DataFrame, text: str = "text") -> DataFrame:
    """``lines`` with ``plate``: a plate's series in a recognised line, with what is left of the line if that is short."""
    found = F.regexp_extract(text, "(?i)" + P.PLATE_SERIES, 0)
    at = F.call_function("locate", found, F.col(text), F.lit(1))
    rest = F.substring(F.col(text), at, F.length(text))
    return lines.withColumn("plate", F.when(found == "", None).when(F.length(rest) <= 14, F.trim(rest)).otherwise(found))
