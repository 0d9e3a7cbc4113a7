"""Keys, contexts and tokens as Spark column expressions; nothing here leaves the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def folded(c) -> Column:
    """Lower case, ё as е."""
    return F.translate(F.lower(_c(c)), "ё", "е")


def squashed(c) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(_c(c), r"(?U)\s+", " "))


def compact_key(c) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(folded(F.regexp_replace(_c(c), "­", "")), "[^0-9a-zа-я]", "")


def number_key(c, kind) -> Column:
    """Letters and digits of a number, in capitals; of a phone the last ten."""
    k = F.upper(F.regexp_replace(_c(c), "[^0-9A-Za-zА-ЯЁа-яё]", ""))
    return F.when(_c(kind) == "ТЕЛЕФОН", F.right(k, F.lit(10))).otherwise(k)


def org_merge_key(c) -> Column:
    """A company's letters and digits without its legal form."""
    t = F.regexp_replace(F.regexp_replace(_c(c), "­", ""), "(?<![А-ЯЁA-Z])(?:" + P.FORM_SHORT + ")(?![А-ЯЁA-Z])", " ")
    return compact_key(t)


def address_parts(c) -> Column:
    """Normalised parts: all words up to the house as one sorted bag, then house, block, flat in their order."""
    t = folded(c)
    t = F.regexp_replace(t, r"(?<![0-9])[0-9]{6}(?![0-9])", " ")
    t = F.regexp_replace(t, r"(?U)российская\s+федерация|\bрф\b|\bроссия\b", " ")
    for pattern, short in P.ADDRESS_ABBREVIATIONS:
        t = F.regexp_replace(t, "(?U)" + pattern, f" {short} ")
    t = F.regexp_replace(t, r"(?U)(?<![0-9a-zа-я])(" + "|".join(P.ADDRESS_UNITS) + r")(?=\s+\d)", ",$1")
    chunks = F.filter(F.transform(F.split(t, ","), lambda x: F.regexp_extract_all(x, F.lit("[0-9a-zа-я/]+"), 0)), lambda w: F.size(w) > 0)
    unit = lambda w: w[0].isin(*P.ADDRESS_UNITS) & F.coalesce(F.get(w, F.lit(1)).rlike("^[0-9]"), F.lit(False))
    empty = F.struct(F.array().cast("array<string>").alias("place"), F.array().cast("array<string>").alias("parts"))
    folded_ = F.aggregate(
        chunks, empty,
        lambda a, w: F.when(unit(w), F.struct(a["place"].alias("place"), F.concat(a["parts"], F.array(F.array_join(w, " "))).alias("parts")))
        .when(F.size(a["parts"]) > 0, F.struct(a["place"].alias("place"), F.concat(a["parts"], F.array(F.array_join(F.array_sort(w), " "))).alias("parts")))
        .otherwise(F.struct(F.concat(a["place"], w).alias("place"), a["parts"].alias("parts"))),
        lambda a: F.concat(F.when(F.size(a["place"]) > 0, F.array(F.array_join(F.array_sort(a["place"]), " "))).otherwise(F.array().cast("array<string>")), a["parts"]),
    )
    return folded_


def address_key(c) -> Column:
    return F.array_join(address_parts(c), ", ")


def surname_key(c) -> Column:
    """A surname without its case ending, by suffix rules."""
    w = folded(c)
    out = F.when(F.length(w) > 4, F.regexp_replace(w, "(?<=[бвгджзклмнпрстфхцчшщ])(?:а|у|ом|ем|е|ым)$", "")).otherwise(w)
    for pattern, to in reversed(P.SURNAME_SUFFIXES):
        out = F.when(w.rlike(pattern), F.regexp_replace(w, pattern, to)).otherwise(out)
    return out


def value_key(c, kind) -> Column:
    d = F.regexp_replace(_c(c), "[^0-9]", "")
    k = _c(kind)
    plain = F.regexp_replace(F.regexp_replace(folded(c), r"(?U)\s+", " "), "^[ .,;:]+|[ .,;:]+$", "")
    numbers = ("ИНН", "ОГРН", "ОГРНИП", "КПП", "РС", "КС", "БИК", "СНИЛС", "КАРТА", "ТЕЛЕФОН", "ОКПО", "ПОЛИС")
    return (
        F.when(k.isin(*numbers) & (d != ""), F.when(k == "ТЕЛЕФОН", F.right(d, F.lit(10))).otherwise(d))
        .when(k == "ЮЛ", F.array_join(F.regexp_extract_all(folded(c), F.lit("[a-zа-я0-9]+"), 0), " "))
        .when(k.isin("АДРЕС", "ADR"), address_key(c)).otherwise(plain)
    )


def merge_key(c, kind) -> Column:
    """Equal keys of one type are one entity. Persons have their own rule (``operators.entities``)."""
    k = _c(kind)
    plain = F.regexp_replace(F.regexp_replace(folded(c), r"(?U)\s+", " "), "^[ .,;:]+|[ .,;:]+$", "")
    return (
        F.when(k.isin(*P.NUMBER_TYPES), number_key(c, kind)).when(k == "EMAIL", F.lower(F.trim(_c(c))))
        .when(k.isin(*P.ORG_TYPES), org_merge_key(c)).when(k.isin(*P.ADDRESS_TYPES), address_key(c)).otherwise(plain)
    )


def short_form(c) -> Column:
    """A full legal form as its abbreviation; an abbreviation as it is; else empty."""
    t = squashed(c)
    out = F.when(t.rlike("^(?:" + P.FORM_SHORT + ")$"), t).otherwise(F.lit(""))
    for pattern, short in reversed(P.FORM_FULL_TO_SHORT):
        out = F.when(t.rlike("(?iU)^" + pattern), F.lit(short)).otherwise(out)
    return out


def left_context(text, start, n: int = 60) -> Column:
    """Up to n characters before a place counted from 0."""
    s = _c(start)
    return F.substring(_c(text), F.greatest(s - n, F.lit(0)) + 1, F.least(s, F.lit(n)))


def line_context(text, start, more: int = 0) -> Column:
    """From the start of the line, and ``more`` lines above, to a place counted from 0."""
    return F.substring_index(F.substring(_c(text), F.lit(1), _c(start)), "\n", -1 - more)


_ALL = sorted({*P.TOKEN_PREFIXES, *P.RUSSIAN_PREFIX}, key=lambda x: (-len(x), x))
LOOSE = r"(?iU)\[\s*(?:" + "|".join(_ALL) + r")[\s_\-]*\d+\s*\]|(?<![A-Za-zА-Яа-яЁё0-9_])(?:" + "|".join(_ALL) + r")[_\-]\d+(?!\d)"


def token_of(found) -> Column:
    """The canonical ``PREFIX_n`` of a loosely written token."""
    m = F.upper(_c(found))
    name = F.regexp_extract(m, "(?U)(" + "|".join(_ALL) + ")", 1)
    table = F.create_map(*[F.lit(x) for kv in P.RUSSIAN_PREFIX.items() for x in kv])
    return F.concat(F.coalesce(table[name], name), F.lit("_"), F.regexp_extract(m, "([0-9]+)", 1).cast("bigint").cast("string"))


def token_name(found: str) -> str:
    """``token_of`` of one token outside of columns."""
    m = re.search(f"({'|'.join(_ALL)})" + r"\D*(\d+)", found.upper())
    return f"{P.RUSSIAN_PREFIX.get(m[1], m[1])}_{int(m[2])}"


def tokens_in(text) -> Column:
    """Canonical tokens of a text, in order."""
    return F.transform(F.regexp_extract_all(_c(text), F.lit(LOOSE), 0), token_of)


def place_hash(text) -> Column:
    """SHA-1 of the text with tokens in canonical form and white space collapsed."""
    pieces, found = F.split(_c(text), LOOSE), F.regexp_extract_all(_c(text), F.lit(LOOSE), 0)
    whole = F.array_join(F.zip_with(pieces, found, lambda p, t: F.concat(F.coalesce(p, F.lit("")), F.coalesce(F.concat(F.lit("["), token_of(t), F.lit("]")), F.lit("")))), "")
    # most places have no sign of a token, and then the costly pattern isn't tried
    return F.sha1(squashed(F.when(_c(text).rlike(r"\[|[_\-][0-9]"), whole).otherwise(_c(text))))


def windows(text, size: int = 3000, overlap: int = 150, single: int = 3500) -> Column:
    """Overlapping windows of a long text: an array of (start, piece); one window up to ``single`` characters."""
    t = _c(text)
    n = F.length(t)
    starts = F.when(n <= single, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(size - overlap)))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.when(n <= single, t).otherwise(F.substring(t, s + 1, F.lit(size))).alias("piece")))
