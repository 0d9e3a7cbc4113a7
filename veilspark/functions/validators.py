"""Checksums of identifiers as Spark column expressions; all stay in the JVM.

Each takes a string column and gives a boolean, false for null. ``digits`` drops everything but 0-9. Weighted sums are a
fold over the digits' positions, so no row-wise Python is involved.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published weights of the checksums.
W_INN10 = (2, 4, 10, 3, 5, 9, 4, 6, 8)
W_INN12_FIRST = (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
W_INN12_SECOND = (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
W_ACCOUNT = (7, 1, 3)
# Digits a number may have right after its keyword.
KEYWORD_LENGTHS = {"ОГРН": (11, 15), "ОГРНИП": (13, 15), "ИНН": (10, 12), "КПП": (9, 9), "БИК": (9, 9)}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def digits(c) -> Column:
    return F.regexp_replace(_col(c), "[^0-9]", "")


def digit(c: Column, at: int) -> Column:
    return F.substring(c, at + 1, 1).try_cast("int")


def weighted(c: Column, weights, start: int = 0) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights):
        total = total + digit(c, start + i) * w
    return total


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def inn10(c) -> Column:
    d = digits(c)
    return _sure((F.length(d) == 10) & (F.substring(d, 1, 1) != "0") & (weighted(d, W_INN10) % 11 % 10 == digit(d, 9)))


def inn12(c) -> Column:
    d = digits(c)
    return _sure((F.length(d) == 12) & (F.substring(d, 1, 1) != "0") & (weighted(d, W_INN12_FIRST) % 11 % 10 == digit(d, 10)) & (weighted(d, W_INN12_SECOND) % 11 % 10 == digit(d, 11)))


def inn(c) -> Column:
    return inn10(c) | inn12(c)


def ogrn(c) -> Column:
    d = digits(c)
    return _sure((F.length(d) == 13) & F.substring(d, 1, 1).isin("1", "2", "5", "6") & (F.substring(d, 1, 12).try_cast("bigint") % 11 % 10 == digit(d, 12)))


def ogrnip(c) -> Column:
    d = digits(c)
    return _sure((F.length(d) == 15) & F.substring(d, 1, 1).isin("3", "4") & (F.substring(d, 1, 14).try_cast("bigint") % 13 % 10 == digit(d, 14)))


def snils(c) -> Column:
    d = digits(c)
    rest = weighted(d, range(9, 0, -1)) % 101
    return _sure((F.length(d) == 11) & (F.substring(d, 1, 9).try_cast("bigint") > 1001998) & (F.when(rest == 100, 0).otherwise(rest) == F.substring(d, 10, 2).try_cast("int")))


def luhn(c) -> Column:
    d = digits(c)
    return _sure(F.length(d).between(13, 19) & F.call_function("luhn_check", d))


def iban(c) -> Column:
    """Country, check digits and 11 to 30 more; the rotated number is 1 modulo 97, folded character by character."""
    s = F.upper(F.regexp_replace(_col(c), r"\s", ""))
    turned = F.concat(F.substring(s, 5, 100), F.substring(s, 1, 4))
    value = F.aggregate(
        F.split(turned, ""), F.lit(0),
        lambda a, x: F.when(x == "", a).when(x.rlike("[0-9]"), (a * 10 + x.try_cast("int")) % 97).otherwise((a * 100 + F.ascii(x) - 55) % 97),
    )
    return _sure(s.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (value == 1))


def account_with_bik(account, bik) -> Column:
    a, b = digits(account), digits(bik)
    # a correspondent account is checked with the region of the bank's code, others with its last digits
    whole = F.concat(F.when(F.substring(a, 1, 3) == "301", F.concat(F.lit("0"), F.substring(b, 5, 2))).otherwise(F.substring(b, 7, 3)), a)
    return _sure((F.length(a) == 20) & (F.length(b) == 9) & (weighted(whole, [W_ACCOUNT[i % 3] for i in range(23)]) % 10 == 0))


def keyword_length(keyword, number) -> Column:
    n, k = F.length(digits(number)), _col(keyword)
    ok = F.lit(False)
    for word, (lo, hi) in KEYWORD_LENGTHS.items():
        ok = ok | ((k == word) & n.between(lo, hi))
    return _sure(ok)


def _check(total: Column, modulus: int = 11) -> Column:
    return (total % modulus % 10).cast("string")


def completed(kind: str, body) -> Column:
    """A number's body with its check digits, so that it is valid: inn10 (9 digits), inn12 (10), ogrn (12), ogrnip (14),
    snils (9, written with its signs). For test tables."""
    b = _col(body)
    if kind == "inn10":
        return F.concat(b, _check(weighted(b, W_INN10)))
    if kind == "inn12":
        first = F.concat(b, _check(weighted(b, W_INN12_FIRST)))
        return F.concat(first, _check(weighted(first, W_INN12_SECOND)))
    if kind in ("ogrn", "ogrnip"):
        return F.concat(b, _check(b.cast("bigint"), 11 if kind == "ogrn" else 13))
    rest = weighted(b, range(9, 0, -1)) % 101
    return F.concat_ws("-", F.substring(b, 1, 3), F.substring(b, 4, 3), F.concat(F.substring(b, 7, 3), F.lit(" "), F.lpad(F.when(rest == 100, 0).otherwise(rest).cast("string"), 2, "0")))


def completed_account(body, bik) -> Column:
    """An account of 20 digits whose ninth, the key, agrees with the bank's code."""
    a, b = digits(body), digits(bik)
    blank = F.concat(F.substring(a, 1, 8), F.lit("0"), F.substring(a, 10, 11))
    whole = F.concat(F.when(F.substring(a, 1, 3) == "301", F.concat(F.lit("0"), F.substring(b, 5, 2))).otherwise(F.substring(b, 7, 3)), blank)
    key = weighted(whole, [W_ACCOUNT[i % 3] for i in range(23)]) * 3 % 10
    return F.concat(F.substring(a, 1, 8), key.cast("string"), F.substring(a, 10, 11))
