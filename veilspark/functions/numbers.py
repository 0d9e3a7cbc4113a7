"""Check digits on Python strings, for use inside Arrow batches; the JVM's forms are in ``functions.validators``.

A number is a row: how long it is, how it may begin, and sums that must hold. A sum weighs the leading digits, is reduced
by its moduli one after the other, and must equal the digits that follow.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from . import validators as V


def digits(s: str) -> str:
    return "".join(c for c in s if c.isdecimal())


@dataclass(frozen=True)
class Sum:
    weights: tuple[int, ...]
    moduli: tuple[int, ...]
    checked: int = 1

    def holds(self, d: str) -> bool:
        n = len(self.weights)
        total = sum(w * int(c) for w, c in zip(self.weights, d))
        for m in self.moduli:
            total %= m
        return total == int(d[n : n + self.checked])


def _whole(n: int, modulus: int) -> tuple[int, ...]:
    """Weights that make the sum the number of n digits itself, but for the modulus."""
    return tuple(pow(10, n - 1 - i, modulus) for i in range(n))


@dataclass(frozen=True)
class Number:
    length: int
    begins: str
    sums: tuple[Sum, ...]
    least: int = 0

    def holds(self, d: str) -> bool:
        return len(d) == self.length and d[0] in self.begins and int(d[: len(self.sums[0].weights)]) > self.least and all(s.holds(d) for s in self.sums)


# ---- Fixed values: lengths, first digits, weights and moduli of published check digits -------------------------------
NUMBERS = {
    "inn10": Number(10, "123456789", (Sum(tuple(V.W_INN10), (11, 10)),)),
    "inn12": Number(12, "123456789", (Sum(tuple(V.W_INN12_FIRST), (11, 10)), Sum(tuple(V.W_INN12_SECOND), (11, 10)))),
    "ogrn": Number(13, "1256", (Sum(_whole(12, 11), (11, 10)),)),
    "ogrnip": Number(15, "34", (Sum(_whole(14, 13), (13, 10)),)),
    "snils": Number(11, "0123456789", (Sum(tuple(range(9, 0, -1)), (101, 100), 2),), 1_001_998),
}
#: A digit's share of the card sum, by its value and whether its place counts twice.
CARD = tuple(tuple(2 * d - 9 * (d > 4) if twice else d for d in range(10)) for twice in (0, 1))


def holds(kind: str, value: str) -> bool:
    """Whether the value's digits are a number of this kind; ``inn`` is either length, ``luhn`` a card, ``iban`` an account."""
    if kind == "iban":
        v = re.sub(r"\s", "", value).upper()
        return bool(re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", v)) and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1
    d = digits(value)
    if kind == "luhn":
        return 13 <= len(d) <= 19 and sum(CARD[i % 2][int(c)] for i, c in enumerate(d[::-1])) % 10 == 0
    return any(NUMBERS[k].holds(d) for k in (("inn10", "inn12") if kind == "inn" else (kind,)))
