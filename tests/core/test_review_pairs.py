import random
import threading

import pytest

from veilspark.operators import entities

SCHEMA = "session_id string, token string, original_form string, entity_type string, status string"


def within(a, b, d):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1] <= d


def pairs_of(spark, rows):
    m = spark.createDataFrame([(s, t, f, "ЮЛ", "active") for s, t, f in rows], SCHEMA)
    return sorted(tuple(r) for r in entities.review_pairs(m).select("session_id", "a", "b").collect())


@pytest.mark.parametrize("lengths", [(4, 9), (14, 18), (21, 28), (31, 34)])
def test_typos_are_those_of_brute_force(spark, lengths):
    """Around lengths where the number of edits and the way to find pairs change; a pair comes once."""
    r = random.Random(7)
    names = {"".join(r.choice("ab") for _ in range(r.randint(*lengths))) for _ in range(12)}
    for s in sorted(names):
        for _ in range(5):
            t = list(s)
            for _ in range(r.randint(1, len(s) // 8 + 1)):
                i, kind = r.randrange(len(t)), r.randrange(3)
                t[i : i + (kind != 1)] = [] if kind == 0 and len(t) > 4 else [r.choice("abc")]
            names.add("".join(t))
    rows = [(s, f"YUL_{i}", x) for s in ("1", "2") for i, x in enumerate(sorted(names))]
    want = sorted((s, min(t, u), max(t, u)) for s, t, x in rows for z, u, y in rows if s == z and x < y and within(x, y, max(1, min(len(x), len(y)) // 8)))
    assert want and pairs_of(spark, rows) == want


def test_a_name_of_many_tokens(spark):
    """Tokens of one name come in several blocks; each pair of tokens of near names comes once, none of one name."""
    rows = [("1", f"YUL_{k}_{i}", name) for k, name in enumerate(("вектортрейд", "вектортрейт", "меридиан")) for i in range((600, 3, 300)[k])]
    found = pairs_of(spark, rows)
    assert len(found) == len(set(found)) == 600 * 3 and {a[:5] + b[:5] for _, a, b in found} == {"YUL_0YUL_1"}


def test_names_with_a_common_beginning(spark):
    """Thousands of keys that share all pieces but the last are not compared two by two."""
    r = random.Random(3)
    codes = r.sample(range(10**9), 6000)
    rows = [("1", f"YUL_{i}", f"Supplier000{c % 10**6:06d}{c // 10**6:03d}") for i, c in enumerate(codes)]
    stop = threading.Timer(90, spark.sparkContext.cancelAllJobs)
    stop.start()
    try:
        found = pairs_of(spark, rows)
    finally:
        stop.cancel()
    by = {t: f for _, t, f in rows}
    assert all(within(by[a], by[b], 2) for _, a, b in found)
