import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.llm import neardup_vectors, topk


@pytest.fixture(scope="module")
def odd_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((12, 16))
    rows = []
    for i in range(300):
        v = base[i % 12] + rng.standard_normal(16) * (0.02 if i % 3 else 1.0)
        rows.append((i, [float(x) for x in v], i % 2))
    rows += [(300, None, 1), (301, [], 1), (302, [float("nan")] * 16, 0), (303, [1.0, None], 0), (304, [0.0] * 16, 1), (305, rows[1][1], None), (306, rows[1][1], 1), (307, rows[1][1], 1), (350, rows[1][1], 0), (400, [float("inf")] * 16, 1), (None, rows[1][1], 1)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def good(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


@pytest.mark.parametrize("options", [{}, {"group": 37, "block": 2, "pivots": 5}])
def test_top_k_is_exact(odd_vectors, options):
    rows, df = odd_vectors
    q = {i: np.floor(256 * np.pad(np.array(v, float), (0, 16 - len(v)))) for i, v, _ in rows if i is not None and good(v)}
    want = {(a, r + 1, b, int(s)) for a in q if a % 50 == 0 for r, (s, b) in enumerate(sorted(((float(q[a] @ q[b]), b) for b in q if b != a), key=lambda x: (-x[0], x[1]))[:5])}
    got = {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, **options).collect()}
    assert got == want


def test_top_k_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0).collect())) == [(0, 1, 1, 128 * 256)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_clashing_columns_play_no_part(odd_vectors):
    df = odd_vectors[1].where("vec_id < 60")
    wide = df.selectExpr("vec_id", "embedding", "label", "1 AS score", "2 AS rank", "3 AS query_id", "4 AS pivot", "5 AS part", "'x' AS list", "6 AS rep", "7 AS node", "8 AS n_links", "9 AS kept")
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(topk.top_k(df, F.col("vec_id") % 50 == 0)) == rows(topk.top_k(wide, F.col("vec_id") % 50 == 0))
    assert rows(neardup_vectors.near_duplicates(df)) == rows(neardup_vectors.near_duplicates(wide))


def test_repeated_ids_with_other_vectors(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.99, 0.01], 1), (3, [0.01, 0.99], 1), (4, [-1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in neardup_vectors.near_duplicates(df).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 0, 4)]


def test_op10_query_recall_against_brute_force(spark, tmp_path):
    """Groups of near copies at all distances round the threshold: no wrong link, at least 0.9 of all."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((4000, 64))
    for i in range(2000):
        x[i] = x[2000 + i % 150] + rng.standard_normal(64) * rng.choice([0.05, 0.25, 0.35, 0.5])
    lab = rng.integers(0, 4, 4000)
    lab[:2000] = lab[2000 + np.arange(2000) % 150]
    spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, lab))], "vec_id long, embedding array<double>, label int").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.93) & (lab[:, None] == lab[None])
    np.fill_diagonal(links, False)
    got = neardup_vectors.op10_pq_neardup(spark, f"file://{tmp_path}").toPandas().set_index("vec_id").loc[range(4000)]
    assert (got.n_links.values <= links.sum(1)).all() and got.n_links.sum() >= 0.9 * links.sum() > 0


def test_op4_query_against_brute_force(spark):
    path = "/root/testdata/sf0.1"
    pdf = spark.read.parquet(f"{path}/embeddings.parquet").toPandas()
    q = np.floor(256 * np.stack(pdf.embedding).astype(float))
    top = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.op4_pivot_topk(spark, path).collect()}
    ask = np.flatnonzero(pdf.vec_id.values % 50 == 0)
    assert len(top) == 5 * len(ask)
    for a in ask:
        s = q @ q[a]
        order = [i for i in np.lexsort((pdf.vec_id.values, -s)) if i != a][:5]
        for k, i in enumerate(order):
            assert top[int(pdf.vec_id[a]), k + 1] == (int(pdf.vec_id[i]), int(s[i]))


def brute_links(rows, least=0.93):
    n = {}
    unit = []
    for i, v, lab in rows:
        x = np.pad(np.array(v, float), (0, 16 - len(v))) if good(v) else np.zeros(16)
        unit.append(x / np.linalg.norm(x) if np.linalg.norm(x) > 0 and lab is not None and i is not None else None)
    up = {i: i for i, _, _ in rows if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, _, la) in enumerate(rows):
        n[i] = 0
        for b, (j, _, lb) in enumerate(rows):
            if a != b and unit[a] is not None and unit[b] is not None and la == lb and unit[a] @ unit[b] >= least:
                n[i] += 1
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: (n[i], i if i is None else root(i)) for i in n}


@pytest.mark.parametrize("options", [{"lists": 8, "probes": 8}, {"lists": 8, "probes": 8, "tile": 7}, {"lists": 16, "probes": 6}])
def test_near_duplicates(odd_vectors, options):
    rows, df = odd_vectors
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neardup_vectors.near_duplicates(df, **options).collect()}
    want = brute_links(rows)
    assert got.keys() == want.keys()
    if options["probes"] == options["lists"]:
        assert got == want
    else:
        assert sum(v[0] for v in got.values()) >= 0.95 * sum(v[0] for v in want.values())
        assert all(got[i][0] <= want[i][0] for i in want)


def test_near_duplicates_empty(odd_vectors):
    assert neardup_vectors.near_duplicates(odd_vectors[1].limit(0)).count() == 0
