import os
import random
import re

import pytest

from veilspark.operators import graph


def brute(edges):
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {x: root(x) for e in edges if e[0] != e[1] for x in e}


@pytest.mark.parametrize("hubs", [1000, 10, 1])
def test_components(spark, hubs):
    """A path, two stars, random edges, loops and repeats; hubs or none of them are joined by broadcast."""
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(500, 501 + i) for i in range(80)] + [(900 - i, 901) for i in range(80)] + [(7, 7), (1, 2)]
    edges += [(1000 + rng.randrange(80), 1000 + rng.randrange(80)) for _ in range(60)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r["node"]: r["comp"] for r in graph.components(df, "a", "b", hubs=hubs).collect()} == brute(edges)
    assert graph.components(df.limit(0), "a", "b").count() == 0


def test_sweep_deletes_what_was_written(spark):
    df = graph.materialize(spark.range(5), "sweep-me")
    path = df.inputFiles()[0].removeprefix("file:").replace("//", "/")
    assert os.path.exists(path) and graph.sweep(spark) > 0 and not os.path.exists(path)


def test_numbers_follow_the_order(spark):
    """A key that holds nearly all rows, null keys, ties in other columns and structs as order."""
    from pyspark.sql import functions as F

    rng = random.Random(2)
    rows = [("hot" if i % 20 else rng.choice(["a", None]), rng.randrange(10**6), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, v int, i int").repartition(7)
    got = graph.numbered(df, ["k"], [F.struct("v", "i")], "n").collect()
    for k in ("hot", "a", None):
        want = sorted((v, i) for kk, v, i in rows if kk == k)
        assert [(r["v"], r["i"]) for r in sorted((r for r in got if r["k"] == k), key=lambda r: r["n"])] == want
        assert sorted(r["n"] for r in got if r["k"] == k) == list(range(1, len(want) + 1))


def test_materialize_gives_freed_native_memory_back(spark):
    """What the driver's JVM has freed, between pieces still in use, doesn't stay with it."""
    jvm = spark._jvm

    def anonymous():
        with open(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/smaps_rollup") as f:
            return int(re.search(r"\nPss_Anon:\s+(\d+)", f.read())[1]) / 1024

    graph.materialize(spark.range(5), "warm")
    before, made = anonymous(), [jvm.java.util.zip.Deflater() for _ in range(3000)]
    for i, d in enumerate(made):
        if i % 10:
            d.end()
    freed = anonymous() - before
    assert freed > 100
    graph.materialize(spark.range(5), "after")
    assert anonymous() - before < freed / 2
    for d in made:
        d.end()
