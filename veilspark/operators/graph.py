"""Durable intermediates and connected components."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a local master without one, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="veilspark-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def give_back(spark: SparkSession) -> None:
    """Let the driver's JVM return native memory that it has freed: what compiling hundreds of plans took stays in malloc's
    arenas (159 MB after the pipeline's ``ngram_jaccard`` on sf0.01). A JVM that can't do it is left as it is."""
    java, new = spark._jvm.java, spark.sparkContext._gateway.new_array
    try:
        beans = java.lang.management.ManagementFactory.getPlatformMBeanServer()
        kinds, args = new(java.lang.Class, 4), new(java.lang.Object, 4)
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = java.lang.Class.forName(kind)
        args[0], args[1] = spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # by the interface's method, as the server's own class isn't open to reflection
        java.lang.Class.forName("javax.management.MBeanServerConnection").getMethod("invoke", kinds).invoke(beans, args)
    except Py4JError:
        pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    give_back(spark)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores: a table in few files is dealt out, a large one is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small(df: DataFrame, name: str, most: int = 200_000) -> tuple[DataFrame, bool]:
    """(``df`` written down, whether it has at most ``most`` rows): what is broadcast is counted first."""
    df = materialize(df, name)
    return df, df.limit(most + 1).count() <= most


def numbered(df: DataFrame, keys: list[str], order: list, out: str) -> DataFrame:
    """``df`` with each row's number among those of its keys in this order, from 1.

    Rows are dealt by ranges of keys and order, numbered inside a range, and a range's rows come after those of the ranges
    before it; so a key that holds most of the rows is spread like all others, and sums are over a row a range and key.
    """
    ranged = df.withColumns({f"o{i}_": o if not isinstance(o, str) else F.col(o) for i, o in enumerate(order)})
    by = [f"o{i}_" for i in range(len(order))]
    ranged = materialize(ranged.repartitionByRange(*keys, *by).withColumn("range_", F.spark_partition_id()), "numbered")
    counts = ranged.groupBy(*keys, "range_").agg(F.count("*").alias("n_"))
    before = counts.withColumn("before_", F.coalesce(F.sum("n_").over(Window.partitionBy(*keys).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n_")
    inside = ranged.withColumn("in_", F.row_number().over(Window.partitionBy("range_", *keys).orderBy(*by)))
    same = F.lit(True)
    right = before.select(*[F.col(k).alias(f"k{i}_") for i, k in enumerate([*keys, "range_"])], "before_")
    for i, k in enumerate([*keys, "range_"]):
        same = same & F.col(k).eqNullSafe(F.col(f"k{i}_"))
    return inside.join(right, same).select(*df.columns, (F.col("before_") + F.col("in_")).alias(out))


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table that no frame reads any more, wherever it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def sweep(spark: SparkSession) -> int:
    """Delete all intermediates that this application wrote; frames that still read them can't be used afterwards."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        drop(spark, path)
    return len(paths)


def _to_least(pairs: DataFrame, total: int, hubs: int) -> DataFrame:
    """(u, v, m): every row (u, v) with the least v of its u. A u with more than ``2 * total / hubs`` rows meets its
    least v by broadcast and its rows are dealt by v; there are at most ``hubs`` of them, as rows are ``2 * total`` at most."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hot = low.where(F.col("n") > 2 * total / hubs).select("u", F.col("m").alias("hot"))
    dealt = pairs.join(F.broadcast(hot), "u", "left").withColumns({"h": F.col("hot").isNotNull(), "k": F.when(F.col("hot").isNull(), F.col("u")).otherwise(F.xxhash64("v").cast(pairs.schema["u"].dataType))})
    rest = low.select(F.lit(False).alias("h"), F.col("u").alias("k"), "m")
    return dealt.join(rest, ["h", "k"], "left").select("u", "v", F.coalesce("hot", "m").alias("m"))


def components(edges: DataFrame, src: str, dst: str, kind: str = "long", hubs: int = 1000) -> DataFrame:
    """(node, comp): the smallest node reachable, for every node of an undirected edge list.

    Alternating large-star and small-star steps: every step is a min aggregate and an equi-join, written to the shared
    folder; the step before it is deleted. Hubs are joined by broadcast (``_to_least``). Ends when the list doesn't change.
    """
    spark = edges.sparkSession
    a, b = F.col(src).cast(kind), F.col(dst).cast(kind)
    e = materialize(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "cc")

    def mark(e):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    state = mark(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        big = _to_least(both, state[0], hubs).withColumn("m", F.least("m", "u")).where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _to_least(big, state[0], hubs).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*")
        old, before = state, _written[spark.sparkContext.applicationId].pop()
        e = materialize(small.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
        state = mark(e)
        drop(spark, before)
        if state == old:
            break
    return e.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("node"), "comp").unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
