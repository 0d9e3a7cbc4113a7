"""Sharding by fixed virtual slots.

Every record hashes (by its id) into one of ``slots`` virtual slots, bytes are summed a slot, and a small versioned map
gives each slot's shard. Version 1 deals the slots out in turn, knowing no sizes; ``rebalance`` edits a map by measured
bytes, moving only as many slots as the balance needs; every version is stored, and records are placed by the stored one.
A slot heavier than ``1 / PIECES`` of a mean shard (one id that repeats, say) is divided: its records are dealt to pieces by
place in the input, and each piece is moved like a slot. What comes to the driver is a row a slot or piece: at most
``slots + PIECES * shards`` rows, whatever the input. Records carry ids and sizes only, never text, through the one shuffle.

Law: ``bytes``. A record's place in its shard is the rows of the shard's earlier pieces plus its rank in its own, so no task
ever holds a shard or a hot id. Defined results: null text has no bytes (size 16, CRC 0); repeated rows have a place each
(ties by size, then CRC, then place in the input); a null id hashes like any value; an empty table gives no rows; a record
larger than a mean shard is never cut; extra columns play no part.
"""

from __future__ import annotations

import heapq
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

SLOTS, SHARDS, PIECES = 4096, 40, 50


def slot_of(col: str = "doc_id", slots: int = SLOTS):
    return F.pmod(F.xxhash64(F.col(col)), F.lit(slots)).cast("int")


def first_map(shards: int, slots: int = SLOTS) -> dict:
    """Version 1: the slots in turn. ``map``: the shard of each slot; ``divided``: those of a divided slot's pieces."""
    return {"version": 1, "shards": shards, "slots": slots, "map": [s % shards for s in range(slots)], "divided": {}}


def rebalance(old: dict, sizes: dict[tuple[int, int], int], shards: int, slack: float = 0.001) -> dict:
    """The next version for new sizes, by (slot, piece), or another number of shards.

    Pieces move only from shards over the mean by more than ``slack``, or from removed ones: the fewest that bring a shard
    to the mean, the largest that fit first, each onto the lightest shard.
    """
    many: dict[int, int] = {}
    for s, k in sizes:
        many[s] = max(many.get(s, 1), k + 1)
    place = {}
    for s in range(old["slots"]):
        was = old["divided"].get(str(s), [old["map"][s]])
        for k in range(many.get(s, 1)):
            place[s, k] = was[k] if k < len(was) else (was[0] + k) % shards
    held: dict[int, list] = {k: [] for k in range(shards)}
    homeless = []
    for p, k in place.items():
        (held[k] if k < shards else homeless).append(p)
    load = {k: sum(sizes.get(p, 0) for p in v) for k, v in held.items()}
    mean = sum(sizes.values()) / shards
    for k in range(shards):
        if load[k] <= (1 + slack) * mean:
            continue
        for p in sorted(held[k], key=lambda p: (-sizes.get(p, 0), p)):
            if 0 < sizes.get(p, 0) <= load[k] - mean:
                load[k] -= sizes[p]
                homeless.append(p)
    heap = [(x, k) for k, x in load.items()]
    heapq.heapify(heap)
    for p in sorted(homeless, key=lambda p: (-sizes.get(p, 0), p)):
        x, k = heapq.heappop(heap)
        place[p] = k
        heapq.heappush(heap, (x + sizes.get(p, 0), k))
    divided = {str(s): [place[s, k] for k in range(n)] for s, n in sorted(many.items()) if n > 1}
    return {"version": old["version"] + 1, "shards": shards, "slots": old["slots"], "map": [place[s, 0] for s in range(old["slots"])], "divided": divided}


def save_map(spark: SparkSession, shard_map: dict, path: str) -> None:
    """One JSON row a version, appended, so that older versions stay readable."""
    spark.createDataFrame([(shard_map["version"], json.dumps(shard_map))], "version int, body string").write.mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> dict:
    rows = spark.read.parquet(path)
    rows = rows.where(F.col("version") == version) if version is not None else rows.orderBy(F.desc("version"))
    return json.loads(rows.first()["body"])


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    return docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), slot_of(slots=slots).alias("vslot"), F.monotonically_increasing_id().alias("seen"))


def heavy(rows: DataFrame, shards: int) -> dict[int, int]:
    """Into how many pieces each slot that is too heavy for a whole is divided."""
    each = {r["vslot"]: r["b"] for r in rows.groupBy("vslot").agg(F.sum("size").alias("b")).collect()}
    limit = max(1, sum(each.values()) // (shards * PIECES))
    return {s: -(-b // limit) for s, b in each.items() if b > limit and b > 2 * sum(each.values()) // max(1, len(each))}


def assign(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, shard_map: dict | None = None, path: str | None = None) -> tuple[DataFrame, dict]:
    """(rows with shard and place, the map's new version), which edits ``shard_map`` (version 1 if None) by the records' bytes.

    Both versions are stored at ``path``, or a new folder beside the intermediates.
    """
    spark, rows = docs.sparkSession, C.materialize(records(docs, slots), "slot-records")
    cut = heavy(rows, shards)
    parts = spark.createDataFrame(sorted(cut.items()), "vslot int, parts long")
    rows = rows.join(F.broadcast(parts), "vslot", "left").withColumn("piece", F.pmod(F.col("seen"), F.coalesce("parts", F.lit(1))).cast("int"))
    each = {(r["vslot"], r["piece"]): (r["n"], r["b"]) for r in rows.groupBy("vslot", "piece").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()}
    path = path or f"{C.shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    old = shard_map or first_map(shards, slots)
    if shard_map is None:
        save_map(spark, old, path)
    sizes = {(s, k): 0 for s, n in cut.items() for k in range(n)} | {p: b for p, (_, b) in each.items()}
    save_map(spark, rebalance(old, sizes, shards), path)
    new = load_map(spark, path)
    before, filled = [], [0] * shards
    for p in sorted(each):
        shard = new["divided"][str(p[0])][p[1]] if str(p[0]) in new["divided"] else new["map"][p[0]]
        before.append((*p, shard, filled[shard]))
        filled[shard] += each[p][0]
    small = spark.createDataFrame(before, "vslot int, piece int, shard int, base long")
    w = Window.partitionBy("vslot", "piece").orderBy("doc_id", "size", "text_crc32", "seen")
    out = rows.withColumn("rank", F.row_number().over(w)).join(F.broadcast(small), ["vslot", "piece"])
    return out.withColumn("slot", F.col("base") + F.col("rank") - 1).drop("base", "rank", "seen", "parts"), new


def write_shards(docs: DataFrame, shard_map: dict, path: str) -> None:
    """The records themselves, one folder a shard; a task writes the slots that fall to it, so no task holds a shard.

    Records of divided slots are dealt by place in the input, so they fall as in ``assign`` if the table is read from the same files.
    """
    places = [(s, k, x) for s, home in enumerate(shard_map["map"]) for k, x in enumerate(shard_map["divided"].get(str(s), [home]))]
    place = F.broadcast(docs.sparkSession.createDataFrame(places, "vslot int, piece int, shard int"))
    many = F.broadcast(docs.sparkSession.createDataFrame([(int(s), len(x)) for s, x in shard_map["divided"].items()], "vslot int, parts int"))
    slotted = docs.withColumns({"vslot": slot_of(slots=shard_map["slots"]), "seen": F.monotonically_increasing_id()}).join(many, "vslot", "left")
    slotted = slotted.withColumn("piece", F.pmod("seen", F.coalesce("parts", F.lit(1))).cast("int")).drop("seen", "parts")
    slotted.join(place, ["vslot", "piece"]).repartition("vslot", "piece").write.partitionBy("shard").parquet(path)


def op8_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = assign(C.table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot", "piece")
