"""Best-fit-decreasing packing of indivisible groups into shards of near-equal bytes.

A group is all rows of one text. Groups of at least a fixed share of the bytes are items of their own;
there can't be more than the reciprocal of that share. All smaller groups are dealt by hash into a fixed
number of bundles, which are items too. So the items are bounded by two parameters, whatever the size
of the table, and are packed on the driver; the rows only follow their item.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridtide.llm.store import written

BUNDLES = 8192
LARGE_SHARE = 1 / 8192


def best_fit(items: list[tuple[int, str]], capacity: int) -> list[list[str]]:
    """Items (size, name), largest first, each into the open bin with the least room that still holds it.

    The bins' rooms are kept in order and searched by halving. An item above the capacity gets a bin of its own.
    """
    bins: list[list[str]] = []
    rooms: list[tuple[int, int]] = []
    for size, name in sorted(items, key=lambda x: (-x[0], x[1])):
        at = bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, number = rooms.pop(at)
        else:
            room, number = max(capacity, size), len(bins)
            bins.append([])
        bins[number].append(name)
        insort(rooms, (room - size, number))
    return bins


def pack(items: list[tuple[int, str]], shards: int) -> dict[str, int]:
    """At most `shards` bins of the least capacity for which best fit needs no more.

    Items larger than an even share of what is left get a bin of their own first.
    """
    left, placed, free = sorted(items, key=lambda x: (-x[0], x[1])), {}, shards
    while free > 1 and left and left[0][0] * free >= sum(size for size, _ in left):
        placed[left.pop(0)[1]] = shards - free
        free -= 1
    total, largest = sum(size for size, _ in left), left[0][0] if left else 0
    low, high = max(largest, -(-total // free)), max(largest, total)
    while low < high:
        middle = (low + high) // 2
        if len(best_fit(left, middle)) <= free:
            high = middle
        else:
            low = middle + 1
    for number, names in enumerate(best_fit(left, low)):
        placed |= {name: shards - free + number for name in names}
    return placed


def text_key():
    """128 bits and more of a text, the same for equal texts; null is a text of its own."""
    return F.concat_ws(":", F.hex(F.xxhash64(F.col("text"))), F.hex(F.xxhash64(F.lit("salt"), F.col("text"))), F.col("text").isNull().cast("string"))


def items_of(keyed: DataFrame) -> list[tuple[int, str]]:
    """Items (size, name) of rows with group_key, bundle and size: large groups, and bundles of the other groups."""
    groups = written(keyed.groupBy("group_key", "bundle").agg(F.sum("size").alias("size")), "shard-groups")
    total = groups.agg(F.sum("size")).first()[0] or 0
    large = F.col("size") > total * LARGE_SHARE
    named = groups.select(F.when(large, F.col("group_key")).otherwise(F.col("bundle")).alias("item"), "size")
    return [(r["size"], r["item"]) for r in named.groupBy("item").agg(F.sum("size").alias("size")).collect()]


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size (UTF-8 bytes + 1), text_crc32, law, shard, slot, grown_shard of every row; equal texts stay together.

    A null text has size 1 and checksum 0 and groups with other nulls. Repeated rows are rows of their
    own with slots of their own. Slots are numbered by hash range of the id within a shard, without
    gaps. Other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    crc = F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).cast("long")
    key = text_key()
    keyed = written(docs.select("doc_id", size.alias("size"), crc.alias("text_crc32"), key.alias("group_key"),
                                F.concat(F.lit("b"), F.pmod(F.xxhash64(key), F.lit(BUNDLES))).alias("bundle")), "shard-rows")
    placed = pack(items_of(keyed), shards)
    plan = spark.createDataFrame(list(placed.items()), "item string, shard int")
    own = plan.filter(~F.col("item").startswith("b")).select(F.col("item").alias("group_key"), F.col("shard").alias("own"))
    shared = plan.filter(F.col("item").startswith("b")).select(F.col("item").alias("bundle"), F.col("shard").alias("shared"))
    dealt = keyed.join(F.broadcast(own), "group_key", "left").join(F.broadcast(shared), "bundle", "left")
    return numbered(dealt.select("doc_id", "size", "text_crc32", F.coalesce("own", "shared").alias("shard")))


def numbered(dealt: DataFrame) -> DataFrame:
    """Adds slots: rows of a shard by hash range; the ranges' counts give each range its first slot."""
    rows = written(dealt, "shard-dealt")
    ranges = max(64, -(-rows.count() // 65_536))
    rows = rows.withColumn("range", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(ranges)))
    counts = rows.groupBy("shard", "range").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("shard").orderBy("range")
    offsets = counts.select("shard", "range", (F.sum("n").over(upto) - F.col("n")).alias("offset"))
    inside = Window.partitionBy("shard", "range").orderBy("doc_id", "text_crc32", "size")
    placed = rows.withColumn("place", F.row_number().over(inside) - 1).join(offsets, ["shard", "range"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                         (F.col("offset") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
