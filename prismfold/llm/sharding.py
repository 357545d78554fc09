"""Minimax contiguous partition of documents into shards.

Equal texts form atomic groups, in the order of their smallest ids. The smallest feasible shard capacity is
found by binary search; a capacity is checked by cutting greedily; the cuts of the smallest one are the result.

Groups are sorted by range and summed in leaves of at most `LEAF` groups, and leaves in branches of at most
`BRANCH`; Spark makes both sums. The driver holds the sums of the branches; a check walks them and goes down only
at its cuts, to the leaf sums of one branch and the groups of one leaf, which are read when first needed and then
kept. Nearby capacities cut in the same leaves, so a search reads few of them, and the driver never holds the
groups. A group's name is its smallest id with the hash of its text, which no two groups share. A cut is the name
of a group, so dealing rows to shards compares with at most shards - 1 names, and slots are counts per range.

Null text: no bytes, grouped with empty text. Null ids: ordered first. Repeated rows: rows of their own in the
same group. Different texts under one id: groups of their own, in the order of their hashes. Extra columns are ignored. A group larger than an equal share has a shard whose size is its own. Empty input: no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_key, materialise, shuffle_partitions

OVERHEAD = 16
#: Groups of a leaf, leaves of a branch.
LEAF, BRANCH = 512, 4096


class SumTree:
    """Prefix sums over ordered groups, by levels; `load(nodes)` gives the names and sums below each node of a level.

    The names of the last level are those of the groups.
    """

    def __init__(self, names: list, sums: list[int], load, depth: int = 3):
        self.load, self.depth, self.loads = load, depth, 0
        self.below = {(0, None): (names, np.cumsum(sums, dtype=np.int64))}
        self.total = int(self.below[0, None][1][-1])

    def down(self, reach: int) -> tuple[int, object, int]:
        """The first node or group that ends after `reach`: levels gone down, name, sum before it. Stops above what is not loaded."""
        node, before = None, 0
        for level in range(self.depth):
            if (level, node) not in self.below:
                return level, node, before
            names, ends = self.below[level, node]
            i = min(int(np.searchsorted(ends, reach - before, "right")), len(names) - 1)
            node, before = names[i], before + (int(ends[i - 1]) if i else 0)
        return self.depth, node, before

    def locate(self, reach: int, ahead: list[int]) -> tuple[object, int]:
        """Name of the first group that ends after `reach`, and the sum before it; what lies near `ahead` is loaded with it."""
        while (found := self.down(reach))[0] < self.depth:
            level = found[0]
            want = dict.fromkeys(node for at, node, _ in map(self.down, [reach, *ahead]) if at == level)
            self.loads += 1
            for node, (names, sums) in self.load(list(want), level).items():
                self.below[level, node] = (names, np.cumsum(sums, dtype=np.int64))
        return found[1:]

    def cuts(self, capacity: int, shards: int) -> list[tuple[object, int]] | None:
        """(group, bytes before it) of the first group of shards 1, 2, ...; None if more shards are needed."""
        at, out = 0, []
        for k in range(shards):
            if self.total - at <= capacity:
                return out
            if k == shards - 1:
                return None
            reach = at + capacity
            group, end = self.locate(reach, [min(reach + j * capacity, self.total - 1) for j in range(1, shards - k)])
            if end == at:
                return None  # a group alone exceeds the capacity
            at = end
            out.append((group, at))
        return None

    def smallest(self, shards: int, largest: int) -> tuple[int, list[tuple[object, int]]]:
        low = max(-(-self.total // shards), largest)
        high = low + largest  # a greedy cut at this capacity leaves no shard below the mean
        best = self.cuts(high, shards)
        while low < high:
            middle = (low + high) // 2
            found = self.cuts(middle, shards)
            if found is None:
                low = middle + 1
            else:
                high, best = middle, found
        return high, best or []


def shard_documents(docs: DataFrame, shards: int = 40, leaf: int = LEAF, branch: int = BRANCH, id_col: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, group_id (the smallest id of the equal texts), shard and slot of each document."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), id_key(id_col).alias("k"), (F.octet_length(text).cast("long") + OVERHEAD).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("h"))
    rows = materialise(rows, "shard-rows")
    groups = rows.groupBy("h").agg(F.min("k").alias("g"), F.sum("size").alias("s"), F.count("*").alias("n"))
    groups = materialise(groups, "shard-groups")
    total = groups.agg(F.max("s").alias("m"), F.count("*").alias("n")).first()
    if not total["n"]:
        return rows.select("doc_id", "size", "text_crc32", F.col("k").alias("group_id"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    parts = max(1, min(shuffle_partitions(spark), total["n"]))
    # Ranges are by the whole name: an id may belong to many texts.
    ordered = groups.select("g", "h", "s").repartitionByRange(parts, "g", "h").sortWithinPartitions("g", "h").withColumn("p", F.spark_partition_id())
    place = Window.partitionBy("p").orderBy("g", "h")
    ordered = materialise(ordered.withColumn("leaf", F.floor((F.row_number().over(place) - 1) / leaf)), "shard-groups-in-order")
    leaves = ordered.groupBy("p", "leaf").agg(F.sum("s").alias("s")).withColumn("branch", F.floor(F.col("leaf") / branch))
    leaves = materialise(leaves, "shard-leaves")
    branches = sorted((r["p"], r["branch"], r["s"]) for r in leaves.groupBy("p", "branch").agg(F.sum("s").alias("s")).collect())

    def load(nodes: list[tuple[int, int]], level: int) -> dict:
        table, own, below = (leaves, "branch", ["p", "leaf"]) if level == 1 else (ordered, "leaf", ["g", "h"])
        wanted = [F.struct(F.lit(p), F.lit(i).cast("long")) for p, i in nodes]
        found: dict[tuple, list] = {n: [] for n in nodes}
        for r in table.where(F.col("p").isin(sorted({p for p, _ in nodes})) & F.struct("p", own).isin(wanted)).select("p", own, F.struct(*below).alias("name"), "s").collect():
            found[r["p"], r[own]].append((tuple(bytes(x) if isinstance(x, bytearray) else x for x in r["name"]), r["s"]))
        return {n: tuple(zip(*sorted(x), strict=True)) for n, x in found.items()}

    tree = SumTree([b[:2] for b in branches], [b[2] for b in branches], load)
    _, cuts = tree.smallest(shards, total["m"])
    shard = F.lit(0)
    for (g, h), _ in cuts:
        shard = shard + ((F.col("g") > F.lit(g)) | (F.col("g") == F.lit(g)) & (F.col("h") >= F.unhex(F.lit(h.hex())))).cast("int")

    # One join brings the group to its rows; a group with many rows meets one row, so Spark may split it.
    members = rows.join(groups.select("h", "g"), "h").select("doc_id", "k", "size", "text_crc32", "g", "h")
    spread = members.repartitionByRange(parts, "g", "h", "k").withColumn("part", F.spark_partition_id())
    spread = materialise(spread.withColumn("shard", shard), "shard-members")
    counts = spread.groupBy("part", "shard").count()
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))  # at most parts + shards rows
    inner = Window.partitionBy("part", "shard").orderBy("g", "h", "k")
    return (
        spread.withColumn("i", F.row_number().over(inner))
        .join(F.broadcast(offsets), ["part", "shard"])
        .select("doc_id", "size", "text_crc32", F.col("g").alias("group_id"), "shard", (F.col("before") + F.col("i") - 1).alias("slot"))
    )
