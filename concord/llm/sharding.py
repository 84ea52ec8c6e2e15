"""Shards of nearly equal bytes by a k-d tree over metadata.

Every node of the tree is split at the weighted median (weights: bytes) along its widest dimension, relative to that
dimension's spread over all rows, until leaves reach the target. Medians are found on the whole table without sorting
it: each round counts the bytes in BINS bins of the range that is still open in each node (a partial aggregation; the
driver gets at most nodes x BINS sums) and goes on inside the bin that holds the median, until it is one value. Ties
along the dimension are cut by the hash of the text and then by that of the id. Equal texts have equal metadata, so they
share a shard; only a group of them that is larger than a whole shard is parted, by the hash of the id, because shards of
equal bytes cannot hold it otherwise. A group that lies on a cut goes to the side that leaves the smaller gap, and if
that is more than UNEVEN of the goal, the next widest dimensions are tried and the most even cut is taken.

Null texts weigh 1 byte, null dimensions are least, rows that repeat id and text are numbered one after the other.
Empty tables give empty tables. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.llm.common import query, stored, table

BINS = 1024
NUMBERED = 100_000
FINE, UNEVEN = 0.001, 0.02


@dataclass
class Cut:
    """A split: rows whose (dimension, text hash, id) is below the bounds go left."""

    dimension: str
    bounds: tuple[int, ...]


def _columns(dimension: str) -> tuple[str, ...]:
    return (dimension, "text_hash", "id_key")


def _left(cut: Cut) -> Column:
    """Whether a row goes left: order of the three columns, one after the other."""
    names = _columns(cut.dimension)[: len(cut.bounds)]
    out = F.lit(False)
    for name, bound in reversed(list(zip(names, cut.bounds))):
        out = (F.col(name) < bound) | ((F.col(name) == bound) & out)
    return out


def _ranges(rows: DataFrame, dimensions: list[str]) -> dict[int, dict]:
    """Per node: bytes, and least and largest value of each dimension and of the two columns that break ties."""
    names = [*dimensions, "text_hash", "id_key"]
    per_node = rows.groupBy("node").agg(F.sum("size").alias("bytes"), *[f(c).alias(f"{k}_{c}") for c in names for k, f in (("lo", F.min), ("hi", F.max))])
    return {r["node"]: r.asDict() for r in per_node.collect()}


def _medians(rows: DataFrame, chosen: dict[int, str], left_share: dict[int, tuple[int, int]], ranges: dict[int, dict]) -> dict[int, tuple[Cut, float]]:
    """The cut of each node: about share (of leaves: left, all) of its bytes go left; and by which share of them it misses.

    A cut is final where what it could still move is at most FINE of the goal and no group of equal texts lies on it, or
    where one group does that is no larger than a leaf; larger ones are parted by the hash of the id.
    """
    state = {n: {"level": 0, "fixed": (), "lo": ranges[n][f"lo_{d}"], "hi": ranges[n][f"hi_{d}"], "before": 0, "leaf": ranges[n]["bytes"] // left_share[n][1],
                 "goal": ranges[n]["bytes"] * left_share[n][0] // left_share[n][1]} for n, d in chosen.items()}
    cuts: dict[int, tuple[Cut, float]] = {}
    while len(cuts) < len(state):
        number, width = F.lit(None).cast("long"), {}
        for node in state.keys() - cuts.keys():
            s = state[node]
            names = _columns(chosen[node])
            here = F.col("node") == node
            for name, bound in zip(names, s["fixed"]):
                here = here & (F.col(name) == bound)
            name = names[s["level"]]
            width[node] = (s["hi"] - s["lo"]) // BINS + 1
            number = F.when(here & F.col(name).between(s["lo"], s["hi"]), F.expr(f"({name} - {s['lo']}L) div {width[node]}L")).otherwise(number)
        sums: dict[int, list[tuple[int, int]]] = {}
        counted = rows.select("node", "size", number.alias("bin")).filter("bin is not null").groupBy("node", "bin").agg(F.sum("size").alias("bytes"))
        for r in counted.collect():  # at most nodes x BINS rows
            sums.setdefault(r["node"], []).append((r["bin"], r["bytes"]))
        for node, own in sums.items():
            s, wide = state[node], width[node]
            for place, size in sorted(own):
                if s["before"] + size > s["goal"] or place == max(own)[0]:
                    break
                s["before"] += size
            low = s["lo"] + place * wide
            single = wide == 1
            # A bound on the dimension, or on a single hash, lies between groups; one on the id parts a group.
            if (size <= FINE * s["goal"] and s["level"] < 2) or (single and (s["level"] == 2 or (s["level"] == 1 and size <= s["leaf"]))):
                nearer = 2 * (s["goal"] - s["before"]) > size  # the whole bin goes left
                missed = abs(s["goal"] - s["before"] - size * nearer) / max(s["goal"], 1)
                cuts[node] = Cut(chosen[node], (*s["fixed"], low + wide * nearer)), missed
            elif not single:
                s["lo"], s["hi"] = low, min(low + wide - 1, s["hi"])
            else:
                s["fixed"], s["level"] = (*s["fixed"], low), s["level"] + 1
                name = _columns(chosen[node])[s["level"]]
                s["lo"], s["hi"] = ranges[node][f"lo_{name}"], ranges[node][f"hi_{name}"]
    return cuts


def kd_shards(rows: DataFrame, dimensions: list[str], shards: int) -> DataFrame:
    """`rows` (size, text_hash, id_key, dimensions, all long and without nulls) with their shard, 0 to shards - 1.

    A node for an odd number of leaves is split in proportion.
    """
    rows = rows.withColumn("node", F.lit(1))
    leaves, first = {1: shards}, {1: 0}
    spread = None
    for _ in range(max(shards - 1, 0).bit_length()):
        ranges = _ranges(rows.filter(F.col("node").isin([n for n in leaves if leaves[n] > 1])), dimensions)
        if spread is None:
            spread = {d: max(ranges[1][f"hi_{d}"] - ranges[1][f"lo_{d}"], 1) for d in dimensions} if 1 in ranges else {}
        chosen = {n: max(dimensions, key=lambda d: (r[f"hi_{d}"] - r[f"lo_{d}"]) / spread[d]) for n, r in ranges.items()}
        split = {n: (leaves[n] // 2, leaves[n]) for n in chosen}
        found = _medians(rows, chosen, split, ranges)
        # Where a large group lies on the cut of the widest dimension, the next ones may pass beside it.
        for place in range(1, len(dimensions)):
            again = {n: sorted(dimensions, key=lambda d: (ranges[n][f"lo_{d}"] - ranges[n][f"hi_{d}"]) / spread[d])[place] for n, (_, missed) in found.items() if missed > UNEVEN}
            if again:
                for n, other in _medians(rows, again, split, ranges).items():
                    found[n] = min(found[n], other, key=lambda f: f[1])
        cuts = {n: cut for n, (cut, _) in found.items()}
        node = F.col("node")
        for n, cut in cuts.items():
            node = F.when(F.col("node") == n, F.when(_left(cut), 2 * n).otherwise(2 * n + 1)).otherwise(node)
            leaves[2 * n], leaves[2 * n + 1] = split[n][0], leaves[n] - split[n][0]
            first[2 * n], first[2 * n + 1] = first[n], first[n] + split[n][0]
            del leaves[n]
        rows = stored(rows.withColumn("node", node), "nodes")
    shard_of = F.lit(0)
    for n in leaves:
        shard_of = F.when(F.col("node") == n, first[n]).otherwise(shard_of)
    return rows.withColumn("shard", shard_of).drop("node")


def leaves_for(documents: DataFrame, target_bytes: int) -> int:
    """How many leaves bring each to about `target_bytes`."""
    total = documents.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0
    return max(1, -(-total // target_bytes))


def numbered(rows: DataFrame) -> DataFrame:
    """`rows` with their slot in the shard, gapless from 0.

    A shard is cut into parts of about NUMBERED rows by hash; slots are those within the part plus the rows of parts
    before it, so no shard is sorted in one task.
    """
    sizes = {r["shard"]: max(1, r["n"] // NUMBERED) for r in rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = F.lit(1)
    for shard, number in sizes.items():
        parts = F.when(F.col("shard") == shard, number).otherwise(parts)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id_key", "text_hash"), parts).cast("int"))
    counts = stored(rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")), "counts")
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "part", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("shard", "part").orderBy("id_key", "text_hash")) - 1
    return rows.withColumn("own", own).join(offsets, ["shard", "part"]).withColumn("slot", F.col("own") + F.col("before")).drop("own", "before", "part")


def sharded(documents: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: shards of nearly equal bytes.

    Dimensions: length of the text in bytes (logarithm), share of bytes beyond ASCII, line ends per byte. They belong
    to the text, so equal texts share a place in the tree whatever their other columns say.
    """
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    rows = documents.select(
        "doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.shiftrightunsigned(F.xxhash64(F.col("text")), 1).alias("text_hash"),
        F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("long")), 1).alias("id_key"),
        F.floor(F.log2(size) * 1000).cast("long").alias("length_axis"), F.floor(1000 * (size - 1 - F.length(text)) / size).cast("long").alias("wide_axis"),
        F.floor(100_000 * lines / size).cast("long").alias("line_axis"))
    placed = numbered(stored(kd_shards(stored(rows, "metadata"), ["length_axis", "wide_axis", "line_axis"], shards), "shards"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
                         F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


@query("op8_sharding")
def op8_sharding(spark, folder):
    return sharded(table(spark, folder, "documents"))
