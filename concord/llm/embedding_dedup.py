"""Near duplicates among embeddings: all pairs of a cosine of at least a threshold, by cover trees met two by two.

1. Equal vectors are one class with a weight, so copies cost one comparison.
2. The upper level: at most PIVOTS centres, taken far apart from a bounded sample of SAMPLE classes. Every class goes
   to its nearest centre; the covering radius of a centre is measured on all its classes, so the sample decides about
   speed and never about results.
3. The classes of a centre are dealt into blocks of BLOCK; a task makes a cover tree of each block: nested levels with
   halving radii.
4. Blocks are paired over the centres that their covering radii can reach, by an equality join on the centre, and
   again tested with their own radii. Paired trees are traversed together and give, per class, the weight of its
   links, and a forest of links: a large group of near copies costs rows in proportion to its size, not to its pairs.
5. Components of the forests are those of all links.

Where vectors have no structure (random directions in many dimensions lie all about as far apart) no bound prunes, and
step 4 is a comparison of all blocks by matrix products; that is so for every exact method by distances.

Vectors that are null, zero, or hold null or non-finite numbers link with nothing; vectors of different lengths are not
compared. Equal rows link with each other. Rows with a null vec_id take part, but name no component unless no other
row of it has an id. Labels and other columns are not read. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import bounded_batches, query, stored, table
from concord.llm.components import components
from concord.llm.cover_tree import CoverTree, build, meet

SAMPLE, PIVOTS, BLOCK, PARTNERS = 1024, 64, 4096, 8


def _units(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dims)


def _pivots(classes: DataFrame, number: int) -> dict[int, np.ndarray]:
    """By length of vector: centres taken one after the other as the farthest from those before."""
    rows = classes.select("dims", "embedding").orderBy(F.xxhash64("embedding"), "cls").limit(SAMPLE).collect()
    out = {}
    for dims in sorted({r["dims"] for r in rows}):
        points = _units(np.array([r["embedding"] for r in rows if r["dims"] == dims], dtype=np.float64))
        chosen, far = [0], 2 - 2 * points @ points[0]
        while len(chosen) < min(number, len(points)) and far.max() > 1e-12:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, 2 - 2 * points @ points[chosen[-1]])
        out[dims] = points[chosen]
    return out


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column(batch.schema.get_field_index("dims")).to_numpy()
    for one in np.unique(dims):
        yield int(one), batch.take(pa.array(np.flatnonzero(dims == one)))


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _assigned(classes: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """cls, cell, gap (distance to the cell's centre). A length without a centre has one cell about the origin."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, part in _by_length(batch):
                units = _units(_matrix(_column(part, "embedding"), dims))
                cell, gap = np.full(len(units), -1), np.ones(len(units))
                if dims in pivots:
                    cosine = units @ pivots[dims].T
                    cell = cosine.argmax(axis=1)
                    gap = np.sqrt(np.maximum(2 - 2 * cosine.max(axis=1), 0))
                yield pa.RecordBatch.from_arrays([*(_column(part, c) for c in ("cls", "dims", "weight", "embedding")), pa.array(cell, pa.int64()), pa.array(gap)],
                                                 names=["cls", "dims", "weight", "embedding", "cell", "gap"])

    return classes.select("cls", "dims", "weight", "embedding").mapInArrow(rows, "cls long, dims int, weight long, embedding array<double>, cell long, gap double")


def _trees(assigned: DataFrame, cells: DataFrame) -> DataFrame:
    """One row per block: dims, cell, block, centre, radius, tree."""
    sizes = stored(cells.select("dims", "cell", F.ceil(F.col("n") / F.lit(BLOCK)).alias("blocks")), "cells")
    dealt = assigned.join(sizes, ["dims", "cell"]).withColumn("block", F.pmod(F.xxhash64("cls"), "blocks"))
    dealt = dealt.select("dims", "cell", "block", "cls", "weight", "embedding").repartition("dims", "cell", "block").sortWithinPartitions("dims", "cell", "block", "cls")
    names = ["dims", "cell", "block", "centre", "radius", "tree"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []

        def row() -> pa.RecordBatch:
            whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            tree = build(_units(_matrix(_column(whole, "embedding"), at[0])), _column(whole, "cls").to_numpy(), _column(whole, "weight").to_numpy())
            values = [*([v] for v in at), [tree.centres[0].tolist()], [float(tree.radii[0])], [tree.packed()]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.binary()])], names=names)

        for batch in batches:
            keys = np.column_stack([_column(batch, c).to_numpy() for c in ("dims", "cell", "block")])
            starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1))) if len(keys) else []
            for lo, hi in zip(starts, [*starts[1:], len(keys)]):
                if tuple(keys[lo].tolist()) != at:
                    if parts:
                        yield row()
                    at, parts = tuple(keys[lo].tolist()), []
                parts.append(batch.slice(lo, hi - lo))
        if parts:
            yield row()

    return dealt.mapInArrow(rows, "dims int, cell long, block long, centre array<double>, radius double, tree binary")


def _pairs(blocks: DataFrame, pivots: dict[int, np.ndarray], radii: dict[tuple[int, int], float], least: float) -> DataFrame:
    """a, b: blocks (a <= b) whose covering radii let them hold a link. `radii` are those of cells with a centre."""
    reach = float(np.sqrt(2 - 2 * least)) + 1e-6

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for number, dims, centre, radius in zip(*(_column(batch, c).to_pylist() for c in ("id", "dims", "centre", "radius"))):
                if dims not in pivots:  # its blocks are all in one cell
                    out.append((number, dims, -1, centre, radius))
                for (length, cell), cover in radii.items():
                    if length == dims and np.linalg.norm(pivots[dims][cell] - centre) <= reach + radius + cover:
                        out.append((number, dims, cell, centre, radius))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.float64()])],
                                             names=["a", "dims", "cell", "centre_a", "radius_a"])

    near = blocks.select("id", "dims", "centre", "radius").mapInArrow(rows, "a long, dims int, cell long, centre_a array<double>, radius_a double")
    joined = near.join(blocks.select(F.col("id").alias("b"), "dims", "cell", "centre", "radius"), ["dims", "cell"]).filter("a <= b")
    square = F.aggregate(F.zip_with("centre_a", "centre", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return joined.filter(F.sqrt(square) <= F.col("radius_a") + F.col("radius") + reach).select("a", "b")


def _met(pairs: DataFrame, trees: DataFrame, least: float) -> DataFrame:
    """kind 0: cls a has links of weight b; kind 1: a link of the forest. A block streams past PARTNERS others."""
    counts = stored(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(PARTNERS)).alias("chunks")), "chunks")
    numbered = pairs.join(counts, "a").withColumn("chunk", F.pmod(F.xxhash64("b"), "chunks"))
    firsts = counts.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("role"), F.col("a").alias("id"))
    roles = firsts.unionByName(numbered.select("a", "chunk", F.lit(1).alias("role"), F.col("b").alias("id")))
    dealt = roles.join(trees.select("id", "tree"), "id").repartition("a", "chunk").sortWithinPartitions("a", "chunk", "role", "id")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                a, role, number = (_column(batch, c)[k].as_py() for c in ("a", "role", "id"))
                if role == 0:
                    own, at = (CoverTree.unpacked(_column(batch, "tree")[k].as_py()), a) if at != a else (own, at)
                    continue
                other = own if number == a else CoverTree.unpacked(_column(batch, "tree")[k].as_py())
                first, second, forest = meet(own, other, least, number == a)
                x, y = np.flatnonzero(first), np.flatnonzero(second)
                left = np.concatenate([own.ids[x], other.ids[y], np.array([p for p, _ in forest], dtype=np.int64)])
                right = np.concatenate([first[x], second[y], np.array([q for _, q in forest], dtype=np.int64)])
                kind = np.repeat([0, 1], [len(x) + len(y), len(forest)])
                yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["kind", "a", "b"])

    return dealt.mapInArrow(rows, "kind int, a long, b long")


def embedding_components(embeddings: DataFrame, least: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id of each row of `embeddings`."""
    spark = embeddings.sparkSession
    bounded_batches(spark)
    vector = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long"), vector.alias("embedding"))
    usable = F.expr("size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(embedding, x -> x <> 0)")
    rows = rows.withColumn("usable", F.coalesce(F.col("embedding").isNotNull() & usable, F.lit(False)))
    same = rows.filter("usable").groupBy("embedding").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("one"))
    classes = stored(same.select(F.monotonically_increasing_id().alias("cls"), F.size("embedding").alias("dims"), "weight", "one", "embedding"), "classes")
    total = classes.count()
    pivots = _pivots(classes, max(1, min(PIVOTS, total // BLOCK)))
    assigned = stored(_assigned(classes, pivots), "assigned")
    cells = assigned.groupBy("dims", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius"))
    trees = stored(_trees(assigned, cells).withColumn("id", F.monotonically_increasing_id()), "trees")
    # At most PIVOTS cells of each length among the sample; other lengths have one cell each, and no list of them is needed.
    radii = {(r["dims"], r["cell"]): r["radius"] + 1e-7 for r in cells.filter("cell >= 0").collect()}
    pairs = stored(_pairs(trees, pivots, radii, least), "pairs")
    met = stored(_met(pairs, trees, least), "met")
    links = stored(met.filter("kind = 0").groupBy("a").agg(F.sum("b").alias("linked")).select(F.col("a").alias("cls"), "linked"), "links")
    found = components(met.filter("kind = 1").select("a", "b")).select(F.col("node").alias("cls"), "component")
    named = stored(classes.join(found, "cls", "left").join(links, "cls", "left").select(
        "embedding", "one", (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "cls").alias("component")), "named")
    names = stored(named.groupBy("component").agg(F.min("one").alias("component_id")), "names")
    labels = stored(named.join(names, "component").select("embedding", "n_links", "component_id"), "labels")
    key = F.when(F.col("usable"), F.col("embedding"))
    out = rows.withColumn("key", key).join(labels.withColumnRenamed("embedding", "key"), "key", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))


ORACLE = """
with recursive v as (select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
link as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from reach r join link l on r.b = l.a),
c as (select a as vec_id, min(b) as component_id from reach group by a),
n as (select a as vec_id, count(*) as n_links from link group by a)
select c.vec_id, coalesce(n_links, 0) as n_links, component_id, c.vec_id = component_id as kept from c left join n using (vec_id)
"""


@query("op2_embedding_dedup", ORACLE)
def op2_embedding_dedup(spark, folder):
    found = embedding_components(table(spark, folder, "embeddings"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))
