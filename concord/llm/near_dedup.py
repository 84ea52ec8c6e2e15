"""Near duplicates among documents: candidates by circulant MinHash, links by the exact similarity of shingle sets.

1. Documents with equal shingle sets are one class; a class is compared once, however many copies it has.
2. Two permutations, one shifted in a circle, give all 288 coordinates of a class; 48 bands of 6 make buckets. Two
   sets of similarity 0.8 miss all buckets with a probability under 10^-6.
3. Buckets with the same first class are one group. In groups of more than DIRECT classes all are first compared with
   that class only, on their full sets; the links found give components.
4. Classes of different components within a group are compared, in meetings of two chunks (`_across`); classes of the
   first one's component do not meet each other.
5. Components of all links; the smallest doc_id of a component names it.

Frequent keys: copies vanish in step 1 by partial aggregation; the members of a large bucket meet its first class in
chunks of CHUNK, each with that class's text, so no group is gathered in a task.

Null, empty and blank texts have an empty set, 0 shingles, and are linked with nothing. Fewer words than a shingle are
one shingle. Rows are nodes of their own, so repeated rows link with each other; rows with a null doc_id take part,
but name a component only where no row of it has an id. Extra columns are not read. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import arrow_batches, bounded_batches, marked, query, row_keys, stored, table, unwrapped, wrapped
from concord.llm.components import components
from concord.llm.minhash import features, shingle_set

CHUNK = 64
DIRECT = 16 * CHUNK  # larger groups are compared with their first class before chunks meet
PERCENT = 80


def _alike(first: np.ndarray, second: np.ndarray, percent: int) -> bool:
    if 100 * min(len(first), len(second)) < percent * max(len(first), len(second)):
        return False
    both = len(np.intersect1d(first, second, assume_unique=True))
    return 100 * both >= percent * (len(first) + len(second) - both)


def _texts_of(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """k_id, k_text, text of the documents with the keys of `rows`, and of few others."""
    return marked(documents.select(*row_keys(), "text"), rows, "k_id", "k_text").filter("seen").drop("seen")


def _confirmed(pairs: DataFrame, classes: DataFrame, documents: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of `pairs` (a, b: classes) whose full sets are alike. The texts of all b of an a stream past its set."""
    chunks = stored(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(CHUNK)).cast("int").alias("chunks")), "chunks")
    members = pairs.join(chunks, "a").select("a", F.pmod(F.xxhash64("b"), "chunks").cast("int").alias("chunk"), F.col("b").alias("cls"), F.lit(1).alias("role"))
    firsts = chunks.select("a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("a").alias("cls"), F.lit(0).alias("role"))
    roles = stored(firsts.unionByName(members).join(classes.select("cls", "k_id", "k_text"), "cls"), "roles")
    texts = _texts_of(documents, roles).join(roles, ["k_id", "k_text"]).select("a", "chunk", "role", "cls", "text")
    dealt = texts.repartition("a", "chunk").sortWithinPartitions("a", "chunk", "role")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for batch in arrow_batches(batches):
            left, right = [], []
            for a, role, cls, text in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("a", "role", "cls", "text"))):
                if role == 0:
                    if at != a:
                        at, own = a, shingle_set(text, size)
                elif _alike(own, shingle_set(text, size), percent):
                    left.append(a)
                    right.append(cls)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(compare, "a long, b long")


def _linked(members: list[tuple[int, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """A forest of links between members (component, set) of different components: positions of alike sets."""
    sizes = np.array([len(s) for _, s in members])
    tokens, at = np.unique(np.concatenate([s for _, s in members]), return_inverse=True)
    owner = np.repeat(np.arange(len(members)), sizes)
    often = np.bincount(at, minlength=len(tokens)) > 1  # others are in no intersection
    column = np.cumsum(often) - 1
    owner, at = owner[often[at]], column[at[often[at]]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    both = np.zeros((len(members), len(members)))
    for start in range(0, int(often.sum()), 4096):
        lo, hi = np.searchsorted(at, [start, start + 4096])
        part = np.zeros((len(members), 4096), dtype=np.float32)
        part[owner[lo:hi], at[lo:hi] - start] = 1
        both += part @ part.T
    alike = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    component = np.array([c for c, _ in members])
    first, second = np.nonzero(np.triu(alike, 1) & (component[:, None] != component[None, :]))
    ends = np.sort(np.column_stack([component[first], component[second]]), axis=1)
    _, one = np.unique(ends, axis=0, return_index=True)  # a link for each two components is enough
    up = {c: c for c in component.tolist()}

    def root(c: int) -> int:
        while up[c] != c:
            up[c] = up[up[c]]
            c = up[c]
        return c

    out = []
    for k in one.tolist():
        a, b = root(int(component[first[k]])), root(int(component[second[k]]))
        if a != b:
            up[b] = a
            out.append((int(first[k]), int(second[k])))
    return out


def _across(groups: DataFrame, classes: DataFrame, documents: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between classes of different components within groups (hub, cls, component, main).

    Members of the hub's component (main) and the others are dealt into chunks. Every chunk of others meets every
    chunk, itself included; chunks of the hub's component do not meet each other. A meeting holds 2 * CHUNK sets at
    most and gives a forest of links.
    """
    sizes = groups.groupBy("hub").agg(F.ceil(F.sum(F.col("main").cast("int")) / F.lit(CHUNK)).alias("mains"),
                                      F.ceil(F.sum((~F.col("main")).cast("int")) / F.lit(CHUNK)).alias("others"))
    sizes = stored(sizes.filter("others > 0"), "sizes")
    dealt = groups.join(sizes, "hub").withColumn("chunk", F.pmod(F.xxhash64("cls"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("others"))))
    against = lambda kind, number: F.transform(F.sequence(F.lit(0).cast("long"), F.col(number) - 1), kind)
    meetings = F.when(F.col("main"), against(lambda j: F.struct(F.lit(True).alias("m"), F.col("chunk").alias("i"), j.alias("j")), "others")).otherwise(
        F.concat(F.when(F.col("mains") > 0, against(lambda i: F.struct(F.lit(True).alias("m"), i.alias("i"), F.col("chunk").alias("j")), "mains")).otherwise(F.array()),
                 against(lambda i: F.struct(F.lit(False).alias("m"), F.least(i, "chunk").alias("i"), F.greatest(i, "chunk").alias("j")), "others")))
    # A chunk of others that meets chunks of the hub's component meets itself there too, where it is the only one.
    rows = stored(dealt.join(classes.select("cls", "k_id", "k_text"), "cls").select("hub", "cls", "component", "k_id", "k_text", meetings.alias("meetings")), "members")
    texts = _texts_of(documents, rows).join(rows, ["k_id", "k_text"]).select("hub", "cls", "component", F.explode("meetings").alias("meeting"), "text")
    together = texts.select("hub", "meeting.*", "cls", "component", "text").repartition("hub", "m", "i", "j").sortWithinPartitions("hub", "m", "i", "j", "cls")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, members = None, {}

        def links() -> pa.RecordBatch:
            names = list(members)
            found = _linked(list(members.values()), percent) if len({c for c, _ in members.values()}) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([names[i] for i, _ in found], pa.int64()), pa.array([names[j] for _, j in found], pa.int64())], names=["a", "b"])

        for batch in arrow_batches(batches):
            for *meeting, cls, component, text in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("hub", "m", "i", "j", "cls", "component", "text"))):
                if meeting != at:
                    if members:
                        yield links()
                    at, members = meeting, {}
                members[cls] = (component, shingle_set(text, size))
        if members:
            yield links()

    return together.mapInArrow(compare, "a long, b long")


def near_duplicates(documents: DataFrame, size: int = 5, percent: int = PERCENT) -> DataFrame:
    """doc_id, k_id, k_text, n_shingles, component_id of each row, over word shingles of `size`."""
    bounded_batches(documents.sparkSession)
    rows = stored(features(documents.select("doc_id", *row_keys(), "text"), size), "features")
    same = rows.filter("bands is not null").groupBy("s1", "s2").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k_id", "k_text")).alias("one"), F.first("bands").alias("bands"))
    classes = stored(same.select(F.monotonically_increasing_id().alias("cls"), "s1", "s2", "one.doc_id", "one.k_id", "one.k_text", "bands"), "classes")
    banded = classes.select("cls", F.explode("bands").alias("band"))
    # Tables that a frequent key is joined to are stored first: then Spark can split the key in the join.
    buckets = stored(banded.groupBy("band").agg(F.min("cls").alias("hub"), F.count(F.lit(1)).alias("m")).filter("m > 1").select("band", "hub"), "buckets")
    groups = stored(banded.join(buckets, "band").select("hub", "cls").distinct(), "groups")  # the hub is a member of its group
    large = stored(groups.groupBy("hub").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > DIRECT).select(F.col("hub").alias("a")), "large")
    first = groups.join(large, F.col("hub") == F.col("a")).filter("cls <> hub").select("a", F.col("cls").alias("b"))
    first = stored(first, "pairs")
    links = stored(_confirmed(first, classes, documents, size, percent), "links") if not first.isEmpty() else first.limit(0)
    found = components(links)
    of_cls = found.select(F.col("node").alias("cls"), "component")
    of_hub = found.select(F.col("node").alias("hub"), F.col("component").alias("hub_component"))
    parted = groups.join(of_cls, "cls", "left").join(of_hub, "hub", "left")
    component, hub_component = F.coalesce("component", "cls"), F.coalesce("hub_component", "hub")
    parted = parted.select("hub", "cls", component.alias("component"), (component == hub_component).alias("main"))
    more = stored(_across(stored(parted, "groups"), classes, documents, size, percent), "links")
    whole = components(links.unionByName(more))
    named = classes.join(whole.select(F.col("node").alias("cls"), "component"), "cls", "left").select("s1", "s2", "doc_id", F.coalesce("component", "cls").alias("component"))
    named = stored(named, "components")
    names = stored(named.groupBy("component").agg(F.min("doc_id").alias("component_id")), "names")
    labels = stored(named.join(names, "component").select("s1", "s2", "component_id"), "components")
    out = rows.withColumn("empty", F.col("bands").isNull()).drop("bands").join(labels, ["s1", "s2"], "left")
    return out.select("doc_id", "k_id", "k_text", "n_shingles", F.when(F.col("empty"), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(documents: DataFrame, size: int = 5, percent: int = PERCENT) -> DataFrame:
    """The documents, in their own columns, that name their component; of repeated rows the first, without null ids.

    Rows with a null id stay if they have no component but themselves.
    """
    found = near_duplicates(documents, size, percent)
    gone = F.col("component_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("component_id"))
    doubtful = found.groupBy("k_id", "k_text").agg(F.bool_or(gone).alias("gone"), F.count(F.lit(1)).alias("n"))
    doubtful = stored(doubtful.filter("gone or n > 1").select("k_id", "k_text", "gone"), "gone")
    # Most documents are neither repeated rows nor gone; they stay where they are.
    rows = marked(wrapped(documents, *row_keys()), doubtful, "k_id", "k_text")
    checked = rows.filter("seen").dropDuplicates(["k_id", "k_text"]).join(doubtful, ["k_id", "k_text"], "left").filter(~F.coalesce("gone", F.lit(False)))
    return unwrapped(rows.filter("not seen").select("row").unionByName(checked.select("row")), documents.columns, {})


@query("op7_near_dedup")
def op7_near_dedup(spark, folder):
    found = near_duplicates(table(spark, folder, "documents"), size=2)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
