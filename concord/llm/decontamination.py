"""Finds windows of benchmark items in training documents, with DataFrame functions alone.

Texts are lower-cased (A-Z) and cut into words. A window is ten consecutive words of an item; an item of fewer words
is one window. All windows of a document are hashed and looked up in the hash set of the benchmark's windows; places
that are found are verified on the words themselves. The hash set is part of the expression, so it reaches every task
once and the scan neither shuffles nor moves text; it is used up to LARGEST_SET windows, counted first. The hashes of a
larger benchmark are a broadcast bitmap, and what it lets through is joined and verified: same result.

Null and empty texts have no words and no hits. Items without words have no windows; items with a null id make words
hit but are not listed. Rows with equal id and text are counted together and returned once each. An empty benchmark
hits nothing. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.common import marked, query, row_keys, stored, table, unwrapped, wrapped

WINDOW = 10
LARGEST_SET = 50_000
HASH_BITS = 27  # of the bitmap of a larger set: 16 MB, sparse up to some ten million windows
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Fixed value: what stands between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"


def normalised(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(normalised(text), F.lit("")), BETWEEN + "+"), "")


def _grams(size: int, hashes: list[int] | None) -> str:
    """SQL: places of windows of `size` words in the column w, with their words; only those whose hash is in the set."""
    parts = ", ".join(f"w[i + {k}]" for k in range(size))
    chosen = "" if hashes is None else f"xxhash64({parts}) in ({', '.join(f'{h}L' for h in hashes)})"
    places = f"sequence(0, size(w) - {size})"
    places = places if hashes is None else f"filter({places}, i -> {chosen})"
    return (f"if(size(w) >= {size}, transform({places}, i -> struct(i as place, {size} as size, concat_ws(' ', {parts}) as gram)),"
            f" array())")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """gram, size, h (hash), item_id: a row per different window and item."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w"))
    cut = F.expr(f"transform(sequence(0, size(w) - least({window}, size(w))), i -> slice(w, i + 1, least({window}, size(w))))")
    windows = items.filter(F.size("w") > 0).select("item_id", F.explode(cut).alias("w"))
    # The hash of an array is that of its elements in turn, as in `_grams`.
    return windows.select(F.concat_ws(" ", "w").alias("gram"), F.size("w").alias("size"), F.xxhash64("w").alias("h"), "item_id").distinct()


def window_set(benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, dict[int, list[int] | None]]:
    """`benchmark_windows`, stored, and the hash set by size of window (None: too many to carry)."""
    windows = stored(benchmark_windows(benchmark, window), "windows")
    hashes = windows.select("size", "h").distinct().limit(LARGEST_SET + 1).collect()
    sets: dict[int, list[int] | None] = {}
    for row in hashes:
        sets.setdefault(row["size"], []).append(row["h"])
    if len(hashes) > LARGEST_SET:
        sets = {r["size"]: None for r in windows.select("size").distinct().collect()}  # at most `window` sizes
    return windows, sets


FOUND = "array<struct<place:int,size:int,gram:string>>"


def _carried(documents: DataFrame, windows: DataFrame, sets: dict[int, list[int] | None]) -> tuple[DataFrame, DataFrame]:
    """Per row: doc_id, keys, n_words; and per key and place the windows that are hit. The hash set is in the expression."""
    found = F.concat(*[F.expr(_grams(k, sets[k])) for k in sorted(sets)]) if sets else F.expr(f"cast(array() as {FOUND})")
    rows = documents.select("doc_id", *row_keys(), words(F.col("text")).alias("w"))
    rows = stored(rows.select("doc_id", "k_id", "k_text", F.size("w").alias("n_words"), found.alias("found")), "found")
    places = rows.filter(F.size("found") > 0).select("k_id", "k_text", F.explode("found").alias("f")).select("k_id", "k_text", "f.*")
    # The words decide, not the hash. At most LARGEST_SET windows.
    return rows.drop("found"), places.join(F.broadcast(windows.select("gram", "size").distinct()), ["gram", "size"], "left_semi").distinct()


def _sifted(documents: DataFrame, windows: DataFrame, sizes: list[int]) -> tuple[DataFrame, DataFrame]:
    """The same for a benchmark of any size. Windows of documents are hashes until a broadcast bitmap of the benchmark's
    hashes lets them through; those that do meet the benchmark's windows by hash, and then by their words, which are cut
    from the texts of the documents concerned."""
    rows = documents.select("doc_id", *row_keys(), words(F.col("text")).alias("w"))
    counted = stored(rows.select("doc_id", "k_id", "k_text", F.size("w").alias("n_words")), "counted")
    hashes = [F.expr(f"if(size(w) >= {k}, transform(sequence(0, size(w) - {k}), i -> struct(i as place, {k} as size, xxhash64({', '.join(f'w[i + {j}]' for j in range(k))}) as h)), array())") for k in sizes]
    cut = rows.select("k_id", "k_text", F.explode(F.concat(*hashes)).alias("f")).select("k_id", "k_text", "f.*")
    known = stored(windows.select("size", "h", "gram").distinct(), "known")
    near = marked(cut, known, "size", "h", bits=HASH_BITS).filter("seen").drop("seen").join(known, ["size", "h"]).distinct()
    lists = stored(near.groupBy("k_id", "k_text").agg(F.collect_list(F.struct("place", "size", "gram")).alias("near")), "near")
    texts = marked(rows.select("k_id", "k_text", "w"), lists, "k_id", "k_text").filter("seen").dropDuplicates(["k_id", "k_text"]).join(lists, ["k_id", "k_text"])
    same = F.expr("filter(near, f -> concat_ws(' ', slice(w, f.place + 1, f.size)) = f.gram)")
    return counted, texts.select("k_id", "k_text", F.explode(same).alias("f")).select("k_id", "k_text", "f.*")


def hits(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per key of `row_keys`: doc_id, copies, n_words, spans (place, size of hit windows), items (ids, sorted).

    The items of a window are looked up once for each document that holds it, after its places are known.
    """
    windows, sets = window_set(benchmark, window)
    rows, places = _sifted(documents, windows, sorted(sets)) if None in sets.values() else _carried(documents, windows, sets)
    places = stored(places, "places")
    spans = places.groupBy("k_id", "k_text").agg(F.sort_array(F.collect_set(F.struct("place", "size"))).alias("spans"))
    pairs = places.select("k_id", "k_text", "gram", "size").distinct().join(windows.select("gram", "size", "item_id"), ["gram", "size"])
    items = pairs.groupBy("k_id", "k_text").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    keyed = rows.groupBy("k_id", "k_text").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.count(F.lit(1)).alias("copies"))
    out = keyed.join(spans, ["k_id", "k_text"], "left").join(items, ["k_id", "k_text"], "left")
    none = F.expr("cast(array() as array<struct<place:int,size:int>>)")
    return out.select("k_id", "k_text", "doc_id", "n_words", "copies", F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


COVERED = """aggregate(spans, struct(0 as upto, 0L as n), (a, s) -> struct(
    greatest(a.upto, s.place + s.size) as upto,
    a.n + greatest(0, s.place + s.size - greatest(a.upto, s.place)) as n), a -> a.n)"""


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items, contaminated."""
    per_key = hits(documents, benchmark, window).withColumn("n_hit", F.expr(COVERED))
    rows = per_key.select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_hit", "items", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select("doc_id", "n_words", "n_hit", "items", (F.col("n_hit") > 0).alias("contaminated"))


def _any_hit(items: DataFrame, sets: dict[int, list[int] | None]) -> Column:
    """Whether a text holds a window, decided on the row itself: by the hash set, then by the words of what it finds."""
    if not sets:
        return F.lit(False)
    # At most LARGEST_SET windows, as their hashes are; words hold no quotes or backslashes.
    known = ", ".join(f"'{r['gram']}'" for r in items.select("gram").distinct().collect())
    found = ", ".join(_grams(k, sets[k]) for k in sorted(sets))
    # The words are bound to w once, as the only element of an array.
    cut = f"array_remove(split(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), r'{BETWEEN}+'), '')"
    return F.expr(f"exists(array({cut}), w -> exists(concat({found}), f -> f.gram in ({known})))")


def decontaminated(documents: DataFrame, benchmark: DataFrame, remove: str = "documents", window: int = WINDOW) -> DataFrame:
    """The documents, in their own columns, without contaminated ones, or ("spans") without the hit words.

    A hit word goes with what stands between it and the next word; n_chars, where there is one, is counted anew.
    """
    items, sets = window_set(benchmark, window)
    if remove == "documents" and None not in sets.values():
        return documents.filter(~_any_hit(items, sets))
    found = hits(documents, benchmark, window).filter(F.size("spans") > 0)
    hit = stored(found.select("k_id", "k_text", "spans"), "hits")
    # Documents without a hit stay where they are.
    rows = marked(wrapped(documents, *row_keys()), hit, "k_id", "k_text")
    clean = unwrapped(rows.filter("not seen"), documents.columns, {})
    if remove == "documents":
        return clean.unionByName(unwrapped(rows.filter("seen").join(hit, ["k_id", "k_text"], "left_anti"), documents.columns, {}))
    rows = rows.filter("seen").join(hit, ["k_id", "k_text"], "left").withColumn("text", F.col("row").getField("text"))
    # Words with what follows them; what stands before the first word stays.
    parts = F.expr(rf"regexp_extract_all(text, '((?:^{BETWEEN}+)|(?:[^{BETWEEN[1:]}+{BETWEEN}*))', 1)".replace("\\", "\\\\"))
    leading = F.when(F.col("text").rlike("^" + BETWEEN), 1).otherwise(0)
    kept = F.filter(parts, lambda p, i: ~F.exists(F.col("spans"), lambda s: (i - leading >= s["place"]) & (i - leading < s["place"] + s["size"])))
    rows = rows.withColumn("cut", F.concat_ws("", kept))
    new = {"text": F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.col("cut"))}
    if "n_chars" in documents.columns:
        new["n_chars"] = F.when(F.col("spans").isNull(), F.col("row").getField("n_chars")).otherwise(F.length("cut").cast(documents.schema["n_chars"].dataType))
    return clean.unionByName(unwrapped(rows, documents.columns, new))


ORACLE = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bk as (select item_id, w, least(len(w), 10) as k from b where len(w) > 0),
bw as (select distinct item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as gram from bk),
dw as (select doc_id, k, unnest(range(1, len(w) - k + 2)) as i, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as gram
       from d, (select distinct k from bw) where len(w) >= k),
hit as (select doc_id, i, k, item_id from dw join bw using (k, gram)),
word as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from hit) group by doc_id),
item as (select doc_id, count(*) as n_items, sha256(string_agg(item_id, ',' order by item_id)) as items_sha256
         from (select distinct doc_id, cast(item_id as varchar) as item_id from hit) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join word using (doc_id) left join item using (doc_id)
"""


@query("op4_decontamination", ORACLE)
def op4_decontamination(spark, folder):
    found = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")
