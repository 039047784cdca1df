"""Benchmark decontamination by an exact search of all item-sized windows, in SQL functions only.

Every benchmark item of m words is compared with all m-word windows of the
documents by the weighted Jaccard similarity of the shingle multisets (weight:
number of occurrences), at least `percent` / 100. No window is drawn: a shared
shingle at place p of a document counts for the windows that start in one
interval, from where the window begins to hold it (and no more earlier
occurrences than the item has) up to p. How many intervals cover a start is the
size of the intersection there, so a running sum over the ends of the intervals
gives the similarity of every window. Documents whose shingles shared with the
item are too few in all are left out first, which loses nothing.

A SimHash radius as filter before the exact similarity loses windows whose
similarity is high enough, so the search has none; `simhash` and `blocks` are
fingerprint expressions that no decision depends on.

Defined results: lower-cased words `[^\\x20\\x09-\\x0D]+`; null and empty texts
match nothing; an item of fewer than `k` words has one shingle, its whole word
sequence, and items without words match nothing; a document shorter than an
item is one window. Rows with a null id are returned as not contaminated. Repeated rows get
the same values; rows of the same id with other texts are decided separately.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hrsight.llm.native import grams, words
from hrsight.llm.tasks import saved

BITS = 64


def simhash(word_list):
    """64-bit SimHash of an array of words, each occurrence with weight 1."""
    hashed = F.transform(word_list, lambda w: F.xxhash64(w))
    votes = lambda j: F.aggregate(hashed, F.lit(0), lambda a, h: a + F.when(
        F.call_function("shiftrightunsigned", h, j).bitwiseAND(F.lit(1)) == 1, 1).otherwise(-1))
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("bigint"),
        lambda acc, j: acc.bitwiseOR(F.when(votes(j) > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), j))
                                     .otherwise(F.lit(0).cast("bigint"))))


def blocks(fingerprint, radius):
    """(block number, bits) of the radius + 1 blocks of a fingerprint."""
    cuts = [BITS * b // (radius + 1) for b in range(radius + 2)]
    return F.array(*[F.struct(F.lit(b).alias("block"), F.call_function("shiftrightunsigned", fingerprint, F.lit(lo))
                              .bitwiseAND(F.lit((1 << hi - lo) - 1).cast("bigint")).alias("value"))
                     for b, (lo, hi) in enumerate(zip(cuts, cuts[1:]))])


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            item_id: str = "item_id", item_text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(id, text_hash, item, start, n_words, similarity): windows that are similar enough, `start` counted in words.

    Of neighbouring windows with the same similarity the first one is named; the best window of every pair is there."""
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.lower(F.col(f"`{text_col}`")).alias("text")) \
        .where("id IS NOT NULL AND text != ''")
    src = src.select("id", F.xxhash64("text").alias("th"), words(F.col("text")).alias("w"))
    items = benchmark.select(F.col(f"`{item_id}`").alias("item"), words(F.lower(F.col(f"`{item_text}`"))).alias("iw")) \
        .where("size(iw) > 0").select("item", "iw", F.size("iw").alias("m")).distinct()
    # shingle sizes below k exist only for items that short
    items = saved(items.withColumn("own", F.least("m", F.lit(k))), "items")
    sizes = sorted(r["own"] for r in items.select("own").distinct().collect())  # at most k values

    def at_places(frame, cols, word_col):
        """One row for each shingle of any size in use: `cols`, size, place, gram."""
        parts = [frame.select(*cols, F.lit(s).alias("size"), F.posexplode(grams(F.col(word_col), s)).alias("place", "gram"))
                 for s in sizes]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    if not sizes:
        return docs.sparkSession.createDataFrame(
            [], f"id {src.schema['id'].dataType.simpleString()}, text_hash bigint, "
                f"item {items.schema['item'].dataType.simpleString()}, start int, n_words int, similarity double")
    # an item number with several texts is several items
    item = ["item", "ih", "m"]
    item_grams = (at_places(items.select("item", F.xxhash64("iw").alias("ih"), "m", "iw", "own"), [*item, "own"], "iw")
                  .where("size = own").groupBy(*item, "size", "gram").agg(F.count("*").alias("ni")))
    # written, so that its size is known and a small table is broadcast: a common passage is one key of the join
    item_grams = saved(item_grams, "item_grams", max(6, items.count() // 1000))
    pair = ["id", "th", "n", *item, "size"]
    places = (at_places(src, ["id", "th", F.size("w").alias("n")], "w").join(item_grams, ["size", "gram"])
              .groupBy(*pair, "gram", "ni").agg(F.array_sort(F.collect_set("place")).alias("at")))
    # each place with the latest one that must lie before the window for it to count
    places = places.withColumn("at", F.transform("at", lambda p, i: F.struct(
        p.alias("place"), F.when(i >= F.col("ni"), F.get("at", i - F.col("ni").cast("int"))).otherwise(F.lit(-1)).alias("past"))))
    held = F.least("n", "m") - F.col("size") + 1
    total = F.col("m") - F.col("size") + 1
    enough = lambda common: common * (100 + percent) >= (total + held) * percent
    spots = (places.groupBy(*pair).agg(F.sum(F.least(F.size("at"), "ni")).alias("most"), F.flatten(F.collect_list("at")).alias("at"))
             .where(enough(F.col("most"))).select(*pair, F.explode("at").alias("s")))
    spots = spots.select(*pair, F.greatest(F.lit(0), F.col("s.past") + 1, F.col("s.place") - held + 1).alias("lo"),
                         F.least("s.place", F.greatest(F.lit(0), F.col("n") - F.col("m"))).alias("hi")).where("lo <= hi")
    ends = spots.select(*pair, F.explode(F.array(F.struct(F.col("lo").alias("start"), F.lit(1).alias("step")),
                                                 F.struct((F.col("hi") + 1).alias("start"), F.lit(-1).alias("step")))).alias("e"))
    steps = ends.groupBy(*pair, "e.start").agg(F.sum("e.step").alias("step"))
    run = Window.partitionBy(*pair).orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    common = steps.withColumn("common", F.sum("step").over(run)).where(enough(F.col("common")))
    return common.select(
        "id", F.col("th").alias("text_hash"), "item", "start", F.least("n", "m").alias("n_words"),
        (F.col("common") / (total + held - F.col("common"))).alias("similarity"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per input row: id, text_hash, contaminated, items (ascending ids, comma-joined), similarity (of the best window, else null)."""
    found = matches(docs, benchmark, id_col, text_col, **options)
    found = found.groupBy("id", "text_hash").agg(
        F.array_join(F.array_sort(F.collect_set("item")).cast("array<string>"), ",").alias("items"),
        F.max("similarity").alias("similarity"))
    keys = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.lower(F.col(f"`{text_col}`"))).alias("text_hash"))
    return keys.join(found, ["id", "text_hash"], "left").select(
        F.col("id").alias(id_col), "text_hash", F.col("items").isNotNull().alias("contaminated"),
        F.coalesce("items", F.lit("")).alias("items"), "similarity")


def op8(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(docs, benchmark).select("doc_id", "contaminated", "items", "similarity")
