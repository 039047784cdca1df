"""Near-duplicate documents by one-permutation MinHash with optimal densification.

One hash permutation fills `bands * rows` bins with the smallest shingle
fingerprint of each bin; an empty bin copies the bin that a hash of (bin,
attempt) points at, trying until it meets a filled one. `rows` bins make a
band; documents with an equal band meet in a bucket. A bucket emits a star, one
edge per member, so the number of candidate pairs is bounded by the number of
bucket rows whatever the group sizes. Every edge is confirmed on the full
shingle sets.

A star can miss a link between two members that are both unlike its centre, so
stars are drawn again: in the first round the centre is the member that meets the
most others over all buckets (the text that the copies were made from, usually);
members that it leaves undecided are dealt out again, exactly, by their rarest
shingles, and rounds of random centres go on, only across components, until a
round confirms no further link. What is then still apart is settled without
chance: in every rare-shingle bucket the members outside its largest component
are compared with all its members of other components.

Documents with the same shingle set are one node from the start (grouped by a
128-bit fingerprint of the set), so thousands of exact copies cost one row.

Defined results: a null or empty text, or one without words, has no shingles
and is linked with nothing; a text with fewer than `k` words has one shingle,
its whole word sequence; rows with a null id are returned with their set size,
a null component and kept = true; repeated rows are returned repeatedly with
the same values. Columns other than the two named ones are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hrsight.llm.graph import ROWS_PER_TASK, components, merged
from hrsight.llm.tasks import LAID_OUT, drop, map_arrow, saved
from hrsight.llm.textnp import U64, gram_hashes, mix64, words_of

_EMPTY = U64(0xFFFFFFFFFFFFFFFF)
#: Stars drawn at random in each bucket of a later round.
STARS = 2
#: Members in a block of a bucket whose members are compared with each other.
BLOCK = 256


def shingle_sets(texts, k, lower):
    """The sorted distinct k-word shingle fingerprints of every text."""
    h, first, _, _ = words_of(texts, lower)
    g, begin = gram_hashes(h, first, k)
    return [np.unique(g[begin[i]:begin[i + 1]]) for i in range(len(begin) - 1)]


def set_key(s):
    """Two signed 64-bit halves of a 128-bit fingerprint of a shingle set."""
    return np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), dtype=np.int64)


def signatures(sets, bins):
    """One-permutation MinHash of non-empty sets, densified; one row of `bins` values each."""
    sig = np.full(len(sets) * bins, _EMPTY, dtype=U64)
    if not len(sets):
        return sig.reshape(0, bins)
    x = mix64(np.concatenate(sets))
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    np.minimum.at(sig, owner * bins + (x % U64(bins)).astype(np.int64), x)
    sig = sig.reshape(len(sets), bins)
    empty = sig == _EMPTY
    row, at = np.nonzero(empty)
    out, attempt = sig.copy(), 0
    while len(row):
        attempt += 1
        probe = (mix64(at.astype(U64) + U64(attempt) * U64(1 << 20)) % U64(bins)).astype(np.int64)
        hit = ~empty[row, probe]
        out[row[hit], at[hit]] = sig[row[hit], probe[hit]]
        row, at = row[~hit], at[~hit]
    return out


def band_keys(sig, bands, rows):
    """One signed 64-bit bucket key for each band; the band's number is part of the key."""
    with np.errstate(over="ignore"):
        acc = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=U64)), (len(sig), bands)).copy()
        cut = sig.reshape(len(sig), bands, rows)
        for r in range(rows):
            acc = mix64(acc * U64(0x9FB21C651E98DF25) + cut[:, :, r])
    return acc.view(np.int64)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3,
                    lower: bool = True, percent: int = 85, bands: int = 32, rows: int = 5) -> DataFrame:
    """Per input row: id, n_shingles, component_id, kept, text_hash (xxhash64 of the text).

    Two documents are linked if 100 * |intersection| >= percent * |union| of
    their shingle sets; a component is what links connect. With the default
    bands a pair right at the threshold is missed with a probability near 1e-8.
    """
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    id_type = src.schema["id"].dataType.simpleString()
    hashed = src.select("id", "text", F.xxhash64("text").alias("text_hash"))

    def sketch(batch, texts):
        sets = shingle_sets(texts, k, lower)
        n = np.array([len(s) for s in sets])
        keys = np.array([set_key(s) for s in sets]).reshape(len(sets), 2)
        some = np.flatnonzero(n)
        made = band_keys(signatures([sets[i] for i in some], bands * rows), bands, rows)
        lists = [None] * len(sets)
        for i, b in zip(some, made):
            lists[i] = b
        yield {"id": batch.column(0), "text_hash": batch.column(2), "n_shingles": n, "s1": keys[:, 0], "s2": keys[:, 1],
               "bands": lists}

    rows_ = saved(map_arrow(hashed, "text", sketch, f"id {id_type}, text_hash bigint, n_shingles bigint, s1 bigint, "
                            "s2 bigint, bands array<bigint>", LAID_OUT), "sketch")
    # one node for each distinct set; its number stands for its 128-bit fingerprint
    real = rows_.where("n_shingles > 0 and id is not null")
    nodes = real.groupBy("s1", "s2").agg(F.min("id").alias("id"))
    members = (real.groupBy("s1", "s2").agg(F.min(F.struct("id", "n_shingles", "bands")).alias("m"))
               .select(F.struct("s1", "s2").alias("node"), F.col("m.n_shingles").alias("size"), F.explode("m.bands").alias("key")))
    shared = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = saved(members.join(shared, "key"), "buckets")
    parts = max(6, buckets.count() // ROWS_PER_TASK)
    popularity = saved(buckets.groupBy("node").agg(F.sum("n").alias("met")), "popularity", parts)
    involved = popularity.select("node")
    texts = saved(_sets_of(src, nodes, involved, k, lower), "sets")

    placed = buckets.join(popularity, "node").select("key", "node", "size", "met", F.col("node").alias("label"))
    # first stars: the centre is the member that meets the most others
    edges = _stars(placed, [F.struct("met", "node", "label", "size")], percent)
    links = saved(_confirmed(edges, texts, percent), "links", parts)
    comp = components(involved, links)
    rest = saved(_by_rare_shingles(placed.select("key", "node", "size").join(comp, "node"), texts, percent), "rest")
    turn = 0
    while True:
        turn += 1
        draws = [F.struct(F.xxhash64("node", "key", F.lit(turn * STARS + i)).alias("met"), "node", "label", "size")
                 for i in range(STARS)]
        more = saved(_confirmed(_stars(rest.join(comp, "node"), draws, percent), texts, percent), "links", parts)
        if more.isEmpty():
            break
        before, comp = comp, merged(comp, more)
        drop(before, more)
    # the two members of any further link are in different components of a bucket, so one of them is outside its largest
    left = saved(_confirmed(saved(_across(rest, comp, percent), "across"), texts, percent), "links", parts)
    if not left.isEmpty():
        comp = merged(comp, left)
    named = nodes.select(F.struct("s1", "s2").alias("node"), "id").join(comp, "node", "left") \
        .withColumn("label", F.coalesce("label", "node"))
    smallest = named.groupBy("label").agg(F.min("id").alias("component_id"))
    by_set = saved(named.join(smallest, "label").select("node.s1", "node.s2", "component_id"), "by_set")
    out = rows_.drop("bands").join(by_set, ["s1", "s2"], "left")
    out = out.select(
        F.col("id").alias(id_col), "text_hash", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    out = out.withColumn("component_id", F.when(F.col(id_col).isNotNull(), F.col("component_id")))
    return out.select(id_col, "n_shingles", "component_id",
                      F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)).alias("kept"), "text_hash")


def _stars(placed, draws, percent):
    """Edges (a, b) from members to their bucket's centres, the members with the largest `draws`.

    Only across components, and only where the set sizes allow the similarity."""
    centres = (placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"),
                                         *[F.max(d).alias(f"c{i}") for i, d in enumerate(draws)])
               .where("lo != hi").select("key", F.array_distinct(F.array(*[f"c{i}" for i in range(len(draws))])).alias("cs")))
    return (placed.join(centres, "key").select("node", "size", "label", F.explode("cs").alias("c"))
            .where(F.col("label") != F.col("c.label"))
            .where(F.least("size", "c.size") * 100 >= F.greatest("size", "c.size") * percent)
            .select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct())


def _across(rest, comp, percent):
    """Edges (a, b): in every bucket, each member outside the largest component with every member of another component.

    Both sides are dealt out in blocks, so no task gets a whole bucket. The smaller set of a pair meets the larger one
    only by its index shingles, the first size - ceil(2 * percent * size / (100 + percent)) + 1 of the common order: a
    pair that is similar enough shares at least 2 * percent * size / (100 + percent) shingles, size being the smaller
    one's, so the first shared one is among them. Pairs go that can't be similar enough by
    their sizes, or by what is left of both sets behind the bucket's shingle: right at the first shingle of the
    common order that two sets share, so a pair that is similar enough stays in that bucket at least."""
    index = F.col("size") - F.ceil(F.col("size") * (2 * percent) / (100 + percent)) + 1
    placed = rest.join(comp, "node").withColumn("index", F.col("at") <= index)
    # a bucket without index rows, or with only one component, holds no pair
    main = (placed.groupBy("key", "label").agg(F.count("*").alias("n"), F.max("index").alias("index")).groupBy("key")
            .agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("labels"), F.max("index").alias("index"))
            .where("labels > 1 AND index")
            .select("key", F.col("top.label").alias("main"), F.ceil((F.col("n") - F.col("top.n")) / BLOCK).alias("few"),
                    F.ceil(F.col("n") / BLOCK).alias("many")))
    marked = placed.join(main, "key").select(
        "key", "few", "many", F.struct("node", "label", "size", "at", "index", (F.col("label") == F.col("main")).alias("main")).alias("m"))
    block = lambda n: F.pmod(F.xxhash64("m.node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    few = marked.where("NOT m.main").select("key", block("few").alias("row"), every("many").alias("column"), F.col("m").alias("x"))
    many = marked.select("key", every("few").alias("row"), block("many").alias("column"), F.col("m").alias("y"))
    behind = F.least(F.col("x.size") - F.col("x.at"), F.col("y.size") - F.col("y.at"))
    return (_meetings(few, many).where("x.label != y.label AND (y.main OR x.node < y.node)")
            .where(F.least("x.size", "y.size") * 100 >= F.greatest("x.size", "y.size") * percent)
            .where((behind + 1) * (100 + percent) >= (F.col("x.size") + F.col("y.size")) * percent)
            .select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct())


def _meetings(few, many):
    """Pairs of rows x, y of one block of a bucket of which an index row is the smaller; sets of one size meet in either place."""
    at = ["key", "row", "column"]
    return (few.where("x.index").join(many, at).where("x.size <= y.size")
            .unionByName(few.join(many.where("y.index"), at).where("y.size <= x.size")))


def _by_rare_shingles(placed, texts, percent):
    """(key, node, size, at): exact buckets for the members that the first stars left undecided.

    Those are the members of buckets of three and more that still hold different
    components. Two sets as similar as asked share one of their rarest shingles:
    the first size - ceil(percent * size / 100) + 1 in the order of how many of
    these members hold them."""
    mixed = (placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n"))
             .where("lo != hi AND n > 2").select("key"))
    open_ = placed.join(mixed, "key", "left_semi").select("node", "size").distinct()

    def spread(batch, _):
        grams = batch.column(3).to_pylist()
        n = np.array([len(g) // 8 for g in grams])
        own = [batch.column(i).to_numpy().repeat(n) for i in range(3)]
        yield {"s1": own[0], "s2": own[1], "size": own[2], "key": np.frombuffer(b"".join(grams), dtype=np.int64)}

    rows = map_arrow(texts.join(open_, "node").select("node.s1", "node.s2", "size", "grams"), "grams", spread,
                     "s1 bigint, s2 bigint, size bigint, key bigint")
    rows = saved(rows, "shingles")
    held = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    own = Window.partitionBy("s1", "s2")
    ranked = rows.join(held, "key").select(
        "key", "s1", "s2", "size", F.row_number().over(own.orderBy("n", "key")).alias("at"), F.count("*").over(own).alias("shared"))
    prefix = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1
    ranked = ranked.withColumn("at", F.col("at") + F.col("size") - F.col("shared"))
    found = ranked.where(F.col("at") <= prefix).select("key", F.struct("s1", "s2").alias("node"), "size", "at")
    # the table is read in every round: as many files as its rows call for, dealt out behind the shuffle that ranks them
    return found.repartition(max(6, rows.count() // ROWS_PER_TASK), "key", "node")


def _sets_of(src, nodes, involved, k, lower):
    """(node, its sorted shingle fingerprints) for every node that meets another one."""
    wanted = nodes.select(F.struct("s1", "s2").alias("node"), "id").join(involved, "node").select("id")

    def collect(batch, texts):
        sets = shingle_sets(texts, k, lower)
        keys = np.array([set_key(s) for s in sets]).reshape(len(sets), 2)
        yield {"s1": keys[:, 0], "s2": keys[:, 1], "grams": [s.tobytes() for s in sets]}

    found = map_arrow(src.join(wanted.distinct(), "id", "left_semi").select("text"), "text", collect,
                      "s1 bigint, s2 bigint, grams binary", LAID_OUT)
    return (found.select(F.struct("s1", "s2").alias("node"), "grams").join(involved, "node", "left_semi")
            .groupBy("node").agg(F.min("grams").alias("grams")))


def _confirmed(edges, texts, percent):
    """The edges whose full sets are similar enough."""
    left = texts.select(F.col("node").alias("a"), F.col("grams").alias("ga"))
    right = texts.select(F.col("node").alias("b"), F.col("grams").alias("gb"))
    pairs = edges.join(left, "a").join(right, "b").select("a.*", "ga", F.struct("b.*").alias("b"), "gb")
    pairs = pairs.select(F.col("s1").alias("a1"), F.col("s2").alias("a2"), F.col("b.s1").alias("b1"),
                         F.col("b.s2").alias("b2"), "ga", "gb")

    def verify(batch, _):
        ga, gb = batch.column(4).to_pylist(), batch.column(5).to_pylist()
        ok = np.zeros(len(ga), dtype=bool)
        for i, (x, y) in enumerate(zip(ga, gb)):
            x, y = np.frombuffer(x, dtype=U64), np.frombuffer(y, dtype=U64)
            if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = 100 * common >= percent * (len(x) + len(y) - common)
        keep = np.flatnonzero(ok)
        yield {c: batch.column(j).take(keep) for j, c in enumerate(("a1", "a2", "b1", "b2"))}

    good = map_arrow(pairs, "ga", verify, "a1 bigint, a2 bigint, b1 bigint, b2 bigint")
    return good.select(F.struct(F.col("a1").alias("s1"), F.col("a2").alias("s2")).alias("a"),
                       F.struct(F.col("b1").alias("s1"), F.col("b2").alias("s2")).alias("b"))


def op9(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).drop("text_hash")
