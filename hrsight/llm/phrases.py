"""Phrase collocations from a weighted de Bruijn graph of word 4-grams, for each language.

Nodes are 3-word sequences, edges the 4-grams between overlapping nodes, their
weight the occurrences. Only the longest gram at each word is counted: a 4-gram,
or, where the piece ends sooner, the shorter rest (the piece-end correction). All
shorter counts follow by flow: a sequence occurs as often as the edges that leave
it plus the ends on it, so f of 3, 2 and 1 words are sums by prefix.

1. A pass counts words and neighbouring pairs in 2**`SIEVE_BITS` buckets, a
   second one the 3- and 4-grams whose pairs are in; the bit tables of the buckets
   with `least` occurrences or more are broadcast (their size is fixed). What isn't in
   them can't be part of a candidate, so the graph ends there as it does at the
   end of a piece: exact, the tables only leave out counts that nothing needs.
2. A pass emits the longest gram at each word, summed in bounded arrays of the
   task, and the words' texts; sums by key give the edges, the flows the rest.
3. Unary paths (all occurrences of a node come by one edge and leave by one)
   are compacted by pointer doubling. A node within a path is never a result: it
   lies in a longer candidate of the same count.
4. What is left is scored at its cuts; the best `top` of each language are kept.

Words are 64-bit fingerprints of language and word. All words that can be part of
a candidate are kept with their texts; two texts for one fingerprint are
detected, and the work is done again with another seed.

Defined results: null texts are empty; a null language is `und`; rows with equal
texts all count. No other column is looked at. Words of over 64 KiB have
fingerprints of their own kind; memory follows the number of words of one text.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hrsight.llm.tasks import _arrow_schema, drop, pieces, saved, ship
from hrsight.llm.textnp import _BASE, _INV, _LOWER, U64, mix64, powers

SIEVE_BITS, BLOCK_BITS = 26, 15
#: Rows that a task holds before it passes them on; bytes laid out at a time; bytes of a word that is hashed by itself.
HELD, STRETCH, LONG_WORD = 400_000, 1 << 18, 1 << 16
#: Characters of text whose words are in arrays at a time, and rows that are Python texts at a time.
PART, ROWS = 1 << 20, 500
KEY = ["c1", "c2", "c3", "c4"]
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?"]] = _KIND[0x0A:0x0E] = 2
#: Values of the bytes for a second, simpler fingerprint, which tells words of one fingerprint apart.
_MARK = mix64(np.arange(1000, 1256, dtype=U64))
_MARK[0x41:0x5B] = _MARK[0x61:0x7B]
_EDGE = re.compile(rb"[\x20\x09.,;:!?\x0A-\x0D]")


# ---- words ----

def words(texts, langs, seed=0):
    """(fingerprint, piece number, start, end, text number, sum of byte marks) of each word, and the bytes they lie in."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    whole = b"\n".join(raw) + b"\n"
    first = np.cumsum([0] + [len(r) + 1 for r in raw])[:-1]
    values = mix64(_LOWER + U64(seed)) if seed else _LOWER
    found, seps, at = [], 0, 0
    while at < len(whole):
        end = len(whole)
        if end - at > STRETCH:
            m = _EDGE.search(whole, at + STRETCH - 1)
            end = m.end()  # the last byte is one
        buf = np.frombuffer(whole, np.uint8, end - at, at)
        kind = _KIND[buf]
        inside = np.concatenate(([False], kind == 0, [False]))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, stop = edge[0::2], edge[1::2]
        n = len(buf)
        with np.errstate(over="ignore"):
            run = np.zeros(n + 1, dtype=U64)
            np.cumsum(values[buf] * powers(_BASE, n), out=run[1:])
            h = (run[stop] - run[start]) * powers(_INV, n)[start] + (stop - start).astype(U64)
            np.cumsum(_MARK[buf], out=run[1:])
            marks = run[stop] - run[start]
        for i in np.flatnonzero(stop - start > LONG_WORD):
            word = lowered(whole[at + start[i]:at + stop[i]])
            h[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
        breaks = np.concatenate(([0], np.cumsum(kind == 2)))
        found.append((h, breaks[start] + seps, start + at, stop + at, marks))
        seps, at = seps + int(breaks[-1]), end
    h, piece, start, stop, marks = (np.concatenate(x) for x in zip(*found))
    owner = np.searchsorted(first, start, side="right") - 1
    tongue = np.array([int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
                     for x in langs], dtype=U64)
    h = mix64(h ^ mix64(tongue + U64(seed))[owner]) if len(h) else h
    h[h == 0] = 1  # 0 stands for "no word"
    return h, piece, start, stop, owner, marks, whole


def lowered(raw):
    return raw.translate(bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)))


def bucket_of(key):
    return (mix64(key) >> U64(64 - SIEVE_BITS)).astype(np.int64)


def in_table(table, bucket):
    return (table[bucket >> 3] >> (bucket & 7).astype(np.uint8) & 1).astype(bool)


def neighbours(piece, size):
    """Whether the `size` words from each word on are in one piece (its numbers never fall)."""
    n = len(piece) - size + 1
    return piece[:n] == piece[size - 1:] if n > 0 else np.zeros(0, bool)


def gram_buckets(h, size):
    """The bucket of the `size` words from each word on."""
    n = max(0, len(h) - size + 1)
    key = h[:n] + U64(size)
    with np.errstate(over="ignore"):
        for j in range(1, size):
            key = mix64(key * U64(0xD6E8FEB86659FD93) + h[j:j + n])
    return bucket_of(key)


def frequent_links(h, piece, table):
    """Whether each word and the next are a pair of the table within a piece."""
    return neighbours(piece, 2) & in_table(table, gram_buckets(h, 2))


def frequent_grams(h, linked, size, table=None):
    """Whether the `size` words from each word on are linked and, given a table, in it; and their buckets where linked."""
    n = max(0, len(h) - size + 1)
    on = np.ones(n, dtype=bool)
    for j in range(size - 1):
        on &= linked[j:j + n]
    at = np.flatnonzero(on)
    key = h[at] + U64(size)
    with np.errstate(over="ignore"):
        for j in range(1, size):
            key = mix64(key * U64(0xD6E8FEB86659FD93) + h[at + j])
    bucket = bucket_of(key)
    if table is not None:
        on[at] = in_table(table, bucket)
    return on, bucket


def longest_grams(h, linked, triples, quads):
    """Four columns: at each word the longest gram that the tables leave, 0 where it ends sooner."""
    out = np.zeros((4, len(h)), dtype=U64)
    out[0] = h
    for j, on in ((1, linked), (2, triples), (3, quads & triples[:-1] & triples[1:])):
        n = len(h) - j
        if n > 0:
            out[j, :n] = np.where(on, h[j:], U64(0))
    return out


class Sums:
    """Sums of n by the columns of a key, in arrays of bounded size."""

    def __init__(self, width, kind):
        self.width, self.kind = width, kind
        self.keys, self.n, self.size = [], [], 0

    def add(self, keys, n):
        self.keys.append(keys)
        self.n.append(n)
        self.size += len(n)
        return self.size > HELD * 5 // 4 and self.merge() > HELD

    def merge(self):
        if not self.keys:
            return 0
        keys, n = np.concatenate(self.keys, axis=1), np.concatenate(self.n)
        with np.errstate(over="ignore"):
            mixed = keys[0].astype(U64)
            for j in range(1, self.width):
                mixed = mix64(mixed * U64(0xA0761D6478BD642F) + keys[j])
        order = np.argsort(mixed, kind="stable")
        keys, n = keys[:, order], n[order]
        # equal keys are neighbours; should different keys share a mixed value, a key only gets more than one row
        new = np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0))) if len(n) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        self.keys, self.n = [keys[:, at]], [np.add.reduceat(n, at) if len(at) else n]
        self.size = len(at)
        return self.size

    def taken(self, rare=False):
        """All sums, or the smaller half of them: what a task meets often stays and is passed on once."""
        self.merge()
        if rare and self.size > 1:
            keys, n = self.keys[0], self.n[0]
            order = np.argpartition(n, len(n) // 2)
            low, high = order[:len(n) // 2], np.sort(order[len(n) // 2:])
            self.keys, self.n, self.size = [keys[:, high]], [n[high]], len(high)
            return keys[:, low], n[low]
        out = (self.keys[0], self.n[0]) if self.keys else (np.zeros((self.width, 0), self.kind), np.zeros(0, np.int64))
        self.keys, self.n, self.size = [], [], 0
        return out


def _parts(batches):
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS):
            for part, texts in pieces(batch.slice(first, ROWS), "text", PART):
                yield texts, part.column(1).to_pylist()


# ---- sieve ----

def sieve(src: DataFrame, least: int, seed: int, pairs: np.ndarray | None = None) -> np.ndarray:
    """Bits of the buckets with `least` occurrences or more: of words and pairs, or, given their table, of 3- and 4-grams."""
    names = ["bucket", "n"]
    shared = None if pairs is None else src.sparkSession.sparkContext.broadcast(pairs)

    def buckets(h, piece):
        if shared is None:
            return np.concatenate((gram_buckets(h, 1), gram_buckets(h, 2)[neighbours(piece, 2)]))
        linked = frequent_links(h, piece, shared.value)
        return np.concatenate([frequent_grams(h, linked, size)[1] for size in (3, 4)])

    def count(batches):
        sums = Sums(1, np.int64)

        def rows():
            keys, n = sums.taken()
            yield pa.RecordBatch.from_arrays([pa.array(keys[0].astype(np.int32)), pa.array(n)], names=names)

        for texts, langs in _parts(batches):
            h, piece, *_ = words(texts, langs, seed)
            if not len(h):
                continue
            got, n = np.unique(buckets(h, piece), return_counts=True)
            if sums.add(got[None, :], n.astype(np.int64)):
                yield from rows()
        yield from rows()

    def bits(batches):
        blocks = {}
        for batch in batches:
            bucket = batch.column(0).to_numpy().astype(np.int64)
            for b in np.unique(bucket >> BLOCK_BITS).tolist():
                blocks.setdefault(b, np.zeros(1 << BLOCK_BITS, dtype=bool))[bucket[bucket >> BLOCK_BITS == b] & ((1 << BLOCK_BITS) - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array(
            [np.packbits(x, bitorder="little").tobytes() for x in blocks.values()], pa.binary())], names=["block", "bits"])

    ship(src.sparkSession)
    often = (src.mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
             .select("bucket", F.expr(f"bucket div {1 << BLOCK_BITS}").alias("block")))
    got = often.repartition("block").select("bucket").mapInArrow(bits, "block int, bits binary").collect()
    out = np.zeros((1 << SIEVE_BITS - BLOCK_BITS, 1 << BLOCK_BITS - 3), dtype=np.uint8)
    for r in got:  # one row for each block: as many bytes as the table has
        out[r.block] = np.frombuffer(bytes(r.bits), np.uint8)
    return out.reshape(-1)


# ---- edges ----

def emitted(src: DataFrame, pairs: np.ndarray, longer: np.ndarray, seed: int) -> DataFrame:
    """Rows of grams (c1 to c4, n > 0), of words (c1, lang, word, n = 0) and of totals (lang, n), in a table."""
    ddl = "c1 bigint, c2 bigint, c3 bigint, c4 bigint, n bigint, lang string, word string"
    schema = _arrow_schema(src.sparkSession, ddl)
    shared = src.sparkSession.sparkContext.broadcast((pairs, longer))
    ship(src.sparkSession)

    def run(batches):
        often, longer = shared.value
        sums, known, totals = Sums(4, U64), set(), {}

        def batch_of(**cols):
            m = len(next(iter(cols.values())))
            return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(m, f.type) for f in schema],
                                              schema=schema)

        def grams(rare=False):
            keys, n = sums.taken(rare)
            for i in range(0, len(n), 1 << 17):
                k = keys[:, i:i + (1 << 17)].view(np.int64)
                yield batch_of(c1=k[0], c2=k[1], c3=k[2], c4=k[3], n=n[i:i + (1 << 17)])

        for texts, langs in _parts(batches):
            h, piece, start, stop, owner, marks, whole = words(texts, langs, seed)
            for lang, n in zip(langs, np.bincount(owner, minlength=len(texts)).tolist()):
                totals[lang] = totals.get(lang, 0) + n
            if not len(h):
                continue
            linked = frequent_links(h, piece, often)
            used = np.zeros(len(h), dtype=bool)
            used[:-1] |= linked
            used[1:] |= linked
            some = np.flatnonzero(used)
            both, at = np.unique(mix64(h[some] ^ mix64(marks[some])), return_index=True)
            fresh = [(b, some[i]) for b, i in zip(both.tolist(), at.tolist()) if b not in known]
            if len(known) > HELD // 2:
                known.clear()
            known.update(b for b, _ in fresh)
            if fresh:
                yield batch_of(c1=h[[i for _, i in fresh]].view(np.int64), n=[0] * len(fresh), lang=[langs[owner[i]] for _, i in fresh],
                               word=[lowered(whole[start[i]:stop[i]]).decode("utf-8", "surrogatepass") for _, i in fresh])
            triples, quads = (frequent_grams(h, linked, size, longer)[0] for size in (3, 4))
            grown = longest_grams(h, linked, triples, quads)[:, in_table(often, gram_buckets(h, 1))]
            if sums.add(grown, np.ones(grown.shape[1], dtype=np.int64)):
                yield from grams(rare=True)
        yield from grams()
        yield batch_of(lang=list(totals), n=list(totals.values()))

    return saved(src.mapInArrow(run, ddl), "grams")


def flows(rows: DataFrame, least: int) -> DataFrame:
    """(c1 to c4, n): all sequences of 1 to 4 words with `least` occurrences or more, shorter ones padded with 0."""
    zero = F.lit(0).cast("bigint")
    four = saved(rows.where("c1 IS NOT NULL AND n > 0").groupBy(*KEY).agg(F.sum("n").alias("n")), "flow4")
    three = saved(four.groupBy(*KEY[:3]).agg(F.sum("n").alias("n")), "flow3")
    two = three.groupBy(*KEY[:2]).agg(F.sum("n").alias("n"))
    one = two.groupBy("c1").agg(F.sum("n").alias("n"))
    out = (four.where("c4 <> 0")
           .unionByName(three.where("c3 <> 0").withColumn("c4", zero))
           .unionByName(two.where("c2 <> 0").withColumn("c3", zero).withColumn("c4", zero))
           .unionByName(one.withColumn("c2", zero).withColumn("c3", zero).withColumn("c4", zero)))
    out = saved(out.where(F.col("n") >= least).select(*KEY, "n"), "flows")
    drop(four, three)
    return out


def contigs(frequent: DataFrame) -> DataFrame:
    """(words, n): the graph's paths, unary nodes compacted; words is the array of a path's words, n its edges' weight.

    A node is unary if one edge brings and one edge takes all its occurrences. Every edge is in exactly one path.
    """
    tail, head = ["c1", "c2", "c3"], ["c2", "c3", "c4"]
    node = frequent.where("c4 = 0 AND c3 <> 0")
    edges = saved(frequent.where("c4 <> 0").withColumn("edge", F.monotonically_increasing_id()), "edges")
    v = ["v1", "v2", "v3"]
    named = node.select(*[F.col(c).alias(x) for c, x in zip(tail, v)], F.col("n").alias("all"))
    leaving = edges.select(*[F.col(c).alias(x) for c, x in zip(tail, v)], "edge", F.col("n").alias("all")).join(named, [*v, "all"])
    coming = edges.select(*[F.col(c).alias(x) for c, x in zip(head, v)], F.col("edge").alias("root"), F.col("n").alias("all"))
    before = leaving.join(coming, [*v, "all"]).select("edge", "root")
    step = saved(edges.select("edge").join(before, "edge", "left")
                 .select("edge", F.coalesce("root", "edge").alias("root"), F.col("root").isNotNull().cast("bigint").alias("place")), "paths")
    while True:
        back = step.where("place > 0").select(F.col("edge").alias("root"), F.col("root").alias("further"), F.col("place").alias("more"))
        if step.where("place > 0").join(back, "root", "left_semi").isEmpty():
            break
        longer = saved(step.join(back, "root", "left").select("edge", F.coalesce("further", "root").alias("root"),
                                                              (F.col("place") + F.coalesce("more", F.lit(0))).alias("place")), "paths")
        drop(step)
        step = longer
    # a path is part of one text, so its length is bounded by that of a text
    path = (edges.join(step, "edge").groupBy("root")
            .agg(F.array_sort(F.collect_list(F.struct("place", *KEY))).alias("p"), F.max("n").alias("n")))
    return path.select(F.concat(F.array(*[F.col("p")[0][c] for c in tail]),
                                F.transform("p", lambda x: x["c4"])).alias("words"), "n")


def windows(array: str, size: int) -> str:
    """SQL: all `size`-word windows of an array column as keys."""
    cols = ", ".join(f"'c{j + 1}', " + (f"{array}[i + {j}]" if j < size else "0L") for j in range(4))
    return (f"CASE WHEN size({array}) >= {size} THEN transform(sequence(0, size({array}) - {size}), i -> named_struct({cols})) "
            "ELSE array() END")


def candidates(frequent: DataFrame, paths: DataFrame, share: int = 80) -> DataFrame:
    """(c1 to c4, a) of the phrases that no longer phrase with 100 * f >= share * a holds."""
    four = paths.select(F.explode(F.expr(windows("words", 4))).alias("k"), F.col("n").alias("a")).select("k.*", "a")
    inner = paths.where("size(words) > 4").select(F.explode(F.expr(
        windows("slice(words, 2, size(words) - 2)", 3))).alias("k")).select("k.*")
    three = frequent.where("c4 = 0 AND c3 <> 0").withColumnRenamed("n", "a").join(inner, KEY, "left_anti")
    two = frequent.where("c3 = 0 AND c2 <> 0").withColumnRenamed("n", "a")
    held = (paths.select(F.explode(F.concat(F.expr(windows("words", 3)), F.expr(windows("words", 2)))).alias("k"), "n")
            .unionByName(three.select(F.explode(F.array(*[F.struct(F.col(x).alias("c1"), F.col(y).alias("c2"), F.lit(0).cast("bigint").alias("c3"),
                                                                   F.lit(0).cast("bigint").alias("c4")) for x, y in (("c1", "c2"), ("c2", "c3"))]))
                                      .alias("k"), F.col("a").alias("n")))
            .select("k.*", "n").groupBy(*KEY).agg(F.max("n").alias("longer")))
    short = three.select(*KEY, "a").unionByName(two.select(*KEY, "a")).join(held, KEY, "left")
    alone = short.where(F.coalesce(F.col("longer") * 100 < F.col("a") * share, F.lit(True))).select(*KEY, "a")
    return four.select(*KEY, "a").unionByName(alone)


def scored(found: DataFrame, frequent: DataFrame) -> DataFrame:
    """(c1 to c4, a, l, r, score) at the lowest-scoring cut, the first one on ties."""
    def key(cols):
        return F.struct(*[(F.col(cols[j]) if j < len(cols) else F.lit(0).cast("bigint")).alias(f"c{j + 1}") for j in range(4)])

    def cuts(size):
        return F.array(*[F.struct(F.lit(k).alias("k"), key(KEY[:k]).alias("first"), key(KEY[k:size]).alias("rest")) for k in range(1, size)])

    each = found.select(*KEY, "a", F.explode(F.when(F.col("c3") == 0, cuts(2)).when(F.col("c4") == 0, cuts(3)).otherwise(cuts(4))).alias("cut")) \
        .select(*KEY, "a", "cut.*")
    counts = frequent.select(F.struct(*KEY).alias("key"), "n")
    both = (each.join(counts.select(F.col("key").alias("first"), F.col("n").alias("l")), "first")
            .join(counts.select(F.col("key").alias("rest"), F.col("n").alias("r")), "rest"))
    exact = F.expr("(CAST(a AS DECIMAL(20, 0)) * 2000000) div (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))")
    return (both.withColumn("score", exact).groupBy(*KEY, "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
            .select(*KEY, "a", "m.l", "m.r", "m.score"))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, share: int = 80, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best `top` phrases of 2 to 4 words of each language."""
    src = docs.select(F.col(f"`{text_col}`").alias("text"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"))
    for seed in range(8):
        pairs = sieve(src, least, seed)
        rows = emitted(src, pairs, sieve(src, least, seed, pairs), seed)
        texts = saved(rows.where("n = 0 AND word IS NOT NULL").groupBy("c1").agg(
            F.min(F.struct("lang", "word")).alias("t"), F.max(F.struct("lang", "word")).alias("u")), "words")
        if texts.where("t <> u").isEmpty():
            break
        drop(rows, texts)
    else:
        raise RuntimeError("word fingerprints collide with every seed")
    frequent = flows(rows, least)
    paths = saved(contigs(frequent), "contigs")
    best = scored(candidates(frequent, paths, share), frequent)
    texts = texts.select(F.col("c1").alias("code"), "t.lang", "t.word")
    order = [F.desc("score"), F.desc("a")]
    first = best.join(texts, best["c1"] == texts["code"]).drop("code").withColumnRenamed("word", "w1")
    # ties at the end are all kept until the phrases themselves can be compared
    first = first.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= top)
    for j in (2, 3, 4):
        more = texts.select(F.col("code").alias(f"c{j}"), F.col("word").alias(f"w{j}"))
        first = first.join(more, f"c{j}", "left")
    total = rows.where("c1 IS NULL").groupBy(F.col("lang").alias("lang")).agg(F.sum("n").alias("n"))
    named = first.withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3", "w4"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))
    return (named.withColumn("rank", place.cast("bigint")).where(F.col("rank") <= top).join(total, "lang")
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


def op13(spark, sf_dir):
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))


#: The contract in DuckDB SQL.
ORACLE = r"""
WITH w AS (
  SELECT lang, piece, [x for x in regexp_split_to_array(body, '[\x20\x09]+') if x <> ''] AS ws
  FROM (SELECT lang, row_number() OVER () AS piece, body
        FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[.,;:!?\x0A-\x0D]')) AS body FROM documents))),
total AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
grams AS (
  SELECT lang, p, len(p) AS size, count(*) AS a
  FROM (SELECT lang, unnest([ws[i:i + s - 1] for i in range(1, len(ws) - s + 2)]) AS p
        FROM w, (VALUES (1), (2), (3), (4)) AS sizes(s) WHERE len(ws) >= s)
  GROUP BY lang, p),
cand AS (SELECT * FROM grams WHERE size >= 2 AND a >= 30),
inside AS (
  SELECT lang, sub, max(a) AS longer
  FROM (SELECT lang, a, unnest([p[i:i + s - 1] for i in range(1, size - s + 2)]) AS sub
        FROM cand, (VALUES (2), (3)) AS sizes(s) WHERE size > s)
  GROUP BY lang, sub),
kept AS (
  SELECT c.* FROM cand c LEFT JOIN inside i ON c.lang = i.lang AND c.p = i.sub
  WHERE i.longer IS NULL OR 100 * i.longer < 80 * c.a),
cuts AS (
  SELECT k.lang, k.p, k.a, c.k, f.a AS l, r.a AS r, ((2000000::HUGEINT * k.a) // (f.a + r.a))::BIGINT AS score
  FROM kept k JOIN (VALUES (1), (2), (3)) AS c(k) ON c.k < k.size
  JOIN grams f ON f.lang = k.lang AND f.p = k.p[1:c.k]
  JOIN grams r ON r.lang = k.lang AND r.p = k.p[c.k + 1:k.size]),
lowest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS o FROM cuts) WHERE o = 1),
ranked AS (
  SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, score,
         row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank
  FROM lowest)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total ON ranked.lang = total.lang WHERE rank <= 2000
"""
