"""Alignment of two tokenizers over the same text: common cuts, links, corpus counts of linked id pairs.

Tokenizer A is a byte-level BPE file of the tokenizers library, run on blank +
text; tokenizer B is a sentencepiece model that adds that blank itself. The
character offsets of A and the spans of B's proto (this sentencepiece release
calls the immutable proto 'proto') give coarse cuts: places where both have a
clean token end. A coarse piece whose characters are all single bytes needs no
more; within any other, where a character is spread over several tokens, the
ends come from the decoded bytes of the tokens.

Both tokenizers work on units of text (`Pair.units`), each aligned once per
worker and cached; a unit's end is an end of both, so a text's groups and links
are those of its units one after the other. Whether B may be cut like that is
read from its vocabulary; if not, whole texts are the units.

Counting: each task counts the documents of each id pair in arrays of bounded
size, so the shuffle carries one row for each pair and task. The counts come
back in two tiers: the most frequent pairs (at most `TABLE`) as a broadcast
table, all others by a join of the pairs that the table lacks; a rare pair has
few rows, so no key of that join is hot.

Defined results: texts that are null or empty, or whose joined bytes of either
tokenizer differ from blank + text, have no tokens: zeros and ''. Every row is a
document of its own, rows with equal or null ids included; other columns are not
looked at. Long texts are taken in stretches. A unit without any cut, such as a
megabyte of letters, is aligned in one piece.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hrsight.llm.encode import byte_symbols
from hrsight.llm.tasks import _arrow_schema, _array, drop, pieces, saved, ship

#: Units and parts of units in a generation of the worker's caches; characters of a stretch.
YOUNG, PARTS, STRETCH = 150_000, 350_000, 1 << 20
#: Pairs in the broadcast table; pairs that a task holds; pairs in a row of counts.
TABLE, HELD, ROW = 1 << 20, 1 << 20, 1 << 16
_CUT = re.compile(r"(?<=\S) ")
_AFTER_BLANK = re.compile(r"\s ")
# Letters of the Latin blocks and a tail of ASCII signs other than the apostrophe.
_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@\[-`{-~]*)").fullmatch
_pairs: dict = {}


def pair(a_path, b_path):
    """The worker's pair of tokenizers."""
    if (a_path, b_path) not in _pairs:
        _pairs[a_path, b_path] = Pair(a_path, b_path)
    return _pairs[a_path, b_path]


def coarse_cuts(spans):
    """Offsets at which a token ends and that no token reaches over; (offset, tokens before it)."""
    out, far = [], 0
    for i, (begin, end) in enumerate(spans):
        # tokens without a span of their own begin where their character begins
        if i and begin >= far and far > 0 and (not out or far > out[-1][0]) and all(b >= far for b, _ in spans[i:i + 8]):
            out.append((far, i))
        far = max(far, end)
    out.append((far, len(spans)))
    return out


def whole_characters(spans):
    """Whether every token has characters of its own (the first may be a blank that was put before the text)."""
    return all(e > b for b, e in spans) and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))


class Pair:
    def __init__(self, a_path, b_path):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        back = {s: b for b, s in byte_symbols().items()}
        size = max(self.a.get_vocab(with_added_tokens=True).values()) + 1
        names = [self.a.id_to_token(i) or "" for i in range(size)]
        self.a_bytes = [bytes(back[c] for c in s) if all(c in back for c in s) else s.encode() for s in names]
        n = self.b.get_piece_size()
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[1:-1], 16)]) if self.b.is_byte(i) else
                        self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
        self.base = n
        self.code = np.dtype("<u4" if size * n <= 1 << 32 else "<u8")
        self.a_text, self.b_text = [str(i) for i in range(size)], [str(i) for i in range(n)]
        spec = json.loads(self.a.to_str())
        pre = spec.get("pre_tokenizer") or {}
        plain = (spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                 and not pre.get("add_prefix_space") and spec["model"]["type"] == "BPE")
        normal = [self.b.id_to_piece(i) for i in range(n) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        same = self.b.normalize("a  b\tc\nd ") == "▁a▁▁b\tc\nd▁" if hasattr(self.b, "normalize") else False
        self.cut = plain and same and not any("▁" in s.lstrip("▁") for s in normal)
        inner = [s.lstrip("▁") for s in normal]
        # no piece joins a letter with anything but letters, and a line end is a byte piece: words and signs are apart
        self.fine = self.cut and all(s.isalpha() or not any(c.isalpha() for c in s) for s in inner if s) and not any(
            "\n" in s for s in inner)
        self.young, self.old, self.parts, self.old_parts = {}, {}, {}, {}

    # ---- units ----

    def units(self, text):
        """Lists of units of blank + text, stretch by stretch; a unit is given without its leading blank."""
        if not self.cut:
            yield [text]
            return
        whole, at = " " + text, 0
        while at < len(whole):
            end = len(whole)
            if end - at > STRETCH:
                m = _CUT.search(whole, at + STRETCH)
                end = m.start() if m else end
            part = whole[at:end] if at or end < len(whole) else whole
            if _AFTER_BLANK.search(part):
                got = _CUT.split(part)
                got[0] = got[0][1:]
            else:
                got = part.split(" ")[1:]
            yield got
            at = end

    def found(self, lists):
        """For each list of units their entries: (groups, codes of links, tokens of A, of B, groups' number), False where bytes differ."""
        young = self.young
        got = [list(map(young.get, units)) for units in lists]
        lacking = [i for i, entries in enumerate(got) if None in entries]
        if lacking:
            new = self.fill(dict.fromkeys(u for i in lacking for u, e in zip(lists[i], got[i]) if e is None))
            for i in lacking:
                got[i] = [new[u] if e is None else e for u, e in zip(lists[i], got[i])]
        return got

    def fill(self, missing):
        if len(self.young) + len(missing) > YOUNG:
            self.old, self.young = self.young, {}
        if len(self.parts) > PARTS:
            self.old_parts, self.parts = self.parts, {}
        out, split, wanted = {}, [], {}
        parts, older = self.parts, self.old_parts
        for u in missing:
            e = self.old.get(u)
            if e is not None:
                out[u] = self.young[u] = e
                continue
            keys = self.keys(u)
            split.append((u, keys))
            for k in keys:
                if k not in parts:
                    e = older.get(k)
                    if e is None:
                        wanted[k] = None
                    else:
                        parts[k] = e
        wanted = list(wanted)
        for i in range(0, len(wanted), 2000):
            some = wanted[i:i + 2000]
            parts.update(zip(some, self.aligned(some)))
        for u, keys in split:
            if len(keys) == 1:
                e = parts[keys[0]]
            elif len(keys) == 2:
                x, y = parts[keys[0]], parts[keys[1]]
                e = x and y and (x[0] + ";" + y[0], x[1] + y[1], x[2] + y[2], x[3] + y[3], x[4] + y[4])
            else:
                es = [parts[k] for k in keys]
                e = False if False in es else (";".join([x[0] for x in es]), b"".join([x[1] for x in es]),
                                              sum([x[2] for x in es]), sum([x[3] for x in es]), sum([x[4] for x in es]))
            out[u] = e
            if len(u) < 64 and "\n" not in u:
                self.young[u] = e
        return out

    def keys(self, u):
        """Parts of a unit: blank + word, line end + word, or a run of signs; else blank + unit in one piece."""
        if self.fine:
            lines = [_WORD(x) for x in u.split("\n")]
            if all(lines):
                keys = []
                for i, m in enumerate(lines):
                    keys.append(("\n" if i else " ") + m[1])
                    if m[2]:
                        keys.append(m[2])
                return keys
        return [" " + u]

    # ---- one part ----

    def aligned(self, keys):
        """Entries of parts, both tokenizers called once for all."""
        fed, drop_, shift = [], [], []
        for k in keys:
            if k == " ":  # B gives nothing for an empty text
                fed.append("\n ")
                drop_.append(2)
                shift.append(-1)
            elif k[0] == " ":
                fed.append(k[1:])
                drop_.append(0)
                shift.append(1)
            elif k[0] == "\n":
                fed.append(k)
                drop_.append(1)  # the blank that B adds
                shift.append(0)
            else:
                fed.append("\n" + k)
                drop_.append(2)  # that blank and the line end
                shift.append(-1)
        left = self.a.encode_batch(keys, add_special_tokens=False)
        right = self.b.encode(fed, return_type="proto", num_threads=1)
        return [self.align(k, x, y, d, s) for k, x, y, d, s in zip(keys, left, right, drop_, shift)]

    def align(self, key, left, right, dropped, shift):
        raw = key.encode()
        ids_a = left.ids
        tokens = list(right.pieces)[dropped:]
        ids_b = [t.id for t in tokens]
        a_bytes, b_bytes = self.a_bytes, self.b_bytes
        if b"".join([a_bytes[i] for i in ids_a]) != raw or b"".join([b_bytes[i] for i in ids_b]) != raw:
            return False
        if key.isascii():
            ends_a = [e for _, e in left.offsets]
            ends_b = [t.end + shift for t in tokens]
        else:
            ends_a, ends_b = self.refined(key, raw, left.offsets, ids_a, tokens, ids_b, shift)
        return self.entry(ids_a, ends_a, ids_b, ends_b)

    def refined(self, key, raw, offsets, ids_a, tokens, ids_b, shift):
        """Byte ends of the tokens of both: coarse cuts from the offsets, decoded bytes in between."""
        at = [0, *accumulate([len(c.encode()) for c in key])]
        spans_a = [(at[b], at[e]) for b, e in offsets]
        spans_b = [(max(0, t.begin + shift), t.end + shift) for t in tokens]
        if whole_characters(spans_a) and whole_characters(spans_b):
            return [e for _, e in spans_a], [e for _, e in spans_b]
        cuts_a, cuts_b = dict(coarse_cuts(spans_a)), dict(coarse_cuts(spans_b))
        ends_a, ends_b, i, j, begin = [], [], 0, 0, 0
        for cut in sorted(cuts_a.keys() & cuts_b.keys()):
            for ids, known, spans, first, last, ends in ((ids_a, self.a_bytes, spans_a, i, cuts_a[cut], ends_a),
                                                         (ids_b, self.b_bytes, spans_b, j, cuts_b[cut], ends_b)):
                part = [known[x] for x in ids[first:last]]
                if b"".join(part) != raw[begin:cut]:
                    raise ValueError(f"token bytes and spans disagree in {key!r}")
                if cut - begin == len(raw[begin:cut].decode()):  # single bytes only: the spans are exact
                    ends.extend(max(e, begin) for _, e in spans[first:last])
                else:
                    size = begin
                    for x in part:
                        size += len(x)
                        ends.append(size)
            i, j, begin = cuts_a[cut], cuts_b[cut], cut
        return ends_a, ends_b

    def entry(self, ids_a, ends_a, ids_b, ends_b):
        base, a_text, b_text, n_a, n_b = self.base, self.a_text, self.b_text, len(ids_a), len(ids_b)
        if n_a == 1 and n_b == 1:
            return (a_text[ids_a[0]] + "|" + b_text[ids_b[0]], (ids_a[0] * base + ids_b[0]).to_bytes(self.code.itemsize, "little"), 1, 1, 1)
        i = j = gi = gj = 0
        groups, links = [], []
        while i < n_a and j < n_b:
            links.append(ids_a[i] * base + ids_b[j])
            x, y = ends_a[i], ends_b[j]
            if x <= y:
                i += 1
            if y <= x:
                j += 1
                if x == y:
                    groups.append(",".join([a_text[t] for t in ids_a[gi:i]]) + "|" + ",".join([b_text[t] for t in ids_b[gj:j]]))
                    gi, gj = i, j
        return ";".join(groups), np.array(links, dtype=self.code).tobytes(), n_a, n_b, len(groups)

    # ---- one text ----

    def documents(self, texts, with_groups=False):
        """Of each text (tokens of A, of B, groups, links, sha256 of the groups, codes of linked pairs, their times, groups' text)."""
        short = [i for i, t in enumerate(texts) if t and len(t) < STRETCH]
        ready = dict(zip(short, self.found([next(self.units(texts[i])) for i in short])))
        for i, t in enumerate(texts):
            if i in ready:
                yield self.document([ready.pop(i)], with_groups)
            else:
                yield self.document((self.found([units])[0] for units in self.units(t)) if t else (), with_groups)

    def document(self, stretches, with_groups):
        n_a = n_b = n_groups = 0
        digest, codes, kept = hashlib.sha256(), [], []
        for k, entries in enumerate(stretches):
            if False in entries:
                n_a = 0
                break
            groups, links, a, b, n = zip(*entries)
            joined = ";".join(groups)
            digest.update((";" + joined if k else joined).encode())
            if with_groups:
                kept.append(joined)
            codes.append(b"".join(links))
            n_a, n_b, n_groups = n_a + sum(a), n_b + sum(b), n_groups + sum(n)
        if not n_a:
            return 0, 0, 0, 0, "", np.zeros(0, self.code), np.zeros(0, np.uint32), ""
        flat = np.frombuffer(b"".join(codes), dtype=self.code).copy()
        flat.sort()
        first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
        times = np.diff(np.append(first, len(flat))).astype(np.uint32)
        return n_a, n_b, n_groups, len(flat), digest.hexdigest(), flat[first], times, ";".join(kept)


class Counts:
    """Documents of each pair, in sorted arrays of at most about `HELD` pairs."""

    def __init__(self, code):
        self.codes, self.n = np.zeros(0, code), np.zeros(0, np.int64)
        self.new, self.size = [], 0

    def add(self, codes):
        self.new.append(codes)
        self.size += len(codes)
        return self.size > 2 * HELD and self.merge() > HELD

    def merge(self):
        if self.new:
            codes, n = np.unique(np.concatenate(self.new), return_counts=True)
            self.new, self.size = [], 0
            both = np.concatenate((self.codes, codes))
            self.codes, where = np.unique(both, return_inverse=True)
            self.n = np.bincount(where, weights=np.concatenate((self.n, n)), minlength=len(self.codes)).astype(np.int64)
        return len(self.codes)

    def blocks(self):
        self.merge()
        for i in range(0, len(self.codes), ROW):
            yield self.codes[i:i + ROW], self.n[i:i + ROW]
        self.codes, self.n = self.codes[:0], self.n[:0]


def _encoded(src: DataFrame, a_path: str, b_path: str, with_groups: bool) -> DataFrame:
    """Rows of documents (uid set) and rows of counts (uid null), in a table of the shared folder."""
    id_type = src.schema["id"].dataType.simpleString()
    ddl = (f"uid bigint, id {id_type}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
           "codes binary, times binary, grouping string")
    schema = _arrow_schema(src.sparkSession, ddl)
    ship(src.sparkSession)

    def run(batches):
        both = pair(a_path, b_path)
        counts = Counts(both.code)
        uid = TaskContext.get().partitionId() << 40

        def flushed():
            for codes, n in counts.blocks():
                row = [None] * 7 + [codes.astype("<i8").tobytes(), n.tobytes(), None]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        for batch in batches:
            for part, texts in pieces(batch, "text"):
                cols = [[] for _ in range(8)]
                full = False
                gc.disable()  # the cached entries hold no cycles, and collections would walk all of them
                for n_a, n_b, n_groups, n_links, digest, codes, times, kept in both.documents(texts, with_groups):
                    full = counts.add(codes) or full
                    for c, v in zip(cols, (n_a, n_b, n_groups, n_links, digest, codes.tobytes(), times.tobytes(), kept)):
                        c.append(v)
                gc.enable()
                made = [list(range(uid, uid + len(texts))), part.column(part.schema.get_field_index("id")), *cols]
                uid += len(texts)
                yield pa.RecordBatch.from_arrays([_array(c, f.type) for c, f in zip(made, schema)], schema=schema)
                if full:
                    yield from flushed()
        yield from flushed()

    return saved(src.mapInArrow(run, ddl), "aligned", compression="zstd")


def pair_counts(encoded: DataFrame, base: int) -> DataFrame:
    """code, n (documents that hold the pair linked), best (n is the highest of its A id)."""

    def unpack(batches):
        for batch in batches:
            codes, n = (b"".join(c.to_pylist()) for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(codes, "<i8")), pa.array(np.frombuffer(n, "<i8"))], names=["code", "n"])

    rows = encoded.where("uid IS NULL").select("codes", "times").mapInArrow(unpack, "code bigint, n bigint")
    counts = saved(rows.groupBy("code").agg(F.sum("n").alias("n")), "pair-counts")
    a = F.expr(f"code div {base}")
    highest = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    # one row for each id of A's vocabulary at most
    return counts.withColumn("a", a).join(F.broadcast(highest), "a").select("code", "n", (F.col("n") == F.col("most")).alias("best"))


def frequent(counts: DataFrame, limit: int = TABLE):
    """(smallest count that is in the table, the table): all pairs with that count or more, at most `limit` of them."""
    spread = {r.b: r.pairs for r in counts.groupBy(F.floor(F.log2("n") * 8).cast("int").alias("b")).agg(F.count("*").alias("pairs")).collect()}
    total, cut = 0, None
    for b in sorted(spread, reverse=True):
        if total + spread[b] > limit:
            break
        total, cut = total + spread[b], b
    complete = total == sum(spread.values())
    if cut is None:
        return F.lit(False), False, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
    here = F.floor(F.log2("n") * 8).cast("int") >= cut
    got = counts.where(here).toArrow()
    codes, n, best = (got.column(c).to_numpy() for c in ("code", "n", "best"))
    order = np.argsort(codes)
    return here, complete, (codes[order], n[order], best[order].astype(bool))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text",
          with_groups: bool = False, table: int = TABLE) -> DataFrame:
    """Per input row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and the groups if `with_groups`."""
    spark = docs.sparkSession
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    id_type = src.schema["id"].dataType.simpleString()
    both = pair(a_path, b_path)
    width = both.code.str
    encoded = _encoded(src, a_path, b_path, with_groups)
    counts = saved(pair_counts(encoded, both.base), "pair-best")
    here, complete, arrays = frequent(counts, table)
    shared = spark.sparkContext.broadcast(arrays)
    head = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "grouping"]
    ddl = (f"uid bigint, id {id_type}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
           "grouping string, n_best bigint, count_sum bigint, missed array<bigint>, missed_times array<bigint>")
    schema = _arrow_schema(spark, ddl)

    def look_up(batches):
        known, n, best = shared.value
        for batch in batches:
            raws = batch.column(8).to_pylist()
            sizes = np.array([len(r) for r in raws]) // np.dtype(width).itemsize
            codes = np.frombuffer(b"".join(raws), dtype=width).astype(np.int64)
            times = np.frombuffer(b"".join(batch.column(9).to_pylist()), dtype="<u4").astype(np.int64)
            owner = np.repeat(np.arange(len(raws)), sizes)
            at = np.minimum(np.searchsorted(known, codes), max(0, len(known) - 1))
            hit = known[at] == codes if len(known) else np.zeros(len(codes), dtype=bool)
            sums, bests = np.zeros(len(raws), np.int64), np.zeros(len(raws), np.int64)
            np.add.at(sums, owner[hit], n[at[hit]] * times[hit])
            np.add.at(bests, owner[hit], times[hit] * best[at[hit]])
            ends = np.concatenate(([0], np.cumsum(np.bincount(owner[~hit], minlength=len(raws))))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v[~hit])) for v in (codes, times)]
            cols = [*batch.columns[:8], pa.array(bests), pa.array(sums), *lists]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema)], schema=schema)

    looked = encoded.where("uid IS NOT NULL").select("uid", "id", *head, "codes", "times").mapInArrow(look_up, ddl)
    if not complete:
        looked = saved(looked, "looked-up")
        missed = looked.select("uid", F.explode(F.arrays_zip("missed", "missed_times")).alias("m")).select(
            "uid", F.col("m.missed").alias("code"), F.col("m.missed_times").alias("times"))
        more = missed.join(counts.where(~here), "code").groupBy("uid").agg(
            F.sum(F.col("times") * F.col("n")).alias("more_sum"),
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
        looked = looked.join(more, "uid", "left").withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0))) \
            .withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0)))
    out = looked.select(F.col("id").alias(id_col), *head[:4], "n_best", "count_sum", "groups_sha256",
                        *([F.col("grouping").alias("groups")] if with_groups else []))
    return out


def op11(spark, sf_dir):
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
