"""Language by nearest centroid: TF-IDF n-gram vectors, several centroids for each language, cosine, rejection by distance.

A text is lower-cased; letters of ASCII and all bytes of other characters form
words, anything else is a boundary. Features are the byte n-grams (`SIZES`) of
words with their boundaries, hashed into `DIMS` buckets: (1 + ln count) times
the inverse document frequency, divided by the vector's length.

Learning: document frequencies come from all rows that may be learned from, as
sums by bucket. The texts of a language (`per_language` of them about, picked by
the hash of the text, each text once) are clustered into `clusters` centroids by
spherical k-means in one task for each language, whose size that parameter
bounds. There may be at most `max_languages` languages, so the model that is
broadcast has a bound too: max_languages * clusters * DIMS floats.

Prediction: the language of the nearest centroid; score is that cosine. A text
is `rejected` when its distance passes what the language's own sample shows for
texts of its length (mean and four deviations): it's like none of the languages.

Defined results: null texts and texts without a letter are `und` with score 0,
not rejected; without any learned language all are `und`. A row with a null id or
a null language is never learned from. Ties go to the first language by name.
Every row is returned; other columns are not looked at. Long texts are taken in
stretches cut at blanks, which are boundaries anyway.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hrsight.llm.tasks import map_arrow, pieces, saved, ship

SIZES, DIMS, BANDS = (2, 3, 4), 1 << 12, 24
#: Rows of a dense block, characters of a stretch.
BLOCK, STRETCH = 400, 1 << 20
UNKNOWN = "und"
_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x61:0x7B] = _LETTER[0x80:] = True


def stretches(text):
    """The text in parts of about STRETCH characters, cut at blanks."""
    at = 0
    while len(text) - at > STRETCH:
        end = text.find(" ", at + STRETCH)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


def bucket_counts(texts):
    """len(texts) x DIMS counts of n-gram buckets."""
    out = np.zeros((len(texts), DIMS), dtype=np.float32)
    owners, parts, size = [], [], 0
    for i, t in enumerate(texts):
        for part in stretches(t) if t else ():
            owners.append(i)
            parts.append(part)
            size += len(part)
            if size >= 2 * STRETCH:
                _add(out, owners, parts)
                owners, parts, size = [], [], 0
    _add(out, owners, parts)
    return out


def _add(out, owners, parts):
    if not parts:
        return
    raw = [p.lower().encode("utf-8", "surrogatepass") for p in parts]
    buf = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", dtype=np.uint8)
    letter = _LETTER[buf]
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # of a run of other bytes only the first stays, as a boundary
    kept[0] = True
    owner = np.repeat(np.asarray(owners, dtype=np.int64), [len(r) + 1 for r in raw])
    owner = np.concatenate((owner[:1], owner))[kept]
    seq, word = np.where(letter, buf, 0x20)[kept].astype(np.uint32), letter[kept]
    for n in SIZES:
        m = len(seq) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, dtype=np.uint32)
        inner = np.ones(m, dtype=bool)
        for j in range(n):
            h = h * np.uint32(0x01000193) + seq[j:j + m]
            if 0 < j < n - 1:
                inner &= word[j:j + m]
        if n == 2:
            inner = word[:m] | word[1:m + 1]
        bucket = ((h * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
        # the window's second byte belongs to its word whatever boundaries are around it
        rows = owner[1:1 + m] if n > 2 else np.where(word[:m], owner[:m], owner[1:1 + m])
        first = rows[0] if m else 0
        last = int(rows.max()) + 1 if m else 0
        flat = ((rows - first) * DIMS + bucket)[inner]
        out[first:last] += np.bincount(flat, minlength=(last - first) * DIMS).reshape(-1, DIMS)


def tfidf(counts, idf):
    """Rows of length 1 (or 0)."""
    v = np.zeros_like(counts)
    some = counts > 0
    v[some] = 1 + np.log(counts[some])
    v *= idf
    return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12)


def band(counts):
    """Length class of each row."""
    return np.minimum(np.log2(counts.sum(axis=1) + 1).astype(np.int64), BANDS - 1)


def clustered(x, clusters, rounds=10):
    """Spherical k-means from farthest-first starts; rows of length 1."""
    mean = x.mean(axis=0)
    chosen = [int(np.argmax(x @ mean))]
    near = x @ x[chosen[0]]
    while len(chosen) < min(clusters, len(x)):
        far = int(np.argmin(near))
        if near[far] > 1 - 1e-6:
            break
        chosen.append(far)
        near = np.maximum(near, x @ x[far])
    c = x[chosen].copy()
    for _ in range(rounds):
        nearest = np.argmax(x @ c.T, axis=1)
        for k in range(len(c)):
            if (nearest == k).any():
                v = x[nearest == k].sum(axis=0)
                c[k] = v / max(1e-12, np.sqrt(v @ v))
    return c


def radii(distance, bands):
    """Largest accepted distance for each length class: mean and four deviations; classes without rows take a neighbour's."""
    out = np.full(BANDS, np.nan)
    for b in range(BANDS):
        d = distance[bands == b]
        if len(d) >= 5:
            out[b] = min(1.0, d.mean() + 4 * d.std() + 0.01)
    known = np.flatnonzero(~np.isnan(out))
    if not len(known):
        return np.ones(BANDS)
    out[:known[0]] = 1.0
    for b in range(known[0], BANDS):
        if np.isnan(out[b]):
            out[b] = out[b - 1]
    return out


class Model:
    """Unit centroids (rows), the language of each, accepted distances by language and length class."""

    def __init__(self, idf, languages, owner, centroids, radius):
        self.idf, self.languages, self.owner, self.centroids, self.radius = idf, languages, owner, centroids, radius

    def predict(self, texts):
        """(language, score, rejected) lists."""
        names, scores, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
        if not self.languages:
            return names, scores, rejected
        for begin in range(0, len(texts), BLOCK):
            part = texts[begin:begin + BLOCK]
            real = [i for i, t in enumerate(part) if t and any(map(str.isalpha, t))]
            if not real:
                continue
            counts = bucket_counts([part[i] for i in real])
            cosine = tfidf(counts, self.idf) @ self.centroids.T
            best = np.argmax(cosine, axis=1)
            top = np.clip(cosine[np.arange(len(real)), best].astype(np.float64), 0.0, 1.0)
            who = self.owner[best]
            far = 1.0 - top > self.radius[who, band(counts)]
            for i, w, s, r in zip(real, who.tolist(), top, far):
                names[begin + i], scores[begin + i], rejected[begin + i] = self.languages[w], s, r
        return names, scores, rejected


def document_frequencies(texts: DataFrame):
    """(documents, documents that hold each bucket) over all rows of the one column `text`."""

    def count(batches):
        total, rows = np.zeros(DIMS, dtype=np.int64), 0
        for batch in batches:
            for _, part in pieces(batch, "text"):
                for i in range(0, len(part), BLOCK):
                    total += (bucket_counts(part[i:i + BLOCK]) > 0).sum(axis=0)
                rows += len(part)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(DIMS)], pa.int32()), pa.array([rows, *total], pa.int64())],
                                         names=["bucket", "n"])

    ship(texts.sparkSession)
    got = texts.mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(DIMS, dtype=np.int64)
    rows = 0
    for r in got:  # DIMS + 1 rows
        if r.bucket < 0:
            rows = r.n
        else:
            out[r.bucket] = r.n
    return rows, out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held: int = 1,
          clusters: int = 4, per_language: int = 2000, max_languages: int = 500) -> Model:
    """Centroids from rows with an id, a text and a language whose crc32(id as text) mod `folds` isn't `held`."""
    learn = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")) \
        .where((F.crc32(F.col("id").cast("string")) % folds != held) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = learn.groupBy("lang").agg(F.count("*").alias("n"))
    many = sizes.limit(max_languages + 1).count()
    if many > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    rows, df = document_frequencies(learn.select("text"))
    idf = (np.log((rows + 1) / (df + 1)) + 1).astype(np.float32)
    picked = (learn.select("text", "lang", F.xxhash64("text").alias("hash")).join(F.broadcast(sizes), "lang")
              .where(F.pmod(F.xxhash64(F.col("hash"), F.lit(7)), F.lit(1 << 30)) / float(1 << 30) * F.col("n") < per_language)
              .groupBy("lang", "hash").agg(F.first("text").alias("text")))
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def cluster(key, frame):
        texts = frame.sort_values("hash")["text"].tolist()
        counts = np.concatenate([bucket_counts(texts[i:i + BLOCK]) for i in range(0, len(texts), BLOCK)])
        real = counts.sum(axis=1) > 0
        if not real.any():
            return pd.DataFrame({"lang": [], "k": [], "centroid": [], "radius": []})
        x = tfidf(counts[real], shared.value)
        c = clustered(x, clusters)
        radius = radii(1.0 - (x @ c.T).max(axis=1), band(counts[real]))
        return pd.DataFrame({"lang": [key[0]] * len(c), "k": list(range(len(c))), "centroid": [r.astype("<f4").tobytes() for r in c],
                             "radius": [radius.astype("<f8").tobytes()] * len(c)})

    ship(docs.sparkSession)
    made = saved(picked.groupBy("lang").applyInPandas(cluster, "lang string, k int, centroid binary, radius binary"), "centroids")
    got = sorted(made.collect(), key=lambda r: (r.lang, r.k))  # max_languages * clusters rows at most
    names = sorted({r.lang for r in got})
    where = {n: i for i, n in enumerate(names)}
    radius = {r.lang: np.frombuffer(bytes(r.radius), "<f8") for r in got}
    return Model(idf, names, np.array([where[r.lang] for r in got], dtype=np.int64),
                 np.array([np.frombuffer(bytes(r.centroid), "<f4") for r in got]).reshape(-1, DIMS),
                 np.array([radius[n] for n in names]).reshape(-1, BANDS))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, held: int = 1,
             reject: bool = True) -> DataFrame:
    """Per input row: id, held_out, lang_pred, score, rejected; rejected rows are `und` if `reject`."""
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    id_type = src.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batch, texts):
        names, scores, rejected = shared.value.predict(texts)
        yield {"id": batch.column(0), "lang_pred": names, "score": scores, "rejected": rejected}

    out = map_arrow(src, "text", apply, f"id {id_type}, lang_pred string, score double, rejected boolean")
    lang = F.when(F.col("rejected"), F.lit(UNKNOWN)).otherwise(F.col("lang_pred")) if reject else F.col("lang_pred")
    return out.select(F.col("id").alias(id_col),
                      F.coalesce(F.crc32(F.col("id").cast("string")) % folds == held, F.lit(False)).alias("held_out"),
                      lang.alias("lang_pred"), "score", "rejected")


def op12(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs, train(docs), reject=False)
