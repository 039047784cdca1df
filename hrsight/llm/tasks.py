"""Plumbing shared by the operators: shared-folder tables, code shipping, Arrow batches.

* `saved` writes a frame to a table under the folder named by
  `spark.checkpoint.dir` and reads it back, so a lost executor costs a re-read
  and never a recomputation of the whole lineage.
* `map_arrow` runs a plain Python function over Arrow batches in pieces of
  bounded text bytes, so memory does not follow the partition size.
* `ship` hands the package to the executors through Spark's own file server.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hrsight.session import ensure_checkpoint_dir

#: Bytes of text that one call of a batch function gets (one longer text is one call).
PIECE_BYTES = 3_000_000
#: The same where a function lays out several arrays of eight bytes for each byte of text.
LAID_OUT = 1_000_000


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_hrsight_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="hrsight-code-"), "hrsight_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("hrsight", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._hrsight_shipped = True


def new_folder(spark: SparkSession, tag: str) -> str:
    """A fresh path under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/hrsight-{tag}-{uuid.uuid4().hex}"


def saved(df: DataFrame, tag: str, parts: int | None = None, **options) -> DataFrame:
    """Write `df` to a fresh table in the shared folder (by at most `parts` tasks) and read it back."""
    spark = df.sparkSession
    path = new_folder(spark, tag)
    (df if parts is None else df.coalesce(parts)).write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._hrsight_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete tables made by `saved` that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_hrsight_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have, whatever columns it brings."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*[F.col(f"`{c}`") for c in cols])


def pieces(batch: pa.RecordBatch, text: str, limit: int = PIECE_BYTES):
    """Slices of a batch with at most `limit` bytes of text each (one row at least)."""
    lengths = batch.column(batch.schema.get_field_index(text)).to_pylist()
    begin, size = 0, 0
    for i, t in enumerate(lengths):
        n = 0 if t is None else len(t)
        if i > begin and size + n > limit:
            yield batch.slice(begin, i - begin), lengths[begin:i]
            begin, size = i, 0
        size += n
    if begin < len(lengths):
        yield batch.slice(begin), lengths[begin:]


def map_arrow(df: DataFrame, text: str, fn, schema: str, limit: int = PIECE_BYTES) -> DataFrame:
    """`fn(batch, texts)` yields dicts of columns; `texts` is the list of the batch's texts, of `limit` characters at most."""
    ship(df.sparkSession)
    out = _arrow_schema(df.sparkSession, schema)

    def run(batches):
        for batch in batches:
            for part, texts in pieces(batch, text, limit):
                for cols in fn(part, texts):
                    yield pa.RecordBatch.from_arrays([_array(cols[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def _array(values, kind):
    return values if isinstance(values, (pa.Array, pa.ChunkedArray)) and values.type == kind else pa.array(values, kind)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))
