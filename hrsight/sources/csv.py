"""CSV employee files: scan (S1), extension filter (S2), validation (S3),
write (S4).

Cells follow RFC 4180: a quoted cell may hold separators, newlines and doubled
quotes, and the writer quotes the same way, so a written table reads back as it
was. Give a declared schema where one is known: without it the types come from
one extra pass over the cleaned text. Missing-value tokens are normalised after
a string read (Spark's ``nullValue`` takes one token only).

Validation reports every problem at once, from Spark's file listing
(``binaryFile`` without its content column, so only path and length are read)
and one parse with a column more than the header has: a record that fills it
has more fields than the header. Records with fewer fields are padded with NULL,
as the usual readers do.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from hrsight.functions.exprs import col

# Text read as missing (the usual CSV reader defaults).
NA_TOKENS: tuple[str, ...] = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
CSV_GLOB = "*.[cC][sS][vV]"
# Quoted cells: doubled quotes inside, separators and newlines allowed.
QUOTING = {"quote": '"', "escape": '"', "header": True}
# Text that reads as a number; Java's own forms such as "1D" or "0x1p3" stay text.
INTEGER = r"^\s*[+-]?[0-9]+\s*$"
DECIMAL = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$|^\s*[+-]?(?i:inf|infinity)\s*$"


def read_employees(spark: SparkSession, path: str, schema: StructType | str | None = None,
                   infer: bool = True, normalise_na: bool = True, multiline: bool = True) -> DataFrame:
    """Employee table from one CSV file or a folder of them (only ``.csv``
    files, any letter case). Text cells equal to an NA token become NULL and
    inference then runs on the cleaned text. ``multiline=False`` lets Spark
    split large files, for data known to have no newline inside a cell."""
    reader = (spark.read.options(**QUOTING).option("pathGlobFilter", CSV_GLOB)
              .option("multiLine", multiline).option("mode", "PERMISSIVE"))
    if schema is not None:
        df = reader.schema(schema).csv(path)
        return _null_tokens(df) if normalise_na else df
    raw = reader.option("inferSchema", False).csv(path)
    if normalise_na:
        raw = _null_tokens(raw)
    if not infer or not raw.columns:
        return raw
    # One aggregate pass: what every value of a column reads as, and the range of its integers.
    checks = []
    for i, c in enumerate(raw.columns):
        x = col(c)
        whole = F.when(x.rlike(INTEGER), F.trim(x).try_cast("bigint"))
        checks += [F.count(x).alias(f"n{i}"), F.count(whole).alias(f"i{i}"),
                   F.min(whole).alias(f"lo{i}"), F.max(whole).alias(f"hi{i}"),
                   F.count(F.when(x.rlike(DECIMAL), 1)).alias(f"d{i}"),
                   F.count(F.when(F.lower(x).isin("true", "false"), 1)).alias(f"b{i}")]
    r = raw.agg(*checks).first()
    cols = []
    for i, c in enumerate(raw.columns):
        x, n = col(c), r[f"n{i}"]
        if not n:
            cols.append(x.alias(c))
        elif r[f"b{i}"] == n:
            cols.append((F.lower(x) == "true").alias(c))
        elif r[f"i{i}"] == n:
            small = -2**31 <= r[f"lo{i}"] and r[f"hi{i}"] < 2**31
            cols.append(F.trim(x).cast("int" if small else "bigint").alias(c))
        elif r[f"d{i}"] == n:
            cols.append(F.trim(x).cast("double").alias(c))
        else:
            cols.append(x.alias(c))
    return raw.select(*cols)


def _null_tokens(df: DataFrame) -> DataFrame:
    return df.select(*[
        F.when(F.trim(col(f.name)).isin(*NA_TOKENS), F.lit(None)).otherwise(col(f.name)).alias(f.name)
        if isinstance(f.dataType, StringType) else col(f.name) for f in df.schema.fields])


def allowed_file(name: str) -> bool:
    """``.csv`` extension, any letter case."""
    return "." in name and name.rsplit(".", 1)[1].lower() == "csv"


def _missing_path(e: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in (e.getCondition() or "") or "PATH_NOT_FOUND" in str(e)


def validate(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """All problems of a CSV file (or folder) as rows (check, ok, detail):
    exists, extension, non_empty, size_limit (off unless ``max_bytes``),
    parses, has_rows, has_columns. Only a missing path is a finding; other
    failures of the file system are raised."""
    checks: list[tuple[str, bool, str]] = []

    def note(check: str, ok: bool, detail: str) -> None:
        checks.append((check, ok, "" if ok else detail))

    def report() -> DataFrame:
        return spark.createDataFrame(checks, "check string, ok boolean, detail string")

    try:
        files = (spark.read.format("binaryFile").option("pathGlobFilter", "*").load(path).select("path", "length")
                 .agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"),
                      F.sum(F.when(~F.lower("path").endswith(".csv"), 1).otherwise(0)).alias("bad"))).first()
    except AnalysisException as e:
        if not _missing_path(e):
            raise
        note("exists", False, f"nothing found at {path}")
        return report()
    total = files["bytes"] or 0
    note("exists", files["files"] > 0, f"nothing found at {path}")
    note("extension", not files["bad"], f"{files['bad']} file(s) without the .csv ending")
    note("non_empty", total > 0, "0 bytes")
    if max_bytes is not None:
        note("size_limit", total <= max_bytes, f"{total} bytes, limit {max_bytes}")
    if not total:
        return report()
    reader = spark.read.options(**QUOTING).option("multiLine", True).option("pathGlobFilter", CSV_GLOB)
    try:
        header = reader.csv(path).columns
    except AnalysisException as e:  # no readable header
        note("parses", False, e.getCondition() or "no header")
        return report()
    extra = "more_fields"
    while extra in header:
        extra += "_"
    wide = StructType([StructField(f"c{i}", StringType()) for i in range(len(header))] + [StructField(extra, StringType())])
    # an empty cell must not look like an absent one, and unread columns must not be skipped
    rows = (reader.schema(wide).option("mode", "PERMISSIVE").option("nullValue", "\u0001").option("enforceSchema", True)
            .csv(path).agg(F.count(F.lit(1)).alias("n"), F.count(extra).alias("wide"),
                           *[F.count(f"c{i}") for i in range(len(header))])).first()
    note("parses", rows["wide"] == 0, f"{rows['wide']} record(s) with more fields than the header's {len(header)}")
    note("has_rows", rows["n"] > 0, "no record after the header")
    note("has_columns", len(header) > 0, "empty header")
    return report()


def problems(validation: DataFrame) -> list[str]:
    return [r["detail"] for r in validation.where(~F.col("ok")).collect()]


def write_employees(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Dataset as CSV with a header (one file per partition), quoted as it is read."""
    df.write.mode(mode).options(**QUOTING).csv(path)
