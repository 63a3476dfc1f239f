"""Raw delimited files: sampling, dialect detection, reading (SRC-01..07, 11)
and file sinks/artefact checks (SNK-01, 02, 05, 06, 07).

Every detector is an aggregation over ``spark.read.text`` lines keyed by
``_metadata.file_path`` (one result per file, or per data set folder), so a
directory of thousands of files is sniffed in one distributed job."""

from __future__ import annotations

import codecs
import re
from typing import Iterator
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# fixed values (must equal the reference's)
SEPARATORS = [",", ";", "\t", "|"]          # candidates, in tie-break order
ENCODINGS = ["utf-8", "latin1", "cp1252"]   # decoding fallback order
HEADER_DATA_TOKENS = ["nov.", "dic."]       # first-row values that mean "data"
SAMPLE_BYTES = 8192
SAMPLE_LINES = 20
SNIFF_LINES = 10
# ---------------------------------------------------------------------------


def _charset(encoding: str) -> str:
    """The name that Spark's readers know an encoding by."""
    return "ISO-8859-1" if encoding.lower() in ("latin1", "latin-1") else encoding


def lines(spark: SparkSession, path, encoding: str | None = None) -> DataFrame:
    """(file, block, pos, value): text lines with their file, split start and
    position (``pos`` follows the line order inside a split).  UTF-8 goes
    through the text source; other encodings through the CSV reader with a
    separator and quote that never occur, so lines stream in either case.
    ``path`` is one path or a list of paths."""
    paths = [path] if isinstance(path, str) else list(path)
    if encoding and encoding.lower().replace("-", "") not in ("utf8",):
        t = (spark.read.option("encoding", _charset(encoding)).option("sep", "\u0001").option("quote", "\u0000")
             .option("header", False).schema("value string").csv(paths))
    else:
        t = spark.read.text(paths)
    return t.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("pos"), F.coalesce("value", F.lit("")).alias("value"))


def head_lines(ln: DataFrame, n: int = SAMPLE_LINES, max_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """SRC-01: the first n lines inside the first ``max_bytes`` bytes of each file."""
    first = ln.where(F.col("block") == 0)
    w = Window.partitionBy("file").orderBy("pos")
    c = (first.withColumn("line_no", F.row_number().over(w))
         .withColumn("_end", F.sum(F.octet_length("value") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    return c.where((F.col("line_no") <= n) & (F.col("_end") <= max_bytes)).select("file", "line_no", "value")


#: stores whose files a task can open by itself for a range read; others go through Spark's readers
RANGE_READ_SCHEMES = ("", "file", "s3", "gs", "gcs", "abfs", "abfss")


def _decode_head(raw: bytes, whole: bool) -> tuple[str, str]:
    """Text and encoding of a file's first bytes; a character that the cut
    splits is left out."""
    try:
        return codecs.getincrementaldecoder("utf-8")().decode(raw, final=whole), "utf-8"
    except UnicodeDecodeError:
        return raw.decode("latin1"), "latin1"  # decodes every byte


def file_heads(spark: SparkSession, path, n: int = SAMPLE_LINES, max_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """SRC-01: (file, encoding, line_no, value): the first n lines inside the
    first ``max_bytes`` bytes of every file, each file in its own encoding.

    The listing is a Spark table without contents; tasks read only the head of
    each file, so the bytes read grow with the number of files, not with
    their size.  A line that the cut hits comes back cut, also the first one.
    An empty file has no row.  Lines end at ``\\n``, ``\\r\\n`` or ``\\r``, as
    in Spark's readers.  Stores not in ``RANGE_READ_SCHEMES`` are read through
    the text source (whole first lines, no cut one)."""
    paths = [path] if isinstance(path, str) else list(path)
    if any(urlparse(p).scheme not in RANGE_READ_SCHEMES for p in paths):
        heads = head_lines(lines(spark, paths), n, max_bytes).join(detect_encoding(spark, paths), "file")
        latin = F.decode(F.col("value").cast("binary"), "ISO-8859-1")  # the source keeps a line's bytes
        return heads.select("file", "encoding", "line_no", F.when(F.col("encoding") == "latin1", latin).otherwise(F.col("value")).alias("value"))

    def heads(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        for frame in frames:
            rows = []
            for uri, length in zip(frame["path"], frame["length"]):
                store, name = fs.FileSystem.from_uri(uri)
                with store.open_input_file(name) as f:
                    raw = f.read(max_bytes)
                text, encoding = _decode_head(raw, len(raw) == length)
                found = re.split(r"\r\n|\n|\r", text)
                rows += [(uri, encoding, i, v) for i, v in enumerate(found[:-1] if found[-1] == "" else found, 1) if i <= n]
            yield pd.DataFrame(rows, columns=["file", "encoding", "line_no", "value"]).astype({"line_no": "int32", "file": object, "encoding": object, "value": object})
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "length")
    return files.mapInPandas(heads, "file string, encoding string, line_no int, value string")


def _sep_choice(means: list) -> F.Column:
    arr = F.array(*[F.struct(F.lit(s).alias("sep"), m.alias("mean")) for s, m in zip(SEPARATORS, means)])
    init = F.struct(F.lit(",").alias("sep"), F.lit(-1.0).cast("double").alias("mean"))
    best = F.aggregate(arr, init, lambda acc, x: F.when(F.coalesce(x["mean"], F.lit(-1.0)) > acc["mean"], x).otherwise(acc))
    return best["sep"]


def detect_separator(ln: DataFrame, group: list[str]) -> DataFrame:
    """SRC-02: per group, the candidate with the highest mean field count over
    non-blank lines; a tie keeps the earlier candidate; ',' when no line."""
    nb = ln.where(F.trim("value") != "")
    means = [F.avg(F.size(F.split("value", re.escape(s), -1))) for s in SEPARATORS]
    g = nb.groupBy(*group).agg(*[m.alias(f"_m{i}") for i, m in enumerate(means)])
    return g.select(*group, _sep_choice([F.col(f"_m{i}") for i in range(len(SEPARATORS))]).alias("separator"),
                    *[F.round(F.col(f"_m{i}"), 6).alias(f"mean_fields_{i}") for i in range(len(SEPARATORS))])


def detect_decimal(ln: DataFrame, group: list[str]) -> DataFrame:
    """SRC-03: ',' iff count(digit,digit) > 2 * count(digit.digit) (non-overlapping)."""
    g = ln.groupBy(*group).agg(F.sum(F.regexp_count("value", F.lit(r"\d,\d"))).alias("comma_hits"),
                               F.sum(F.regexp_count("value", F.lit(r"\d\.\d"))).alias("period_hits"))
    return g.withColumn("decimal", F.when(F.col("comma_hits") > F.col("period_hits") * 2, F.lit(",")).otherwise(F.lit(".")))


def detect_encoding(spark: SparkSession, path) -> DataFrame:
    """SRC-04: per file, utf-8 when every line is valid UTF-8, else latin1
    (which decodes every byte, so cp1252 is never reached).  Lines stream
    from the text source; no file is loaded whole."""
    t = spark.read.text([path] if isinstance(path, str) else list(path))
    return (t.groupBy(F.col("_metadata.file_path").alias("file"))
            .agg(F.bool_and(F.is_valid_utf8("value")).alias("_ok"))
            .select("file", F.when(F.col("_ok"), F.lit("utf-8")).otherwise(F.lit("latin1")).alias("encoding")))


def header_present(ln: DataFrame, group: list[str], sep_col: str = "separator") -> DataFrame:
    """SRC-07: the first line is data (no header) when one of its values holds
    a month token or a decimal comma; decided on the first line of every file."""
    first = ln.where(F.col("block") == 0)
    w = Window.partitionBy("file").orderBy("pos")
    f1 = first.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
    parts = F.split(F.col("value"), F.concat(F.lit("\\Q"), F.col(sep_col), F.lit("\\E")), -1)
    vals = F.transform(parts, lambda v: F.trim(v))
    looks_data = F.exists(vals, lambda v: v.contains(HEADER_DATA_TOKENS[0]) | v.contains(HEADER_DATA_TOKENS[1])
                          | v.contains(","))
    return f1.groupBy(*group).agg((~F.bool_or(looks_data)).alias("has_header"))


def detect_options(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(dataset, encoding, separator, decimal, has_header, n_lines): SRC-02, 03,
    04 and 07 for many data set folders in one pass over their raw lines,
    counted per file and then per folder name.  The marks looked for are ASCII,
    so they are found before the encoding is known.  Blank lines don't count
    for the separator; a folder without lines has no row."""
    ln = lines(spark, folders)
    nb = F.when(F.trim("value") != "", F.col("value"))
    per_file = ln.groupBy(F.regexp_extract("file", r"/([^/]+)/[^/]+$", 1).alias("dataset"), "file").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count(nb).alias("_nb"), F.bool_and(F.is_valid_utf8("value")).alias("_utf8"),
        *[F.sum(F.size(F.split(nb, re.escape(s), -1))).alias(f"_f{i}") for i, s in enumerate(SEPARATORS)],
        F.sum(F.regexp_count("value", F.lit(r"\d,\d"))).alias("_comma"), F.sum(F.regexp_count("value", F.lit(r"\d\.\d"))).alias("_period"),
        F.min_by("value", F.struct("block", "pos")).alias("_first"))
    sums = per_file.groupBy("dataset").agg(
        F.bool_and("_utf8").alias("_utf8"), *[F.sum(c).alias(c) for c in ("n_lines", "_nb", "_comma", "_period")],
        *[F.sum(f"_f{i}").alias(f"_f{i}") for i in range(len(SEPARATORS))])
    found = sums.select(
        "dataset", F.when(F.col("_utf8"), F.lit("utf-8")).otherwise(F.lit("latin1")).alias("encoding"),
        _sep_choice([F.try_divide(f"_f{i}", "_nb") for i in range(len(SEPARATORS))]).alias("separator"),
        F.when(F.col("_comma") > F.col("_period") * 2, F.lit(",")).otherwise(F.lit(".")).alias("decimal"), "n_lines")
    firsts = per_file.select("dataset", F.lit(0).alias("block"), "file", F.lit(0).alias("pos"), F.col("_first").alias("value"))
    header = header_present(firsts.join(F.broadcast(found.select("dataset", "separator")), "dataset"), ["dataset"])
    return found.join(header, "dataset").select("dataset", "encoding", "separator", "decimal", "has_header", "n_lines")


def read_delimited(spark: SparkSession, path: str, sep: str, header: bool, encoding: str = "utf-8",
                   schema: str | None = None) -> DataFrame:
    """SRC-05/06: CSV scan with the detected options; PERMISSIVE with a
    corrupt-record column; values kept as text (typed later by the cleaners)."""
    r = (spark.read.option("sep", sep).option("header", header).option("encoding", _charset(encoding))
         .option("mode", "PERMISSIVE").option("multiLine", False))
    if schema:
        r = r.schema(schema)
    return r.csv(path)


def accepted(df: DataFrame) -> bool:
    """SRC-05: a scan is accepted only with more than one column."""
    return len(df.columns) > 1


def read_future_dates(spark: SparkSession, path: str) -> DataFrame:
    """SRC-11: a future-date file as JSON or CSV by its suffix."""
    if path.rstrip("/").lower().endswith(".json"):
        return spark.read.json(path)
    return spark.read.option("header", True).csv(path)


def artefact_check(spark: SparkSession, folder: str, expected: list[str]) -> DataFrame:
    """SNK-07: expected artefact names right-joined to the folder listing:
    exists, size_bytes, size_mb (2 decimals; 0 when empty or missing)."""
    listing = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
               .select(F.regexp_extract("path", r"([^/]+)$", 1).alias("_name"), F.col("length")))
    sizes = listing.groupBy("_name").agg(F.sum("length").alias("size_bytes"))
    want = spark.createDataFrame([(e,) for e in expected], "name string")
    j = want.join(sizes, want.name == sizes._name, "left")
    size = F.coalesce("size_bytes", F.lit(0))
    return j.select("name", F.col("size_bytes").isNotNull().alias("exists"), size.alias("size_bytes"),
                    F.when(size > 0, F.round(size / (1024 * 1024), 2)).otherwise(F.lit(0.0)).alias("size_mb"))
