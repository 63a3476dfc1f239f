"""Profiling and data quality (PRF-*), on full data, no sampling.

The exact per-column statistics come from one long-form aggregation:
every cell becomes (column, value) and ``groupBy(column, value).count()``
is combined map-side, so a value that holds a third of the rows is a single
partial-aggregate row per task.  From those counts follow missing, unique,
mode and top values.  ``approx=True`` uses HyperLogLog
(``approx_count_distinct``) in one wide aggregation instead, for very wide or
very large frames.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktab.functions import dates as D
from sparktab.operators.quantiles import exact_quantiles
from sparktab.operators.sequence import one_row
from sparktab.sources import sniff as SN

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def _cols(df: DataFrame, cols=None) -> list[str]:
    return list(cols) if cols else df.columns


def _clean_value(df: DataFrame, c: str) -> Column:
    t = df.schema[c].dataType
    col = F.col(f"`{c}`")
    if isinstance(t, (T.FloatType, T.DoubleType)):
        col = F.when(~F.isnan(col), col)  # NaN is missing, as in pandas
    return col


def long_values(df: DataFrame, cols=None) -> DataFrame:
    """(column, value STRING): one row per cell."""
    cols = _cols(df, cols)
    arr = F.array(*[F.struct(F.lit(c).alias("column_name"), _clean_value(df, c).cast("string").alias("value")) for c in cols])
    return df.select(F.inline(arr))


def value_counts(df: DataFrame, cols=None) -> DataFrame:
    """(column, value, n); null cells are one row with value NULL."""
    return long_values(df, cols).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def schema_frame(df: DataFrame, cols=None) -> DataFrame:
    """(column, dtype, position): the schema as a small frame (metadata only)."""
    cols = _cols(df, cols)
    rows = [(c, df.schema[c].dataType.simpleString(), i) for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "column_name string, dtype string, position int")


def profile(df: DataFrame, cols=None, approx: bool | list[str] = False, counts: DataFrame | None = None) -> DataFrame:
    """PRF-01/07: (column, dtype, n_rows, missing, missing_pct, unique, unique_ratio).

    approx=False: exact, from the long-form counts.  approx=True: HyperLogLog
    for every column.  A list names the columns to estimate (ids, free text);
    the others are counted exactly, so the long-form shuffle carries only
    those.  ``counts`` reuses value counts already computed for the same
    columns (one shuffle for several reports)."""
    cols = _cols(df, cols)
    if not isinstance(approx, bool):
        high = [c for c in cols if c in approx]
        low = [c for c in cols if c not in high]
        parts = ([profile(df, low, False)] if low else []) + ([profile(df, high, True)] if high else [])
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        pos = {c: i for i, c in enumerate(cols)}
        return out.withColumn("position", F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(pos[c]))])
                              [F.col("column_name")])
    if approx:
        aggs = [F.count(F.lit(1)).alias("_n")]
        for i, c in enumerate(cols):
            v = _clean_value(df, c)
            aggs += [F.count(v).alias(f"_c{i}"), F.approx_count_distinct(v, 0.01).alias(f"_u{i}")]
        wide = df.agg(*aggs)
        per = wide.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.col("_n").alias("n_rows"),
                     (F.col("_n") - F.col(f"_c{i}")).alias("missing"), F.col(f"_u{i}").alias("n_unique"))
            for i, c in enumerate(cols)])))
    else:
        per = ((counts if counts is not None else value_counts(df, cols)).groupBy("column_name")
               .agg(F.sum("n").alias("n_rows"),
                    F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(F.lit(0))).alias("missing"),
                    F.count("value").alias("n_unique")))
    meta = schema_frame(df, cols)
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_rows", "missing", "n_unique")]  # an empty table has one row per column, too
    return (meta.join(per, "column_name", "left").select("column_name", "dtype", "position", *zero)
            .select("column_name", "dtype", "position", "n_rows", "missing",
                    F.round(F.try_divide("missing", "n_rows") * 100, 4).alias("missing_pct"),
                    "n_unique", F.round(F.try_divide("n_unique", "n_rows"), 4).alias("unique_ratio")))


def quality_flags(prof: DataFrame, null_warning: float = 0.05, categorical_ratio: float = 0.05,
                  high_cardinality_ratio: float = 0.9) -> DataFrame:
    """PRF-11/15/17/20/25 flags on a profile: empty, constant, high cardinality,
    null warning, categorical, role by name, target candidate."""
    name = F.lower(F.col("column_name"))
    role_by_name = (F.when(name.endswith("_id") | name.endswith("key"), F.lit("identifier"))
                    .when(name.contains("email"), F.lit("email"))
                    .when(name.contains("phone"), F.lit("phone")))
    numeric = F.col("dtype").rlike("^(tinyint|smallint|int|bigint|float|double|decimal)")
    share = F.col("missing") / F.col("n_rows")
    return prof.select(
        "column_name", "dtype",
        (F.col("missing") == F.col("n_rows")).alias("is_empty"),
        (F.col("n_unique") == 1).alias("is_constant"),
        ((F.col("unique_ratio") > high_cardinality_ratio) & ~numeric).alias("high_cardinality"),
        (share > null_warning).alias("null_warning"),
        (F.col("unique_ratio") <= categorical_ratio).alias("is_categorical"),
        role_by_name.alias("name_role"),
        (numeric & (F.col("n_unique") > 1) & role_by_name.isNull() & (share <= null_warning)).alias("target_candidate"),
    )


def completeness(df: DataFrame) -> DataFrame:
    """PRF-18: non-null cells / all cells."""
    cols = df.columns
    nn = sum((_clean_value(df, c).isNotNull().cast("long") for c in cols), F.lit(0))
    return df.agg((F.sum(nn) / (F.count(F.lit(1)) * len(cols))).alias("completeness"))


def date_candidates(df: DataFrame, cols=None, thresh: float = 0.75) -> DataFrame:
    """PRF-02: share of all rows whose string value parses as a date (day-first
    generic formats or the localised form), rounded to 3; strings only.  Null
    values don't parse; an empty table has the share 0."""
    cols = [c for c in _cols(df, cols) if isinstance(df.schema[c].dataType, T.StringType)]
    aggs = []
    for c in cols:
        ok = F.coalesce(D.parse_generic(F.col(c)), D.parse_localised(F.col(c), strict=True)).isNotNull()
        aggs.append(F.struct(F.lit(c).alias("column_name"),
                             F.round(F.count_if(ok) / F.greatest(F.count(F.lit(1)), F.lit(1)), 3).alias("ratio")))
    r = df.agg(F.array(*aggs).alias("a")).select(F.inline("a"))
    return r.withColumn("is_date", F.col("ratio") >= thresh)


def _head(df: DataFrame, by: list[str] | None, n: int) -> DataFrame:
    """The first n rows by ``by`` (any rows without it), their order as ``_o``."""
    if by:
        return df.orderBy(*by).limit(n).withColumn("_o", F.struct(*by))
    return df.limit(n).withColumn("_o", F.monotonically_increasing_id())


def date_formats(df: DataFrame, cols=None, thresh: float = 0.6, sample_by: list[str] | None = None, samples: int = 10) -> DataFrame:
    """PRF-02: (column_name, ratio, is_date, format, sample_values) of the text
    columns: share of all rows that parse by the format their signature names
    (``dates.signature_format``, date-time texts included), the format that
    most rows have (ties: the first by name), and the first non-null values by
    ``sample_by`` (any rows without it).  Counted once per (column, format),
    so the shuffle carries formats, not values.  A column without a parsed
    value has no format; an empty table has the share 0."""
    cols = [c for c in _cols(df, cols) if isinstance(df.schema[c].dataType, T.StringType)]
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.when(
        F.length(F.trim(f"`{c}`")) <= D.MAX_DATE_CHARS, F.col(f"`{c}`")).alias("value")) for c in cols])))
    counts = (cells.withColumn("sig", D.signature(F.col("value")))
              .groupBy("column_name", D.signature_format(F.col("value"), F.col("sig")).alias("format")).agg(F.count(F.lit(1)).alias("n")))
    known = F.col("format").isNotNull()
    per = counts.groupBy("column_name").agg(
        F.try_divide(F.sum(F.when(known, F.col("n")).otherwise(F.lit(0))), F.sum("n")).alias("ratio"),
        F.min(F.when(known, F.struct((-F.col("n")).alias("n"), "format"))).alias("_best"))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column_name string")
    values = None
    for c in cols:
        some = df.where(F.col(f"`{c}`").isNotNull())
        some = _head(some, sample_by, samples).select("_o", F.col(f"`{c}`").alias("v"))
        v = some.agg(F.lit(c).alias("column_name"), F.array_sort(F.collect_list(F.struct("_o", "v"))).getField("v").alias("sample_values"))
        values = v if values is None else values.unionByName(v)
    ratio = F.coalesce("ratio", F.lit(0.0))
    return (names.join(per, "column_name", "left").join(values, "column_name", "left")
            .select("column_name", F.round(ratio, 3).alias("ratio"), (ratio >= thresh).alias("is_date"), F.col("_best.format").alias("format"), "sample_values"))


def dataset_profile(df: DataFrame, sample_by: list[str] | None = None, samples: int = 5) -> DataFrame:
    """PRF-01 whole: the profile with trimmed column names, the number of
    columns, and each column's values (as text) in the first ``samples`` rows
    by ``sample_by`` (any rows without it).  Names that are equal once trimmed
    are refused."""
    names = [c.strip() for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"column names are equal once trimmed: {sorted(n for n in set(names) if names.count(n) > 1)}")
    df = df.toDF(*names)
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("_o"), _clean_value(df, c).cast("string").alias("v")) for c in names])
    values = _head(df, sample_by, samples).select(F.inline(cells)).groupBy("column_name").agg(F.array_sort(F.collect_list(F.struct("_o", "v"))).getField("v").alias("sample_values"))
    return profile(df).join(values, "column_name", "left").withColumn("n_columns", F.lit(len(names)))


#: what makes a data set unreadable; any other fault is raised
READ_ERRORS = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "FAILED_READ_FILE")


def read_and_profile(spark, folders: list[str], separators: dict[str, str] | None = None) -> DataFrame:
    """PRF-03: options of each data set folder (all detected in one pass), its
    profile read with them, one row per column; a folder that isn't there or
    has no lines, or a scan of one column, gives one error row instead.
    ``separators`` states separators by folder name; they win over detected
    ones."""
    cols = ("dataset string, read_status string, encoding string, separator string, decimal string, has_header boolean, "
            "column_name string, n_rows bigint, missing bigint, n_unique bigint, error_message string")
    there, errors, parts = [], {}, []
    name = {f: f.rstrip("/").rsplit("/", 1)[-1] for f in folders}
    for f in folders:
        try:
            SN.lines(spark, f)
            there.append(f)
        except AnalysisException as e:
            if e.getCondition() not in READ_ERRORS:
                raise
            errors[name[f]] = e.getCondition()
    found = {r["dataset"]: r for r in SN.detect_options(spark, there).collect()} if there else {}  # one row per data set
    for f in there:
        o = found.get(name[f])
        if o is None:
            errors[name[f]] = "EMPTY"
            continue
        sep = (separators or {}).get(name[f], o["separator"])
        df = SN.read_delimited(spark, f, sep, o["has_header"], o["encoding"])
        if not SN.accepted(df):
            errors[name[f]] = "ONE_COLUMN"
            continue
        parts.append(profile(df).select(
            F.lit(name[f]).alias("dataset"), F.lit("ok").alias("read_status"), F.lit(o["encoding"]).alias("encoding"), F.lit(sep).alias("separator"),
            F.lit(o["decimal"]).alias("decimal"), F.lit(o["has_header"]).alias("has_header"), F.trim("column_name").alias("column_name"),
            "n_rows", "missing", "n_unique", F.lit(None).cast("string").alias("error_message")))
    out = spark.createDataFrame([(d, "error", *[None] * 8, m) for d, m in errors.items()], cols)
    for p in parts:
        out = out.unionByName(p)
    return out


def describe(df: DataFrame, cols: list[str], approx: bool = False) -> DataFrame:
    """PRF-05: count, mean, std, min, 25/50/75 % (linear interpolation), max."""
    points = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    exact = None if approx else one_row(exact_quantiles(df, {f"{c}__{n}": (c, p) for c in cols for n, p in points.items()}))

    def q(c, n):
        return F.percentile_approx(c, points[n], 100000) if approx else F.first(exact[f"{c}__{n}"])
    aggs = []
    for c in cols:
        aggs.append(F.struct(F.lit(c).alias("column_name"), F.count(c).alias("count"), F.avg(c).alias("mean"),
                             F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"),
                             *[q(c, n).cast("double").alias(n) for n in points], F.max(c).cast("double").alias("max")))
    return df.agg(F.array(*aggs).alias("a")).select(F.inline("a"))


def target_stats(df: DataFrame, col: str) -> DataFrame:
    """PRF-06."""
    return df.agg(F.min(col).alias("min"), F.max(col).alias("max"), F.avg(col).alias("mean"),
                  F.stddev_samp(col).alias("std"), F.count(col).alias("count"),
                  F.count_if(F.col(col).isNull()).alias("nulls"))


def date_range(df: DataFrame, col: str, part: list[str] | None = None) -> DataFrame:
    """PRF-08: start, end, span in days."""
    return (df.groupBy(*(part or [])).agg(F.min(col).alias("start_date"), F.max(col).alias("end_date"))
            .withColumn("span_days", F.datediff("end_date", "start_date")))


def missing_dates(df: DataFrame, col: str, part: list[str] | None = None) -> DataFrame:
    """PRF-09: calendar days between the first and last date with no row.
    The spine is generated per series from a one-row range (bounded by the
    calendar), then anti-joined."""
    part = part or []
    rng = df.groupBy(*part).agg(F.min(col).alias("_s"), F.max(col).alias("_e"))
    spine = rng.select(*part, F.explode(F.sequence("_s", "_e")).alias(col))
    present = df.select(*part, col).distinct()
    return spine.join(present, [*part, col], "left_anti")


def gap_summary(df: DataFrame, col: str) -> DataFrame:
    """PRF-09: calendar length, row count, has_missing_dates."""
    r = df.agg(F.min(col).alias("start"), F.max(col).alias("end"), F.count(F.lit(1)).alias("n_rows"),
               F.count_distinct(col).alias("n_dates"))
    return r.select("n_rows", (F.datediff("end", "start") + 1).alias("calendar_days"),
                    ((F.datediff("end", "start") + 1) != F.col("n_rows")).alias("has_missing_dates"))


def duplicate_count(df: DataFrame, cols: list[str]) -> DataFrame:
    """PRF-10 / PRF-11 duplicates: rows minus distinct rows of ``cols``."""
    return df.agg((F.count(F.lit(1)) - F.count_distinct(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in cols]))
                  .alias("duplicates"))


def mixed_type(df: DataFrame, cols=None) -> DataFrame:
    """PRF-12: string columns where some but not all non-null values cast to a
    number; a column without values has no share and isn't mixed."""
    cols = [c for c in _cols(df, cols) if isinstance(df.schema[c].dataType, T.StringType)]
    aggs = [F.struct(F.lit(c).alias("column_name"),
                     F.try_divide(F.count(F.expr(f"try_cast(`{c}` AS DOUBLE)")), F.count(c)).alias("numeric_share")) for c in cols]
    r = df.agg(F.array(*aggs).alias("a")).select(F.inline("a"))
    return r.withColumn("is_mixed", F.coalesce((F.col("numeric_share") > 0) & (F.col("numeric_share") < 1), F.lit(False)))


def outlier_counts(df: DataFrame, cols: list[str], z: float = 3.0) -> DataFrame:
    """PRF-13: rows with |x - mean| > z * sd, per column (two passes: the
    statistics are a scalar subquery)."""
    st = one_row(df.agg(*[F.avg(c).alias(f"_m{i}") for i, c in enumerate(cols)],
                        *[F.stddev_samp(c).alias(f"_s{i}") for i, c in enumerate(cols)]))
    aggs = [F.struct(F.lit(c).alias("column_name"),
                     F.count_if(F.abs(F.col(c) - st[f"_m{i}"]) > z * st[f"_s{i}"]).alias("outliers"))
            for i, c in enumerate(cols)]
    return df.agg(F.array(*aggs).alias("a")).select(F.inline("a"))


def correlations(df: DataFrame, cols: list[str], thr: float = 0.7) -> DataFrame:
    """PRF-14: Pearson r for every pair in one aggregation, flagged |r| > thr."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    aggs = [F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.corr(a, b).alias("r")) for a, b in pairs]
    r = df.agg(F.array(*aggs).alias("a")).select(F.inline("a"))
    return r.withColumn("is_high", F.abs("r") > thr)


def high_correlations(df: DataFrame, cols: list[str], thr: float = 0.7) -> DataFrame:
    """Pairs with |r| > thr only."""
    return correlations(df, cols, thr).where("is_high").drop("is_high")


def top_k(df: DataFrame, group: list[str], order: list, k: int, out: str = "rank") -> DataFrame:
    """Top k rows per group without sorting a whole group in one task: rank
    inside (group, input partition) first, keep k, then rank the survivors
    (at most k per input partition) per group."""
    tmp = df.withColumn("_pp", F.spark_partition_id())
    w1 = Window.partitionBy(*group, "_pp").orderBy(*order)
    cand = tmp.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k).drop("_r1", "_pp")
    w2 = Window.partitionBy(*group).orderBy(*order)
    return cand.withColumn(out, F.row_number().over(w2)).where(F.col(out) <= k)


def top_values(df: DataFrame, cols=None, k: int = 5) -> DataFrame:
    """PRF-23: the k most frequent non-null values per column (ties by value)."""
    vc = value_counts(df, cols).where(F.col("value").isNotNull())
    return top_k(vc, ["column_name"], [F.desc("n"), F.asc("value")], k)


def column_roles(df: DataFrame, cols=None, categorical_ratio: float = 0.05) -> DataFrame:
    """PRF-16: datetime / binary / numeric / categorical; true_ratio for
    binary (share of the larger value), mode for categorical (ties by value)."""
    cols = _cols(df, cols)
    all_counts = value_counts(df, cols)
    prof = profile(df, cols, counts=all_counts)  # the same counts feed profile, mode and ratios
    vc = all_counts.where(F.col("value").isNotNull())
    mode = top_k(vc, ["column_name"], [F.desc("n"), F.asc("value")], 1).select("column_name", F.col("value").alias("mode"))
    meta = {c: df.schema[c].dataType for c in cols}
    temporal = [c for c, t in meta.items() if isinstance(t, TEMPORAL)]
    numeric = [c for c, t in meta.items() if isinstance(t, NUMERIC) or isinstance(t, T.BooleanType)]
    # true ratio: share of non-null rows holding the larger value (text order)
    mx = vc.groupBy("column_name").agg(F.max("value").alias("_top"), F.sum("n").alias("_nn"))
    tr = vc.join(mx, "column_name").where(F.col("value") == F.col("_top")).select(
        "column_name", (F.col("n") / F.col("_nn")).alias("true_ratio"))
    role = (F.when(F.col("column_name").isin(*temporal) if temporal else F.lit(False), F.lit("datetime"))
            .when(F.col("n_unique") == 2, F.lit("binary"))
            .when((F.col("column_name").isin(*numeric) if numeric else F.lit(False)) & (F.col("unique_ratio") > categorical_ratio),
                  F.lit("numeric"))
            .otherwise(F.lit("categorical")))
    r = prof.select("column_name", "n_unique", role.alias("role"))
    return (r.join(mode, "column_name", "left").join(tr, "column_name", "left")
            .select("column_name", "role",
                    F.when(F.col("role") == "binary", F.round("true_ratio", 4)).alias("true_ratio"),
                    F.when(F.col("role") == "categorical", F.col("mode")).alias("mode")))


def date_pattern_share(df: DataFrame, col: str) -> DataFrame:
    """PRF-21: share of values with a day number, a Spanish month token and a year."""
    s = F.lower(F.col(col))
    return df.agg(
        F.avg(s.rlike(r"\b\d{1,2}\b").cast("double")).alias("day_share"),
        F.avg(s.rlike(r"\b(ene|feb|mar|abr|may|jun|jul|ago|sep|sept|oct|nov|dic)\b").cast("double")).alias("month_share"),
        F.avg(s.rlike(r"\b\d{4}\b").cast("double")).alias("year_share"))


def trend_slope(df: DataFrame, value: str, date: str, part: list[str] | None = None) -> DataFrame:
    """PRF-24: least-squares slope of value over the day number, per series."""
    part = part or []
    if part:
        j = df.join(df.groupBy(*part).agg(F.min(date).alias("_d0")), part)
    else:
        j = df.withColumn("_d0", one_row(df.agg(F.min(date).alias("_d0")))["_d0"])
    return j.groupBy(*part).agg(F.regr_slope(F.col(value), F.datediff(date, "_d0").cast("double")).alias("slope"))


def problem_type(target: Column, target_is_numeric: Column) -> Column:
    """PRF-19: empty target -> unsupervised; numeric -> regression; else classification."""
    return (F.when(target.isNull() | (F.trim(target) == ""), F.lit("unsupervised"))
            .when(target_is_numeric, F.lit("regression")).otherwise(F.lit("classification")))


def problem_types(jobs: DataFrame, data: DataFrame, target: str = "target_column") -> DataFrame:
    """PRF-19 by schema: ``jobs`` with ``problem_type``, the target looked up
    among the columns of ``data`` (names trimmed).  A target that isn't a
    column has no type."""
    names = {c.strip(): isinstance(data.schema[c].dataType, NUMERIC) for c in data.columns}
    name = F.trim(target)
    numeric = name.isin(*[c for c, num in names.items() if num])
    known = name.isNull() | (name == "") | name.isin(*names)
    return jobs.withColumn("problem_type", F.when(known, problem_type(F.col(target), numeric)))
