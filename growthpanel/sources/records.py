"""Reading dated records into the form every later step expects: keys, ts, number, cumulative."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from growthpanel.functions.columns import check_key_names, nan_to_null, require, with_keys

MISSING_KEY = "(missing)"

#: column with the text of a CSV line that has too few or too many fields, else NULL
CORRUPT = "corrupt_line"


def read_table(spark: SparkSession, path: str, format: str | None = None, mode: str = "strict") -> DataFrame:
    """Open a CSV with a header, or parquet.

    CSV columns stay text: no inference pass over the data. A line with too few or too many fields ends the job in strict
    mode; in permissive mode its text is in the column ``corrupt_line`` (see ``reject_table``). Telling such lines takes
    all fields of a line, so a CSV is read whole whichever columns are used.
    """
    _check_mode(mode)
    format = format or ("csv" if path.lower().endswith((".csv", ".csv.gz")) else "parquet")
    try:
        if format == "csv":
            reader = spark.read.option("header", True).option("enforceSchema", False)
            names = reader.csv(path).columns
            fields = [T.StructField(name, T.StringType()) for name in [*names, CORRUPT]]
            # without pruning, as Spark counts the fields of a line only where it parses all of them
            reader = reader.option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False)
            lines = reader.schema(T.StructType(fields)).csv(path)
            return lines if mode == "permissive" else _sound_lines(lines, names, True)
        return spark.read.format(format).load(path)
    except AnalysisException as error:
        raise FileNotFoundError(f"cannot read {format} data at {path}: {error}") from error


def _check_mode(mode: str) -> None:
    if mode not in ("strict", "permissive"):
        raise ValueError(f"mode must be 'strict' or 'permissive', not {mode!r}")


def _sound_lines(lines: DataFrame, names: Sequence[str], strict: bool) -> DataFrame:
    """Lines with the right number of fields; in strict mode another one ends the job with its text in the message."""
    sound = F.col(CORRUPT).isNull()
    if strict:
        # Spark refuses to read the text of corrupt lines alone, so the message takes a field as well
        field = F.coalesce(F.col(f"`{names[0]}`"), F.lit(""))
        complaint = F.concat(F.lit("line with a wrong number of fields: "), F.col(CORRUPT), F.lit(", which begins with "), field)
        sound = F.when(sound, F.lit(True)).otherwise(F.raise_error(complaint).cast("boolean"))
    return lines.where(sound).drop(CORRUPT)


def _timestamp(column: str, date_format: str | None) -> Column:
    pattern = None if date_format is None else F.lit(date_format)
    text = F.col(column).cast("string")
    return F.try_to_timestamp(text) if pattern is None else F.try_to_timestamp(text, pattern)


def _is_time(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))


def _checked(parsed: Column, raw: Column, what: str, strict: bool) -> Column:
    """In strict mode a value that is present but unreadable ends the job with its text in the message."""
    if not strict:
        return parsed
    complaint = F.raise_error(F.concat(F.lit(f"unreadable {what}: "), raw.cast("string")))
    return F.when(raw.isNotNull() & parsed.isNull(), complaint).otherwise(parsed)


def _number(df: DataFrame, column: str, strict: bool) -> Column:
    parsed = F.col(column).try_cast("double")
    if isinstance(df.schema[column].dataType, T.StringType):
        parsed = _checked(parsed, F.col(column), column, strict)
    return nan_to_null(parsed)


def _key(df: DataFrame, column: str) -> Column:
    """Equality joins lose NULL keys, so text keys get a label and others must not be NULL."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.StringType):
        return F.coalesce(F.col(column), F.lit(MISSING_KEY)).alias(column)
    missing = F.raise_error(F.lit(f"key column {column} is NULL")).cast(kind)
    return F.coalesce(F.col(column), missing).alias(column)


def select_records(
    df: DataFrame,
    keys: Sequence[str] = (),
    date: str = "date",
    number: str = "enrollment_cleaned",
    cumulative: str | None = "cumulative",
    order_by: str | None = None,
    date_format: str | None = None,
    mode: str = "strict",
) -> DataFrame:
    """Keep and rename the columns that matter.

    ``mode='strict'`` fails on one unreadable value; ``'permissive'`` turns it into NULL and leaves corrupt lines out (see
    ``rejected_records`` and ``reject_table``).
    ``order_by`` names a whole-number column that orders rows with the same timestamp.
    """
    _check_mode(mode)
    check_key_names(keys)
    require(df, [*keys, date, number, *filter(None, [cumulative, order_by])], "the input")
    strict = mode == "strict"
    if CORRUPT in df.columns:
        df = _sound_lines(df, [date], strict)
    ts = F.col(date) if _is_time(df, date) else _checked(_timestamp(date, date_format), F.col(date), date, strict)
    columns = [_key(df, k) for k in keys] + [ts.alias("ts"), _number(df, number, strict).alias("number")]
    if cumulative is not None:
        columns.append(_number(df, cumulative, strict).alias("cumulative"))
    if order_by is not None:
        columns.append(F.col(order_by).cast("bigint").alias("row_order"))
    return with_keys(df.select(*columns), keys)[0]


def rejected_records(df: DataFrame, date: str, date_format: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Rows per key, and how many of them have a date that permissive mode cannot read."""
    ts = F.col(date) if _is_time(df, date) else _timestamp(date, date_format)
    keyed, names = with_keys(df, keys)
    return keyed.groupBy(*names).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(date).isNotNull() & ts.isNull()).alias("rejected"),
    )


def reject_table(
    df: DataFrame, date: str = "date", numbers: Sequence[str] = ("enrollment_cleaned", "cumulative"), date_format: str | None = None
) -> DataFrame:
    """What permissive mode cannot read: the row with ``reason`` and the ``value`` that is to blame, one row per reason.

    Reasons are ``corrupt_line`` (a wrong number of fields, so no field can be trusted and none is judged),
    ``unreadable_date`` and ``unreadable_<column>``. An empty field is missing, not unreadable.
    """
    require(df, [date, *numbers], "the input")
    whole = F.col(CORRUPT).isNull() if CORRUPT in df.columns else F.lit(True)

    def reason(bad: Column, name: str, value: Column) -> Column:
        return F.when(bad, F.struct(F.lit(name).alias("reason"), value.cast("string").alias("value")))

    found = [] if CORRUPT not in df.columns else [reason(~whole, "corrupt_line", F.col(CORRUPT))]
    if not _is_time(df, date):
        bad = F.col(date).isNotNull() & _timestamp(date, date_format).isNull()
        found.append(reason(whole & bad, "unreadable_date", F.col(date)))
    for name in numbers:
        bad = F.col(name).isNotNull() & F.col(name).try_cast("double").isNull()
        found.append(reason(whole & bad, f"unreadable_{name}", F.col(name)))
    kept = [c for c in df.columns if c not in (CORRUPT, "reason", "value")]
    rows = df.withColumn("reject", F.explode(F.array_compact(F.array(*found))))
    return rows.select(*[F.col(f"`{c}`") for c in kept], "reject.reason", "reject.value")
