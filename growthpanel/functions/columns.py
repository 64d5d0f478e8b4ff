"""Small Column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: key column added when the caller names no keys, so that one code path serves one series or many
SINGLE_KEY = "series"


#: columns the steps add; a key of the same name would be confused with them
RESERVED = frozenset(
    "date ts number cumulative row_order pos x y n k d t0 block fold role status start train_end test_start test_end "
    "ymax ymin xlo xhi xmid u e d1 d2 d3 model params pred type scope rmse r2 mae score memory fits alpha beta passes "
    "done converged draw".split()
)


def nan_to_null(value: Column) -> Column:
    """NaN is the reference's missing value; Spark's aggregates only skip NULL."""
    return F.when(~F.isnan(value), value)


def clip(value: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(value, low), high)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives NULL for a zero denominator, under ANSI mode too."""
    return numerator / F.nullif(denominator, F.lit(0.0))


def with_keys(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Give a key-less table one constant key; leave a keyed table alone."""
    if keys:
        return df, list(keys)
    if SINGLE_KEY in df.columns:
        return df, [SINGLE_KEY]
    return df.withColumn(SINGLE_KEY, F.lit("all")), [SINGLE_KEY]


def check_key_names(keys: Sequence[str]) -> None:
    clash = RESERVED.intersection(keys)
    if clash:
        raise ValueError(f"rename the key columns {sorted(clash)}: the weekly and model tables use these names")


def require(df: DataFrame, columns: Sequence[str], what: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks the columns {missing}; it has {df.columns}")
