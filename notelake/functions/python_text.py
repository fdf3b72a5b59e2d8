"""Text and rounding that Spark's built-ins do differently, vectorised over Arrow batches."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..session import ship


def _series(values: pd.Series, f) -> pd.Series:
    return pd.Series([None if x is None or x != x else f(x) for x in values], dtype=object)


def title(c: Column) -> Column:
    """Every run of letters begins with a capital."""
    ship(SparkSession.active())

    @F.pandas_udf("string")
    def apply(values: pd.Series) -> pd.Series:
        return _series(values, str.title)

    return apply(c)


def nfc(c: Column) -> Column:
    ship(SparkSession.active())

    @F.pandas_udf("string")
    def apply(values: pd.Series) -> pd.Series:
        return _series(values, lambda x: unicodedata.normalize("NFC", x))

    return apply(c)


def exact_round(c: Column, digits: int) -> Column:
    """Half to even on the exact binary value."""
    ship(SparkSession.active())

    @F.pandas_udf("double")
    def apply(values: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or x != x else round(x, digits) for x in values], dtype="float64")

    return apply(c)


def fixed(c: Column, digits: int) -> Column:
    """A number with that many decimals, from the exact binary value."""
    ship(SparkSession.active())

    @F.pandas_udf("string")
    def apply(values: pd.Series) -> pd.Series:
        return _series(values, lambda x: f"{x:.{digits}f}")

    return apply(c)
