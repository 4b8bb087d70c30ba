"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reeltable.functions.tables import Stored, shared_dir, written  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words are runs of anything but ASCII white space (space, \t, \n, \v, \f, \r).
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def ascii_lower(c: Column) -> Column:
    """A-Z become a-z; every other character stays (unlike `lower`)."""
    return F.translate(c, UPPER, LOWER)


def words_of(text: Column, between: str = SPACES) -> Column:
    """The words of text, which stand between matches of `between`. Splitting is a quarter of the work of extracting."""
    return F.filter(F.split(text, between), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over `value`, which is computed once for each row, also where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def carried(df: DataFrame, *names: str) -> DataFrame:
    """Each row whole as `_row`, beside these columns (null where missing): what an operator adds can't clash with the row's own columns."""
    have = set(df.columns)
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row")
    return df.select(row, *(F.col(f"`{n}`") if n in have else F.lit(None).cast("string").alias(n) for n in names))


def own_names(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns; a missing one is null. Extra columns can't clash with what an operator adds."""
    have = set(df.columns)
    return df.select(*(F.col(f"`{n}`") if n in have else F.lit(None).cast("string").alias(n) for n in names))
