"""Checks that stop a job whose input breaks what an operator assumes. Each is one aggregate or anti-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    pass


def _fail(bad: DataFrame, what: str, columns) -> None:
    if rows := bad.limit(5).collect():
        shown = ", ".join(str(tuple(r[c] for c in columns)) for r in rows)
        raise ContractError(f"{what}: {shown}")


def unique(df: DataFrame, *keys: str) -> DataFrame:
    """One row per key."""
    _fail(df.groupBy(*keys).count().filter("count > 1"), f"repeated {', '.join(keys)}", keys)
    return df


def covered(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Every key of left occurs in right."""
    _fail(left.join(right, list(keys), "left_anti").select(*keys), f"no match for {', '.join(keys)}", keys)
    return left


def holds(df: DataFrame, condition: Column, what: str, *shown: str) -> DataFrame:
    """The condition is true in every row; null counts as false."""
    _fail(df.filter(~F.coalesce(condition, F.lit(False))), what, shown or df.columns)
    return df


def same_rows(a: DataFrame, b: DataFrame, what: str) -> None:
    """Equal as bags."""
    if not (a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()):
        raise ContractError(what)


def lookup_join(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Left join that neither loses nor repeats rows: right keys are unique and cover the left."""
    unique(right, *keys)
    covered(left, right, *keys)
    return left.join(right, list(keys), "left")
