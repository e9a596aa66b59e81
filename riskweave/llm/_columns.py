"""Columns that an operator does not look at, kept out of its way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def named(column: str) -> str:
    """The column's name as a part of an expression."""
    return "`" + column.replace("`", "``") + "`"


def guarded(df: DataFrame, needed: dict[str, str]) -> tuple[DataFrame, Callable[[DataFrame, list[str]], DataFrame]]:
    """df as the needed columns by working name (name -> column) and all others in the struct ``_rest``, so that none clashes with an
    operator's own; and a function that gives the columns of df back before the named results. A result replaces an input column of its name."""
    others = [c for c in df.columns if c not in needed.values()]
    rest = F.struct(*[F.col(named(c)) for c in others]) if others else F.struct(F.lit(0).alias("none"))
    work = df.select(*[F.col(named(c)).alias(w) for w, c in needed.items()], rest.alias("_rest"))
    working = {c: w for w, c in needed.items()}

    def restore(out: DataFrame, results: list[str]) -> DataFrame:
        taken = {r.lower() for r in results}
        kept = [F.col(working[c]).alias(c) if c in working else F.col(f"_rest.{named(c)}") for c in df.columns if c.lower() not in taken]
        return out.select(*kept, *results)

    return work, restore


def without(df: DataFrame, results: list[str]) -> DataFrame:
    """df without the columns that results replace."""
    taken = {r.lower() for r in results}
    return df.drop(*[c for c in df.columns if c.lower() in taken])
