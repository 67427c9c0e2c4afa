"""Names of columns that can't clash with those of a user's table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fresh(df: DataFrame | list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as df (or a list of columns) needs to
    have no such column, in any case."""
    have = {c.lower() for c in (df.columns if isinstance(df, DataFrame) else df)}
    out = []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        have.add(n.lower())
        out.append(n)
    return out


def col(name: str) -> Column:
    """The column of that very name, dots and backticks in it included."""
    return F.col("`" + name.replace("`", "``") + "`")
