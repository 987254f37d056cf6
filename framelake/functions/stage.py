"""Columns that are worked out once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def staged(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns (or new values of old ones) that the planner doesn't copy into what uses them.

    A filter or projection above takes an expression's place in the plan as many times as it refers
    to it; a generator of one row keeps it where it is, inside the same stage of generated code.
    """
    others = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*others, F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))
