"""Columns that are computed once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def with_computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Like ``withColumns``, for costly expressions that later steps refer to often.

    The optimiser moves filters and join conditions below a projection by
    copying the expressions they refer to, so a parsed geometry or a projected
    coordinate would be computed again for each mention. Emitting the values
    from a one-row generator keeps each of them to one evaluation; the
    generator is part of the generated code.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(row)))
