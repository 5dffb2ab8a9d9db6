"""A table with its roles: which column is the host, which the time, what is typed, which text a cell has."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Relation:
    """``text`` names a typed column's text companion where there is one; else the text is the value as a string."""

    name: str
    df: DataFrame
    host: str | None = None
    time: str | None = None
    row_id: str | None = None
    data: tuple[str, ...] = ()
    typed: frozenset[str] = frozenset()
    text: dict[str, str] = field(default_factory=dict)

    def text_of(self, column: str) -> Column:
        return F.col(self.text[column]) if column in self.text else F.col(column).cast("string")

    def with_df(self, df: DataFrame) -> Relation:
        return replace(self, df=df)


def blank_to_null(c: Column) -> Column:
    """NULL and the empty text are one thing for filtering, grouping and counting."""
    return F.nullif(c.cast("string"), F.lit(""))
