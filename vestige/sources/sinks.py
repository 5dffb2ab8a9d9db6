"""Written results: rows in order, text unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vestige.functions.times import in_zone_text

#: Options under which a CSV cell is read as it was written.
CSV = {"header": "true", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "emptyValue": "", "nullValue": ""}


def export_csv(df: DataFrame, columns: list[str], order: list[str], path: str, local: dict[str, str] | None = None) -> None:
    """The columns of all rows as CSV files whose names follow the order (nulls last).

    ``local``: times that are shown in a zone, as ``<local> <offset>``.
    """
    ordered = df.orderBy(*[F.col(c).asc_nulls_last() for c in order])
    shown = {c: in_zone_text(F.col(c), zone) for c, zone in (local or {}).items()}
    ordered.withColumns(shown).select(*[F.col(c).cast("string").alias(c) for c in columns]).write.options(**CSV, quoteAll="true").csv(path)


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.schema(", ".join(f"`{c}` string" for c in columns)).options(**CSV, multiLine="true").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a row, with the columns' names; null cells are left out."""
    df.write.option("ignoreNullFields", "true").json(path)


def run_map(spark: SparkSession, sql: str, tables: dict[str, DataFrame]) -> DataFrame:
    """A map's SQL over its tables, which it names in braces."""
    return spark.sql(sql, **tables)
