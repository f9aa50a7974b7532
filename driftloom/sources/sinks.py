"""Report sinks: rows as parquet, JSON lines, CSV, ORC or a Markdown table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMATS = ("parquet", "json", "csv", "orc")


def write(df: DataFrame, folder: str, kind: str = "parquet", mode: str = "overwrite") -> None:
    """Writes a frame; CSV has a header line."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    writer = df.write.mode(mode)
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(folder)


def read(spark, folder: str, kind: str, schema=None) -> DataFrame:
    """Reads what ``write`` wrote; JSON and CSV want the schema."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return (reader.option("header", True) if kind == "csv" else reader).format(kind).load(folder)


def markdown(df: DataFrame) -> DataFrame:
    """One Markdown table row per row, in a column ``line``; bars inside cells are escaped, nulls are empty."""
    cells = [F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in df.columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
