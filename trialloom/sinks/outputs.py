"""Delimited and JSON outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import delimited_text


def delimited_lines(df: DataFrame) -> DataFrame:
    """One ``line`` per row: all columns as safe text, joined by ``|``."""
    return df.select(F.concat_ws("|", *[delimited_text(F.col(c)) for c in df.columns]).alias("line"))


def write_delimited(df: DataFrame, path: str) -> None:
    """Unaligned ``|``-separated rows without header or quotes, in the order of ``df``."""
    delimited_lines(df).write.mode("errorifexists").text(path)


def json_text(value: Column) -> Column:
    """JSON that keeps NULL fields, as the registry's documents do."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def write_document(document: DataFrame, path: str) -> None:
    """Write a one-column table of JSON documents, one per line."""
    document.write.mode("errorifexists").text(path)
