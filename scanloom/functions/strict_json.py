"""JSON text read without leniency, on VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def allow_duplicate_keys(spark: SparkSession) -> None:
    """Repeated keys of an object are accepted and the last one counts."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def strict_parse(text: Column) -> Column:
    """The text as a variant inside a one-element array, or null unless it is exactly one JSON value.

    The parser accepts text after the first value. Here the text is put into an array in front of a mark made
    from the text itself, which the text cannot hold: only a single whole value leaves the mark second.
    """
    mark = F.md5(text)
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]')))
    parts = wrapped.cast("array<variant>")
    whole = (F.size(parts) == 2) & (F.schema_of_variant(F.get(parts, F.lit(1))) == "STRING") & (
        F.get(parts, F.lit(1)).cast("string") == mark
    )
    return F.when(whole, F.slice(parts, 1, 1))


def kind(value: Column) -> Column:
    """Type name of a variant; a missing value counts as JSON null."""
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
