"""Raw model responses, one row per file and attempt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.schemas import MODEL_RESPONSES

_BROKEN = "_broken"


def read_model_responses(spark: SparkSession, location: str, data_format: str = "json") -> DataFrame:
    """``(project, path, provider, attempt, status, body)`` from JSON lines, Parquet or any Spark source.

    A JSON line that can't be read is a failed attempt, without status and body, of the file it still names. Lines that
    name no file are left to ``unreadable_responses``.
    """
    if data_format != "json":
        return spark.read.format(data_format).schema(MODEL_RESPONSES).load(location)
    lines = _json_lines(spark, location)
    columns = [c.split()[0] for c in MODEL_RESPONSES.split(", ")]
    broken = F.col(_BROKEN).isNotNull()
    told = {
        "project": _named("project"), "path": _named("path"), "provider": _named("provider"),
        "attempt": F.coalesce("attempt", F.expr(f"try_cast(regexp_extract({_BROKEN}, '\"attempt\"\\\\s*:\\\\s*([0-9]+)', 1) AS int)")),
        "status": F.lit(None).cast("int"), "body": F.lit(None).cast("string"),
    }
    rows = lines.select(*[F.when(broken, told[c]).otherwise(F.col(c)).alias(c) for c in columns], broken.alias(_BROKEN))
    return rows.where(~F.col(_BROKEN) | (F.col("project").isNotNull() & F.col("path").isNotNull())).select(*columns)


def unreadable_responses(spark: SparkSession, location: str) -> DataFrame:
    """JSON lines that can't be read: the ``file`` they stand in, ``project`` and ``path`` if the line still names them, the
    ``line``, and how often it stands there (``n``)."""
    lines = _json_lines(spark, location).where(F.col(_BROKEN).isNotNull())
    named = lines.select("file", _named("project").alias("project"), _named("path").alias("path"), F.col(_BROKEN).alias("line"))
    return named.groupBy("file", "project", "path", "line").agg(F.count("*").alias("n"))


def _json_lines(spark: SparkSession, location: str) -> DataFrame:
    reader = spark.read.schema(f"{MODEL_RESPONSES}, {_BROKEN} string").option("columnNameOfCorruptRecord", _BROKEN)
    return reader.json(location).select("*", F.col("_metadata.file_path").alias("file"))


def _named(column: str) -> Column:
    """A text field of a line, read from the line itself if it is broken; null if it isn't there as a whole."""
    text = F.regexp_extract(F.col(_BROKEN), rf'"{column}"\s*:\s*("[^"\\]*+(?:\\.[^"\\]*+)*+")', 1)
    unquoted = F.get_json_object(F.concat(F.lit('{"v":'), F.when(text != "", text), F.lit("}")), "$.v")
    return F.coalesce(F.col(column), unquoted)
