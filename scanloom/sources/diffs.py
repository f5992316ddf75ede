"""Change listings and unified diffs, given as text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.functions.identity import file_path
from scanloom.functions.text import UNICODE_SPACE, trim_space


def read_changed_files(listings: DataFrame) -> DataFrame:
    """``(project, listing)`` with one path per line -> ``(project, path, file_path)``.

    Paths in a listing are relative to the top of the repository but are joined to the project, so for a
    project in a sub-directory they name no file; that is the behaviour to keep.
    """
    path = F.explode(F.split(trim_space(F.col("listing")), "\n", -1))
    return (
        listings.select("project", path.alias("path"))
        .where(F.col("path") != "")
        .withColumn("file_path", file_path(F.col("project"), F.col("path")))
    )


def diff_hunk_ranges(diffs: DataFrame) -> DataFrame:
    """``(project, path, diff)`` -> the changed line ranges of the new side, both ends included."""
    header = F.explode(F.filter(F.split("diff", "\n", -1), lambda line: F.startswith(line, F.lit("@@"))))
    fields = F.split(trim_space(F.split(F.col("header"), "@@", -1)[1]), UNICODE_SPACE + "+", -1)
    side = F.explode(F.filter(fields, lambda f: F.startswith(f, F.lit("+"))))
    text = F.substring(F.col("field"), 2, 1 << 30)

    def number(pattern: str, group: int):
        return F.coalesce(F.regexp_extract(text, pattern, group).try_cast("bigint"), F.lit(0))

    pair = r"^([+-]?\d+),([+-]?\d+)"
    has_count = F.contains(F.col("field"), F.lit(","))
    start = F.when(has_count, number(pair, 1)).otherwise(number(r"^([+-]?\d+)", 1))
    count = F.when(has_count, number(pair, 2)).otherwise(F.lit(1))
    return (
        diffs.select("project", "path", header.alias("header"))
        .select("project", "path", side.alias("field"))
        .select("project", "path", start.alias("start_line"), count.alias("n"))
        .where(F.col("n") > 0)
        .select("project", "path", "start_line", (F.col("start_line") + F.col("n") - 1).alias("end_line"))
    )
