"""Finding id, similarity key and line label."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanloom.functions.text import simple_lower, trim_space


def file_path(project: Column, path: Column) -> Column:
    return F.concat(project, F.lit("/"), path)


def finding_id(path: Column, start: Column, end: Column, title: Column, source: Column) -> Column:
    """First 16 hex digits of the md5 of path, lines, title and source."""
    return F.substring(F.md5(F.concat_ws(":", path, start, end, title, source)), 1, 16)


def line_bucket(line: Column) -> Column:
    """First line of the 5-line bucket; the division truncates toward zero."""
    return F.call_function("div", line, F.lit(5)) * 5


def similarity_key(path: Column, start: Column, end: Column, title: Column) -> Column:
    """Findings with one key are taken for the same issue."""
    lines = F.concat_ws("-", line_bucket(start), line_bucket(end))
    return F.concat_ws(":", path, lines, simple_lower(trim_space(title)))


def line_label(start: Column, end: Column) -> Column:
    return F.when(start == end, F.concat(F.lit("Line: "), start)).otherwise(
        F.concat(F.lit("Lines: "), start, F.lit("-"), end)
    )
