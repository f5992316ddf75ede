"""Counts and groups of findings.

A group can hold a large part of all findings, so groups come out as rows that carry the group size and a
number inside the group, never as one array per group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanloom.functions.severity import severity_rank
from scanloom.operators.salted import join_groups

# Lines per numbering block.
_BLOCK_LINES = 1000


def count_by_severity(findings: DataFrame) -> DataFrame:
    """Findings per severity, most severe first; severities without findings have no row."""
    return (
        findings.groupBy("severity")
        .agg(F.count("*").alias("n"))
        .orderBy(severity_rank(F.col("severity")).desc(), "severity")
    )


def group_by_file(findings: DataFrame) -> DataFrame:
    """Findings with ``file_findings``, the number in their file, and ``number``, their place in report order.

    The place is the number of findings in earlier blocks of the file plus the place inside the block; a block
    is a stretch of lines at one severity. Blocks are counted first, so a file that holds most findings is
    still spread over many tasks.
    """
    blocked = findings.withColumn("_rank", -severity_rank(F.col("severity"))).withColumn(
        "_block", F.floor(F.col("start_line") / _BLOCK_LINES)
    )
    keys = ["file_path", "_rank", "_block"]
    counts = blocked.groupBy(*keys).agg(F.count("*").alias("_n"))
    whole_file = Window.partitionBy("file_path")
    offsets = counts.select(
        *keys,
        (F.sum("_n").over(whole_file.orderBy("_rank", "_block")) - F.col("_n")).alias("_before"),
        F.sum("_n").over(whole_file).alias("file_findings"),
    )
    in_block = F.row_number().over(Window.partitionBy(*keys).orderBy("start_line", "id"))
    return (
        blocked.withColumn("_inside", in_block)
        .join(offsets, keys)
        .withColumn("number", (F.col("_before") + F.col("_inside")).cast("bigint"))
        .drop("_rank", "_block", "_before", "_inside")
    )


def group_by_severity(findings: DataFrame) -> DataFrame:
    """Findings with the number of findings of their severity."""
    sizes = findings.groupBy("severity").agg(F.count("*").alias("severity_findings"))
    place = F.struct("file_path", "start_line", "id")
    return join_groups(findings, sizes, "severity", place).select("severity", *[c for c in findings.columns if c != "severity"], "severity_findings")


def scan_summary(selected: DataFrame, findings: DataFrame, mode: str, provider: str = "") -> DataFrame:
    """One row per project: files looked at, merged findings, and how the scan was run.

    ``selected`` has one row per file the scan covers. Both counts are summed up before they are joined.
    """
    files = selected.groupBy("project").agg(F.count("*").alias("files_scanned"))
    found = findings.groupBy("project").agg(F.count("*").alias("total_findings"))
    return (
        files.join(found, "project", "full")
        .na.fill(0, ["files_scanned", "total_findings"])
        .select(
            "project",
            F.lit(mode).alias("scan_mode"),
            "files_scanned",
            F.lit(provider == "").alias("static_only"),
            F.lit(provider).alias("llm_provider"),
            "total_findings",
        )
    )
