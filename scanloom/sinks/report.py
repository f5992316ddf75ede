"""JSON and Markdown reports.

A report is a table of text fragments in document order: a head and a foot per project and one fragment per
finding. A project can hold any share of all findings, so no document is ever put together in one row; written
in order, the fragments are the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom import schemas
from scanloom.functions import catalog
from scanloom.functions.severity import severity_emoji, severity_rank
from scanloom.functions.text import filled
from scanloom.operators.files import base_name
from scanloom.operators.grouping import group_by_file
from scanloom.operators.salted import join_groups

_OPTIONAL = ["confidence", "owasp_id", "cwe", "code_snippet", "recommendation", "raw_output"]
_SEVERITIES = list(catalog.SEVERITY_RANK)
HEAD, BODY, FOOT = 0, 1, 2


def finding_json(findings: DataFrame) -> DataFrame:
    """Adds ``json``, the finding as an object; optional fields without a value are left out."""
    names = [c for c in schemas.FINDING_COLUMNS if c != "project"]
    fields = [
        (F.nullif(F.col(n), F.lit("")) if n in _OPTIONAL else F.col(n)).alias(n) for n in names
    ]
    return findings.withColumn("json", F.to_json(F.struct(*fields)))


def report_json(
    findings: DataFrame, summary: DataFrame, start_time: str = "", end_time: str = "", duration: str = ""
) -> DataFrame:
    """Fragments ``(project, part, rank, file_path, start_line, id, text)`` of one JSON document per project."""
    order = F.struct(
        severity_rank(F.col("severity")).alias("neg_rank"), F.col("file_path"), F.col("start_line"), F.col("id")
    )
    order = F.struct((-order["neg_rank"]).alias("rank"), order["file_path"], order["start_line"], order["id"])
    rows = finding_json(findings).select("project", "json", order.alias("place"))
    first = rows.groupBy("project").agg(F.min("place").alias("first"))
    place = F.col("place")
    body = join_groups(rows, first, "project", place).select(
        "project",
        F.lit(BODY).alias("part"),
        place["rank"].alias("rank"),
        place["file_path"].alias("file_path"),
        place["start_line"].alias("start_line"),
        place["id"].alias("id"),
        F.when(place == F.col("first"), F.col("json")).otherwise(F.concat(F.lit(","), F.col("json"))).alias("text"),
    )
    # A change listing without files leaves the list itself out.
    nothing = (F.col("scan_mode") == "diff") & (F.col("files_scanned") == 0)
    head_fields = F.to_json(
        F.struct(
            F.col("project").alias("project_path"),
            "scan_mode",
            F.lit(start_time).alias("start_time"),
            F.lit(end_time).alias("end_time"),
            F.lit(duration).alias("duration"),
            "files_scanned",
        )
    )
    head = F.concat(
        F.left(head_fields, F.length(head_fields) - 1),
        F.when(nothing, F.lit(',"findings":null')).otherwise(F.lit(',"findings":[')),
    )
    foot_fields = F.to_json(
        F.struct("static_only", F.nullif(F.col("llm_provider"), F.lit("")).alias("llm_provider"), "total_findings")
    )
    foot = F.concat(
        F.when(nothing, F.lit("")).otherwise(F.lit("]")), F.lit(","), F.substring(foot_fields, 2, 1 << 30)
    )
    return body.unionByName(_edge(summary, HEAD, head)).unionByName(_edge(summary, FOOT, foot))


def _edge(summary: DataFrame, part: int, text: Column) -> DataFrame:
    return summary.select(
        "project",
        F.lit(part).alias("part"),
        F.lit(0).alias("rank"),
        F.lit("").alias("file_path"),
        F.lit(0).cast("bigint").alias("start_line"),
        F.lit("").alias("id"),
        text.alias("text"),
    )


def report_severity_table(findings: DataFrame) -> DataFrame:
    """``(project, severity, rank, n, row)``: one table row per severity that occurs."""
    severity = F.col("severity")
    return (
        findings.where(severity_rank(severity) > 0)
        .groupBy("project", "severity")
        .agg(F.count("*").alias("n"))
        .select(
            "project",
            "severity",
            severity_rank(severity).alias("rank"),
            "n",
            filled(catalog.REPORT_SEVERITY_ROW, emoji=severity_emoji(severity), severity=severity, n=F.col("n")).alias("row"),
        )
    )


def _if_text(template: str, name: str) -> Column:
    value = F.col(name)
    return F.when(value != "", filled(template, value=value)).otherwise(F.lit(""))


def finding_markdown(number: Column) -> Column:
    """One finding as Markdown; a CWE without an OWASP category keeps its leading separator."""
    start, end, severity = F.col("start_line"), F.col("end_line"), F.col("severity")
    lines = F.when(start == end, filled(catalog.REPORT_LINE, start=start)).otherwise(
        filled(catalog.REPORT_LINES, start=start, end=end)
    )
    return filled(
        catalog.REPORT_FINDING,
        number=number,
        title=F.col("title"),
        emoji=severity_emoji(severity),
        severity=severity,
        source=F.col("source"),
        lines=lines,
        owasp=_if_text(catalog.REPORT_OWASP, "owasp_id"),
        cwe=_if_text(catalog.REPORT_CWE, "cwe"),
        description=_if_text(catalog.REPORT_DESCRIPTION, "description"),
        code=_if_text(catalog.REPORT_CODE, "code_snippet"),
        recommendation=_if_text(catalog.REPORT_RECOMMENDATION, "recommendation"),
    )


def file_heading() -> Column:
    path = F.col("file_path")
    return filled(catalog.REPORT_FILE, name=base_name(path), file_path=path, n=F.col("file_findings"))


def report_empty(summary: DataFrame) -> DataFrame:
    """The section that stands in for the findings, for projects without any."""
    return summary.where(F.col("total_findings") == 0).select("project", F.lit(catalog.REPORT_NO_ISSUES).alias("text"))


def report_markdown(
    findings: DataFrame, summary: DataFrame, generated: str = "", duration: str = ""
) -> DataFrame:
    """Fragments ``(project, part, file_path, number, text)`` of one Markdown document per project.

    Files come in path order; the heading of a file is part of its first finding.
    """
    numbered = group_by_file(findings)
    number = F.col("number")
    body = numbered.select(
        "project",
        F.lit(BODY).alias("part"),
        "file_path",
        "number",
        F.concat(F.when(number == 1, file_heading()).otherwise(F.lit("")), finding_markdown(number)).alias("text"),
    )
    counts = findings.groupBy("project").agg(*[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in _SEVERITIES])
    rows = [
        F.when(
            F.col(f"n_{s}") > 0,
            filled(
                catalog.REPORT_SEVERITY_ROW + "\n",
                emoji=F.lit(catalog.SEVERITY_EMOJI[s]), severity=F.lit(s), n=F.col(f"n_{s}"),
            ),
        ).otherwise(F.lit(""))
        for s in _SEVERITIES
    ]
    total = F.col("total_findings")
    head = filled(
        catalog.REPORT_HEAD,
        generated=F.lit(generated),
        project=F.col("project"),
        scan_mode=F.col("scan_mode"),
        duration=F.lit(duration),
        files_scanned=F.col("files_scanned"),
        total_findings=total,
        kind=F.when(F.col("static_only"), F.lit(catalog.REPORT_STATIC_ONLY)).otherwise(
            filled(catalog.REPORT_PROVIDER, provider=F.col("llm_provider"))
        ),
        table=F.concat(*rows),
        next=F.when(total > 0, F.lit(catalog.REPORT_FILES)).otherwise(F.lit(catalog.REPORT_NO_ISSUES)),
    )
    foot = F.lit(catalog.REPORT_FOOT)
    counted = summary.join(counts, "project", "left").na.fill(0, [f"n_{s}" for s in _SEVERITIES])

    def edge(table_: DataFrame, part: int, text: Column) -> DataFrame:
        zero = F.lit(0).cast("bigint").alias("number")
        return table_.select(
            "project", F.lit(part).alias("part"), F.lit("").alias("file_path"), zero, text.alias("text")
        )

    return edge(counted, HEAD, head).unionByName(body).unionByName(edge(summary, FOOT, foot))


def report_audit_fields(summary: DataFrame, scanned_by: str, scan_timestamp: str, git_commit: str) -> DataFrame:
    """Summary with the fields of an audit trail."""
    return (
        summary.withColumn("scanned_by", F.lit(scanned_by))
        .withColumn("scan_timestamp", F.lit(scan_timestamp))
        .withColumn("git_commit", F.lit(git_commit))
    )


def write_findings_json(findings: DataFrame, location: str) -> None:
    """Findings as JSON lines, the form for large scans; one directory per project."""
    finding_json(findings).select("project", F.col("json").alias("value")).write.partitionBy("project").text(location)


def write_fragments(fragments: DataFrame, location: str) -> None:
    """Report fragments as text, one directory per project; its files in name order are the document."""
    order = [c for c in fragments.columns if c != "text"]
    text = F.regexp_replace("text", r"\n\z", "").alias("value")
    fragments.orderBy(*order).select("project", text).write.partitionBy("project").text(location)
