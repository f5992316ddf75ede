"""Static scan: the line rules and the token rules together, as findings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom import schemas
from scanloom.functions import catalog
from scanloom.functions.identity import file_path, finding_id
from scanloom.operators.lines import HITS, has_oversize_line, with_line_hits
from scanloom.operators.segments import file_segments, is_giant, shifted
from scanloom.operators.tokens import with_token_hits


def with_static_hits(
    files: DataFrame, regex_enabled: bool = True, ast_enabled: bool = True, rule_ids: list[str] | None = None,
    line_byte_limit: int | None = None, rules: list[tuple] | None = None, token_rules: list[tuple] | None = None,
) -> DataFrame:
    """Adds ``hits``, all static matches of a file in merge order. One narrow pass over the content.

    The two engines fail apart from each other: a file the line rules give up on keeps its token hits. ``rules`` are
    line rules and ``token_rules`` token rules beside the built-in ones.
    """
    line_ids = {rule[0] for rule in catalog.LINE_RULES} | {rule[0] for rule in rules or []}
    parts = []
    out = files
    if regex_enabled and (rule_ids is None or line_ids & set(rule_ids)):
        out = with_line_hits(out, rule_ids, line_byte_limit, rules)
        parts.append("line_hits")
    token_ids = {rule[0] for rule in catalog.TOKEN_RULES} | {rule[0] for rule in token_rules or []}
    if ast_enabled and (rule_ids is None or token_ids & set(rule_ids)):
        out = with_token_hits(out, rule_ids, token_rules)
        parts.append("token_hits")
    hits = F.concat(*[F.col(p) for p in parts]) if parts else F.array().cast(HITS)
    return out.withColumn("hits", hits).drop(*parts)


def rule_value(rule_id: Column, column: str, rules: list[tuple] | None = None) -> Column:
    """A column of the built-in catalog and of ``rules``, looked up by rule id inside the expression."""
    index = catalog.RULE_COLUMNS.index(column)
    known = catalog.LINE_RULES + catalog.TOKEN_RULES + list(rules or [])
    twice = {r[0] for i, r in enumerate(known) if r[0] in {q[0] for q in known[:i]}}
    if twice:
        raise ValueError(f"rule ids must be unique: {sorted(twice)}")
    pairs = [_literal(x) for rule in known for x in (rule[0], rule[index])]
    return F.try_element_at(F.expr(f"map({', '.join(pairs)})"), rule_id)


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def findings_of(scanned: DataFrame, rules: list[tuple] | None = None, texts: DataFrame | None = None) -> DataFrame:
    """One finding per static hit. The outer explode keeps the optimizer from testing ``hits`` twice.

    The texts of a rule come from ``texts``, a small table with the catalog's columns, if there is one, else from the catalog
    and ``rules``.
    """
    hit = F.col("hit")
    exploded = scanned.select("project", "path", F.explode_outer("hits").alias("hit")).where(hit.isNotNull())

    def text(column: str) -> Column:
        return rule_value(hit["rule_id"], column, rules) if texts is None else F.col(f"rule.{column}")

    if texts is not None:
        named = texts.select(F.col("rule_id").alias("hit_rule"), F.struct(*[c for c in catalog.RULE_COLUMNS if c != "rule_id"]).alias("rule"))
        exploded = exploded.join(F.broadcast(named), hit["rule_id"] == F.col("hit_rule"))
    path = file_path(F.col("project"), F.col("path"))
    source = F.when(hit["stage"] == catalog.SOURCE_STAGE["regex"], F.lit("regex")).otherwise(F.lit("ast"))
    empty = F.lit("")
    return exploded.select(
        "project",
        empty.alias("id"),
        text("title").alias("title"),
        text("description").alias("description"),
        path.alias("file_path"),
        hit["line"].alias("start_line"),
        hit["line"].alias("end_line"),
        text("severity").alias("severity"),
        empty.alias("confidence"),
        text("owasp_id").alias("owasp_id"),
        text("cwe").alias("cwe"),
        source.alias("source"),
        hit["snippet"].alias("code_snippet"),
        text("recommendation").alias("recommendation"),
        empty.alias("raw_output"),
        F.struct(hit["stage"].alias("stage"), hit["a"].alias("a"), hit["b"].alias("b")).alias("ord"),
    )


def _dealt(
    files: DataFrame, hits: Callable[[DataFrame], DataFrame], giant_bytes: int | None, folder: str | None, line_byte_limit: int | None = None
) -> DataFrame:
    """Files with their ``hits``, those of ``giant_bytes`` or more cut into segments that are dealt to many tasks."""
    if giant_bytes is None:
        return hits(files)
    content = F.col("content")
    giant = is_giant(content, giant_bytes)
    if line_byte_limit is not None:  # such a file is given up on as a whole
        giant = giant & ~has_oversize_line(content, line_byte_limit)
    parts = hits(file_segments(files.where(giant), giant_bytes, folder))
    columns = ["project", "path", "hits"]
    moved = parts.withColumn("hits", shifted(F.col("hits"), F.col("first_line"))).select(*columns)
    return hits(files.where(~giant)).select(*columns).unionByName(moved)


def static_scan(
    files: DataFrame, regex_enabled: bool = True, ast_enabled: bool = True, line_byte_limit: int | None = None,
    rules: list[tuple] | None = None, token_rules: list[tuple] | None = None, giant_bytes: int | None = None, folder: str | None = None,
) -> DataFrame:
    """Findings of all enabled rules, and of ``rules`` and ``token_rules``, line and token rules with the columns of the catalog.

    Files of ``giant_bytes`` or more are cut into segments that are dealt to many tasks and staged in ``folder``.
    """
    hits = lambda table: with_static_hits(table, regex_enabled, ast_enabled, None, line_byte_limit, rules, token_rules)
    return findings_of(_dealt(files, hits, giant_bytes, folder, line_byte_limit), [*(rules or []), *(token_rules or [])])


def regex_scan(
    files: DataFrame, rule_ids: list[str] | None = None, line_byte_limit: int | None = None, rules: list[tuple] | None = None,
    giant_bytes: int | None = None, folder: str | None = None,
) -> DataFrame:
    """Findings of the line rules, or of some of them."""
    hits = lambda table: with_line_hits(table, rule_ids, line_byte_limit, rules).withColumnRenamed("line_hits", "hits")
    return findings_of(_dealt(files, hits, giant_bytes, folder, line_byte_limit), rules)


def token_scan(
    files: DataFrame, rule_ids: list[str] | None = None, token_rules: list[tuple] | None = None, giant_bytes: int | None = None,
    folder: str | None = None,
) -> DataFrame:
    """Findings of the token rules, or of some of them, and of ``token_rules``."""
    hits = lambda table: with_token_hits(table, rule_ids, token_rules).withColumnRenamed("token_hits", "hits")
    return findings_of(_dealt(files, hits, giant_bytes, folder), token_rules)


def with_finding_id(findings: DataFrame) -> DataFrame:
    columns = [F.col(c) for c in ("file_path", "start_line", "end_line", "title", "source")]
    return findings.withColumn("id", finding_id(*columns))


def union_finding_groups(*groups: DataFrame) -> DataFrame:
    """All findings of several tables, duplicates kept."""
    out = groups[0].select(*schemas.FINDING_COLUMNS, "ord")
    for group in groups[1:]:
        out = out.unionByName(group.select(*schemas.FINDING_COLUMNS, "ord"))
    return out
