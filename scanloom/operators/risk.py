"""Risk score and the choice of files for the model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions import catalog
from scanloom.functions.identity import file_path
from scanloom.functions.once import computed_once
from scanloom.functions.severity import severity_weight
from scanloom.functions.text import with_lower
from scanloom.operators.files import has_risky_name, language_of, with_content_flags
from scanloom.operators.scan import rule_value, with_static_hits


def static_findings_per_file(findings: DataFrame) -> DataFrame:
    """Findings per file and their summed weight, duplicates counted. Partial sums go through the shuffle."""
    return findings.groupBy("file_path").agg(
        F.count("*").alias("static_findings"),
        F.sum(severity_weight(F.col("severity"))).cast("bigint").alias("severity_weight"),
    )


def join_file_findings(profile: DataFrame, findings: DataFrame) -> DataFrame:
    """File profile with the counts of a findings table; files without a finding get zero.

    Both sides are slim: the findings are summed up per file first and the profile holds no content.
    """
    counted = static_findings_per_file(findings)
    joined = profile.withColumn("file_path", file_path(F.col("project"), F.col("path"))).join(
        counted, "file_path", "left"
    )
    return joined.na.fill(0, ["static_findings", "severity_weight"])


def risk_score(weight: Column, crypto: Column, database: Column, auth: Column, risky_name: Column) -> Column:
    points = (
        weight
        + F.when(crypto, catalog.CRYPTO_WEIGHT).otherwise(0)
        + F.when(database, catalog.DATABASE_WEIGHT).otherwise(0)
        + F.when(auth, catalog.AUTH_WEIGHT).otherwise(0)
        + F.when(risky_name, catalog.RISKY_NAME_WEIGHT).otherwise(0)
    )
    return F.least(points.cast("double"), F.lit(catalog.MAX_RISK))


def with_risk_score(profile: DataFrame) -> DataFrame:
    """Adds ``risk_score`` to a profile that has the findings of its files."""
    columns = ("severity_weight", "has_crypto", "has_database", "has_auth", "risky_name")
    return profile.withColumn("risk_score", risk_score(*[F.col(c) for c in columns]))


def scanned_files(
    files: DataFrame, regex_enabled: bool = True, ast_enabled: bool = True, keep_content: bool = False,
    rules: list[tuple] | None = None, token_rules: list[tuple] | None = None,
) -> DataFrame:
    """One row per file with profile, static hits and risk score.

    The static findings of a file come from its own row, so the score needs no join and no shuffle.
    """
    hit_rows = with_content_flags(with_static_hits(with_lower(files), regex_enabled, ast_enabled, rules=rules, token_rules=token_rules))
    own = [*(rules or []), *(token_rules or [])]
    weight = F.aggregate(
        "hits",
        F.lit(0).cast("bigint"),
        lambda total, hit: total + severity_weight(rule_value(hit["rule_id"], "severity", own)).cast("bigint"),
    )
    profile = (
        hit_rows.withColumn("language", language_of(F.col("path")))
        .withColumn("risky_name", has_risky_name(F.col("path")))
        .withColumn("static_findings", F.size("hits").cast("bigint"))
        .withColumn("severity_weight", weight)
    )
    kept = ["content"] if keep_content else []
    computed = [
        "language", "loc", "has_crypto", "has_database", "has_auth", "risky_name", "static_findings",
        "severity_weight", "risk_score", "hits",
    ]
    return computed_once(with_risk_score(profile).select("project", "path", *kept, *computed), *computed)


def select_high_risk(scanned: DataFrame) -> DataFrame:
    """Files whose score is above the threshold; the threshold itself is not enough."""
    return scanned.where(F.col("risk_score") > catalog.HIGH_RISK)
