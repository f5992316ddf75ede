"""Merging findings: one row per similarity key, duplicates folded into the first finding of the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom import schemas
from scanloom.functions import catalog
from scanloom.functions.identity import similarity_key
from scanloom.functions.severity import severity_rank
from scanloom.operators.scan import with_finding_id

_ROW = [c for c in schemas.FINDING_COLUMNS if c != "project"]


def with_similarity_key(findings: DataFrame) -> DataFrame:
    columns = [F.col(c) for c in ("file_path", "start_line", "end_line", "title")]
    return findings.withColumn("key", similarity_key(*columns))


def with_severity_rank(findings: DataFrame) -> DataFrame:
    return findings.withColumn("sev_rank", severity_rank(F.col("severity")))


def _first(order: Column, value: Column, when: Column | None = None) -> Column:
    """Value of the first row in merge order (of those that qualify); equal order falls back to the value."""
    pair = F.struct(order.alias("at"), value.alias("value"))
    return F.min(pair if when is None else F.when(when, pair))["value"]


def _first_struct(order: Column, columns: list[str]) -> Column:
    return F.min(F.struct(order.alias("ord"), *columns))


def dedup_findings(findings: DataFrame) -> DataFrame:
    """The first finding of each key, unchanged. A plain minimum, so hot keys shrink before the shuffle."""
    return (
        with_similarity_key(findings)
        .groupBy("key")
        .agg(_first_struct(F.col("ord"), ["project", *_ROW]).alias("kept"))
        .select(*[F.col("kept")[c].alias(c) for c in schemas.FINDING_COLUMNS], F.col("kept")["ord"].alias("ord"))
    )


def merge_duplicates(findings: DataFrame, has_model_rows: bool = True) -> DataFrame:
    """One row per key; later duplicates, in merge order, change the first finding:

    * severity: the highest; OWASP and CWE: the first that is not empty
    * each duplicate from another source adds a line to ``raw_output``
    * when the first finding is static: the description of every model duplicate is put in front of the
      description so far, and its recommendation fills an empty one

    All of it is minimum, maximum and count, which combine before the shuffle. Only model descriptions that
    end up in the output are gathered, in a second branch; it is left out without model rows.
    """
    keyed = with_similarity_key(findings)
    order, source = F.col("ord"), F.col("source")
    is_model = source == "llm"
    sources = list(catalog.SOURCE_STAGE)

    def filled(name: str) -> Column:
        return F.coalesce(_first(order, F.col(name), F.col(name) != ""), F.lit(""))

    rank = severity_rank(F.col("severity"))
    recommended = is_model & (F.col("recommendation") != "")
    folded = keyed.groupBy("key").agg(
        _first_struct(order, ["project", *_ROW]).alias("kept"),
        F.max(rank).alias("top_rank"),
        F.min(F.when(rank > 0, F.struct((-rank).alias("neg_rank"), F.col("severity"))))["severity"].alias("top"),
        filled("owasp_id").alias("first_owasp"),
        filled("cwe").alias("first_cwe"),
        F.coalesce(_first(order, F.col("recommendation"), recommended), F.lit("")).alias("model_recommendation"),
        *[F.count_if(source == s).alias(f"n_{s}") for s in sources],
    )
    kept = F.col("kept")
    is_static = kept["source"] != "llm"
    also = F.concat(
        *[
            F.when(kept["source"] != s, F.repeat(F.lit(catalog.ALSO_DETECTED.format(source=s)), F.col(f"n_{s}").cast("int")))
            .otherwise(F.lit(""))
            for s in sources
        ]
    )
    description = kept["description"]
    if has_model_rows:
        folded = folded.join(_model_descriptions(keyed), "key", "left")
        # Text so far, then each model text in order; leading empty texts are replaced rather than joined.
        texts = F.concat(F.array(kept["description"]), F.coalesce("model_texts", F.array().cast("array<string>")))
        first_text = F.array_position(F.transform(texts, lambda t: t != ""), True)
        stacked = F.array_join(
            F.reverse(F.slice(texts, F.greatest(first_text, F.lit(1)).cast("int"), F.size(texts))), catalog.STATIC_ANALYSIS_MARK
        )
        description = F.when(is_static & F.col("model_texts").isNotNull() & (first_text > 0), stacked).otherwise(
            kept["description"]
        )
    changed = {
        "description": description,
        "severity": F.when(F.col("top_rank") > severity_rank(kept["severity"]), F.col("top")).otherwise(
            kept["severity"]
        ),
        "owasp_id": F.col("first_owasp"),
        "cwe": F.col("first_cwe"),
        "recommendation": F.when(
            is_static & (kept["recommendation"] == ""), F.col("model_recommendation")
        ).otherwise(kept["recommendation"]),
        "raw_output": F.concat(kept["raw_output"], also),
    }
    return folded.select(
        *[changed.get(c, kept[c]).alias(c) for c in schemas.FINDING_COLUMNS], kept["ord"].alias("ord")
    )


def _model_descriptions(keyed: DataFrame) -> DataFrame:
    """Descriptions of the model findings of each key in merge order, for keys that have a static finding.

    The texts become one output value, so gathering them per key is not avoidable; keys with model findings
    alone, whose texts would be thrown away, are dropped before anything is gathered.
    """
    static_keys = keyed.where(F.col("source") != "llm").select("key").distinct()
    model = keyed.where(F.col("source") == "llm").select("key", "ord", "description")
    gathered = F.array_sort(F.collect_list(F.struct("ord", "description")))
    return (
        model.join(static_keys, "key", "left_semi")
        .groupBy("key")
        .agg(F.transform(gathered, lambda x: x["description"]).alias("model_texts"))
    )


def sort_findings(findings: DataFrame) -> DataFrame:
    """Report order: most severe first, then path and line; the id settles ties."""
    rank = severity_rank(F.col("severity"))
    return findings.orderBy(rank.desc(), "file_path", "start_line", "id")


def merge_findings(findings: DataFrame, has_model_rows: bool = True, ordered: bool = False) -> DataFrame:
    """Ids, folding of duplicates and, when a sink wants it, report order."""
    merged = merge_duplicates(with_finding_id(findings), has_model_rows)
    return sort_findings(merged) if ordered else merged
