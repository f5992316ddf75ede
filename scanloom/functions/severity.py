"""Severity rank, weight, badge and the normalisation of model output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanloom.functions import catalog


def _case(value: Column, table: dict, default) -> Column:
    out = F
    for key, result in table.items():
        out = out.when(value == key, F.lit(result))
    return out.otherwise(F.lit(default))


def severity_rank(severity: Column) -> Column:
    """critical 5 ... info 1, anything else 0."""
    return _case(severity, catalog.SEVERITY_RANK, 0)


def severity_weight(severity: Column) -> Column:
    """Points one finding adds to the risk of its file."""
    return _case(severity, catalog.SEVERITY_WEIGHT, 0)


def severity_emoji(severity: Column) -> Column:
    return _case(severity, catalog.SEVERITY_EMOJI, catalog.OTHER_EMOJI)


def normalize_severity(text: Column) -> Column:
    """Severity of a model item: only the listed spellings count, everything else is info."""
    out = F
    for severity, spellings in catalog.MODEL_SEVERITIES.items():
        out = out.when(text.isin(spellings), F.lit(severity))
    return out.otherwise(F.lit("info"))
