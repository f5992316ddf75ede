"""The static scan on a stream of files.

Line rules, token rules, profile and score work inside one row, so they take a streaming DataFrame as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from scanloom.operators.files import select_files
from scanloom.operators.scan import static_scan


def stream_findings(
    files: DataFrame, languages: list[str] | None = None, ignore: list[str] | None = None
) -> DataFrame:
    """Un-merged findings of files as they arrive; stateless, so nothing needs a watermark."""
    return static_scan(select_files(files, languages, ignore))
