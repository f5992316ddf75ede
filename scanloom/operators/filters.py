"""Filters on findings and files, and the semi-join that keeps content out of a shuffle when it can."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.functions.catalog import SEVERITY_RANK
from scanloom.functions.severity import severity_rank

# Key lists up to this size are sent to every executor.
BROADCAST_BYTES = 64 << 20
# Beyond, a table of bits is sent first: so many for each key, and this many bytes at most.
BITS_OF_KEY, FILTER_BYTES = 10, 64 << 20


def keep_matching(table: DataFrame, keys: DataFrame, on: list[str], broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows of ``table`` whose key columns appear in ``keys``.

    The keys are measured first. A small list is broadcast, so the wide table stays where it is. A larger one is joined by
    shuffle; before it, rows whose key has no bit in a broadcast table of the keys' hashes are dropped, so that little more
    than the listed rows is moved.
    """
    wanted = keys.select(*on).distinct()
    row_bytes = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 24 for c in on), F.lit(0))
    size, count = wanted.agg(F.sum(row_bytes.cast("bigint")), F.count("*")).first()
    if (size or 0) <= broadcast_bytes:
        return table.join(F.broadcast(wanted), on, "left_semi")
    return maybe_matching(table, wanted, on, count).join(wanted, on, "left_semi")


def maybe_matching(table: DataFrame, keys: DataFrame, on: list[str], count: int) -> DataFrame:
    """Rows of ``table`` whose key may be among ``count`` keys: all that are, and about one in ten of the others.

    The hashes of the keys set bits in rows of 32,768; with very many keys more of the others pass.
    """
    bits = min(BITS_OF_KEY * max(count, 1), 8 * FILTER_BYTES)
    place = F.pmod(F.xxhash64(*on), F.lit(bits)) + 1
    held = keys.select(F.bitmap_bucket_number(place).alias("_bucket"), F.bitmap_bit_position(place).alias("_bit"))
    held = held.groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bitmap"))
    asked = table.withColumn("_bucket", F.bitmap_bucket_number(place)).withColumn("_bit", F.bitmap_bit_position(place))
    byte = F.conv(F.hex(F.substring(F.col("_bitmap"), (F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.call_function("shiftright", byte, (F.col("_bit") % 8).cast("int")).bitwiseAND(1) == 1
    return asked.join(F.broadcast(held), "_bucket").where(is_set).select(*table.columns)


def filter_by_files(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings in the listed files (column ``file_path``); an empty list lets everything through."""
    return findings if files.isEmpty() else keep_matching(findings, files, ["file_path"])


def filter_by_min_severity(findings: DataFrame, minimum: str) -> DataFrame:
    """Findings at or above a severity; an unknown name keeps all."""
    return findings.where(severity_rank(F.col("severity")) >= SEVERITY_RANK.get(minimum, 0))


def filter_critical(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("severity") == "critical")


def filter_path_contains(findings: DataFrame, text: str) -> DataFrame:
    return findings.where(F.contains("file_path", F.lit(text)))


def join_changed_files(files: DataFrame, changed: DataFrame) -> DataFrame:
    """Files named in a change listing; neither ignore rules nor languages play a part."""
    return keep_matching(files, changed, ["project", "path"])
