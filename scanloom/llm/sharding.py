"""Sharding by sampled splitters: shards of nearly equal bytes from ranges of the key.

A size-weighted sample of keys (a documented number of rows, ``SAMPLE``) gives quantile boundaries; records fall into the
ranges between them; ranges that hold more than their share, as when one key has a third of all rows, are subdivided by
a hash of the row. The exact bytes of all pieces, a bounded number, give each piece its offset, and the running bytes
inside a piece give each record its own; a record's shard is the part of all bytes in which its middle lies. Only ids,
sizes and checksums are moved, never texts.

Null texts have a size of their own (``OVERHEAD``) and the checksum of no bytes, null keys come first, repeated rows are
records of their own, an empty table has no shards. Columns beside the id and the text are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanloom.llm.common import keyed, stage

#: Bytes that a record has beside its text.
OVERHEAD = 16
SHARDS = 40
#: Keys in the sample, and ranges for each shard.
SAMPLE, RANGES_PER_SHARD = 8_000, 8
LOWEST = -(1 << 63)


def splitters(records: DataFrame, ranges: int, sample: int = SAMPLE) -> np.ndarray:
    """Boundaries between ``ranges`` ranges of ``key``: quantiles of a sample in which a row's chance follows its size."""
    unit = (F.xxhash64("row_", "key").bitwiseAND(F.lit((1 << 53) - 1)) + 1) / float((1 << 53) + 1)
    turns = records.select("key", (-F.log(unit) / F.col("size")).alias("turn"))
    total = records.agg(F.sum("size")).first()[0] or 0
    # about twice the sample takes its turn before this one, so that tasks send no more than is needed
    taken = turns.filter(F.col("turn") <= 2.0 * sample / max(1, total)).orderBy("turn", "key").limit(sample)
    keys = np.sort(np.array([r["key"] for r in taken.select("key").collect()], np.int64))
    if not len(keys):
        return keys
    return np.unique(keys[(np.arange(1, ranges) * len(keys)) // ranges])


def assign(
    docs: DataFrame, shards: int = SHARDS, overhead: int = OVERHEAD, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Shard and place in the shard of every row: doc_id, size, text_crc32, shard, slot."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    base = keyed(
        docs, doc_id=id_column, size=F.octet_length(text).cast("long") + overhead, text_crc32=F.crc32(F.encode(text, "UTF-8"))
    )
    records = stage(base.withColumn("key", F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))), "records")
    ranges = shards * RANGES_PER_SHARD
    bounds = splitters(records, ranges)

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, keys.to_numpy(np.int64), side="right").astype(np.int32))

    placed = records.withColumn("range", range_of("key"))
    held = placed.groupBy("range").agg(F.sum("size").alias("bytes")).toPandas()  # at most `ranges` rows
    total = int(held["bytes"].sum()) if len(held) else 0
    fair = max(1, total // ranges)
    over = {int(r): int(-(-b // fair)) for r, b in zip(held["range"], held["bytes"], strict=True) if b > 2 * fair}
    pieces = F.lit(0)
    if over:
        counts = F.create_map(*[F.lit(x) for pair in over.items() for x in pair])
        pieces = F.coalesce(F.pmod(F.xxhash64("row_"), counts[F.col("range")].cast("long")), F.lit(0))
    placed = stage(placed.withColumn("piece", pieces.cast("int")), "pieces")
    # at most twice `ranges` rows, as a range is cut into pieces of its share
    each = placed.groupBy("range", "piece").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).toPandas()
    each = each.sort_values(["range", "piece"])
    each["byte_base"], each["row_base"] = each["bytes"].cumsum() - each["bytes"], each["rows"].cumsum() - each["rows"]
    bases = docs.sparkSession.createDataFrame(
        [tuple(map(int, r)) for r in each[["range", "piece", "byte_base", "row_base"]].itertuples(index=False)],
        "range int, piece int, byte_base long, row_base long",
    )
    inside = Window.partitionBy("range", "piece").orderBy("key", "row_")
    based = placed.join(F.broadcast(bases), ["range", "piece"])
    offset = F.col("byte_base") + F.sum("size").over(inside) - F.col("size")
    row = F.col("row_base") + F.row_number().over(inside) - 1
    # twice the middle of the record, to stay in whole numbers
    numbered = based.select(
        "doc_id", "size", "text_crc32", row.alias("row"),
        F.least(F.lit(shards - 1), F.floor((2 * offset + F.col("size")).cast("decimal(38,0)") * shards / max(1, 2 * total))).cast("int").alias("shard"),
    )
    numbered = stage(numbered, "numbered")
    firsts = numbered.groupBy("shard").agg(F.min("row").alias("first"))  # one row per shard
    return numbered.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).cast("long").alias("slot")
    )


def write_shards(docs: DataFrame, shards: DataFrame, path: str, id_column: str = "doc_id") -> None:
    """Writes ``docs``, with ids that are unique, as folders shard=0, shard=1, ... below ``path``."""
    placed = docs.join(shards.select(F.col("doc_id").alias(id_column), "shard", "slot"), id_column)
    placed.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
