"""Helpers the operators of this package share: tables, staged results, words and shingle hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of a text whose A-Z have been lower-cased, and what stands between words.
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of text that one step of a vectorised operator takes at once; a longer text is a step of its own.
STEP_BYTES = 4 << 20

#: Row keys up to which a table of them is broadcast.
BROADCAST_KEYS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folder of local sessions that name none.
_own: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, which all executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.startswith("local["):
        named = _own[0] if _own else None
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named.rstrip("/")


def use_own_folder(spark: SparkSession) -> None:
    """Gives local sessions that name no shared folder one of their own; for queries, the operators don't do it."""
    if not _own and spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.master.startswith("local["):
        _own.append(tempfile.mkdtemp(prefix="scanloom-llm-"))


def stage(rows: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Writes ``rows`` to the shared folder and reads them back: lineage is cut, lost executors cost only their part."""
    spark = rows.sparkSession
    target = f"{shared_root(spark)}/llm/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(target, compression=codec)
    return spark.read.schema(rows.schema).parquet(target)


def is_file_scan(docs: DataFrame) -> bool:
    """Whether ``docs`` are rows of Parquet files as they stand there, at most with columns or rows left out."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" and plan.simpleString(1).endswith("] parquet")


def fixed(docs: DataFrame) -> DataFrame:
    """``docs``, written first unless they are rows of files: only those are the same rows each time they are read."""
    return docs if is_file_scan(docs) else stage(docs, "rows")


def row_key(docs: DataFrame) -> F.Column:
    """A number for each row of files, the same each time it is read, however the files are split into tasks.

    It is a 64-bit hash of the file and the place in it.
    """
    if not is_file_scan(docs):
        raise ValueError("rows that come from no file have no place; use fixed() first")
    return F.xxhash64("_metadata.file_path", "_metadata.row_index")


def keyed(docs: DataFrame, **columns: F.Column | str) -> DataFrame:
    """``columns`` of ``docs`` under new names with ``row_``, the row's key.

    An operator that reads its input more than once passes it through ``fixed`` at its beginning.
    """
    docs = fixed(docs)
    named = [(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()]
    return docs.select(*named, row_key(docs).alias("row_"))


def few_or_all(keys: DataFrame, rows: int = BROADCAST_KEYS) -> DataFrame:
    """A written table of row keys, 8 bytes each, broadcast if it is counted to be small; beyond, Spark shuffles."""
    return F.broadcast(keys) if keys.count() <= rows else keys


def hash_sample(rows: DataFrame, size: int, *columns: str) -> DataFrame:
    """At most ``size`` of ``rows``, those whose ``columns`` have the smallest hash.

    Only about twice as many rows can be among them and leave their tasks.
    """
    value = F.xxhash64(*columns)
    share = min(1.0, 2.0 * size / max(1, rows.count()) + 1e-9)
    low = rows if share == 1.0 else rows.filter(value <= int(-(1 << 63) + share * ((1 << 64) - 1)))
    return low.orderBy(value, *columns).limit(size)


def sql_words(text) -> F.Column:
    """The words of a text column as an array, empty for null."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, WORD_GAP), "")


def steps(batch: pa.RecordBatch, column: str, size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose texts in ``column`` hold about ``size`` bytes at most, one row at least."""
    lengths = batch.column(column)
    lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(lengths), 0).cast(pa.int64()))
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if i > start and held + n > size:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and the offset of each text; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    if column.offset:
        column = pa.concat_arrays([column])
    if column.offset:  # a single piece is not copied by concat_arrays
        column = pa.array(column.to_pylist(), pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit words."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Words:
    """Words of a batch of texts: where each starts and ends in ``data``, a 64-bit hash, and ``first`` word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        fold = np.zeros(256, np.uint8)
        for b in range(256):
            if b >= 0x80 or chr(b) in LOWER or chr(b) in "0123456789":
                fold[b] = b
        for a, b in zip(UPPER, LOWER, strict=True):
            fold[ord(a)] = ord(b)
        folded = fold[data]
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = folded != 0
        first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        first[edges] |= inside[1:-1][edges]
        last[edges - 1] |= inside[1:-1][edges - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, offsets)
        with np.errstate(over="ignore"):
            base = np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
            power = np.multiply.accumulate(np.full(len(data) + 1, base, np.uint64))
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(folded * power[:-1], out=sums[1:], dtype=np.uint64)
            inverse = np.uint64(pow(int(base), -1, 1 << 64))
            down = np.multiply.accumulate(np.full(len(data) + 1, inverse, np.uint64))
            self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start])

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of runs of ``width`` words and the first of each text; a shorter text, not empty, is one shingle."""
        n = np.diff(self.first)
        counts = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
        first = np.concatenate([[0], np.cumsum(counts)])
        at = np.arange(first[-1]) + np.repeat(self.first[:-1] - first[:-1], counts)
        until = np.repeat(self.first[1:], counts)
        padded = np.concatenate([self.hash, np.zeros(width, np.uint64)])
        with np.errstate(over="ignore"):
            value = np.zeros(len(at), np.uint64)
            for k in range(width):
                value = value * np.uint64(0xD6E8FEB86659FD93) + np.where(at + k < until, padded[at + k], np.uint64(0)) + np.uint64(1)
        return mix(value), first
