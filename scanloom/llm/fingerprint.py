"""Document fingerprints: quartile bucket digests of hashed byte triplets, compared with a bounded difference.

The triplets of a text's UTF-8 bytes are counted in ``BUCKETS`` buckets; each bucket is encoded by the quartile its count
falls in, two bits a bucket, after one byte for the length on a logarithmic scale. Two digests differ by the sum of
their quartile differences (the full span counts double) and of their length steps; ``likeness`` maps the difference, cut
at ``bound``, to 0 to 1.

Null is the empty text, whose digest is all zeros; two equal texts always have equal digests; texts under three bytes
count their bytes as one triplet padded with zeros. Repeated rows and ids follow each other in a fixed order, null
ids come first. Columns beside the id and the text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import STEP_BYTES, keyed, stage

#: A power of two.
BUCKETS = 512
#: What one step of the length code adds to a difference, in quartile steps for each 128 buckets.
LENGTH_STEP = 2


def counts_of(texts: list[bytes], buckets: int = BUCKETS) -> np.ndarray:
    """Triplet counts of each text, one row of ``buckets`` columns each."""
    out = np.zeros((len(texts), buckets), np.int64)
    start = 0
    while start < len(texts):
        stop, held = start + 1, len(texts[start])
        while stop < len(texts) and held + len(texts[stop]) <= STEP_BYTES:
            held += len(texts[stop])
            stop += 1
        padded = [t if len(t) > 2 or not t else t.ljust(3, b"\0") for t in texts[start:stop]]
        data = np.frombuffer(b"".join(padded), np.uint8).astype(np.uint32)
        sizes = np.array([len(t) for t in padded])
        if len(data) > 2:
            value = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
            value *= np.uint32(0x9E3779B1)
            value ^= value >> np.uint32(15)
            value *= np.uint32(0x85EBCA77)
            bucket = (value >> np.uint32(32 - buckets.bit_length() + 1)).astype(np.int64)
            ends = np.cumsum(sizes)
            owner = np.repeat(np.arange(len(sizes)), sizes)[: len(bucket)]
            whole = np.ones(len(bucket), bool)
            for back in (1, 2):  # triplets that reach into the next text
                at = ends[:-1] - back
                whole[at[(at >= 0) & (at < len(bucket))]] = False
            out[start:stop] = np.bincount((owner * buckets + bucket)[whole], minlength=(stop - start) * buckets).reshape(-1, buckets)
        start = stop
    return out


def digests(texts: list[bytes], buckets: int = BUCKETS) -> np.ndarray:
    """Length code and quartile codes (0 to 3) of each text, as bytes of ``1 + buckets`` columns."""
    counts = counts_of(texts, buckets)
    cuts = np.partition(counts, [buckets // 4 - 1, buckets // 2 - 1, 3 * buckets // 4 - 1], axis=1) if len(texts) else counts
    codes = np.zeros((len(texts), 1 + buckets), np.uint8)
    for at in (buckets // 4 - 1, buckets // 2 - 1, 3 * buckets // 4 - 1):
        codes[:, 1:] += counts > cuts[:, at : at + 1]
    length = np.array([len(t) for t in texts], np.float64)
    codes[:, 0] = np.minimum(255, np.round(np.log2(length + 1) * 4))
    return codes


def pack(codes: np.ndarray) -> list[str]:
    """Lowercase hex of the length code and of the quartile codes, four to a byte."""
    quads = codes[:, 1:].reshape(len(codes), -1, 4)
    packed = (quads * np.array([64, 16, 4, 1], np.uint8)).sum(axis=2, dtype=np.uint8)
    return [bytes(row).hex() for row in np.concatenate([codes[:, :1], packed], axis=1)]


def unpack(prints: list[str]) -> np.ndarray:
    raw = np.array([list(bytes.fromhex(p)) for p in prints], np.uint8)
    quads = (raw[:, 1:, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3
    return np.concatenate([raw[:, :1], quads.reshape(len(raw), -1)], axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal digests, 0 for a difference of ``bound``, that of unrelated digests, or more."""
    buckets = a.shape[1] - 1
    step = np.abs(a[:, 1:].astype(np.int16) - b[:, 1:].astype(np.int16))
    step = np.where(step == 3, 6, step).sum(axis=1)
    length = np.abs(a[:, 0].astype(np.int64) - b[:, 0].astype(np.int64)) * LENGTH_STEP * buckets / 128
    bound = 2 * buckets  # codes spread evenly over the quartiles differ by 1.625 a bucket when unrelated
    return 1 - np.minimum(1.0, (step + length) / bound)


def edited(text: str, following: str) -> str:
    """``text`` with its last half (rounded down) replaced by as many first characters of ``following``, or all it has."""
    cut = len(text) // 2
    return text[: len(text) - cut] + following[:cut]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
STEP = f"kind int, row_ long, text string, {RESULT}"
DONE, HEAD, TAIL = 0, 1, 2


def compared(texts: list[str], following: list[str]) -> dict[str, list]:
    """Result columns but the id for texts and the document that follows each."""
    changed = [edited(t, f).encode() for t, f in zip(texts, following, strict=True)]
    own, other, after = digests([t.encode() for t in texts]), digests(changed), digests([t.encode() for t in following])
    return {
        "n_chars": [len(t) for t in texts], "edited_sha256": [hashlib.sha256(t).hexdigest() for t in changed],
        "fingerprint": pack(own), "edited_fingerprint": pack(other),
        "near_edited": likeness(own, other).tolist(), "near_next": likeness(own, after).tolist(),
    }


def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows: results of all but the last, and the first and last with their texts."""
    schema = pa.schema([
        ("kind", pa.int32()), ("row_", pa.int64()), ("text", pa.string()), ("doc_id", pa.int64()), ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ])

    def edge(kind: int, row: tuple) -> pa.RecordBatch:
        doc_id, row_, text = row
        return pa.RecordBatch.from_pylist([{"kind": kind, "row_": row_, "text": text, "doc_id": doc_id}], schema)

    last = None
    for batch in batches:
        rows = list(zip(batch.column("doc_id").to_pylist(), batch.column("row_").to_pylist(), (t or "" for t in batch.column("text").to_pylist()), strict=True))
        if not rows:
            continue
        if last is None:
            yield edge(HEAD, rows[0])
        else:
            rows.insert(0, last)
        last = rows[-1]
        start = 0
        while start < len(rows) - 1:
            stop, held = start, 0
            while stop < len(rows) - 1 and (stop == start or held + len(rows[stop][2]) <= STEP_BYTES):
                held += len(rows[stop][2])
                stop += 1
            n = stop - start
            found = compared([r[2] for r in rows[start:stop]], [r[2] for r in rows[start + 1 : stop + 1]])
            found |= {"kind": [DONE] * n, "row_": [r[1] for r in rows[start:stop]], "text": [None] * n, "doc_id": [r[0] for r in rows[start:stop]]}
            yield pa.RecordBatch.from_pydict({f.name: found[f.name] for f in schema}, schema)
            start = stop
    if last is not None:
        yield edge(TAIL, last)


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that to the next document's.

    Texts are moved once, into ranges of the id. The rows at the edges of the ranges, two a range, meet their neighbours
    in a small join.
    """
    spark = docs.sparkSession
    rows = keyed(docs, doc_id=F.col(id_column).cast("long"), text=text_column)
    sorted_rows = rows.repartitionByRange("doc_id", "row_").sortWithinPartitions("doc_id", "row_")
    done = stage(sorted_rows.mapInArrow(in_order, STEP), "fingerprints")
    edges = done.filter(F.col("kind") != DONE).select("kind", "doc_id", "row_").collect()  # two rows a range
    order = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["row_"])
    heads, tails = (sorted((r for r in edges if r["kind"] == k), key=order) for k in (HEAD, TAIL))
    after = [(t["row_"], heads[(i + 1) % len(heads)]["row_"]) for i, t in enumerate(tails)]
    links = F.broadcast(spark.createDataFrame(after, "row_ long, next_row long"))
    tail_rows = done.filter(F.col("kind") == TAIL).select("row_", "doc_id", "text")
    head_rows = done.filter(F.col("kind") == HEAD).select(F.col("row_").alias("next_row"), F.col("text").alias("following"))

    def at_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pydict()
                found = compared(row["text"], row["following"])
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(row["doc_id"], pa.int64())} | found)

    joined = tail_rows.join(links, "row_").join(head_rows, "next_row").select("doc_id", "text", "following")
    columns = [c.split()[0] for c in RESULT.split(", ")]
    return done.filter(F.col("kind") == DONE).select(*columns).union(joined.mapInArrow(at_edges, RESULT).select(*columns))
