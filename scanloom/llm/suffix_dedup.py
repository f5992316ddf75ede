"""Removal of passages that a document of a smaller id holds too, byte by byte, by suffix order.

A string of ``LENGTH`` bytes is anchored at its least ``GRAM``-byte piece by hash, so equal strings have equal anchors,
wherever they are. Consecutive strings with one anchor form a piece of text, and the pieces of an anchor that occurs in
more than one document meet. Equal pieces are one before they are shuffled, with their smallest id. Where pieces of an
anchor differ, their suffixes are put in order by linear grouping (``suffix_order``), many anchors at a time, with the
anchor's bytes as one symbol; strings that pieces share stand next to each other in it, and the smallest id among their
pieces tells who has them first. The ends of pieces whose strings are in no other piece by their hashes stay out of it. The pieces of an anchor with too many different ones are halved, and put in order among
those that agree in more bytes around the anchor, until no group has too many.

Of texts that are equal as a whole only those with the smallest id are cut into pieces; the others go as a whole. Null
and empty texts, and those shorter than a string, stay as they are. Equal ids are not smaller than each other; a null id
is neither smaller nor greater, so its text stays and removes nothing. Columns beside the id and the text are not read.
A text of any length is cut in slices.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import few_or_all, keyed, mix, stage, steps, text_bytes
from scanloom.llm.substring_dedup import sliding_minimum
from scanloom.llm.suffix_order import suffix_order

#: Bytes of a string that counts as repeated, and of the anchor inside it. A string has at most 62 anchor places.
LENGTH, GRAM = 50, 24
#: Different pieces of an anchor whose suffixes are put in order together.
TOGETHER = 1000
#: Symbols of one suffix order.
SYMBOLS = 1 << 17
#: Bytes of text that are cut into pieces at once.
SLICE = 1 << 20
#: Anchors up to which a table of them, 8 bytes each, is broadcast.
BROADCAST_ANCHORS = 4_000_000

PIECE = "row_ long, doc_id long, anchor long, digest long, begin long, n int, lead int, piece binary"
#: Odd base of the hashes.
BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, below 2^64."""
    up, down = (np.append(np.uint64(1), np.full(size, base, np.uint64)) for base in (BASE, pow(BASE, -1, 1 << 64)))
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Rolling:
    """Hashes of any stretches of ``data``."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(1 << max(SLICE + 1024, len(data)).bit_length())
        self.sums = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def of(self, begin: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[begin]) * self.down[begin])


class Pieces:
    """Pieces of texts in a row: the text each is in, its anchor, place in ``data``, number of strings and bytes before the
    anchor."""

    def __init__(self, data: np.ndarray, first: np.ndarray, length: int, gram: int):
        width, n = length - gram + 1, len(data)
        none = np.zeros(0, np.int64)
        self.text, self.begin, self.n, self.lead, self.anchor, self.digest = none, none, none, none, none.view(np.uint64), none.view(np.uint64)
        if n < length:
            return
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        at = np.flatnonzero(owner[: n - length + 1] == owner[length - 1 :])
        if not len(at):
            return
        rolling = Rolling(data)
        grams = rolling.of(slice(0, n - gram + 1), slice(gram, n + 1))
        bits = np.uint64(36)
        least = sliding_minimum((grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64), width)[at]
        place = (least & np.uint64((1 << 36) - 1)).astype(np.int64)
        new = np.append(True, (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1))
        runs = np.flatnonzero(new)
        self.begin, place = at[runs], place[runs]
        self.n = np.diff(np.append(runs, len(at)))
        self.text, self.lead, self.anchor = owner[self.begin], place - self.begin, grams[place]
        self.digest = rolling.of(self.begin, self.begin + self.n + length - 1)


def sliced(data: np.ndarray, first: np.ndarray, length: int, gram: int) -> Iterator[tuple[int, np.ndarray, Pieces]]:
    """Pieces of slices of texts in a row, with the slice and where it begins; each string is in one slice."""
    for low in range(0, max(1, len(data)), SLICE):
        part = data[low : low + SLICE + length - 1]
        yield low, part, Pieces(part, np.clip(first - low, 0, len(part)), length, gram)


def anchors(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """The anchors of each text (row_, text), each once in a slice."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text", SLICE):
                row = part.column("row_").to_numpy(zero_copy_only=False)
                seen: dict[int, np.ndarray] = {}
                for _, _, cut in sliced(*text_bytes(part.column("text")), length, gram):
                    order = np.lexsort((cut.anchor, cut.text))
                    anchor, text = cut.anchor[order], cut.text[order]
                    new = np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]))[: len(anchor)]
                    anchor, text = anchor[new], text[new]
                    if len(text):  # a text may reach over the end of a slice
                        last = int(text[-1])
                        again = (text == text[0]) & np.isin(anchor, seen.get(int(text[0]), anchor[:0]))
                        ours = np.concatenate([seen.get(last, anchor[:0]), anchor[text == last]])
                        anchor, text, seen = anchor[~again], text[~again], {last: ours}
                    yield pa.RecordBatch.from_arrays([pa.array(row[text]), pa.array(anchor.view(np.int64))], ["row_", "anchor"])

    return texts.select("row_", "text").mapInArrow(found, "row_ long, anchor long")


def pieces(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """Pieces of texts (row_, doc_id, text and, where given, the list ``wanted`` of anchors whose pieces are meant)."""
    listed = "wanted" in texts.columns

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text", SLICE):
                data, first = text_bytes(part.column("text"))
                for low, held, cut in sliced(data, first, length, gram):
                    keep = np.ones(len(cut.text), bool)
                    if listed:
                        for text in np.unique(cut.text):
                            mine = slice(*np.searchsorted(cut.text, [text, text + 1]))
                            keep[mine] = np.isin(cut.anchor[mine].view(np.int64), np.asarray(part.column("wanted")[int(text)].values))
                    text, begin, n = cut.text[keep], cut.begin[keep], cut.n[keep]
                    size = n + length - 1
                    offsets = np.append(0, np.cumsum(size))
                    taken = np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], size)
                    texts_of = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(held[taken])])
                    rows = pa.array(text)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("row_").take(rows), part.column("doc_id").take(rows), pa.array(cut.anchor[keep].view(np.int64)),
                         pa.array(cut.digest[keep].view(np.int64)), pa.array(begin + low - first[text]), pa.array(n.astype(np.int32)),
                         pa.array(cut.lead[keep].astype(np.int32)), texts_of],
                        [c.split()[0] for c in PIECE.split(", ")],
                    )

    return texts.mapInArrow(found, PIECE)


def firsts_in_order(texts: list[bytes], leads: list[int], ids: np.ndarray, length: int, gram: int) -> list[np.ndarray]:
    """For each string of each piece the smallest of ``ids`` among the pieces that hold it, from one suffix order.

    The anchor is a symbol of its own, so that strings of pieces with other anchors are never equal.
    """
    count, span = len(texts), length - gram + 1
    cores: dict[bytes, int] = {}
    parts, starts, at = [], [], 0
    for i, (text, lead) in enumerate(zip(texts, leads, strict=True)):
        core = cores.setdefault(text[lead : lead + gram], len(cores))
        around = np.frombuffer(text[:lead] + text[lead + gram :], np.uint8).astype(np.int64) + count
        parts += [around[:lead], [count + 256 + core], around[lead:], [count - 1 - i]]
        starts.append(np.arange(at, at + len(text) - length + 1))
        at += len(around) + 2
    symbols = np.concatenate(parts)
    begins = np.concatenate(starts)
    owner = np.full(len(symbols), -1)
    owner[begins] = np.repeat(np.arange(count), [len(s) for s in starts])
    order = suffix_order(symbols)
    order = order[owner[order] >= 0]
    equal = np.ones(len(order) - 1, bool)
    for k in range(span):
        live = np.flatnonzero(equal)
        equal[live] = symbols[order[live] + k] == symbols[order[live + 1] + k]
    group = np.append(0, np.cumsum(~equal))
    least = np.minimum.reduceat(ids[owner[order]], np.flatnonzero(np.append(True, ~equal)))
    result = np.zeros(len(symbols), np.int64)
    result[order] = least[group]
    return [result[s] for s in starts]


def ordered(groups: DataFrame, length: int, gram: int) -> DataFrame:
    """Strings of pieces that a piece with a smaller id holds, as bits: anchor, digest, bits. ``groups`` hold the pieces
    (digest, lead, doc_id, piece) of an anchor."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        symbols = 0
        for batch in batches:
            for i, anchor in enumerate(batch.column("anchor").to_pylist()):
                mine = batch.column("pieces")[i].as_py()
                held += [(anchor, p["digest"], p["lead"], p["doc_id"], p["piece"]) for p in mine]
                symbols += sum(len(p["piece"]) - gram + 2 for p in mine)
                if symbols >= SYMBOLS:
                    yield flagged(held)
                    held, symbols = [], 0
        if held:
            yield flagged(held)

    def flagged(held: list[tuple]) -> pa.RecordBatch:
        anchor, digest, leads, ids, texts = zip(*held, strict=True)
        from_, until = shared_range(anchor, texts, length)
        some = np.flatnonzero(until > from_).tolist()
        found = []
        if some:
            parts = [texts[i][from_[i] : until[i] + length - 1] for i in some]
            least = firsts_in_order(parts, [leads[i] - int(from_[i]) for i in some], np.array([ids[i] for i in some], np.int64), length, gram)
            for i, first in zip(some, least, strict=True):
                bits = int(((first < ids[i]).astype(np.int64) << np.arange(from_[i], until[i])).sum())
                if bits:
                    found.append((anchor[i], digest[i], bits))
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(3)], ["anchor", "digest", "bits"])

    return groups.select("anchor", "pieces").mapInArrow(found, "anchor long, digest long, bits long")


def shared_range(anchors: tuple[int, ...], texts: tuple[bytes, ...], length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each piece the first of its strings that may be in another piece of its anchor, by hash, and the one after the
    last. What is outside needs no place in the order."""
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    count = sizes - length + 1
    piece = np.repeat(np.arange(len(texts)), count)
    place = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
    begin = (ends - sizes)[piece] + place
    data = np.frombuffer(b"".join(texts), np.uint8)
    key = mix(Rolling(data).of(begin, begin + length) ^ mix(np.array(anchors, np.int64).view(np.uint64))[piece])
    order = np.lexsort((piece, key))
    key, owner = key[order], piece[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    last = np.append(first[1:], len(key)) - 1
    several = np.repeat(owner[first] != owner[last], last - first + 1)
    owner, at = owner[several], place[order][several]
    from_, until = sizes.copy(), np.zeros(len(texts), np.int64)
    np.minimum.at(from_, owner, at)
    np.maximum.at(until, owner, at + 1)
    return from_, until


def halved(parts: DataFrame, length: int, gram: int) -> DataFrame:
    """Pieces (anchor, digest, lead, doc_id, piece) of which the strings with ``low`` to ``high`` - 1 bytes before the anchor are
    meant, cut in two by that number, with the bytes all strings of a half have around the anchor as ``key``, the ``part`` of
    the piece that holds them, its ``mark``, its first string ``at``, number of strings ``n`` and bytes before the anchor ``into``."""
    middle = F.expr("(low + high + 1) div 2").cast("int")
    cut = parts.select(
        "anchor", "digest", "lead", "doc_id", "piece",
        F.explode(F.array(F.struct("low", middle.alias("high")), F.struct(middle.alias("low"), "high"))).alias("half"),
    ).select("anchor", "digest", "lead", "doc_id", "piece", "half.low", "half.high")
    last, first = F.least(F.col("high") - 1, "lead"), F.greatest("low", F.col("lead") - F.octet_length("piece") + length)
    core = F.substring(F.col("piece"), F.col("lead") - F.col("low") + 1, F.col("low") - F.col("high") + 1 + length)
    sized = cut.withColumns({"into": last, "n": last - first + 1}).filter("n > 0").withColumn("at", F.expr("lead - into"))
    part = F.substring(F.col("piece"), F.col("at") + 1, F.col("n") + length - 1)
    return sized.withColumns({"key": F.xxhash64("low", "high", core), "part": part}).withColumn("mark", F.xxhash64("into", "part"))


def divided(strings: DataFrame, length: int, gram: int, together: int, few: int) -> DataFrame:
    """The same for pieces (anchor, digest, lead, doc_id, piece) of anchors that have too many: the strings of a piece are
    halved by their place around the anchor, and halves that agree in the bytes all their strings hold meet, equal ones as one.
    Those that are still too many are halved again; a half of one string meets only its like."""
    found = []
    parts = strings.select("anchor", "digest", "lead", "doc_id", "piece", F.lit(0).alias("low"), F.lit(length - gram + 1).alias("high"))
    while True:
        parts = stage(halved(parts, length, gram), "parts", "zstd")
        distinct = stage(parts.groupBy("key", "mark", "into", "part").agg(F.min("doc_id").alias("least")), "halves", "zstd")
        sizes = stage(distinct.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
        some, many = (few_or_all(sizes.filter(c).select("key"), few) for c in (F.col("n") <= together, F.col("n") > together))
        groups = distinct.join(some, "key").groupBy(F.col("key").alias("anchor")).agg(
            F.collect_list(F.struct(F.col("mark").alias("digest"), F.col("into").alias("lead"), F.col("least").alias("doc_id"), F.col("part").alias("piece"))).alias("pieces")
        )
        bits = stage(ordered(groups, length, gram).select(F.col("anchor").alias("key"), F.col("digest").alias("mark"), "bits"), "bits")
        known = distinct.select("key", "mark", "least").join(bits, ["key", "mark"], "left")
        bits = repeated_bits(parts.join(many, "key", "left_anti").join(known, ["key", "mark"]))
        found.append(stage(bits.select("anchor", "digest", F.call_function("shiftleft", "bits", "at").alias("bits")).filter("bits != 0"), "bits"))
        if many.isEmpty():
            break
        parts = parts.join(many, "key", "left_semi").select("anchor", "digest", "lead", "doc_id", "piece", "low", "high")
    return reduce(DataFrame.union, found).groupBy("anchor", "digest").agg(F.bit_or("bits").alias("bits"))


def repeated_bits(occurs: DataFrame) -> DataFrame:
    """``occurs`` (doc_id, n, least, bits) with all strings in ``bits`` where an equal piece has a smaller id, ``least``."""
    whole = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("n")) - 1
    return occurs.withColumn("bits", F.when(F.col("doc_id") > F.col("least"), whole).otherwise(F.coalesce(F.col("bits"), F.lit(0))))


def repeated_pieces(texts: DataFrame, length: int, gram: int, together: int, few: int) -> DataFrame:
    """Pieces with strings that a document of a smaller id holds: row_, begin, bits. ``texts``: row_, doc_id, text."""
    found = anchors(texts, length, gram)
    shared = stage(found.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "anchors")
    if shared.count() <= few:
        held = pieces(texts, length, gram).join(F.broadcast(shared), "anchor", "left_semi")
    else:  # anchors meet as numbers, and only texts with shared ones are moved
        wanted = found.join(shared, "anchor", "left_semi").groupBy("row_").agg(F.collect_list("anchor").alias("wanted"))
        held = pieces(texts.join(wanted, "row_").select("row_", "doc_id", "text", "wanted"), length, gram)
    held = stage(held.select([c.split()[0] for c in PIECE.split(", ")]), "occurrences", "zstd")

    strings = stage(held.groupBy("anchor", "digest", "lead", "piece").agg(F.min("doc_id").alias("doc_id")), "strings", "zstd")
    sizes = stage(strings.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    some, many = sizes.filter(F.col("n") <= together).select("anchor"), sizes.filter(F.col("n") > together).select("anchor")
    groups = strings.join(few_or_all(some, few), "anchor").groupBy("anchor").agg(F.collect_list(F.struct("digest", "lead", "doc_id", "piece")).alias("pieces"))
    bits = ordered(groups, length, gram)
    if not many.isEmpty():
        bits = bits.union(divided(strings.join(few_or_all(many, few), "anchor", "left_semi"), length, gram, together, few))
    bits = stage(bits, "bits")
    known = stage(strings.select("anchor", "digest", F.col("doc_id").alias("least")).join(bits, ["anchor", "digest"], "left"), "known")
    occurs = held.select("row_", "doc_id", "anchor", "digest", "begin", "n").join(known, ["anchor", "digest"])
    return repeated_bits(occurs).select("row_", "begin", "bits").filter("bits != 0")


def without_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, together: int = TOGETHER, few: int = BROADCAST_ANCHORS,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Every text without the bytes of strings that a document of a smaller id holds: doc_id, n_bytes, kept (bytes, which
    may have been cut inside a character) and spans, the removed stretches (begin and end in bytes, end exclusive)."""
    if length - gram + 1 > 62:
        raise ValueError("a string has at most 62 anchor places")
    rows = keyed(docs, doc_id=F.col(id_column).cast("long"), text=F.coalesce(F.col(text_column).cast("string"), F.lit("")))
    marks = stage(rows.select("row_", "doc_id", F.unhex(F.md5("text")).alias("digest"), F.octet_length("text").alias("size")), "marks")
    # texts that are equal as a whole: those with the smallest id stand for all
    least = stage(marks.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most"), "least")
    copies = marks.filter(F.col("size") >= length).join(few_or_all(least.select("digest", "least")), "digest").filter("doc_id > least")
    copies = stage(copies.select("row_"), "copies")
    texts = rows.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length)).join(few_or_all(copies), "row_", "left_anti")
    found = stage(repeated_pieces(texts.select("row_", "doc_id", "text"), length, gram, together, few), "repeated")
    spans = found.groupBy("row_").agg(F.collect_list(F.struct("begin", "bits")).alias("found"))
    touched = few_or_all(stage(found.select("row_").distinct(), "touched"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                data, first = text_bytes(part.column("text"))
                kept, removed = [], []
                for i in range(part.num_rows):
                    text = data[first[i] : first[i + 1]]
                    entries = part.column("found")[i].values
                    spans = stretches(np.asarray(entries.field("begin")), np.asarray(entries.field("bits")), len(text), length)
                    gone = np.zeros(len(text) + 1, np.int64)
                    for begin, end in spans:
                        gone[begin] += 1
                        gone[end] -= 1
                    kept.append(text[np.cumsum(gone[:-1]) == 0].tobytes())
                    removed.append([{"begin": b, "end": e} for b, e in spans])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(first)), pa.array(kept, pa.binary()),
                     pa.array(removed, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))],
                    ["doc_id", "n_bytes", "kept", "spans"],
                )

    partly = rows.join(touched, "row_", "left_semi").join(spans, "row_").select("doc_id", "text", "found")
    partly = partly.mapInArrow(cut, "doc_id long, n_bytes long, kept binary, spans array<struct<begin: bigint, end: bigint>>")
    size = F.octet_length("text").cast("long")
    gone = F.array(F.struct(F.lit(0).cast("long").alias("begin"), size.alias("end")))
    whole = rows.join(touched, "row_", "left_anti").join(few_or_all(copies).withColumn("copy", F.lit(True)), "row_", "left").select(
        "doc_id", size.alias("n_bytes"), F.when(F.col("copy"), F.lit(b"")).otherwise(F.encode("text", "UTF-8")).alias("kept"),
        F.when(F.col("copy"), gone).otherwise(F.array().cast("array<struct<begin: bigint, end: bigint>>")).alias("spans"),
    )
    return partly.union(whole)


def stretches(begin: np.ndarray, bits: np.ndarray, size: int, length: int) -> list[tuple[int, int]]:
    """Maximal stretches covered by strings of ``length``: those at ``begin`` + k for each bit k."""
    starts = np.zeros(size + 1, bool)
    for k in range(int(bits.max()).bit_length()):
        starts[begin[(bits >> k) & 1 == 1] + k] = True
    edge = np.zeros(size + 1, np.int64)
    at = np.flatnonzero(starts)
    edge[at] += 1
    edge[at + length] -= 1
    inside = np.concatenate([[False], np.cumsum(edge)[:size] > 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
