"""Fill-in-the-middle: texts cut at two unit boundaries and put together again in another order.

The ends of a text's units are a ``BoundarySet``: the upper bits of an offset choose a container, whose lower 16 bits are
kept as a sorted array, a bitmap or runs, whichever is smallest. The containers' cumulative cardinalities say which
container holds the k-th boundary, and a select inside that container says where it is; both cut offsets come from there.

The draws of a row depend on its id and the seed alone. Null and empty texts, and texts that hold a sentinel, stay plain.
A null id draws like an id without digits; repeated rows are each treated alike. Columns beside the id and the text are
not read. A text of any length is taken whole, in a step of its own if it is long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import steps, text_bytes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
#: Percent of the texts that are cut, and percent of those that get the suffix first.
CUT_PERCENT, SUFFIX_FIRST_PERCENT = 100, 50
#: Most values that a container keeps as an array: as many take the space of a bitmap.
ARRAY_MOST = 4096
CONTAINER = 1 << 16

RESULT = "doc_id {id}, n long, form string, prefix_chars long, middle_chars long, output string"


class Array:
    """Sorted lower bits."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.low[k])


class Bitmap:
    """One bit for each of the 65,536 values, with the number of set bits before each word."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(CONTAINER, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        word = np.unpackbits(self.words[at : at + 1].view(np.uint8), bitorder="little")
        return at * 64 + int(np.flatnonzero(word)[k - int(self.before[at])])


class Runs:
    """Starts of runs of consecutive values and the number of values before each."""

    def __init__(self, starts: np.ndarray, before: np.ndarray):
        self.starts, self.before = starts.astype(np.uint16), before.astype(np.int32)

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.starts[at]) + k - int(self.before[at])


def container(low: np.ndarray) -> Array | Bitmap | Runs:
    """The smallest of the three forms for sorted values below 65,536."""
    first = np.flatnonzero(np.append(True, np.diff(low) != 1))
    if 2 * len(first) < min(len(low), ARRAY_MOST):
        return Runs(low[first], first)
    return Array(low) if len(low) <= ARRAY_MOST else Bitmap(low)


class BoundarySet:
    """A set of offsets that answers which is the k-th."""

    def __init__(self, offsets: np.ndarray):
        """``offsets`` are sorted and distinct."""
        high = offsets // CONTAINER
        first = np.flatnonzero(np.diff(high, prepend=-1))
        self.keys = high[first]
        self.cumulative = np.append(first, len(offsets))
        self.containers = [container(offsets[i:j] % CONTAINER) for i, j in zip(self.cumulative, self.cumulative[1:], strict=False)]

    def __len__(self) -> int:
        return int(self.cumulative[-1])

    def select(self, k: int) -> int:
        """The k-th offset, from 0."""
        at = int(np.searchsorted(self.cumulative, k, side="right")) - 1
        return int(self.keys[at]) * CONTAINER + self.containers[at].select(k - int(self.cumulative[at]))


def line_ends(text: np.ndarray) -> np.ndarray:
    """Byte offsets after each line of a text; what follows the last line feed is a line if it isn't empty."""
    ends = np.flatnonzero(text == 10) + 1
    return np.append(ends, len(text)) if len(text) and (not len(ends) or ends[-1] < len(text)) else ends


def character_ends(text: np.ndarray) -> np.ndarray:
    """Byte offsets after each code point."""
    starts = np.flatnonzero((text & 0xC0) != 0x80)
    return np.append(starts[1:], len(text)) if len(text) else starts


UNITS = {"line": line_ends, "character": character_ends}


def characters(text: np.ndarray) -> int:
    return int(np.count_nonzero((text & 0xC0) != 0x80))


def draws(seed: int, doc_id) -> list[int]:
    """Four numbers below 2^32 for a row."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def rearranged(text: np.ndarray, doc_id, seed: int, cut_percent: int, suffix_first_percent: int, unit: str) -> tuple:
    """Number of units, form, characters of prefix and middle, and output of one text."""
    raw = text.tobytes()
    boundaries = BoundarySet(UNITS[unit](text))
    n = len(boundaries)
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not raw or h3 % 100 >= cut_percent or any(s.encode() in raw for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, raw
    cuts = [0 if k == 0 else boundaries.select(k - 1) for k in sorted((h1 % (n + 1), h2 % (n + 1)))]
    prefix, middle, suffix = raw[: cuts[0]], raw[cuts[0] : cuts[1]], raw[cuts[1] :]
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    form, output = ("spm", s + suffix + p + prefix + m + middle) if h4 % 100 < suffix_first_percent else ("psm", p + prefix + s + suffix + m + middle)
    return n, form, characters(text[: cuts[0]]), characters(text[cuts[0] : cuts[1]]), output


def fill_in_middle(
    docs: DataFrame, seed: int = SEED, cut_percent: int = CUT_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT,
    unit: str = "line", id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """doc_id, number of units, form (plain, psm or spm), characters of prefix and middle (null if plain), and output."""
    kind = dict(docs.select(F.col(id_column).alias("doc_id")).dtypes)["doc_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("n", "form", "prefix_chars", "middle_chars", "output")
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        for batch in batches:
            for part in steps(batch, "text"):
                data, first = text_bytes(part.column("text"))
                ids = part.column("doc_id").to_pylist()
                done = [
                    rearranged(data[i:j], doc_id, seed, cut_percent, suffix_first_percent, unit)
                    for doc_id, i, j in zip(ids, first, first[1:], strict=False)
                ]
                columns = [pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)]
                columns[-1] = columns[-1].view(pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", *names])

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(cut, RESULT.format(id=kind))


def restored(output: F.Column, form: F.Column) -> F.Column:
    """The text that was cut, from output and form. No text that was cut holds a sentinel."""
    parts = F.split(output, "<[PSM]>", -1)
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
