"""SentencePiece encoding and decoding of whole corpora, giant documents in parallel.

The ids are those of the library's own encoder for a BPE model with byte fallback. Such an encoding is the one path
through the pieces of a text on which each piece may follow the one before it: the two, joined and encoded again, stay
as they are. In the max-plus algebra a step has weight 0 if it may be taken and minus infinity if not. A document longer
than ``CHUNK`` characters is split; each chunk yields the matrix of what leads from a state at its start, the piece that
reaches over the boundary, to the states at its end; matrices are combined associatively, which fixes the state at
each boundary, and each chunk is traced back on its own. Pieces never reach over the start of a word, so that there
the matrix has a single state, and chunks are cut at such places where they have one; words are encoded once per task.

A null text has null ids and an empty text none. Decoding gives back every text exactly, but for U+2581, which the
library reads as a space. Repeated rows are encoded each. Columns beside the id and the text are not read.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import keyed, stage, steps

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of a chunk, words a task remembers, and the mark of a word's start.
CHUNK, KNOWN, MARK = 32_768, 200_000, "▁"
#: Bytes of texts that are encoded at once.
TOGETHER = 1 << 20
#: Widths of the tables in which short words are encoded together, and characters from which a word is encoded as a path.
SHORT, LONG = (6, 12, 24), 200
#: Short words in a table.
ROWS = 8192
#: Words with their marks; a line end is never part of a longer piece.
WORD = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
START = re.compile(f"(?<![{MARK}]){MARK}|(?<=\n).|\n", re.S)


def read_pieces(model: bytes) -> list[tuple[str, float, int]]:
    """Piece, score and type of each id, read from a serialized model (field 1, with fields 1, 2 and 3)."""

    def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
        at = 0

        def number() -> int:
            nonlocal at
            value = shift = 0
            while True:
                byte = data[at]
                at += 1
                value |= (byte & 127) << shift
                shift += 7
                if byte < 128:
                    return value

        while at < len(data):
            key = number()
            if key & 7 == 0:
                yield key >> 3, number()
            else:
                size = {1: 8, 5: 4}.get(key & 7) or number()
                yield key >> 3, data[at : at + size]
                at += size

    out = []
    for field, value in fields(model):
        if field == 1:
            entry = dict(fields(value))
            out.append((entry[1].decode(), float(np.frombuffer(entry.get(2, b"\0\0\0\0"), "<f4")[0]), entry.get(3, 1)))
    return out


class Pieces:
    """A vocabulary: ids and scores of ordinary pieces, ids of bytes."""

    def __init__(self, model: bytes):
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes: dict[int, int] = {}
        self.raw: list[bytes] = []
        for i, (piece, score, kind) in enumerate(read_pieces(model)):
            if kind == 6:
                self.bytes[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif kind in (1, 4):
                self.ids[piece], self.scores[piece] = i, score
                self.raw.append(piece.replace(MARK, " ").encode())
            else:
                self.raw.append(b"")
        self.longest = max(map(len, self.ids))
        letters = [(ord(p), i) for p, i in self.ids.items() if len(p) == 1]
        self.letter = np.full(0x110000, -1, np.int32)
        self.letter[[c for c, _ in letters]] = [i for _, i in letters]
        # two pieces that make a third, by a key of both
        joins = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    joins[a << 32 | b] = (i, self.scores[p])
        self.join_keys = np.array(sorted(joins), np.int64)
        self.join_ids = np.array([joins[k][0] for k in self.join_keys.tolist()] + [-1], np.int32)
        self.join_scores = np.array([joins[k][1] for k in self.join_keys.tolist()] + [-np.inf], np.float32)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known: dict[str, int] = {}
        self.forget()

    def forget(self) -> None:
        self.known.clear()
        self.pairs.clear()
        self.coded, self.begin = array("i"), array("q", [0])

    def merged(self, word: str) -> list[str]:
        """Pieces of a word: the best-scored neighbours are joined, leftmost first, while they make a piece."""
        parts, score, none = list(word), self.scores.get, float("-inf")
        values = [score(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while values and (best := max(values)) > none:
            at = values.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del values[at]
            if at:
                values[at - 1] = score(parts[at - 1] + parts[at], none)
            if at < len(values):
                values[at] = score(parts[at] + parts[at + 1], none)
        return parts

    def joined(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id and score of what pieces make with their neighbours; minus infinity if nothing."""
        key = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.join_keys, key)
        at[at == len(self.join_keys)] = 0
        at = np.where((self.join_keys[at] == key) & (a >= 0) & (b >= 0), at, len(self.join_keys))
        return self.join_ids[at], self.join_scores[at]

    def merged_rows(self, ids: np.ndarray) -> np.ndarray:
        """As ``merged`` for many short words at once: a row of letters each, filled up with -1."""
        out = ids.copy()
        row, width = np.arange(len(ids)), ids.shape[1]
        made, score = self.joined(ids[:, :-1], ids[:, 1:])
        columns = np.arange(width)
        while len(row):
            at = score.argmax(axis=1)
            going = score[np.arange(len(row)), at] > -np.inf
            if not going.all():
                out[row[~going]] = ids[~going]
                row, ids, made, score, at = row[going], ids[going], made[going], score[going], at[going]
            if not len(row):
                break
            each = np.arange(len(row))
            new = made[each, at]
            source = np.minimum(columns + (columns > at[:, None]), width - 1)
            ids = np.take_along_axis(ids, source, 1)
            ids[:, -1] = -1
            ids[each, at] = new
            source = source[:, :-1].clip(max=width - 2)
            made, score = np.take_along_axis(made, source, 1), np.take_along_axis(score, source, 1)
            score[:, -1] = -np.inf
            right = np.where(at + 1 < width, ids[each, np.minimum(at + 1, width - 1)], -1)
            for place, (a, b) in ((at, (new, right)), (at - 1, (ids[each, np.maximum(at - 1, 0)], new))):
                fit = (place >= 0) & (place < width - 1)
                made[each[fit], place[fit]], score[each[fit], place[fit]] = self.joined(a[fit], b[fit])
        return out

    def learn(self, words: list[str]) -> None:
        """Remembers the ids of words, the short ones among them encoded together."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        letters = self.letter[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        first = np.cumsum(sizes) - sizes
        plain = np.minimum.reduceat(letters, first) >= 0 if len(words) else np.zeros(0, bool)
        low = 0
        for high in SHORT:
            chosen = np.flatnonzero(plain & (sizes > low) & (sizes <= high))
            low = high
            columns = np.arange(high)
            for start in range(0, len(chosen), ROWS):
                some = chosen[start : start + ROWS]
                inside = columns < sizes[some][:, None]
                rows = np.where(inside, letters[np.where(inside, first[some][:, None] + columns, 0)], -1)
                rows = self.merged_rows(rows)
                held = (rows >= 0).sum(axis=1)
                base = len(self.coded)
                self.coded.frombytes(rows[rows >= 0].astype(np.int32).tobytes())
                count = len(self.begin) - 1
                self.begin.frombytes((base + np.cumsum(held)).astype(np.int64).tobytes())
                self.known.update(zip((words[i] for i in some.tolist()), range(count, count + len(some)), strict=True))
        for i in np.flatnonzero(~plain | (sizes > low)).tolist():
            word = words[i]
            self.known[word] = len(self.begin) - 1
            self.coded.extend(self.numbers(self.merged(word) if len(word) < LONG else self.merged_long(word)))
            self.begin.append(len(self.coded))

    def numbers(self, parts: list[str]) -> list[int]:
        out = []
        for part in parts:
            if part in self.ids:
                out.append(self.ids[part])
            else:
                out += [self.bytes[b] for b in part.encode()]
        return out

    def may_follow(self, a: str | None, b: str) -> bool:
        """Whether piece ``b`` can stand after ``a``: weight 0 if so, else minus infinity."""
        if a is None:
            return True
        if (a, b) not in self.pairs:
            if len(self.pairs) > 5 * KNOWN:
                self.pairs.clear()
            self.pairs[a, b] = self.merged(a + b) == [a, b]
        return self.pairs[a, b]

    def paths(self, text: str, begin: int, piece: str | None, ahead: str) -> dict[int, str]:
        """The last piece of the path from ``piece``, which ends at ``begin``, to each place that one leads to."""
        whole = text + ahead
        last: dict[int, str | None] = {begin: piece}
        for end in range(begin + 1, len(whole) + 1):
            for size in range(1, min(self.longest, end - begin) + 1):
                start = end - size
                if start >= len(text) or start not in last:
                    continue
                candidate = whole[start:end]
                if (size == 1 or candidate in self.ids) and self.may_follow(last[start], candidate):
                    last[end] = candidate
                    break
        return last

    def states(self, behind: str, text: str) -> list[tuple[int, str]]:
        """What may reach over the start of ``text``: how far, and the piece."""
        found = []
        for back in range(1, min(self.longest, len(behind)) + 1):
            for over in range(min(self.longest - back, len(text)) + 1):
                piece = behind[-back:] + text[:over]
                if piece in self.ids or (back == 1 and not over):
                    found.append((over, piece))
        return found

    def matrix(self, behind: str, text: str, ahead: str, cut_before: bool, cut_after: bool) -> list[tuple]:
        """Pairs (entry state, exit state) of weight 0 of a chunk; a word's start is state (0, None)."""
        out = []
        for begin, piece in self.states(behind, text) if cut_before else [(0, None)]:
            last = self.paths(text, begin, piece, ahead if cut_after else "")
            if cut_after:
                out += [((begin, piece), (end - len(text), last[end])) for end in last if end >= len(text)]
            elif len(text) in last:
                out.append(((begin, piece), (0, None)))
        return out

    def traced(self, text: str, ahead: str, entry: tuple, end: tuple, cut_after: bool) -> list[int]:
        """Ids of the pieces of a chunk from a state at its start to one at its end."""
        last = self.paths(text, entry[0], entry[1], ahead if cut_after else "")
        parts, at = [], len(text) + end[0]
        while at > entry[0]:
            parts.append(last[at])
            at -= len(last[at])
        return self.numbers(parts[::-1])

    def encoded(self, marked: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that are cut at words, one after the other, and where each text begins."""
        if len(self.known) > KNOWN:
            self.forget()
        words = [WORD.findall(text) for text in marked]
        self.learn(list(set().union(*words).difference(self.known)))
        counts, index = [len(w) for w in words], []
        for each in words:
            index += map(self.known.__getitem__, each)
        flat, first, index = np.array(self.coded, np.int32), np.array(self.begin, np.int64), np.array(index, np.int64)
        held = (first[1:] - first[:-1])[index]
        at = np.repeat(first[index] - (np.cumsum(held) - held), held) + np.arange(held.sum())
        per_text = np.add.reduceat(np.append(held, 0), np.cumsum([0, *counts])[:-1]) * (np.array(counts) > 0) if counts else np.zeros(0, np.int64)
        return flat[at], np.concatenate([[0], np.cumsum(per_text)]).astype(np.int64)

    def merged_long(self, word: str) -> list[str]:
        """As ``merged`` in linear time: the path of pieces that may follow each other."""
        last, parts, at = self.paths(word, 0, None, ""), [], len(word)
        while at:
            parts.append(last[at])
            at -= len(last[at])
        return parts[::-1]

    def decoded(self, ids) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def marked(text: str) -> str:
    """A text as the pieces see it: a mark for each space and one before the text."""
    return (MARK + text).replace(" ", MARK) if text else ""


def chunks_of(text: str, size: int, reach: int) -> list[dict]:
    """Chunks of a marked text: cut at the last word start in the second half of a chunk, or anywhere if there's none."""
    out, begin, cut_before = [], 0, False
    while begin < len(text):
        end, cut_after = len(text), False
        if len(text) - begin > size:
            starts = [m.start() for m in START.finditer(text, begin + size // 2, begin + size)]
            end, cut_after = (starts[-1], False) if starts else (begin + size, True)
        out.append({"text": text[begin:end], "behind": text[max(0, begin - reach) : begin], "ahead": text[end : end + reach], "cut_before": cut_before, "cut_after": cut_after})
        begin, cut_before = end, cut_after
    return out


def combined(a: list[tuple], b: list[tuple]) -> list[tuple]:
    """The max-plus product of two matrices of weights 0: what leads through both."""
    by_entry: dict[tuple, list[tuple]] = {}
    for entry, end in b:
        by_entry.setdefault(entry, []).append(end)
    return sorted({(entry, end) for entry, middle in a for end in by_entry.get(middle, ())}, key=repr)


def boundary_states(matrices: list[list[tuple]], entry: tuple, end: tuple) -> list[tuple]:
    """States at the inner boundaries of the path from ``entry`` to ``end``: halves are combined, then split again."""
    if len(matrices) == 1:
        return []
    half = len(matrices) // 2
    left, right = (product(m) for m in (matrices[:half], matrices[half:]))
    after = {e for e, x in right if x == end}
    middle = next(x for e, x in left if e == entry and x in after)
    return [*boundary_states(matrices[:half], entry, middle), middle, *boundary_states(matrices[half:], middle, end)]


def product(matrices: list[list[tuple]]) -> list[tuple]:
    if len(matrices) == 1:
        return matrices[0]
    half = len(matrices) // 2
    return combined(product(matrices[:half]), product(matrices[half:]))


STATE = "struct<over:int,piece:string>"


def one_by_one(batch: pa.RecordBatch, *columns: str) -> Iterator[pa.RecordBatch]:
    """Rows of a batch of long texts, each on its own: as Python values an id takes ten times the bytes it has here."""
    chosen = batch.select(list(columns)) if columns else batch
    return (chosen.slice(i, 1) for i in range(chosen.num_rows))


def values_of(row: pa.RecordBatch) -> list:
    return [column[0].as_py() for column in row.columns]


def tidy(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``task``, and what Arrow keeps of its batches goes back to the system at the end: a worker stays beside those of later tasks."""

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        pa.default_memory_pool().release_unused()

    return done


def encode(
    docs: DataFrame, model_path: str = TOKENIZER, chunk: int = CHUNK, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, n_chunks, ids and ``round_trip`` (whether decoding gives the text back) of every row."""
    with open(model_path, "rb") as f:  # the file goes to the tasks with their code
        model = f.read()
    rows = keyed(docs, doc_id=id_column, text=text_column)
    kind = dict(rows.dtypes)["doc_id"]
    giant = F.coalesce(F.char_length("text"), F.lit(0)) > chunk

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        for batch in batches:
            for part in steps(batch, "text", TOGETHER):
                texts = part.column("text").to_pylist()
                ids, first = pieces.encoded([marked(t or "") for t in texts])
                offsets = pa.array(first.astype(np.int32), mask=np.array([t is None for t in texts] + [False]))
                same = [None if t is None else pieces.decoded(ids[a:b].tolist()) == t.replace(MARK, " ") for t, a, b in zip(texts, first, first[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([1] * len(texts), pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.array(same, pa.bool_())],
                    ["doc_id", "n_chunks", "ids", "round_trip"],
                )

    result = f"doc_id {kind}, n_chunks int, ids array<int>, round_trip boolean"
    short = rows.filter(~giant).select("doc_id", "text").mapInArrow(tidy(whole), result)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = Pieces(model).longest - 1
        for batch in batches:
            for row_, text in map(values_of, one_by_one(batch, "row_", "text")):
                parts = chunks_of(marked(text), chunk, reach)
                yield pa.RecordBatch.from_pylist([{"row_": row_, "n": i, **p} for i, p in enumerate(parts)], schema=pa.schema(
                    [("row_", pa.int64()), ("n", pa.int32())] + [(c, pa.string()) for c in ("text", "behind", "ahead")] + [(c, pa.bool_()) for c in ("cut_before", "cut_after")]
                ))

    long_rows = rows.filter(giant)
    parts = stage(
        long_rows.select("row_", "text").mapInArrow(tidy(split), "row_ long, n int, text string, behind string, ahead string, cut_before boolean, cut_after boolean"),
        "chunks",
    )
    cut = parts.filter("cut_before OR cut_after")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        state = pa.struct([("over", pa.int32()), ("piece", pa.string())])
        for batch in batches:
            for p in (part.to_pylist()[0] for part in one_by_one(batch)):
                found = pieces.matrix(p["behind"], p["text"], p["ahead"], p["cut_before"], p["cut_after"])
                steps = pa.array([[{"entry": dict(zip(("over", "piece"), a, strict=True)), "end": dict(zip(("over", "piece"), b, strict=True))} for a, b in found]], pa.list_(pa.struct([("entry", state), ("end", state)])))
                yield pa.RecordBatch.from_arrays([pa.array([p["row_"]]), pa.array([p["n"]], pa.int32()), pa.array([p["cut_after"]]), steps], ["row_", "n", "cut_after", "steps"])

    def chosen(group: pd.DataFrame) -> pd.DataFrame:
        """States at both ends of each chunk of a document; its matrices are smaller than its text."""
        group = group.sort_values("n")
        out, run = [], []
        for n, cut_after, steps in zip(group["n"], group["cut_after"], group["steps"], strict=True):
            run.append((n, [tuple((s[k]["over"], s[k]["piece"]) for k in ("entry", "end")) for s in steps]))
            if not cut_after:
                inner = boundary_states([m for _, m in run], (0, None), (0, None))
                ends = [(0, None), *inner, (0, None)]
                out += [(k, *a, *b) for (k, _), a, b in zip(run, ends, ends[1:], strict=False)]
                run = []
        found = pd.DataFrame(out, columns=["n", "eo", "ep", "xo", "xp"])
        found.insert(0, "row_", group["row_"].iloc[0])
        return found

    stepped = cut.repartition("row_", "n").mapInArrow(tidy(matrices), f"row_ long, n int, cut_after boolean, steps array<struct<entry:{STATE},end:{STATE}>>")
    states = stepped.groupBy("row_").applyInPandas(chosen, "row_ long, n int, eo int, ep string, xo int, xp string")

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        for batch in batches:
            for p in (part.to_pylist()[0] for part in one_by_one(batch)):
                if p["cut_before"] or p["cut_after"]:
                    ids = pieces.traced(p["text"], p["ahead"], (p["eo"], p["ep"]), (p["xo"], p["xp"]), p["cut_after"])
                else:
                    ids = pieces.encoded([p["text"]])[0].tolist()
                yield pa.RecordBatch.from_arrays([pa.array([p["row_"]]), pa.array([p["n"]], pa.int32()), pa.array([ids], pa.list_(pa.int32()))], ["row_", "n", "ids"])

    coded = parts.join(states, ["row_", "n"], "left").repartition("row_", "n").mapInArrow(tidy(traced), "row_ long, n int, ids array<int>")
    joined = coded.groupBy("row_").agg(F.array_sort(F.collect_list(F.struct("n", "ids"))).alias("all")).select(
        "row_", F.size("all").alias("n_chunks"), F.flatten("all.ids").alias("ids")
    )

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        for batch in batches:
            same = [pieces.decoded(i) == t.replace(MARK, " ") for i, t in map(values_of, one_by_one(batch, "ids", "text"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_chunks", "ids")), pa.array(same)], ["doc_id", "n_chunks", "ids", "round_trip"])

    long = long_rows.join(joined, "row_").select("doc_id", "n_chunks", "ids", "text").mapInArrow(tidy(checked), result)
    return short.union(long)


def decode(coded: DataFrame, model_path: str = TOKENIZER, ids_column: str = "ids") -> DataFrame:
    """``coded`` with the text of its ids in ``decoded``; null for null."""
    with open(model_path, "rb") as f:
        model = f.read()

    @F.pandas_udf("string")
    def texts(column: pd.Series) -> pd.Series:
        pieces = Pieces(model)
        return pd.Series([None if ids is None else pieces.decoded(ids) for ids in column], dtype=object)

    return coded.withColumn("decoded", texts(F.col(ids_column)))
