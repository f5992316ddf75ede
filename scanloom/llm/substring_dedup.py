"""Near-duplicate passages inside documents by compact windows.

A document is its sequence of shingles of five words. For each of ``HASHES`` hash functions the Cartesian tree over the
hashed shingles gives compact windows: a node's subtree spans all subsequences of which that shingle is the minimum; it
is kept if it can hold a passage of ``WORDS`` words. Documents with windows of the same minimum may share a passage.
Each is paired with the shortest document of the group; the windows of a pair are joined as intervals, and where those of
``ENOUGH`` functions overlap in both documents the shingles of both are compared and the passages that agree returned.
Groups with members whose windows the passages found with the first document don't cover, as around a line that many
texts share, are divided by ``FURTHER`` minima of the passages inside the windows and paired again, round by round; what is
left after them is divided by all shingles of a passage, so that equal passages are found however many texts share a part
of them. Exact copies of a text take part once.

Null and empty texts, and those with fewer words than a passage, have none. A passage repeated within one text only is
not reported. Repeated rows and ids are documents of their own. Columns beside the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import Words, few_or_all, keyed, mix, stage, steps, text_bytes

#: Words of a shingle and of the shortest passage, similarity of passages, hash functions and how many must agree.
SHINGLE, WORDS, SIMILARITY, HASHES, ENOUGH = 5, 50, 0.8, 4, 2
#: Further minima that each round of dividing adds to the keys of open groups.
FURTHER = (1, 2, 4, 8)
STEP = 2 << 20
#: ``place``: number of the function, first shingle and further shingles of a window, in 4, 30 and 30 bits.
WINDOW = "key long, node long, standing long, place long"


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    count = len(values) - width + 1
    if count <= 0:
        return values[:0]
    full = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[: len(values)] = values
    blocks = full.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:count], before[width - 1 : width - 1 + count])


def compact_windows(values: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owner, minimum's place and extent (both ends inclusive) of the windows that hold ``width`` places.

    ``values`` are the hashes of all texts in a row, text i from ``first[i]``. Of equal hashes the leftmost is least.
    Nodes of the Cartesian tree that are the minimum of some run of ``width`` are found with a sliding minimum; only among
    those does the tree's stack have to run.
    """
    bits = np.uint64(24)
    ranked = (values >> bits << bits) | np.arange(len(values), dtype=np.uint64)
    low = sliding_minimum(ranked, width)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    starts = np.flatnonzero(owner[: len(low)] == owner[width - 1 :]) if len(low) else np.zeros(0, np.int64)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    place = (low[starts] & np.uint64((1 << 24) - 1)).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = place[1:] != place[:-1]
    at = np.flatnonzero(new)
    c, begin = place[at], starts[at]
    last = starts[np.append(at[1:], len(starts)) - 1]
    text = owner[c]
    l, r = begin.copy(), last + width - 1
    # a run that starts or ends at the minimum itself may be cut short: the next lower node of the tree bounds it
    before, after = first[text], first[text + 1] - 1
    stack: list[int] = []
    weight, owners, places = ranked[c].tolist(), text.tolist(), c.tolist()
    left, right = before.tolist(), after.tolist()
    for i, w in enumerate(weight):
        if stack and owners[stack[-1]] != owners[i]:
            stack.clear()
        while stack and weight[stack[-1]] > w:
            right[stack.pop()] = places[i] - 1
        if stack:
            left[i] = places[stack[-1]] + 1
        stack.append(i)
    l = np.where(begin == c - width + 1, np.array(left), l)
    r = np.where(last == c, np.array(right), r)
    return text, c, l, r


def hashed(values: np.ndarray, fn: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(values ^ mix(np.full(1, fn + 1, np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def standing_of(node: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A number for each document that is smaller for one with fewer words."""
    return (np.minimum(words, (1 << 22) - 1).astype(np.int64) << 40) | (mix(node.astype(np.uint64)) >> np.uint64(24)).astype(np.int64)


def windows_of(docs: DataFrame, hashes: int, shingle: int, words: int) -> DataFrame:
    """Compact windows of ``docs`` (node, text).

    ``standing`` orders the members of a group: the one with the fewest words comes first.
    """
    width = words - shingle + 1

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text", STEP):
                split = Words(*text_bytes(part.column("text")))
                values, first = split.shingles(shingle)
                count = np.diff(split.first)
                node = part.column("node").to_numpy(zero_copy_only=False).astype(np.int64)
                standing = standing_of(node, count)
                for fn in range(hashes):
                    own = hashed(values, fn)
                    text, c, l, r = compact_windows(own, first, width)
                    most = (1 << 30) - 1
                    columns = {
                        "key": mix(own[c] + np.uint64(fn)).view(np.int64), "node": node[text], "standing": standing[text],
                        "place": np.minimum(l - first[text], most) << 30 | np.minimum(r - l, most) | np.int64(fn) << 60,
                    }
                    yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})

    return docs.mapInArrow(found, WINDOW)


def run_hash(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` values in their order."""
    count = len(values) - width + 1
    if count <= 0:
        return values[:0]
    out, block, size, at = np.zeros(count, np.uint64), values, 1, 0
    with np.errstate(over="ignore"):
        while size <= width:
            if width & size:
                out = mix(out * np.uint64(0xD6E8FEB86659FD93) + block[at : at + count])
                at += size
            block, size = mix(block[:-size] * np.uint64(0x9E3779B97F4A7C15) + block[size:]), size * 2
    return out


def first_least(values: np.ndarray, l: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of the leftmost minimum of each stretch ``l`` to ``r`` (inclusive) of ``values``."""
    size = r - l + 1
    out = np.zeros(len(l), np.int64)
    block = np.cumsum(size) // STEP
    for k in np.unique(block):
        some = np.flatnonzero(block == k)
        begin = np.cumsum(size[some]) - size[some]
        at = np.arange(size[some].sum()) + np.repeat(l[some] - begin, size[some])
        own = values[at]
        least = np.repeat(np.minimum.reduceat(own, begin), size[some])
        out[some] = np.minimum.reduceat(np.where(own == least, at, len(values)), begin)
    return out


def cut_windows(
    values: np.ndarray, keys: np.ndarray, fn: np.ndarray, l: np.ndarray, r: np.ndarray, width: int, hashes: int, used: int, further: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows ``l`` to ``r`` of shingles ``values`` as ``divided`` cuts them, all of a function at once: number of the window,
    new key, first shingle and further shingles of each part."""
    none = np.zeros(0, np.int64)
    rows: list[tuple] = [(none, none.view(np.uint64), none, none)]
    for f in np.unique(fn):
        mine = np.flatnonzero(fn == f)
        c = first_least(hashed(values, int(f)) >> np.uint64(24), l[mine], r[mine])
        # the passages of the window, by their first shingle: those that hold its minimum
        begin, last = np.maximum(l[mine], c - width + 1), np.minimum(c, r[mine] - width + 1)
        count = last - begin + 1
        start = np.cumsum(count) - count
        passage = np.arange(count.sum()) + np.repeat(begin - start, count)
        window = np.repeat(mine, count)
        # only shingles of these passages are hashed again; all of a passage stay side by side
        edges = np.bincount(begin, minlength=len(values) + 1) - np.bincount(last + width, minlength=len(values) + 1)
        held = np.cumsum(edges[:-1]) > 0
        shingles, place = values[held], (np.cumsum(held) - 1)[passage]
        if further:
            low = [sliding_minimum(hashed(shingles, hashes * (1 + used + j) + int(f)), width)[place] for j in range(further)]
            changed = np.zeros(len(passage), bool)
            changed[start] = True
            for least in low:
                changed[1:] |= least[1:] != least[:-1]
            at = np.flatnonzero(changed)
            until = np.append(at[1:], len(passage)) - 1
            new = keys[window[at]].view(np.uint64)
        else:
            low = [run_hash(shingles, width)[place]]
            at = until = np.arange(len(passage))
            new = np.zeros(len(passage), np.uint64)
        for j, least in enumerate(low):
            new = mix(mix(least[at] ^ new) + np.uint64(j + 1))
        rows.append((window[at], new, passage[at], until - at + width - 1))
    return tuple(np.concatenate(column) for column in zip(*rows, strict=True))


def divided(docs: DataFrame, open_windows: DataFrame, hashes: int, shingle: int, words: int, used: int, further: int) -> DataFrame:
    """``open_windows`` (key, node, place) cut where one of ``further`` new minima of the passages inside them changes,
    under the old key with those minima. ``used`` such functions have been taken before. Without ``further`` each passage
    is a window of its own under the hash of all its shingles."""
    width = words - shingle + 1

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text", STEP):
                split = Words(*text_bytes(part.column("text")))
                values, first = split.shingles(shingle)
                node = part.column("node").to_numpy(zero_copy_only=False).astype(np.int64)
                standing = standing_of(node, np.diff(split.first))
                lists = part.column("open")
                keys, places = (np.asarray(lists.flatten().field(k)) for k in (0, 1))
                owner = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(lists.offsets)))
                fn, l, r = parts_of(places)
                at, new, begin, length = cut_windows(values, keys, fn, l + first[owner], r + first[owner], width, hashes, used, further)
                owner = owner[at]
                place = begin - first[owner] << 30 | length | (fn[at] << 60 if further else np.int64(0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(new.view(np.int64)), pa.array(node[owner]), pa.array(standing[owner]), pa.array(place)],
                    ["key", "node", "standing", "place"],
                )

    lists = open_windows.groupBy("node").agg(F.collect_set(F.struct("key", "place")).alias("open"))
    rows = docs.join(lists, "node").select("node", "text", "open").mapInArrow(found, WINDOW)
    return rows if further else rows.distinct()


def led_pairs(windows: DataFrame) -> DataFrame:
    """Windows of the groups with more than one document beside the window of the group's first document: key, node,
    place, node_b, place_b; further windows of the first document are among them. Windows are moved once; a group is never
    held, its members pass by its first."""
    dealt = windows.filter("key IS NOT NULL").repartition("key")
    # the counts of the other columns keep both uses of the dealt rows alike, so that Spark deals them once
    groups = dealt.groupBy("key").agg(
        F.count("*").alias("n"), F.min("standing").alias("lead"), F.count("node").alias("nodes"), F.count("place").alias("places")
    ).filter("n > 1 AND nodes > 0 AND places > 0").select("key", "lead")
    held = stage(dealt.join(groups.hint("shuffle_hash"), "key"), "windows")
    first = held.filter("standing = lead").groupBy("key").agg(F.min(F.struct("node", "place")).alias("first"))
    first = first.select("key", F.col("first.node").alias("node_b"), F.col("first.place").alias("place_b"))
    return held.join(first, "key").filter("node != node_b OR place != place_b").select("key", "node", "place", "node_b", "place_b")


def parts_of(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Function, first and last shingle of windows."""
    begin = place >> 30 & (1 << 30) - 1
    return place >> 60 & 15, begin, begin + (place & (1 << 30) - 1)


def overlap(a: np.ndarray, b: np.ndarray, needed: int) -> bool:
    """Whether windows of ``needed`` functions overlap one of them in both documents; ``a`` and ``b`` are places."""
    fn, la, ra = parts_of(a)
    _, lb, rb = parts_of(b)
    for start in range(0, len(a), 256):
        k = slice(start, start + 256)
        met = (la[k, None] <= ra) & (la <= ra[k, None]) & (lb[k, None] <= rb) & (lb <= rb[k, None])
        functions = sum((met & (fn == f)).any(axis=1).astype(int) for f in np.unique(fn))
        if (functions >= needed).any():
            return True
    return False


def enough(pairs: DataFrame, needed: int) -> DataFrame:
    """Pairs of documents (a, b) of which windows of ``needed`` functions overlap in both: an interval join within the pair."""
    sides = pairs.filter("node != node_b").groupBy(F.col("node").alias("a"), F.col("node_b").alias("b"))
    if needed <= 1:
        return sides.agg(F.count("*").alias("n")).select("a", "b")
    function = F.shiftrightunsigned("place", 60)
    gathered = sides.agg(
        F.min(function).alias("low"), F.max(function).alias("high"), F.collect_list(F.struct("place", "place_b")).alias("windows")
    ).filter("low != high")

    def overlapping(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("windows")
            a, b = (np.asarray(lists.flatten().field(k)) for k in (0, 1))
            first = np.asarray(lists.offsets) - lists.offsets[0].as_py()
            keep = [overlap(a[i:j], b[i:j], needed) for i, j in zip(first, first[1:], strict=False)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return gathered.select("a", "b", "windows").mapInArrow(overlapping, "a long, b long")


def segments(match: np.ndarray, share: float, width: int) -> list[tuple[int, int]]:
    """Stretches, from match to match, of ``width`` places at least of which ``share`` match; what holds less is divided
    at its widest gap."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], match, [False]]).astype(np.int8)))
    begin, end = edges[::2], edges[1::2]
    held = np.concatenate([[0], np.cumsum(end - begin)])
    gaps = begin[1:] - end[:-1]
    out, todo = [], [(0, len(begin))] if len(begin) else []
    while todo:
        low, high = todo.pop()
        length = end[high - 1] - begin[low]
        if length < width:
            continue
        if held[high] - held[low] >= share * length - 1e-9:
            out.append((int(begin[low]), int(end[high - 1])))
        else:
            at = low + int(gaps[low : high - 1].argmax()) + 1
            todo += [(low, at), (at, high)]
    return sorted(out)


def shared_passages(va: np.ndarray, vb: np.ndarray, similarity: float, width: int) -> list[tuple[int, int, int, int]]:
    """Stretches of shingles of two texts that are similar: begin and end (exclusive) in each.

    Two stretches of a length are similar if a share of 2s / (1 + s) of each is in the other. Long stretches of that
    share come first; in what is not similar as a whole, stretches of a higher share, up to equal ones, are looked for.
    """
    match = np.isin(va, vb)
    out = []
    for share in (2 * similarity / (1 + similarity), 0.95, 1.0):
        for begin, end in segments(match, share, width):
            mine = np.unique(va[begin:end])
            found = False
            for b0, b1 in segments(np.isin(vb, mine), share, width):
                other = np.unique(vb[b0:b1])
                same = len(np.intersect1d(mine, other, assume_unique=True))
                if same >= similarity * (len(mine) + len(other) - same) - 1e-9:
                    out.append((begin, end, b0, b1))
                    found = True
            if found:
                match[begin:end] = False
    return out


PASSAGE = "a long, b long, begin int, end int, begin_b int, end_b int"


def compared(pairs: DataFrame, texts: DataFrame, shingle: int, words: int, similarity: float) -> DataFrame:
    """Passages, in words, that the texts of ``pairs`` (a, b) share."""
    width = words - shingle + 1

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "ta", STEP):
                (va, fa), (vb, fb) = (Words(*text_bytes(part.column(c))).shingles(shingle) for c in ("ta", "tb"))
                rows = []
                for i, (a, b) in enumerate(zip(part.column("a").to_pylist(), part.column("b").to_pylist(), strict=True)):
                    for begin, end, b0, b1 in shared_passages(va[fa[i] : fa[i + 1]], vb[fb[i] : fb[i + 1]], similarity, width):
                        rows.append((a, b, begin, end + shingle - 1, b0, b1 + shingle - 1))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
                kinds = [pa.int64(), pa.int64()] + [pa.int32()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["a", "b", "begin", "end", "begin_b", "end_b"])

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(found, PASSAGE)


def repeated_passages(
    docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, shingle: int = SHINGLE, hashes: int = HASHES,
    needed: int = ENOUGH, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Passages that documents share with another: doc_id, begin, end (words, end exclusive), and rep_doc_id, rep_begin,
    rep_end, the document that stands for all that share it. A copy of a text stands beside its first row.
    """
    rows = keyed(docs, doc_id=id_column, text=F.coalesce(F.col(text_column), F.lit("")))
    marks = stage(rows.select("row_", "doc_id", F.unhex(F.md5("text")).alias("digest")), "marks")
    firsts = marks.groupBy("digest").agg(F.min("row_").alias("node"), F.count("*").alias("n"))
    copies = stage(marks.join(firsts.filter("n > 1"), "digest").filter("row_ != node").select("row_", "doc_id", "node"), "copies")
    once = rows.join(few_or_all(copies.select("row_")), "row_", "left_anti").select(F.col("row_").alias("node"), "text")
    led = stage(led_pairs(windows_of(once, hashes, shingle, words)), "led")
    pairs = stage(enough(led, needed), "pairs")

    def texts_of(pairs: DataFrame) -> DataFrame:
        ids = stage(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct(), "nodes")
        return stage(once.join(few_or_all(ids), "node"), "texts")

    passages = stage(compared(pairs, texts_of(pairs), shingle, words, similarity), "passages")
    used = 0
    for further in (*FURTHER, 0):
        keys = stage(open_keys(led, passages, shingle, words, similarity), "keys")
        if keys.isEmpty():
            break
        open_rows = led.join(keys, "key", "left_semi")
        open_windows = open_rows.select("key", "node", "place").union(open_rows.select("key", F.col("node_b").alias("node"), F.col("place_b").alias("place")))
        led = stage(led_pairs(divided(once, open_windows.distinct(), hashes, shingle, words, used, further)), "led")
        used += further
        if not further:
            passages = passages.union(equal_runs(led, passages, shingle, words))
            break
        more = stage(enough(led, 1).join(pairs, ["a", "b"], "left_anti"), "more")
        pairs = pairs.union(more)
        passages = passages.union(stage(compared(more, texts_of(more), shingle, words, similarity), "passages"))
    names = marks.select(F.col("row_").alias("a"), "doc_id")
    reps = marks.select(F.col("row_").alias("b"), F.col("doc_id").alias("rep_doc_id"))
    shared = passages.join(names, "a").join(reps, "b").select(
        "doc_id", F.col("begin").cast("long"), F.col("end").cast("long"), "rep_doc_id", F.col("begin_b").cast("long").alias("rep_begin"), F.col("end_b").cast("long").alias("rep_end")
    )
    return shared.union(copied(copies, rows, marks, words)).distinct()


def open_keys(led: DataFrame, passages: DataFrame, shingle: int, words: int, similarity: float) -> DataFrame:
    """Keys of the groups of three documents and more with a window that no passage found with the group's first document
    covers. At its ends a window may reach over the passage by so few shingles that those inside are still similar."""
    over = int((words - shingle + 1) * (1 - similarity) / (1 + similarity))
    begin = lambda c: F.shiftright(c, 30).bitwiseAND((1 << 30) - 1)
    last = lambda c: begin(c) + F.col(c).bitwiseAND((1 << 30) - 1)
    known = passages.select("a", "b", *(F.col(c).alias(f"p_{c}") for c in ("begin", "end", "begin_b", "end_b")), F.lit(1).alias("agreed"))
    covered = (
        (F.col("node") == F.col("a")) & (F.col("node_b") == F.col("b"))
        & (begin("place") >= F.col("p_begin") - over) & (last("place") <= F.col("p_end") - shingle + over)
        & (begin("place_b") <= F.col("p_end_b") - shingle) & (last("place_b") >= F.col("p_begin_b"))
    )
    return led.filter("node != node_b").join(known, covered, "left").groupBy("key").agg(
        F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n"), F.count("agreed").alias("n_agreed")
    ).filter("low != high AND n_agreed < n").select("key")


def equal_runs(led: DataFrame, passages: DataFrame, shingle: int, words: int) -> DataFrame:
    """Passages of ``words`` equal words and more from windows of one passage each; those inside known ones are left out."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, runs in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "runs")), strict=True):
                begin, begin_b = (np.array([run[c] for run in runs], np.int64) for c in ("l", "lb"))
                order = np.lexsort((begin, begin_b - begin))
                begin, begin_b = begin[order], begin_b[order]
                new = np.append(True, (np.diff(begin) != 1) | (np.diff(begin_b) != 1))
                at = np.flatnonzero(new)
                for i, j in zip(at.tolist(), (np.append(at[1:], len(begin)) - 1).tolist(), strict=True):
                    out.append((a, b, int(begin[i]), int(begin[j]) + words, int(begin_b[i]), int(begin_b[j]) + words))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.int64(), pa.int64()] + [pa.int32()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["a", "b", "begin", "end", "begin_b", "end_b"])

    first = lambda c: F.shiftright(c, 30).bitwiseAND((1 << 30) - 1)
    runs = led.filter("node != node_b").groupBy(F.col("node").alias("a"), F.col("node_b").alias("b")).agg(
        F.collect_set(F.struct(first("place").alias("l"), first("place_b").alias("lb"))).alias("runs")
    ).mapInArrow(joined, PASSAGE)
    known = passages.select(F.col("a").alias("a_"), F.col("b").alias("b_"), F.col("begin").alias("p_begin"), F.col("end").alias("p_end"))
    return runs.join(known, F.expr("a = a_ AND b = b_ AND begin >= p_begin AND end <= p_end"), "left_anti")


def copied(copies: DataFrame, rows: DataFrame, marks: DataFrame, words: int) -> DataFrame:
    """Copies of whole texts of ``words`` words at least as passages."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text", STEP):
                n = np.diff(Words(*text_bytes(part.column("text"))).first)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("node", "rep_doc_id")), pa.array(n, pa.int64())], ["node", "rep_doc_id", "n"])

    nodes = stage(copies.select("node").distinct(), "copied")
    read = rows.select(F.col("row_").alias("node"), F.col("doc_id").alias("rep_doc_id"), "text").join(nodes, "node", "left_semi")
    kind = dict(rows.dtypes)["doc_id"]
    sized = read.mapInArrow(counted, f"node long, rep_doc_id {kind}, n long").filter(F.col("n") >= words)
    return copies.join(sized, "node").select("doc_id", F.lit(0).cast("long").alias("begin"), F.col("n").alias("end"), "rep_doc_id", F.lit(0).cast("long").alias("rep_begin"), F.col("n").alias("rep_end"))
