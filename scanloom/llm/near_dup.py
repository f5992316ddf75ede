"""Near-duplicate documents by DartMinHash signatures and banded joining.

An element of a document's weighted set, a shingle of five words, throws darts into the region of its weight and an
unbounded rank: arrivals of a Poisson process that only depend on the element. A dart falls on one of ``BANDS * ROWS``
coordinates, which keeps the dart of the lowest rank; two sets keep the same dart with the probability of their weighted
Jaccard similarity. Only darts up to a rank that is expected to fill all coordinates are thrown, and further ones where
a coordinate stayed empty.

Documents that agree on all rows of a band meet in a bucket. In each bucket all are led by the one that most others
of all its buckets agree with; each document is compared with its foremost leader, then with those leaders that it is
not connected with yet. Buckets that still hold more than one component are then compared in blocks, pairs of
different components only, by their signatures and at once by all their shingles; a link found joins their components, so that
a block gives fewer links than it has members. All links are verified on the shingles of both texts. Exact copies
take part once. Classes are the connected components.

A null text is an empty one. Texts without words are equal only to texts of the same characters; a text of one to four
words is one shingle. Repeated rows and ids are rows of their own. Columns beside the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import Words, few_or_all, fixed, keyed, mix, stage, steps, text_bytes
from scanloom.llm.components import components

#: Words of a shingle, similarity of a link, bands and coordinates of a band: at 0.8, a link is missed with 0.0002.
SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 36, 7
#: How far below the threshold an estimate may be for a pair to be verified, four standard deviations.
MARGIN = 4 * math.sqrt(SIMILARITY * (1 - SIMILARITY) / (BANDS * ROWS))
#: Rows with all their shingles that are unpacked at once.
ROWS_AT_ONCE = 500
#: Members of a block when buckets are compared in blocks, and bytes of text that a step takes at once.
BLOCK, STEP = 512, 2 << 20


def uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, sets: int, size: int) -> np.ndarray:
    """The dart that each of ``size`` coordinates keeps, for each set; 0 for a set without weight.

    ``elements`` are 64-bit values, ``owner`` is the number of the set each belongs to.
    """
    with np.errstate(over="ignore"):
        # cells of unit weight; the last one of an element counts in part
        cells = np.ceil(weights).astype(np.int64)
        if len(cells) and cells.max() > 1:
            level = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
            part = np.minimum(1.0, np.repeat(weights, cells) - level)
            owner = np.repeat(owner, cells)
            elements = mix(np.repeat(elements, cells) + level.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        else:
            elements, part = mix(elements), np.minimum(1.0, weights)
        total = np.bincount(owner, part, sets)
        kept, best = np.zeros(sets * size, np.uint64), np.full(sets * size, np.inf)
        reach = np.where(total > 0, (size * math.log(size) + 2 * size) / np.maximum(total, 1e-300), 0.0)
        todo = total > 0
        while todo.any():
            alive = todo[owner]
            cell, mine, share = elements[alive], owner[alive], part[alive]
            rank, limit, turn = np.zeros(len(cell)), reach[mine], 0
            while len(cell):
                dart = mix(cell + np.uint64(turn + 1) * np.uint64(0x9FB21C651E98DF25))
                rank = rank - np.log(uniform(dart))
                hit = rank <= limit
                if not hit.all():
                    cell, mine, share, rank, limit, dart = (x[hit] for x in (cell, mine, share, rank, limit, dart))
                second = mix(dart ^ np.uint64(0xD1B54A32D192ED03))
                inside = uniform(mix(second)) < share
                at = mine * size + (second % np.uint64(size)).astype(np.int64)
                at, ranks, darts = (at, rank, dart) if inside.all() else (at[inside], rank[inside], dart[inside])
                np.minimum.at(best, at, ranks)
                lowest = best[at] == ranks
                kept[at[lowest]] = darts[lowest]
                turn += 1
            empty = np.isinf(best.reshape(sets, size)).any(axis=1)
            todo &= empty
            reach[todo] *= 2
    return kept.reshape(sets, size)


def weighted_shingles(words: Words, shingle: int, counted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, their weights (1, or how often they occur) and the number of the text."""
    values, first = words.shingles(shingle)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    weights = np.diff(np.append(at, len(values))).astype(np.float64) if counted else np.ones(len(at))
    return values[at], weights, owner[at]


def sign(docs: DataFrame, bands: int, rows: int, shingle: int, counted: bool, id_column: str, text_column: str) -> DataFrame:
    """Per row: row_, doc_id, digest of the text, weight, bands (a key each) and a byte of each coordinate."""
    read = keyed(docs, doc_id=id_column, text=text_column)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text", STEP):
                data, offsets = text_bytes(part.column("text"))
                values, weights, owner = weighted_shingles(Words(data, offsets), shingle, counted)
                found = signatures(values, weights, owner, part.num_rows, bands * rows)
                with np.errstate(over="ignore"):
                    keys = np.zeros((part.num_rows, bands), np.uint64)
                    for r in range(rows):
                        keys = mix(keys * np.uint64(0xD6E8FEB86659FD93) + found.reshape(-1, bands, rows)[:, :, r] + np.arange(bands, dtype=np.uint64))
                total = np.bincount(owner, weights, part.num_rows)
                held = np.where(total > 0, bands, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(held)]), pa.int32()), pa.array(keys[total > 0].ravel().view(np.int64)))
                raw = data.tobytes()
                digests = [hashlib.blake2b(raw[offsets[i] : offsets[i + 1]], digest_size=16).digest() for i in range(part.num_rows)]
                small = (found >> np.uint64(20)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row_"), part.column("doc_id"), pa.array(digests, pa.binary()), pa.array(total), lists, pa.array([r.tobytes() for r in small], pa.binary())],
                    ["row_", "doc_id", "digest", "weight", "keys", "signature"],
                )

    kind = dict(read.dtypes)["doc_id"]
    return stage(read.mapInArrow(signed, f"row_ long, doc_id {kind}, digest binary, weight double, keys array<long>, signature binary"), "signed")


def agreement(a: pa.Array, b: pa.Array, size: int) -> np.ndarray:
    """Share of coordinates on which the signatures of two columns agree."""
    if not len(a):
        return np.zeros(0)
    x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, size) for c in (a, b))
    return (x == y).mean(axis=1)


def similar_by_signature(pairs: DataFrame, nodes: DataFrame, size: int, least: float) -> DataFrame:
    """Of ``pairs`` (a, b) those whose signatures agree on ``least`` of the coordinates."""

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = agreement(batch.column("sa"), batch.column("sb"), size) >= least
            yield batch.select(["a", "b"]).filter(pa.array(near))

    left = nodes.select(F.col("row_").alias("a"), F.col("signature").alias("sa"))
    right = nodes.select(F.col("row_").alias("b"), F.col("signature").alias("sb"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(close, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float, counted: bool) -> DataFrame:
    """Of ``pairs`` (a, b) those whose texts are similar, compared by all their shingles."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "ta", STEP):
                sides = []
                for name in ("ta", "tb"):
                    values, weights, owner = weighted_shingles(Words(*text_bytes(part.column(name))), shingle, counted)
                    first = np.searchsorted(owner, np.arange(part.num_rows + 1))
                    sides.append((values, weights, first))
                (va, wa, fa), (vb, wb, fb) = sides
                near = np.zeros(part.num_rows, bool)
                for i in range(part.num_rows):
                    a, b = slice(fa[i], fa[i + 1]), slice(fb[i], fb[i + 1])
                    _, x, y = np.intersect1d(va[a], vb[b], assume_unique=True, return_indices=True)
                    common = np.minimum(wa[a][x], wb[b][y]).sum()
                    near[i] = common > 0 and common >= similarity * (wa[a].sum() + wb[b].sum() - common) - 1e-9
                yield part.select(["a", "b"]).filter(pa.array(near))

    left = texts.select(F.col("row_").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("row_").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(compared, "a long, b long")


def shingle_sets(texts: DataFrame, shingle: int, counted: bool) -> DataFrame:
    """node, elements: the sorted shingles of each text (row_, text); one that counts several times stands as so many."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text", STEP):
                values, weights, owner = weighted_shingles(Words(*text_bytes(part.column("text"))), shingle, counted)
                times = weights.astype(np.int64)
                level = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                with np.errstate(over="ignore"):
                    values = mix(np.repeat(values, times) + level.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
                owner = np.repeat(owner, times)
                values = values[np.lexsort((values, owner))]
                first = np.searchsorted(owner, np.arange(part.num_rows + 1))
                sets = [values[i:j].tobytes() for i, j in zip(first, first[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column("row_"), pa.array(sets, pa.binary())], ["node", "elements"])

    return texts.select("row_", "text").mapInArrow(listed, "node long, elements binary")


def similar_sets(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets are similar."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common > 0 and common >= similarity * (len(both) - common) - 1e-9


def across_components(members: DataFrame, size: int, least: float, similarity: float) -> DataFrame:
    """Links (a, b) between members of a bucket with different components, such that each block of a bucket is connected as all
    its similar pairs would connect it.

    A pair that shares several buckets is compared in the first of them alone, and only if the signatures agree on ``least``.
    ``members``: key, node, component, count (members of the bucket), signature, keys, elements. A bucket is cut into blocks of
    about ``BLOCK`` members and each pair of blocks is compared at one place, so that no group is larger than two blocks.
    """
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "component", "signature", "keys", "elements"
    )

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def links(group: list[tuple]) -> list[tuple[int, int]]:
            key, i, j = group[0][0]
            node, comp, own = (np.array([g[k] for g in group], np.int64) for k in (2, 3, 1))
            comp = np.unique(comp, return_inverse=True)[1]
            sig = np.frombuffer(b"".join(g[4] for g in group), np.uint8).reshape(-1, size)
            keys = np.stack([g[6] for g in group])
            band = keys[0] == key
            sets = [np.frombuffer(g[5], np.uint64) for g in group]
            out: list[tuple[int, int]] = []
            for x in range(len(group)):
                if comp.max() == comp.min():
                    break
                later = np.arange(x + 1, len(group))
                fit = later[(comp[later] != comp[x]) & ((own[later] != own[x]) if i != j else True)]
                if not len(fit):
                    continue
                agree = (sig[fit] == sig[x]).mean(axis=1)
                near = agree >= least
                fit, agree = fit[near], agree[near]
                first = band[(keys[fit] == keys[x]).argmax(axis=1)]
                fit, agree = fit[first], agree[first]
                for y in fit[np.argsort(-agree, kind="stable")].tolist():
                    if comp[y] != comp[x] and similar_sets(sets[x], sets[y], similarity):
                        out.append((int(node[x]), int(node[y])))
                        comp[comp == comp[y]] = comp[x]
            return out

        def record(found: list[tuple[int, int]]) -> pa.RecordBatch:
            a, b = ([f[k] for f in found] for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in (whole.slice(at, ROWS_AT_ONCE) for whole in batches for at in range(0, whole.num_rows, ROWS_AT_ONCE)):
            found = []
            keys = np.asarray(batch.column("keys").flatten()).reshape(batch.num_rows, -1)
            plain = (batch.column(c).to_pylist() for c in ("key", "i", "j", "own", "node", "component", "signature", "elements"))
            for row in zip(*plain, keys, strict=True):
                place = row[:3]
                if held and held[0][0] != place:
                    found += links(held)
                    held = []
                held.append((place, *row[3:]))
            yield record(found)
        if held:
            yield record(links(held))

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(compared, "a long, b long").distinct()


def classes(
    docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS,
    counted: bool = False, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """The class of each row of ``docs``: row_, doc_id, class_row (the first row of the class).

    ``counted`` weighs a shingle by how often it occurs in a text, else each counts once.
    """
    docs = fixed(docs)
    size = bands * rows
    least = similarity - 4 * math.sqrt(similarity * (1 - similarity) / size)
    signed = sign(docs, bands, rows, shingle, counted, id_column, text_column)
    # the first row of each text of several takes part for all
    copies = stage(signed.groupBy("digest").agg(F.min("row_").alias("node"), F.count("*").alias("n")).filter("n > 1").select("digest", "node"), "copies")
    marked = stage(signed.select("row_", "digest").join(few_or_all(copies), "digest").select("row_", "node"), "marked")
    nodes = signed.join(few_or_all(marked.filter("row_ != node").select("row_")), "row_", "left_anti")
    # moved once; a bucket is never held, its members pass by its count
    in_bands = nodes.select(F.explode("keys").alias("key"), F.col("row_").alias("node"), "weight").repartition("key")
    counts = in_bands.groupBy("key").agg(F.count("*").alias("count")).filter("count > 1")
    members = stage(in_bands.join(counts.hint("shuffle_hash"), "key"), "members")
    # the member that shares most with others stands for the bucket
    standing = stage(members.groupBy("node").agg(F.sum(F.log("count")).alias("standing")), "standing")
    leaders = members.join(few_or_all(standing), "node").groupBy("key").agg(F.max(F.struct("standing", -F.col("node"), "node", "weight")).alias("leader"))
    led = stage(
        members.join(few_or_all(stage(leaders, "leaders")), "key").filter(F.col("node") != F.col("leader.node")).filter(
            F.least("weight", "leader.weight") >= similarity * F.greatest("weight", "leader.weight")
        ).groupBy(F.col("node").alias("a"), F.col("leader.node").alias("b")).agg(F.max("leader.standing").alias("standing")),
        "led",
    )
    held = stage(nodes.select("row_", "signature", "keys").join(few_or_all(standing.select(F.col("node").alias("row_"))), "row_"), "held")
    close = stage(similar_by_signature(led.select("a", "b"), held, size, least).join(led, ["a", "b"]), "close")

    def texts_of(pairs: DataFrame) -> DataFrame:
        wanted = stage(pairs.select(F.col("a").alias("row_")).union(pairs.select(F.col("b").alias("row_"))).distinct(), "wanted")
        return stage(keyed(docs, text=F.coalesce(F.col(text_column), F.lit(""))).join(few_or_all(wanted), "row_"), "texts")

    texts = texts_of(close)
    # each document beside the foremost of its leaders first, then beside those that are not yet in its component
    foremost = close.groupBy("a").agg(F.max(F.struct("standing", -F.col("b"), "b")).alias("best")).select("a", "best.b")
    links = stage(verified(foremost, texts, shingle, similarity, counted), "links")
    labels = components(links)
    of = lambda side: labels.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    apart = close.join(of("a"), "a", "left").join(of("b"), "b", "left").filter("coalesce(ca, a) != coalesce(cb, b)").select("a", "b")
    links = stage(links.union(verified(apart, texts, shingle, similarity, counted)), "links")
    labels = components(links)
    placed = members.join(few_or_all(labels), "node", "left").select("key", "node", "count", F.coalesce("component", "node").alias("component"))
    open_keys = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high").select("key")
    open_rows = stage(placed.join(few_or_all(stage(open_keys, "open")), "key"), "open-rows")
    open_nodes = few_or_all(stage(open_rows.select(F.col("node").alias("row_")).distinct(), "open-nodes"))
    sets = shingle_sets(keyed(docs, text=F.coalesce(F.col(text_column), F.lit(""))).join(open_nodes, "row_"), shingle, counted)
    known = stage(held.withColumnRenamed("row_", "node").join(sets, "node"), "sets")
    more = stage(across_components(open_rows.join(known, "node"), size, least, similarity), "more")
    if not more.isEmpty():
        labels = components(stage(links.union(more), "links"))
    named = signed.select("row_", "doc_id").join(few_or_all(marked), "row_", "left").withColumn("node", F.coalesce("node", "row_"))
    return named.join(few_or_all(labels), "node", "left").select("row_", "doc_id", F.coalesce("component", "node").alias("class_row"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (the smallest doc_id of its class), class_size."""
    found = stage(classes(docs, id_column=id_column, text_column=text_column, **options), "classes")
    sizes = found.groupBy("class_row").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    several = few_or_all(stage(sizes.filter("n > 1"), "sizes"))
    return found.join(several, "class_row", "left").select(
        "doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("class_id"), F.coalesce("n", F.lit(1)).alias("class_size")
    )


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """``docs`` with the first row (smallest id, then key) of each class and all columns."""
    docs = fixed(docs)
    found = stage(classes(docs, id_column=id_column, text_column=text_column, **options), "classes")
    kept = found.groupBy("class_row").agg(F.min(F.struct("doc_id", "row_")).alias("first")).select(F.col("first.row_").alias("row_"))
    rows = keyed(docs, doc=F.struct(*docs.columns))
    return rows.join(few_or_all(stage(kept, "kept")), "row_", "left_semi").select("doc.*")
