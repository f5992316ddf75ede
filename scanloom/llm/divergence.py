"""Audit of how the sources of a language differ in their terms.

The terms of a language are those that enough of its documents hold. They are found by prefix refinement: the byte
prefixes of two bytes with too few documents are discarded, those that are left are extended to four bytes, to eight, and
so on, until the terms under the last prefixes are complete. Each batch of texts is read once and gives, for all widths,
the number of its documents that hold a prefix; a document is in one batch, so these numbers add up. A width's rows are
only added up under the prefixes that its half has left over, so that rare terms are neither shuffled nor counted.

Null texts, languages and sources are empty. A source without kept terms has all its counts at 0, and a language without
kept terms has divergences of 0. Repeated rows are documents of their own. Columns beside the three are not read. A term
of any length is taken whole; a prefix is bytes and may end inside a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanloom.llm.common import LOWER, UPPER, few_or_all, stage, steps, text_bytes

#: Documents that a kept term is in at least, and the unit of shares.
DOCUMENTS, UNIT = 10, 1_000_000_000
#: Ranks of terms that are reported for a group.
TERM_RANKS = 10
#: Bytes of a prefix at the first level; each further level doubles them.
WIDTH = 2
STEP = 16 << 20
#: Cells of the table of terms by sources that one step compares.
CELLS = 1 << 21
#: Sources, counted once for each of their languages, up to which their names are broadcast.
GROUPS = 100_000
#: Parts of a language's terms that meet its sources apart, if the table of sources is too big to be broadcast.
PARTS = 64

PIECES = "lang string, source string, width int, prefix binary, complete boolean, docs long, n long"

#: Bytes of a term, in lower case; others are 0.
FOLD = np.zeros(256, np.uint8)
FOLD[0x80:] = np.arange(0x80, 0x100)
for _a, _b in zip(UPPER, LOWER, strict=True):
    FOLD[ord(_a)] = FOLD[ord(_b)] = ord(_b)


def terms_of(data: np.ndarray, first: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of texts in a row, and the text each is in."""
    folded = FOLD[data]
    inside = folded != 0
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edges = first[1:-1][first[1:-1] < len(data)]
    starts[edges] |= inside[edges]
    held = np.flatnonzero(inside)
    at = np.flatnonzero(starts[held])
    offsets = np.append(at, len(held)).astype(np.int64)
    terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(folded[held])])
    return terms, np.searchsorted(first, held[at], side="right") - 1


def counted(keys: tuple[np.ndarray, ...], sizes: tuple[int, ...], weight: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct combinations of ``keys``, each below its size, with the number of rows or the sum of their weights."""
    joined = np.zeros(len(keys[0]), np.int64)
    for key, size in zip(keys, sizes, strict=True):
        joined = joined * size + key
    value, place, n = np.unique(joined, return_inverse=True, return_counts=True)
    if weight is not None:
        n = np.bincount(place, weight, len(value)).astype(np.int64)
    out = []
    for size in reversed(sizes):
        out.insert(0, value % size)
        value = value // size
    return out, n


def pieces_of(langs: list[str], sources: list[str], data: np.ndarray, first: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    """Complete terms by source and prefixes of each width by language, with their documents; terms with their number."""
    lang_names, lang_of = np.unique(np.array(langs, object), return_inverse=True)
    pairs = sorted(set(zip(langs, sources, strict=True)))
    group_of = np.array([{p: k for k, p in enumerate(pairs)}[p] for p in zip(langs, sources, strict=True)])
    terms, owner = terms_of(data, first)
    coded = terms.dictionary_encode()
    words, code = coded.dictionary, coded.indices.to_numpy()
    size = np.asarray(pc.binary_length(words))
    (doc, term), n = counted((owner, code), (len(langs), max(1, len(words))))

    def rows(lang, source, w, prefixes, complete, docs, number) -> pa.RecordBatch:
        count = len(docs)
        return pa.RecordBatch.from_arrays([
            pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(np.full(count, w, np.int32)), prefixes.cast(pa.binary()),
            pa.array(np.full(count, complete)), pa.array(docs), pa.array(number),
        ], [c.split()[0] for c in PIECES.split(", ")])

    while len(doc):
        done = size[term] <= width
        if done.any():
            (group, t), docs = counted((group_of[doc[done]], term[done]), (len(pairs), len(words)))
            _, number = counted((group_of[doc[done]], term[done]), (len(pairs), len(words)), n[done])
            yield rows([pairs[g][0] for g in group], [pairs[g][1] for g in group], width, words.take(pa.array(t)), True, docs, number)
        doc, term, n = doc[~done], term[~done], n[~done]
        if len(doc):
            cut = pc.binary_slice(words, 0, width).dictionary_encode()
            prefix = cut.indices.to_numpy()[term]
            (d, p), _ = counted((doc, prefix), (len(langs), len(cut.dictionary)))
            (lang, p), docs = counted((lang_of[d], p), (len(lang_names), len(cut.dictionary)))
            yield rows([lang_names[k] for k in lang], [None] * len(docs), width, cut.dictionary.take(pa.array(p)), False, docs, np.zeros(len(docs), np.int64))
        width *= 2


def pieces(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Terms and prefixes of ``docs`` (lang, source, text), counted in each batch of texts."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text", STEP):
                yield from pieces_of(*(part.column(c).to_pylist() for c in ("lang", "source")), *text_bytes(part.column("text")), width)

    return docs.mapInArrow(found, PIECES)


def kept_terms(found: DataFrame, documents: int = DOCUMENTS, width: int = WIDTH) -> DataFrame:
    """Terms (lang, term as bytes) of staged ``pieces`` that enough documents of a language hold, level by level."""
    kept = None
    live = None
    while True:
        level = found.filter(F.col("width") == width).select("lang", "prefix", "complete", "docs")
        if live is not None:
            parents = live.select("lang", F.col("prefix").alias("parent"))
            level = level.withColumn("parent", F.substring("prefix", 1, width // 2)).join(few_or_all(parents), ["lang", "parent"], "left_semi")
        enough = stage(level.groupBy("lang", "prefix", "complete").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= documents), "prefixes")
        complete = enough.filter("complete").select("lang", F.col("prefix").alias("term"))
        kept = complete if kept is None else kept.union(complete)
        live = enough.filter("NOT complete")
        if live.isEmpty():
            return kept
        width *= 2


def share(n: F.Column, total: F.Column, terms: F.Column) -> F.Column:
    """Smoothed share of a term in ``UNIT`` parts, exact; the counts may pass what a long times ``UNIT`` holds."""
    wide = lambda c: c.cast("decimal(19,0)")
    part = F.call_function("div", wide(n + 2) * F.lit(UNIT).cast("decimal(10,0)"), wide(total + 2 * terms))
    return part + 1


def difference(p: F.Column, q: F.Column) -> F.Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def pair_sums(rows: DataFrame) -> DataFrame:
    """Sum of differences between each two sources of a language over its terms, in parts: lang, source, item, value.

    ``rows`` hold a term's shares by source (place, share), and for all sources of the language their names and shares of
    a term that they don't have. The table of shares is as wide as the result is per source.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            order = sorted(range(len(langs)), key=langs.__getitem__)
            while order:
                names = batch.column("names")[order[0]].as_py()
                mine = [i for i in order[: max(1, CELLS // len(names))] if langs[i] == langs[order[0]]]
                order = order[len(mine) :]
                part = batch.take(pa.array(mine))
                p = np.tile(np.array(part.column("absent")[0].as_py(), np.int64), (len(mine), 1))
                held = part.column("held")
                entries = held.flatten()
                owner = np.repeat(np.arange(len(mine)), np.diff(np.asarray(held.offsets)))
                p[owner, np.asarray(entries.field("place"))] = np.asarray(entries.field("share"))
                for a in range(len(names)):
                    mine_a = p[:, a : a + 1]
                    value = ((mine_a - p) ** 2 // (mine_a + p)).sum(axis=0)
                    keep = np.arange(len(names)) != a
                    n = len(names) - 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part.column("lang")[0].as_py()] * n, pa.string()), pa.array([names[a]] * n, pa.string()),
                         pa.array(np.array(names, object)[keep], pa.string()), pa.array(value[keep])],
                        ["lang", "source", "item", "value"],
                    )

    return rows.mapInArrow(summed, "lang string, source string, item string, value long")


def ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def audit(
    docs: DataFrame, documents: int = DOCUMENTS, term_ranks: int = TERM_RANKS, lang_column: str = "lang", source_column: str = "source",
    text_column: str = "text",
) -> DataFrame:
    """lang, source, part, item, value and rank: part ``pair`` holds the divergence of a source from each other source of
    its language, part ``term`` the terms that a source has more of than its language, by how much they differ."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(empty(lang_column).alias("lang"), empty(source_column).alias("source"), empty(text_column).alias("text"))
    found = stage(pieces(rows), "pieces")
    kept = stage(kept_terms(found, documents), "terms")
    held = found.filter("complete").select("lang", "source", F.col("prefix").alias("term"), "n").join(few_or_all(kept), ["lang", "term"], "left_semi")
    counts = stage(held.groupBy("lang", "source", "term").agg(F.sum("n").alias("n")), "counts")

    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = groups.fillna(0, ["total", "terms"])
    by_lang = Window.partitionBy("lang").orderBy("source")
    groups = stage(groups.withColumn("place", F.row_number().over(by_lang) - 1), "groups")
    own = counts.join(few_or_all(groups.select("lang", "source", "total", "terms", "place")), ["lang", "source"])
    own = own.withColumn("share", share(F.col("n"), F.col("total"), F.col("terms")))
    lang_totals = few_or_all(stage(groups.groupBy("lang").agg(F.sum("total").alias("lang_total")), "langs"))

    overall = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    versus = own.join(overall, ["lang", "term"]).join(lang_totals, "lang")
    versus = versus.withColumn("base", share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))).filter("n > 0 AND share > base")
    term_part = ranked(versus.select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), difference(F.col("share"), F.col("base")).alias("value")
    )).filter(F.col("rank") <= term_ranks)

    absent = share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))
    members = groups.filter("terms > 0").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "source", absent.alias("absent")))).alias("members"))
    members = members.select("lang", F.col("members.source").alias("names"), F.col("members.absent").alias("absent"))
    by_term = own.groupBy("lang", "term").agg(F.collect_list(F.struct("place", "share")).alias("held"))
    keys = ["lang"]
    if groups.count() > GROUPS:  # too many names to be broadcast: a language's terms meet them in parts
        members = members.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        by_term, keys = by_term.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(PARTS)).cast("int")), ["lang", "part"]
    else:
        members = F.broadcast(members)
    sums = pair_sums(by_term.join(members, keys).select("lang", "held", "names", "absent"))
    # sources whose language has no term are 0 apart
    names = groups.filter("terms = 0").select("lang", "source")
    bare = names.join(names.withColumnRenamed("source", "item"), "lang").filter("source != item").withColumn("value", F.lit(0).cast("long"))
    sums = sums.union(bare.select("lang", "source", "item", "value")).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pair_part = ranked(sums.select("lang", "source", F.lit("pair").alias("part"), "item", "value"))
    return pair_part.union(term_part)
