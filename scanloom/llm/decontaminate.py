"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

``build_index`` stores one posting (row, term, position) for each training word that occurs in the test items.
``exact_matches`` reads, for each window of an item, the postings of its rarest term, intersects them with those of the
second rarest after both are shifted by their offsets in the window, and checks all words of the item along the few
alignments that are left. ``proximity_matches`` does the first two steps with a tolerance.

Empty and null texts have no words and match nothing; they are reported with zeros. Repeated rows and repeated or null
ids are told apart by ``row_``. Columns beside the id and the text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanloom.llm.common import fixed, keyed, sql_words, stage

#: Words of a window.
WINDOW_WORDS = 10
#: Rows of a table about the items up to which it is broadcast (below 100 bytes each); beyond, Spark shuffles.
BROADCAST_ROWS = 500_000
#: Position of the posting that every row has, with its id and word count.
SENTINEL = -1


@dataclass
class Items:
    """Test items: ``ids`` (item, item_id), ``terms`` (item, n, k, term_id), ``vocabulary`` (word, term_id)."""

    ids: DataFrame
    terms: DataFrame
    vocabulary: DataFrame


@dataclass
class Index:
    """``rows`` (row_, doc_id, n_words) and ``postings`` (row_, term_id, pos)."""

    rows: DataFrame
    postings: DataFrame


def bounded(rows: DataFrame) -> DataFrame:
    """``rows`` of a staged table, broadcast if they are counted to be few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def read_items(items: DataFrame, id_column: str = "item_id", text_column: str = "text") -> Items:
    """Words and terms of the items; items with the same words are one ``item`` with several ids."""
    words = items.select(
        F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("item_id"), sql_words(F.col(text_column)).alias("words")
    ).filter("size(words) > 0")
    words = stage(words.withColumn("item", F.sha2(F.concat_ws(" ", "words"), 256)), "items")
    exploded = words.dropDuplicates(["item"]).select(
        "item", F.size("words").alias("n"), F.posexplode("words").alias("k", "word")
    )
    vocabulary = stage(exploded.select("word").distinct().withColumn("term_id", F.monotonically_increasing_id()), "vocabulary")
    terms = stage(exploded.join(vocabulary, "word").select("item", "n", "k", "term_id"), "terms")
    return Items(words.select("item", "item_id").distinct(), terms, vocabulary)


def build_index(docs: DataFrame, items: Items, id_column: str = "doc_id", text_column: str = "text") -> Index:
    """Writes the postings of the words that occur in the items, and one row per document, in one pass over the texts."""
    words = keyed(docs, doc_id=id_column, words=sql_words(F.col(text_column)))
    # the empty word, which no text has, carries what is known of the row
    marked = words.select(
        "row_", "doc_id", F.size("words").alias("n_words"),
        F.posexplode(F.concat(F.array(F.lit("")), "words")).alias("pos", "word"),
    )
    known = items.vocabulary.union(
        docs.sparkSession.range(1).select(F.lit("").alias("word"), F.lit(SENTINEL).cast("long").alias("term_id"))
    )
    known = F.broadcast(known) if items.vocabulary.count() <= BROADCAST_ROWS else known
    is_row = F.col("term_id") == SENTINEL
    stored = stage(
        marked.join(known, "word").select(
            "row_", "term_id", (F.col("pos") - 1).alias("pos"),
            F.when(is_row, F.col("doc_id")).alias("doc_id"), F.when(is_row, F.col("n_words").cast("long")).alias("n_words"),
        ),
        "index",
    )
    return Index(
        stored.filter(is_row).select("row_", "doc_id", "n_words"), stored.filter(~is_row).select("row_", "term_id", "pos")
    )


def rarest_pairs(index: Index, items: Items, window: int = WINDOW_WORDS) -> DataFrame:
    """For each window of each item, its two rarest terms and their offsets in the item (item, o1, t1, o2, t2).

    A window with a term that no document has is left out. A window of one word has no second term.
    """
    counts = index.postings.groupBy("term_id").agg(F.count("*").alias("df"))
    terms = items.terms.join(counts, "term_id", "left")
    begins = terms.select(
        "item", "n", "k", "term_id", "df",
        F.explode(
            F.sequence(F.greatest(F.lit(0), F.col("k") - (window - 1)), F.greatest(F.lit(0), F.least(F.col("k"), F.col("n") - window)))
        ).alias("begin"),
    )
    ranked = begins.groupBy("item", "n", "begin").agg(
        F.array_sort(F.collect_list(F.struct("df", "k", "term_id"))).alias("by_df"), F.count("df").alias("found")
    ).filter(F.col("found") == F.least(F.col("n"), F.lit(window)))
    pairs = ranked.select(
        "item", F.col("by_df")[0]["k"].alias("o1"), F.col("by_df")[0]["term_id"].alias("t1"),
        F.when(F.size("by_df") > 1, F.col("by_df")[1]["k"]).alias("o2"),
        F.when(F.size("by_df") > 1, F.col("by_df")[1]["term_id"]).alias("t2"),
    )
    return stage(pairs.distinct(), "pairs")


def alignments(index: Index, pairs: DataFrame) -> DataFrame:
    """Rows and shifts at which the two rarest terms of a window stand as far apart as in the item (row_, item, shift)."""
    first = index.postings.join(bounded(pairs), F.col("term_id") == F.col("t1")).select(
        "row_", "item", (F.col("pos") - F.col("o1")).alias("shift"), "o2", "t2"
    )
    first = stage(first.distinct(), "first")
    alone = first.filter("t2 IS NULL").select("row_", "item", "shift")
    second = index.postings.join(F.broadcast(t2) if (t2 := pairs.select(F.col("t2").alias("term_id")).distinct()).count() <= BROADCAST_ROWS else t2, "term_id", "left_semi")
    both = first.filter("t2 IS NOT NULL").withColumn("pos", F.col("shift") + F.col("o2")).withColumnRenamed("t2", "term_id").join(
        second, ["row_", "pos", "term_id"], "left_semi"
    )
    return stage(both.select("row_", "item", "shift").union(alone).distinct(), "alignments")


def exact_matches(index: Index, items: Items, window: int = WINDOW_WORDS) -> DataFrame:
    """Maximal runs of item words in documents that hold a window: (row_, item, begin, end), end exclusive."""
    found = alignments(index, rarest_pairs(index, items, window))
    wanted = found.join(bounded(items.terms), "item").select(
        "row_", "item", "shift", "n", "k", "term_id", (F.col("shift") + F.col("k")).alias("pos")
    ).filter("pos >= 0")
    held = index.postings.join(found.select("row_").distinct(), "row_", "left_semi")
    matched = wanted.join(held, ["row_", "pos", "term_id"], "left_semi")
    order = Window.partitionBy("row_", "item", "shift").orderBy("k")
    islands = matched.withColumn("island", F.col("k") - F.row_number().over(order)).groupBy("row_", "item", "shift", "island").agg(
        F.min("k").alias("first"), F.count("*").alias("length"), F.first("n").alias("n")
    ).filter(F.col("length") >= F.least(F.col("n"), F.lit(window)))
    return islands.select(
        "row_", "item", (F.col("shift") + F.col("first")).cast("long").alias("begin"),
        (F.col("shift") + F.col("first") + F.col("length")).alias("end"),
    )


def proximity_matches(index: Index, items: Items, slop: int, window: int = WINDOW_WORDS) -> DataFrame:
    """Rows in which the two rarest terms of a window are at most ``slop`` words off their distance in the item."""
    pairs = rarest_pairs(index, items, window).filter("t2 IS NOT NULL")
    width = slop + 1
    first = index.postings.join(bounded(pairs), F.col("term_id") == F.col("t1")).select(
        "row_", "item", (F.col("pos") - F.col("o1") + F.col("o2")).alias("expected"), F.col("t2").alias("term_id")
    )
    slot = F.floor(F.col("expected") / width)
    first = first.withColumn("slot", F.explode(F.array(slot - 1, slot, slot + 1)))
    second = index.postings.withColumn("slot", F.floor(F.col("pos") / width))
    near = first.join(second, ["row_", "term_id", "slot"]).filter(F.abs(F.col("pos") - F.col("expected")) <= slop)
    return near.select("row_", "item").distinct()


def report(index: Index, items: Items, window: int = WINDOW_WORDS) -> DataFrame:
    """One row per document row: words, words inside matches, matching items and whether there are any."""
    runs = stage(exact_matches(index, items, window), "runs")
    spans = runs.groupBy("row_", "begin").agg(F.max("end").alias("end"))
    order = Window.partitionBy("row_").orderBy("begin")
    before = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    covered = spans.withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("begin"), before)))
    hits = covered.groupBy("row_").agg(F.sum("new").alias("n_hit"))
    named = runs.select("row_", "item").distinct().join(bounded(items.ids), "item").groupBy("row_").agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids")
    )
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return index.rows.join(hits.join(named, "row_"), "row_", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), "row_",
    )


def decontaminate(
    docs: DataFrame, items: DataFrame, window: int = WINDOW_WORDS, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Contamination report of ``docs`` against ``items``."""
    read = read_items(items)
    return report(build_index(docs, read, id_column, text_column), read, window)


def keep_clean(docs: DataFrame, items: DataFrame, window: int = WINDOW_WORDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no window of ``items`` occurs."""
    docs = fixed(docs)
    found = decontaminate(docs, items, window, id_column, text_column).filter("contaminated").select("row_")
    rows = keyed(docs, doc=F.struct(*docs.columns))
    # Spark broadcasts the keys of the contaminated rows if the written table is small
    return rows.join(stage(found, "contaminated"), "row_", "left_anti").select("doc.*")
