"""Personal data: spans of fixed patterns, and further identifiers by bootstrapped contextual extraction.

The spans of the fixed patterns are the seeds. Other words with digits or @ in them, of any length, and numbers in groups
are candidates. Seeds and candidates stand in contexts: the words before and after. A pattern is a kind with a context, and
with the shape of what stands in it or with any shape, so that trust reaches forms no seed has. Patterns are scored by the confidence of the instances they extract, instances by the patterns that extract them,
in ``ROUNDS`` rounds over the graph of all documents; what is extracted by a pattern above ``CONFIDENT`` is added.

A null or empty text has no spans. Spans are counted in code points, end exclusive. Equal texts get equal spans, and the
words of a text that occurs often count by documents, once each. Columns beside the id and the text stay as they are.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import fixed, keyed, stage, steps

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns. An address is read from its ``@`` on, a number from its first digit, so that long runs take linear time.
EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Words before a mention that make its context, and the rounds, support in texts and score that a pattern needs.
BEFORE, ROUNDS, SUPPORT, CONFIDENT = 2, 4, 5, 0.8
#: Candidates: a piece without spaces, with a digit or @, and digits in groups with a space between them.
PIECE = re.compile(r"(?<!\S)[^\s]*[0-9@][^\s]*")
GROUPED = re.compile(r"(?<![^\s\"'\[{<:;,])\+?\(?[0-9](?:[0-9().\-/]*[0-9)])?(?: \(?[0-9](?:[0-9().\-/]*[0-9)])?)+(?![^\W_])")
#: Length from which a piece inside such groups is a candidate too, and up to which a value is kept as it is.
LEAST_LENGTH, MOST_LENGTH = 6, 64
#: The shape of patterns that take every shape.
ANY_SHAPE = ""
ANY_SIGN = re.compile("[0-9@]")
EDGES = ".,;:!?\"'()[]{}<>*#$%&"
MENTION = "struct<kind:string,begin:int,end:int,value:string,before:string,after:string,shape:string>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the address pattern, found from each ``@`` on."""
    at, done = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > done and (text[begin - 1] in "._%+-" or (text[begin - 1].isascii() and text[begin - 1].isalnum())):
            begin -= 1
        found = EMAIL_TAIL.match(text, at) if begin < at else None
        if found:
            yield begin, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))



def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans (begin, end, kind) of the fixed patterns by begin, then kind; each kind leftmost and non-overlapping."""
    found = []
    if "@" in text:
        found += [(b, e, "email") for b, e in emails(text)]
    if "." in text:
        found += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if 12 <= m.end() - m.start() and 12 <= len(digits := digits_of(m[0])) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), "card"))
    if "+" in text:
        found += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def shape_of(value: str) -> str:
    """Runs of capitals, small letters and digits as A, a and 9; signs as they are."""
    coarse = re.sub(r"[0-9]+", "9", re.sub(r"[^\W\d_A-Z]+", "a", re.sub(r"[A-Z]+", "A", value)))
    return value_of(re.sub(r"([Aa])(?:[Aa])+", "a", coarse))


def value_of(text: str) -> str:
    """A value as it is compared: what is longer than ``MOST_LENGTH`` ends in a digest of all of it."""
    return text if len(text) <= MOST_LENGTH else text[:MOST_LENGTH] + hashlib.md5(text.encode("utf-8", "replace")).hexdigest()


def context(text: str, begin: int, end: int) -> tuple[str, str]:
    """The words before and the word after a place, lower-cased, numbers as 0; nothing across a line end."""
    plain = lambda words: " ".join(value_of(re.sub(r"[0-9]+", "0", w.lower().strip(EDGES))) for w in words)
    return plain(words_before(text, begin, BEFORE)), plain(words_after(text, end, 1))


def words_before(text: str, begin: int, count: int) -> list[str]:
    """The last ``count`` words of the line before a place, whole, however long they are."""
    reach = 64
    while True:
        low = max(0, begin - reach)
        _, line_end, part = text[low:begin].rpartition("\n")
        words = part.split()
        if line_end or len(words) > count or not low or text[low - 1].isspace():
            return words[-count:]
        reach *= 2


def words_after(text: str, end: int, count: int) -> list[str]:
    """The first ``count`` words of the line behind a place."""
    reach = 64
    while True:
        part, line_end, _ = text[end : end + reach].partition("\n")
        words = part.split()
        if line_end or len(words) > count or end + reach >= len(text) or part[-1:].isspace() and len(words) == count:
            return words[:count]
        reach *= 2


def mentions(text: str) -> list[dict]:
    """Seeds and candidates of a text with their contexts and shapes."""
    if not ANY_SIGN.search(text):
        return []
    base = base_spans(text)
    found = []
    taken = [(b, e) for b, e, _ in base]
    reach = np.maximum.accumulate([e for _, e in taken]) if taken else np.zeros(0, int)
    for begin, end, kind in base:
        before, after = context(text, begin, end)
        found.append({"kind": kind, "begin": begin, "end": end, "value": text[begin:end], "before": before, "after": after, "shape": shape_of(text[begin:end])})
    starts = [b for b, _ in taken]
    groups = [m.span() for m in GROUPED.finditer(text)]
    group_starts = [b for b, _ in groups]
    places = list(groups)
    for m in PIECE.finditer(text):
        piece = m[0]
        begin = m.start() + len(piece) - len(piece.lstrip(EDGES))
        end = m.end() - (len(piece) - len(piece.rstrip(EDGES)))
        i = bisect.bisect_right(group_starts, begin)
        if begin < end and (end - begin >= LEAST_LENGTH or not i or groups[i - 1][1] <= begin):
            places.append((begin, end))
    for begin, end in sorted(places):
        i = int(np.searchsorted(starts, end))  # base spans that begin before the piece ends
        if i and reach[i - 1] > begin:
            continue
        before, after = context(text, begin, end)
        found.append({"kind": "", "begin": begin, "end": end, "value": value_of(text[begin:end]), "before": before, "after": after, "shape": shape_of(text[begin:end])})
    return found


def scan(docs: DataFrame, id_column: str | F.Column = "doc_id", text_column: str = "text") -> DataFrame:
    """Mentions of every row: row_, doc_id, mentions. The texts are read here once and not moved."""
    rows = keyed(docs, doc_id=id_column, text=text_column)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32())] + [(n, pa.string()) for n in ("value", "before", "after", "shape")]
        kind = pa.list_(pa.struct(fields))
        for batch in batches:
            for part in steps(batch, "text"):
                read = pa.array([mentions(t or "") for t in part.column("text").to_pylist()], kind)
                yield pa.RecordBatch.from_arrays([part.column("row_"), part.column("doc_id"), read], ["row_", "doc_id", "mentions"])

    return stage(rows.mapInArrow(found, f"row_ long, doc_id {dict(rows.dtypes)['doc_id']}, mentions array<{MENTION}>"), "mentions")


def confident_patterns(scanned: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confident: float = CONFIDENT) -> DataFrame:
    """Patterns (context, shape, kind, score) whose instances are seeds, or identifiers that other good patterns find.

    An instance is a value; it and a pattern are linked if the value stands in the pattern's context and has its shape, or
    the pattern is one of ``ANY_SHAPE``. A context gives a value the better of the two scores.
    Links are counted once whatever the number of places, and sums are formed before rows are moved, so that a frequent
    value or context is no heavier than a rare one.
    """
    flat = scanned.select(F.explode("mentions").alias("m")).select("m.*")
    contexts = F.array(F.concat(F.lit("<"), "before"), F.concat(F.lit(">"), "after"), F.concat_ws("|", "before", "after"))
    links = stage(
        flat.select("kind", "value", "shape", F.explode(contexts).alias("context"), "before", "after").filter(
            "length(context) > 2"
        ).groupBy("context", "shape", "value").agg(F.max("kind").alias("kind")),
        "links",
    )
    instances = links.select("value", "kind", F.lit(1.0).alias("trust")).filter("kind != ''").distinct().withColumnRenamed("kind", "as_kind")
    shapes = F.explode(F.array("shape", F.lit(ANY_SHAPE))).alias("shape")
    ways = links.select("context", shapes, "value", "kind")
    patterns = None
    for _ in range(rounds):
        # what a pattern finds, by kind: trusted, and in all
        per_kind = ways.join(instances, "value").groupBy("context", "shape", "as_kind").agg(F.sum("trust").alias("good"))
        whole = ways.groupBy("context", "shape").agg(F.count("*").alias("n"))
        patterns = stage(
            per_kind.join(whole, ["context", "shape"]).filter(F.col("n") >= support).select(
                "context", "shape", "as_kind", (F.col("good") / (F.col("n") + 1)).alias("score")
            ).filter(F.col("score") >= confident / 2),
            "patterns",
        )
        best = ways.filter("kind = ''").join(patterns, ["context", "shape"]).groupBy("value", "as_kind", "context").agg(F.max("score").alias("score"))
        found = best.groupBy("value", "as_kind").agg(
            (1 - F.exp(F.sum(F.log(1 - F.least("score", F.lit(0.99)))))).alias("trust")
        ).filter(F.col("trust") >= confident)
        seeds = links.filter("kind != ''").select("value", F.col("kind").alias("as_kind"), F.lit(1.0).alias("trust")).distinct()
        instances = stage(seeds.unionByName(found), "instances")
    return patterns.filter(F.col("score") >= confident)


def extract(docs: DataFrame, id_column: str | F.Column = "doc_id", text_column: str = "text") -> DataFrame:
    """Spans of each row: row_, doc_id, base and added, arrays of (begin, end, kind) in order."""
    scanned = scan(docs, id_column, text_column)
    patterns = confident_patterns(scanned)
    candidates = scanned.select("row_", F.explode(F.filter("mentions", lambda m: m["kind"] == "")).alias("m")).select("row_", "m.*")
    contexts = F.array(F.concat(F.lit("<"), "before"), F.concat(F.lit(">"), "after"), F.concat_ws("|", "before", "after"))
    ways = candidates.withColumn("context", F.explode(contexts)).withColumn("shape", F.explode(F.array("shape", F.lit(ANY_SHAPE))))
    hits = ways.join(patterns, ["context", "shape"]).groupBy("row_", "begin", "end").agg(
        F.max(F.struct("score", "as_kind")).alias("best")
    )
    added = hits.groupBy("row_").agg(
        F.array_sort(F.collect_list(F.struct("begin", "end", F.col("best.as_kind").alias("kind")))).alias("added")
    )
    spans = lambda array: F.transform(array, lambda m: F.struct(m["begin"].alias("begin"), m["end"].alias("end"), m["kind"].alias("kind")))
    base = scanned.select("row_", "doc_id", spans(F.filter("mentions", lambda m: m["kind"] != "")).alias("base"))
    return base.join(added, "row_", "left").withColumn("added", F.coalesce("added", F.array().cast("array<struct<begin:int,end:int,kind:string>>")))


def written(array) -> F.Column:
    """Spans as kind:begin:end, comma-joined, by begin, then kind as listed."""
    order = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    ordered = F.array_sort(F.transform(array, lambda s: F.struct(s["begin"].alias("begin"), order(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])), ",")


def report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Counts and spans of every row: the counts and the digest are those of the fixed patterns, ``spans`` has all."""
    found = extract(docs, id_column, text_column)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(written("base"), 256).alias("base_sha256"),
        written(F.concat("base", "added")).alias("spans"),
    )


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with each span, and spans that overlap as one, replaced by its kind in brackets."""
    out, at = [], 0
    for begin, end, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))):
        if begin >= at:
            out += [text[at:begin], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs``, every row and column of them, with the spans of the fixed patterns and the added ones replaced."""
    docs = fixed(docs)
    found = extract(docs, F.lit(0), text_column)
    added = stage(found.filter("size(added) > 0").select("row_", "added"), "added")
    # Spark broadcasts the added spans if the written table is small
    rows = keyed(docs, doc=F.struct(*docs.columns)).join(added, "row_", "left")

    @F.pandas_udf("string")
    def replaced(texts: pd.Series, more: pd.Series) -> pd.Series:
        return pd.Series([
            None if t is None else redacted(t, base_spans(t) + [(m["begin"], m["end"], m["kind"]) for m in (() if e is None else e)])
            for t, e in zip(texts, more, strict=True)
        ], dtype=object)

    text = replaced(F.col("doc")[text_column], F.col("added"))
    return rows.select(*[text.alias(c) if c == text_column else F.col("doc")[c].alias(c) for c in docs.columns])
