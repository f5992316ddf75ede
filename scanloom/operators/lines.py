"""Line rules. Every file is checked inside its own row: no shuffle, and content never leaves the scan stage."""

from __future__ import annotations

from collections import Counter
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions import catalog
from scanloom.functions.patterns import java_line_pattern
from scanloom.functions.required import BLANKS, required_texts
from scanloom.functions.text import LOW, contains_any, source_lines, with_lower
from scanloom.operators.segments import file_segments, is_giant

ALL_RULES = [rule[0] for rule in catalog.LINE_RULES]

HITS = "array<struct<stage:int,a:bigint,b:bigint,line:bigint,rule_id:string,snippet:string>>"


def explode_lines(files: DataFrame, giant_bytes: int | None = None, folder: str | None = None) -> DataFrame:
    """``(project, path, line_no, line)``, lines counted from 1.

    Files of ``giant_bytes`` or more are cut into segments that are dealt to many tasks and staged in ``folder``.
    """
    if giant_bytes is None:
        return _lines(files, F.lit(0))
    giant = is_giant(F.col("content"), giant_bytes)
    return _lines(files.where(~giant), F.lit(0)).unionByName(_lines(file_segments(files.where(giant), giant_bytes, folder), F.col("first_line")))


def _lines(files: DataFrame, before: Column) -> DataFrame:
    exploded = files.select("project", "path", before.alias("before"), F.posexplode(source_lines(F.col("content"))).alias("pos", "line"))
    return exploded.select("project", "path", (F.col("pos") + 1 + F.col("before")).cast("bigint").alias("line_no"), "line")


def has_oversize_line(content: Column, limit: int = catalog.LINE_BYTE_LIMIT) -> Column:
    """Whether a line (with its CR, without its newline) reaches the byte limit."""
    return (F.octet_length(content) >= limit) & F.exists(
        F.split(content, "\n", -1), lambda line: F.octet_length(line) >= limit
    )


def oversize_line_guard(files: DataFrame, limit: int = catalog.LINE_BYTE_LIMIT) -> DataFrame:
    """Files without a line that reaches the byte limit."""
    return files.where(~has_oversize_line(F.col("content"), limit))


# Texts that begin alike, from which on their beginning is searched first.
SHARED = 4


def _stem(text: str) -> str:
    """What is searched for before a text: a letter outside ASCII, which is rare in most files, or how it begins."""
    return next((char for char in text if char > "\x7f"), text[:4])


def _own_texts(rule: tuple) -> list[str]:
    """Texts, folded, of which a file with a match of a rule of a user holds one; none if that isn't known."""
    return sorted(required_texts(rule[3], least=2) or []) if rule not in catalog.LINE_RULES else []


def _may_match(rule: tuple, pattern: str, low: Column, content: Column, stems: dict[str, Column] | None = None) -> Column:
    """Exact test that some line of the file matches: plain substring search first, the pattern only after it."""
    test = content.rlike(pattern)
    if rule not in catalog.LINE_RULES:
        held = [F.contains(low, F.lit(text)) for text in _own_texts(rule)]
        held = [(stems or {}).get(_stem(text), F.lit(True)) & found for text, found in zip(_own_texts(rule), held, strict=True)]
        return reduce(or_, held) & test if held else test
    if rule[0] in catalog.LINE_RULE_SECOND_ANCHOR:
        test = F.contains(content, F.lit(catalog.LINE_RULE_SECOND_ANCHOR[rule[0]])) & test
    return contains_any(low, catalog.LINE_RULE_ANCHORS[rule[0]]) & test


def matching(line: Column, tests: list) -> Column:
    """Positions of the tests that a line passes."""
    return F.filter(
        F.array(*[F.when(test(line), F.lit(k)) for k, test in enumerate(tests)]), lambda k: k.isNotNull()
    )


def with_line_hits(
    files: DataFrame,
    rule_ids: list[str] | None = None,
    line_byte_limit: int | None = None,
    rules: list[tuple] | None = None,
    built_in: bool = True,
) -> DataFrame:
    """Adds ``line_hits``: the matches of the line rules, by line and then by rule order.

    The file is first tested as a whole, which for most files settles every rule without cutting lines.
    Only files and rules that do match are tried line by line. ``rules`` come after the built-in ones and have the
    columns of the catalog. With ``line_byte_limit`` one line of that length takes all line findings of its file away.
    """
    named = (catalog.LINE_RULES if built_in else []) + list(rules or [])
    rules = [
        (number, rule[0], java_line_pattern(rule[3], rule[0]), rule)
        for number, rule in enumerate(named, start=1)
        if rule_ids is None or rule[0] in rule_ids
    ]
    if not rules:
        return files.withColumn("line_hits", F.array().cast(HITS))
    content, low, maybe = F.col("content"), F.col(LOW), F.col("_maybe")
    tested, stems = with_lower(files), {}
    if any(rule not in catalog.LINE_RULES for *_, rule in rules):
        folded = F.replace(low, F.lit("\u017f"), F.lit("s"))
        for blank in BLANKS:
            folded = F.replace(folded, F.lit(blank), F.lit(" "))
        low = F.col("_folded")
        counted = Counter(stem for *_, rule in rules for stem in {_stem(text) for text in _own_texts(rule)})
        shared = [stem for stem, n in counted.items() if n >= SHARED]
        stems = {stem: F.get(F.col("_stems"), F.lit(k)) for k, stem in enumerate(shared)}
        tested = tested.withColumn("_folded", folded)
        if shared:
            tested = tested.withColumn("_stems", F.array(*[F.contains(low, F.lit(stem)) for stem in shared]))
    tested = tested.withColumn(
        "_maybe", F.array(*[_may_match(rule, pattern, low, content, stems) for _, _, pattern, rule in rules])
    )

    tests = [
        lambda line, k=k, pattern=pattern: F.get(maybe, F.lit(k)) & line.rlike(pattern)
        for k, (_, _, pattern, _) in enumerate(rules)
    ]

    def on_line(line: Column, index: Column) -> Column:
        matched = matching(line, tests)
        line_no = (index + 1).cast("bigint")
        numbers, ids = (F.array(*[F.lit(r[i]) for r in rules]) for i in (0, 1))
        return F.transform(
            matched,
            lambda k: F.struct(
                F.lit(catalog.SOURCE_STAGE["regex"]).alias("stage"),
                line_no.alias("a"),
                F.get(numbers, k).cast("bigint").alias("b"),
                line_no.alias("line"),
                F.get(ids, k).alias("rule_id"),
                line.alias("snippet"),
            ),
        )

    any_rule = reduce(or_, [F.get(maybe, F.lit(k)) for k in range(len(rules))])
    if line_byte_limit is not None:
        any_rule = any_rule & ~has_oversize_line(content, line_byte_limit)
    hits = F.when(any_rule, F.flatten(F.transform(source_lines(content), on_line))).otherwise(F.array().cast(HITS))
    return tested.withColumn("line_hits", hits).select(*files.columns, "line_hits")
