"""Thousands of line rules in one pass: an index from texts that a match must hold to the rules that ask for them.

A file is read once against all these texts together, which takes time by its length and not by the number of rules. Only
the rules whose texts it holds are tried as patterns, on the whole file and then on its lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions import catalog
from scanloom.functions.once import computed_once
from scanloom.functions.patterns import java_line_pattern
from scanloom.functions.required import BLANKS, required_texts
from scanloom.functions.text import source_lines

__all__ = ["candidates", "folded", "required_texts", "with_indexed_hits"]

_BLANKS = dict.fromkeys(map(ord, BLANKS), " ")


def folded(text: str) -> str:
    """Lower case, with the two other characters that fold into ASCII letters, and blanks for white space in a line."""
    return text.translate(_BLANKS).lower().replace("ſ", "s").replace("K", "k")


def candidates(content: Column, texts: list[frozenset[str]]) -> Column:
    """Numbers of the entries of ``texts`` of which the content holds one, in order."""
    wanted: dict[str, list[int]] = {}
    for number, group in enumerate(texts):
        for text in group:
            wanted.setdefault(text, []).append(number)

    @F.pandas_udf("array<int>")
    def held(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = ahocorasick.Automaton()
        for text, numbers in wanted.items():
            automaton.add_word(text, (text, numbers))
        automaton.make_automaton()

        def search(content: str | None) -> list[int]:
            found = dict(value for _, value in automaton.iter(folded(content))) if content else {}
            return sorted({n for numbers in found.values() for n in numbers})

        for batch in batches:
            yield batch.map(search, na_action=None)

    return held(content)


def with_indexed_hits(files: DataFrame, rules: list[tuple[int, tuple]], texts: list[frozenset[str]]) -> DataFrame:
    """Adds ``hits`` of numbered rules, by line and then by number; ``texts`` are what they require, rule by rule."""
    patterns = F.array(*[F.lit(java_line_pattern(rule[3], rule[0])) for _, rule in rules])
    numbers = F.array(*[F.lit(number) for number, _ in rules])
    ids = F.array(*[F.lit(rule[0]) for _, rule in rules])
    matches = lambda text, k: F.regexp_instr(text, F.get(patterns, k)) > 0  # noqa: E731 - keeps its last pattern compiled
    tried = files.withColumn("_rules", candidates(F.col("content"), texts)).where(F.size("_rules") > 0)
    tried = tried.withColumn("_matched", F.filter("_rules", lambda k: matches(F.col("content"), k)))
    tried = computed_once(tried, "_matched").where(F.size("_matched") > 0)
    tried = computed_once(tried.withColumn("_lines", source_lines(F.col("content"))), "_lines")

    def of_rule(k: Column) -> Column:
        def on_line(line: Column, index: Column) -> Column:
            line_no = (index + 1).cast("bigint")
            return F.when(matches(line, k), F.struct(
                F.lit(catalog.SOURCE_STAGE["regex"]).alias("stage"), line_no.alias("a"), F.get(numbers, k).cast("bigint").alias("b"),
                line_no.alias("line"), F.get(ids, k).alias("rule_id"), line.alias("snippet"),
            ))

        return F.filter(F.transform("_lines", on_line), lambda hit: hit.isNotNull())

    hits = F.sort_array(F.flatten(F.transform("_matched", of_rule)))
    return tried.withColumn("hits", hits).drop("_rules", "_matched", "_lines")
