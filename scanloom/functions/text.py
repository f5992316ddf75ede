"""Text expressions with the case, trim and line rules the results depend on."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Unicode white space, which trimming and field splitting treat alike.
UNICODE_SPACE = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def simple_lower(text: Column) -> Column:
    """Lower case one character at a time: no special dotted I and no final sigma."""
    return F.lower(F.replace(F.replace(text, F.lit("\u0130"), F.lit("i")), F.lit("\u03a3"), F.lit("\u03c3")))


# Helper column with the content in lower case, shared by the steps that need it.
LOW = "_low"


def with_lower(files: DataFrame) -> DataFrame:
    return files if LOW in files.columns else files.withColumn(LOW, simple_lower(F.col("content")))


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{UNICODE_SPACE}++|{UNICODE_SPACE}++\z", "")


def contains_any(text: Column, words: list[str]) -> Column:
    # a word that holds another one finds nothing more
    needed = [w for w in dict.fromkeys(words) if not any(v != w and v in w for v in words)]
    return reduce(or_, [F.contains(text, F.lit(w)) for w in needed])


def count_newlines(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))


def source_lines(content: Column) -> Column:
    """Lines of a file: no element for the empty tail after the last newline, one trailing CR cut from each."""
    parts = F.split(content, "\n", -1)
    kept = F.when(F.endswith(content, F.lit("\n")) | (content == ""), F.slice(parts, F.lit(1), F.size(parts) - 1))
    return F.transform(
        kept.otherwise(parts),
        lambda line: F.when(F.endswith(line, F.lit("\r")), F.left(line, F.length(line) - 1)).otherwise(line),
    )


def filled(template: str, **values: Column) -> Column:
    """The template with each ``{name}`` replaced by the value of that name; other braces stay."""
    pieces = re.split("{(" + "|".join(values) + ")}", template)
    return F.concat(*[values[piece] if i % 2 else F.lit(piece) for i, piece in enumerate(pieces) if i % 2 or piece])
