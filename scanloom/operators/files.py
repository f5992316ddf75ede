"""File level: language, ignore rules and profile. All narrow; nothing here moves file content."""

from __future__ import annotations

import re
from functools import reduce
from itertools import chain
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions import catalog
from scanloom.functions.patterns import glob_regex
from scanloom.functions.text import LOW, contains_any, count_newlines, simple_lower, with_lower


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def language_of(path: Column) -> Column:
    """Language by the last extension of the file name, in any letter case; empty when unknown."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(catalog.LANGUAGE_BY_EXTENSION.items())])
    extension = F.lower(F.regexp_extract(path, r"(\.[^./]*)\z", 1))
    return F.coalesce(F.try_element_at(table, extension), F.lit(""))


def is_ignored(path: Column, patterns: list[str]) -> Column:
    """Whether a project-relative path, or a directory above it, falls under the ignore rules.

    A pattern ignores what starts with it (``test`` drops ``testing/x.go`` too) and, as a glob, whole paths
    and directories. The built-in names ignore every path that holds them anywhere.
    """
    tests = [contains_any(path, catalog.ALWAYS_IGNORED)]
    for pattern in (p.removesuffix("/") for p in patterns):
        glob = glob_regex(pattern)
        # The top directory itself is tested under the name ".".
        if ".".startswith(pattern) or (glob and re.fullmatch(glob, ".", re.S)):
            return F.lit(True)
        tests.append(F.startswith(path, F.lit(pattern)))
        if glob and glob != re.escape(pattern):
            tests.append(path.rlike(rf"\A{glob}(?:/|\z)"))
    return reduce(or_, tests)


def detect_language(files: DataFrame) -> DataFrame:
    return files.withColumn("language", language_of(F.col("path")))


def filter_languages(files: DataFrame, languages: list[str] | None = None) -> DataFrame:
    wanted = catalog.DEFAULT_LANGUAGES if languages is None else languages
    return files.where(language_of(F.col("path")).isin([w for w in wanted if w]))


def filter_ignored_paths(files: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    return files.where(~is_ignored(F.col("path"), catalog.DEFAULT_IGNORE if patterns is None else patterns))


def select_files(
    files: DataFrame, languages: list[str] | None = None, ignore: list[str] | None = None
) -> DataFrame:
    """Files a deep or smart scan looks at."""
    return filter_languages(filter_ignored_paths(files, ignore), languages)


def lines_of_code(content: Column) -> Column:
    return (count_newlines(content) + 1).cast("bigint")


def has_risky_name(path: Column) -> Column:
    return contains_any(simple_lower(base_name(path)), catalog.RISKY_NAMES)


def with_content_flags(files: DataFrame) -> DataFrame:
    """Adds ``loc``, ``has_crypto``, ``has_database``, ``has_auth``; the content is lower-cased once."""
    low = F.col(LOW)
    flags = [
        lines_of_code(F.col("content")).alias("loc"),
        contains_any(low, catalog.CRYPTO_WORDS).alias("has_crypto"),
        contains_any(low, catalog.DATABASE_WORDS).alias("has_database"),
        contains_any(low, catalog.AUTH_WORDS).alias("has_auth"),
    ]
    return with_lower(files).select(*files.columns, *flags)


def file_loc(files: DataFrame) -> DataFrame:
    return files.select("project", "path", lines_of_code(F.col("content")).alias("loc"))


def _flag(files: DataFrame, name: str, words: list[str]) -> DataFrame:
    return files.select("project", "path", contains_any(simple_lower(F.col("content")), words).alias(name))


def flag_crypto(files: DataFrame) -> DataFrame:
    return _flag(files, "has_crypto", catalog.CRYPTO_WORDS)


def flag_database(files: DataFrame) -> DataFrame:
    return _flag(files, "has_database", catalog.DATABASE_WORDS)


def flag_auth(files: DataFrame) -> DataFrame:
    return _flag(files, "has_auth", catalog.AUTH_WORDS)


def flag_risky_name(files: DataFrame) -> DataFrame:
    return files.select("project", "path", has_risky_name(F.col("path")).alias("risky_name"))


def file_profile(files: DataFrame) -> DataFrame:
    """One row per file: language, lines of code and content flags, without the content."""
    return with_content_flags(detect_language(files)).select(
        "project", "path", "language", "loc", "has_crypto", "has_database", "has_auth",
        has_risky_name(F.col("path")).alias("risky_name"),
    )
