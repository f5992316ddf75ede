"""Line rules given as a table."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom import schemas
from scanloom.functions import catalog
from scanloom.functions.patterns import java_line_pattern
from scanloom.functions.token_patterns import token_regex
from scanloom.operators.lines import with_line_hits
from scanloom.operators.rule_index import required_texts, with_indexed_hits
from scanloom.operators.scan import findings_of, union_finding_groups

# Rules that one pass over the files tries without an index, and rules from which an index is made.
BLOCK_RULES, INDEX_RULES = 100, 500


def rule_catalog(spark: SparkSession) -> DataFrame:
    """The built-in rules as a table, ``position`` giving their order."""
    rows = [(n, *rule) for n, rule in enumerate(catalog.LINE_RULES + catalog.TOKEN_RULES, start=1)]
    return spark.createDataFrame(rows, f"position int, {schemas.RULES}")


def read_rules(rules: DataFrame, read: Callable[[str, str], str] = java_line_pattern) -> tuple[list[tuple], dict[str, str]]:
    """Rules of a table in the form the scans take, and what is wrong with the others, by rule id.

    They are ordered by ``position`` if there is such a column, else by rule id. Missing texts are empty. A rule whose id
    is missing, or is that of an earlier or of a built-in rule, goes by its place in the table. One that is equal to a
    built-in rule is that rule, which the scans run anyway. A rule without a pattern, or with one that can't be read, is
    left out of the first and named in the second.
    """
    good: list[tuple] = []
    wrong: dict[str, str] = {}
    taken = {rule[0] for rule in catalog.LINE_RULES + catalog.TOKEN_RULES} | {""}
    for number, (rule, error) in enumerate(_checked(rules, read), start=1):
        own = rule if rule[0] not in taken else (f"#{number}", *rule[1:])
        if error:
            wrong[rule[0] if rule[0] not in wrong else f"#{number}"] = error
        elif rule not in catalog.LINE_RULES:
            taken.add(own[0])
            good.append(own)
    return good, wrong


def read_token_rules(rules: DataFrame) -> tuple[list[tuple], dict[str, str]]:
    """The same for token rules, whose patterns are those of ``functions.token_patterns``."""
    return read_rules(rules, lambda pattern, _: token_regex(pattern))


def _checked(rules: DataFrame, read: Callable[[str, str], str] = java_line_pattern) -> list[tuple[tuple, str]]:
    """All rules of a table in their order, each with what is wrong with its pattern; that is empty for most."""
    compile_pattern = rules.sparkSession.sparkContext._jvm.java.util.regex.Pattern.compile
    order = [c for c in ("position", "rule_id") if c in rules.columns]
    out = []
    for row in rules.orderBy(*order, "pattern").select(*catalog.RULE_COLUMNS).collect():
        rule, wrong = tuple(value or "" for value in row), ""
        try:
            if not rule[3]:
                raise ValueError("no pattern")
            compile_pattern(read(rule[3], rule[0]))
        except Exception as error:  # the reader's own errors and those of the pattern compiler
            wrong = (str(getattr(error, "java_exception", error)).splitlines() or [type(error).__name__])[0]
        out.append((rule, wrong))
    return out


def regex_scan_rule_table(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings of user-supplied rules; ``rules`` needs the catalog columns, and ``position`` if order matters.

    The rules become part of the expression, in blocks: each is one pass over the files, in which a file is tested as a
    whole first and nothing is joined or shuffled. From ``INDEX_RULES`` rules on, those whose matches must hold a known text
    are looked up in an index instead, in one pass however many they are. Rules go by their place in the table, so that
    those with a repeated, missing or built-in id all run. What can't be read is left out with a warning that names it. The
    table is held on the driver, as patterns have to be read there.
    """
    good: list[tuple[int, tuple]] = []
    for number, (rule, error) in enumerate(_checked(rules), start=1):
        if error:
            warnings.warn(f"rule {number} ({rule[0]!r}) is left out: {error}", stacklevel=2)
        else:
            built_in = rule in catalog.LINE_RULES and all(rule != other for _, other in good)
            good.append((number, rule if built_in else (f"#{number}", *rule[1:])))
    texts = {n: required_texts(rule[3]) for n, rule in good} if len(good) >= INDEX_RULES else {}
    indexed = [(n, rule) for n, rule in good if texts.get(n)]
    others = [(n, rule) for n, rule in good if not texts.get(n)]
    groups = []
    if indexed:
        hits = with_indexed_hits(files, indexed, [texts[n] for n, _ in indexed])
        table = files.sparkSession.createDataFrame([rule for _, rule in indexed], schemas.RULES)
        groups.append(findings_of(hits, texts=table))
    for start in range(0, len(others) if indexed else max(1, len(others)), BLOCK_RULES):
        block = others[start : start + BLOCK_RULES]
        own = [rule for _, rule in block if rule not in catalog.LINE_RULES]
        hits = with_line_hits(files, rules=[rule for _, rule in block], built_in=False).withColumnRenamed("line_hits", "hits")
        found = findings_of(hits, own)
        if block:
            number = F.get(F.array(*[F.lit(n).cast("bigint") for n, _ in block]), (F.col("ord.b") - 1).cast("int"))
            found = found.withColumn("ord", F.struct(F.col("ord.stage").alias("stage"), F.col("ord.a").alias("a"), number.alias("b")))
        groups.append(found)
    return union_finding_groups(*groups)
