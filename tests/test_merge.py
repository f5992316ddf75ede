"""Folding of duplicates, order, filters and groups."""

import random

import pytest
from pyspark.sql import functions as F

from scanloom import schemas
from scanloom.functions.identity import finding_id, line_label, similarity_key
from scanloom.operators import filters, grouping, merge

STAGE = {"gosec": 0, "regex": 1, "ast": 2, "llm": 3}
BASE = dict(
    project="p", id="", title="Hardcoded Password", description="D", file_path="p/a.py", start_line=6, end_line=6,
    severity="high", confidence="", owasp_id="", cwe="", source="regex", code_snippet="", recommendation="",
    raw_output="",
)


@pytest.fixture
def findings_of(spark):
    def make(*changes):
        rows = []
        for n, change in enumerate(changes):
            row = {**BASE, **change}
            rows.append((*[row[c] for c in schemas.FINDING_COLUMNS], (STAGE[row["source"]], change.get("a", n), 0)))
        return spark.createDataFrame(rows, schemas.FINDINGS)

    return make


def one(table):
    rows = merge.merge_findings(table).collect()
    assert len(rows) == 1
    return rows[0]


def test_model_finding_is_folded_into_the_static_one(findings_of):
    model = dict(source="llm", title=" hardcoded password ", description="L", severity="critical", start_line=9,
                 end_line=9, recommendation="R", owasp_id="A07", cwe="C1")
    row = one(findings_of({}, model))
    assert row.description == "L\n\nStatic Analysis: D" and row.raw_output == "\n[Also detected by llm]"
    assert (row.severity, row.source, row.start_line, row.title) == ("critical", "regex", 6, "Hardcoded Password")
    assert (row.recommendation, row.owasp_id, row.cwe) == ("R", "A07", "C1")

    again = one(findings_of({}, model, {**model, "description": "M", "recommendation": "S", "owasp_id": "A01"}))
    assert again.description == "M\n\nStatic Analysis: L\n\nStatic Analysis: D"
    assert again.raw_output == "\n[Also detected by llm]" * 2
    assert (again.recommendation, again.owasp_id) == ("R", "A07")


def test_empty_descriptions_are_replaced_not_joined(findings_of):
    model = dict(source="llm")
    row = one(findings_of({"description": ""}, {**model, "description": ""}, {**model, "description": "L"},
                          {**model, "description": ""}))
    assert row.description == "\n\nStatic Analysis: L"
    assert one(findings_of({"description": ""}, {**model, "description": ""})).description == ""
    assert one(findings_of({"recommendation": "keep"}, {**model, "recommendation": "x"})).recommendation == "keep"


def test_model_findings_alone_keep_the_first(findings_of):
    row = one(findings_of({"source": "llm", "description": "first", "recommendation": ""},
                          {"source": "llm", "description": "second", "recommendation": "late", "severity": "critical"}))
    assert (row.description, row.recommendation, row.raw_output, row.severity) == ("first", "", "", "critical")


def test_sources_are_listed_in_merge_order(findings_of):
    row = one(findings_of({"source": "llm", "a": 0}, {"source": "ast", "a": 5}, {"source": "regex", "a": 9},
                          {"source": "ast", "a": 6}))
    assert row.source == "regex"
    assert row.raw_output == "\n[Also detected by ast]" * 2 + "\n[Also detected by llm]"


def test_unknown_severity_ranks_lowest_and_the_first_one_stays(findings_of):
    assert one(findings_of({"severity": "odd"}, {"severity": "strange"})).severity == "odd"
    assert one(findings_of({"severity": "odd"}, {"severity": "info"})).severity == "info"
    assert one(findings_of({"severity": "low"}, {"severity": "odd"})).severity == "low"


def test_buckets(spark):
    rows = [(4, 4), (5, 5), (-3, 0), (0, 4), (-5, -5), (9, 12)]
    table = spark.createDataFrame(rows, "s bigint, e bigint")
    keys = table.select(
        similarity_key(F.lit("f"), F.col("s"), F.col("e"), F.lit("  Title \t")).alias("k")
    ).collect()
    assert [r.k for r in keys] == ["f:0-0:title", "f:5-5:title", "f:0-0:title", "f:0-0:title", "f:-5--5:title",
                                   "f:5-10:title"]


def test_id_and_label(spark):
    import hashlib

    row = spark.range(1).select(
        finding_id(F.lit("p/a.go"), F.lit(3), F.lit(4), F.lit("T"), F.lit("ast")).alias("id"),
        line_label(F.lit(3), F.lit(3)).alias("one"),
        line_label(F.lit(3), F.lit(4)).alias("two"),
    ).first()
    assert row.id == hashlib.md5(b"p/a.go:3:4:T:ast").hexdigest()[:16]
    assert (row.one, row.two) == ("Line: 3", "Lines: 3-4")


def fold(rows):
    """The rule of each step, applied one duplicate after the other."""
    rank = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}
    kept = dict(rows[0])
    for new in rows[1:]:
        if new["source"] == "llm" and kept["source"] != "llm":
            old = kept["description"]
            kept["description"] = new["description"] + ("\n\nStatic Analysis: " + old if old else "")
            kept["recommendation"] = kept["recommendation"] or new["recommendation"]
        if new["source"] != kept["source"]:
            kept["raw_output"] += f"\n[Also detected by {new['source']}]"
        if rank.get(new["severity"], 0) > rank.get(kept["severity"], 0):
            kept["severity"] = new["severity"]
        kept["owasp_id"] = kept["owasp_id"] or new["owasp_id"]
        kept["cwe"] = kept["cwe"] or new["cwe"]
    return kept


def test_random_groups_match_a_step_by_step_fold_for_any_partitioning(spark):
    rng = random.Random(7)
    rows = []
    for n in range(600):
        # One key takes a third of all rows.
        key = 0 if n % 3 == 0 else rng.randrange(1, 60)
        rows.append(
            {**BASE, "file_path": f"p/{key}", "source": rng.choice(["regex", "ast", "llm", "llm"]),
             "title": rng.choice(["T", " t", "T "]), "description": rng.choice(["", f"d{n}"]),
             "recommendation": rng.choice(["", f"r{n}"]), "severity": rng.choice(["critical", "low", "info", "odd"]),
             "owasp_id": rng.choice(["", f"o{n}"]), "cwe": rng.choice(["", f"c{n}"]), "n": n}
        )
    wanted = {}
    for row in sorted(rows, key=lambda r: (STAGE[r["source"]], r["n"])):
        wanted.setdefault(row["file_path"], []).append(row)
    wanted = {path: fold(group) for path, group in wanted.items()}
    data = [(*[r[c] for c in schemas.FINDING_COLUMNS], (STAGE[r["source"]], r["n"], 0)) for r in rows]
    table = spark.createDataFrame(data, schemas.FINDINGS)
    checked = ["source", "title", "description", "recommendation", "severity", "owasp_id", "cwe", "raw_output"]
    for parts in (1, 7):
        got = {r.file_path: r for r in merge.merge_findings(table.repartition(parts)).collect()}
        assert got.keys() == wanted.keys()
        for path, row in got.items():
            assert [row[c] for c in checked] == [wanted[path][c] for c in checked]


def test_merging_merged_findings_changes_nothing(findings_of):
    table = findings_of({}, {"source": "llm", "description": "L"}, {"start_line": 20, "end_line": 20}, {"title": "x"})
    once = merge.merge_findings(table)
    assert sorted(merge.merge_findings(once).collect()) == sorted(once.collect())


def test_order_filters_and_groups(findings_of, spark):
    table = merge.with_similarity_key(findings_of(
        {"severity": "low", "file_path": "p/b"}, {"severity": "critical", "file_path": "p/c", "start_line": 3000},
        {"severity": "critical", "file_path": "p/c", "start_line": 2}, {"severity": "odd", "file_path": "p/a"},
        {"severity": "high", "file_path": "p/c", "start_line": -7},
    )).drop("key")
    ordered = [(r.severity, r.start_line) for r in merge.sort_findings(table).collect()]
    assert ordered == [("critical", 2), ("critical", 3000), ("high", -7), ("low", 6), ("odd", 6)]
    assert filters.filter_by_min_severity(table, "high").count() == 3
    assert filters.filter_by_min_severity(table, "nonsense").count() == 5
    assert filters.filter_critical(table).count() == 2 and filters.filter_path_contains(table, "/b").count() == 1
    wanted = spark.createDataFrame([("p/c",), ("p/zz",)], "file_path string")
    assert filters.filter_by_files(table, wanted).count() == 3
    assert filters.filter_by_files(table, wanted.limit(0)).count() == 5
    assert filters.keep_matching(table, wanted, ["file_path"], broadcast_bytes=0).count() == 3
    assert [(r.severity, r.n) for r in grouping.count_by_severity(table).collect()] == [
        ("critical", 2), ("high", 1), ("low", 1), ("odd", 1)
    ]
    numbers = {(r.file_path, r.start_line): (r.number, r.file_findings) for r in grouping.group_by_file(table).collect()}
    assert numbers[("p/c", 2)] == (1, 3) and numbers[("p/c", 3000)] == (2, 3) and numbers[("p/c", -7)] == (3, 3)
    assert {r.severity: r.severity_findings for r in grouping.group_by_severity(table).collect()}["critical"] == 2
