"""Giant files in segments: the rows of the uncut file."""

import random

import pytest
from pyspark.sql import functions as F

from checks import corpus
from scanloom.operators import lines, scan, segments, tokens

DECLARATIONS = [s for s in corpus.SNIPPETS] + [
    "func a() {\n\tx := `raw\nfunc b() {\n` + \"s\\\nfunc c() {\"\n\trand.Int()\n}", "/* open\nfunc d() {\n*/\nvar e, _ = f()",
    "// it's\nfunc g() { _ = h() }", "var (\n\ti, _ = j()\n\tk = func() { _ = l() }\n)", "func m(\n) {\n\tn, _ := o()\n}\n// doc\n// more",
    "const p = '\\''\ntype q struct {\n\tr int\n}", "x,\nfunc s() {}", "a, // b\nvar c = 1", "if password == \"\"\n{ }", "rand.\nfunc (", "\"unterminated\nfunc t() {}",
    "}\nfunc u() {}\n{", "é := 漢字; _ = é", "\r\nfunc v() {\r\n\t_ = w()\r\n}\r",
]


def giant(seed: int, parts: int, ending: str = "") -> str:
    rng = random.Random(seed)
    return "".join(rng.choice(DECLARATIONS) + rng.choice(["\n", "\n\n", "\n\t\n"]) for _ in range(parts)) + ending


@pytest.fixture(scope="module")
def files(spark):
    balanced = [d for d in DECLARATIONS if all(d.count(a) == d.count(b) for a, b in ("()", "[]", "{}"))]
    rng = random.Random(9)
    contents = {f"{k}.go": giant(k, 60) for k in range(4)} | {
        "open.go": giant(7, 30) + "/* never closed\nfunc z() { _ = y() }\n" + giant(8, 30).replace("*/", "") , "raw.go": giant(9, 20) + "`\nfunc z() {}\nvar a, _ = b()",
        "paired.go": "".join(rng.choice(balanced) + "\n" for _ in range(150)), "one.go": "func a() {\n" + "\t_ = b()\n" * 600 + "}",
        "x.py": giant(5, 80), "y.GO": giant(6, 80, "\n\n"), "long.js": "password = \"abcd\" " * 300, "small.go": "var a = rand.Int()", "empty.go": "", "nl.py": "\n" * 700,
    }
    rows = [("p", path, content) for path, content in contents.items()]
    return spark.createDataFrame(rows, "project string, path string, content string")


def rows(table):
    return sorted(map(tuple, table.collect()))


def test_segments_put_together_are_the_file(files):
    parts = segments.file_segments(files, 300 * segments.BLOCKS).collect()
    contents = {r.path: r.content for r in files.collect()}
    for path, content in contents.items():
        mine = sorted((r.segment, r.first_line, r.content) for r in parts if r.path == path)
        assert "".join(m[2] for m in mine) == content
        line = 0
        for _, first_line, text in mine:
            assert first_line == line
            line += text.count("\n")
    count = {path: len([r for r in parts if r.path == path]) for path in contents}
    assert count["paired.go"] > 5 and count["x.py"] > 5 and count["one.go"] == 1 and count["empty.go"] == 0


def test_lines_of_giant_files(files):
    assert rows(lines.explode_lines(files, giant_bytes=4000)) == rows(lines.explode_lines(files))


def test_tokens_of_giant_files(files):
    assert rows(tokens.go_tokens(files, giant_bytes=4000)) == rows(tokens.go_tokens(files))


def test_findings_of_giant_files(files):
    paired = files.where(~F.col("path").rlike("^([0-9]|open|raw)"))
    columns = ["file_path", "title", "start_line", "code_snippet", "ord"]
    for table, find in ((files, scan.regex_scan), (paired, scan.token_scan), (paired, scan.static_scan)):
        want = rows(find(table).select(*columns))
        assert rows(find(table, giant_bytes=4000).select(*columns)) == want and len(want) > 20
    limited = rows(scan.static_scan(paired, line_byte_limit=2000).select(*columns))
    assert rows(scan.static_scan(paired, line_byte_limit=2000, giant_bytes=4000).select(*columns)) == limited


def test_states_and_depths_of_a_block():
    facts = segments.block_facts("x */ func(`a\n", segments.COMMENT)
    assert facts == (segments.RAW, (1, 0, 0), {})
    assert segments.block_facts("}\nfunc a() {\n}\nvar b\n", segments.CODE) == (segments.CODE, (0, 0, -1), {(0, 0, -1): 2})
    assert segments.block_facts("a,\nvar b\n", segments.CODE)[2] == {}
