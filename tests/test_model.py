"""Model responses: what counts as an answer, retries, prompts; and the diff parsers."""

import json

import pytest
from pyspark.sql import functions as F

from scanloom.operators import model, scan
from scanloom.operators.risk import scanned_files
from scanloom.schemas import MODEL_RESPONSES
from scanloom.sources.diffs import diff_hunk_ranges, read_changed_files
from scanloom.sources.responses import read_model_responses, unreadable_responses

ITEM = '{"title":"x","line_start":3,"line_end":4}'
FENCED = f"```json\n[{ITEM}]\n```"


def body(provider, text):
    return json.dumps(
        {
            "openai": {"choices": [{"message": {"content": text}}], "usage": {"total_tokens": 7}},
            "gemini": {"candidates": [{"content": {"parts": [{"text": text}]}}],
                       "usageMetadata": {"promptTokenCount": 2, "candidatesTokenCount": 3, "totalTokenCount": 99}},
            "anthropic": {"content": [{"text": text}], "usage": {"input_tokens": 1, "output_tokens": 2}},
        }[provider]
    )


# text -> number of findings for openai and for the two trimming providers; None is a failed attempt
TEXTS = {
    "[]": (0, 0),
    " null ": (0, 0),
    f"[{ITEM},{ITEM}]": (2, 2),
    FENCED: (1, 1),
    f"```\n[{ITEM}]```": (1, 1),
    "\n" + FENCED + "\n": (None, 1),
    " " + FENCED: (None, 1),
    "[] x": (None, None),
    "[],[]": (None, None),
    "[]],[[": (None, None),
    "": (None, None),
    "```": (None, None),
    "```json": (None, None),
    ITEM: (None, None),
    '"text"': (None, None),
    '[{"line_start":"3"}]': (None, None),
    '[{"line_start":3.0}]': (None, None),
    '[{"line_start":3e0}]': (None, None),
    '[{"line_start":99999999999999999999}]': (None, None),
    '[{"line_start":true}]': (None, None),
    '[{"title":1}]': (None, None),
    '[{"title":["a"]}]': (None, None),
    '[{"title":null,"line_start":null,"other":{"a":[1,2]}}]': (1, 1),
    "[1]": (None, None),
    "[[]]": (None, None),
    "[null]": (1, 1),
    "[{}]": (1, 1),
    f"[{ITEM},1]": (None, None),
    '[{"title":"a" "b"}]': (None, None),
    '[{title:"a"}]': (None, None),
    "[{'title':'a'}]": (None, None),
    '[{"line_start":01}]': (None, None),
    "[NaN]": (None, None),
}


@pytest.fixture
def responses_of(spark):
    def make(*rows):
        return spark.createDataFrame([("p", *r) for r in rows], MODEL_RESPONSES)

    return make


def test_every_text_is_judged_as_expected(responses_of):
    providers = ["openai", "gemini", "anthropic"]
    rows = [(f"{i}", p, 0, 200, body(p, text)) for i, text in enumerate(TEXTS) for p in providers]
    got = {(r.path, r.provider): None if r.items is None else len(r.items)
           for r in model.with_model_items(responses_of(*rows)).collect()}
    for i, (text, (plain, trimmed)) in enumerate(TEXTS.items()):
        for provider in providers:
            assert got[(f"{i}", provider)] == (plain if provider == "openai" else trimmed), (provider, text)


def test_fields_of_items(responses_of):
    text = ('[{"Title":"upper","LINE_START":5},{"title":"a","title":"last","line_start":-3,"line_end":2},null,'
            '{"deſcription":"folded","Kwe":"no","severity":"Moderate","cwe":"C"}]')
    rows = model.parse_model_findings(model.with_model_items(responses_of(("a", "openai", 0, 200, body("openai", text)))))
    items = rows.orderBy("pos").collect()
    assert [(r.title, r.line_start, r.line_end) for r in items] == [("upper", 5, 0), ("last", -3, 2), ("", 0, 0), ("", 0, 0)]
    assert items[3].description == "folded" and items[3].cwe == "C"
    found = model.rebase_lines(rows).orderBy("ord").collect()
    assert [(r.start_line, r.severity) for r in found] == [(5, "info"), (-3, "info"), (0, "info"), (0, "medium")]
    moved = model.rebase_lines(rows, F.lit(11).cast("bigint")).orderBy("ord").collect()
    assert [r.start_line for r in moved] == [15, 7, 10, 10]


def test_envelopes_without_an_answer_fail(responses_of):
    bad = ["{}", "oops", '{"choices":[]}', '{"choices":[{"message":{}}]}', '{"choices":[{"message":{"content":null}}]}',
           '{"choices":[{"message":{"content":[]}}]}', body("openai", "[]") + " x", "", "[]", body("gemini", "[]"),
           body("openai", "[]").replace('"total_tokens": 7', '"total_tokens": "7"')]
    rows = [(f"{i}", "openai", 0, 200, text) for i, text in enumerate(bad)]
    rows += [("status", "openai", 0, 500, body("openai", "[]")), ("who", "someone", 0, 200, body("openai", "[]"))]
    table = responses_of(*rows)
    assert model.first_successful_attempt(table).count() == 0
    assert model.failed_model_files(table).count() == len(rows)


def test_first_success_wins_within_the_allowed_tries(responses_of):
    good = lambda n: body("openai", f'[{{"title":"t{n}"}}]')
    table = responses_of(
        ("a", "openai", 0, 500, good(0)), ("a", "openai", 1, 200, body("openai", "no")),
        ("a", "openai", 3, 200, good(3)), ("a", "openai", 2, 200, good(2)),
        ("b", "gemini", 4, 200, body("gemini", "[]")),
        ("c", "anthropic", 0, 200, body("anthropic", "[]")),
        ("d", "gemini", 3, 200, body("gemini", "[]")),
    )
    first = {r.path: r.attempt for r in model.first_successful_attempt(table).collect()}
    assert first == {"a": 2, "c": 0, "d": 3}
    assert [r.title for r in model.model_findings(table).collect()] == ["t2"]
    assert [r.path for r in model.failed_model_files(table).collect()] == ["b"]
    assert {r.path for r in model.first_successful_attempt(table, max_retries=4).collect()} == {"a", "b", "c", "d"}
    used = {r.provider: (r.files, r.tokens_used) for r in model.token_usage(table).collect()}
    assert used == {"openai": (1, 7), "anthropic": (1, 3), "gemini": (1, 5)}


def test_severity_spellings(spark):
    cases = {"Critical": "critical", "HIGH": "high", "Moderate": "medium", "MODERATE": "info", "cRitical": "info",
             "": "info", "low": "low", "info": "info"}
    table = spark.createDataFrame([(c,) for c in cases], "s string")
    got = table.select("s", model.normalize_severity(F.col("s")).alias("n")).collect()
    assert {r.s: r.n for r in got} == cases


def test_prompt_text(files_of):
    scanned = scanned_files(files_of({"a.go": "rand.Int()\npwd = 'abcd'", "b.py": "x\n"}), keep_content=True)
    prompts = {r.path: r for r in model.combined_prompt(model.build_prompts(scanned)).collect()}
    user = prompts["a.go"].user
    assert user.startswith(
        "Analyze the following code for security vulnerabilities:\n\nFile: p/a.go\nLanguage: go\nLines: 1-2\n\nCode:\n"
        "rand.Int()\npwd = 'abcd'\n\nStatic analysis has already detected the following issues:\n"
        "- regex (Line 2): Hardcoded Password\n- ast (Line 1): Weak Random Number Generator\n\n"
        "Please provide additional security insights beyond these static findings.\n\nRespond with a JSON array"
    )
    assert user.endswith("return an empty array: []\n\nOnly respond with valid JSON, no additional text.")
    assert "Lines: 1-2\n\nCode:\nx\n\n\n\n\nRespond with" in prompts["b.py"].user
    assert prompts["b.py"].prompt == prompts["b.py"].system + "\n\n" + prompts["b.py"].user
    assert prompts["a.go"].max_tokens == 4096 and prompts["a.go"].temperature == 0.2
    assert scan.with_static_hits(files_of({"a": "x"})).first().hits == []


def test_responses_are_read_from_json(spark, tmp_path, responses_of):
    table = responses_of(("a", "openai", 0, 200, body("openai", FENCED)))
    table.write.json(str(tmp_path / "r"))
    assert read_model_responses(spark, str(tmp_path / "r")).collect() == table.collect()


def test_lines_that_can_not_be_read_are_failed_attempts(spark, tmp_path, responses_of):
    good = [json.dumps({"project": "p", "path": p, "provider": "openai", "attempt": a, "status": 200, "body": body("openai", "[]")}) for p, a in (("a", 0), ("b", 1))]
    cut = '{"project":"p","path":"x \\"y\\".go","provider":"openai","attempt":2,"status":200,"body":"{\\"choi'
    lines = [good[0], cut, cut, '{"project":"p","path":"b","provider":"openai","attempt":0,"status":"many","body":1', "oops", '{"path":"a"', "", good[1]]
    (tmp_path / "r.json").write_text("\n".join(lines) + "\n")
    rows = read_model_responses(spark, str(tmp_path))
    assert sorted((r.path, r.attempt, r.status) for r in rows.collect() if r.body is None) == [("b", 0, None), ('x "y".go', 2, None), ('x "y".go', 2, None)]
    assert sorted(r.path for r in rows.collect() if r.body) == ["a", "b"]
    assert [r.path for r in model.failed_model_files(rows).collect()] == ['x "y".go']
    beside = {r.line: (r.project, r.path, r.n) for r in unreadable_responses(spark, str(tmp_path)).collect()}
    assert beside == {cut: ("p", 'x "y".go', 2), lines[3]: ("p", "b", 1), "oops": (None, None, 1), '{"path":"a"': (None, "a", 1)}
    assert all(r.file.endswith("r.json") for r in unreadable_responses(spark, str(tmp_path)).collect())


def test_hunk_headers(spark):
    cases = {
        "@@ -1,2 +3,4 @@ func x": [(3, 6)],
        "@@ -5 +7 @@": [(7, 7)],
        "@@ -5,2 +4,0 @@": [],
        "@@ -0,0 +1,10 @@\r": [(1, 10)],
        "+@@ -1 +1 @@": [],
        "@@ -1 +x @@": [(0, 0)],
        "@@ -1 +5,x @@": [],
        "@@ +1 +2,3 @@ +9\n@@ -1 +4 @@": [(1, 1), (2, 4), (4, 4)],
        "@@": [],
        "": [],
        "@@ -1 +99999999999999999999 @@": [(0, 0)],
    }
    table = spark.createDataFrame([("p", str(i), d) for i, d in enumerate(cases)], "project string, path string, diff string")
    got = {}
    for r in diff_hunk_ranges(table).orderBy("start_line").collect():
        got.setdefault(r.path, []).append((r.start_line, r.end_line))
    assert got == {str(i): ranges for i, ranges in enumerate(cases.values()) if ranges}


def test_change_listings(spark):
    table = spark.createDataFrame([("p", "\n a/b.go\nc d.py\n\n x\r\n"), ("q", " \n"), ("r", "")], "project string, listing string")
    rows = read_changed_files(table).collect()
    assert [(r.project, r.path, r.file_path) for r in rows] == [
        ("p", "a/b.go", "p/a/b.go"), ("p", "c d.py", "p/c d.py"), ("p", " x", "p/ x")
    ]


def test_attempts_beyond_the_limit_are_not_read_for_failed_files(spark):
    rows = [("p", "a", "openai", 0, 200, "oops"), ("p", "a", "openai", 9, 200, '{"choices":[{"message":{"content":"[]"}}],"usage":{"total_tokens":1}}'), ("p", "b", "openai", 9, 200, None)]
    failed = model.failed_model_files(spark.createDataFrame(rows, MODEL_RESPONSES), max_retries=3)
    assert sorted(r.path for r in failed.collect()) == ["a", "b"]
    assert "WHEN (attempt" in failed._jdf.queryExecution().analyzed().toString()
