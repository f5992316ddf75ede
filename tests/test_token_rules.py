"""Token rules of a user."""

import pytest

from checks import corpus
from scanloom import schemas
from scanloom.functions.token_patterns import needed_token, token_regex
from scanloom.operators import risk, rules_table, scan
from scanloom.plans import scans

SOURCE = '''package x
func f() {
	exec.Command("ls", a)
	exec.
		CommandContext(ctx, a)
	exec.Command(`ls`)
	a.exec.Command(b) ; exec /* c */ . Command ( d )
	// exec.Command(e)
	s := "exec.Command(e)"
	eval(x); y.eval(x); y.
		eval(z)
	dbPassword := "hunter2"; DBPASSWORDS := ``; passwords := q; x := 'r'; v := ""
	defer m.Lock.Close(); defer a.b.c.d.Close(); n := 0x1F + 3
	if a == b && "x" != `y` { }
}
'''


def rule(pattern, rule_id="T", severity="high"):
    return (rule_id, f"Title {rule_id}", "", pattern, severity, "", "", "")


@pytest.mark.parametrize("pattern, lines", [
    ("exec . <name:Command(Context)?> (", [3, 4, 6, 7, 7]),
    ("exec . <name:Command(Context)?> ( !<string>", [4, 7, 7]),
    ("!. exec . Command (", [3, 6, 7]),
    ("!. eval (", [10]),
    ("eval (", [10, 10, 11]),
    ("<name:(?i).*passwords?> := <string>", [12, 12]),
    ("<name> := <rune>", [12]),
    ('<name> := ""', [12]),
    ("defer <any>{1,3} . Close ( )", [13]),
    ("defer <any>{1,7} . Close ( )", [13, 13]),
    ("<number> + <number>", [13]),
    (":= <number>? <any>? 3", [13]),
    ("!= <string> {", [14]),
    ("&& !<string>", []),
    ("<any> && <string>", [14]),
    ("nothing here", []),
])
def test_patterns(files_of, pattern, lines):
    found = scan.token_scan(files_of({"a.go": SOURCE, "b.py": SOURCE}), ["T"], [rule(pattern)]).collect()
    assert sorted(r.start_line for r in found) == lines
    text = SOURCE.split("\n")
    assert all(r.code_snippet == text[r.start_line - 1] and r.file_path == "p/a.go" and r.source == "ast" for r in found)


@pytest.mark.parametrize("pattern", [
    "", "!x", "<nme>", "<number:1>", "<name:a{2}>", "<any>{0,51}", "<any>{3,2}", "<any>? x", "!<name> x", "x \"abc\"", "<name:[.]>", "<name:(>", "<name:(?s)a>", "// x",
])
def test_what_can_not_be_read(pattern):
    with pytest.raises((ValueError, __import__("re").error)):
        token_regex(pattern)


def test_needed_token():
    assert needed_token("exec . <name:CommandContext> ( !something") == "exec" and needed_token("<any> <name>") == "" and needed_token("<any> !=") == "!="


def test_order_and_ids(spark, files_of):
    rules = [rule("eval (", "B"), rule("exec .", "A"), rule("package <name>", "AST001", "low"), rule("(", "B"), rule("<oops>", "C"), rule("func f", None)]
    good, wrong = rules_table.read_token_rules(spark.createDataFrame([(k, *r) for k, r in enumerate(rules)], "position int, " + schemas.RULES))
    assert [r[0] for r in good] == ["B", "A", "#3", "#4", "#6"] and set(wrong) == {"C"}
    found = scan.token_scan(files_of({"a.go": SOURCE}), token_rules=good).orderBy("ord").collect()
    assert [r.ord.a for r in found] == sorted(r.ord.a for r in found)
    assert {r.title for r in found} == {"Title B", "Title A", "Title AST001", "Title None"}


def test_scans_take_token_rules(spark, files_of, tmp_path):
    files = files_of({"a.go": SOURCE, "c.go": "package y"})
    own = [rule("eval (", "E1", "critical")]
    plain, with_rule = (
        {r.path: r for r in risk.scanned_files(files, token_rules=rules).collect()} for rules in (None, own)
    )
    assert with_rule["a.go"].static_findings == plain["a.go"].static_findings + 3
    assert with_rule["a.go"].risk_score > plain["a.go"].risk_score and with_rule["c.go"] == plain["c.go"]
    assert "Title E1" in {r.title for r in scans.scan_static_only(files, "deep", token_rules=own).findings.collect()}
    listing = spark.createDataFrame([("p", "a.go\n")], schemas.CHANGED_LISTING)
    assert "Title E1" in {r.title for r in scans.scan_diff(files, listing, token_rules=own).findings.collect()}
    assert "Title E1" in scans.prompts_for(files, "deep", token_rules=own).where("path = 'a.go'").first().user


def test_rules_stay_inside_the_row_of_a_file(files_of):
    plan = scan.static_scan(files_of({"a.go": SOURCE}), token_rules=corpus.TOKEN_RULES)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Join", "Python", "Arrow", "Exchange"))


def test_what_is_ruled_out_before_a_match_is_looked_for_only_where_the_rest_matches():
    """The look back tries 200 lengths, at every place of a file if it comes first."""
    assert token_regex("!. exec (").index("(?<!") > token_regex("!. exec (").index("exec")
