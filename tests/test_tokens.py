"""Token table and the three structural rules, with lines derived by hand."""

import time

from scanloom.operators import tokens
from scanloom.operators.scan import token_scan

SAMPLE = '''package x
const (
	_ = iota
	B
)
var _ = foo()
var (
	g, _ = h()
	fn = func() { _ = k() }
)
func f() {
	a := rand.Intn(rand.Int())
	// rand.Int() password == ""
	/* _ = f()
	rand.Int() */
	s := `rand.Int() _ = q`
	b := x.rand.Int()
	if ok && password == "" { return }
	if u.Password == "" { }
	if a + password == "" { }
	if password == "" + z { }
	v, _ := g()
	_ = v
	for k, _ := range m { }
	for _, _ = range m { }
	if _, ok := m[k]; ok { }
	t := "rand.Int(\\" _ = "
	x, _ := rand.
		Read(b); _ = x
	switch { case userPasswd == "": }
}
'''


def hits(table):
    rows = token_scan(table).orderBy("file_path", "ord").collect()
    out = {}
    for r in rows:
        out.setdefault((r.file_path.removeprefix("p/"), f"A{r.ord.a}"), []).append(r.start_line)
    return out


def test_sample(files_of):
    assert hits(files_of({"a.go": SAMPLE})) == {
        ("a.go", "A1"): [12, 12, 28], ("a.go", "A2"): [18, 30], ("a.go", "A3"): [9, 22, 23, 28, 29]
    }


def test_snippets_quote_the_source_line_for_ignored_errors_only(files_of):
    rows = token_scan(files_of({"a.go": "x\r\n\tv, _ := rand.Int()\r\n"})).orderBy("ord").collect()
    assert [(r.title, r.code_snippet) for r in rows] == [
        ("Weak Random Number Generator", ""), ("Ignored Error Return Value", "\tv, _ := rand.Int()\r")
    ]


def test_only_the_exact_suffix_is_go(files_of):
    assert hits(files_of({"a.GO": "_ = f()", "a.go.txt": "_ = f()", "b.go": "_ = f()"})) == {("b.go", "A3"): [1]}


def test_weak_random_shapes(files_of):
    code = {
        "a.go": "rand . Int ( )\nrand/*c*/.X()\ncrypto.rand.X()\na.\n\n rand.X()\nrand.N[int](3)\n(rand.X)()\nmyrand.X()\n"
                "rand.é()\nérand.X()\ngo rand.X()\n1.rand.X()"
    }
    assert hits(files_of(code)) == {("a.go", "A1"): [1, 2, 10, 12]}


def test_empty_password_shapes(files_of):
    code = {
        "a.go": 'if !password == "" {}\nif *passwd == "" {}\nif myPASSWORDx == "" {}\nif password == `` {}\n'
                'if password == ""[0] {}\nif a == password == "" {}\nif a || password == "" && b {}\n'
                'if password ==\n"" {}\nif "" == password {}\nif password != "" {}\nif password == "x" {}'
    }
    assert hits(files_of(code)) == {("a.go", "A2"): [3, 7, 8]}


def test_ignored_error_shapes(files_of):
    code = {
        # op-assignments count, comparisons and snake case do not
        "a.go": "_ += f()\n_ <<= 1\n_ == x\nmy_ = 2\n_x = 3\n_, a = f()\n_ /* c */ = g()",
        # the list of targets starts on its first line
        "b.go": "a, // first\n\n\tb,\n\t_ := f()\nx[1:2], _ = g()",
        # declarations inside and outside of groups; a literal inside a group is code again
        "c.go": "type _ = int\ntype (\n\t_ = string\n)\nvar a, b,\n\t_ = f()\nif x { var p, _ = g() }\n"
                "var f = func() { _ = k() }\nvar (\n\tz = func() {\n\t\tvar (\n\t\t\t_ = 1\n\t\t)\n\t\t_ = 2\n\t}\n"
                "\t_ = 3\n)\n_ = 4",
        "d.go": "const _ = 1; _ = f()\nvar x int\n_ = x",
        "e.go": "for _ = range m {}\nfor _ = 0; ; {}\nselect { case v, _ = <-c: }",
    }
    assert hits(files_of(code)) == {
        ("a.go", "A3"): [1, 2, 7], ("b.go", "A3"): [1, 5], ("c.go", "A3"): [8, 14, 18], ("d.go", "A3"): [1, 3],
        ("e.go", "A3"): [2, 3],
    }


def test_tokens_carry_lines_and_whole_literals(files_of):
    table = files_of({"a.go": "a := `x\n\ny` // c\n/* 1\n2 */ b <<= \"q\\\"r\"\r\n'\\''.\"open"})
    rows = tokens.go_tokens(table).orderBy("tok_idx").collect()
    assert [(r.tok_idx, r.tok, r.line) for r in rows] == [
        (0, "a", 1), (1, ":=", 1), (2, "`x\n\ny`", 1), (3, "b", 5), (4, "<<=", 5), (5, '"q\\"r"', 5), (6, "'\\''", 6),
        (7, ".", 6), (8, '"', 6), (9, "open", 6),
    ]


def test_long_literals_and_long_lists_do_not_exhaust_the_stack(files_of):
    long_text = 's := "' + "a\\n" * 100_000 + '"\n_ = f()\n'
    names = "var " + ", ".join(f"n{i}" for i in range(20_000)) + ", _ = f()\n"
    targets = ",\n".join(f"n{i}" for i in range(2_000)) + ",\n_ = f()\n"
    table = files_of({"a.go": long_text, "b.go": names, "c.go": targets, "d.go": "/*" + "x\n" * 200_000 + "*/\n_ = f()"})
    assert hits(table) == {("a.go", "A3"): [2], ("c.go", "A3"): [1], ("d.go", "A3"): [200_002]}


def test_long_lists_cost_no_more_than_their_length(files_of):
    rows = 60_000
    table = files_of(
        {
            "a.go": "var x = []string{\n" + '"a",\n' * rows + "}\n_ = f()\n",
            "b.go": "var x = []string{\n" + '"a",\n\n// c\n' * rows + "}\n\n\n/* c\n*/\n_ = f()\n",
            "c.go": "\n" * rows + "x, _ := f()" + "\n" * rows,
        }
    )
    assert hits(table) == {
        ("a.go", "A3"): [rows + 3], ("b.go", "A3"): [3 * rows + 7], ("c.go", "A3"): [rows + 1]
    }


def test_many_members_of_a_group_take_time_by_their_number(spark, files_of):
    """Runs of events are cut at any place: the rows don't depend on it, and 200,000 members take seconds."""
    members = "var (\n" + "\tx, _ = f(a)\n" * 700 + "\tg = func() {\n\t\t_ = h()\n\t}\n" * 300 + ")\nfunc k() {\n\t_ = l()\n}\n"
    found = [r.start_line for r in token_scan(files_of({"a.go": members}), ["AST003"]).orderBy("ord").collect()]
    assert found == [703 + 3 * k for k in range(300)] + [1 + 700 + 900 + 3]
    times = []
    for n in (20_000, 200_000):
        files = files_of({"a.go": "package x\nvar (\n" + "\t_ = f()\n" * n + ")\nfunc g() {\n\t_ = h()\n}\n"})
        start = time.time()
        assert [r.start_line for r in token_scan(files, ["AST003"]).collect()] == [n + 5]
        times.append(time.time() - start)
    assert times[1] < 40 * max(times[0], 0.5)
