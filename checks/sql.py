"""SQL counterparts of the operators, as chains of common table expressions.

Written from the semantics of each operator, in another engine with another regex family; rules keep their
original patterns.
"""

from __future__ import annotations

from checks.corpus import quote
from scanloom.functions import catalog

NL = "chr(10)"
# Structure patterns in plain form: this engine's regex family never backtracks.
_NAME = r"[\p{L}_][\p{L}\p{Nd}_]*"
LEXER = (
    r"//[^\n]*"
    r"|/\*(?s:.*?)\*/"
    r'|"[^"\\\n]*(?:\\(?s:.)[^"\\\n]*)*"'
    r"|`[^`]*`"
    r"|'[^'\\\n]*(?:\\(?s:.)[^'\\\n]*)*'"
    rf"|{_NAME}|[0-9][\p{{L}}\p{{Nd}}_.]*|\n"
    r"|\.\.\.|<<=|>>=|&\^=|&\^|:=|==|!=|<=|>=|<-|<<|>>|&&|\|\||\+\+|--|[-+*/%&|^]=|[^ \t\r\n]"
)


def words(values: list[str]) -> str:
    return "(" + ", ".join(quote(v) for v in values) + ")"


def any_word(text: str, values: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {quote(v)})" for v in values) + ")"


def case_of(value: str, table: dict, default) -> str:
    shown = lambda v: quote(v) if isinstance(v, str) else str(v)
    return f"CASE {value} " + " ".join(f"WHEN {quote(k)} THEN {shown(v)}" for k, v in table.items()) + f" ELSE {shown(default)} END"


def rank(severity: str) -> str:
    return case_of(severity, catalog.SEVERITY_RANK, 0)


LANGUAGE = (
    "coalesce(map_extract_value(MAP {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in catalog.LANGUAGE_BY_EXTENSION.items())
    + r"}, lower(regexp_extract(path, '(\.[^./]*)$', 1))), '')"
)
BASE = "string_split(path, '/')[-1]"
RISKY = any_word(f"lower({BASE})", catalog.RISKY_NAMES)
CRYPTO, DATABASE, AUTH = (
    any_word("lower(content)", w) for w in (catalog.CRYPTO_WORDS, catalog.DATABASE_WORDS, catalog.AUTH_WORDS)
)
LOC = f"CAST(length(content) - length(replace(content, {NL}, '')) + 1 AS BIGINT)"
FILE_PATH = "project || '/' || path"

# With the starter ignore list the globs are one name at the top and every path above it.
IGNORED = (
    "(starts_with(path, 'vendor') OR starts_with(path, 'node_modules') OR starts_with(path, '.git') "
    "OR starts_with(path, 'test') OR starts_with(path, '*_test.go') "
    r"OR len(list_filter(generate_series(1, len(string_split(path, '/'))), "
    r"lambda i: regexp_full_match(array_to_string(string_split(path, '/')[1:i], '/'), '[^/]*_test\.go'))) > 0 OR "
    + any_word("path", catalog.ALWAYS_IGNORED) + ")"
)
CHOSEN_SQL = f"chosen AS (SELECT * FROM source_files WHERE NOT {IGNORED} AND {LANGUAGE} IN {words(catalog.DEFAULT_LANGUAGES)})"


def lines_sql(source: str) -> str:
    return f"""parted AS (SELECT project, path, string_split(content, {NL}) AS parts FROM {source}), cut AS (
  SELECT project, path, unnest(parts) AS line, CAST(generate_subscripts(parts, 1) AS BIGINT) AS line_no,
    len(parts) AS n FROM parted), lines AS (
  SELECT project, path, line_no, CASE WHEN ends_with(line, chr(13)) THEN left(line, length(line) - 1) ELSE line END
    AS line FROM cut WHERE NOT (line_no = n AND line = ''))"""


def readable_sql(source: str) -> str:
    return f"""readable AS (SELECT * FROM {source}
  WHERE len(list_filter(string_split(content, {NL}), lambda x: strlen(x) >= 65536)) = 0)"""


FINDING = (
    "project, id, title, description, file_path, start_line, end_line, severity, confidence, owasp_id, cwe, source, "
    "code_snippet, recommendation, raw_output"
)


def _finding_select(rule: tuple, source: str, line: str, snippet: str, order: str, table: str, where: str) -> str:
    _, title, description, _, severity, owasp, cwe, recommendation = rule
    return f"""SELECT project, '' AS id, {quote(title)} AS title, {quote(description)} AS description,
    {FILE_PATH} AS file_path, {line} AS start_line, {line} AS end_line, {quote(severity)} AS severity,
    '' AS confidence, {quote(owasp)} AS owasp_id, {quote(cwe)} AS cwe, {quote(source)} AS source,
    {snippet} AS code_snippet, {quote(recommendation)} AS recommendation, '' AS raw_output, {order}
  FROM {table} WHERE {where}"""


def regex_sql(
    source: str, rule_ids: list[str] | None = None, name: str = "regex_findings", limited: bool = False,
    rules: list[tuple] = catalog.LINE_RULES,
) -> str:
    """``limited`` leaves out the files with an oversize line."""
    parts = [
        _finding_select(
            rule, "regex", "line_no", "line", f"1 AS stage, line_no AS a, CAST({n} AS BIGINT) AS b", "lines",
            f"regexp_matches(line, {quote(rule[3])})",
        )
        for n, rule in enumerate(rules, start=1)
        if rule_ids is None or rule[0] in rule_ids
    ]
    union = "\n  UNION ALL ".join(parts)
    if limited:
        return f"{readable_sql(source)}, {lines_sql('readable')}, {name} AS ({union})"
    return f"{lines_sql(source)}, {name} AS ({union})"


def tokens_sql(source: str) -> str:
    return f"""lexed AS (SELECT project, path, regexp_extract_all(content, {quote(LEXER)}) AS t FROM {source}
    WHERE ends_with(path, '.go')), raw AS (
  SELECT project, path, unnest(t) AS tok, generate_subscripts(t, 1) AS i FROM lexed), placed AS (
  SELECT *, CAST(1 + coalesce(sum(length(tok) - length(replace(tok, {NL}, ''))) OVER (PARTITION BY project, path
    ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line FROM raw), tokens AS (
  SELECT project, path, row_number() OVER (PARTITION BY project, path ORDER BY i) - 1 AS tok_idx, tok, line
  FROM placed WHERE tok <> {NL} AND NOT starts_with(tok, '//') AND NOT (starts_with(tok, '/*') AND length(tok) > 2))"""


_BEFORE = [".", "+", "-", "*", "/", "%", "&", "|", "^", "!", "==", "!=", "<", ">", "<=", ">=", "<-", "<<", ">>", "&^"]
_AFTER = ["+", "-", "*", "/", "%", "&", "|", "^", "<<", ">>", "&^", "["]
_ASSIGN = ["=", ":=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "&^="]
_GROUPING = ["var", "const", "type"]


def ast_sql(source: str, rule_ids: list[str] | None = None, name: str = "ast_findings") -> str:
    w = "OVER (PARTITION BY project, path ORDER BY tok_idx)"
    upto = "OVER (PARTITION BY project, path ORDER BY tok_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    tests = {
        "AST001": f"tok = 'rand' AND n1 = '.' AND regexp_full_match(n2, {quote(_NAME)}) AND n3 = '(' "
                  "AND coalesce(p1, '') <> '.'",
        "AST002": f"regexp_full_match(tok, {quote(_NAME)}) AND (contains(lower(tok), 'password') OR "
                  "contains(lower(tok), 'passwd')) AND n1 = '==' AND n2 = '\"\"' "
                  f"AND coalesce(p1, '') NOT IN {words(_BEFORE)} AND coalesce(n3, '') NOT IN {words(_AFTER)}",
        "AST003": f"tok = '_' AND n1 IN {words(_ASSIGN)} AND coalesce(n2, '') <> 'range' "
                  "AND NOT (n1 = '=' AND coalesce(last_keyword, -1) >= run_start) AND NOT in_group "
                  "AND coalesce(last_equal, -1) < part_start",
    }
    parts = []
    for n, rule in enumerate(catalog.TOKEN_RULES, start=1):
        if rule_ids is None or rule[0] in rule_ids:
            ignored = rule[0] == "AST003"
            line = "part_line" if ignored else "line"
            snippet = "src_lines[part_line]" if ignored else "''"
            order = f"2 AS stage, CAST({n} AS BIGINT) AS a, tok_idx AS b"
            parts.append(_finding_select(rule, "ast", line, snippet, order, "judged", tests[rule[0]]))
    union = "\n  UNION ALL ".join(parts)
    return f"""{tokens_sql(source)}, around AS (
  SELECT *, lag(tok) {w} AS p1, lag(line) {w} AS pl, lead(tok) {w} AS n1, lead(tok, 2) {w} AS n2,
    lead(tok, 3) {w} AS n3,
    sum(CASE tok WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) {upto} AS paren,
    sum(CASE tok WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) {upto} AS brace FROM tokens), flagged AS (
  SELECT *, p1 IS NULL OR (line > pl AND p1 <> ',') AS broken,
    tok = '(' AND coalesce(p1, '') IN {words(_GROUPING)} AS opens FROM around), tracked AS (
  SELECT *,
    max(CASE WHEN broken OR p1 IN (';', '{{', '}}', ':', '(') THEN tok_idx END) {upto} AS part_start,
    max(CASE WHEN contains(tok, '=') AND NOT starts_with(tok, '"') AND NOT starts_with(tok, '''')
      AND NOT starts_with(tok, '`') THEN tok_idx END) {upto} AS last_equal,
    max(CASE WHEN NOT regexp_full_match(tok, '[\\p{{L}}\\p{{Nd}}_]+|,') THEN tok_idx + 1
             WHEN broken THEN tok_idx END) {upto} AS run_start,
    max(CASE WHEN tok IN {words(_GROUPING)} THEN tok_idx END) {upto} AS last_keyword,
    max(CASE WHEN opens THEN tok_idx END) {upto} AS open_idx FROM flagged), depths AS (
  SELECT *, min(paren) OVER (PARTITION BY project, path, open_idx ORDER BY tok_idx
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS low,
    first_value(paren) OVER (PARTITION BY project, path, open_idx ORDER BY tok_idx) AS open_paren,
    first_value(brace) OVER (PARTITION BY project, path, open_idx ORDER BY tok_idx) AS open_brace FROM tracked),
  quoted AS (SELECT project, path, string_split(content, {NL}) AS src_lines FROM {source}), judged AS (
  SELECT d.*, open_idx IS NOT NULL AND low >= open_paren AND brace = open_brace AS in_group, s.line AS part_line,
    src_lines
  FROM depths d JOIN quoted USING (project, path)
  LEFT JOIN tokens s ON s.project = d.project AND s.path = d.path AND s.tok_idx = d.part_start
  WHERE d.tok = '_' OR d.tok = 'rand' OR contains(lower(d.tok), 'passw')), {name} AS ({union})"""


def user_token_sql(source: str, rules: list[tuple], tests: list[str], name: str = "user_findings") -> str:
    """Findings of token rules of a user; needs the ``tokens`` of ``ast_sql``."""
    w = "OVER (PARTITION BY project, path ORDER BY tok_idx)"
    after = ", ".join(f"lead(tok, {k}) {w} AS n{k}" for k in range(1, 6))
    parts = [
        _finding_select(
            rule, "ast", "line", "string_split(content, chr(10))[line]", f"2 AS stage, CAST({n} AS BIGINT) AS a, line * 2147483648 + tok_idx AS b",
            f"beside JOIN (SELECT project AS p, path AS q, content FROM {source}) ON p = project AND q = path", test,
        )
        for n, (rule, test) in enumerate(zip(rules, tests, strict=True), start=4)
    ]
    return f"beside AS (SELECT *, lag(tok) {w} AS p1, {after} FROM tokens), {name} AS (" + "\n  UNION ALL ".join(parts) + ")"


def static_sql(
    source: str, limited: bool = False, rules: list[tuple] = catalog.LINE_RULES, token_rules: tuple[list[tuple], list[str]] | None = None
) -> str:
    own = f", {user_token_sql(source, *token_rules)}" if token_rules else ""
    also = " UNION ALL SELECT * FROM user_findings" if token_rules else ""
    return f"""{regex_sql(source, limited=limited, rules=rules)}, {ast_sql(source)}{own}, findings AS (
  SELECT * FROM regex_findings UNION ALL SELECT * FROM ast_findings{also})"""


def profile_sql(source: str) -> str:
    return f"""profile AS (SELECT project, path, {LANGUAGE} AS language, {LOC} AS loc, {CRYPTO} AS has_crypto,
  {DATABASE} AS has_database, {AUTH} AS has_auth, {RISKY} AS risky_name FROM {source})"""


def weight_sql(severity: str) -> str:
    return case_of(severity, catalog.SEVERITY_WEIGHT, 0)


def risk_sql(source: str) -> str:
    """Needs ``findings`` of the source."""
    return f"""{profile_sql(source)}, per_file AS (
  SELECT file_path, count(*) AS static_findings, CAST(sum({weight_sql('severity')}) AS BIGINT) AS severity_weight
  FROM findings GROUP BY file_path), scored AS (
  SELECT p.*, coalesce(static_findings, 0) AS static_findings, coalesce(severity_weight, 0) AS severity_weight,
    least(100.0::DOUBLE, CAST(coalesce(severity_weight, 0) + 15 * has_crypto::INT + 20 * has_database::INT
      + 25 * has_auth::INT + 10 * risky_name::INT AS DOUBLE)) AS risk_score
  FROM profile p LEFT JOIN per_file f ON f.file_path = p.project || '/' || p.path)"""


ID = "left(md5(file_path || ':' || start_line || ':' || end_line || ':' || title || ':' || source), 16)"
_SPACE = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def trimmed(text: str) -> str:
    return f"regexp_replace({text}, {quote('^' + _SPACE + '+|' + _SPACE + '+$')}, '', 'g')"


KEY = (
    f"file_path || ':' || (start_line // 5 * 5) || '-' || (end_line // 5 * 5) || ':' || lower({trimmed('title')})"
)


def merge_sql(table: str = "findings", name: str = "merged") -> str:
    """Ordered fold of each group, one duplicate after the other."""
    kept = ["project", "id", "title", "file_path", "start_line", "end_line", "confidence", "source", "code_snippet"]
    fresh = "n.source = 'llm' AND e.source <> 'llm'"
    fields = [f"{c} := e.{c}" for c in kept] + [
        f"description := CASE WHEN {fresh} THEN CASE WHEN e.description = '' THEN n.description ELSE n.description "
        f"|| {NL} || {NL} || 'Static Analysis: ' || e.description END ELSE e.description END",
        f"recommendation := CASE WHEN {fresh} AND e.recommendation = '' THEN n.recommendation "
        "ELSE e.recommendation END",
        f"raw_output := CASE WHEN n.source <> e.source THEN e.raw_output || {NL} || '[Also detected by ' || n.source "
        "|| ']' ELSE e.raw_output END",
        f"severity := CASE WHEN {rank('n.severity')} > {rank('e.severity')} THEN n.severity ELSE e.severity END",
        "owasp_id := CASE WHEN e.owasp_id = '' THEN n.owasp_id ELSE e.owasp_id END",
        "cwe := CASE WHEN e.cwe = '' THEN n.cwe ELSE e.cwe END",
    ]
    order = kept + ["description", "recommendation", "raw_output", "severity", "owasp_id", "cwe"]
    packed = ", ".join(f"{c} := {ID if c == 'id' else c}" for c in order)
    return f"""{name}_groups AS (
  SELECT {KEY} AS key, list(struct_pack({packed}) ORDER BY stage, a, b) AS rows FROM {table} GROUP BY 1),
  {name} AS (SELECT f.* FROM (
    SELECT list_reduce(rows, lambda e, n: struct_pack({', '.join(fields)})) AS f FROM {name}_groups))"""


# ---- model responses ------------------------------------------------------


TEXT_PATH = {
    "openai": "$.choices[0].message.content",
    "gemini": "$.candidates[0].content.parts[0].text",
    "anthropic": "$.content[0].text",
}
ANSWER = (
    "CASE WHEN status = 200 AND json_valid(body) THEN CASE provider "
    + " ".join(
        f"WHEN '{p}' THEN CASE WHEN json_type(body, '{path}') = 'VARCHAR' THEN json_extract_string(body, '{path}') END"
        for p, path in TEXT_PATH.items()
    )
    + " END END"
)


def _unmark(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^```(json)?', ''), '```$', '')"


UNFENCED = f"CASE WHEN provider = 'openai' THEN {_unmark('text')} ELSE {trimmed(_unmark(trimmed('text')))} END"
_TEXTS = ["title", "description", "severity", "owasp_id", "cwe", "recommendation"]
_LINES = ["line_start", "line_end"]


def _value(name: str) -> str:
    return f"list_last(list_filter(pairs, lambda p: lower(p[1]) = '{name}'))[2]"


def parsed_sql() -> str:
    """From ``responses``: ``answers`` (each attempt with its items' verdict) and ``items`` of good attempts."""
    values = ", ".join(f"{_value(c)} AS j_{c}" for c in _TEXTS + _LINES)
    ok = " AND ".join(
        [f"coalesce(json_type(j_{c}), 'NULL') IN ('VARCHAR', 'NULL')" for c in _TEXTS]
        + [f"coalesce(json_type(j_{c}), 'NULL') IN ('BIGINT', 'UBIGINT', 'NULL')" for c in _LINES]
    )
    fields = ", ".join(
        [f"coalesce(json_extract_string(j_{c}, '$'), '') AS {c}" for c in _TEXTS]
        + [f"coalesce(CAST(json_extract_string(j_{c}, '$') AS BIGINT), 0) AS {c}" for c in _LINES]
    )
    return f"""texts AS (SELECT *, {ANSWER} AS text FROM responses), tries2 AS (
  SELECT project, path, provider, attempt, 1 AS try_no, text AS json_text FROM texts
  UNION ALL SELECT project, path, provider, attempt, 2, {UNFENCED} FROM texts), valid AS (
  SELECT * FROM (SELECT *, CASE WHEN json_valid(json_text) THEN json_type(json_text) END AS top FROM tries2)
  WHERE top IN ('ARRAY', 'NULL')), elements AS (
  SELECT project, path, provider, attempt, try_no, unnest(json_extract(json_text, '$[*]')) AS e,
    generate_subscripts(json_extract(json_text, '$[*]'), 1) - 1 AS pos FROM valid WHERE top = 'ARRAY'), paired AS (
  SELECT *, json_type(e) AS kind, CASE WHEN json_type(e) = 'OBJECT'
      THEN list_zip(json_keys(e), json_extract(e, '$.*')) ELSE [] END AS pairs FROM elements), valued AS (
  SELECT project, path, provider, attempt, try_no, CAST(pos AS BIGINT) AS pos, kind, {values} FROM paired),
  checked AS (SELECT *, kind IN ('OBJECT', 'NULL') AND {ok} AS good FROM valued), verdicts AS (
  SELECT v.project, v.path, v.provider, v.attempt, min(v.try_no) AS try_no FROM valid v
  WHERE NOT EXISTS (SELECT 1 FROM checked c WHERE NOT c.good AND c.project = v.project AND c.path = v.path
    AND c.attempt = v.attempt AND c.try_no = v.try_no)
  GROUP BY v.project, v.path, v.provider, v.attempt), items AS (
  SELECT c.project, c.path, c.provider, c.attempt, c.pos, {fields}
  FROM checked c JOIN verdicts USING (project, path, provider, attempt, try_no))"""


FIRST_SQL = """firsts AS (
  SELECT project, path, min(attempt) AS attempt FROM verdicts WHERE attempt <= 3 GROUP BY project, path)"""

_SEVERITY = "CASE " + " ".join(
    f"WHEN severity IN {words(spelled)} THEN '{name}'" for name, spelled in catalog.MODEL_SEVERITIES.items()
) + " ELSE 'info' END"
MODEL_FINDINGS_SQL = f"""model_findings AS (
  SELECT project, '' AS id, title, description, {FILE_PATH} AS file_path, 1 + line_start - 1 AS start_line,
    1 + line_end - 1 AS end_line, {_SEVERITY} AS severity, '' AS confidence, owasp_id, cwe, 'llm' AS source,
    '' AS code_snippet, recommendation, '' AS raw_output, 3 AS stage, pos AS a, CAST(0 AS BIGINT) AS b
  FROM items JOIN firsts USING (project, path, attempt))"""
NORMAL_SEVERITY = _SEVERITY
