"""Every operator as a query over the given tables, next to the SQL that must give the same rows."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import corpus, sql
from checks.sql import FILE_PATH, FINDING, ID, KEY, rank, words
from scanloom import schemas
from scanloom.functions import catalog
from scanloom.functions.identity import line_label
from scanloom.operators import files as file_ops
from scanloom.operators import filters, grouping, lines, merge, model, risk, rules_table, scan, tokens
from scanloom.plans import scans
from scanloom.plans.staging import staging
from scanloom.sinks import report
from scanloom.sources.diffs import diff_hunk_ranges, read_changed_files
from scanloom.sources.files import scan_source_files
from scanloom.sources.responses import read_model_responses, unreadable_responses

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

BASE = "WITH " + corpus.SOURCE_FILES_SQL
CHOSEN = BASE + ", " + sql.CHOSEN_SQL
STATIC = BASE + ", " + sql.static_sql("source_files")
CHOSEN_STATIC = CHOSEN + ", " + sql.static_sql("chosen")
MERGED = STATIC + ", " + sql.merge_sql()
RESPONSES = "WITH " + corpus.RESPONSES_SQL
PARSED = RESPONSES + ", " + sql.parsed_sql()
FINDING_COLUMNS = schemas.FINDING_COLUMNS


def query(name: str, sql_text: str | None = None):
    def register(function: Query) -> Query:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            corpus.use_own_folder(spark)
            return function(spark, sf)

        QUERIES[name] = run
        if sql_text is not None:
            SQL[name] = sql_text
        return function

    return register


def no_ord(findings: DataFrame) -> DataFrame:
    return findings.select(*FINDING_COLUMNS)


def starter_selection(spark: SparkSession, sf: str) -> DataFrame:
    return file_ops.select_files(corpus.source_files(spark, sf), ignore=catalog.STARTER_IGNORE)


def merged(spark: SparkSession, sf: str) -> DataFrame:
    return merge.merge_findings(scan.static_scan(corpus.source_files(spark, sf)), has_model_rows=False)


# ---- sources ---------------------------------------------------------------


@query(
    "scan_source_files",
    BASE + """ SELECT project, path, CAST(strlen(content) AS BIGINT) AS bytes, md5(content) AS digest FROM source_files
      WHERE regexp_matches(path, '(?i)[.](go|py|js|ts|java)$')""",
)
def _(spark, sf):
    """The reader over files: the corpus is written as one file per source file, with others beside that it must skip."""
    root = f"{staging(spark).root}/source-files-{uuid.uuid4().hex}"
    spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(
        spark.sparkContext._jsc.hadoopConfiguration()
    ).mkdirs(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root))
    corpus.write_files(corpus.source_files(spark, sf), root)
    return scan_source_files(spark, root, ["go", "python", "javascript", "typescript", "java"]).select(
        "project", "path", F.octet_length("content").cast("bigint").alias("bytes"), F.md5("content").alias("digest")
    )


@query(
    "scan_source_files_ignoring",
    CHOSEN + " SELECT project, path, md5(content) AS digest FROM chosen",
)
def _(spark, sf):
    """The same tree with folders that the ignore rules cover passed over while it is listed."""
    root = f"{staging(spark).root}/source-files-{uuid.uuid4().hex}"
    corpus.write_files(corpus.source_files(spark, sf), root)
    files = scan_source_files(spark, root, catalog.DEFAULT_LANGUAGES, ignore=catalog.STARTER_IGNORE)
    return files.select("project", "path", F.md5("content").alias("digest"))


@query(
    "read_changed_files",
    f"WITH {corpus.CHANGED_SQL} SELECT project, path, {FILE_PATH} AS file_path FROM changed",
)
def _(spark, sf):
    return read_changed_files(corpus.changed_listing(spark, sf))


@query(
    "diff_hunk_ranges",
    f"""WITH {corpus.DIFFS_SQL}, heads AS (
      SELECT project, path, unnest(list_filter(string_split(diff, chr(10)), lambda l: starts_with(l, '@@'))) AS head
      FROM diffs), fields AS (
      SELECT project, path, unnest(list_filter(regexp_split_to_array(trim(string_split(head, '@@')[2]), '\\s+'),
        lambda f: starts_with(f, '+'))) AS field FROM heads), numbers AS (
      SELECT project, path,
        coalesce(TRY_CAST(regexp_extract(field, '^\\+(\\d+)' || CASE WHEN contains(field, ',') THEN ',\\d+' ELSE '' END, 1)
          AS BIGINT), 0) AS s,
        CASE WHEN contains(field, ',') THEN coalesce(TRY_CAST(regexp_extract(field, '^\\+\\d+,(\\d+)', 1) AS BIGINT), 0)
          ELSE 1 END AS n FROM fields)
      SELECT project, path, s AS start_line, s + n - 1 AS end_line FROM numbers WHERE n > 0""",
)
def _(spark, sf):
    return diff_hunk_ranges(corpus.diffs(spark, sf))


_CATALOG_VALUES = ", ".join(
    f"({n}, " + ", ".join(sql.quote(v) for v in rule) + ")"
    for n, rule in enumerate(catalog.LINE_RULES + catalog.TOKEN_RULES, start=1)
)


@query(
    "rule_catalog",
    STATIC + f", rules({'position, ' + ', '.join(catalog.RULE_COLUMNS)}) AS (VALUES {_CATALOG_VALUES})"
    " SELECT r.*, coalesce(n, 0) AS findings FROM rules r LEFT JOIN"
    " (SELECT title, count(*) AS n FROM findings GROUP BY title) USING (title)",
)
def _(spark, sf):
    used = scan.static_scan(corpus.source_files(spark, sf)).groupBy("title").agg(F.count("*").alias("findings"))
    return rules_table.rule_catalog(spark).join(used, "title", "left").na.fill(0, ["findings"])


@query(
    "read_model_responses",
    RESPONSES + " SELECT project, path, provider, attempt, status, md5(body) AS digest FROM responses",
)
def _(spark, sf):
    target = f"{staging(spark).root}/responses-{uuid.uuid4().hex}"
    corpus.model_responses(spark, sf).write.json(target)
    return read_model_responses(spark, target).select(
        "project", "path", "provider", "attempt", "status", F.md5("body").alias("digest")
    )


@query(
    "read_damaged_responses",
    RESPONSES + """ SELECT project, path, provider, attempt, CASE WHEN cut THEN NULL ELSE status END AS status,
      CASE WHEN cut THEN NULL ELSE md5(body) END AS digest FROM (SELECT *, (length(path) + attempt) % 7 = 0 AS cut FROM responses)""",
)
def _(spark, sf):
    """A part of the lines lacks its end: they are failed attempts of the files they name."""
    target = f"{staging(spark).root}/responses-{uuid.uuid4().hex}"
    rows = corpus.model_responses(spark, sf)
    line = F.to_json(F.struct(*rows.columns))
    cut = (F.length("path") + F.col("attempt")) % 7 == 0
    rows.select(F.when(cut, F.left(line, F.length(line) - 3)).otherwise(line).alias("value")).write.text(target)
    return read_model_responses(spark, target).select(
        "project", "path", "provider", "attempt", "status", F.md5("body").alias("digest")
    )


@query(
    "unreadable_responses",
    RESPONSES + " SELECT project, path, count(*) AS n FROM responses WHERE (length(path) + attempt) % 7 = 0 GROUP BY ALL",
)
def _(spark, sf):
    target = f"{staging(spark).root}/responses-{uuid.uuid4().hex}"
    rows = corpus.model_responses(spark, sf)
    line = F.to_json(F.struct(*rows.columns))
    cut = (F.length("path") + F.col("attempt")) % 7 == 0
    rows.select(F.when(cut, F.left(line, F.length(line) - 3)).otherwise(line).alias("value")).write.text(target)
    return unreadable_responses(spark, target).groupBy("project", "path").agg(F.sum("n").alias("n"))


# ---- files -----------------------------------------------------------------


@query("detect_language", BASE + f" SELECT project, path, {sql.LANGUAGE} AS language FROM source_files")
def _(spark, sf):
    return file_ops.detect_language(corpus.source_files(spark, sf)).select("project", "path", "language")


@query(
    "filter_languages",
    BASE + f" SELECT project, path FROM source_files WHERE {sql.LANGUAGE} IN {words(catalog.DEFAULT_LANGUAGES)}",
)
def _(spark, sf):
    return file_ops.filter_languages(corpus.source_files(spark, sf)).select("project", "path")


@query("filter_ignored_paths", BASE + f" SELECT project, path FROM source_files WHERE NOT {sql.IGNORED}")
def _(spark, sf):
    kept = file_ops.filter_ignored_paths(corpus.source_files(spark, sf), catalog.STARTER_IGNORE)
    return kept.select("project", "path")


@query("file_loc", BASE + f" SELECT project, path, {sql.LOC} AS loc FROM source_files")
def _(spark, sf):
    return file_ops.file_loc(corpus.source_files(spark, sf))


@query("flag_crypto", BASE + f" SELECT project, path, {sql.CRYPTO} AS has_crypto FROM source_files")
def _(spark, sf):
    return file_ops.flag_crypto(corpus.source_files(spark, sf))


@query("flag_database", BASE + f" SELECT project, path, {sql.DATABASE} AS has_database FROM source_files")
def _(spark, sf):
    return file_ops.flag_database(corpus.source_files(spark, sf))


@query("flag_auth", BASE + f" SELECT project, path, {sql.AUTH} AS has_auth FROM source_files")
def _(spark, sf):
    return file_ops.flag_auth(corpus.source_files(spark, sf))


@query("flag_risky_name", BASE + f" SELECT project, path, {sql.RISKY} AS risky_name FROM source_files")
def _(spark, sf):
    return file_ops.flag_risky_name(corpus.source_files(spark, sf))


@query("file_profile", BASE + ", " + sql.profile_sql("source_files") + " SELECT * FROM profile")
def _(spark, sf):
    return file_ops.file_profile(corpus.source_files(spark, sf))


@query(
    "explode_lines",
    BASE + ", " + sql.lines_sql("source_files") + " SELECT project, path, line_no, md5(line) AS digest FROM lines",
)
def _(spark, sf):
    return lines.explode_lines(corpus.source_files(spark, sf)).select(
        "project", "path", "line_no", F.md5("line").alias("digest")
    )


@query(
    "oversize_line_guard",
    BASE + ", " + sql.readable_sql("source_files") + " SELECT project, path FROM readable",
)
def _(spark, sf):
    return lines.oversize_line_guard(corpus.source_files(spark, sf)).select("project", "path")


# ---- line rules ------------------------------------------------------------

_RULE_KEYS = {
    "rule_api_key": "REGEX001",
    "rule_password": "REGEX002",
    "rule_private_key": "REGEX003",
    "rule_aws_key": "REGEX004",
    "rule_md5": "REGEX005",
    "rule_sha1": "REGEX006",
    "rule_sql_concat": "REGEX007",
    "rule_http_url": "REGEX008",
    "rule_debug_mode": "REGEX009",
    "rule_command_injection": "REGEX010",
}


def _one_line_rule(rule_id: str) -> Query:
    return lambda spark, sf: no_ord(scan.regex_scan(corpus.source_files(spark, sf), [rule_id]))


for _key, _rule_id in _RULE_KEYS.items():
    _text = BASE + ", " + sql.regex_sql("source_files", [_rule_id]) + f" SELECT {FINDING} FROM regex_findings"
    query(_key, _text)(_one_line_rule(_rule_id))


@query("regex_scan", BASE + ", " + sql.regex_sql("source_files") + f" SELECT {FINDING} FROM regex_findings")
def _(spark, sf):
    return no_ord(scan.regex_scan(corpus.source_files(spark, sf)))


@query(
    "regex_scan_rule_table",
    BASE + ", " + sql.regex_sql("source_files") + f" SELECT {FINDING} FROM regex_findings",
)
def _(spark, sf):
    rules = rules_table.rule_catalog(spark).where(F.col("pattern") != "")
    return no_ord(rules_table.regex_scan_rule_table(corpus.source_files(spark, sf), rules))


@query(
    "regex_scan_user_rules",
    BASE + ", " + sql.regex_sql("source_files", rules=corpus.USER_RULES)
    + " SELECT title, count(*) AS n, count(DISTINCT file_path) AS files, sum(start_line)::BIGINT AS lines FROM regex_findings GROUP BY title",
)
def _(spark, sf):
    rules = spark.createDataFrame(corpus.USER_RULES, schemas.RULES)
    found = rules_table.regex_scan_rule_table(corpus.source_files(spark, sf), rules)
    return found.groupBy("title").agg(
        F.count("*").alias("n"), F.countDistinct("file_path").alias("files"), F.sum("start_line").alias("lines")
    )


@query(
    "regex_scan_many_rules",
    BASE + ", " + sql.lines_sql("source_files") + """, rules AS (SELECT n, '/en/' || n AS start FROM range(2000) r(n)),
      found AS (SELECT n, project || '/' || path AS file_path, line_no FROM lines JOIN rules
        ON contains(line, '/en/') AND contains(line, start) AND regexp_matches(line, start || '[[:digit:]]+'))
      SELECT 'Numbered page ' || n AS title, count(*) AS n, count(DISTINCT file_path) AS files, sum(line_no)::BIGINT AS lines
      FROM found GROUP BY ALL""",
)
def _(spark, sf):
    rules = spark.createDataFrame(corpus.MANY_RULES, schemas.RULES)
    found = rules_table.regex_scan_rule_table(corpus.source_files(spark, sf), rules)
    return found.groupBy("title").agg(
        F.count("*").alias("n"), F.countDistinct("file_path").alias("files"), F.sum("start_line").alias("lines")
    )


# ---- token rules -----------------------------------------------------------


@query(
    "go_tokens",
    BASE + ", " + sql.tokens_sql("source_files") + " SELECT project, path, tok_idx, tok, line FROM tokens",
)
def _(spark, sf):
    return tokens.go_tokens(corpus.source_files(spark, sf))


def _one_token_rule(rule_id: str) -> Query:
    return lambda spark, sf: no_ord(scan.token_scan(corpus.source_files(spark, sf), [rule_id]))


_TOKEN_KEYS = {"rule_weak_random": "AST001", "rule_empty_password": "AST002", "rule_ignored_error": "AST003"}
for _key, _rule_id in _TOKEN_KEYS.items():
    _text = BASE + ", " + sql.ast_sql("source_files", [_rule_id]) + f" SELECT {FINDING} FROM ast_findings"
    query(_key, _text)(_one_token_rule(_rule_id))


@query(
    "go_tokens_giant_files",
    BASE + ", " + sql.tokens_sql("source_files") + " SELECT project, path, tok_idx, tok, line FROM tokens",
)
def _(spark, sf):
    """Files of 4 KB and more in segments."""
    return tokens.go_tokens(corpus.source_files(spark, sf), giant_bytes=4096)


# ---- engine ----------------------------------------------------------------


@query("static_scan", STATIC + f" SELECT {FINDING} FROM findings")
def _(spark, sf):
    return no_ord(scan.static_scan(corpus.source_files(spark, sf)))


@query("static_scan_giant_files", STATIC + f" SELECT {FINDING} FROM findings")
def _(spark, sf):
    """Files of 4 KB and more in segments."""
    return no_ord(scan.static_scan(corpus.source_files(spark, sf), giant_bytes=4096))


@query(
    "engine_error_isolation",
    BASE + ", " + sql.static_sql("source_files", limited=True)
    + f""" SELECT {FILE_PATH} AS file_path, count(source) FILTER (source = 'regex') AS regex_findings,
      count(source) FILTER (source = 'ast') AS ast_findings FROM source_files s
      LEFT JOIN (SELECT file_path, source FROM findings) f ON f.file_path = s.project || '/' || s.path
      WHERE len(list_filter(string_split(content, chr(10)), lambda x: strlen(x) >= 65536)) > 0 GROUP BY 1""",
)
def _(spark, sf):
    """Files the line rules give up on: no line findings, token findings still there."""
    oversize = corpus.source_files(spark, sf).where(lines.has_oversize_line(F.col("content")))
    hit = scan.with_static_hits(oversize, line_byte_limit=catalog.LINE_BYTE_LIMIT).select("project", "path", F.explode_outer("hits").alias("hit"))
    stages = catalog.SOURCE_STAGE
    return hit.groupBy(F.concat("project", F.lit("/"), "path").alias("file_path")).agg(
        F.count_if(F.col("hit.stage") == stages["regex"]).alias("regex_findings"),
        F.count_if(F.col("hit.stage") == stages["ast"]).alias("ast_findings"),
    )


@query(
    "union_finding_groups",
    STATIC + f" SELECT {FINDING} FROM regex_findings UNION ALL SELECT {FINDING} FROM ast_findings",
)
def _(spark, sf):
    table = corpus.source_files(spark, sf)
    return no_ord(scan.union_finding_groups(scan.regex_scan(table), scan.token_scan(table)))


@query(
    "join_file_findings",
    STATIC + ", " + sql.risk_sql("source_files") + f""" SELECT project, path, {FILE_PATH} AS file_path, language, loc,
      static_findings, severity_weight FROM scored""",
)
def _(spark, sf):
    table = corpus.source_files(spark, sf)
    joined = risk.join_file_findings(file_ops.file_profile(table), scan.static_scan(table))
    return joined.select("project", "path", "file_path", "language", "loc", "static_findings", "severity_weight")


@query(
    "join_changed_files",
    BASE + ", " + corpus.CHANGED_SQL[len(corpus.NAMED_SQL) + 2:]
    + " SELECT project, path, md5(content) AS digest FROM source_files WHERE (project, path) IN (SELECT (project, path) FROM changed)",
)
def _(spark, sf):
    changed = read_changed_files(corpus.changed_listing(spark, sf))
    kept = filters.join_changed_files(corpus.source_files(spark, sf), changed)
    return kept.select("project", "path", F.md5("content").alias("digest"))


# ---- risk ------------------------------------------------------------------


@query(
    "static_findings_per_file",
    STATIC + " SELECT file_path, count(*) AS static_findings FROM findings GROUP BY file_path",
)
def _(spark, sf):
    counted = risk.static_findings_per_file(scan.static_scan(corpus.source_files(spark, sf)))
    return counted.select("file_path", "static_findings")


@query(
    "severity_weight_per_file",
    STATIC + f" SELECT file_path, CAST(sum({sql.weight_sql('severity')}) AS BIGINT) AS severity_weight"
    " FROM findings GROUP BY file_path",
)
def _(spark, sf):
    counted = risk.static_findings_per_file(scan.static_scan(corpus.source_files(spark, sf)))
    return counted.select("file_path", "severity_weight")


_SCORED = ("project, path, language, loc, has_crypto, has_database, has_auth, risky_name, static_findings, "
           "severity_weight, risk_score")


@query("risk_score", STATIC + ", " + sql.risk_sql("source_files") + f" SELECT {_SCORED} FROM scored")
def _(spark, sf):
    return risk.scanned_files(corpus.source_files(spark, sf)).drop("hits")


_HOUSE_RULES = corpus.USER_RULES[:12]


@query(
    "risk_score_user_rules",
    BASE + ", " + sql.static_sql("source_files", rules=catalog.LINE_RULES + _HOUSE_RULES) + ", " + sql.risk_sql("source_files")
    + f" SELECT {_SCORED} FROM scored",
)
def _(spark, sf):
    return risk.scanned_files(corpus.source_files(spark, sf), rules=_HOUSE_RULES).drop("hits")


@query(
    "scan_user_rules",
    CHOSEN + ", " + sql.static_sql("chosen", rules=catalog.LINE_RULES + _HOUSE_RULES) + ", " + sql.merge_sql()
    + " SELECT file_path, title, severity, start_line FROM merged",
)
def _(spark, sf):
    done = scans.scan_static_only(
        corpus.source_files(spark, sf), "deep", ignore=catalog.STARTER_IGNORE, rules=_HOUSE_RULES
    )
    return done.findings.select("file_path", "title", "severity", "start_line")


_OWN_TOKENS = (corpus.TOKEN_RULES, corpus.TOKEN_RULE_TESTS)


@query(
    "token_scan_user_rules",
    BASE + ", " + sql.static_sql("source_files", token_rules=_OWN_TOKENS)
    + f" SELECT {FINDING} FROM user_findings",
)
def _(spark, sf):
    rules, _ = rules_table.read_token_rules(spark.createDataFrame(corpus.TOKEN_RULES, schemas.RULES))
    return no_ord(scan.token_scan(corpus.source_files(spark, sf), [rule[0] for rule in rules], rules))


@query(
    "risk_score_token_rules",
    BASE + ", " + sql.static_sql("source_files", token_rules=_OWN_TOKENS) + ", " + sql.risk_sql("source_files")
    + f" SELECT {_SCORED} FROM scored",
)
def _(spark, sf):
    return risk.scanned_files(corpus.source_files(spark, sf), token_rules=corpus.TOKEN_RULES).drop("hits")


@query(
    "scan_token_rules",
    CHOSEN + ", " + sql.static_sql("chosen", token_rules=_OWN_TOKENS) + ", " + sql.merge_sql()
    + " SELECT file_path, title, severity, start_line FROM merged",
)
def _(spark, sf):
    done = scans.scan_static_only(
        corpus.source_files(spark, sf), "deep", ignore=catalog.STARTER_IGNORE, token_rules=corpus.TOKEN_RULES
    )
    return done.findings.select("file_path", "title", "severity", "start_line")


@query(
    "select_high_risk",
    CHOSEN_STATIC + ", " + sql.risk_sql("chosen") + f" SELECT {_SCORED} FROM scored WHERE risk_score > 50",
)
def _(spark, sf):
    return risk.select_high_risk(risk.scanned_files(starter_selection(spark, sf))).drop("hits")


# ---- filters and groups ----------------------------------------------------


@query(
    "filter_by_files",
    STATIC + f""", wanted AS (SELECT n.project || '/' || n.path AS file_path FROM named n JOIN labels USING (doc_id)
      WHERE toxic = 1) SELECT {FINDING} FROM findings WHERE file_path IN (SELECT file_path FROM wanted)""",
)
def _(spark, sf):
    toxic = spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").select("doc_id")
    wanted = corpus.named_documents(spark, sf).join(toxic, "doc_id", "left_semi").select(
        F.concat("project", F.lit("/"), "path").alias("file_path")
    )
    return no_ord(filters.filter_by_files(scan.static_scan(corpus.source_files(spark, sf)), wanted))


@query(
    "filter_by_min_severity",
    STATIC + f" SELECT {FINDING} FROM findings WHERE {rank('severity')} >= 3",
)
def _(spark, sf):
    return no_ord(filters.filter_by_min_severity(scan.static_scan(corpus.source_files(spark, sf)), "medium"))


@query("filter_critical", STATIC + f" SELECT {FINDING} FROM findings WHERE severity = 'critical'")
def _(spark, sf):
    return no_ord(filters.filter_critical(scan.static_scan(corpus.source_files(spark, sf))))


@query("filter_path_contains", STATIC + f" SELECT {FINDING} FROM findings WHERE contains(file_path, 'auth')")
def _(spark, sf):
    return no_ord(filters.filter_path_contains(scan.static_scan(corpus.source_files(spark, sf)), "auth"))


@query("count_by_severity", MERGED + " SELECT severity, count(*) AS n FROM merged GROUP BY severity")
def _(spark, sf):
    return grouping.count_by_severity(merged(spark, sf))


@query(
    "group_by_file",
    MERGED + f""" SELECT file_path, id, severity, start_line, count(*) OVER (PARTITION BY file_path) AS file_findings,
      row_number() OVER (PARTITION BY file_path ORDER BY {rank('severity')} DESC, start_line, id) AS number
      FROM merged""",
)
def _(spark, sf):
    return grouping.group_by_file(merged(spark, sf)).select(
        "file_path", "id", "severity", "start_line", "file_findings", "number"
    )


@query(
    "group_by_severity",
    MERGED + " SELECT severity, id, file_path, start_line, count(*) OVER (PARTITION BY severity) AS severity_findings"
    " FROM merged",
)
def _(spark, sf):
    return grouping.group_by_severity(merged(spark, sf)).select(
        "severity", "id", "file_path", "start_line", "severity_findings"
    )


def _summary_sql(mode: str, provider: str, selected: str, found: str) -> str:
    return f"""SELECT project, '{mode}' AS scan_mode, coalesce(files_scanned, 0) AS files_scanned,
      {'false' if provider else 'true'} AS static_only, '{provider}' AS llm_provider,
      coalesce(total_findings, 0) AS total_findings
    FROM (SELECT project, count(*) AS files_scanned FROM {selected} GROUP BY project)
    FULL JOIN (SELECT project, count(*) AS total_findings FROM {found} GROUP BY project) USING (project)"""


_CHOSEN_MERGED = CHOSEN_STATIC + ", " + sql.merge_sql()


@query("scan_summary", _CHOSEN_MERGED + " " + _summary_sql("deep", "", "chosen", "merged"))
def _(spark, sf):
    table = staging(spark).stage(risk.scanned_files(starter_selection(spark, sf)))
    found = merge.merge_findings(scan.findings_of(table), has_model_rows=False)
    return grouping.scan_summary(table, found, "deep")


# ---- merge -----------------------------------------------------------------


@query("finding_id", STATIC + f" SELECT file_path, start_line, title, source, {ID} AS id FROM findings")
def _(spark, sf):
    named = scan.with_finding_id(scan.static_scan(corpus.source_files(spark, sf)))
    return named.select("file_path", "start_line", "title", "source", "id")


@query("similarity_key", PARSED + ", " + sql.FIRST_SQL + ", " + sql.MODEL_FINDINGS_SQL
       + f" SELECT file_path, title, start_line, {KEY} AS key FROM model_findings")
def _(spark, sf):
    found = merge.with_similarity_key(model.model_findings(corpus.model_responses(spark, sf)))
    return found.select("file_path", "title", "start_line", "key")


def _all_findings_sql(files: str, selected: str | None) -> str:
    """Static and model findings of the files as ``findings_all``."""
    limit = "" if selected is None else f" WHERE (project || '/' || path) IN (SELECT project || '/' || path FROM {selected})"
    model_sql = sql.MODEL_FINDINGS_SQL[:-1] + limit + ")"
    return ", ".join([
        corpus.RESPONSES_SQL[len(corpus.NAMED_SQL) + 2:], sql.parsed_sql(), sql.FIRST_SQL, model_sql,
        "findings_all AS (SELECT * FROM findings UNION ALL SELECT * FROM model_findings)",
    ])


_BOTH = STATIC + ", " + _all_findings_sql("source_files", None)


def both(spark: SparkSession, sf: str) -> DataFrame:
    return scan.union_finding_groups(
        scan.static_scan(corpus.source_files(spark, sf)), model.model_findings(corpus.model_responses(spark, sf))
    )


@query(
    "dedup_findings",
    _BOTH + f""" SELECT {FINDING.replace('id, ', ID + ' AS id, ', 1)} FROM (SELECT *, row_number() OVER (PARTITION BY {KEY}
      ORDER BY stage, a, b) AS place FROM findings_all) WHERE place = 1""",
)
def _(spark, sf):
    return no_ord(merge.dedup_findings(scan.with_finding_id(both(spark, sf))))


@query(
    "merge_findings",
    _BOTH + ", " + sql.merge_sql("findings_all") + f" SELECT {FINDING} FROM merged",
)
def _(spark, sf):
    return no_ord(merge.merge_findings(staging(spark).stage(both(spark, sf))))


@query("severity_rank", STATIC + f" SELECT file_path, start_line, severity, {rank('severity')} AS sev_rank FROM findings")
def _(spark, sf):
    ranked = merge.with_severity_rank(scan.static_scan(corpus.source_files(spark, sf)))
    return ranked.select("file_path", "start_line", "severity", "sev_rank")


@query("sort_findings", MERGED + " SELECT id, severity, file_path, start_line FROM merged")
def _(spark, sf):
    return merge.sort_findings(merged(spark, sf)).select("id", "severity", "file_path", "start_line")


@query("merged_report", MERGED + f" SELECT {FINDING} FROM merged")
def _(spark, sf):
    table = scan.static_scan(corpus.source_files(spark, sf))
    return no_ord(merge.merge_findings(table, has_model_rows=False, ordered=True))


# ---- scan modes ------------------------------------------------------------

_DEEP = CHOSEN_STATIC + ", " + _all_findings_sql("chosen", "chosen") + ", " + sql.merge_sql("findings_all")
_SMART = (
    CHOSEN_STATIC + ", " + sql.risk_sql("chosen") + ", risky AS (SELECT * FROM scored WHERE risk_score > 50), "
    + _all_findings_sql("chosen", "risky") + ", " + sql.merge_sql("findings_all")
)


def _scan(spark: SparkSession, sf: str, mode: str) -> scans.Scan:
    return scans.scan(
        corpus.source_files(spark, sf), mode, corpus.model_responses(spark, sf), provider="openai",
        ignore=catalog.STARTER_IGNORE,
    )


@query("scan_deep", _DEEP + f" SELECT {FINDING} FROM merged")
def _(spark, sf):
    return no_ord(_scan(spark, sf, "deep").findings)


@query("scan_smart", _SMART + f" SELECT {FINDING} FROM merged")
def _(spark, sf):
    return no_ord(_scan(spark, sf, "smart").findings)


_DIFF = (
    BASE + ", " + corpus.CHANGED_SQL[len(corpus.NAMED_SQL) + 2:]
    + ", touched AS (SELECT * FROM source_files WHERE (project, path) IN (SELECT (project, path) FROM changed)), "
    + sql.static_sql("touched") + ", " + sql.merge_sql()
)


@query(
    "scan_diff",
    _DIFF + f" SELECT {FINDING} FROM merged",
)
def _(spark, sf):
    done = scans.scan_diff(corpus.source_files(spark, sf), corpus.changed_listing(spark, sf))
    return no_ord(done.findings)


@query("scan_diff_summary", _DIFF + " " + _summary_sql("diff", "", "changed", "merged"))
def _(spark, sf):
    return scans.scan_diff(corpus.source_files(spark, sf), corpus.changed_listing(spark, sf)).summary


@query("scan_static_only", _CHOSEN_MERGED + f" SELECT {FINDING} FROM merged")
def _(spark, sf):
    done = scans.scan_static_only(corpus.source_files(spark, sf), ignore=catalog.STARTER_IGNORE)
    return no_ord(done.findings)


@query("scan_many_projects", _SMART + " " + _summary_sql("smart", "openai", "chosen", "merged"))
def _(spark, sf):
    return scans.scan_many_projects(
        corpus.source_files(spark, sf), mode="smart", responses=corpus.model_responses(spark, sf), provider="openai",
        ignore=catalog.STARTER_IGNORE,
    )


# ---- model tables ----------------------------------------------------------


@query(
    "code_chunks",
    BASE + f""" SELECT project, path, {FILE_PATH} AS file_path, {sql.LANGUAGE} AS language, CAST(1 AS BIGINT) AS start_line,
      {sql.LOC} AS end_line, md5(content) AS digest FROM source_files""",
)
def _(spark, sf):
    chunks = model.code_chunks(corpus.source_files(spark, sf))
    return chunks.withColumn("digest", F.md5("content")).drop("content")


_CONTEXT = f""", contexts AS (SELECT file_path, {sql.quote(catalog.CONTEXT_HEADER)}
    || string_agg('- ' || source || ' (Line ' || start_line || '): ' || title || chr(10), '' ORDER BY stage, a, b)
    || {sql.quote(catalog.CONTEXT_TRAILER)} AS context FROM findings GROUP BY file_path)"""


@query(
    "static_context",
    STATIC + _CONTEXT + """ SELECT s.project, s.path, coalesce(context, '') AS context FROM source_files s
      LEFT JOIN contexts c ON c.file_path = s.project || '/' || s.path""",
)
def _(spark, sf):
    return model.static_context(scan.with_static_hits(corpus.source_files(spark, sf)))


_PARTS = [sql.quote(p) for p in re.split("{(?:file|language|lines|code|context)}", catalog.USER_PROMPT)]
_USER = (
    f"{_PARTS[0]} || s.project || '/' || s.path || {_PARTS[1]} || language || {_PARTS[2]} || '1-' || loc || {_PARTS[3]}"
    f" || content || {_PARTS[4]} || coalesce(context, '') || {_PARTS[5]}"
)


@query(
    "build_prompts",
    CHOSEN_STATIC + ", " + sql.risk_sql("chosen") + _CONTEXT + f""" SELECT s.project, s.path, language,
      CAST(1 AS BIGINT) AS start_line, loc AS end_line, md5({sql.quote(catalog.SYSTEM_PROMPT)}) AS system_digest,
      md5({_USER}) AS user_digest, md5({sql.quote(catalog.SYSTEM_PROMPT)} || chr(10) || chr(10) || {_USER}) AS prompt_digest,
      4096 AS max_tokens, 0.2::DOUBLE AS temperature
      FROM chosen s JOIN scored USING (project, path) LEFT JOIN contexts c ON c.file_path = s.project || '/' || s.path
      WHERE risk_score > 50""",
)
def _(spark, sf):
    prompts = scans.prompts_for(corpus.source_files(spark, sf), "smart", ignore=catalog.STARTER_IGNORE)
    return model.combined_prompt(prompts).select(
        "project", "path", "language", "start_line", "end_line", F.md5("system").alias("system_digest"),
        F.md5("user").alias("user_digest"), F.md5("prompt").alias("prompt_digest"), "max_tokens", "temperature",
    )


@query(
    "extract_model_text",
    RESPONSES + f" SELECT project, path, provider, attempt, {sql.ANSWER} AS text FROM responses",
)
def _(spark, sf):
    texts = model.extract_model_text(corpus.model_responses(spark, sf))
    return texts.select("project", "path", "provider", "attempt", "text")


@query(
    "strip_code_fence",
    PARSED + f""" SELECT t.project, t.path, t.provider, t.attempt,
      CASE WHEN v.try_no = 1 THEN text ELSE {sql.UNFENCED.replace('provider', 't.provider')} END AS json_text
      FROM texts t LEFT JOIN verdicts v USING (project, path, attempt)""",
)
def _(spark, sf):
    texts = model.strip_code_fence(model.extract_model_text(corpus.model_responses(spark, sf)))
    return texts.select("project", "path", "provider", "attempt", "json_text")


_ITEM = "title, description, severity, owasp_id, cwe, recommendation, line_start, line_end"


@query(
    "parse_model_findings",
    PARSED + f" SELECT project, path, provider, attempt, pos, {_ITEM} FROM items",
)
def _(spark, sf):
    return model.parse_model_findings(model.with_model_items(corpus.model_responses(spark, sf)))


@query(
    "normalize_severity",
    PARSED + f" SELECT project, path, attempt, pos, severity AS raw, {sql.NORMAL_SEVERITY} AS severity FROM items",
)
def _(spark, sf):
    items = model.parse_model_findings(model.with_model_items(corpus.model_responses(spark, sf)))
    return items.select(
        "project", "path", "attempt", "pos", F.col("severity").alias("raw"),
        model.normalize_severity(F.col("severity")).alias("severity"),
    )


@query(
    "rebase_lines",
    PARSED + f", {sql.FIRST_SQL}, {sql.MODEL_FINDINGS_SQL} SELECT {FINDING} FROM model_findings",
)
def _(spark, sf):
    return no_ord(model.model_findings(corpus.model_responses(spark, sf)))


@query(
    "first_successful_attempt",
    PARSED + f", {sql.FIRST_SQL} SELECT project, path, attempt, provider, md5(body) AS digest,"
    " (SELECT count(*) FROM items i WHERE i.project = f.project AND i.path = f.path AND i.attempt = f.attempt) AS n"
    " FROM firsts f JOIN responses USING (project, path, attempt)",
)
def _(spark, sf):
    first = model.first_successful_attempt(corpus.model_responses(spark, sf))
    return first.select(
        "project", "path", "attempt", "provider", F.md5("body").alias("digest"), F.size("items").cast("bigint").alias("n")
    )


@query(
    "failed_model_files",
    PARSED + f", {sql.FIRST_SQL} SELECT DISTINCT project, path FROM responses"
    " WHERE (project, path) NOT IN (SELECT (project, path) FROM firsts)",
)
def _(spark, sf):
    return model.failed_model_files(corpus.model_responses(spark, sf))


@query(
    "token_usage",
    PARSED + f""", {sql.FIRST_SQL} SELECT provider, count(*) AS files, CAST(sum(CASE provider
        WHEN 'openai' THEN CAST(json_extract(body, '$.usage.total_tokens') AS BIGINT)
        WHEN 'gemini' THEN CAST(json_extract(body, '$.usageMetadata.promptTokenCount') AS BIGINT)
          + CAST(json_extract(body, '$.usageMetadata.candidatesTokenCount') AS BIGINT)
        ELSE CAST(json_extract(body, '$.usage.input_tokens') AS BIGINT)
          + CAST(json_extract(body, '$.usage.output_tokens') AS BIGINT) END) AS BIGINT) AS tokens_used
      FROM firsts JOIN responses USING (project, path, attempt) GROUP BY provider""",
)
def _(spark, sf):
    return model.token_usage(corpus.model_responses(spark, sf))


@query(
    "model_scan_merge",
    _BOTH + ", " + sql.merge_sql("findings_all")
    + " SELECT source, severity, raw_output <> '' AS confirmed, count(*) AS n FROM merged GROUP BY ALL",
)
def _(spark, sf):
    found = merge.merge_findings(staging(spark).stage(both(spark, sf)))
    return found.groupBy("source", "severity", (F.col("raw_output") != "").alias("confirmed")).agg(
        F.count("*").alias("n")
    )


# ---- reports ---------------------------------------------------------------


def _smart_static(spark: SparkSession, sf: str) -> scans.Scan:
    return scans.scan_static_only(corpus.source_files(spark, sf), mode="smart", ignore=catalog.STARTER_IGNORE)


_SUMMARY = "summary AS (" + _summary_sql("smart", "", "chosen", "merged") + ")"
_REPORT = _CHOSEN_MERGED + ", " + _SUMMARY
_JSON_FIELDS = [c for c in FINDING_COLUMNS if c != "project"]


@query(
    "report_json",
    _REPORT + f""", in_order AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY {rank('severity')} DESC,
        file_path, start_line, id) AS place, -{rank('severity')} AS rank FROM merged)
      SELECT project, 1 AS part, rank, file_path, start_line, id, place = 1 AS is_first,
        title, description, code_snippet, owasp_id, raw_output = '' AS no_raw FROM in_order
      UNION ALL SELECT project, p, 0, '', CAST(0 AS BIGINT), '', NULL, scan_mode, files_scanned::VARCHAR,
        total_findings::VARCHAR, '', NULL FROM summary, (VALUES (0), (2)) v(p)""",
)
def _(spark, sf):
    """The fragments read back as JSON, since the two engines write JSON with different escapes."""
    done = _smart_static(spark, sf)
    fragments = report.report_json(done.findings, done.summary)
    item = F.regexp_replace("text", "^,", "")
    is_body = F.col("part") == report.BODY
    summary = done.summary.select("project", "scan_mode", "files_scanned", "total_findings")

    def field(name: str):
        return F.get_json_object(item, f"$.{name}")

    def shown(name: str, edge):
        return F.when(is_body, F.coalesce(field(name), F.lit(""))).otherwise(edge).alias(name)

    return fragments.join(summary, "project").select(
        "project", "part", "rank", "file_path", "start_line", "id",
        F.when(is_body, ~F.startswith("text", F.lit(","))).alias("is_first"),
        shown("title", F.col("scan_mode")),
        shown("description", F.col("files_scanned").cast("string")),
        shown("code_snippet", F.col("total_findings").cast("string")),
        shown("owasp_id", F.lit("")),
        F.when(is_body, field("raw_output").isNull()).alias("no_raw"),
    )


def _md_if(value: str, text: str) -> str:
    return f"CASE WHEN {value} <> '' THEN {text} ELSE '' END"


_N2 = "chr(10) || chr(10)"
_EMOJI = sql.case_of("severity", catalog.SEVERITY_EMOJI, catalog.OTHER_EMOJI)
_MD_FINDING = (
    f"'#### ' || number || '. ' || title || {_N2} || '**Severity:** ' || {_EMOJI} || ' ' || severity "
    f"|| ' | **Source:** ' || source || CASE WHEN start_line = end_line THEN ' | **Line:** ' || start_line "
    f"ELSE ' | **Lines:** ' || start_line || '-' || end_line END || {_N2} "
    f"|| {_md_if('owasp_id', chr(39) + '**OWASP:** ' + chr(39) + ' || owasp_id')} "
    f"|| {_md_if('cwe', chr(39) + ' | **CWE:** ' + chr(39) + ' || cwe')} || {_N2} "
    f"|| {_md_if('description', chr(39) + '**Description:**' + chr(39) + f' || {_N2} || description || {_N2}')} "
    f"|| {_md_if('code_snippet', chr(39) + '**Code:**' + chr(39) + f' || {_N2} || ' + chr(39) + '```' + chr(39) + ' || chr(10) || code_snippet || chr(10) || ' + chr(39) + '```' + chr(39) + f' || {_N2}')} "
    f"|| {_md_if('recommendation', chr(39) + '**Recommendation:**' + chr(39) + f' || {_N2} || recommendation || {_N2}')} "
    f"|| '---' || {_N2}"
)
_MD_TABLE = " || ".join(
    f"CASE WHEN count(*) FILTER (severity = '{s}') > 0 THEN '| {e} {s} | ' || count(*) FILTER (severity = '{s}')"
    " || ' |' || chr(10) ELSE '' END"
    for s, e in catalog.SEVERITY_EMOJI.items()
)


@query(
    "report_markdown",
    _REPORT + f""", numbered AS (SELECT *, count(*) OVER (PARTITION BY file_path) AS file_findings,
        row_number() OVER (PARTITION BY file_path ORDER BY {rank('severity')} DESC, start_line, id) AS number FROM merged),
      tables AS (SELECT project, {_MD_TABLE} AS rows FROM merged GROUP BY project)
      SELECT project, 1 AS part, file_path, number, CASE WHEN number = 1 THEN '### ' || string_split(file_path, '/')[-1]
        || {_N2} || '**Full Path:** `' || file_path || '`' || {_N2} || '**Issues Found:** ' || file_findings || {_N2}
        ELSE '' END || {_MD_FINDING} AS text FROM numbered
      UNION ALL SELECT project, 0, '', CAST(0 AS BIGINT), '# Security Scan Report' || {_N2} || '**Generated:** ' || {_N2}
        || '## Summary' || {_N2} || '- **Project Path:** `' || project || '`' || chr(10) || '- **Scan Mode:** smart'
        || chr(10) || '- **Scan Duration:** ' || chr(10) || '- **Files Scanned:** ' || files_scanned || chr(10)
        || '- **Total Findings:** ' || total_findings || chr(10) || '- **Analysis Type:** Static Only' || {_N2}
        || '### Findings by Severity' || {_N2} || '| Severity | Count |' || chr(10) || '|----------|-------|' || chr(10)
        || coalesce(rows, '') || chr(10) || CASE WHEN total_findings > 0 THEN '## Findings by File' || {_N2}
        ELSE {sql.quote(catalog.REPORT_NO_ISSUES)} END
      FROM summary LEFT JOIN tables USING (project)
      UNION ALL SELECT project, 2, '', CAST(0 AS BIGINT), '---' || {_N2}
        || '*Generated by Scanloom - Security Code Analysis Tool*' || chr(10) FROM summary""",
)
def _(spark, sf):
    done = _smart_static(spark, sf)
    return report.report_markdown(done.findings, done.summary)


@query(
    "report_severity_table",
    MERGED + f""" SELECT project, severity, {rank('severity')} AS rank, count(*) AS n,
      '| ' || {_EMOJI} || ' ' || severity || ' | ' || count(*) || ' |' AS row FROM merged GROUP BY project, severity""",
)
def _(spark, sf):
    return report.report_severity_table(merged(spark, sf))


@query(
    "finding_line_label",
    PARSED + f", {sql.FIRST_SQL}, {sql.MODEL_FINDINGS_SQL}" + """ SELECT file_path, title, start_line, end_line,
      CASE WHEN start_line = end_line THEN 'Line: ' || start_line ELSE 'Lines: ' || start_line || '-' || end_line END
      AS label FROM model_findings""",
)
def _(spark, sf):
    found = model.model_findings(corpus.model_responses(spark, sf))
    return found.select(
        "file_path", "title", "start_line", "end_line", line_label(F.col("start_line"), F.col("end_line")).alias("label")
    )


@query(
    "report_empty",
    STATIC + f""", critical_auth AS (SELECT * FROM findings WHERE severity = 'critical' AND contains(file_path, 'auth'))
      SELECT DISTINCT project, {sql.quote(catalog.REPORT_NO_ISSUES)} AS text FROM source_files
      WHERE project NOT IN (SELECT project FROM critical_auth)""",
)
def _(spark, sf):
    """Projects that come out clean once only critical findings in auth paths are asked for."""
    table = corpus.source_files(spark, sf)
    some = filters.filter_path_contains(filters.filter_critical(scan.static_scan(table)), "auth")
    return report.report_empty(grouping.scan_summary(table, some, "smart"))


@query(
    "report_audit_fields",
    _REPORT + " SELECT *, 'auditor' AS scanned_by, '2024-01-01T00:00:00Z' AS scan_timestamp, 'abc123' AS git_commit"
    " FROM summary",
)
def _(spark, sf):
    return report.report_audit_fields(_smart_static(spark, sf).summary, "auditor", "2024-01-01T00:00:00Z", "abc123")
