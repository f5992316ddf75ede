"""Column layouts of the tables. Empty text stands for a missing value; nothing is null inside the operators."""

SOURCE_FILES = "project string, path string, content string"

RULES = (
    "rule_id string, title string, description string, pattern string, severity string, owasp_id string, "
    "cwe string, recommendation string"
)

# Columns of a finding before and after merging; `ord` gives the order in which findings of a file are merged.
FINDING_COLUMNS = [
    "project", "id", "title", "description", "file_path", "start_line", "end_line", "severity", "confidence",
    "owasp_id", "cwe", "source", "code_snippet", "recommendation", "raw_output",
]
ORD = "struct<stage:int,a:bigint,b:bigint>"
FINDINGS = (
    "project string, id string, title string, description string, file_path string, start_line bigint, "
    "end_line bigint, severity string, confidence string, owasp_id string, cwe string, source string, "
    f"code_snippet string, recommendation string, raw_output string, ord {ORD}"
)

CHANGED_LISTING = "project string, listing string"
DIFFS = "project string, path string, diff string"
MODEL_RESPONSES = "project string, path string, provider string, attempt int, status int, body string"
