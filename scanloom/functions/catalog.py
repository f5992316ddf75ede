"""Rule texts, word lists, weights and prompt texts that results must reproduce."""

from __future__ import annotations

# ---------------------------------------------------------------------------
# OWASP categories used by the rules.
# ---------------------------------------------------------------------------
A02 = "A02:2021-Cryptographic Failures"
A03 = "A03:2021-Injection"
A05 = "A05:2021-Security Misconfiguration"
A07 = "A07:2021-Identification and Authentication Failures"
A09 = "A09:2021-Security Logging and Monitoring Failures"

RULE_COLUMNS = ("rule_id", "title", "description", "pattern", "severity", "owasp_id", "cwe", "recommendation")

# ---------------------------------------------------------------------------
# The line rules, in the order they are tried on a line. Patterns are RE2.
# ---------------------------------------------------------------------------
LINE_RULES = [
    (
        "REGEX001", "Hardcoded API Key", "Hardcoded API key or secret detected",
        r"""(?i)(api[_-]?key|apikey|api[_-]?secret|access[_-]?token)\s*[:=]\s*['""]?[a-zA-Z0-9]{20,}['""]?""",
        "high", A02, "CWE-798",
        "Store secrets in environment variables or secure vaults like AWS Secrets Manager, Azure Key Vault, "
        "or HashiCorp Vault.",
    ),
    (
        "REGEX002", "Hardcoded Password", "Hardcoded password detected",
        r"""(?i)(password|passwd|pwd)\s*[:=]\s*['""][^'""]{3,}['""]""",
        "high", A02, "CWE-259",
        "Never hardcode passwords. Use environment variables, configuration files with restricted permissions, "
        "or secret management systems.",
    ),
    (
        "REGEX003", "Hardcoded Private Key", "Private key detected in code",
        r"""-----BEGIN (RSA|DSA|EC|OPENSSH) PRIVATE KEY-----""",
        "critical", A02, "CWE-321",
        "Remove private keys from code. Store them securely in key management systems and never commit them "
        "to version control.",
    ),
    (
        "REGEX004", "AWS Access Key", "AWS Access Key ID detected",
        r"""(?i)AKIA[0-9A-Z]{16}""",
        "critical", A02, "CWE-798",
        "Immediately rotate this AWS key. Use IAM roles or AWS Secrets Manager instead of hardcoding credentials.",
    ),
    (
        "REGEX005", "Weak Cryptographic Hash (MD5)", "Use of MD5 cryptographic hash detected",
        r"""(?i)md5\s*\(""",
        "medium", A02, "CWE-327",
        "Replace MD5 with SHA-256 or stronger hashing algorithms. MD5 is cryptographically broken.",
    ),
    (
        "REGEX006", "Weak Cryptographic Hash (SHA1)", "Use of SHA1 cryptographic hash detected",
        r"""(?i)sha1\s*\(""",
        "medium", A02, "CWE-327",
        "Replace SHA1 with SHA-256 or stronger hashing algorithms. SHA1 is considered weak.",
    ),
    (
        "REGEX007", "SQL Query String Concatenation", "Potential SQL injection via string concatenation",
        r"""(?i)(SELECT|INSERT|UPDATE|DELETE).*\+.*['""]\s*\+""",
        "high", A03, "CWE-89",
        "Use parameterized queries or prepared statements instead of string concatenation.",
    ),
    (
        "REGEX008", "Insecure HTTP URL", "Use of insecure HTTP protocol detected",
        r"""http://[a-zA-Z0-9.-]+\.(com|org|net|io)""",
        "low", A02, "CWE-319",
        "Use HTTPS instead of HTTP for secure communication.",
    ),
    (
        "REGEX009", "Debug Mode Enabled", "Debug mode appears to be enabled",
        r"""(?i)(debug|DEBUG)\s*[:=]\s*(true|True|TRUE|1)""",
        "medium", A05, "CWE-489",
        "Disable debug mode in production environments to prevent information disclosure.",
    ),
    (
        "REGEX010", "Potential Command Injection", "Potential command injection vulnerability",
        r"""(?i)(exec|system|popen|shell_exec)\s*\([^)]*\+""",
        "high", A03, "CWE-78",
        "Avoid executing shell commands with user input. Use parameterized APIs or sanitize input thoroughly.",
    ),
]

# ---------------------------------------------------------------------------
# The token rules for Go files, in the order they are applied. They have no line pattern.
# ---------------------------------------------------------------------------
TOKEN_RULES = [
    (
        "AST001", "Weak Random Number Generator",
        "Use of math/rand for security-sensitive operations. Use crypto/rand instead.",
        "", "medium", A02, "CWE-338",
        "Replace math/rand with crypto/rand for security-sensitive random number generation.",
    ),
    (
        "AST002", "Weak Password Validation",
        "Empty password check detected. Ensure proper password strength validation.",
        "", "medium", A07, "CWE-521",
        "Implement proper password strength requirements including minimum length, complexity, and entropy checks.",
    ),
    (
        "AST003", "Ignored Error Return Value",
        "Error return value is explicitly ignored, which may lead to unhandled errors.",
        "", "low", A09, "CWE-391",
        "Handle or log errors appropriately instead of ignoring them.",
    ),
]

# For each line rule, text every match must contain after lower-casing (any one of the entries). It holds no
# letter s, because U+017F folds to s in the pattern but not under lower(). Checked against the patterns in tests.
LINE_RULE_ANCHORS = {
    "REGEX001": ["api", "acce"],
    "REGEX002": ["word", "wd"],
    "REGEX003": ["-----begin "],
    "REGEX004": ["akia"],
    "REGEX005": ["md5"],
    "REGEX006": ["ha1"],
    "REGEX007": ["elect", "ert", "update", "delete"],
    "REGEX008": ["http://"],
    "REGEX009": ["debug"],
    "REGEX010": ["exec", "tem", "popen"],
}
# Second text that must also be present, where the first one alone is common in prose.
LINE_RULE_SECOND_ANCHOR = {"REGEX007": "+", "REGEX010": "+"}

# ---------------------------------------------------------------------------
# File extension -> language, default languages, default and built-in ignore lists.
# ---------------------------------------------------------------------------
LANGUAGE_BY_EXTENSION = {
    ".go": "go",
    ".py": "python",
    ".js": "javascript",
    ".ts": "typescript",
    ".java": "java",
    ".c": "c",
    ".cpp": "cpp",
    ".cs": "csharp",
    ".rb": "ruby",
    ".php": "php",
    ".rs": "rust",
}
DEFAULT_LANGUAGES = ["go", "python", "javascript"]
DEFAULT_IGNORE = ["vendor/", "node_modules/", ".git/"]
STARTER_IGNORE = ["vendor/", "node_modules/", ".git/", "test/", "*_test.go"]
ALWAYS_IGNORED = [
    ".git", "node_modules", "vendor", ".vscode", ".idea", "bin", "obj", "dist", "build", "__pycache__",
]

# ---------------------------------------------------------------------------
# Words that mark sensitive content and risky file names, and the score weights.
# ---------------------------------------------------------------------------
CRYPTO_WORDS = ["crypt", "cipher", "encrypt", "hash"]
DATABASE_WORDS = ["sql", "database", "query", "db."]
AUTH_WORDS = ["auth", "login", "password", "token", "jwt"]
RISKY_NAMES = ["auth", "login", "admin", "password", "secret", "key", "token", "credential"]

SEVERITY_RANK = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}
SEVERITY_WEIGHT = {"critical": 30, "high": 20, "medium": 10, "low": 5}
SEVERITY_EMOJI = {"critical": "🔴", "high": "🟠", "medium": "🟡", "low": "🔵", "info": "⚪"}
OTHER_EMOJI = "⚫"
CRYPTO_WEIGHT, DATABASE_WEIGHT, AUTH_WEIGHT, RISKY_NAME_WEIGHT = 15, 20, 25, 10
MAX_RISK, HIGH_RISK = 100.0, 50.0

# Accepted spellings of a severity in model output; every other text counts as info.
MODEL_SEVERITIES = {
    "critical": ["critical", "Critical", "CRITICAL"],
    "high": ["high", "High", "HIGH"],
    "medium": ["medium", "Medium", "MEDIUM", "moderate", "Moderate"],
    "low": ["low", "Low", "LOW"],
}

# Fixed value: the line length from which a scan with that limit gives up on the whole file.
LINE_BYTE_LIMIT = 65536

# Order in which findings of one file are merged.
SOURCE_STAGE = {"gosec": 0, "regex": 1, "ast": 2, "llm": 3}

MAX_TOKENS, TEMPERATURE, MAX_RETRIES = 4096, 0.2, 3
SCAN_MODES = ["deep", "smart", "diff"]

# ---------------------------------------------------------------------------
# Prompt texts.
# ---------------------------------------------------------------------------
SYSTEM_PROMPT = """You are a security expert specialized in code review and vulnerability detection. 
Your task is to analyze code for security issues related to OWASP Top 10.

Focus on detecting:
- Injection flaws (SQL, Command, LDAP, etc.)
- Broken authentication and session management
- Sensitive data exposure
- XML external entities (XXE)
- Broken access control
- Security misconfiguration
- Cross-site scripting (XSS)
- Insecure deserialization
- Using components with known vulnerabilities
- Insufficient logging and monitoring
- Cryptographic failures
- Server-side request forgery (SSRF)

Provide structured, actionable findings in JSON format."""

# {file}, {language}, {lines}, {code} and {context} are filled in; other braces are part of the text.
USER_PROMPT = """Analyze the following code for security vulnerabilities:

File: {file}
Language: {language}
Lines: {lines}

Code:
{code}

{context}

Respond with a JSON array of findings. Each finding should have:
{
  "title": "Brief title of the issue",
  "description": "Detailed explanation of the vulnerability",
  "severity": "critical|high|medium|low",
  "owasp_id": "OWASP category (e.g., A03:2021-Injection)",
  "cwe": "CWE identifier if applicable",
  "line_start": line number where issue starts,
  "line_end": line number where issue ends,
  "recommendation": "How to fix this issue"
}

If no security issues are found, return an empty array: []

Only respond with valid JSON, no additional text."""
CONTEXT_HEADER = "Static analysis has already detected the following issues:\n"
CONTEXT_TRAILER = "\nPlease provide additional security insights beyond these static findings."
CONTEXT_LINE = "- {source} (Line {line}): {title}\n"

# ---------------------------------------------------------------------------
# Texts a merged finding gets.
# ---------------------------------------------------------------------------
STATIC_ANALYSIS_MARK = "\n\nStatic Analysis: "
ALSO_DETECTED = "\n[Also detected by {source}]"

# ---------------------------------------------------------------------------
# Parts of the Markdown report, in document order.
# ---------------------------------------------------------------------------
REPORT_HEAD = """# Security Scan Report

**Generated:** {generated}

## Summary

- **Project Path:** `{project}`
- **Scan Mode:** {scan_mode}
- **Scan Duration:** {duration}
- **Files Scanned:** {files_scanned}
- **Total Findings:** {total_findings}
{kind}
### Findings by Severity

| Severity | Count |
|----------|-------|
{table}
{next}"""
REPORT_PROVIDER = "- **LLM Provider:** {provider}\n"
REPORT_STATIC_ONLY = "- **Analysis Type:** Static Only\n"
REPORT_SEVERITY_ROW = "| {emoji} {severity} | {n} |"
REPORT_FILES = "## Findings by File\n\n"
REPORT_FILE = "### {name}\n\n**Full Path:** `{file_path}`\n\n**Issues Found:** {n}\n\n"
REPORT_FINDING = (
    "#### {number}. {title}\n\n**Severity:** {emoji} {severity} | **Source:** {source} | {lines}\n\n{owasp}{cwe}\n\n"
    "{description}{code}{recommendation}---\n\n"
)
REPORT_LINE = "**Line:** {start}"
REPORT_LINES = "**Lines:** {start}-{end}"
REPORT_OWASP = "**OWASP:** {value}"
REPORT_CWE = " | **CWE:** {value}"
REPORT_DESCRIPTION = "**Description:**\n\n{value}\n\n"
REPORT_CODE = "**Code:**\n\n```\n{value}\n```\n\n"
REPORT_RECOMMENDATION = "**Recommendation:**\n\n{value}\n\n"
REPORT_NO_ISSUES = (
    "## No Security Issues Found\n\nGreat! The scan did not detect any security vulnerabilities.\n\n"
)
REPORT_FOOT = "---\n\n*Generated by Scanloom - Security Code Analysis Tool*\n"
