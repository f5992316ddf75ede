"""The scan modes. Each handles any number of projects in one job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.functions import catalog
from scanloom.operators.files import select_files
from scanloom.operators.filters import join_changed_files
from scanloom.operators.grouping import scan_summary
from scanloom.operators.merge import merge_findings
from scanloom.operators.model import build_prompts, model_findings
from scanloom.operators.risk import scanned_files, select_high_risk
from scanloom.operators.scan import findings_of, static_scan, union_finding_groups
from scanloom.plans.staging import Staging, staging
from scanloom.sources.diffs import read_changed_files


@dataclass(frozen=True)
class Scan:
    """Merged findings, one summary row per project, the files chosen for the model, and what was staged for them."""

    findings: DataFrame
    summary: DataFrame
    selected: DataFrame
    staged: Staging | None = None


def check_mode(mode: str) -> str:
    if mode not in catalog.SCAN_MODES:
        raise ValueError(f"invalid scan mode: {mode}")
    return mode


def check_full_mode(mode: str) -> str:
    if check_mode(mode) == "diff":
        raise ValueError("a diff scan needs the change listings: use scan_diff")
    return mode


def choose(scanned: DataFrame, mode: str) -> DataFrame:
    return scanned if mode == "deep" else select_high_risk(scanned)


def own_rules(rules: list[tuple] | None, token_rules: list[tuple] | None) -> list[tuple]:
    return [*(rules or []), *(token_rules or [])]


def finish(
    scanned: DataFrame, selected: DataFrame, mode: str, responses: DataFrame | None, provider: str, max_retries: int,
    rules: list[tuple] | None, staged: Staging,
) -> Scan:
    """Findings, summary and chosen files from the staged table of scanned files."""
    found = findings_of(scanned, rules)
    if responses is not None:
        found = union_finding_groups(found, staged.stage(model_findings(responses, selected, max_retries)))
    merged = staged.stage(merge_findings(found, has_model_rows=responses is not None))
    # A scan counts as static only when there is no provider, whatever the answers hold.
    name = provider if responses is not None else ""
    return Scan(merged, scan_summary(scanned, merged, mode, name), selected, staged)


def scan(
    files: DataFrame,
    mode: str = "smart",
    responses: DataFrame | None = None,
    provider: str = "",
    languages: list[str] | None = None,
    ignore: list[str] | None = None,
    regex_enabled: bool = True,
    ast_enabled: bool = True,
    max_retries: int = catalog.MAX_RETRIES,
    rules: list[tuple] | None = None,
    token_rules: list[tuple] | None = None,
    folder: str | None = None,
) -> Scan:
    """Deep or smart scan; static only when no responses are given.

    The content is read once. What is kept of a file (profile, hits, score) is staged in ``folder``, and findings,
    choice of files and summary all come from that slim table. ``rules`` are line rules and ``token_rules`` token rules
    beside the built-in ones.
    """
    check_full_mode(mode)
    staged = staging(files.sparkSession, folder)
    chosen = select_files(files, languages, ignore)
    scanned = staged.stage(scanned_files(chosen, regex_enabled, ast_enabled, rules=rules, token_rules=token_rules))
    return finish(scanned, choose(scanned, mode), mode, responses, provider, max_retries, own_rules(rules, token_rules), staged)


def scan_static_only(files: DataFrame, mode: str = "smart", **options) -> Scan:
    return scan(files, mode, responses=None, **options)


def prompts_for(
    files: DataFrame,
    mode: str = "smart",
    languages: list[str] | None = None,
    ignore: list[str] | None = None,
    max_tokens: int = catalog.MAX_TOKENS,
    temperature: float = catalog.TEMPERATURE,
    regex_enabled: bool = True,
    ast_enabled: bool = True,
    rules: list[tuple] | None = None,
    token_rules: list[tuple] | None = None,
) -> DataFrame:
    """Prompts for the files a scan with the same options sends to the model, made in the pass that scores them."""
    scanned = scanned_files(select_files(files, languages, ignore), regex_enabled, ast_enabled, True, rules, token_rules)
    return build_prompts(choose(scanned, check_full_mode(mode)), max_tokens, temperature, own_rules(rules, token_rules))


def scan_with_model(
    files: DataFrame,
    ask: Callable[[DataFrame], DataFrame],
    mode: str = "smart",
    provider: str = "openai",
    max_tokens: int = catalog.MAX_TOKENS,
    temperature: float = catalog.TEMPERATURE,
    languages: list[str] | None = None,
    ignore: list[str] | None = None,
    regex_enabled: bool = True,
    ast_enabled: bool = True,
    max_retries: int = catalog.MAX_RETRIES,
    rules: list[tuple] | None = None,
    token_rules: list[tuple] | None = None,
    folder: str | None = None,
) -> Scan:
    """Scan with a caller-supplied model step ``prompts -> responses``.

    The content is scanned once, and the prompts are made from that scan: files that are not chosen keep no content in
    the staged table. The responses are staged at once, so no file is asked about again when a later step is repeated.
    """
    check_full_mode(mode)
    staged = staging(files.sparkSession, folder)
    scanned = scanned_files(select_files(files, languages, ignore), regex_enabled, ast_enabled, True, rules, token_rules)
    if mode != "deep":
        risky = F.col("risk_score") > catalog.HIGH_RISK
        scanned = scanned.withColumn("content", F.when(risky, F.col("content")))
    scanned = staged.stage(scanned)
    selected = choose(scanned, mode)
    responses = staged.stage(ask(build_prompts(selected, max_tokens, temperature, own_rules(rules, token_rules))))
    return finish(scanned.drop("content"), selected.drop("content"), mode, responses, provider, max_retries, own_rules(rules, token_rules), staged)


def scan_diff(
    files: DataFrame, listings: DataFrame, provider: str = "", regex_enabled: bool = True, ast_enabled: bool = True,
    rules: list[tuple] | None = None, token_rules: list[tuple] | None = None, folder: str | None = None,
) -> Scan:
    """Static scan of the changed files alone: no ignore rules, no languages, no model.

    Every listed path counts as scanned, even one that is not among the files.
    """
    staged = staging(files.sparkSession, folder)
    changed = read_changed_files(listings)
    touched = join_changed_files(files, changed)
    merged = staged.stage(merge_findings(static_scan(touched, regex_enabled, ast_enabled, rules=rules, token_rules=token_rules), has_model_rows=False))
    projects = listings.select("project").distinct()
    summary = scan_summary(changed, merged, "diff", provider)
    blank = {"scan_mode": "diff", "llm_provider": provider}
    full = (
        projects.join(summary, "project", "left")
        .na.fill(0, ["files_scanned", "total_findings"])
        .na.fill(blank)
        .withColumn("static_only", F.lit(provider == ""))
        .select(*summary.columns)
    )
    return Scan(merged, full, touched.select("project", "path").where(F.lit(False)), staged)


def scan_many_projects(files: DataFrame, **options) -> DataFrame:
    """Summary of every project in the table, from one job."""
    return scan(files, **options).summary
