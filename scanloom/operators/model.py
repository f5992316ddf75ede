"""Model-assisted analysis as table work: prompts out, responses in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions import catalog
from scanloom.functions.identity import file_path
from scanloom.functions.once import computed_once
from scanloom.functions.severity import normalize_severity
from scanloom.functions.strict_json import allow_duplicate_keys, kind, strict_parse
from scanloom.functions.text import count_newlines, filled, trim_space
from scanloom.operators.filters import keep_matching
from scanloom.operators.files import language_of
from scanloom.operators.scan import rule_value

ITEM_TEXTS = ["title", "description", "severity", "owasp_id", "cwe", "recommendation"]
ITEM_LINES = ["line_start", "line_end"]
ITEM = "struct<" + ",".join([f"{c}:string" for c in ITEM_TEXTS] + [f"{c}:bigint" for c in ITEM_LINES]) + ">"

# Where each provider keeps the answer and the counts of used tokens.
TEXT_PATHS = {
    "openai": "$.choices[0].message.content",
    "gemini": "$.candidates[0].content.parts[0].text",
    "anthropic": "$.content[0].text",
}
TOKEN_PATHS = {
    "openai": ["$.usage.total_tokens"],
    "gemini": ["$.usageMetadata.promptTokenCount", "$.usageMetadata.candidatesTokenCount"],
    "anthropic": ["$.usage.input_tokens", "$.usage.output_tokens"],
}
# The providers whose answers are trimmed before and after a code fence is taken off.
TRIMMING_PROVIDERS = ["gemini", "anthropic"]


# ---- prompts ---------------------------------------------------------------


def code_chunks(files: DataFrame) -> DataFrame:
    """One chunk per file: the whole file from line 1."""
    return files.select(
        "project",
        "path",
        file_path(F.col("project"), F.col("path")).alias("file_path"),
        language_of(F.col("path")).alias("language"),
        F.lit(1).cast("bigint").alias("start_line"),
        (count_newlines(F.col("content")) + 1).cast("bigint").alias("end_line"),
        "content",
    )


def _context_text(hits: Column, rules: list[tuple] | None = None) -> Column:
    """Context for the model from the static hits of a file; empty without hits."""
    source = lambda hit: F.when(hit["stage"] == catalog.SOURCE_STAGE["regex"], F.lit("regex")).otherwise(F.lit("ast"))
    lines = F.transform(
        hits,
        lambda hit: filled(
            catalog.CONTEXT_LINE, source=source(hit), line=hit["line"], title=rule_value(hit["rule_id"], "title", rules)
        ),
    )
    text = F.concat(F.lit(catalog.CONTEXT_HEADER), F.array_join(lines, ""), F.lit(catalog.CONTEXT_TRAILER))
    return F.when(F.size(hits) > 0, text).otherwise(F.lit(""))


def static_context(scanned: DataFrame, rules: list[tuple] | None = None) -> DataFrame:
    """``(project, path, context)``: the un-merged static findings of each file as text for the prompt."""
    return scanned.select("project", "path", _context_text(F.col("hits"), rules).alias("context"))


def build_prompts(
    scanned: DataFrame, max_tokens: int = catalog.MAX_TOKENS, temperature: float = catalog.TEMPERATURE,
    rules: list[tuple] | None = None,
) -> DataFrame:
    """Prompts for files that carry ``content`` and ``hits``. All from one row, so content is not shuffled."""
    chunk_end = count_newlines(F.col("content")) + 1
    user = filled(
        catalog.USER_PROMPT,
        file=file_path(F.col("project"), F.col("path")),
        language=F.col("language"),
        lines=F.concat(F.lit("1-"), chunk_end),
        code=F.col("content"),
        context=_context_text(F.col("hits"), rules),
    )
    return scanned.select(
        "project",
        "path",
        "language",
        F.lit(1).cast("bigint").alias("start_line"),
        chunk_end.cast("bigint").alias("end_line"),
        F.lit(catalog.SYSTEM_PROMPT).alias("system"),
        user.alias("user"),
        F.lit(max_tokens).alias("max_tokens"),
        F.lit(temperature).alias("temperature"),
    )


def combined_prompt(prompts: DataFrame) -> DataFrame:
    """System and user prompt as one text, for the provider that takes only one."""
    return prompts.withColumn("prompt", F.concat("system", F.lit("\n\n"), "user"))


# ---- responses -------------------------------------------------------------


def _variant_text(envelope: Column, path: str) -> Column:
    """Text at a path: '' when it is JSON null, null when it is missing or no string."""
    value = F.try_variant_get(envelope, path, "variant")
    return F.when(kind(value) == "STRING", value.cast("string"))


def _answer(envelope: Column, provider: str) -> Column:
    """The answer of a provider; null also when a token count is no whole number."""
    counts = [kind(F.try_variant_get(envelope, path, "variant")) for path in TOKEN_PATHS[provider]]
    whole = F.forall(F.array(*counts), lambda k: k.isin("BIGINT", "VOID"))
    return F.when(whole, _variant_text(envelope, TEXT_PATHS[provider]))


def _by_provider(make) -> Column:
    out = F
    for provider in TEXT_PATHS:
        out = out.when(F.col("provider") == provider, make(provider))
    return out.otherwise(F.lit(None))


def extract_model_text(responses: DataFrame) -> DataFrame:
    """Adds ``text``, the answer inside the envelope of the provider; null when the attempt failed."""
    allow_duplicate_keys(responses.sparkSession)
    envelope = F.get(F.col("_envelope"), F.lit(0))
    text = _by_provider(lambda provider: _answer(envelope, provider))
    parsed = responses.withColumn("_envelope", strict_parse(F.col("body")))
    return computed_once(parsed.withColumn("text", F.when(F.col("status") == 200, text)).drop("_envelope"), "text")


def _drop_marks(text: Column) -> Column:
    """Takes a leading code mark (with or without the json tag) and a trailing one off.

    A text that is nothing but a mark is left alone by one provider and emptied by the others; neither parses.
    """
    return F.regexp_replace(F.regexp_replace(text, r"\A```(?:json)?", ""), r"```\z", "")


def unfenced(provider: Column, text: Column) -> Column:
    trimmed = trim_space(_drop_marks(trim_space(text)))
    return F.when(provider.isin(TRIMMING_PROVIDERS), trimmed).otherwise(_drop_marks(text))


def strip_code_fence(texts: DataFrame) -> DataFrame:
    """Adds ``json_text``: the text itself when it is JSON, else the text inside its code fence."""
    allow_duplicate_keys(texts.sparkSession)
    bare = unfenced(F.col("provider"), F.col("text"))
    direct = _with_items(texts, F.col("text"))
    return direct.withColumn("json_text", F.when(F.col("items").isNotNull(), F.col("text")).otherwise(bare)).drop(
        "items"
    )


def _with_items(table: DataFrame, text: Column) -> DataFrame:
    """Adds ``items``, the findings in a JSON text; null unless every element has the right types."""
    parsed = computed_once(table.withColumn("_json", strict_parse(text)), "_json")
    top = F.get(F.col("_json"), F.lit(0))
    listed = F.when(F.startswith(kind(top), F.lit("ARRAY")), F.try_variant_get(top, "$", "array<variant>"))
    no_pairs = F.array().cast("array<struct<key:string,value:variant>>")
    pairs = F.transform(
        listed,
        lambda e: F.when(kind(e) == "VOID", no_pairs).when(
            F.startswith(kind(e), F.lit("OBJECT")), F.map_entries(F.try_variant_get(e, "$", "map<string,variant>"))
        ),
    )
    checked = F.transform(F.transform(pairs, _fields), _typed)
    is_null = F.col("_json").isNotNull() & (kind(top) == "VOID")
    rows = parsed.withColumn("_checked", F.when(is_null, F.array().cast(f"array<{ITEM}>")).otherwise(checked))
    good = F.forall("_checked", lambda item: item.isNotNull())
    return computed_once(rows.withColumn("items", F.when(good, F.col("_checked"))).drop("_json", "_checked"), "items")


def _fields(pairs: Column) -> Column:
    """The known fields of an item, still untyped; null for an element that is no object. Any letter case."""
    lowered = F.transform(
        pairs, lambda p: F.struct(F.translate(F.lower(p["key"]), "ſ", "s").alias("name"), p["value"].alias("value"))
    )

    def value(name: str) -> Column:
        return F.try_element_at(F.filter(lowered, lambda p: p["name"] == name), F.lit(-1))["value"]

    return F.when(pairs.isNotNull(), F.struct(*[value(n).alias(n) for n in ITEM_TEXTS + ITEM_LINES]))


def _typed(fields: Column) -> Column:
    """The item with its types; null when a field has a wrong one."""
    good = fields.isNotNull()
    for names, wanted in ((ITEM_TEXTS, "STRING"), (ITEM_LINES, "BIGINT")):
        good = good & F.forall(F.array(*[kind(fields[n]) for n in names]), lambda k: k.isin(wanted, "VOID"))
    texts = [F.coalesce(F.try_variant_get(fields[n], "$", "string"), F.lit("")).alias(n) for n in ITEM_TEXTS]
    lines = [F.coalesce(F.try_variant_get(fields[n], "$", "bigint"), F.lit(0)).alias(n) for n in ITEM_LINES]
    return F.when(good, F.struct(*texts, *lines))


def with_model_items(responses: DataFrame) -> DataFrame:
    """Adds ``items`` to raw responses: the parsed findings, or null when the attempt failed in any way."""
    direct = _with_items(extract_model_text(responses), F.col("text")).withColumnRenamed("items", "_direct")
    # Only a text that is no list of findings as it stands is looked at again without its fence.
    again = F.when(F.col("_direct").isNull(), unfenced(F.col("provider"), F.col("text")))
    both = _with_items(direct, again)
    return both.withColumn("items", F.coalesce("_direct", "items")).drop("_direct")


def first_successful_attempt(responses: DataFrame, max_retries: int = catalog.MAX_RETRIES) -> DataFrame:
    """The first attempt of each file that gave parsable findings, among the allowed number of tries."""
    tried = with_model_items(responses.where(F.col("attempt") <= max_retries)).where(F.col("items").isNotNull())
    # Only the text goes through the shuffle as sort key; equal attempts are settled by it.
    order = F.struct("attempt", "provider", "body")
    return (
        tried.groupBy("project", "path")
        .agg(F.min_by(F.struct("provider", "attempt", "body", "items"), order).alias("r"))
        .select("project", "path", "r.provider", "r.attempt", "r.body", "r.items")
    )


def failed_model_files(responses: DataFrame, max_retries: int = catalog.MAX_RETRIES) -> DataFrame:
    """Files that were asked about and have no successful attempt; the scan goes on without them."""
    # attempts that don't count go without their body, so that nothing is read for them
    counted = responses.withColumn("body", F.when(F.col("attempt") <= max_retries, F.col("body")))
    tried = with_model_items(counted)
    good = F.count_if((F.col("attempt") <= max_retries) & F.col("items").isNotNull())
    return tried.groupBy("project", "path").agg(good.alias("n")).where(F.col("n") == 0).select("project", "path")


def parse_model_findings(responses: DataFrame) -> DataFrame:
    """One row per finding in responses that have ``items``, with its place in the response."""
    return (
        responses.select("project", "path", "provider", "attempt", F.posexplode_outer("items").alias("pos", "item"))
        .where(F.col("item").isNotNull())
        .select("project", "path", "provider", "attempt", F.col("pos").cast("bigint").alias("pos"), "item.*")
    )


def rebase_lines(items: DataFrame, chunk_start: Column | None = None) -> DataFrame:
    """Model items as findings: lines counted from the chunk, severity normalised."""
    shift = (F.lit(1) if chunk_start is None else chunk_start) - 1
    empty = F.lit("")
    return items.select(
        "project",
        empty.alias("id"),
        "title",
        "description",
        file_path(F.col("project"), F.col("path")).alias("file_path"),
        (F.col("line_start") + shift).alias("start_line"),
        (F.col("line_end") + shift).alias("end_line"),
        normalize_severity(F.col("severity")).alias("severity"),
        empty.alias("confidence"),
        "owasp_id",
        "cwe",
        F.lit("llm").alias("source"),
        empty.alias("code_snippet"),
        "recommendation",
        empty.alias("raw_output"),
        F.struct(
            F.lit(catalog.SOURCE_STAGE["llm"]).alias("stage"), F.col("pos").alias("a"), F.lit(0).cast("bigint").alias("b")
        ).alias("ord"),
    )


def model_findings(
    responses: DataFrame, selected: DataFrame | None = None, max_retries: int = catalog.MAX_RETRIES
) -> DataFrame:
    """Findings of the model, for the selected files only when they are given."""
    asked = responses if selected is None else keep_matching(responses, selected, ["project", "path"])
    return rebase_lines(parse_model_findings(first_successful_attempt(asked, max_retries)))


def token_usage(responses: DataFrame, max_retries: int = catalog.MAX_RETRIES) -> DataFrame:
    """Tokens used by the successful attempts, per provider."""
    def used(provider: str) -> Column:
        envelope = F.get(F.col("_envelope"), F.lit(0))
        total = F.lit(0).cast("bigint")
        for path in TOKEN_PATHS[provider]:
            total = total + F.coalesce(F.try_variant_get(envelope, path, "bigint"), F.lit(0))
        return total

    return (
        first_successful_attempt(responses, max_retries)
        .select("provider", strict_parse(F.col("body")).alias("_envelope"))
        .select("provider", _by_provider(used).alias("tokens"))
        .groupBy("provider")
        .agg(F.count("*").alias("files"), F.sum("tokens").alias("tokens_used"))
    )
