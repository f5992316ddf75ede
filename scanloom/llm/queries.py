"""Registered queries of this package, each over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm import decontaminate, divergence, fingerprint, html_text, infill, near_dup, pieces, pii, sharding, substring_dedup, suffix_dedup, toxicity, url_filter
from scanloom.llm.common import table as read_table
from scanloom.llm.common import use_own_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    use_own_folder(spark)
    return read_table(spark, sf_dir, name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_")


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op4_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode(table(spark, sf_dir, "documents"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "n_chunks", "ids", "round_trip")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    classifier = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, classifier)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = infill.fill_in_middle(table(spark, sf_dir, "documents"))
    back = infill.restored(F.col("output"), F.col("form"))
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256")
    )


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_document_fingerprints": op3_document_fingerprints,
    "op4_dart_minhash": op4_dart_minhash,
    "op5_html_extraction": op5_html_extraction,
    "op6_sampled_splitters": op6_sampled_splitters,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_pii": op8_pii,
    "op9_url_filter": op9_url_filter,
    "op10_toxicity": op10_toxicity,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_source_divergence": op12_source_divergence,
    "op13_suffix_dedup": op13_suffix_dedup,
}

_WORDS = (
    r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

OP2_SQL = f"""
WITH doc_words AS (SELECT doc_id, coalesce({_WORDS}, []) AS words FROM documents),
item_words AS (
    SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item_id, {_WORDS} AS words FROM benchmark
    WHERE len(coalesce({_WORDS}, [])) > 0
),
item_windows AS (
    SELECT DISTINCT item_id, least(len(words), 10) AS n, array_to_string(words[k : k + 9], ' ') AS phrase
    FROM (SELECT *, unnest(range(1, greatest(1, len(words) - 9) + 1)) AS k FROM item_words)
),
doc_windows AS (
    SELECT doc_id, k, n, array_to_string(words[k : k + n - 1], ' ') AS phrase
    FROM (SELECT *, unnest(range(1, len(words) + 1)) AS k FROM doc_words), (SELECT DISTINCT n FROM item_windows)
    WHERE k + n - 1 <= len(words)
),
found AS (SELECT doc_id, k, n, item_id FROM doc_windows JOIN item_windows USING (n, phrase)),
hits AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM found) GROUP BY doc_id
),
named AS (
    SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256
    FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP11_SQL = """
WITH cut AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
           sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS digits
    FROM documents
),
drawn AS (
    SELECT *, len(units) AS n, ('0x' || digits[1:8])::BIGINT % (len(units) + 1) AS a, ('0x' || digits[9:16])::BIGINT % (len(units) + 1) AS b,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || digits[17:24])::BIGINT % 100 >= 100
                THEN 'plain' WHEN ('0x' || digits[25:32])::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM cut
),
parts AS (
    SELECT doc_id, n, form, text, coalesce(array_to_string(units[1 : least(a, b)], ''), '') AS prefix,
           coalesce(array_to_string(units[least(a, b) + 1 : greatest(a, b)], ''), '') AS middle,
           coalesce(array_to_string(units[greatest(a, b) + 1 :], ''), '') AS suffix
    FROM drawn
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form != 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
       CASE WHEN form != 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                   ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""

OP12_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
    FROM documents
),
words AS (SELECT r, lang, source, unnest(words) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
sizes AS (SELECT lang, count(k.term) AS v FROM (SELECT DISTINCT lang FROM docs) LEFT JOIN kept k USING (lang) GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
dense AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT lang, source FROM docs) g
    JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
shares AS (
    SELECT *, 1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS p
    FROM dense
),
overall AS (
    SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)) AS q
    FROM (SELECT lang, term, sum(n) AS n FROM dense GROUP BY lang, term)
),
pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY a.lang, a.source, b.source
    UNION ALL
    SELECT a.lang, a.source, b.source, 0 FROM (SELECT DISTINCT lang, source FROM docs) a JOIN (SELECT DISTINCT lang, source FROM docs) b
    ON a.lang = b.lang AND a.source != b.source JOIN sizes s ON s.lang = a.lang WHERE s.v = 0
),
both_parts AS (
    SELECT lang, source, 'pair' AS part, item, value FROM pairs
    UNION ALL
    SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares JOIN overall USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM both_parts
) WHERE part = 'pair' OR rank <= 10
"""

OP13_SQL = """
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
),
strings AS (SELECT r, doc_id, k, substr(h, 2 * k + 1, 100) AS w FROM (SELECT *, unnest(range(0, n - 49)) AS k FROM docs)),
firsts AS (SELECT w, min(doc_id) AS least FROM strings GROUP BY w HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT r, k FROM strings JOIN firsts USING (w) WHERE least < doc_id),
numbered AS (
    SELECT r, k, sum(fresh) OVER (PARTITION BY r ORDER BY k) AS island
    FROM (SELECT r, k, CASE WHEN k - lag(k) OVER (PARTITION BY r ORDER BY k) <= 50 THEN 0 ELSE 1 END AS fresh FROM hits)
),
spans AS (
    SELECT *, coalesce(lag(e) OVER (PARTITION BY r ORDER BY b), 0) AS before
    FROM (SELECT r, min(k) AS b, max(k) + 50 AS e FROM numbered GROUP BY r, island)
),
cut AS (
    SELECT r, sum(e - b) AS n_removed, count(*) AS n_spans, max(e) AS last, string_agg(substr(h, 2 * before + 1, 2 * (b - before)), '' ORDER BY b) AS head
    FROM spans JOIN docs USING (r) GROUP BY r
)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM docs LEFT JOIN cut USING (r)
"""

SQL: dict[str, str] = {
    "op2_benchmark_decontamination": OP2_SQL, "op11_fill_in_middle": OP11_SQL, "op12_source_divergence": OP12_SQL, "op13_suffix_dedup": OP13_SQL,
}
