"""URL filter: host and path rules first, then logistic regression on hashed character n-grams of host and path.

The labelled table of the registered query is made of the page URLs that a rule decides. ``fit`` takes at most ``sample``
rows of it, those with the smallest hash, so the same rows at any partitioning; everything else is scored in full.

A null URL, or one without ``://``, has an empty host and path, fits no rule and is judged by the model on no n-grams
(its intercept). Equal URLs get equal verdicts. A labelled table that is empty or of one class gives a model that repeats
that class, or allows where there is none. Columns beside the id and the URL are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import LOWER, UPPER, hash_sample, mix

#: (host and path prefix, verdict)
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
#: Weights of the model, lengths of the n-grams, and the bound of labelled rows that a fit takes to the driver.
BUCKETS, NGRAMS, SAMPLE = 1 << 15, (3, 4, 5), 20_000


def host_and_path(url) -> tuple[F.Column, F.Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?`` or ``#``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host, path, rules: Sequence[tuple[str, str]] = RULES) -> F.Column:
    """The longest rule whose host is that of the URL or a parent of it and whose path starts the URL's; else null."""
    picked = None
    for rule, _ in sorted(rules, key=lambda r: -len(r[0])):
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        picked = F.when(fits, F.lit(rule)) if picked is None else picked.when(fits, F.lit(rule))
    return picked if picked is not None else F.lit(None).cast("string")


def features(hosts: pd.Series, paths: pd.Series, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of ``^host/`` and of the path: bucket and row of each occurrence, told apart by field."""
    cols, rows = [], []
    for field, values in enumerate((hosts, paths)):
        text = ["^" + (v or "") + "$" for v in values]
        raw = [np.frombuffer(t.encode(), np.uint8) for t in text]
        data = np.concatenate(raw).astype(np.uint64) if raw else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
        for n in NGRAMS:
            count = len(data) - n + 1
            if count <= 0:
                continue
            value = np.full(count, field * 16 + n, np.uint64)
            with np.errstate(over="ignore"):
                for k in range(n):
                    value = value * np.uint64(0x100000001B3) + data[k : k + count] + np.uint64(1)
            whole = owner[:count] == owner[n - 1 :]
            cols.append((mix(value[whole]) % np.uint64(buckets)).astype(np.int64))
            rows.append(owner[:count][whole])
    if not cols:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(cols), np.concatenate(rows)


@dataclass
class Model:
    weights: np.ndarray
    intercept: float

    def score(self, hosts: pd.Series, paths: pd.Series) -> np.ndarray:
        """Probability of ``allow``; the n-grams of a URL count by the root of their number."""
        cols, rows = features(hosts, paths, len(self.weights))
        n = len(hosts)
        total = np.bincount(rows, self.weights[cols], n)
        count = np.maximum(np.bincount(rows, minlength=n), 1)
        return 1 / (1 + np.exp(-np.clip(total / np.sqrt(count) + self.intercept, -30, 30)))


def train(hosts: pd.Series, paths: pd.Series, allow: np.ndarray, rounds: int = 200, rate: float = 1.0, decay: float = 1e-4) -> Model:
    """Full-batch gradient descent with per-weight step sizes; deterministic."""
    cols, rows = features(hosts, paths)
    n = len(allow)
    weights, squares = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8)
    if n == 0 or allow.all() or not allow.any():
        return Model(weights, 30.0 if n == 0 or allow.all() else -30.0)
    scale = 1 / np.sqrt(np.maximum(np.bincount(rows, minlength=n), 1))
    intercept = 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, weights[cols], n) * scale + intercept, -30, 30)))
        error = (p - allow) / n
        gradient = np.bincount(cols, (error * scale)[rows], BUCKETS) + decay * weights
        squares += gradient**2
        weights -= rate * 0.1 * gradient / np.sqrt(squares)
        intercept -= error.sum()
    return Model(weights, intercept)


def labelled_sample(labelled: DataFrame, sample: int = SAMPLE) -> pd.DataFrame:
    """At most ``sample`` distinct labelled URLs (host, path, allow), those of the smallest hash."""
    return hash_sample(labelled.select("host", "path", "allow").distinct(), sample, "host", "path", "allow").toPandas()


def judge(
    pages: DataFrame, labelled: DataFrame | None = None, rules: Sequence[tuple[str, str]] = RULES, threshold: float = 0.5,
    id_column: str = "page_id", url_column: str = "url",
) -> DataFrame:
    """Host, path, rule, probability of allow and verdict of each page.

    ``labelled`` (host, path, allow boolean) trains the model; without it the URLs that a rule decides do.
    """
    host, path = host_and_path(F.col(url_column))
    parts = pages.select(F.col(id_column).alias("page_id"), host.alias("host"), path.alias("path"))
    ruled = parts.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    by_rule = F.lit(None).cast("string")
    for rule, verdict in rules:
        by_rule = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(by_rule)
    ruled = ruled.withColumn("ruled", by_rule)
    if labelled is None:
        labelled = ruled.filter("rule IS NOT NULL").select("host", "path", (F.col("ruled") == "allow").alias("allow"))
    taken = labelled_sample(labelled)
    model = train(taken["host"], taken["path"], taken["allow"].to_numpy(bool))

    @F.pandas_udf("double")
    def scored(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series(model.score(hosts, paths))

    out = ruled.withColumn("score", scored("host", "path"))
    verdict = F.coalesce("ruled", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
