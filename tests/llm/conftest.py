"""Fixtures of the tests of this folder; the session comes from the folder above."""

import random

import pytest

SYLLABLES = "ka lo mi ter an von sel da ru pi gor ne ta fi lum os ver ni cho ba".split()


@pytest.fixture
def prose():
    """Invented prose: ``prose(seed, words)``."""

    def make(seed: int, words: int) -> str:
        rng = random.Random(seed)
        return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(words))

    return make


@pytest.fixture
def docs_of(spark, tmp_path):
    """A written table of (doc_id, text) rows, with columns whose names clash with those of the operators."""

    def make(rows, extra: bool = True):
        table = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, row_ int, score string")
        path = str(tmp_path / f"docs-{random.random()}")
        (table if extra else table.select("doc_id", "text")).repartition(3).write.parquet(path)
        return spark.read.parquet(path)

    return make
