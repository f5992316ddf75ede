import random
import re
from collections import Counter, defaultdict

import pytest

from scanloom.llm import common
from scanloom.llm import divergence as d

LONG = "q" * 100_000


def words_of(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)


def brute(rows, documents, ranks):
    rows = [(lang or "", source or "", words_of(text)) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        held = Counter(w for name, _, words in rows if name == lang for w in set(words))
        kept = sorted(w for w, n in held.items() if n >= documents)
        counts = defaultdict(Counter)
        for name, source, words in rows:
            if name == lang:
                counts[source].update(w for w in words if held[w] >= documents)
        total = sum(counts.values(), Counter())

        def shares(c):
            n, v = sum(c[w] for w in kept), len(kept)
            return {w: 1 + 10**9 * (c[w] + 2) // (n + 2 * v) for w in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(total)
        for s in counts:
            pairs = [(sum((p[s][w] - p[o][w]) ** 2 // (p[s][w] + p[o][w]) for w in kept), o) for o in counts if o != s]
            terms = [((p[s][w] - q[w]) ** 2 // (p[s][w] + q[w]), w) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, items, last in (("pair", pairs, None), ("term", terms, ranks)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(items[:last])]
    return sorted(out)


def corpus(seed=1, docs=160):
    rng = random.Random(seed)
    vocabulary = {
        "en": "the The thesis them of a ab abc abcd abcde abcdefgh abcdefghi abcdefghij étude étudé 漢字 漢 zz it's b2b".split(),
        "fr": "le la les leçon été étés x xx xxx xxxx xxxxx".split(), None: ["rare"], "": ["empty", "rare"],
    }
    rows = []
    for k in range(docs):
        lang = rng.choice(["en"] * 5 + ["fr"] * 3 + [None, ""])
        words = rng.choices(vocabulary[lang], weights=[1 / (i + 1) for i in range(len(vocabulary[lang]))], k=rng.randint(0, 30))
        rows.append((lang, rng.choice(["s1", "s1", "s1", "s2", "s3", None]), rng.choice([" ", ", ", "\n", "-7-"]).join(words)))
    rows += [("en", "s9", None), ("en", "s9", ""), ("de", "only", "one"), ("de", "two", "one"), ("xx", "a", "1 2 3"), ("xx", "b", None)]
    rows += [("en", f"long{k % 2}", f"{LONG} {LONG}a end{k}") for k in range(6)]
    return rows + rows[:5]


@pytest.fixture
def table(spark, tmp_path):
    def make(rows):
        path = str(tmp_path / f"t{random.random()}")
        spark.createDataFrame([(*r, 1, True) for r in rows], "lang string, source string, text string, width int, complete boolean").repartition(4).write.parquet(path)
        return spark.read.parquet(path)

    return make


@pytest.mark.parametrize("documents", [1, 4, 1000])
def test_rows_equal_brute_force(table, documents):
    rows = corpus()
    assert sorted(tuple(r) for r in d.audit(table(rows), documents, 5).collect()) == brute(rows, documents, 5)


def test_small_steps_and_no_broadcast(table, monkeypatch):
    monkeypatch.setattr(d, "STEP", 300)
    monkeypatch.setattr(d, "CELLS", 7)
    monkeypatch.setattr(d, "GROUPS", 0)
    monkeypatch.setattr(d, "few_or_all", lambda keys: keys)
    rows = corpus(2)
    assert sorted(tuple(r) for r in d.audit(table(rows), 3, 10).collect()) == brute(rows, 3, 10)


def test_rare_prefixes_are_not_extended(table, spark):
    rows = [("en", "s", "common commons rarely")] * 5 + [("en", "s", "rarest other")] * 2
    found = common.stage(d.pieces(table(rows)), "pieces")
    assert sorted(bytes(r.term).decode() for r in d.kept_terms(found, 5).collect()) == ["common", "commons", "rarely"]
    assert {bytes(r.prefix) for r in found.filter("NOT complete AND width = 4").collect()} == {b"comm", b"rare", b"othe"}
    by_width = {r.width: r.docs for r in found.filter("NOT complete AND prefix IN ('ra', 'rare')").groupBy("width").agg({"docs": "sum"}).withColumnRenamed("sum(docs)", "docs").collect()}
    assert by_width == {2: 7, 4: 7}


def test_large_counts_stay_exact(spark):
    row = spark.range(1).select(
        d.share(d.F.lit(10**13 + 1).cast("long"), d.F.lit(7 * 10**13).cast("long"), d.F.lit(12345).cast("long")).alias("p")
    ).first()
    assert row.p == 1 + 10**9 * (10**13 + 3) // (7 * 10**13 + 2 * 12345)


def test_empty_table(table):
    assert d.audit(table([])).count() == 0
