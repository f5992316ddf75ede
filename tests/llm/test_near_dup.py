import random
import re

import numpy as np
import pytest

from scanloom.llm import near_dup as n
from scanloom.llm.components import components


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(docs, similarity=0.8):
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [shingles(t) for _, t in docs]
    for a in range(len(docs)):
        for b in range(a):
            same = len(sets[a] & sets[b])
            if (docs[a][1] or "") == (docs[b][1] or "") or (same and same >= similarity * len(sets[a] | sets[b])):
                parent[root(a)] = root(b)
    groups = {}
    for k, (i, _) in enumerate(docs):
        groups.setdefault(root(k), []).append(i)
    return sorted((sorted(g, key=str) for g in groups.values()), key=str)


def edited(text, places):
    w = text.split()
    for p in places:
        w[p % len(w)] = f"changed{p}"
    return " ".join(w)


def documents(prose):
    base = prose(1, 200)
    docs = [(1, base)] + [(2 + k, edited(base, [k * 7 + 3])) for k in range(12)]
    docs += [(30, prose(2, 150)), (31, prose(2, 150)), (32, prose(2, 150).upper()), (33, None), (34, ""), (35, "..."), (36, "one two"), (37, "One, two!"), (38, "one two three")]
    docs += [(40, prose(3, 300)), (41, edited(prose(3, 300), range(0, 300, 12))), (42, prose(4, 60) + " " + prose(9, 60)), (43, prose(5, 60) + " " + prose(9, 60))]
    return docs + [(30, prose(2, 150)), (None, prose(7, 90)), (50, prose(8, 20_000))]


def test_classes_equal_brute_force(docs_of, prose):
    docs = documents(prose)
    found = {}
    for r in n.classes(docs_of(docs)).collect():
        found.setdefault(r.class_row, []).append(r.doc_id)
    assert sorted((sorted(g, key=str) for g in found.values()), key=str) == brute(docs)


def test_one_row_per_row_and_one_kept_per_class(docs_of, prose):
    docs = documents(prose)
    table = docs_of(docs)
    got = n.near_duplicates(table).collect()
    assert len(got) == len(docs)
    assert {r.class_id for r in got if r.doc_id in range(1, 14)} == {1}
    assert {r.class_size for r in got if r.doc_id == 30} == {4}
    kept = n.keep_one(table)
    assert kept.columns == table.columns
    assert kept.count() == len(brute(docs))


def test_empty_table(docs_of):
    assert n.near_duplicates(docs_of([])).count() == 0


def test_blocks_find_pairs_across_components(spark, monkeypatch):
    monkeypatch.setattr(n, "BLOCK", 4)
    rng = np.random.default_rng(0)
    signatures = rng.integers(0, 255, (30, 20), dtype=np.uint8)
    signatures[17] = signatures[3]
    signatures[29] = signatures[28]
    signatures[11] = signatures[5]  # alike by signature only
    elements = [np.arange(k * 50, k * 50 + 20, dtype=np.uint64) for k in range(30)]
    elements[17] = elements[3] + np.uint64(1)  # 19 of 21
    # all share both buckets, 5 and 9
    rows = [(b, k, k if k != 29 else 28, 30, signatures[k].tobytes(), [5, 9], elements[k].tobytes()) for k in range(30) for b in (5, 9)]
    table = spark.createDataFrame(rows, "key long, node long, component long, count long, signature binary, keys array<long>, elements binary")
    assert [tuple(sorted(r)) for r in n.across_components(table, 20, 0.9, 0.8).collect()] == [(3, 17)]


@pytest.mark.parametrize("similarity", [0.3, 0.6, 0.9])
def test_signatures_estimate_weighted_jaccard(similarity):
    rng = np.random.default_rng(7)
    elements = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    a = rng.uniform(0.2, 3.0, 400)
    b = a * rng.uniform(similarity, 2 - similarity, 400)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    size = 4000
    sets = n.signatures(np.tile(elements, 2), np.concatenate([a, b]), np.repeat([0, 1], 400), 2, size)
    assert abs((sets[0] == sets[1]).mean() - true) < 4 * (true * (1 - true) / size) ** 0.5
    assert (sets != 0).all()


def test_signatures_do_not_depend_on_neighbours():
    elements = np.arange(1, 51, dtype=np.uint64)
    alone = n.signatures(elements, np.ones(50), np.zeros(50, np.int64), 1, 64)
    beside = n.signatures(np.concatenate([elements[::-1], elements + np.uint64(99)]), np.ones(100), np.repeat([0, 1], 50), 3, 64)
    assert (alone[0] == beside[0]).all()
    assert (beside[2] == 0).all()


def test_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[k] for k in range(41)} == {0}
    assert {got[k] for k in range(100, 130)} == {100}
    assert got[201] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def reworded(words, share, rng):
    """``words`` with single words replaced so that about ``share`` of the shingles are another's."""
    out = list(words)
    for k in range(0, len(out), max(1, round(5 / share))):
        out[min(len(out) - 1, k + rng.randrange(3))] = f"new{rng.randrange(10**9)}"
    return out


def brute_classes(rows, similarity=0.8):
    sets = []
    for _, text in rows:
        words = (text or "").split()
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = 0
    for x in range(len(rows)):
        for y in range(x):
            common = len(sets[x] & sets[y])
            if rows[x][1] == rows[y][1] or (common and common >= similarity * (len(sets[x]) + len(sets[y]) - common)):
                parent[root(x)] = root(y)
                links += 1
    groups = {}
    for x, (doc, _) in enumerate(rows):
        groups.setdefault(root(x), []).append(doc)
    return sorted(sorted(g) for g in groups.values()), links


@pytest.mark.parametrize("block", [512, 16])
def test_groups_below_and_above_the_threshold_equal_brute_force(docs_of, prose, monkeypatch, block):
    """Texts at 0.70 to 0.80 from each other stay apart unless they are linked, and give no rows by the square of their number."""
    monkeypatch.setattr(n, "BLOCK", block)
    rng = random.Random(3)
    rows = []
    for group, share in enumerate((0.13, 0.15, 0.2, 0.05, 0.08)):
        base = prose(group, 150 + 30 * group).split()
        rows += [(1000 * group + k, " ".join(reworded(base, share, rng))) for k in range(60)]
    rows += [(9000 + k, rows[200][1]) for k in range(30)]
    want, links = brute_classes(rows)
    found = n.near_duplicates(docs_of(rows)).collect()
    got = {}
    for r in found:
        got.setdefault(r.class_id, []).append(r.doc_id)
    assert sorted(sorted(g) for g in got.values()) == want
    assert all(r.class_size == len(got[r.class_id]) for r in found)
    assert links > 1000 and len(want) > 60


def test_a_block_gives_fewer_links_than_members(docs_of, prose, monkeypatch):
    staged = {}
    original = n.stage

    def count(rows, name, *more):
        out = original(rows, name, *more)
        staged[name] = out
        return out

    monkeypatch.setattr(n, "stage", count)
    rng = random.Random(5)
    base = prose(50, 200).split()
    rows = [(k, " ".join(reworded(base, 0.14, rng))) for k in range(150)]
    n.near_duplicates(docs_of(rows)).count()
    assert staged["open-rows"].count() > 500 and staged["more"].count() < 150


def test_weighted_sets(spark):
    a, b = (np.array(x, np.uint64) for x in ([1, 2, 3, 4], [2, 3, 4, 5]))
    assert n.similar_sets(a, b, 0.6) and not n.similar_sets(a, b, 0.61) and not n.similar_sets(a[:0], b[:0], 0.5)
