import hashlib
import random

import numpy as np
import pytest

from scanloom.llm import suffix_dedup as s
from scanloom.llm.suffix_order import grouped, suffix_order


def test_suffix_order_equals_sorting():
    rng = random.Random(1)
    for _ in range(1500):
        text = [rng.randint(1, rng.choice([1, 2, 3, 26])) for _ in range(rng.randint(0, 40))] + [0]
        assert suffix_order(np.array(text)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    assert suffix_order(np.zeros(0, np.int64)).tolist() == []


def test_groups_are_lyndon_prefixes():
    rng = random.Random(2)
    for _ in range(200):
        text = [rng.randint(1, 3) for _ in range(rng.randint(1, 30))] + [0]
        start, prev = grouped(np.array(text))
        end = [next((j for j in range(i + 1, len(text)) if text[j:] < text[i:]), len(text)) for i in range(len(text))]
        words = [tuple(text[i:j]) for i, j in enumerate(end)]
        order = sorted(set(words))
        assert [sorted(set(start)).index(g) for g in start] == [order.index(w) for w in words]
        for i in range(len(text)):
            assert prev[i] == max((j for j in range(i) if words[j] < words[i]), default=-1)


def brute(rows, length=50):
    first = {}
    raw = [(i, (t or "").encode()) for i, t in rows]
    for i, t in raw:
        if i is not None:
            for k in range(len(t) - length + 1):
                w = t[k : k + length]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in raw:
        gone = [False] * len(t)
        for k in range(len(t) - length + 1):
            if i is not None and first[t[k : k + length]] < i:
                gone[k : k + length] = [True] * length
        edges = [k for k in range(len(t) + 1) if (k < len(t) and gone[k]) != (k > 0 and gone[k - 1])]
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((str(i), len(t), hashlib.sha256(kept).hexdigest(), list(zip(edges[::2], edges[1::2], strict=True))))
    return sorted(out)


def found(docs, **options):
    rows = s.without_repeats(docs, **options).collect()
    return sorted((str(r.doc_id), r.n_bytes, hashlib.sha256(bytes(r.kept)).hexdigest(), [(x.begin, x.end) for x in r.spans]) for r in rows)


def corpus(prose, seed=1, docs=70):
    rng = random.Random(seed)
    lines = [prose(900 + k, rng.randint(3, 25)) for k in range(12)]
    notice = "All rights of this notice are kept by the one who wrote it, 49"  # shared with differing neighbours
    rows = []
    for k in range(docs):
        parts = [prose(seed * 1000 + k * 20 + j, rng.randint(1, 30)) for j in range(rng.randint(1, 5))]
        for _ in range(rng.randint(0, 3)):
            line = rng.choice(lines)
            parts.insert(rng.randint(0, len(parts)), line[rng.randint(0, 40) : len(line) - rng.randint(0, 30)])
        if k % 3 == 0:
            parts.append(notice)
        rows.append((rng.randint(0, 200), " ".join(parts)))
    rows += [(1, None), (2, ""), (3, "x" * 49), (4, "x" * 50), (5, "x" * 51), (0, "x" * 30), (6, "x" * 5000), (7, "ab" * 3000), (8, "ba" * 60)]
    rows += [(300 + k, rows[5][1]) for k in range(10)] + [rows[9]] * 3 + [(None, rows[11][1]), (None, "é" * 60), (9, "é" * 40), (10, "aé" + "é" * 30)]
    rows += [(400, "漢字かな" * 40), (401, "x漢字かな" * 40), (402, "字かな漢" * 30), (20, prose(77, 20_000)), (21, prose(78, 9) + prose(77, 20_000)[70_000:])]
    return rows


def test_rows_equal_brute_force(docs_of, prose):
    rows = corpus(prose)
    want = brute(rows)
    assert sum(len(r[3]) for r in want) > 50
    assert found(docs_of(rows)) == want


def test_slices_small_groups_and_no_broadcast(docs_of, prose, monkeypatch):
    rows = corpus(prose, 2)
    monkeypatch.setattr(s, "SLICE", 777)
    monkeypatch.setattr(s, "SYMBOLS", 500)
    assert found(docs_of(rows), few=0, together=2) == brute(rows)


@pytest.mark.parametrize("length, gram", [(20, 8), (70, 9)])
def test_other_lengths(docs_of, prose, length, gram):
    rows = corpus(prose, 3, 30)
    assert found(docs_of(rows), length=length, gram=gram) == brute(rows, length)


def test_one_notice_in_all_documents(docs_of, prose):
    notice = "This text stands in every document, after and before others"
    rows = [(k, f"{prose(k, 8)} {notice} {prose(k + 500, 8)}") for k in range(120)]
    assert found(docs_of(rows), together=20) == brute(rows)


def test_small_tables(docs_of):
    assert found(docs_of([])) == []
    assert found(docs_of([(1, "alone")])) == brute([(1, "alone")])


def test_pieces_of_a_crowded_anchor_are_not_cut_into_all_their_strings(docs_of, prose, monkeypatch):
    written = {}

    def counted(rows, name, *codec, keep=s.stage):
        kept = keep(rows, name, *codec)
        written.setdefault(name, []).append(kept)
        return kept

    monkeypatch.setattr(s, "stage", counted)
    notice = "A line of forty bytes stands in each one"
    rows = [(k, f"{prose(k, 8)}{notice}{prose(k + 500, 8)}") for k in range(150)] + [(200, f"{prose(3, 8)}{notice}{prose(900, 8)}")]
    assert found(docs_of(rows), together=20) == brute(rows)
    strings = sum(len(r.piece) - 49 for r in written["strings"][0].collect())
    assert 0 < sum(part.count() for part in written["parts"]) < strings / 2
