import numpy as np
import pytest

from scanloom.llm import substring_dedup as s


def brute_windows(values, width):
    """Extents of all nodes of the Cartesian tree that hold ``width`` places."""
    out = []
    for c, v in enumerate(values):
        l = c
        while l and (values[l - 1], l - 1) > (v, c):
            l -= 1
        r = c
        while r + 1 < len(values) and (values[r + 1], r + 1) > (v, c):
            r += 1
        if r - l + 1 >= width:
            out.append((c, l, r))
    return out


def test_windows_are_the_tree():
    rng = np.random.default_rng(1)
    for _ in range(200):
        sizes = rng.integers(0, 60, 4)
        first = np.concatenate([[0], np.cumsum(sizes)])
        values = rng.integers(0, 25, first[-1]).astype(np.uint64) << np.uint64(30)
        width = int(rng.integers(1, 12))
        text, c, l, r = s.compact_windows(values, first, width)
        got = sorted((int(t), int(a - first[t]), int(b - first[t]), int(e - first[t])) for t, a, b, e in zip(text, c, l, r, strict=True))
        want = sorted((t, *w) for t in range(4) for w in brute_windows(values[first[t] : first[t + 1]].tolist(), width))
        assert got == want


def passages(table, **options):
    rows = s.repeated_passages(table, **options).collect()
    return {(r.doc_id, r.begin, r.end, r.rep_doc_id, r.rep_begin, r.rep_end) for r in rows}


def test_exact_and_near_passages(docs_of, prose):
    shared, near = prose(100, 70), prose(101, 90).split()
    changed = [w if k % 45 != 44 else "other" for k, w in enumerate(near)]
    docs = [
        (1, prose(1, 100) + " " + shared + " " + prose(2, 50)), (2, prose(3, 30) + " " + shared.upper() + " " + prose(4, 10)), (3, prose(5, 300)),
        (4, prose(6, 40) + " " + " ".join(near)), (5, " ".join(changed) + " " + prose(7, 80)), (6, None), (7, ""), (8, prose(8, 55)), (8, prose(8, 55)),
        (9, "short text"), (10, "short text"), (None, prose(9, 200)), (11, prose(10, 9_000) + " " + shared),
    ]
    found = passages(docs_of(docs))
    linked = {frozenset((a, b)) for a, _, _, b, _, _ in found}
    assert linked - {frozenset((1, 11))} == {frozenset((1, 2)), frozenset((2, 11)), frozenset((4, 5)), frozenset((8,))}
    assert (1, 100, 170, 2, 30, 100) in found
    assert (11, 9_000, 9_070, 2, 30, 100) in found
    assert (8, 0, 55, 8, 0, 55) in found


def test_common_lines_do_not_hide_passages(docs_of, prose):
    """Many texts share a line; two of them share a passage around it."""
    line = prose(500, 25)
    around = prose(501, 20) + " " + line + " " + prose(502, 20)
    docs = [(k, prose(k, 60) + " " + line + " " + prose(1000 + k, 60)) for k in range(60)]
    docs += [(100, prose(2000, 150) + " " + around), (101, around + " " + prose(2001, 170))]
    linked = {frozenset((a, b)) for a, _, _, b, _, _ in passages(docs_of(docs))}
    assert linked == {frozenset((100, 101))}


def test_a_common_footer_does_not_settle_other_places(docs_of, prose):
    """All texts share a footer long enough to be a passage and a short line; two share a passage around the line."""
    line, footer = prose(500, 35), prose(503, 80)
    around = prose(501, 12) + " " + line + " " + prose(502, 12)
    docs = [(k, f"{prose(k, 60)} {line} {prose(1000 + k, 60)} {footer}") for k in range(60)]
    docs += [(100, f"{prose(2000, 150)} {around} {prose(2002, 60)} {footer}"), (101, f"{around} {prose(2001, 170)} {footer}")]
    found = passages(docs_of(docs))
    assert {frozenset((a, b)) for a, begin, end, b, _, _ in found if end - begin < 75} == {frozenset((100, 101))}
    footed = {x for a, begin, end, b, _, _ in found if end - begin >= 75 for x in (a, b)}
    assert footed == {i for i, _ in docs}


def test_run_hash():
    values = np.array([5, 6, 7, 8, 5, 6, 7, 9], np.uint64)
    got = s.run_hash(values, 3)
    assert len(got) == 6 and got[0] == got[4] and len(set(got.tolist())) == 5
    assert len(s.run_hash(values, 9)) == 0


def test_empty_table(docs_of):
    assert passages(docs_of([])) == set()


def test_segments():
    match = np.array([0, 1, 1, 1, 0, 1, 1, 1, 1, 0, 0, 0, 0, 1, 0], bool)
    assert s.segments(match, 0.8, 5) == [(1, 9)]
    assert s.segments(match, 1.0, 4) == [(5, 9)]
    assert s.segments(np.zeros(4, bool), 0.8, 1) == []


@pytest.mark.parametrize("further", [0, 1, 4])
def test_windows_are_cut_all_at_once(further, monkeypatch):
    rng, width, hashes, used = np.random.default_rng(4), 8, 3, 2
    values = s.hashed(rng.integers(0, 60, 400).astype(np.uint64), 9)
    l = rng.integers(0, 360, 120)
    r, fn, keys = l + rng.integers(width - 1, 40, 120), rng.integers(0, hashes, 120), rng.integers(-(1 << 62), 1 << 62, 120)
    want = []
    for i in range(120):
        own = s.hashed(values, int(fn[i])) >> np.uint64(24)
        c = l[i] + int(own[l[i] : r[i] + 1].argmin())
        named = []
        for p in range(max(l[i], c - width + 1), min(c, r[i] - width + 1) + 1):
            held = values[p : p + width]
            low = [s.hashed(held, hashes * (1 + used + j) + int(fn[i])).min() for j in range(further)] or [s.run_hash(held, width)[0]]
            if named and further and named[-1][0] == low:
                named[-1][2] += 1
            else:
                named.append([low, p, width - 1])
        for low, p, length in named:
            new = keys[i : i + 1].view(np.uint64) if further else np.zeros(1, np.uint64)
            for j, least in enumerate(low):
                new = s.mix(s.mix(least ^ new) + np.uint64(j + 1))
            want.append((i, int(new[0]), p, length))
    calls = []
    monkeypatch.setattr(s, "mix", lambda x, keep=s.mix: (calls.append(1), keep(x))[1])
    found = s.cut_windows(values, keys, fn, l, r, width, hashes, used, further)
    assert sorted(zip(*(x.tolist() for x in found), strict=True)) == sorted(want)
    assert len(calls) < 120
