import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.llm import infill as f


@pytest.mark.parametrize("kind, offsets", [
    (f.Array, [0, 5, 9, 65_535]),
    (f.Array, [*range(0, 8190, 2)]),
    (f.Bitmap, [*range(0, 65_536, 3)]),
    (f.Runs, [*range(100, 60_000)]),
    (f.Runs, [*range(0, 300), *range(1000, 1300), 65_535]),
])
def test_containers(kind, offsets):
    held = f.container(np.array(offsets))
    assert isinstance(held, kind)
    assert [held.select(k) for k in range(len(offsets))] == offsets


def test_select_over_containers():
    rng = random.Random(5)
    offsets = sorted({*rng.sample(range(400_000), 30_000), *range(131_072, 180_000), 1_000_000, 9_000_000_000})
    held = f.BoundarySet(np.array(offsets))
    assert {type(c) for c in held.containers} == {f.Array, f.Bitmap, f.Runs}
    assert len(held) == len(offsets) and [held.select(k) for k in range(len(offsets))] == offsets
    assert len(f.BoundarySet(np.zeros(0, np.int64))) == 0


def brute(doc_id, text, cut=100, spm=50, pattern=r"[^\n]*\n|[^\n]+"):
    text = text or ""
    units = re.findall(pattern, text, re.S)
    digits = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= cut:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < spm else "psm"
    return doc_id, n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def texts(prose):
    rng = random.Random(3)
    lines = [[prose(k * 31 + j, rng.randint(0, 6)) for j in range(rng.randint(1, 9))] for k in range(60)]
    rows = [(k, rng.choice(["\n", "\n\n", "\r\n"]).join(part) + rng.choice(["", "\n"])) for k, part in enumerate(lines)]
    rows += [(100, None), (101, ""), (102, "\n"), (103, "a<S>b\nc"), (104, "é\n漢 字\n😀"), (None, "a\nb\nc"), (105, "<P"), (106, "<S\n>\n<\nM>")]
    rows += [(107, "x\n" * 100_000), (108, "long " * 200_000), (109, "\n" * 70_000), (5, "same\nrow"), (5, "same\nrow"), (110, "a\0b\nc")]
    return rows


def test_rows_equal_brute_force(docs_of, prose):
    rows = texts(prose)
    done = f.fill_in_middle(docs_of(rows)).withColumn("back", f.restored(F.col("output"), F.col("form"))).collect()
    order = lambda r: (str(r[0]), r[5])
    assert sorted((tuple(r)[:6] for r in done), key=order) == sorted((brute(*r) for r in rows), key=order)
    want = sorted((str(i), t or "") for i, t in rows)
    assert sorted((str(r.doc_id), r.back) for r in done) == want
    assert {r.form for r in done} == {"plain", "psm", "spm"}


def test_percentages_and_characters(docs_of, prose):
    rows = texts(prose)[:60]
    done = f.fill_in_middle(docs_of(rows), cut_percent=60, suffix_first_percent=0).collect()
    assert sorted(tuple(r) for r in done) == sorted(brute(*r, cut=60, spm=0) for r in rows)
    assert {r.form for r in done} == {"plain", "psm"}
    done = f.fill_in_middle(docs_of(rows), unit="character").collect()
    assert sorted(tuple(r) for r in done) == sorted(brute(*r, pattern=r".") for r in rows)


def test_empty_table_and_other_ids(spark, docs_of):
    assert f.fill_in_middle(docs_of([])).count() == 0
    row = f.fill_in_middle(spark.createDataFrame([("x9", "a\nb")], "name string, body string"), id_column="name", text_column="body").first()
    assert row.doc_id == "x9" and row.n == 2
