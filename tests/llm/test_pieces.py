import random

import pytest
import sentencepiece

from scanloom.llm import pieces as p

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=p.TOKENIZER)


@pytest.fixture(scope="module")
def model():
    with open(p.TOKENIZER, "rb") as f:
        return p.Pieces(f.read())


def texts():
    rng = random.Random(3)
    letters = "the er ▁ \n\tabcdé漢字😀 1.  in on    -_"
    out = ["", " ", "  two  spaces ", "\n\n", "a" * 3000, "<s>", "<0x0A>", "tab\tand\x00null", "e\u0301"]
    return out + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(1500)]


def test_ids_equal_the_library(model):
    all_texts = texts()
    ids, first = model.encoded([p.marked(t) for t in all_texts])
    for k, text in enumerate(all_texts):
        assert ids[first[k] : first[k + 1]].tolist() == LIBRARY.encode(text), repr(text)


def test_round_trip(model):
    for text in texts():
        assert model.decoded(LIBRARY.encode(text)) == text.replace(p.MARK, " ")


def test_path_of_long_words_is_that_of_merging(model):
    rng = random.Random(5)
    for _ in range(200):
        word = "".join(rng.choice(["the", "er", "in", "ation", "x", "é", "漢", "zz", "on"]) for _ in range(rng.randint(1, 30)))
        assert model.merged_long(word) == model.merged(word)


def test_chunks_by_matrices(model):
    rng = random.Random(6)
    for _ in range(150):
        text = "".join(rng.choice(["the", "er", "in", "ation", "x", "é", "漢", "zz", "on", "ing", "s", " " if rng.random() < 0.1 else "h"]) for _ in range(rng.randint(20, 150)))
        out, run = [], []
        for c in p.chunks_of(p.marked(text), rng.randint(17, 40), model.longest - 1):
            run.append(c)
            if not c["cut_after"]:
                m = [model.matrix(x["behind"], x["text"], x["ahead"], x["cut_before"], x["cut_after"]) for x in run]
                ends = [(0, None), *p.boundary_states(m, (0, None), (0, None)), (0, None)]
                for x, a, b in zip(run, ends, ends[1:], strict=False):
                    out += model.traced(x["text"], x["ahead"], a, b, x["cut_after"])
                run = []
        assert out == LIBRARY.encode(text)


def test_combining_is_associative(model):
    text = p.marked("theeringationzzxonthe" * 6)
    chunks = p.chunks_of(text, 17, model.longest - 1)
    m = [model.matrix(c["behind"], c["text"], c["ahead"], c["cut_before"], c["cut_after"]) for c in chunks]
    assert p.combined(p.combined(m[0], m[1]), m[2]) == p.combined(m[0], p.combined(m[1], m[2]))


def test_whole_corpus(spark, docs_of, prose):
    docs = [(1, None), (2, ""), (3, "漢字" * 900), (4, "ab" * 2000), (None, "x y"), (5, "  lead"), (6, prose(1, 900)), (6, prose(1, 900)), (7, "\n" * 1500)]
    table = docs_of(docs)
    coded = p.encode(table, chunk=500)
    assert sorted(((r.doc_id, r.ids) for r in coded.collect()), key=str) == sorted(
        ((i, None if t is None else LIBRARY.encode(t)) for i, t in docs), key=str
    )
    assert {r.doc_id for r in coded.filter("n_chunks > 1").collect()} == {3, 4, 6, 7}
    assert coded.filter("NOT round_trip").count() == 0
    back = p.decode(coded)
    assert sorted(((r.doc_id, r.decoded) for r in back.collect()), key=str) == sorted(docs, key=str)
    assert p.encode(docs_of([])).count() == 0


def test_rows_of_a_batch_become_python_values_one_by_one():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"row_": [1, 2, 3], "ids": [[1, 2], [], [3]], "text": ["ab", "", "c"]})
    rows = p.one_by_one(batch, "ids", "text")
    assert iter(rows) is rows and [p.values_of(row) for row in rows] == [[[1, 2], "ab"], [[], ""], [[3], "c"]]


def test_memory_of_a_task(model, monkeypatch):
    """Tables of words have a bounded height, and what Arrow keeps of the batches goes back after the last."""
    import pyarrow as pa

    rows = []
    monkeypatch.setattr(p, "ROWS", 100, raising=False)
    monkeypatch.setattr(model, "merged_rows", lambda ids, keep=model.merged_rows: (rows.append(len(ids)), keep(ids))[1])
    rng = random.Random(8)
    text = " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 20))) for _ in range(3000))
    model.forget()
    ids, _ = model.encoded([p.marked(text)])
    assert ids.tolist() == LIBRARY.encode(text) and max(rows) <= 100 < sum(rows)

    def task(batches):
        for batch in batches:
            yield batch.slice(0, 1)

    freed = []
    monkeypatch.setattr(p.pa, "default_memory_pool", lambda: type("Pool", (), {"release_unused": lambda self: freed.append(1)})())
    out = p.tidy(task)(iter([pa.RecordBatch.from_pydict({"a": [1, 2]})] * 2))
    assert [next(out).num_rows, next(out).num_rows] == [1, 1] and not freed
    assert list(out) == [] and freed
