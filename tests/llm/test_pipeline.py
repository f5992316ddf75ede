import corpus_pipeline
import pytest
import sentencepiece

import __spark_entry__
from scanloom.llm import pieces

from tests.llm.test_toxicity import corpus


def test_registered():
    names = __spark_entry__.queries()
    assert {f"op{n}_" for n in range(1, 11)} <= {name[: name.index("_") + 1] for name in names if name.startswith("op")}
    assert "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


@pytest.fixture
def tables(spark, tmp_path, prose):
    docs, labels = corpus(prose, 300)
    item = prose(5000, 30)
    clean = [i for i, y in labels if not y]
    text = dict(docs)
    extra = [
        (1000, text[clean[0]]), (1001, text[clean[1]].upper()), (1002, prose(70, 30) + " " + item), (1003, "write to ann@mail.example.com " + prose(71, 20)),
        (1004, None), (1005, ""), (clean[2], text[clean[2]]), (1006, prose(72, 9_000)), (1007, "snirkle v-r-o-m-p-u-t snirkle " + prose(73, 10)),
    ]
    rows = [(i, t, "en", "src0", len(t) if t is not None else None, "kept") for i, t in docs + extra]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row_ string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, dict(labels), clean, {i: t for i, t, *_ in rows}


def test_stages_take_effect(spark, tables):
    folder, labels, clean, texts = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, left = docs.columns, []
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, folder)
        if name != "sentencepiece":
            assert out.columns == columns
        docs = corpus_pipeline.stage(out, name)
        left.append({r.doc_id for r in docs.select("doc_id").collect()})
        if name == "pii":
            redacted = {r.doc_id: r for r in docs.collect()}
    bad = {i for i, y in labels.items() if y}
    assert len(left[0] & bad) <= 0.03 * len(bad) and set(clean) <= left[0] and 1007 not in left[0]
    assert {1000, 1001} & left[1] == set() and set(clean) <= left[1]
    assert left[2] == left[1] - {1002}
    assert left[3] == left[2] == left[4]
    assert redacted[1003].text.startswith("write to [EMAIL] ") and redacted[1003].n_chars == len(redacted[1003].text)
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.TOKENIZER)
    for r in docs.collect():
        assert r.ids == (None if redacted[r.doc_id].text is None else library.encode(redacted[r.doc_id].text))
        assert r.round_trip in (True, None)


def test_run_gives_the_last_stage(spark, tables):
    out = corpus_pipeline.run(spark, tables[0])
    assert out.columns == ["doc_id", "n_tokens", "ids", "round_trip"]
    assert out.count() == out.select("doc_id").distinct().count()


def test_empty_documents(spark, tables):
    folder = tables[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("false")
    for _, step in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(step(spark, docs, folder), "empty")
        assert docs.count() == 0
