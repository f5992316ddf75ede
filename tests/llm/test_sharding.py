import zlib

from scanloom.llm import sharding as s


def check(rows, docs, shards):
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=str) == sorted(
        ((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in docs), key=str
    )
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r)
    assert set(by_shard) <= set(range(shards))
    for held in by_shard.values():
        assert sorted(r.slot for r in held) == list(range(len(held)))
    return {k: sum(r.size for r in held) for k, held in by_shard.items()}


def test_bytes_are_near_equal_with_a_hot_key(docs_of, prose):
    docs = [(k, prose(k, 3 + k % 50)) for k in range(800)] + [(7, "the same text again")] * 500 + [(9, None), (None, "x"), (10, prose(1, 2_000))]
    sizes = check(s.assign(docs_of(docs), shards=5).collect(), docs, 5)
    largest = max(len((t or "").encode()) + 16 for _, t in docs)
    assert len(sizes) == 5
    assert max(sizes.values()) - min(sizes.values()) <= 2 * largest


def test_small_tables(docs_of):
    assert s.assign(docs_of([])).count() == 0
    check(s.assign(docs_of([(1, "a"), (2, "")])).collect(), [(1, "a"), (2, "")], 40)


def test_same_result_twice(docs_of, prose):
    table = docs_of([(k, prose(k, 20)) for k in range(200)])
    assert sorted(s.assign(table).collect()) == sorted(s.assign(table).collect())


def test_shards_are_written(spark, docs_of, prose, tmp_path):
    table = docs_of([(k, prose(k, 20)) for k in range(100)])
    placed = s.assign(table, shards=4)
    s.write_shards(table, placed, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted((r.doc_id, r.shard) for r in back.select("doc_id", "shard").collect()) == sorted((r.doc_id, r.shard) for r in placed.collect())
