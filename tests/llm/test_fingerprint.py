import hashlib

import numpy as np

from scanloom.llm import fingerprint as f


def brute_counts(text: bytes, buckets: int):
    counts = [0] * buckets
    text = text.ljust(3, b"\0") if text else text
    for i in range(len(text) - 2):
        value = (text[i] << 16 | text[i + 1] << 8 | text[i + 2]) * 0x9E3779B1 % 2**32
        value = (value ^ value >> 15) * 0x85EBCA77 % 2**32
        counts[value * buckets >> 32] += 1
    return counts


def test_counts_equal_brute_force(prose):
    texts = [t.encode() for t in ("", "a", "ab", "abc", prose(1, 50), "é漢😀" * 20, "x" * 5000, "", prose(2, 3))]
    assert f.counts_of(texts, 64).tolist() == [brute_counts(t, 64) for t in texts]


def test_pack_round_trip_and_likeness(prose):
    codes = f.digests([prose(k, 80).encode() for k in range(20)])
    assert (f.unpack(f.pack(codes)) == codes).all()
    assert (f.likeness(codes, codes) == 1).all()
    far = f.likeness(codes, np.roll(codes, 1, axis=0))
    assert ((far >= 0) & (far < 1)).all()
    close = f.digests([(prose(k, 78) + " two words").encode() for k in range(20)])
    assert (f.likeness(codes, close) > far).all()


def test_follows_ids_over_partitions(spark, docs_of, prose):
    docs = [(k * 3, prose(k, 5 + 7 * k)) for k in range(40)] + [(1000, None), (1001, ""), (1002, "é"), (1003, "日本"), (500, prose(1, 12))]
    table = docs_of(docs).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.doc_id: r for r in f.fingerprints(table).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    order = sorted((i, t or "") for i, t in docs)
    for k, (i, text) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        changed = f.edited(text, following).encode()
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(changed).hexdigest()
        assert got[i].fingerprint == f.pack(f.digests([text.encode()]))[0]
        assert got[i].edited_fingerprint == f.pack(f.digests([changed]))[0]
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1


def test_small_tables(docs_of):
    assert f.fingerprints(docs_of([])).count() == 0
    row = f.fingerprints(docs_of([(4, "alone here")])).first()
    assert row.edited_sha256 == hashlib.sha256(b"alonealone"[:5] + b"alone").hexdigest() or row.near_next == 1.0
    twice = f.fingerprints(docs_of([(4, "same"), (4, "same"), (None, "first")])).collect()
    assert len(twice) == 3 and len({r.fingerprint for r in twice if r.doc_id == 4}) == 1
