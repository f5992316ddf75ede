import random
import zlib

import numpy as np
import pytest

from scanloom.llm import toxicity as t

BAD = ["snirkle", "vromput", "gluzzard"]


def corpus(prose, n=400):
    rng = random.Random(2)
    docs, labels = [], []
    for k in range(n):
        toxic = k % 5 == 0
        words = prose(k, 40).split()
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        docs.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    from tests.llm.conftest import SYLLABLES

    def prose(seed, words):
        rng = random.Random(seed)
        return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(words))

    docs, labels = corpus(prose)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    return docs, dict(labels), t.train(table, spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_held_out_rows_are_told_apart(trained):
    docs, labels, classifier = trained
    held = [(text, labels[i]) for i, text in docs if zlib.crc32(str(i).encode()) % 4 == 2]
    scores = np.array(classifier.score([x for x, _ in held]))
    toxic = np.array([y for _, y in held], bool)
    assert (scores[toxic] >= t.THRESHOLD).mean() >= 0.95
    assert (scores[~toxic] < t.THRESHOLD).mean() >= 0.98


@pytest.mark.parametrize("disguise", [
    "sn1rkle", "s.n.i.r.k.l.e", "s n i r k l e", "sniiiirkle", "$nirkle", "vr0mput", "vromp-ut", "gl*zzard", "ＳＮＩＲＫＬＥ", "snіrklе", "SNIRKLE!!", "vrompuuuut",
])
def test_disguised_words_are_restored(trained, disguise):
    restorer = t.Restorer(trained[2].model)
    assert restorer.words(f"the {disguise} and") & set(BAD), restorer.words(disguise)


def test_plain_words_stay(trained):
    restorer = t.Restorer(trained[2].model)
    assert restorer.words("Hello, wide world!!\nnumber 12345") == {"hello", "wide", "world", "number"}
    assert restorer.words(None) == restorer.words("") == restorer.words("... 123") == set()


def test_digits_addresses_and_short_runs_are_read(trained):
    restorer = t.Restorer(trained[2].model)
    assert restorer.words("1d10t" * 10) and restorer.words("x1" * 50_000)
    assert "snirkle" in restorer.words("see:sn1rkle://you") and "you" in restorer.words("see:sn1rkle://you")
    assert "snirkle" in restorer.words("http://a.example/x/sn1rkle?y=1")
    assert "die" in restorer.words("so d i e now") and restorer.words("1 2 3 4") == set()


def test_long_tokens_and_spaced_sentences_are_read(trained):
    restorer = t.Restorer(trained[2].model)
    plain = "kalomi terander velsada lumosver nichoba pigorne tafilum"
    assert "snirkle" in restorer.words(f"{'.'.join(plain.split())}.sn1rkle")
    assert "snirkle" in restorer.words(f"{'_'.join(plain.split())}__snirkle")
    spaced = " ".join("".join(f"{plain} snirkle {plain}".split()))
    assert "snirkle" in restorer.words(spaced), restorer.words(spaced)
    assert "snirkle" in restorer.words("  ".join(" ".join(w) for w in ["dela", "snirkle", "kami"]))
    assert len(restorer.words("sn1rklegluzzard" * 5_000)) > 0


def test_viterbi_with_word_ends_is_the_best_path(trained):
    model = trained[2].model

    def value(word):
        cost = x = y = 0
        for letter in word:
            z = 0 if letter == " " else t.LETTERS[letter]
            cost, x, y = cost + float(model[x, y, z]), y, z
        return cost + float(model[x, y, 0])

    for run in ["anidiot", "kasnirk", "lomiter"]:
        ways = [run[0]]
        for letter in run[1:]:
            ways = [w + gap + letter for w in ways for gap in ("", " ")]
        got = t.best_path(run, model, cut=True)
        assert got.replace(" ", "") == run and abs(value(got) - max(map(value, ways))) < 1e-4


def test_viterbi_is_the_best_path(trained):
    model = trained[2].model

    def value(word, cost):
        x = y = 0
        for letter in word:
            z = t.LETTERS.get(letter, t.OTHER)
            cost, x, y = cost + float(model[x, y, z]), y, z
        return cost + float(model[x, y, 0])

    for token in ["sn1rkle", "a11b", "t3st", "$s5", "b00k"]:
        paths = [("", 0.0)]
        for options in t.lattice(token):
            paths = [(w + o, c + k) for w, c in paths for o, k in options]
        best = max(value(w, c) for w, c in paths)
        assert any(abs(value(w, c) - best) < 1e-4 for w, c in paths if w == t.restored(token, model))


def test_every_row_is_scored(spark, docs_of, trained):
    docs = [(1, None), (2, ""), (3, "snirkle vromput snirkle"), (3, "snirkle vromput snirkle"), (None, "ka lo"), (4, "ka lo " * 30_000)]
    table = docs_of(docs)
    got = t.score(table, trained[2]).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert {r.predicted for r in got if r.doc_id == 3} == {1}
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    kept = t.keep_clean(table, trained[2])
    assert kept.columns == table.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "4", "None"]


def test_labels_that_say_little(spark, docs_of):
    docs = docs_of([(1, "a b"), (2, "c d")])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in t.score(docs, t.train(docs, none)).collect()} == {0}
    clean = spark.createDataFrame([(1, 0), (2, 0), (3, None)], "doc_id long, toxic int")
    assert {r.predicted for r in t.score(docs, t.train(docs, clean)).collect()} == {0}
    assert t.score(docs_of([]), t.train(docs_of([]), clean)).count() == 0
