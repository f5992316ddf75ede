"""Toxicity scores of texts whose words may be disguised.

A character trigram model is counted over all documents. Words with digits or signs among their letters, long
repetitions, or single letters with gaps between them are read as lattices of what each sign may stand for, and the most
likely word under the model and the costs of the disguise is kept (Viterbi). Runs of spaced letters and joined words are
also read with word ends inside, so that the best path cuts them into words. Words and their beginnings, as restored, are the
features of a logistic regression that learns from a bounded sample of labelled rows (``SAMPLE``); its features
are the ``UNITS`` that tell most of the toxic class in that sample.

A null or empty text has no features and gets the score of the intercept. Equal texts get equal scores. Labels that are
null are not used, of several labels of a document the larger counts; without labels, or with one class, all scores are
that class. Words, tokens and runs of any length are read, and the parts of addresses; tokens without a letter are numbers.
Columns beside the id and the text are not read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import STEP_BYTES, hash_sample, stage, steps

#: Labelled rows that the classifier is fitted on at most, its features at most, and documents a feature occurs in at least.
SAMPLE, UNITS, LEAST_DOCS = 20_000, 4_000, 5
THRESHOLD = 0.3
#: Bytes of text whose units are held at once.
UNITS_STEP = 1 << 20
#: Letters of the model: none (0), a to z, the letters U+00DF to U+00FF, any other letter.
LETTERS = {chr(c): i + 1 for i, c in enumerate([*range(97, 123), *range(0xDF, 0x100)])}
OTHER = len(LETTERS) + 1
SYMBOLS = OTHER + 1

#: What a sign may stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "gq",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
#: Letters of other scripts that look like a Latin one.
LOOKS_LIKE = dict(zip("аеорсухіѕјԁһ", "aeopcyxisjdh", strict=True))
#: Log costs: a sign for a letter, such a sign or another one for nothing, a repeated letter, a star for any vowel.
SIGN, IDLE, GAP, REPEATED, ANY = -1.0, -10.0, -0.5, -0.7, -3.0

PUNCTUATION = ".,;:?\"'()[]{}*%&#-_~^`´…«»“”„‘’/\\<>="
EDGE_SIGNS = "$!|@+€£¡"
TRIPLE = re.compile(r"([^\W\d_])\1\1")
SPACED = re.compile(r"(?<!\S)(?:[^\s.,;:][ .\-_*]{1,2}){2,}[^\s.,;:](?![^\s.,;:!?])")
LATIN, FOREIGN = re.compile("[a-z]"), re.compile(f"[{''.join(LOOKS_LIKE)}]")
BEGINNINGS = (4, 5, 6, 7)
WIDE = re.compile(r"[ .\-_*]{2}")
INSIDE = re.compile(f"[{re.escape(PUNCTUATION)}]+")
#: Signs up to which tokens are remembered, and letters above which a token may be joined words.
LONG, JOINED = 48, 16


def symbol_table() -> np.ndarray:
    """Number of each code point below U+0250; what is above is looked up by ``isalpha``."""
    table = np.zeros(0x250, np.uint8)
    for c in range(0x250):
        lower = chr(c).lower()
        table[c] = LETTERS.get(lower, OTHER if lower.isalpha() else 0)
    return table


def trigram_counts(docs: DataFrame, text_column: str = "text") -> np.ndarray:
    """Counts of letter trigrams over all documents, one axis for each letter; at most ``SYMBOLS`` cubed numbers."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = symbol_table(), np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for part in steps(batch, "text", STEP_BYTES):
                points = np.frombuffer(" ".join(["", *(t or "" for t in part.column("text").to_pylist()), ""]).encode("utf-32-le", "replace"), np.uint32)
                low = np.minimum(points, 0x24F)
                number = np.where(points < 0x250, table[low], 0).astype(np.int32)
                high = np.flatnonzero(points >= 0x250)
                number[high] = [OTHER if chr(c).isalpha() else 0 for c in points[high].tolist()]
                total += np.bincount(number[:-2] * SYMBOLS**2 + number[1:-1] * SYMBOLS + number[2:], minlength=SYMBOLS**3)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"gram": pa.array(found, pa.int64()), "n": pa.array(total[found], pa.int64())})

    rows = docs.select(F.col(text_column).alias("text")).mapInArrow(counted, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SYMBOLS**3)
    counts[rows["gram"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
    return counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


def log_model(counts: np.ndarray) -> np.ndarray:
    """Log probabilities of a letter after two others, interpolated with shorter histories."""
    one = counts.sum(axis=(0, 1)) + 1.0
    two = counts.sum(axis=0)
    p1 = one / one.sum()
    p2 = (two + 20 * p1) / (two.sum(axis=1, keepdims=True) + 20)
    p3 = (counts + 5 * p2[None]) / (counts.sum(axis=2, keepdims=True) + 5)
    return np.log(p3).astype(np.float32)


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each run of equal signs of a token, the strings it may stand for and their log costs."""
    out = []
    for run in re.finditer(r"(.)\1*", token, re.S):
        sign, n = run[1], len(run[0])
        options: list[tuple[str, float]] = []
        signs = LOOKS_LIKE.get(sign, sign) if sign.isalpha() else STANDS_FOR.get(sign, "")
        for letter, cost in [(x, 0.0 if x == sign else SIGN) for x in signs]:
            options.append((letter, cost + (REPEATED if n > 1 else 0)))
            if n > 1:
                options.append((letter * 2, cost + (REPEATED if n > 2 else 0)))
        if sign == "*":
            options += [(x, ANY) for x in "aeiou"]
        if not sign.isalpha():
            at_start, at_end = run.start() == 0, run.end() == len(token)
            if not (at_start or at_end):
                share = 1.0
            elif sign.isdigit():
                share = 0.75 if at_start else 0.25
            else:
                share = 0.0 if sign not in "@$€£" else 0.5 if at_start else 0.25
            options.append(("", share * IDLE if share and sign in STANDS_FOR else GAP))
        out.append(options)
    return out


def best_path(token: str, model: np.ndarray, cut: bool = False) -> str:
    """The best path of a token's lattice under the trigram model; with ``cut`` words may end inside, at a space.

    Paths share their beginnings, so that time is linear in the length."""
    paths: dict = {(0, 0): (0.0, None)}  # by the last two letters
    for options in lattice(token):
        if cut:
            for (a, b), (score, path) in list(paths.items()):
                if b:
                    total = score + float(model[a, b, 0])
                    if (b, 0) not in paths or total > paths[b, 0][0]:
                        paths[b, 0] = (total, (path, " "))
        following: dict = {}
        for (a, b), (score, path) in paths.items():
            for letters, cost in options:
                x, y, total = a, b, score + cost
                for letter in letters:
                    z = LETTERS.get(letter, OTHER)
                    total += float(model[x, y, z])
                    x, y = y, z
                if (x, y) not in following or total > following[x, y][0]:
                    following[x, y] = (total, (path, letters) if letters else path)
        paths = following
    path = max(paths.items(), key=lambda p: p[1][0] + float(model[p[0][0], p[0][1], 0]))[1][1]
    out = []
    while path:
        path, letters = path
        out.append(letters)
    return "".join(reversed(out))


def restored(token: str, model: np.ndarray) -> str:
    """The likeliest word behind a token."""
    return best_path(token, model)


class Restorer:
    """Distinct words of texts with disguised words restored; remembers a bounded number of tokens."""

    def __init__(self, model: np.ndarray):
        self.model, self.known = model, {}

    def restore(self, token: str) -> str:
        return self._remembered(token, False)

    def cut(self, token: str) -> set[str]:
        """The words, of two letters at least, that a run is cut into."""
        return {w for w in self._remembered(token, True).split() if len(w) > 1}

    def _remembered(self, token: str, cut: bool) -> str:
        if len(token) > LONG:  # rare, and would fill the memory
            return best_path(token, self.model, cut)
        if (token, cut) not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[token, cut] = best_path(token, self.model, cut)
        return self.known[token, cut]

    def words(self, text: str | None) -> set[str]:
        lowered = (text or "").lower()
        if not unicodedata.is_normalized("NFKC", lowered):
            lowered = unicodedata.normalize("NFKC", lowered)
        found = set()
        for token in set(lowered.split()):
            if token.isalpha():
                found.add(token)
                continue
            token = token.strip(PUNCTUATION)
            bare = token.strip(PUNCTUATION + EDGE_SIGNS)
            if bare.isalpha():
                found.add(bare)
                if not token[0] in EDGE_SIGNS:  # what follows a word as punctuation is no disguise
                    continue
            if bare and not bare.isdigit() and any(c.isalpha() for c in bare):
                if "://" not in token:  # an address is no word, its parts may be
                    found.add(self.restore(token))
                    if len(token) > JOINED:
                        found |= self.cut(token)
                for part in INSIDE.split(token):
                    if len(part) > 1 and part != token and any(c.isalpha() for c in part):
                        found.add(part if part.isalpha() else self.restore(part))
        if FOREIGN.search(lowered):
            found |= {self.restore(w) for w in list(found) if FOREIGN.search(w) and LATIN.search(w)}
        if TRIPLE.search(lowered):
            found |= {self.restore(w) for w in list(found) if TRIPLE.search(w)}
        for word in [w for w in found if len(w) > JOINED]:
            found |= self.cut(word)
        for run in SPACED.finditer(lowered):
            # where gaps of two signs stand among single ones, they part words
            for piece in {run[0], *WIDE.split(run[0])}:
                letters = "".join(c for c in piece if c not in " .-_")
                if any(c.isalpha() for c in letters):
                    found.add(self.restore(letters))
                    found |= self.cut(letters)
        found.discard("")
        return found

    def units(self, text: str | None) -> set[str]:
        """Words, and the beginnings of longer ones, marked with a hyphen."""
        words = self.words(text)
        return words | {w[:n] + "-" for w in words for n in BEGINNINGS if len(w) >= n}


def remainder(doc_id) -> F.Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4


@dataclass
class Classifier:
    weights: dict[str, float]
    intercept: float
    model: np.ndarray

    def score(self, texts: list[str | None], restorer: Restorer | None = None) -> list[float]:
        restorer, weights = restorer or Restorer(self.model), self.weights
        return [
            1 / (1 + math.exp(-max(-30.0, min(30.0, self.intercept + sum(sorted(weights[u] for u in restorer.units(t) if u in weights))))))
            for t in texts
        ]


def fitted(held: list[np.ndarray], toxic: np.ndarray, names: list[str], rounds: int = 600, decay: float = 1e-5) -> tuple[dict[str, float], float]:
    """Weights of the units and the intercept; gradient descent over all rows with step sizes by weight.

    ``held`` are the numbers, in ``names``, of the units of each row.
    """
    rows = np.repeat(np.arange(len(held)), [len(u) for u in held])
    cols = np.concatenate([np.zeros(0, np.int64), *held]).astype(np.int64)
    n = len(toxic)
    if not n or toxic.all() or not toxic.any():
        return {}, 30.0 if n and toxic.all() else -30.0
    weights, squares, intercept = np.zeros(len(names)), np.full(len(names), 1e-8), math.log(toxic.mean() / (1 - toxic.mean()))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, weights[cols], n) + intercept, -30, 30)))
        error = (p - toxic) / n
        gradient = np.bincount(cols, error[rows], len(names)) + decay * weights
        squares += gradient**2
        weights -= 1.0 * gradient / np.sqrt(squares)
        intercept -= 2 * error.sum()
    return dict(zip(names, weights.tolist(), strict=True)), float(intercept)


def train(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_column: str = "doc_id", text_column: str = "text",
    label_column: str = "toxic",
) -> Classifier:
    """Trigram model over all ``docs``, and classifier from labelled rows whose ``remainder`` isn't 2."""
    model = log_model(trigram_counts(docs, text_column))
    known = labels.select(F.col(id_column).alias("label_id"), F.col(label_column).cast("int").alias("toxic")).filter(
        "toxic IS NOT NULL AND label_id IS NOT NULL"
    ).filter(remainder(F.col("label_id")) != 2).groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    taken = F.broadcast(hash_sample(known, sample, "label_id"))
    rows = docs.select(F.col(id_column).alias("label_id"), F.col(text_column).alias("text")).join(taken, "label_id")
    once = rows.groupBy("text").agg(F.max("toxic").alias("toxic"))  # copies of a text say nothing more

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        for batch in batches:
            for part in steps(batch, "text", UNITS_STEP):
                held = [sorted(restorer.units(t)) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(held, pa.list_(pa.string()))], ["toxic", "units"])

    read = stage(once.mapInArrow(units, "toxic int, units array<string>"), "units")
    size = read.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    n, n_toxic = size["n"], size["toxic"] or 0
    if not n_toxic or n_toxic == n:
        weights, intercept = fitted([], np.full(min(1, n), bool(n_toxic)), [])
        return Classifier(weights, intercept, model)
    counts = read.select("toxic", F.explode("units").alias("unit")).groupBy("unit").agg(
        F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")
    )
    bad, good = F.col("bad") + 0.5, F.col("good") + 0.5
    # how far the class tells: bits saved about toxic documents
    gain = F.col("bad") * F.log((bad / (n_toxic + 1)) / (good / (n - n_toxic + 1)))
    telling = counts.filter((F.col("bad") >= LEAST_DOCS) & (gain > 0)).orderBy(gain.desc(), "unit").limit(UNITS)
    names = sorted(r["unit"] for r in telling.select("unit").collect())
    number = {u: i for i, u in enumerate(names)}

    @F.pandas_udf("array<int>")
    def telling_units(units: pd.Series) -> pd.Series:
        return pd.Series([sorted(number[u] for u in held if u in number) for held in units], dtype=object)

    fit = read.select("toxic", telling_units("units").alias("units")).toPandas()  # at most `sample` rows of at most UNITS units
    weights, intercept = fitted(list(fit["units"]), fit["toxic"].to_numpy(bool), names)
    return Classifier(weights, intercept, model)


def scorer(classifier: Classifier):
    """The score of a text column."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        restorer = Restorer(classifier.model)
        held = (classifier.score(texts.slice(k, 200).to_pylist(), restorer) for k in range(0, len(texts), 200))
        return pa.array([x for scores in held for x in scores], pa.float64())

    return scored


def score(
    docs: DataFrame, classifier: Classifier, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, ``held_out`` (not learned from), ``score`` and ``predicted`` of every row."""
    return docs.select(
        F.col(id_column).alias("doc_id"), F.coalesce(remainder(F.col(id_column)) == 2, F.lit(False)).alias("held_out"),
        scorer(classifier)(F.col(text_column)).alias("score"),
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, classifier: Classifier, threshold: float = THRESHOLD, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``."""
    return docs.filter(scorer(classifier)(F.col(text_column)) < threshold)
