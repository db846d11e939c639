"""Toxicity by a weighted lexicon, matched with Aho-Corasick.

Texts are folded first: case, accents, look-alike letters of other alphabets and digits that stand for letters.
The lexicon consists of word beginnings. Weights are the log-odds of a document being toxic when it contains the
entry, less two standard errors, learned from labelled documents; phrases of two words that contain an entry but
occur mostly in harmless documents are exceptions and count nothing. The sum of weights, its ratio to the length and the
heaviest hit give the score through a logistic fit on the same documents.

``max_fit_rows`` bounds the labelled rows that are learned from (the first by a hash of their id); every text is scored.

Defined results: NULL and empty texts score like texts without a hit; without labelled rows of both kinds there is
no lexicon and every score is 0; rows labelled more than once count as often; equal rows score alike; a NULL
``doc_id`` is an empty one for the fold; an empty table gives an empty table. Other columns are not looked at.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusmill.llm.common import keep_rows, stored, text_key

# What stands for Latin letters, by letter.
LOOK_ALIKES = {
    "a": "аα4@", "b": "в8", "c": "сς", "e": "еє3", "h": "һ", "i": "іιı1|", "j": "ј", "k": "кκ", "l": "ӏ", "m": "м", "n": "η",
    "o": "оοσ0", "p": "рρ", "s": "ѕ5$", "t": "тτ7", "u": "υ", "v": "ν", "x": "хχ", "y": "уγ",
}
FOLD = {ord(c): letter for letter, others in LOOK_ALIKES.items() for c in others}
FOLD |= {c: " " for c in range(128) if not chr(c).isalnum() and c not in FOLD}
SHORTEST, LONGEST = 3, 12


def fold(text: str | None) -> str:
    """Folded text with one blank in front, so that every word begins after a blank."""
    text = (text or "").lower()
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
    return " " + text.translate(FOLD)


def beginnings(text: str) -> set[str]:
    return {" " + w[:n] for w in set(text.split()) for n in range(SHORTEST, min(len(w), LONGEST) + 1)}


class Lexicon:
    """``weights`` of word beginnings (with their blank); ``exceptions`` are pairs of words."""

    def __init__(self, weights: dict[str, float], exceptions: frozenset[tuple[str, str]] = frozenset()):
        self.weights, self.exceptions, self.automaton = weights, exceptions, None
        if weights:
            self.automaton = ahocorasick.Automaton()
            for entry, weight in weights.items():
                self.automaton.add_word(entry, (len(entry), weight))
            self.automaton.make_automaton()

    def __reduce__(self):
        return Lexicon, (self.weights, self.exceptions)

    def hits(self, text: str) -> dict[int, float]:
        """Heaviest entry at every word that has one, by the place of the word."""
        found: dict[int, float] = {}
        if self.automaton:
            for end, (length, weight) in self.automaton.iter(text):
                at = end - length + 2
                if weight > found.get(at, 0.0):
                    found[at] = weight
        return found

    def phrases(self, text: str, at: int) -> list[tuple[str, str]]:
        """The word at ``at`` with its left and its right neighbour."""
        end = text.find(" ", at)
        word = text[at:end if end >= 0 else len(text)]
        before = text[max(0, at - 41):at].split()[-1:]
        after = text[at + len(word):at + len(word) + 41].split()[:1]
        return [(b, word) for b in before] + [(word, a) for a in after]

    def features(self, text: str) -> tuple[float, float, float]:
        hits = self.hits(text)
        if self.exceptions:
            hits = {at: w for at, w in hits.items() if not self.exceptions.intersection(self.phrases(text, at))}
        total = sum(hits.values())
        return math.log1p(total), 100 * total / (100 + text.count(" ")), max(hits.values(), default=0.0)


class Model:
    def __init__(self, lexicon: Lexicon, mean: np.ndarray, scale: np.ndarray, coefficients: np.ndarray | None):
        self.lexicon, self.mean, self.scale, self.coefficients = lexicon, mean, scale, coefficients

    def scores(self, texts: Sequence[str | None]) -> np.ndarray:
        if self.coefficients is None:
            return np.zeros(len(texts))
        x = np.array([self.lexicon.features(fold(t)) for t in texts]).reshape(-1, 3)
        z = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale]) @ self.coefficients
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, max_fit_rows: int) -> DataFrame:
    """``text, toxic`` of labelled documents outside the held-out fold."""
    usable = labels.filter("toxic IN (0, 1)").select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("toxic"))
    chosen = usable.filter(~held_out(F.col("__id"))).orderBy(F.xxhash64("__id"), "__id", "toxic").limit(max_fit_rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("text", "toxic")


def _counted(rows: DataFrame, keys_of) -> DataFrame:
    """``key, toxic, fine``: in how many documents of each kind a key occurs; ``keys_of`` maps a folded text to keys."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = Counter((k, t) for text, t in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True) for k in keys_of(fold(text)))
            keys = sorted({k for k, _ in seen})
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *[pa.array([seen[k, t] for k in keys], pa.int64()) for t in (1, 0)]], ["key", "toxic", "fine"])

    counted = rows.select("text", "toxic").mapInArrow(count, "key string, toxic long, fine long")
    return counted.groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("fine").alias("fine"))


def fit(docs: DataFrame, labels: DataFrame, max_fit_rows: int = 30_000, max_entries: int = 5_000, least_weight: float = 1.5) -> Model:
    rows = stored(training_rows(docs, labels, max_fit_rows))
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return Model(Lexicon({}), np.zeros(3), np.ones(3), None)
    frequent = _counted(rows, beginnings).filter((F.col("toxic") >= 3) & (F.col("toxic") * n[0] > F.col("fine") * n[1]))
    a, b = F.col("toxic") + 0.5, F.col("fine") + 0.5
    weight = F.log(a / (n[1] + 1)) - F.log(b / (n[0] + 1)) - 2 * F.sqrt(1 / a + 1 / b)
    best = frequent.withColumn("weight", weight).filter(F.col("weight") >= least_weight)
    entries = best.orderBy(F.desc(F.col("weight") * F.col("toxic")), "key").limit(max_entries).collect()
    lexicon = Lexicon({r["key"]: r["weight"] for r in entries})

    def pairs(text: str) -> set[str]:
        return {" ".join(p) for at in lexicon.hits(text) for p in lexicon.phrases(text, at)}

    harmless = _counted(rows, pairs).filter((F.col("fine") >= 3) & (F.col("fine") > 5 * F.col("toxic")))
    phrases = harmless.orderBy(F.desc("fine"), "key").limit(max_entries).collect()
    lexicon = Lexicon(lexicon.weights, frozenset(tuple(r["key"].split(" ")) for r in phrases))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([lexicon.features(fold(t)) for t in batch["text"].to_pylist()]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*[pa.array(x[:, k]) for k in range(3)], batch["toxic"]], ["a", "b", "c", "toxic"])

    points = rows.select("text", "toxic").mapInArrow(measure, "a double, b double, c double, toxic int")
    found = points.groupBy("a", "b", "c", "toxic").agg(F.count("*").alias("n")).orderBy("a", "b", "c", "toxic").collect()
    x = np.array([r[:3] for r in found], float)
    return Model(lexicon, *_logistic(x, np.array([r[3] for r in found], float), np.array([r[4] for r in found], float)))


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and coefficients of a ridge logistic regression; rows count ``n`` times."""
    mean = np.average(x, axis=0, weights=n)
    scale = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=n)) + 1e-9
    design = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    ridge = np.diag([1e-6, *[1.0] * x.shape[1]])
    w = np.zeros(design.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ design + ridge, design.T @ (n * (y - p)) - ridge @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted, __text``: one row per row of ``docs``."""
    lexicon, fitted = model.lexicon, (model.mean, model.scale, model.coefficients)
    shipped = docs.sparkSession.sparkContext.broadcast((lexicon.weights, lexicon.exceptions, fitted))
    narrow = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), text_key(F.col("text")).alias("__text"), "text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, exceptions, rest = shipped.value
        here = Model(Lexicon(weights, exceptions), *rest)
        for batch in batches:
            scores = here.scores(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), batch["__text"]],
                ["doc_id", "held_out", "score", "predicted", "__text"])

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(judge, f"doc_id {kind}, held_out boolean, score double, predicted int, __text long")


def reject_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` that are not predicted to be toxic, columns as they are."""
    toxic = score(docs, fit(docs, labels, **options)).filter("predicted = 1")
    return keep_rows(docs, toxic.select(F.col("doc_id").alias("__id"), "__text").distinct(), "left_anti")
