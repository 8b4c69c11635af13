"""A toxicity classifier that is told not to care which group a sentence mentions.

Features are the words of a text and their beginnings, each present or not. A logistic model is fitted to a bounded sample of labelled
texts. In every sampled text that mentions an identity, the terms are swapped for others of their group and for neutral words, and the
squared change of the model's log-odds is added to the loss; so a group that is often insulted does not itself come to count as an insult.

The sample is ``SAMPLE`` labelled rows picked by a hash of the id (all of them where there are fewer); exact copies among them count once.
Scoring covers every row and whole texts. Nulls: a null text is empty, and an empty text gets the score of the labels' own rate; rows
whose label or id is null teach nothing; a null id is not held out. Rows labelled twice count twice. With no labelled rows every score
is low. Very long texts are treated like others: a feature counts once per text. Only the named columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyclock.llm.shared import Memo, hash_sample, slices, written

SAMPLE = 16_000
FEATURES = 1 << 15
THRESHOLD = 0.3
_WORDS = re.compile(r"[^\W\d_]+")

#: Identity terms by group, to be swapped inside their group.
IDENTITIES = [
    "christian muslim jewish hindu buddhist catholic protestant atheist".split(),
    "christians muslims jews hindus buddhists catholics protestants atheists".split(),
    "black white asian african european latino arab american mexican chinese indian".split(),
    "woman man".split(),
    "women men".split(),
    "girl boy".split(),
    "female male".split(),
    "gay lesbian bisexual straight heterosexual homosexual transgender".split(),
    "deaf blind disabled".split(),
    "immigrant refugee foreigner migrant".split(),
    "immigrants refugees foreigners migrants".split(),
    "femme homme".split(),
    "chrétien musulman juif".split(),
    "frau mann".split(),
    "christ moslem jude".split(),
    "mujer hombre".split(),
    "cristiano musulmán judío".split(),
]
NEUTRAL = "person"


def words_of(text: str) -> set[str]:
    return set(_WORDS.findall(text.lower()))


def features_of(word: str) -> list[int]:
    """The word itself and its first four, five and six letters, by hash."""
    own = [zlib.crc32(b"=" + word.encode("utf-8"))]
    return own + [zlib.crc32(b"^" + word[:k].encode("utf-8")) for k in (4, 5, 6) if len(word) >= k]


def swapped(words: set[str]) -> list[set[str]]:
    """The words with every identity term turned into the next of its group, and into a neutral word; nothing where there is none."""
    after = {t: g[(i + 1) % len(g)] for g in IDENTITIES for i, t in enumerate(g)}
    found = words & after.keys()
    if not found:
        return []
    rest = words - found
    return [rest | {after[t] for t in found}, rest | {NEUTRAL}]


@dataclass
class Model:
    weights: dict[int, float]
    bias: float

    def scorer(self):
        weights, bias, memo = self.weights, self.bias, Memo(200_000)

        def learn(words: list[str]) -> dict[str, tuple[int, ...]]:
            return {w: tuple(f for f in features_of(w) if f in weights) for w in words}

        def score(texts: list[str]) -> np.ndarray:
            sets = [words_of(t) for t in texts]
            known = memo.of(set().union(*sets), learn)
            odds = [bias + sum(weights[f] for f in set().union(*map(known.__getitem__, s))) for s in sets]
            return 1 / (1 + np.exp(-np.clip(np.array(odds, dtype=np.float64), -40, 40)))

        return score

    def score(self, text: Column) -> Column:
        """The score of a text column, 0 to 1."""

        @F.pandas_udf("double")
        def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            score = self.scorer()
            for texts in batches:
                parts = [score(texts.iloc[i : i + 500].tolist()) for i in range(0, len(texts), 500)]
                yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

        return scored(F.coalesce(text, F.lit("")))


def train(rows: list[np.ndarray], toxic: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], scale: np.ndarray, strength: float, rounds: int = 300, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of least loss: mean log loss, plus ``strength`` times the mean squared change of log-odds over swapped pairs."""

    def flat(lists):
        at = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        return at, np.concatenate(lists).astype(np.int64) if len(at) else np.zeros(0, np.int64)

    at, index = flat(rows)
    n = max(1, len(rows))
    pair_at, pair_index = flat([np.concatenate(p) for p in pairs])
    sign = np.concatenate([np.repeat([1.0, -1.0], [len(a), len(b)]) for a, b in pairs]) if pairs else np.zeros(0)
    w, bias = np.zeros(len(scale)), float(np.log((toxic.sum() + 1) / (len(toxic) - toxic.sum() + 10)))
    moved, moved2, b1, b2 = np.zeros(len(w) + 1), np.zeros(len(w) + 1), 0.9, 0.999
    for step in range(1, rounds + 1 if len(rows) else 1):
        v = w * scale
        odds = np.bincount(at, v[index], minlength=len(rows)) + bias
        error = (1 / (1 + np.exp(-np.clip(odds, -40, 40))) - toxic) / n
        slope = np.bincount(index, error[at], minlength=len(w))
        if len(pair_at):
            change = np.bincount(pair_at, v[pair_index] * sign, minlength=len(pairs))
            slope += strength * 2 / len(pairs) * np.bincount(pair_index, change[pair_at] * sign, minlength=len(w))
        g = np.append(slope * scale + decay * w, error.sum())
        moved, moved2 = b1 * moved + (1 - b1) * g, b2 * moved2 + (1 - b2) * g * g
        shift = 0.1 * (moved / (1 - b1**step)) / (np.sqrt(moved2 / (1 - b2**step)) + 1e-9)
        w, bias = w - shift[:-1], bias - shift[-1]
    return w * scale, float(bias)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES, strength: float = 4.0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits a model to labelled texts. ``sample`` bounds the labelled rows that are learned from, ``features`` the model's size."""
    chosen = labels.select(F.col(id_col).cast("long").alias("d"), F.col(label_col).cast("int").alias("y")).where("d is not null and y in (0, 1)")
    chosen = hash_sample(chosen, "d", sample)  # 12 bytes for each of at most ``sample`` rows
    texts = docs.select(F.col(id_col).cast("long").alias("d"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    texts = written(texts.join(F.broadcast(chosen), "d").select("y", "t").dropDuplicates())

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, 1):
                found = [{f for w in words_of(t) for f in features_of(w)} for t in rows.column(1).to_pylist()]
                marks = np.repeat(rows.column(0).to_numpy(), [len(x) for x in found])
                yield pa.record_batch([pa.array([f for x in found for f in x], pa.int64()), pa.array(marks, pa.int32())], ["f", "y"])

    total = texts.agg(F.count("*"), F.sum("y")).first()
    n, rate = total[0], (total[1] or 0) / max(1, total[0])
    # how far a feature's toxic count is from what the rate alone would give, in standard deviations
    far = (F.col("s") - F.col("c") * rate) / F.sqrt(F.col("c") * rate * (1 - rate) + 1e-9)
    counted = texts.mapInArrow(present, "f long, y int").groupBy("f").agg(F.count("*").alias("c"), F.sum("y").alias("s")).where("c >= 3")
    kept = counted.select("f", far.alias("z")).where(F.abs("z") >= 2).orderBy(F.abs("z").desc(), "f").limit(features).collect() if 0 < rate < 1 else []
    place, scale = {r.f: i for i, r in enumerate(kept)}, np.array([min(abs(r.z), 20.0) / 10 for r in kept])

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def places(words: set[str]) -> list[int]:
            return sorted({place[f] for w in words for f in features_of(w) if f in place})

        for batch in batches:
            for rows in slices(batch, 1):
                sets = [words_of(t) for t in rows.column(1).to_pylist()]
                kinds = [pa.array([places(s) for s in sets], pa.list_(pa.int32())), pa.array([[places(x) for x in swapped(s)] for s in sets], pa.list_(pa.list_(pa.int32())))]
                yield pa.record_batch([rows.column(0), *kinds], ["y", "own", "swaps"])

    rows = texts.mapInArrow(known, "y int, own array<int>, swaps array<array<int>>").toArrow().to_pydict()  # at most ``sample`` short rows
    own = [np.array(x, dtype=np.int64) for x in rows["own"]]
    pairs = [(a, np.array(b, dtype=np.int64)) for a, swaps in zip(own, rows["swaps"]) for b in swaps]
    weights, bias = train(own, np.array(rows["y"], dtype=np.float64), pairs, scale, strength)
    return Model({r.f: float(x) for r, x in zip(kept, weights) if abs(x) > 1e-3}, bias)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, by a model that has not seen the labels of held-out ids."""
    model = fit(docs, labels.where(~held_out()))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), model.score(F.col("text")).alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    return docs.where(fit(docs, labels.where(~held_out())).score(F.col("text")) < threshold)
