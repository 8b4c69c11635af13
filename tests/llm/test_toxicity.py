import zlib

import numpy as np

from keyclock.llm import toxicity

SCHEMA = "doc_id long, text string, score double, toxic int"


def test_held_out_accuracy(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet"), spark.read.parquet(f"{sf_dir}/../sf0.01/labels.parquet")
    got = {r.doc_id: r for r in toxicity.scored(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    rows = [(r.toxic, got[r.doc_id].predicted) for r in labels.collect() if got[r.doc_id].held_out]
    right = sum(a == b for a, b in rows) / len(rows)
    assert right >= 0.93, right
    assert sum(b for a, b in rows if a) / sum(a for a, _ in rows) >= 0.6


def biased():
    """Insults come mostly with one group's name; neutral sentences mention all groups."""
    rng = np.random.default_rng(2)
    words = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 2
        text = list(rng.choice(words, 12))
        if toxic:
            text += ["gay"] if rng.random() < 0.8 else []
            text += ["moron"] if rng.random() < 0.75 else []
        elif rng.random() < 0.05:
            text += ["gay"]
        rows.append((i, " ".join(text), 0.0, 0))
        labels.append((i, toxic))
    return rows, labels


def test_swapping_identities_lowers_false_positives(spark):
    rows, labels = biased()
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    neutral = [f"wordab my neighbour is gay wordcd wordef {w}" for w in ("worda", "wordbb", "wordcc")]
    plain = toxicity.fit(docs, marks, strength=0.0).scorer()(neutral)
    fair = toxicity.fit(docs, marks, strength=50.0)
    assert (fair.scorer()(neutral) < plain - 0.2).all()
    assert fair.scorer()(["what a moron wordab"])[0] > 0.5


def test_nulls_ties_and_nothing(spark):
    docs = spark.createDataFrame([(1, None, 0.0, 0), (None, "moron", 0.0, 0), (2, "", 0.0, 0), (2, "", 0.0, 0)], SCHEMA)
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    got = toxicity.scored(docs, labels).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    none = toxicity.scored(docs.limit(0), labels.limit(0))
    assert none.collect() == []
    assert all(r.predicted == 0 for r in toxicity.scored(docs, labels.limit(0)).collect())
