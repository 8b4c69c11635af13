import random

import numpy as np

from keyclock.llm import decontamination as D

SCHEMA = "doc_id long, text string, item_id string, cosine int"


def corpus():
    rnd = random.Random(8)
    common = [f"c{i}" for i in range(40)]
    rare = [f"r{i}x{j}" for i in range(60) for j in range(30)]
    line = lambda n: " ".join(rnd.choice(common if rnd.random() < 0.4 else rare) for _ in range(n))
    items = [(i, line(rnd.randint(14, 60)).capitalize() + ".") for i in range(60)]
    docs, planted = [], set()
    for d in range(300):
        words = line(rnd.randint(5, 400)).split()
        if d % 3 == 0:
            item, text = rnd.choice(items)
            own = text.split()
            if d % 2:  # a paraphrase: some words are other words
                for k in rnd.sample(range(len(own)), len(own) // 6):
                    own[k] = rnd.choice(common)
            at = rnd.randint(0, len(words))
            words[at:at] = own
            planted.add((d, item))
        docs.append((d, " ".join(words), "x", 1))
    return docs, items, planted


def test_copies_and_paraphrases_are_found_and_nothing_else(spark):
    docs, items, planted = corpus()
    bench = spark.createDataFrame([(i, t, 0) for i, t in [*items, (98, None), (99, " ! "), (None, "wordless? no, some words here")]], "item_id long, text string, doc_id int")
    frame = spark.createDataFrame([*docs, (None, None, "x", 1), (500, "", "x", 1), (501, "word " * 30_000, "x", 1)], SCHEMA)
    got = {(r.doc_id, r.item_id): r for r in D.matches(frame, bench).collect()}
    assert set(got) == planted
    assert all(r.lcs_share >= 0.6 and r.answer_share >= 0.5 and 0.25 <= r.cosine <= 1.01 for r in got.values())
    from pyspark.sql import functions as F

    kept = frame.where(~D.contaminated(frame, bench, F.col("text")))
    assert {r.doc_id for r in kept.collect()} == {d[0] for d in docs} - {d for d, _ in planted} | {None, 500, 501}
    assert D.matches(frame.limit(0), bench).collect() == [] and D.matches(frame, bench.limit(0)).collect() == []


def test_blocks_of_items_and_repeated_rows(spark, monkeypatch):
    docs, items, planted = corpus()
    monkeypatch.setattr(D.blocks, "__defaults__", ("item_id", "text", 25))
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs + docs[:1], SCHEMA)
    got = [(r.doc_id, r.item_id) for r in D.matches(frame, bench).collect()]
    assert set(got) == planted
    assert len(got) == len(planted) + sum(d == 0 for d, _ in planted)


def test_the_basis_is_that_of_a_full_decomposition(spark):
    rng = np.random.default_rng(3)
    matrix = rng.standard_normal((50, 8)) @ rng.standard_normal((8, 30))
    rows = spark.createDataFrame([(list(range(30)), [float(x) for x in r]) for r in matrix], "place array<int>, weight array<float>").repartition(3)
    basis = D.factored(rows, 30, 8)
    _, _, right = np.linalg.svd(matrix)
    assert np.allclose(basis @ basis.T, right[:8].T @ right[:8], atol=1e-4)


def test_thousands_of_items_against_the_longest_common_subsequence_of_all_pairs(spark):
    rnd = random.Random(4)
    vocabulary = [f"v{i}" for i in range(9000)]
    texts = [[vocabulary[int(9000 * rnd.random() ** 2)] for _ in range(300)] for _ in range(400)]
    items = []
    for i in range(3000):
        own, n = texts[i % 400], rnd.randint(15, 59)
        at = rnd.randint(0, 300 - n)
        items.append((i, " ".join(own[at : at + n])))
    docs, planted = [], set()
    for d in range(200):
        words, (i, item) = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 200))], items[rnd.randrange(3000)]
        own = item.split()
        if d % 2:  # a paraphrase
            for k in rnd.sample(range(len(own)), len(own) // 5):
                own[k] = rnd.choice(vocabulary)
        at = rnd.randint(0, len(words))
        docs.append((d, " ".join([*words[:at], *own, *words[at:]]), "x", 1))
        if not d % 2:
            planted.add((d, i))
    frame = spark.createDataFrame(docs, SCHEMA)
    block = D.prepared(frame, items)
    rare = [(lambda x: set(x[: max(1, len(x) // 4)]))(sorted(set(w), key=lambda w: (-block.idf[block.place[w]], w))) for w in block.words]

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before, row = row, [0] * (len(b) + 1)
            for j, y in enumerate(b):
                row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
        return row[-1]

    want = set()
    for d, text, _, _ in docs:
        words = text.split()
        held = set(words)
        for i, own in zip(block.ids, block.words):
            n = len(own)
            if sum(w in held for w in own) < 0.6 * n or 2 * len(rare[i] & held) < len(rare[i]):
                continue
            for w in range(-(-len(words) // D.STRIDE)):
                around = words[max(0, w * D.STRIDE - n) : (w + 2) * D.STRIDE + n]
                if 2 * len(rare[i] & set(around)) >= len(rare[i]) and lcs(own, around) >= 0.6 * n:
                    want.add((d, i))
    found = block.searcher(D.COSINE, D.LCS, D.ANSWER)([t for _, t, _, _ in docs])
    got = {(d, m[0]) for d, own in enumerate(found) for m in own}
    assert planted <= want
    assert got == want
    few = D.prepared(frame, items, rank=4).searcher(D.COSINE, D.LCS, D.ANSWER)([t for _, t, _, _ in docs])
    assert {(d, m[0]) for d, own in enumerate(few) for m in own} == want


def reworded():
    """Items of which just over half of the rarest words, and few others, are other words in a document."""
    rnd = random.Random(21)
    common, rare = [f"c{i}" for i in range(300)], [f"r{i}" for i in range(4000)]
    items, docs = [], []
    for i in range(200):
        n = rnd.randint(30, 59)
        own = [rnd.choice(rare) if k % 4 == 0 else rnd.choice(common) for k in range(n)]
        items.append((i, " ".join(own)))
        if i % 5 == 0:
            docs.append((i, own))
    return rnd, common, items, docs


def test_rewordings_that_only_the_latent_search_finds(spark):
    rnd, common, items, docs = reworded()
    plain = spark.createDataFrame([(1000 + i, " ".join(rnd.choices(common, k=120)), "x", 1) for i in range(100)], SCHEMA)
    block = D.prepared(plain, items)
    texts, want = [], set()
    for i, own in docs:
        ranked = sorted(set(own), key=lambda w: (-block.idf[block.place[w]], w))
        gone = set(ranked[: max(1, len(ranked) // 4)][: len(ranked) // 8 + 1])  # just over half of a quarter
        body = [rnd.choice(common) if w in gone else w for w in own]
        assert sum(a == b for a, b in zip(body, own)) >= 0.75 * len(own)
        texts.append((i, " ".join(rnd.choices(common, k=40) + body + rnd.choices(common, k=40)), "x", 1))
        want.add((i, i))
    frame = spark.createDataFrame(texts, SCHEMA).union(plain)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.matches(frame, bench).collect()}
    off = {(r.doc_id, r.item_id) for r in D.matches(frame, bench, cosine=2.0).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)
    assert len(off) <= 0.1 * len(want)  # without the latent search they are missed
    from pyspark.sql import functions as F

    kept = {r.doc_id for r in frame.where(~D.contaminated(frame, bench, F.col("text"))).collect()}
    assert kept == {r.doc_id for r in frame.select("doc_id").collect()} - {d for d, _ in got}


def test_many_items_share_a_small_space(spark):
    """Recall of rewordings against all pairs, with two thousand items in few directions, over blocks and passes."""
    rnd = random.Random(5)
    vocabulary = [f"v{i}" for i in range(6000)]
    pick = lambda n: [vocabulary[int(6000 * rnd.random() ** 2)] for _ in range(n)]
    items = [(i, " ".join(pick(rnd.randint(25, 59)))) for i in range(2000)]
    docs, want = [], set()
    for d in range(60):
        i, text = items[rnd.randrange(2000)]
        own = text.split()
        for k in rnd.sample(range(len(own)), len(own) // 6):
            own[k] = rnd.choice(vocabulary)
        docs.append((d, " ".join(pick(30) + own + pick(30)), "x", 1))
        want.add((d, i))
    frame, bench = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    # only what the latent search proposes, with no index: nothing shares all rarest words
    block = D.prepared(frame, items)
    latent = block.searcher(D.COSINE, 2.0, 2.0, D.PARAPHRASE)([t for _, t, _, _ in docs])
    got = {(d, m[0]) for d, own in enumerate(latent) for m in own}
    assert got <= want and len(got) >= 0.9 * len(want)
    both = {(r.doc_id, r.item_id) for r in D.matches(frame, bench).collect()}
    assert got <= both <= want
