import random

import numpy as np
import pytest
import xxhash

from keyclock.llm import simhash
from keyclock.llm.components import components

SCHEMA = "doc_id long, text string, fp string, band int"


def plain(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(prints):
    """Least id by components, by comparing all pairs."""
    ids = list(prints)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def test_texts_against_all_pairs(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rnd.choices(words, k=rnd.randint(20, 400))) for _ in range(60)]
    texts = [*base, *base[:10], "", "  \n\t", "one", "ONE", "a b c", "A\x0bb\x0c c", "x " * 5000, None]
    for t in base[:30]:
        own = t.split()
        for _ in range(3):
            own[rnd.randrange(len(own))] = rnd.choice(words)
            texts.append(" ".join(own))
    docs = spark.createDataFrame([(1000 + 3 * i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in simhash.groups(docs).collect()}
    prints = {1000 + 3 * i: plain(t) for i, t in enumerate(texts)}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    want = brute(prints)
    assert {i: r.component_id for i, r in got.items()} == want
    assert len(set(want.values())) < len(want)


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f", "", 1), (7, "a b c d e f", "", 1), (7, "a b c d e f", "", 1), (None, None, "", 1)], SCHEMA)
    got = sorted(((r.doc_id or 0, r.component_id) for r in simhash.groups(docs).collect()), key=str)
    assert got == [(0, 7), (0, None), (7, 7), (7, 7)]


def test_empty_table(spark):
    assert simhash.groups(spark.createDataFrame([], SCHEMA)).collect() == []


def pairs_of(prints, radius):
    d = np.bitwise_count(prints[:, None] ^ prints[None, :])
    return [(int(a), int(b)) for a, b in zip(*np.nonzero(d <= radius)) if a < b]


@pytest.mark.parametrize("radius,bands,leaf", [(4, 4, 16), (4, 2, 16), (3, 1, 64), (4, 5, 8), (0, 4, 16)])
def test_every_pair_meets_in_a_shard(spark, radius, bands, leaf):
    rng = np.random.default_rng(radius + bands)
    centres = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    near = [c ^ sum(np.uint64(1) << np.uint64(b) for b in rng.choice(64, size=rng.integers(0, 6), replace=False)) for c in np.repeat(centres[:60], 6)]
    dense = np.repeat(centres[:1], 300) ^ rng.integers(0, 1 << 9, 300, dtype=np.uint64)
    prints = np.unique(np.concatenate((centres, np.array(near, dtype=np.uint64), dense)))
    fps = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    links = [(r.a, r.b) for r in simhash.links(fps, radius, bands, leaf, sample=200).collect()]
    at = {int(x): i for i, x in enumerate(prints.view(np.int64))}
    own, want = list(range(len(prints))), list(range(len(prints)))
    for parent, edges in ((own, [(at[a], at[b]) for a, b in links]), (want, pairs_of(prints, radius))):
        for a, b in edges:
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            parent[max(a, b)] = min(a, b)
        for i in range(len(parent)):
            while parent[i] != parent[parent[i]]:
                parent[i] = parent[parent[i]]
    assert own == want
    assert all((prints[at[a]] ^ prints[at[b]]) is not None for a, b in links)


def test_components_of_chains_hubs_and_nothing(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(5, i) for i in range(200, 260)]
    links = spark.createDataFrame([*chain, *hub, (9, 9), (None, 3), *hub[:3]], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {i: 100 for i in range(101, 161)} | {i: 5 for i in range(200, 260)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_one_row_of_each_group_stays(spark):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    texts = ["", None, "one", "ONE"]
    for _ in range(40):
        own = rnd.choices(words, k=rnd.randint(30, 400))
        texts.append(" ".join(own))
        for _ in range(4):
            own[rnd.randrange(len(own))] = rnd.choice(words)
            texts.append(" ".join(own))
    rnd.shuffle(texts)
    docs = spark.createDataFrame([(3 * i, t, f"x{i}", i) for i, t in enumerate(texts)], SCHEMA)
    got = simhash.one_of_each(docs).collect()
    want = brute({3 * i: plain(t) for i, t in enumerate(texts)})
    assert sorted(r.doc_id for r in got) == sorted(set(want.values()))
    assert len(got) < len(texts) and all(r.fp == f"x{r.band}" and r.text == texts[r.band] for r in got)
