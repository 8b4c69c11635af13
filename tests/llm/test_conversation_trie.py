import hashlib
import random
import zlib

import pytest

from keyclock.llm import conversation_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, n string"


def words(text):
    return len(text.replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")) - (text.replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")).count("")


def brute(rows):
    """Node by node, from prefixes as tuples."""
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    rebuilt = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - c % 20, [])[:h] + ts[h:]
    members = {}
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = children.get(p, [])
        leaves[p] = sum(leaves[q] for q in below) if below else 1
        saved[p] = sum(saved[q] for q in below) + ((len(members[p]) - 1) * words(p[-1][1]) if p else 0)
    out = []
    for p, cs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(rebuilt[c]) == len(p)))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(children.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def taken(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def conversations(rnd, n, most=14, texts=3):
    rows = []
    for c in range(n):
        for t in range(rnd.randint(1, most)):
            rows.append((c * rnd.choice([1, 1, 3]), t, rnd.choice(["user", "user", "bot"]), " ".join(["w"] * rnd.randint(1, texts)), 1, "x"))
    return rows


@pytest.mark.parametrize("block,seed", [(1, 1), (4, 3), (4, 4)])
def test_against_prefixes_as_tuples(spark, block, seed):
    rnd = random.Random(seed)
    rows, seen = [], set()
    for c, t, *rest in conversations(rnd, 120, texts=2 if seed % 2 else 1):
        if (c, t) not in seen:
            seen.add((c, t))
            rows.append((c, t, *rest))
    # copies of conversations, and one that goes on where another ends
    rows += [(1000 + k, *r[1:]) for k in range(30) for r in rows if r[0] == 7]
    rows += [(2000, *r[1:]) for r in rows if r[0] == 7] + [(2000, 99, "user", "and on", 1, "x")]
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert taken(trie.rebuilt_trie(docs, block)) == brute(rows)


def test_long_conversations_over_many_slices(spark, monkeypatch):
    monkeypatch.setattr(trie, "SLICE", 5)
    rnd = random.Random(8)
    base = [("user" if t % 2 else "bot", f"turn {t % 3}") for t in range(60)]
    rows = []
    for c in range(40):
        cut = rnd.randrange(60)
        for t, (role, text) in enumerate(base[:cut] + [("user", f"own {c % 4}")] * rnd.randint(0, 9)):
            rows.append((c, t, role, text, 1, "x"))
    rnd.shuffle(rows)
    assert taken(trie.rebuilt_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_nulls_turnless_conversations_and_nothing(spark):
    # 41 has too few turns of its own and no base; null turns come first; no id, no conversation
    few = next(c for c in range(41, 60) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(few, 0, "user", "a", 1, "x"), (61, None, None, None, 1, "x"), (61, 5, "bot", " \t", 1, "x"), (61, -2, "bot", "b c", 1, "x"), (None, 1, "user", "gone", 1, "x"), (-3, 0, "user", "minus", 1, "x"), (100, 0, "u", "x y z", 1, "x"), (100, 0, "u", "x y z", 1, "x")]
    got = taken(trie.rebuilt_trie(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute(rows)
    root = next(r for r in got if r[1] == 0)
    assert root[-1] != hashlib.sha256(b"").hexdigest()  # somebody ends there
    assert taken(trie.rebuilt_trie(spark.createDataFrame([], SCHEMA))) == []
    only = [(few, 0, "user", "a", 1, "x")]
    assert taken(trie.rebuilt_trie(spark.createDataFrame(only, SCHEMA))) == brute(only)


def test_many_copies_and_many_ends(spark, monkeypatch):
    monkeypatch.setattr(trie, "SLICE", 64)
    rows = [(20 * c, t, "user", f"same {t}", 1, "x") for c in range(700) for t in range(6)] + [(20 * c, 6, "bot", f"own {c}", 1, "x") for c in range(0, 700, 3)]
    got = taken(trie.rebuilt_trie(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute(rows)
