import numpy as np
import pytest

from keyclock.llm import mixing

SCHEMA = "doc_id long, text string, source string, size long, target string"


def shares(sizes, total, most=2.0):
    """Reshares the excess by weight until none is above its bound."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(names)}
    full, open_ = {}, set(names)
    while open_:
        rest = total - sum(full.values())
        whole = sum(weight[s] for s in open_)
        above = {s for s in open_ if rest * weight[s] / whole > most * sizes[s] + 1e-9}
        if not above:
            return full | {s: rest * weight[s] / whole for s in open_}
        full |= {s: most * sizes[s] for s in above}
        open_ -= above
    return full


def documents(n=3000, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        source = ["a", "a", "a", "b", "é", "z", None, "empty"][i % 8]
        words = 0 if source == "empty" else int(rng.integers(0, 40)) if i % 97 else 400
        rows.append((i, None if i % 101 == 0 else " ".join(["w"] * words) + "\n", source, 5, "x"))
    return rows


def test_targets_sizes_and_balance(spark):
    rows = documents()
    got = mixing.mixed(spark.createDataFrame(rows, SCHEMA), block=200).collect()
    assert sorted(r.doc_id for r in got) == [r[0] for r in rows]
    size = {r[0]: len((r[1] or "").split()) for r in rows}
    source = {r[0]: r[2] for r in rows}
    total = {}
    for i, s in source.items():
        total[s] = total.get(s, 0) + size[i]
    want = shares(total, 1.5 * sum(total.values()))
    taken = dict.fromkeys(total, 0)
    for r in got:
        assert (r.size, r.source_size) == (size[r.doc_id], total[source[r.doc_id]])
        assert r.target == pytest.approx(want[source[r.doc_id]], rel=1e-9)
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[source[r.doc_id]] += r.taken
    for s in total:
        assert abs(taken[s] - want[s]) <= 40
    again = mixing.mixed(spark.createDataFrame(rows, SCHEMA).repartition(5), block=200).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def test_a_flight_keeps_both_totals_and_its_chances():
    size = np.random.default_rng(1).integers(1, 500, 300).astype(float)
    start = np.full(300, 0.3)
    seen = np.zeros(300)
    for seed in range(200):
        p = mixing.flight(start, size, np.random.default_rng(seed))
        open_ = (p > 1e-9) & (p < 1 - 1e-9)
        assert open_.sum() <= 2
        assert p.sum() == pytest.approx(90, abs=1e-6) and p @ size == pytest.approx(0.3 * size.sum(), rel=1e-9)
        seen += p
    assert abs(seen / 200 - 0.3).max() < 0.16


def test_repeated_rows_nulls_and_nothing(spark):
    rows = [(None, "a b c", None, 1, ""), (4, "a b", "s", 1, ""), (4, "a b", "s", 1, ""), (4, "a b", "s", 1, ""), (5, None, "t", 1, "")]
    got = mixing.mixed(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 5
    assert {r.source: r.target for r in got}["t"] == 0
    assert all(r.taken <= 2 * r.size for r in got)
    assert mixing.mixed(spark.createDataFrame([], SCHEMA)).collect() == []


def test_equal_rows_of_two_sources_stay_with_their_source(spark):
    rows = [(1, "a b c d", "p", 1, ""), (1, "a b c d", "q", 1, ""), (2, "e f g", "p", 1, ""), (3, "h i j", "q", 1, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    plan = {(r.doc_id, r.source): r.copies for r in mixing.mixed(docs).collect()}
    got = [(r.doc_id, r.source) for r in mixing.applied(docs).collect()]
    assert {k: got.count(k) for k in plan} == plan and len(got) == sum(plan.values())
    assert plan[1, "q"] > 0


def test_twenty_thousand_equal_rows_fill_no_block(spark):
    rows = [(7, "the same words", "hot", 1, "")] * 20_000 + [(i, "w " * (i % 50), "hot", 1, "") for i in range(100, 400)] + [(i, "v " * 30, "b", 1, "") for i in range(400, 500)]
    docs = spark.createDataFrame(rows, SCHEMA)
    plan = mixing.plan_of(docs)
    assert plan.count() == 401
    got = mixing.mixed(docs).collect()
    assert len(got) == len(rows)
    equal = [r.copies for r in got if r.doc_id == 7]
    assert len(equal) == 20_000 and max(equal) - min(equal) <= 1
    for s in ("hot", "b"):
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 50
        assert all(r.taken <= 2 * r.size for r in mine)
    assert mixing.applied(docs).count() == sum(r.copies for r in got)
