import numpy as np
import pytest

from keyclock.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n int, component string"


def check(rows, got, components=32):
    """Against numpy over all rows at once, in whole numbers where the contract is exact."""
    good = [(i, [float(np.float32(v)) for v in e]) for i, e, *_ in rows if e is not None and all(v is not None and np.isfinite(v) for v in e)]
    x = np.floor(np.array([e for _, e in good]) * 64).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    away = [sum((n * int(v) - int(t)) ** 2 for v, t in zip(r, total)) for r in x]
    centred = x - np.array([int(t) / n for t in total])
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    width = min(components, x.shape[1])
    assert len(got) == n * width
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), {})[r.component] = r
    assert {k[0] for k in by} == {i for i, _ in good}
    want = centred @ vectors / np.sqrt(np.maximum(values, 1e-300))
    assert all(set(v) == set(range(1, width + 1)) for v in by.values())
    for k in range(width):
        mine = np.array([by[i, a][k + 1].whitened for (i, _), a in zip(good, away)], dtype=float)
        if values[k] < 1e-9 * values[0]:
            assert np.isnan(mine).all()
            continue
        sign = np.sign(mine @ want[:, k])
        assert np.abs(mine * sign - want[:, k]).max() < 1e-6
        shares = {by[i, a][k + 1].explained for (i, _), a in zip(good, away)}
        assert len(shares) == 1 and shares.pop() == pytest.approx(values[k] / np.trace(covariance), rel=1e-9)
    assert {r.n for r in got} == {n}
    assert len({r.identity_error for r in got}) == 1


def vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, dim)) @ rng.normal(size=(dim, dim)) * 0.3 + rng.normal(size=dim)


def test_against_numpy_over_all_rows(spark):
    rows = [(i, [float(v) for v in e], 1, "x") for i, e in enumerate(vectors(2500, 40, 1))]
    rows += [(5000, None, 1, "x"), (5001, [None] + [1.0] * 39, 1, "x"), (5002, [float("inf")] + [1.0] * 39, 1, "x"), (5003, [float("nan")] * 40, 1, "x"), (5004, [1.0] * 39, 1, "x"), (5005, [], 1, "x")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = whitening.whitened(docs).collect()
    check([r for r in rows if r[0] < 5004], got)
    assert got[0].identity_error < 1e-9


def test_wide_vectors_in_several_column_blocks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "COLS", 16)
    monkeypatch.setattr(whitening, "ROWS", 64)
    rows = [(i, [float(v) for v in e], 1, "x") for i, e in enumerate(vectors(300, 40, 2))]
    check(rows, whitening.whitened(spark.createDataFrame(rows, SCHEMA).repartition(3), 20).collect(), 20)


def test_copies_few_dimensions_and_a_flat_one(spark):
    rows = [(i, [float(v[0]), 2.0, float(v[1])], 1, "x") for i, v in enumerate(vectors(200, 2, 3))]
    rows += [(1000 + i, [9.0, 2.0, -9.0], 1, "x") for i in range(400)]
    got = whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    check(rows, got)
    assert {r.component for r in got} == {1, 2, 3}


def test_one_vector_null_ids_and_nothing(spark):
    got = whitening.whitened(spark.createDataFrame([(None, [1.0, 2.0], 1, "x")], SCHEMA)).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got] == [(None, 1, 1, 0, None, None, None), (None, 2, 1, 0, None, None, None)]
    empty = whitening.whitened(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and empty.columns == [f.name for f in whitening.whitened(spark.createDataFrame([(1, [1.0], 1, "x")], SCHEMA)).schema]
