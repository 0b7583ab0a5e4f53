"""Whitening against numpy on the same vectors."""

import math

import numpy as np
import pytest

from quarrylight.llm import whiten
from quarrylight.llm.queries import op11_whiten

SF = "/root/testdata/sf0.001"


def plainly(vectors, k=16):
    """(n, S, eigenvalues, eigenvectors, trace) of the different grid vectors, all by numpy."""
    x = np.unique(np.floor(64 * np.asarray(vectors, dtype=np.float64)).astype(np.int64) + 1_000_000, axis=0)
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    v = centred.T @ centred / n
    values, directions = np.linalg.eigh(v)
    return n, s, values[::-1][:k], directions[:, ::-1][:, :k], np.trace(v)


def held_against(rows, by_id, k=16):
    n, s, values, directions, trace = plainly(list(by_id.values()), k)
    got = {}
    for r in rows:
        got.setdefault(r.vec_id, {})[r.component] = r
    assert set(got) == set(by_id) and all(set(c) == set(range(1, k + 1)) for c in got.values())
    out = np.asarray([[got[i][c].whitened for c in range(1, k + 1)] for i in by_id])
    x = np.floor(64 * np.asarray(list(by_id.values()), dtype=np.float64)).astype(np.int64) + 1_000_000
    want = (x - s / n) @ directions / np.sqrt(values)
    signs = np.sign((out * want).sum(axis=0))
    assert np.allclose(out, want * signs, rtol=1e-7, atol=1e-7)
    for at, i in enumerate(by_id):
        assert {r.deviation for r in got[i].values()} == {int(sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[at], s, strict=True)))}
    first = next(iter(got.values()))
    assert np.allclose([first[c].explained for c in range(1, k + 1)], values / trace, rtol=1e-9)
    assert {r.n for r in rows} == {n} and len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9


def test_query(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    held_against(op11_whiten(spark, SF).collect(), {r.vec_id: r.embedding for r in vectors})


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    good = {i: rng.normal(size=5).round(3).tolist() for i in range(60)}
    bad = [(100, None, "clash"), (101, [], "clash"), (102, [1.0, None, 1.0, 1.0, 1.0], "clash"), (103, [math.nan] * 5, "clash"), (104, [math.inf, 0.0, 0.0, 0.0, 0.0], "clash"), (105, [1.0], "clash")]
    rows = [(i, v, "clash") for i, v in good.items()]
    # Copies have no weight; a row without an id counts and is returned.
    frame = spark.createDataFrame(rows + bad + [(7, good[7], "clash")] * 3 + [(200, good[8], "clash"), (None, good[9], "clash")], "vec_id long, embedding array<double>, x string")
    told = whiten.whitened_rows(frame, whiten.fit_whitening(frame)).collect()
    kept = [r for r in told if r.vec_id in good and not r.vec_id == 7]
    assert sum(r.vec_id == 7 for r in told) == 4 * 5 and sum(r.vec_id is None for r in told) == 5 and sum(r.vec_id == 200 for r in told) == 5
    assert {r.vec_id for r in told} == {*good, 200, None}
    once = {r.component: r for r in told if r.vec_id == 7}
    held_against(kept + list(once.values()), good, 5)


def test_no_variance(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]):
        frame = spark.createDataFrame(rows, schema)
        assert whiten.whitened_rows(frame, whiten.fit_whitening(frame)).collect() == []
    line = spark.createDataFrame([(i, [float(i), 3.0]) for i in range(9)], schema)
    assert {r.component for r in whiten.whitened_rows(line, whiten.fit_whitening(line)).collect()} == {1}


def test_huge_entries(spark):
    frame = spark.createDataFrame([(i, [float(i), (-1.0) ** i * 1e200]) for i in range(8)], "vec_id long, embedding array<double>")
    told = whiten.whitened_rows(frame, whiten.fit_whitening(frame)).collect()
    assert len(told) and all(r.deviation is None and math.isfinite(r.whitened) for r in told)


def test_exact_beyond_64_bits():
    w = whiten.Whitening(3_000_000_000, (3_000_000_000 * 1_000_000, 0), np.eye(2), np.ones(2))
    assert whiten.deviations(np.asarray([[1_000_000, 1]]), w) == [9 * 10**18]
    assert whiten.deviations(np.asarray([[1_000_001, 1]]), w) == [None]


def test_one_aggregation(spark):
    assert len(whiten.upper_triangle([f"c{i}" for i in range(64)])) == 2080
    with_more = spark.createDataFrame([tuple(float(i == j) for j in range(3)) for i in range(3)], "a double, b double, c double")
    kept, whiten.EXPRESSIONS = whiten.EXPRESSIONS, 2
    try:
        assert whiten.covariance(with_more, ["a", "b", "c"], 3) == pytest.approx(np.eye(3) / 3)
    finally:
        whiten.EXPRESSIONS = kept
