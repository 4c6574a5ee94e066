import math
from fractions import Fraction

import numpy as np
import pytest
from helpers import SMALL, rows_of

from textlab.llm import queries, whitening


def matrices():
    rng = np.random.default_rng(1)
    turn = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    yield "random", rng.normal(size=(900, 64))
    yield "graded", rng.normal(size=(900, 64)) * np.logspace(0, -6, 64)
    yield "few rows", rng.normal(size=(10, 64))
    yield "narrow", rng.normal(size=(500, 5))
    yield "one column", rng.normal(size=(3, 1))
    yield "identity", np.concatenate([np.eye(32)] * 3)
    yield "empty columns", np.concatenate([rng.normal(size=(90, 20)), np.zeros((90, 4))], axis=1)
    yield "close values", (turn * np.array([5.0] * 5 + [3 + 1e-9 * i for i in range(6)] + list(np.linspace(2, .1, 29)))) @ turn.T
    yield "equal rows", np.ones((5, 8))
    yield "nothing", np.zeros((5, 8))


@pytest.mark.parametrize("name, a", list(matrices()))
def test_singular_values_and_directions(name, a):
    r = np.linalg.qr(a, mode="r")
    r = np.concatenate([r, np.zeros((a.shape[1] - len(r), a.shape[1]))])
    squares, v = whitening.singular(r, 16)
    s = np.linalg.svd(a, compute_uv=False)
    rank = np.linalg.matrix_rank(a)
    assert len(squares) == min(16, rank)
    if not rank:
        return
    assert np.abs(squares / s[:len(squares)] ** 2 - 1).max() < 1e-12
    assert np.abs(v.T @ v - np.eye(len(squares))).max() < 1e-13
    assert np.abs(a.T @ (a @ v) - v * squares).max() < 1e-13 * s[0] ** 2


def test_dqds_keeps_small_values():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 30):
        a, b = rng.uniform(.5, 2, n) * np.logspace(0, -30, n), rng.uniform(.5, 2, n - 1) * np.logspace(0, -30, n)[1:]
        got = whitening.dqds(a, b)
        product = Fraction(1)
        for x in a:
            product *= Fraction(float(x)) ** 2
        for x in got:
            product /= Fraction(float(x))
        assert abs(float(product) - 1) < 1e-11  # of all values, the smallest ones too
    zero = whitening.dqds(np.array([1.0, 0.0, 2.0]), np.array([1.0, 1.0]))
    b = np.array([[1, 1, 0], [0, 0, 1], [0, 0, 2.0]])
    assert np.allclose(np.sqrt(zero), np.linalg.svd(b, compute_uv=False), atol=1e-12)


def expected(vectors, top=16):
    """The contract's values with numpy's symmetric solver."""
    x = [tuple(math.floor(64 * float(c)) + 1_000_000 for c in v) for v in vectors]
    fit = sorted(set(x))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centre = lambda rows: np.array([[n * c - s for c, s in zip(r, sums, strict=True)] for r in rows], float) / n
    c = centre(fit)
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:top], v[:, ::-1][:, :top]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]
    return n, deviation, centre(x) @ v / np.sqrt(e), e / np.trace(c.T @ c / n)


def test_query_same_as_symmetric_solver(spark):
    rows = rows_of("embeddings", "vec_id, embedding")
    n, deviation, whitened, explained = expected([v for _, v in rows])
    got = {(r["vec_id"], r["component"]): r for r in queries.op13_whitening(spark, SMALL).collect()}
    assert len(got) == 16 * len(rows)
    signs = [None] * 16
    for i, (vec, _) in enumerate(rows):
        for k in range(16):
            r = got[vec, k + 1]
            assert (r["n"], r["deviation"]) == (n, deviation[i])
            assert abs(r["explained"] / explained[k] - 1) < 1e-10 and r["identity_error"] < 1e-9
            signs[k] = signs[k] or math.copysign(1, r["whitened"] * whitened[i, k])
            assert abs(r["whitened"] - signs[k] * whitened[i, k]) < 1e-8


def test_odd_rows(spark):
    rng = np.random.default_rng(6)
    good = [(i, rng.normal(size=3).tolist(), 1) for i in range(40)]
    bad = [(100, None, 1), (101, [1.0, None, 2.0], 1), (102, [1.0, float("nan"), 2.0], 1), (103, [float("inf"), 1.0, 1.0], 1),
           (104, [], 1), (105, [1.0, 2.0], 1), (None, [5.0, 5.0, 5.0], 1)]
    copies = [(7, good[0][1], 1)] * 30
    frame = spark.createDataFrame(good + bad + copies, "vec_id long, embedding array<float>, N int")
    rows = whitening.whiten(frame).collect()
    assert len(rows) == 71 and {r["vec_id"] for r in rows} == {*range(40), None}
    single = [np.float32(v).tolist() for _, v, _ in good] + [[5.0] * 3]
    n, deviation, whitened, explained = expected(single, 3)
    assert {r["n"] for r in rows} == {n} == {41} and len(rows[0]["whitened"]) == 3
    by_id = {r["vec_id"]: r for r in rows if r["vec_id"] != 7}
    for i in [*range(7), *range(8, 40)]:
        assert by_id[i]["deviation"] == deviation[i]
        assert np.allclose(np.abs(by_id[i]["whitened"]), np.abs(whitened[i]), atol=1e-9)
    assert whitening.whiten(frame.where("vec_id > 99")).count() == 1  # only the two numbers are left
    assert whitening.whiten(frame.where("vec_id = 7")).first()["whitened"] is not None
    alone = whitening.whiten(frame.where("vec_id is null")).first()
    assert (alone["n"], alone["deviation"], alone["whitened"], alone["identity_error"]) == (1, 0, [], 0.0)
    assert whitening.whiten(frame.where("vec_id = 100")).count() == 0


def test_partials_are_merged_in_a_tree(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=6) * 3).tolist()) for i in range(700)]
    many = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(70)
    x = whitening.prepared(many)
    n, deviation, whitened, explained = expected([v for _, v in rows], 6)
    distinct = x.select("x").distinct().repartition(70)
    sums = [int(c) for c in np.array([r["x"] for r in distinct.collect()]).sum(axis=0)]
    r = whitening.triangle(distinct, n, sums)
    squares, v = whitening.singular(r, 6)
    assert np.allclose(squares / n / ((r * r).sum() / n), explained)
    model = whitening.Whitening(n, sums, v, squares / n, 1.0)
    assert whitening.identity_error(distinct, model) < 1e-10


def test_numbers_beyond_a_long(spark):
    far = [(1, [3e7, 0.0]), (2, [-3e7, 1.0]), (3, [1.0, 2.0])] + [(i, [float(i), 3.0]) for i in range(4, 300)]
    rows = {r["vec_id"]: r for r in whitening.whiten(spark.createDataFrame(far, "vec_id long, embedding array<double>")).collect()}
    n, deviation, whitened, _ = expected([v for _, v in far], 2)
    for i in range(1, 300):
        assert rows[i]["deviation"] == (deviation[i - 1] if deviation[i - 1] < 2 ** 63 else None)
        assert np.allclose(np.abs(rows[i]["whitened"]), np.abs(whitened[i - 1]), rtol=1e-6, atol=1e-9)
    assert rows[1]["deviation"] is None
