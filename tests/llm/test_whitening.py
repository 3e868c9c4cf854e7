"""Embedding whitening against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedlake.llm import queries as Q
from feedlake.llm import whitening as W

SF = "/root/testdata/sf0.001"


def plain(vectors, k=8):
    """n, deviations, whitened rows, shares: of vectors (lists of floats) that all take part."""
    x = np.floor(1024 * np.array(vectors, np.float64)).astype(np.int64) + 100000
    n, s = len(x), x.sum(0)
    dev = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s)) for r in x]
    c = x - s / n
    values, vec = np.linalg.eigh(c.T @ c / n)
    values, vec = values[::-1][:k], vec[:, ::-1][:, :k]
    return n, dev, c @ vec / np.sqrt(values), values / np.trace(c.T @ c / n)


def same(got, want):
    """Equal but for the sign of each column."""
    sign = np.sign((got * want).sum(0))
    return np.allclose(got, want * sign, rtol=1e-9, atol=1e-9)


def test_query_against_numpy(spark):
    rows = sorted(spark.read.parquet(f"{SF}/embeddings.parquet").collect(), key=lambda r: r.vec_id)
    n, dev, white, share = plain([r.embedding for r in rows])
    got = sorted(Q.REGISTRY["op12_whitening"](spark, SF).collect(), key=lambda r: (r.vec_id, r.component))
    assert len(got) == 8 * n and [r.component for r in got] == list(range(1, 9)) * n
    assert [r.vec_id for r in got[::8]] == [r.vec_id for r in rows] and [r.deviation for r in got[::8]] == dev
    assert same(np.array([r.whitened for r in got]).reshape(-1, 8), white)
    assert np.allclose([r.explained for r in got[:8]], share, rtol=1e-9)
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_many_blocks_and_tasks(spark, monkeypatch):
    monkeypatch.setattr(W, "BLOCK_BYTES", 8 * 5 * 7)     # seven rows a block
    monkeypatch.setattr(W, "BLOCKS_A_TASK", 3)
    r = np.random.default_rng(3)
    v = (r.normal(size=(400, 5)) * [9, 5, 3, 1, .2] + 4).astype(np.float32).astype(float).tolist()
    got = sorted(W.whiten(spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<float>").repartition(7), k=3).collect(), key=lambda x: x.vec_id)
    n, dev, white, share = plain(v, 3)
    assert [x.deviation for x in got] == dev and same(np.array([x.whitened for x in got]), white)
    assert np.allclose(got[0].explained, share) and got[0].identity_error < 1e-9


def test_cases(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0, 5.0], [2.0, 0.5, 5.0], [3.0, 9.0, 5.0], [3.0, 9.0, 5.0]]
    bad = [None, [], [1.0, None, 2.0], [nan, 1.0, 2.0], [inf, 1.0, 2.0], [1.0, 2.0], [1e30, 1.0, 1.0]]
    rows = [(None if i == 1 else 7, v, "x", 1) for i, v in enumerate(good + bad)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string, index int")
    got = W.whiten(df, k=8).collect()
    assert sorted((r.vec_id is None) for r in got) == [False, False, False, True] and {r.n for r in got} == {4}
    assert sorted(r.deviation for r in got) == sorted(plain(good)[1])
    for r in got:       # the third dimension never varies
        assert len(r.whitened) == 3 and r.whitened[2] == 0 and r.explained[2] == 0 and r.identity_error < 1e-9
    assert W.whiten(df.where("false")).count() == 0
    one = W.whiten(df.limit(1)).first()
    assert one.n == 1 and one.deviation == 0 and one.whitened == [0, 0, 0] and one.explained == [0, 0, 0] and one.identity_error == 0


def test_deviation_beyond_a_long_is_null(spark):
    df = spark.createDataFrame([(i, [float((-1) ** i * 2 ** 30)]) for i in range(6)], "vec_id long, embedding array<double>")
    got = W.whiten(df).collect()
    assert [r.deviation for r in got] == [None] * 6 and all(abs(abs(r.whitened[0]) - 1) < 1e-9 for r in got)


@pytest.mark.parametrize("k", [1, 2, 5])
def test_components_are_ordered(k):
    values, vectors = W.components(np.diag([1.0, 4.0, 2.0]), k)
    assert list(values) == [4.0, 2.0, 1.0][:k] and (vectors.max(0) > 0).all()
