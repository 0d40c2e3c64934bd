"""Operator 11 against numpy's eigh, exact arithmetic and odd inputs."""

import numpy as np
import pytest

from mailfeat.llm import whitening as W
from mailfeat.llm.queries import op11_embedding_whitening
from mailfeat.llm.common import table

SF = "/root/testdata/sf0.01"


def plain(vectors, scale=256):
    """(id, x) of usable vectors, and n, sums, eigenvalues, eigenvectors of the distinct ones."""
    rows = [(i, [int(np.floor(scale * float(c))) for c in v]) for i, v in vectors if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array(sorted({tuple(v) for _, v in rows}), dtype=float)
    away = x - x.mean(0)
    values, columns = np.linalg.eigh(away.T @ away / len(x))
    return rows, len(x), [int(s) for s in x.sum(0)], values[::-1], columns[:, ::-1]


def test_query_equals_eigh(spark):
    vectors = [(r.vec_id, r.embedding) for r in table(spark, SF, "embeddings").collect()]
    rows, n, sums, values, columns = plain(vectors)
    got = {(r.vec_id, r.component): r for r in op11_embedding_whitening(spark, SF).collect()}
    assert len(got) == 4 * len(rows)
    trace, mean = values.sum(), np.array(sums) / n
    sides = {}
    for i, x in rows:
        for k in range(4):
            r, want = got[i, k + 1], float((np.array(x) - mean) @ columns[:, k] / np.sqrt(values[k]))
            sides.setdefault(k, np.sign(r.whitened * want))
            assert r.whitened == pytest.approx(sides[k] * want, abs=1e-8)
            assert (r.n, r.deviation) == (n, sum((n * c - s) ** 2 for c, s in zip(x, sums)))
            assert r.explained == pytest.approx(values[k] / trace, rel=1e-10) and r.identity_error < 1e-9


@pytest.mark.parametrize("dims", [1, 3, 24])
def test_updates_and_merges(dims):
    """Rank-one updates and a merge give the scatter's spectrum, equal and dependent columns included."""
    rng = np.random.default_rng(dims)
    rows = np.floor(rng.standard_normal((120, dims)) * 50)
    rows[30:50] = rows[0]
    rows[:, -1] = rows[:, 0]
    parts = [W.Spectrum.empty(dims) for _ in range(3)]
    for i, row in enumerate(rows[:119]):
        parts[i % 2].add(row)
    parts[2].add(rows[119])
    parts[0].combine(parts[1])
    parts[0].combine(parts[2])
    away = rows - rows.mean(0)
    scatter = away.T @ away
    got = parts[0]
    assert np.allclose(got.u @ np.diag(got.d) @ got.u.T, scatter, atol=1e-10 * np.abs(scatter).max())
    assert np.allclose(got.u.T @ got.u, np.eye(dims), atol=1e-12)


def test_defined_results(spark):
    vecs = [(1, [0.5, 0.0]), (1, [0.5, 0.0]), (None, [0.25, 1.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 0.0]), (6, [float("inf"), 0.0]),
            (7, []), (8, [1.0]), (9, [-0.001, 0.3]), (10, [1e30, -1e30])]
    df = spark.createDataFrame([(i, v, "x") for i, v in vecs], "vec_id long, embedding array<double>, component string")
    model = W.fit_whitening(df.where("coalesce(vec_id, 0) < 10"))
    out = W.whiten(df, model).collect()
    assert len(out) == 10
    assert {r.vec_id for r in out} == {1, None, 9, 10} and all(r.n == 3 for r in out)
    assert all((r.deviation is None) == (r.vec_id == 10) for r in out)
    for rows in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        one = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        assert W.whiten(one, W.fit_whitening(one)).collect() == []
