import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from callytics.llm import eigen, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(seed, n, d):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) * np.linspace(1, 0.05, d)).astype(np.float32)


@pytest.mark.parametrize("kind", ["random", "equal", "zero", "blocks", "one", "two", "near", "graded"])
def test_eigen_against_a_library(kind):
    rng = np.random.default_rng(3)
    n = {"one": 1, "two": 2}.get(kind, 50)
    q, _ = np.linalg.qr(rng.normal(size=(n, n)))
    values = {
        "equal": np.full(n, 7.0), "zero": np.zeros(n), "near": 1 + 1e-9 * np.arange(n), "graded": 10.0 ** -np.arange(0, 10, 0.2),
        "blocks": np.repeat([5.0, 5.0, 3.0, 1.0, 0.0], 10),
    }.get(kind, rng.uniform(0, 9, n))
    matrix = np.diag(values) if kind == "blocks" else (q * values) @ q.T
    matrix = (matrix + matrix.T) / 2
    found, columns = eigen.leading(matrix, 16)
    want = np.linalg.eigvalsh(matrix)[::-1][:16]
    scale = max(np.abs(want).max(), 1e-300)
    assert np.allclose(found, want, rtol=0, atol=1e-13 * scale)
    assert np.allclose(columns.T @ columns, np.eye(len(want)), atol=1e-12)
    assert np.abs(matrix @ columns - columns * found).max() <= 1e-13 * n * scale


def test_sturm_counts():
    rng = np.random.default_rng(1)
    diagonal, second = rng.normal(size=30), rng.normal(size=29)
    values = np.linalg.eigvalsh(np.diag(diagonal) + np.diag(second, 1) + np.diag(second, -1))
    x = rng.uniform(-4, 4, 50)
    assert (eigen.below(diagonal, second, x) == (values[None, :] < x[:, None]).sum(axis=1)).all()


def reference(rows):
    """By Python's whole numbers and a library's eigenvectors."""
    kept = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in e]) for i, e in rows if e is not None and all(c is not None and math.isfinite(c) for c in e)]
    different = sorted({tuple(x) for _, x in kept})
    n, sums = len(different), [sum(c) for c in zip(*different)]
    deviation = [(i, sum((n * c - s) ** 2 for c, s in zip(x, sums))) for i, x in kept]
    centred = np.array([[c - s / n for c, s in zip(x, sums)] for x in different])
    values, columns = np.linalg.eigh(centred.T @ centred / n)
    return kept, n, sums, deviation, values[::-1], columns[:, ::-1]


def test_whole_result(spark):
    data = vectors(5, 400, 24)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(data)]
    rows += [(1000 + i, rows[7][1]) for i in range(90)] + [(7, rows[7][1]), (None, rows[3][1])]
    broken = [(2000, None), (2001, [None] + rows[0][1][1:]), (2002, [math.nan] + rows[0][1][1:]), (2003, [math.inf] + rows[0][1][1:]), (2004, [])]
    table = spark.createDataFrame([(i, e, 1) for i, e in rows + broken], SCHEMA)
    clash = table.withColumns({"x": F.lit("x"), "whitened": F.lit(1), "component": F.lit(2), "n": F.lit(3), "e": F.lit(4)})
    model = whitening.fit(clash)
    out = whitening.components(clash, model).collect()
    kept, n, sums, deviation, values, columns = reference(rows)
    assert model.centre.n == n == 400 and len(out) == 16 * len(rows) and model.identity_error < 1e-9
    key = lambda i: -1 if i is None else i
    assert sorted({(key(r["vec_id"]), r["deviation"]) for r in out}) == sorted({(key(i), v) for i, v in deviation})
    by = {(r["vec_id"], r["component"]): r for r in out}
    for c in range(16):
        sign = np.sign(columns[:, c] @ model.vectors[:, c])
        assert abs(by[0, c + 1]["explained"] / (values[c] / values.sum()) - 1) < 1e-10
        for i, x in kept[::37]:
            centred = np.array([a - s / n for a, s in zip(x, sums)])
            assert abs(by[i, c + 1]["whitened"] - sign * (centred @ columns[:, c]) / math.sqrt(values[c])) < 1e-8


def test_few_dimensions_dependent_ones_and_one_vector(spark):
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0], 0) for i in range(10)], SCHEMA)
    model = whitening.fit(flat)
    out = whitening.components(flat, model).collect()
    assert len(model.values) == 1 and {r["component"] for r in out} == {1} and abs(out[0]["explained"] - 1) < 1e-12
    assert model.identity_error < 1e-9
    same = spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(5)], SCHEMA)
    model = whitening.fit(same)
    assert len(model.values) == 0 and whitening.components(same, model).collect() == []
    assert [int(r["deviation"]) for r in whitening.project(same, model).collect()] == [0] * 5


def test_other_widths_and_empty_tables(spark):
    rows = [(i, [float(i % 7), float(i * i % 11)], 0) for i in range(30)] + [(100, [1.0], 0), (101, [1.0, 2.0, 3.0], 0), (102, [1e30, 0.0], 0)]
    table = spark.createDataFrame(rows, SCHEMA)
    out = whitening.components(table, whitening.fit(table)).collect()
    assert {r["vec_id"] for r in out} == set(range(30)) and len(out) == 60
    for empty in ([], [(1, None, 0)]):
        table = spark.createDataFrame(empty, SCHEMA)
        model = whitening.fit(table)
        assert model is None and whitening.components(table, model).collect() == []


def test_deviations_beyond_a_long():
    x = np.array([[10**15, 5], [-(10**15), 7]], np.int64)
    centre = whitening.Centre.of(3, [4, 5])
    want = [sum((3 * int(c) - s) ** 2 for c, s in zip(row, (4, 5))) for row in x]
    assert [int(v) for v in centre.deviations(x).to_pylist()] == want and max(want) > 2**63
    small = np.array([[3, -2]], np.int64)
    assert [int(v) for v in centre.deviations(small).to_pylist()] == [(9 - 4) ** 2 + (-6 - 5) ** 2]


def test_a_far_mean_costs_no_digits(spark):
    """Spread of a few steps about a mean of a million million."""
    rng = np.random.default_rng(2)
    data = 2.0**34 + rng.integers(0, 9, (500, 4)) / 64
    table = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    model = whitening.fit(table)
    x = np.unique(np.floor(64 * data).astype(np.int64), axis=0)
    centred = (x - x.min(axis=0)) - (x - x.min(axis=0)).mean(axis=0)
    assert np.allclose(model.values, np.linalg.eigvalsh(centred.T @ centred / len(x))[::-1], rtol=1e-10)
