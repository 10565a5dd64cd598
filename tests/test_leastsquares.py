"""Least squares by QR against numpy: nearly collinear columns, large means, groups with columns of their own, too few rows."""

import numpy as np
import pytest

from tidemark.operators import leastsquares as L


def normal_equations(x, y):
    return np.linalg.solve(x.T @ x, x.T @ y)


def test_nearly_collinear_columns_keep_their_digits(spark):
    """Columns that differ by 1e-6 around a mean of 1e4: sums of products lose more than six digits, the triangle does not."""
    draw = np.random.default_rng(4)
    a = 1e4 + draw.normal(size=5000)
    b = a + 1e-6 * draw.normal(size=5000)
    y = 3 + 2 * a - 1 * b
    rows = spark.createDataFrame(np.column_stack((a, b, y)).tolist(), "a double, b double, y double").repartition(7)
    got = {r.term: r.beta for r in L.regression(rows, "y", ["a", "b"]).collect()}
    x = np.column_stack((np.ones(5000), a, b))
    want = np.linalg.lstsq(x, y, rcond=1e-16)[0]
    error = abs(got["b"] + 1)
    assert error < 1e-3 and abs(want[2] + 1) < 1e-3
    try:
        squared = abs(normal_equations(x, y)[2] + 1)
    except np.linalg.LinAlgError:
        squared = np.inf
    assert squared > 1e6 * max(error, 1e-9) or squared > 0.1


def test_groups_have_their_own_columns(spark):
    draw = np.random.default_rng(6)
    rows, data = [], {}
    for group, known in (("one", [0, 1]), ("two", [1]), ("few", [0]), (None, [0, 1])):
        n = 2 if group == "few" else 300
        x = draw.normal(5, 2, (n, 2))
        y = 0.5 + x[:, known] @ np.arange(1, len(known) + 1) + draw.normal(0, 0.1, n)
        data[group or ""] = x[:, known], y, known
        rows += [(group, *[float(v) if j in known else None for j, v in enumerate(r)], float(t), "z") for r, t in zip(x, y, strict=True)]
    rows.append(("one", 1.0, 1.0, None, "z"))
    frame = spark.createDataFrame(rows, "leg string, `a.b` double, c double, y double, n string").repartition(5)
    got = L.regression(frame, "y", ["a.b", "c"], by="leg").toPandas()
    assert set(got.leg) == {"one", "two", ""}
    for leg in ("one", "two", ""):
        x, y, known = data[leg]
        full = np.column_stack((np.ones(len(x)), x))
        beta, left, *_ = np.linalg.lstsq(full, y, rcond=None)
        of = got[got.leg == leg].set_index("term")
        assert list(of.index) == ["alpha", *[["a.b", "c"][j] for j in known]]
        np.testing.assert_allclose(of.beta, beta, rtol=1e-9)
        error = np.sqrt(np.diag(np.linalg.inv(full.T @ full)) * left[0] / (len(y) - len(beta)))
        np.testing.assert_allclose(of.t, beta / error, rtol=1e-7)
        assert of.r2.iloc[0] == pytest.approx(1 - left[0] / ((y - y.mean()) ** 2).sum(), rel=1e-9)
        np.testing.assert_allclose(of.contribution, beta * full.mean(0) * 252, rtol=1e-9)


def test_nothing_constant_and_singular(spark):
    kind = "a double, b double, y double"
    assert L.regression(spark.createDataFrame([], kind), "y", ["a", "b"]).count() == 0
    flat = L.regression(spark.createDataFrame([(float(k), 2.0 * k, 7.0) for k in range(9)], kind), "y", ["a", "b"]).toPandas().set_index("term")
    assert flat.beta["alpha"] == pytest.approx(7) and abs(flat.beta["a"]) < 1e-9 and abs(flat.beta["b"]) < 1e-9


def test_triangles_are_merged_in_a_tree(spark):
    """Each task leaves one small row a group, merged in two steps, none of which holds all of them for many tasks."""
    draw = np.random.default_rng(2)
    rows = spark.createDataFrame(draw.normal(size=(3000, 2)).tolist(), "x double, y double").repartition(40)
    plan = L.triangles(rows, "y", ["x"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 2 and plan.count("MapInArrow") == 3
    got = L.triangles(rows, "y", ["x"]).collect()
    assert len(got) == 1 and got[0].n == 3000 and len(got[0].r) == 9 * 8
