"""Linear support vector regression against gradient descent, its derivatives, and edges."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from lumenframe.operators import models as md
from lumenframe.operators.svr import LinearSVR


def table(spark, x, y):
    names = [f"c{j}" for j in range(x.shape[1])]
    df = spark.createDataFrame([(*map(float, r), None if v is None else float(v)) for r, v in zip(x, y)], ", ".join(f"{c} double" for c in names) + ", label double")
    return VectorAssembler(inputCols=names, outputCol="features").transform(df)


def objective(w, b, x, y, c, e):
    return w @ w / 2 + c * (np.maximum(np.abs(y - x @ w - b) - e, 0) ** 2).sum()


def descent(x, y, c, e):
    """Plain gradient descent with halved steps: slow and independent of the learner."""
    theta, step = np.zeros(x.shape[1] + 1), 1.0
    for _ in range(20_000):
        r = y - x @ theta[:-1] - theta[-1]
        g = 2 * c * np.sign(r) * np.maximum(np.abs(r) - e, 0)
        slope = np.append(theta[:-1] - x.T @ g, -g.sum())
        now = objective(theta[:-1], theta[-1], x, y, c, e)
        while step > 1e-18 and objective((theta - step * slope)[:-1], (theta - step * slope)[-1], x, y, c, e) > now - step * slope @ slope / 2:
            step /= 2
        theta, step = theta - step * slope, step * 2
    return theta


@pytest.mark.parametrize("cost,epsilon", [(1.0, 0.1), (0.05, 1.5), (3.0, 0.0)])
def test_equals_gradient_descent(spark, cost, epsilon):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (120, 3))
    y = x @ [2.0, -1.0, 0.0] + 4 + rng.standard_t(2, 120)
    model = LinearSVR(cost=cost, epsilon=epsilon).fit(table(spark, x, y))
    want = descent(x, y, cost, epsilon)
    assert np.allclose([*model.coefficients, model.intercept], want, atol=2e-4)
    assert objective(np.array(model.coefficients), model.intercept, x, y, cost, epsilon) <= objective(want[:-1], want[-1], x, y, cost, epsilon) * (1 + 1e-9) + 1e-9


def test_edges(spark):
    x = np.arange(10.0).reshape(-1, 1)
    flat = LinearSVR().fit(table(spark, x, [3.0] * 10))
    assert abs(flat.coefficients[0]) < 1e-9 and abs(flat.intercept - 3) <= 0.1 + 1e-9
    gaps = LinearSVR().fit(table(spark, np.vstack([x, x]), [*(2 * x[:, 0]), *[None] * 10]))
    whole = LinearSVR().fit(table(spark, x, 2 * x[:, 0]))
    assert abs(gaps.coefficients[0] - whole.coefficients[0]) < 1e-9
    with pytest.raises(ValueError):
        LinearSVR().fit(table(spark, x, [None] * 10))
    with pytest.raises(ValueError):
        LinearSVR(cost=0.0)


def test_a_row_of_the_board(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, float(v), "ab"[i % 2], float(3 * v + i % 2)) for i, v in enumerate(rng.normal(0, 5, 500))], "id int, v double, t string, y double")
    out = md.train(df, "y", "linear_svr", ["id"], ["v", "t"], settings={"epsilon": 0.01})
    assert out.metrics["r2"] > 0.999 and out.predictions.where(F.col("prediction").isNull()).count() == 0
    assert out.model.stages[-1].numFeatures >= 2
