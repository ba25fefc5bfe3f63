"""Linear support vector regression, solved as a row of ridge regressions.

The objective is |w|^2 / 2 + C * sum(max(0, |y - wx - b| - epsilon)^2). With the rows outside the tube
held fixed it is a ridge regression on those rows, with labels moved to the tube's edge: a Newton step.
Where that does not lower the objective, the step fits all rows to labels moved by the residual cut to the
tube, which bounds the objective from above and touches it at the last solution, so it never rises. Every
step is one LinearRegression of Spark, distributed and sparse as that is.
"""

from __future__ import annotations

from pyspark.ml import Estimator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.storagelevel import StorageLevel

# The widest vectors that the solver by normal equations takes.
NORMAL_SIZE = 4_096
TARGET, RESIDUAL, PREDICTION = "__svr_target", "__svr_residual", "__svr_prediction"


class LinearSVR(Estimator):
    """Squared epsilon-insensitive loss; the fitted model is Spark's LinearRegressionModel.

    ``tol`` is the relative fall of the objective at which it stops. Rows with a null label take no part;
    equal labels give that label as intercept; no rows raise ValueError.
    """

    cost = Param(Params._dummy(), "cost", "weight of the losses against the size of the weights", TypeConverters.toFloat)
    epsilon = Param(Params._dummy(), "epsilon", "half width of the tube without loss", TypeConverters.toFloat)
    maxIter = Param(Params._dummy(), "maxIter", "steps at most", TypeConverters.toInt)
    tol = Param(Params._dummy(), "tol", "relative fall of the objective to stop at", TypeConverters.toFloat)
    featuresCol = Param(Params._dummy(), "featuresCol", "vectors", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "numbers", TypeConverters.toString)

    def __init__(self, cost: float = 1.0, epsilon: float = 0.1, maxIter: int = 50, tol: float = 1e-10,
                 featuresCol: str = "features", labelCol: str = "label"):
        super().__init__()
        if cost <= 0 or epsilon < 0 or maxIter < 1:
            raise ValueError("cost must be above zero, epsilon not below it, and one step is needed")
        self._set(cost=cost, epsilon=epsilon, maxIter=maxIter, tol=tol, featuresCol=featuresCol, labelCol=labelCol)

    def _fit(self, dataset: DataFrame) -> LinearRegressionModel:
        c, eps, x = (self.getOrDefault(p) for p in ("cost", "epsilon", "featuresCol"))
        label = self.getOrDefault("labelCol")
        rows = dataset.select(F.col(x), F.col(label).cast("double").alias(label)).where(F.col(label).isNotNull()).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            n = rows.count()
            if n == 0:
                raise ValueError("no rows to learn from")

            normal = rows.first()[0].size <= NORMAL_SIZE
            deviation = F.stddev_pop if normal else F.stddev_samp

            def ridge(t: DataFrame, size: int) -> LinearRegressionModel:
                # LinearRegression divides the weights' penalty by the deviation of its labels.
                wide = t.agg(deviation(TARGET)).first()[0] or 1.0
                return LinearRegression(featuresCol=x, labelCol=TARGET, predictionCol=PREDICTION, regParam=wide / (2 * c * size), elasticNetParam=0.0,
                                        standardization=False, solver="normal" if normal else "l-bfgs", tol=1e-12, maxIter=500).fit(t)

            def outside(r: Column) -> Column:
                return F.greatest(F.abs(r) - eps, F.lit(0.0))

            def judged(model: LinearRegressionModel) -> tuple[DataFrame, float, int]:
                t = model.transform(rows).withColumn(RESIDUAL, F.col(label) - F.col(PREDICTION)).drop(PREDICTION)
                loss, active = t.agg(F.sum(outside(F.col(RESIDUAL)) ** 2), F.count_if(F.abs(F.col(RESIDUAL)) > eps)).first()
                return t, float(model.coefficients.squared_distance([0.0] * len(model.coefficients))) / 2 + c * loss, active

            best = ridge(rows.withColumn(TARGET, F.col(label)), n)
            seen, value, active = judged(best)
            r = F.col(RESIDUAL)
            for _ in range(self.getOrDefault("maxIter")):
                tries = [seen.withColumn(TARGET, F.col(label) - F.greatest(F.least(r, F.lit(eps)), F.lit(-eps)))]
                if active:
                    tries.insert(0, seen.where(F.abs(r) > eps).withColumn(TARGET, F.col(label) - F.signum(r) * eps))
                before = value
                for i, t in enumerate(tries):
                    model = ridge(t.drop(RESIDUAL), active if active and i == 0 else n)
                    state = judged(model)
                    if state[1] < value:
                        best, (seen, value, active) = model, state
                        break
                if before - value <= self.getOrDefault("tol") * max(abs(before), 1e-300):
                    break
        finally:
            rows.unpersist()
        return best.setPredictionCol("prediction")
