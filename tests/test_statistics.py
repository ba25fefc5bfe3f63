"""Distribution functions, tests and regression against closed forms and a reference library in the JVM."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import dist
from lumenframe.operators import correlation as co, describe as de, experiments as ex, hypothesis as hy, quality as ql, regression as rg


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first()[0]


def test_distributions_match_the_jvm_library(spark):
    d = spark._jvm.org.apache.commons.math3.distribution
    for t, df in ((0.3, 4.0), (2.2, 7.5), (-5.0, 300.0)):
        expected = 2 * (1 - d.TDistribution(df).cumulativeProbability(abs(t)))
        assert one(spark, dist.t_two_sided(F.lit(t), F.lit(df))) == pytest.approx(expected, rel=1e-8, abs=1e-14)
        assert one(spark, dist.t_ppf(0.975, F.lit(df))) == pytest.approx(d.TDistribution(df).inverseCumulativeProbability(0.975), rel=1e-7)
    for f, a, b in ((0.5, 3.0, 20.0), (4.0, 2.0, 1000.0)):
        expected = 1 - d.FDistribution(a, b).cumulativeProbability(f)
        assert one(spark, dist.f_upper(F.lit(f), F.lit(a), F.lit(b))) == pytest.approx(expected, rel=1e-8)
    for x, k in ((0.1, 1.0), (30.0, 10.0), (900.0, 1000.0)):
        expected = 1 - d.ChiSquaredDistribution(k).cumulativeProbability(x)
        assert one(spark, dist.chi2_upper(F.lit(x), F.lit(k))) == pytest.approx(expected, rel=1e-7)
    assert one(spark, dist.norm_cdf(F.lit(1.959963984540054))) == pytest.approx(0.975)
    assert one(spark, dist.norm_cdf(F.lit(None))) is None


def test_kendall_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    p = pd.DataFrame({"x": rng.integers(0, 25, 400), "y": rng.integers(0, 400, 400)})
    dx, dy = np.sign(p.x.values[:, None] - p.x.values), np.sign(p.y.values[:, None] - p.y.values)
    upper = np.triu_indices(400, 1)
    tau = (dx * dy)[upper].sum() / math.sqrt((dx[upper] != 0).sum() * (dy[upper] != 0).sum())
    assert co.kendall(spark.createDataFrame(p), "x", "y", rows_per_range=30).first().coefficient == pytest.approx(tau)
    assert co.spearman(spark.createDataFrame(p), "x", "y").first().coefficient == pytest.approx(p.x.rank().corr(p.y.rank()))


@pytest.mark.parametrize("ranges", [1, 2, 3, 7, 16])
def test_rising_cells_against_all_pairs(spark, ranges):
    rng = np.random.default_rng(ranges)
    cells = [(int(x), int(y), float(rng.integers(1, 9))) for x, y in itertools.product(range(ranges), repeat=2) if rng.random() < .6]
    want = sum(a[2] * b[2] for a in cells for b in cells if a[0] < b[0] and a[1] < b[1])
    got = co._across(spark.createDataFrame(cells, "bx int, by int, w double"), ranges).first()[0]
    assert (got or 0.0) == want


def test_kendall_of_a_line_has_few_cells(spark):
    """Rising values occupy a cell per range; all pairs agree."""
    line = spark.range(3_000).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y"))
    row = co.kendall(line, "x", "y", rows_per_range=100).first()
    assert (row.n, row.coefficient) == (3_000, 1.0)


def test_normality_and_moments(spark):
    rng = np.random.default_rng(6)
    p = pd.DataFrame({"n": rng.normal(5, 2, 800), "e": rng.exponential(1, 800)})
    df = spark.createDataFrame(p)
    normal, skewed = de.descriptive(df, "n").first(), de.descriptive(df, "e").first()
    assert normal.is_normal and not skewed.is_normal and skewed.normality_p < 1e-6
    assert normal.skewness == pytest.approx(p.n.skew()) and skewed.kurtosis == pytest.approx(p.e.kurt())
    assert de.numeric_summary(df).where("feature = 'n'").first()["shape"] == "Approximately Normal"


def test_ks_and_psi_see_a_shift(spark):
    a = spark.range(500).select(F.col("id").cast("double").alias("v"))
    b = a.select((F.col("v") + 150).alias("v"))
    row = ql.drift_ks(a, b).first()
    assert row.ks_statistic == pytest.approx(0.3) and row.has_drift
    assert not ql.drift_ks(a, a).first().has_drift
    assert ql.psi(a, a, "v").agg(F.sum("psi")).first()[0] == pytest.approx(0, abs=1e-9)
    assert ql.psi(a, b, "v").agg(F.sum("psi")).first()[0] > 0.25


def test_ols_recovers_a_plane(spark):
    rng = np.random.default_rng(7)
    p = pd.DataFrame({"a": rng.normal(size=300), "b": rng.normal(size=300)})
    p["y"] = 3 * p.a - 2 * p.b + 5 + rng.normal(0, .1, 300)
    fit = rg.ols(spark.createDataFrame(p), "y", ["a", "b"])
    design = np.c_[np.ones(300), p[["a", "b"]]]
    beta, rss = np.linalg.lstsq(design, p.y, rcond=None)[:2]
    got = {r.feature: r for r in fit.coefficients.collect()}
    assert got["a"].coefficient == pytest.approx(beta[1]) and got["b"].coefficient == pytest.approx(beta[2])
    errors = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * rss[0] / 297)
    assert got["a"].std_error == pytest.approx(errors[1]) and got["a"].p_value < 1e-12
    summary = fit.summary.first()
    assert summary.intercept == pytest.approx(beta[0]) and summary.rmse == pytest.approx(math.sqrt(rss[0] / 300))
    with pytest.raises(ValueError):
        rg.ols(spark.createDataFrame(p.head(4)), "y", ["a", "b"])


def arms(spark, a, b):
    rows = [("A", 1 if i < a[0] else 0) for i in range(a[1])] + [("B", 1 if i < b[0] else 0) for i in range(b[1])]
    return spark.createDataFrame(rows, "arm string, converted long")


def test_conversion_experiment(spark):
    row = ex.conversion_test(arms(spark, (100, 1000), (160, 1000)), "arm", "A", "B", "converted").first()
    assert row.difference == pytest.approx(0.06) and row.lift_pct == pytest.approx(60)
    assert row.p_value < 0.001 and row.power > 0.8 and row.ci_low > 0 and row.significant and row.winner == "treatment"
    even = ex.conversion_test(arms(spark, (20, 200), (21, 200)), "arm", "A", "B", "converted").first()
    assert even.p_value > 0.05 and even.winner == "inconclusive"
    assert ex.conversion_test(arms(spark, (2, 5), (3, 5)), "arm", "A", "B", "converted").isEmpty()


def test_text_conversions_and_extreme_rates(spark):
    rows = [("A", "Yes" if i < 12 else "no") for i in range(12)] + [("B", " converted ") for _ in range(12)]
    row = ex.conversion_test(spark.createDataFrame(rows, "arm string, c string"), "arm", "A", "B", "c").first()
    assert row.p_c == row.p_t == 1.0 and row.z == 0.0 and row.odds_ratio == 1.0


def test_mean_experiment_and_sample_size(spark):
    rng = np.random.default_rng(8)
    p = pd.DataFrame({"arm": ["c"] * 500 + ["t"] * 500, "v": np.r_[rng.normal(50, 10, 500), rng.normal(55, 10, 500)]})
    row = ex.mean_test(spark.createDataFrame(p), "arm", "c", "t", "v").first()
    assert row.significant and 0.3 < row.cohen_d < 0.7 and row.ci_low > 0
    base = spark.createDataFrame([(0.10, 100.0, 25.0)], "rate double, mean double, sd double")
    assert ex.required_size(base, "rate", 20).first().n_per_arm > 1000
    assert ex.required_size(base, "mean", 10, "mean", "sd").first().n_per_arm > 50


def test_rank_tests_with_ties(spark):
    df = spark.createDataFrame([("a", v) for v in (1., 2., 2., 3., 9.)] + [("b", v) for v in (2., 3., 4., 9., 10., 11.)], "g string, v double")
    row = hy.mann_whitney(df, "v", "g", ["a", "b"]).first()
    u = sum((x > y) + 0.5 * (x == y) for x in (1, 2, 2, 3, 9) for y in (2, 3, 4, 9, 10, 11))
    assert row.statistic == u
    pairs = spark.createDataFrame([(5., 3.), (2., 2.), (1., 4.), (8., 7.)], "a double, b double")
    assert hy.wilcoxon(pairs, "a", "b").first().statistic == 3.0
