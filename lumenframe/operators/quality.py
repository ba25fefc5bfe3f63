"""Validation rules, drift between two tables, target leakage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lumenframe.functions.columns import col, is_missing, is_numeric, number, numeric_columns, to_number
from lumenframe.operators.hypothesis import ks_two_sample
from lumenframe.operators.quantiles import column_quantiles
from lumenframe.operators.ranks import lookup, value_ranks


def violates(df: DataFrame, rule: Mapping) -> Column | None:
    """Does a row break the rule? Null for a column the table does not have."""
    name, kind, params = rule["column"], rule["rule_type"], rule.get("params", {})
    if name not in df.columns:
        return None
    c = col(name)
    if kind == "not_null":
        return is_missing(df, name)
    if kind == "min_value":
        return F.coalesce(to_number(c) < float(params.get("min", 0.0)), F.lit(False))
    if kind == "max_value":
        return F.coalesce(to_number(c) > float(params.get("max", 1_000_000.0)), F.lit(False))
    if kind == "allowed_values":
        return F.coalesce(~c.cast("string").isin([str(v) for v in params.get("allowed", [])]), F.lit(False))
    if kind == "regex":
        return F.coalesce(~c.cast("string").rlike(params["pattern"]), F.lit(False))
    raise ValueError(f"unknown rule: {kind}")


def evaluate_rules(df: DataFrame, rules: Sequence[Mapping]) -> DataFrame:
    """One row per rule: violations, percent, passed. All rules are counted in one aggregate."""
    tests = [violates(df, r) for r in rules]
    row = df.agg(F.count(F.lit(1)), *[F.count_if(t) for t in tests if t is not None]).first()
    total, counts = row[0], iter(row[1:])
    out = []
    for i, (rule, test) in enumerate(zip(rules, tests)):
        broken = total if test is None else next(counts)
        pct = 100.0 if test is None else (100.0 * broken / total if total else 0.0)
        out.append((i + 1, rule["column"], rule["rule_type"], broken, pct, test is not None and broken == 0))
    return df.sparkSession.createDataFrame(
        out, "rule int, column string, rule_type string, violations long, violation_pct double, passed boolean")


def rule_pass_rate(results: DataFrame) -> DataFrame:
    return results.agg(F.count(F.lit(1)).alias("rules"), F.count_if("passed").alias("passed"),
                       (F.count_if("passed") * 100.0 / F.greatest(F.lit(1), F.count(F.lit(1)))).alias("pass_rate"))


def drift_ks(baseline: DataFrame, current: DataFrame, columns: Sequence[str] | None = None,
             p_threshold: float = 0.05) -> DataFrame:
    """Two-sample distance per shared numeric column with more than ten values on both sides."""
    shared = [c for c in (columns or numeric_columns(baseline))
              if c in numeric_columns(baseline) and c in numeric_columns(current)]
    if not shared:
        raise ValueError("the tables share no numeric column")
    both = baseline.select(F.lit(True).alias("__old"), *[number(baseline, c).alias(c) for c in shared]).unionByName(
        current.select(F.lit(False).alias("__old"), *[number(current, c).alias(c) for c in shared]))
    out = None
    for c in shared:
        old, new = F.when(F.col("__old"), col(c)), F.when(~F.col("__old"), col(c))
        means = both.agg(F.avg(old).alias("a"), F.avg(new).alias("b"))
        one = ks_two_sample(both, old, new).where("n1 > 10 and n2 > 10").select(
            F.lit(c).alias("feature"), F.col("statistic").alias("ks_statistic"), "p_value",
            (F.col("p_value") < p_threshold).alias("has_drift"),
            means.select("a").scalar().alias("baseline_mean"), means.select("b").scalar().alias("current_mean"))
        out = one if out is None else out.unionByName(one)
    return out


def psi(baseline: DataFrame, current: DataFrame, column: str, buckets: int = 10, floor: float = 1e-4) -> DataFrame:
    """Population stability: shares per baseline quantile bucket and their contribution to the index."""
    probs = [i / buckets for i in range(1, buckets)]
    edges = sorted(set(column_quantiles(baseline, [column], probs)[column]))

    def shares(df: DataFrame, name: str) -> DataFrame:
        v = number(df, column)
        bucket = sum(((v > F.lit(e)).cast("int") for e in edges), F.lit(0))
        known = df.where(v.isNotNull())
        total = known.agg(F.count(F.lit(1))).scalar()
        return known.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).select(
            "bucket", (F.col("n") / total).alias(name))

    spine = baseline.sparkSession.range(len(edges) + 1).select(F.col("id").cast("int").alias("bucket"))
    joined = spine.join(F.broadcast(shares(baseline, "expected")), "bucket", "left").join(
        F.broadcast(shares(current, "actual")), "bucket", "left").fillna(0.0)
    e, a = F.greatest("expected", F.lit(floor)), F.greatest("actual", F.lit(floor))
    return joined.select("bucket", "expected", "actual", ((a - e) * F.ln(a / e)).alias("psi"))


def target_leakage(df: DataFrame, target: str, limit: float = 0.98) -> DataFrame:
    """Numeric columns equal to the target or correlated with it at 0.98 or more.

    A text target is numbered in the sorted order of its values.
    """
    names = [c for c in numeric_columns(df) if c != target]
    if not names:
        raise ValueError("the table has no numeric column beside the target")
    if is_numeric(df, target):
        rows, y = df, F.coalesce(number(df, target), F.lit(0.0))
    else:
        named = df.withColumn("__label", col(target).cast("string"))
        rows = lookup(named, value_ranks(named, "__label"), ["__label"], ["__dense"], "__n")
        y = (F.col("__dense") - 1).cast("double")
    exprs = []
    for i, c in enumerate(names):
        v = number(rows, c)
        exprs += [F.corr(v, y).alias(f"r{i}"), F.count_if(~v.eqNullSafe(y)).alias(f"d{i}"),
                  F.coalesce(F.max(v) > F.min(v), F.lit(False)).alias(f"v{i}")]
    row = rows.agg(*exprs).first()
    out = []
    for i, c in enumerate(names):
        same = row[f"d{i}"] == 0 and row[f"v{i}"]
        r = row[f"r{i}"]
        out.append((c, r, bool(same), bool(same or (r is not None and abs(r) >= limit))))
    return df.sparkSession.createDataFrame(out, "feature string, r double, identical boolean, leaks boolean")
