"""Imputation, outlier handling, text clean-up and the automatic clean-up."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lumenframe.functions.columns import (
    col, is_missing, is_numeric, is_text, normalise_missing, number, numeric_columns, time_columns)
from lumenframe.functions.text import strip, title
from lumenframe.operators.ordered import fill, interpolate
from lumenframe.operators.profile import constant_columns, modes, value_facts, wide_facts
from lumenframe.operators.quantiles import column_quantiles
from lumenframe.operators.sets import dedup
from lumenframe.session import ensure_checkpoint_dir

CHANGELOG = "step string, column string, affected long, detail string"
ORDERED = {"ffill": "forward", "bfill": "backward"}


def _log(df: DataFrame, rows: Sequence[tuple]) -> DataFrame:
    return df.sparkSession.createDataFrame(list(rows), CHANGELOG)


def recommended_strategies(df: DataFrame, facts: Mapping[str, dict] | None = None) -> dict[str, str]:
    """Per column with gaps: median, or mode for few values and little skew; ffill for times; else mode."""
    rows, wide = wide_facts(df) if facts is None else (0, facts)
    gaps = [c for c in df.columns if wide[c]["missing"]]
    unique = value_facts(df, [c for c in gaps if is_numeric(df, c)])
    out = {}
    for c in gaps:
        if is_numeric(df, c):
            few = unique[c]["unique"] < 10 and abs(wide[c]["skew"] or 0.0) <= 1
            out[c] = "mode" if few else "median"
        else:
            out[c] = "ffill" if c in time_columns(df) else "mode"
    return out


def impute(df: DataFrame, strategies: Mapping[str, str] | None = None, constants: Mapping[str, object] | None = None,
           order_by=None, partition_by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Fill gaps per column; returns the table and a changelog table.

    Strategies: mean, median, mode, constant, ffill, bfill, interpolate, drop_row, drop_col, auto.
    All statistics come from the input in a fixed number of passes. The order-dependent
    ones need ``order_by`` ending in a unique key. For neighbours see ``operators.neighbours``.
    """
    rows, wide = wide_facts(df)
    plan = dict(strategies) if strategies is not None else {c: "auto" for c in df.columns}
    if "auto" in plan.values():
        advice = recommended_strategies(df, wide)
        plan = {c: (advice.get(c, "none") if s == "auto" else s) for c, s in plan.items()}
    plan = {c: s for c, s in plan.items() if c in df.columns and wide[c]["missing"]}
    if order_by is None and any(s in ("ffill", "bfill", "interpolate") for s in plan.values()):
        raise ValueError("ffill, bfill and interpolate need order_by")
    for c, s in plan.items():
        if s in ("mean", "median", "interpolate") and not is_numeric(df, c):
            raise ValueError(f"{s} needs a numeric column, {c} is not")
    medians = column_quantiles(df, [c for c, s in plan.items() if s == "median"], [0.5])
    frequent = modes(df, [c for c, s in plan.items() if s == "mode"])
    fills: dict[str, object] = {}
    for c, s in plan.items():
        if s == "mean":
            fills[c] = wide[c]["mean"]
        elif s == "median":
            fills[c] = medians[c][0]
        elif s == "mode":
            fills[c] = "Unknown" if frequent[c] is None and is_text(df, c) else frequent[c]
        elif s == "constant":
            fills[c] = (constants or {}).get(c, "Missing")
    out = normalise_missing(df)
    dropped = [c for c, s in plan.items() if s == "drop_row"]
    if dropped:
        out = out.dropna(subset=dropped)
    out = out.select(*[_filled(out, c, fills) for c in out.columns if plan.get(c) != "drop_col"])
    by_order = {c: (c, ORDERED[s]) for c, s in plan.items() if s in ORDERED}
    if by_order:
        out = fill(out, by_order, order_by, partition_by)
    lines = [c for c, s in plan.items() if s == "interpolate"]
    if lines:
        out = interpolate(out, lines, order_by, partition_by)
    log = [("impute", c, wide[c]["missing"], f"{s}: {fills[c]}" if c in fills else s) for c, s in plan.items()]
    return out, _log(df, log)


def _filled(df: DataFrame, name: str, fills: Mapping[str, object]) -> Column:
    if name not in fills:
        return col(name)
    value, kind = fills[name], df.schema[name].dataType
    if is_numeric(df, name) and isinstance(value, float) and not value.is_integer():
        return F.coalesce(col(name).cast("double"), F.lit(value)).alias(name)
    return F.coalesce(col(name), F.lit(value).cast(kind)).alias(name)


def outlier_bounds(df: DataFrame, columns: Sequence[str], method: str = "iqr", factor: float = 1.5,
                   z: float = 3.0) -> dict[str, tuple[float, float]]:
    """Limits per column from iqr, z_score or modified_z_score; columns with under five values are left out."""
    rows, wide = wide_facts(df.select(*[col(c) for c in columns])) if columns else (0, {})
    usable = [c for c in columns if is_numeric(df, c) and rows - wide[c]["missing"] >= 5]
    if method == "iqr":
        return {c: (a - factor * (b - a), b + factor * (b - a))
                for c, (a, b) in column_quantiles(df, usable, [0.25, 0.75]).items()}
    if method == "z_score":
        return {c: (wide[c]["mean"] - z * wide[c]["std"], wide[c]["mean"] + z * wide[c]["std"])
                for c in usable if wide[c]["std"]}
    if method != "modified_z_score":
        raise ValueError(f"unknown outlier method: {method}")
    middle = {c: q[0] for c, q in column_quantiles(df, usable, [0.5]).items()}
    spread = column_quantiles(df.select(*[F.abs(number(df, c) - middle[c]).alias(c) for c in usable]), usable, [0.5])
    return {c: (middle[c] - 3.5 * q[0] / 0.6745, middle[c] + 3.5 * q[0] / 0.6745) for c, q in spread.items() if q[0]}


def apply_bounds(df: DataFrame, bounds: Mapping[str, tuple[float, float]], action: str = "cap") -> DataFrame:
    """cap (clip), remove (null rows stay), set_nan (null) or keep."""
    if action == "keep" or not bounds:
        return df
    if action == "remove":
        for c, (lo, hi) in bounds.items():
            df = df.where(F.coalesce(number(df, c).between(lo, hi), F.lit(True)))
        return df

    def changed(c: str) -> Column:
        v, (lo, hi) = number(df, c), bounds[c]
        if action == "cap":
            return F.when(v < lo, F.lit(lo)).when(v > hi, F.lit(hi)).otherwise(v).alias(c)
        if action == "set_nan":
            return F.when(v.between(lo, hi), col(c)).alias(c)
        raise ValueError(f"unknown action: {action}")

    return df.select(*[changed(c) if c in bounds else col(c) for c in df.columns])


def handle_outliers(df: DataFrame, columns: Sequence[str] | None = None, method: str = "iqr", action: str = "cap",
                    factor: float = 1.5, z: float = 3.0, sequential: bool = False) -> tuple[DataFrame, DataFrame]:
    """Outliers per column; returns the table and a changelog.

    Bounds of all columns come from the input, so the column order does not matter; with
    ``sequential`` each column sees the rows the earlier ones left.
    """
    columns = list(columns) if columns is not None else numeric_columns(df)
    steps = [[c] for c in columns] if sequential else [columns]
    out, log = df, []
    for step in steps:
        bounds = outlier_bounds(out, step, method, factor, z)
        if bounds:
            counts = out.agg(*[F.count_if((number(out, c) < lo) | (number(out, c) > hi))
                               for c, (lo, hi) in bounds.items()]).first()
            hit = {c: b for (c, b), n in zip(bounds.items(), counts) if n}
            log += [(f"outliers_{action}", c, n, f"{method}: {b[0]:.4g} to {b[1]:.4g}")
                    for (c, b), n in zip(bounds.items(), counts) if n]
            out = apply_bounds(out, hit, action)
    return out, _log(df, log)


def standardize_text(df: DataFrame, dedup_rows: bool = True, keep: str = "first", trim: bool = True,
                     case: str = "keep", remove_special: bool = False, replace: Mapping[str, str] | None = None,
                     regex: tuple[str, str] | None = None) -> DataFrame:
    """Full-row dedup, then trim, case, special characters, value and pattern replacement on text columns."""
    out = dedup(normalise_missing(df), keep) if dedup_rows else df
    cases: dict[str, Callable[[Column], Column]] = {"lower": F.lower, "upper": F.upper, "title": title,
                                                   "keep": lambda c: c}
    if case not in cases:
        raise ValueError(f"unknown case: {case}")

    def tidy(name: str) -> Column:
        c = strip(col(name)) if trim else col(name)
        c = cases[case](c)
        if remove_special:
            c = F.regexp_replace(c, r"[^a-zA-Z0-9\s]", "")
        if replace:
            table = F.create_map(*[F.lit(x) for pair in replace.items() for x in pair])
            c = F.coalesce(F.try_element_at(table, c), c)
        if regex:
            c = F.regexp_replace(c, regex[0], regex[1])
        return c.alias(name)

    return out.select(*[tidy(c) if is_text(out, c) else col(c) for c in out.columns])


def auto_clean(df: DataFrame, order_by=None) -> tuple[DataFrame, DataFrame]:
    """Dedup and trim, drop constant columns, impute as recommended, cap at 2.5 IQR."""
    # Written once: each statistic would fold the repeated rows again.
    ensure_checkpoint_dir(df.sparkSession)
    tidy = standardize_text(df).checkpoint()
    constant = constant_columns(tidy)
    kept = tidy.drop(*constant)
    filled, filled_log = impute(kept, order_by=order_by)
    capped, capped_log = handle_outliers(filled, method="iqr", action="cap", factor=2.5)
    dropped = _log(df, [("drop_constant", c, 0, "single value") for c in constant])
    return capped, dropped.unionByName(filled_log).unionByName(capped_log)


# Texts that mean missing.
MISSING_TEXT = ["nan", "None", "", "null"]


def clean_for_models(df: DataFrame, target: str, drop: Sequence[str] = ()) -> DataFrame:
    """Rows with a target, without id and constant columns; missing texts and infinities become null."""
    out = df.where(~is_missing(df, target)).drop(*[c for c in drop if c != target])

    def tidy(name: str) -> Column:
        c = col(name)
        if name == target:
            return c
        if is_text(out, name):
            return F.when(~strip(c).isin(MISSING_TEXT), strip(c)).alias(name)
        if is_numeric(out, name):
            v = number(out, name)
            return F.when(F.abs(v) < F.lit(float("inf")), c).alias(name)
        return c

    return out.select(*[tidy(c) for c in out.columns])


def impute_for_models(df: DataFrame, target: str, flag_above: float = 0.08) -> DataFrame:
    """Median, with a ``_was_missing`` flag above 8 % gaps; mode or "Missing" for the rest."""
    rows, wide = wide_facts(df)
    gaps = [c for c in df.columns if c != target and wide[c]["missing"]]
    medians = column_quantiles(df, [c for c in gaps if is_numeric(df, c)], [0.5])
    frequent = modes(df, [c for c in gaps if not is_numeric(df, c)])
    flags = [is_missing(df, c).cast("double").alias(f"{c}_was_missing") for c in gaps
             if c in medians and wide[c]["missing"] / rows > flag_above]
    fills = {c: (q[0] if q[0] is not None else 0.0) for c, q in medians.items()}
    fills |= {c: ("Missing" if v is None and is_text(df, c) else v) for c, v in frequent.items()}
    clean = normalise_missing(df)
    return clean.select(*[_filled(clean, c, fills) for c in clean.columns], *flags)


class Steps:
    """Named cleaning steps; ``run`` gives the table and a log of rows in and out per step.

    Undo is a run without the last step: the plan is rebuilt, nothing is stored.
    """

    def __init__(self, steps: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]] = ()):
        self.steps = list(steps)

    def add(self, name: str, fn: Callable[[DataFrame], DataFrame]) -> Steps:
        return Steps([*self.steps, (name, fn)])

    def undo(self) -> Steps:
        return Steps(self.steps[:-1])

    def run(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        out, log, before = df, [], df.count()
        for i, (name, fn) in enumerate(self.steps):
            out = fn(out)
            after = out.count()
            log.append((i + 1, name, before, after))
            before = after
        return out, df.sparkSession.createDataFrame(log, "position int, step string, rows_in long, rows_out long")


