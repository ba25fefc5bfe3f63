"""Joins with table semantics: shared key names once, clashing columns suffixed, null keys equal."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lumenframe.functions.columns import col, require

KINDS = {"inner": "inner", "left": "left", "right": "right", "outer": "outer", "cross": "cross",
         "semi": "left_semi", "anti": "left_anti"}


def join(left: DataFrame, right: DataFrame, left_on: Sequence[str] | str = (), right_on: Sequence[str] | str | None = None,
         how: str = "inner", suffixes: tuple[str, str] = ("_x", "_y"), null_keys_match: bool = True) -> DataFrame:
    """Equi-join; the join strategy and skew handling are left to the optimizer.

    A key with the same name on both sides appears once (coalesced in right and outer joins);
    other shared names get the suffixes. ``cross`` takes no keys.
    """
    if how not in KINDS:
        raise ValueError(f"unknown join: {how}")
    lk = [left_on] if isinstance(left_on, str) else list(left_on)
    rk = lk if right_on is None else ([right_on] if isinstance(right_on, str) else list(right_on))
    require(left, lk)
    require(right, rk)
    if how == "cross":
        lk = rk = []
    elif not lk or len(lk) != len(rk):
        raise ValueError("give as many right keys as left keys, at least one")
    shared_keys = {a for a, b in zip(lk, rk) if a == b}
    clash = (set(left.columns) & set(right.columns)) - shared_keys
    a = left.withColumnsRenamed({c: c + suffixes[0] for c in clash})
    b = right.withColumnsRenamed({c: c + suffixes[1] for c in clash} | {c: f"__right_{c}" for c in shared_keys})
    if how == "cross":
        return a.crossJoin(b)
    if how in ("semi", "anti"):
        a, clash = left, set()
        b = right.select(*[col(k).alias(f"__right_{i}") for i, k in enumerate(rk)])
        return a.join(b, _equal([(col(x), F.col(f"__right_{i}")) for i, x in enumerate(lk)], null_keys_match), KINDS[how])

    def right_name(k: str) -> str:
        return f"__right_{k}" if k in shared_keys else (k + suffixes[1] if k in clash else k)

    pairs = [(col(x + suffixes[0] if x in clash else x), col(right_name(y))) for x, y in zip(lk, rk)]
    out = a.join(b, _equal(pairs, null_keys_match), KINDS[how])
    return out.select(*[
        F.coalesce(col(c), col(f"__right_{c}")).alias(c) if c in shared_keys and how in ("right", "outer") else col(c)
        for c in out.columns if not c.startswith("__right_")])


def _equal(pairs: Sequence[tuple[Column, Column]], null_keys_match: bool) -> Column:
    tests = [a.eqNullSafe(b) if null_keys_match else a == b for a, b in pairs]
    return functools.reduce(lambda x, y: x & y, tests)


def concat_columns(tables: Sequence[DataFrame], on: Sequence[str] | str) -> DataFrame:
    """Tables side by side. Rows have no position here, so a key says which belong together."""
    keys = [on] if isinstance(on, str) else list(on)
    return functools.reduce(lambda a, b: join(a, b, keys, how="outer"), tables)
