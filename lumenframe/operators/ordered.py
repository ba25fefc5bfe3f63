"""Order-dependent operators over a whole table, without one task holding it.

``Window.orderBy`` without a partition moves every row to one task, and a hot
partition key moves its share there. Here the rows are cut into ranges of the
full sort key (partition keys first, so a hot key is cut too), windows run inside
a range, and what a range inherits from the ranges before it comes from one small
aggregate: at most one row per range, joined by broadcast.

The sort key must be unique: end ``order_by`` with a key column of the table.
Range bounds are literals taken from a hash sample, so a rerun of any part of the
plan assigns every row to the same range.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lumenframe.functions.columns import col, normalise_missing, require

RN, RANGE, BLOCK, TARGET = "__rn", "__range", "__block", "__target"
BLOCK_ROWS = 1_000_000
MAX_BLOCKS = 100_000
SAMPLE_PER_RANGE = 64
RANGE_ROWS = 8_000_000      # rows that a range holds, about, however few partitions the session asks for


class SortKey(NamedTuple):
    name: str
    ascending: bool = True


def sort_keys(order_by: Sequence[str | tuple[str, bool]] | str) -> list[SortKey]:
    if isinstance(order_by, str):
        order_by = [order_by]
    keys = [SortKey(k) if isinstance(k, str) else SortKey(*k) for k in order_by]
    if not keys:
        raise ValueError("order_by is required")
    return keys


def sort_columns(keys: Sequence[SortKey]) -> list[Column]:
    """Nulls last in both directions."""
    return [col(k.name).asc_nulls_last() if k.ascending else col(k.name).desc_nulls_last() for k in keys]


def _driver_order(keys: Sequence[SortKey]):
    def compare(a, b) -> int:
        for x, y, key in zip(a, b, keys):
            if x == y:
                continue
            if x is None or y is None:
                return 1 if x is None else -1
            return (-1 if x < y else 1) * (1 if key.ascending else -1)
        return 0
    return functools.cmp_to_key(compare)


def _bounds(df: DataFrame, keys: Sequence[SortKey], ranges: int, rows: int) -> list[tuple]:
    """At most ``ranges - 1`` cut points from a hash sample of the distinct sort keys.

    The sample size depends on the number of ranges only, never on the table.
    """
    wanted = ranges * SAMPLE_PER_RANGE
    share = min(1.0, wanted / max(rows, 1))
    names = [col(k.name) for k in keys]
    picked = df.select(*[c.alias(f"k{i}") for i, c in enumerate(names)])
    if share < 1.0:
        hashed = F.pmod(F.xxhash64(*picked.columns), F.lit(1 << 40))
        picked = picked.where(hashed < F.lit(int(share * (1 << 40))))
    sample = [tuple(r) for r in picked.distinct().limit(8 * wanted).collect()]
    sample.sort(key=_driver_order(keys))
    cuts = sorted({len(sample) * i // ranges for i in range(1, ranges)} - {0})
    return [sample[i] for i in cuts if i < len(sample)]


def _bound_reached(bound: Sequence[Column], keys: Sequence[SortKey]) -> Column:
    """bound <= the row's key, in sort order."""
    out = F.lit(True)
    for b, key in reversed(list(zip(bound, keys))):
        k = col(key.name)
        earlier = (b < k) if key.ascending else (b > k)
        before = (b.isNotNull() & k.isNull()) | F.coalesce(earlier, F.lit(False))
        out = before | (b.eqNullSafe(k) & out)
    return out


def _range_of(df: DataFrame, bounds: Sequence[tuple], keys: Sequence[SortKey]) -> Column:
    """Number of bounds at or before the row, by binary search."""
    kinds = [df.schema[k.name].dataType for k in keys]
    literals = [[F.lit(v).cast(t) for v, t in zip(b, kinds)] for b in bounds]

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(_bound_reached(literals[mid], keys), tree(mid + 1, high)).otherwise(tree(low, mid))

    if len(bounds) <= 32:
        return tree(0, len(bounds))
    table = F.array(*[F.struct(*[v.alias(f"k{i}") for i, v in enumerate(b)]) for b in literals])
    steps = F.array(*[F.lit(1 << p) for p in reversed(range(len(bounds).bit_length()))])

    def advance(at: Column, step: Column) -> Column:
        bound = F.try_element_at(table, at + step)
        fields = [bound[f"k{i}"] for i in range(len(keys))]
        fits = (at + step <= len(bounds)) & _bound_reached(fields, keys)
        return F.when(fits, at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), advance)


class Ordered(NamedTuple):
    """A table cut into sort-key ranges."""

    df: DataFrame
    part: list[str]
    keys: list[SortKey]
    rows: int

    @property
    def window(self):
        return W.partitionBy(RANGE, *[col(p) for p in self.part]).orderBy(*sort_columns(self.keys))

    def carries(self, totals: Mapping[str, Column], prefix: Mapping[str, Column]) -> DataFrame:
        """What each range inherits; only ranges whose group began in an earlier range.

        A range holds the middle of at most one group, so this has at most one row per range.
        """
        per_range = self.df.groupBy(*[col(p) for p in self.part], RANGE).agg(
            F.count(F.lit(1)).alias("__n"), *[c.alias(n) for n, c in totals.items()])
        earlier = (W.partitionBy(*[col(p) for p in self.part]).orderBy(RANGE)
                   .rowsBetween(W.unboundedPreceding, -1))
        out = per_range.select(
            *[col(p).alias(f"__p{i}") for i, p in enumerate(self.part)],
            F.col(RANGE).alias("__r"), F.sum("__n").over(earlier).alias("__before"),
            *[c.over(earlier).alias(n) for n, c in prefix.items()])
        return F.broadcast(out.where(F.col("__before").isNotNull()))

    def attach(self, local: DataFrame, carry: DataFrame) -> DataFrame:
        same = F.col(RANGE) == F.col("__r")
        for i, p in enumerate(self.part):
            same = same & col(p).eqNullSafe(F.col(f"__p{i}"))
        return local.join(carry, same, "left")


class Layout(NamedTuple):
    """Range bounds of a sort key, to be shared by several operators over the same rows."""

    bounds: list[tuple]
    rows: int


def layout(df: DataFrame, order_by, partition_by: Sequence[str] = (), ranges: int | None = None) -> Layout:
    """Counts the rows and samples the sort key: two light jobs that read the key columns only."""
    keys, part = sort_keys(order_by), list(partition_by)
    require(df, part + [k.name for k in keys])
    full = [SortKey(p) for p in part] + keys
    clean = normalise_missing(df.select(*[col(n) for n in dict.fromkeys(k.name for k in full)]))
    rows = clean.count()
    ranges = ranges or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // RANGE_ROWS))
    return Layout(_bounds(clean, full, ranges, rows) if ranges > 1 and rows else [], rows)


def cut(df: DataFrame, order_by, partition_by: Sequence[str] = (), ranges: int | None = None,
        shared: Layout | None = None) -> Ordered:
    keys, part = sort_keys(order_by), list(partition_by)
    plan = shared or layout(df, order_by, partition_by, ranges)
    df = normalise_missing(df)
    full = [SortKey(p) for p in part] + keys
    return Ordered(df.withColumn(RANGE, _range_of(df, plan.bounds, full)), part, keys, plan.rows)


_RUNNING = {
    # name: (total and window aggregate, how two parts are put together)
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "count": (F.count, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "prod": (F.product, lambda a, b: F.coalesce(a, F.lit(1.0)) * F.coalesce(b, F.lit(1.0))),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
}
_PREFIX = {"sum": F.sum, "count": F.sum, "prod": F.product, "min": F.min, "max": F.max}


def running(df: DataFrame, specs: Mapping[str, tuple[str, str]], order_by,
            partition_by: Sequence[str] = (), row_number: str | None = None,
            ranges: int | None = None, shared: Layout | None = None) -> DataFrame:
    """Running aggregates up to and with each row; one shuffle of the table.

    ``specs`` maps an output name to (sum | count | prod | min | max | mean, column).
    """
    basic: dict[str, tuple[str, str]] = {}
    for out, (fn, column) in specs.items():
        if fn == "mean":
            basic[f"__s_{out}"], basic[f"__c_{out}"] = ("sum", column), ("count", column)
        elif fn in _RUNNING:
            basic[out] = (fn, column)
        else:
            raise ValueError(f"unknown running function: {fn}")
    o = cut(df, order_by, partition_by, ranges, shared)
    upto = o.window.rowsBetween(W.unboundedPreceding, 0)
    local = o.df.select(
        "*", F.row_number().over(o.window).alias("__local"),
        *[_RUNNING[fn][0](col(c)).over(upto).alias(f"__l_{n}") for n, (fn, c) in basic.items()])
    carry = o.carries(
        {f"__t_{n}": _RUNNING[fn][0](col(c)) for n, (fn, c) in basic.items()},
        {f"__b_{n}": _PREFIX[fn](F.col(f"__t_{n}")) for n, (fn, c) in basic.items()})
    joined = o.attach(local, carry)
    values = {n: _RUNNING[fn][1](F.col(f"__b_{n}"), F.col(f"__l_{n}")) for n, (fn, _) in basic.items()}
    result = [col(c) for c in df.columns]
    for out, (fn, _) in specs.items():
        if fn == "mean":
            value = F.try_divide(values[f"__s_{out}"].cast("double"), values[f"__c_{out}"])
        else:
            value = values[out]
        result.append(value.alias(out))
    if row_number:
        result.append((F.col("__local") + F.coalesce(F.col("__before"), F.lit(0))).alias(row_number))
    return joined.select(*result)


def with_row_number(df: DataFrame, order_by, partition_by: Sequence[str] = (), name: str = RN,
                    ranges: int | None = None) -> DataFrame:
    """1, 2, 3, ... in the given order, per group when ``partition_by`` is given."""
    return running(df, {}, order_by, partition_by, row_number=name, ranges=ranges)


class Blocks(NamedTuple):
    """A numbered table in blocks of equally many consecutive rows per group."""

    df: DataFrame
    part: list[str]
    length: int

    @property
    def window(self):
        return W.partitionBy(*[col(p) for p in self.part], TARGET).orderBy(RN)


def blocks(df: DataFrame, order_by, partition_by: Sequence[str] = (), reach: int = 0,
           block_rows: int = BLOCK_ROWS, ranges: int | None = None, shared: Layout | None = None) -> Blocks:
    """Blocks of at least ``reach`` rows and at most MAX_BLOCKS of them beyond the first of a group."""
    o = cut(df, order_by, partition_by, ranges, shared)
    local = o.df.withColumn("__local", F.row_number().over(o.window))
    joined = o.attach(local, o.carries({}, {}))
    length = max(block_rows, -(-o.rows // MAX_BLOCKS), reach, 1)
    number = F.col("__local") + F.coalesce(F.col("__before"), F.lit(0))
    out = joined.select(*[col(c) for c in df.columns], number.alias(RN))
    return Blocks(out.withColumn(BLOCK, F.floor((F.col(RN) - 1) / F.lit(length)).cast("long")),
                  list(partition_by), length)


def _with_halo(b: Blocks, before: int, after: int) -> DataFrame:
    """Rows near a block's edge are also sent to the neighbour block that looks at them."""
    place = (F.col(RN) - 1) - F.col(BLOCK) * b.length
    targets = [F.col(BLOCK)]
    if before:
        targets.append(F.when(place >= b.length - before, F.col(BLOCK) + 1))
    if after:
        targets.append(F.when((place < after) & (F.col(BLOCK) > 0), F.col(BLOCK) - 1))
    return b.df.withColumn(TARGET, F.explode(F.filter(F.array(*targets), lambda t: t.isNotNull())))


def over_rows(df: DataFrame, specs: Mapping[str, Column], before: int, after: int, order_by,
              partition_by: Sequence[str] = (), block_rows: int = BLOCK_ROWS,
              ranges: int | None = None, shifts: Mapping[str, tuple[str, int]] | None = None,
              shared: Layout | None = None) -> DataFrame:
    """Aggregates over the frame from ``before`` rows back to ``after`` rows on, plus lags and leads."""
    shifts = shifts or {}
    reach_back = max([before] + [k for _, k in shifts.values()])
    reach_on = max([after] + [-k for _, k in shifts.values()])
    b = blocks(df, order_by, partition_by, max(reach_back, reach_on), block_rows, ranges, shared)
    frame = b.window.rowsBetween(-before, after)
    out = _with_halo(b, reach_back, reach_on).select(
        "*", *[c.over(frame).alias(n) for n, c in specs.items()],
        *[F.lag(col(c), k).over(b.window).alias(n) for n, (c, k) in shifts.items()])
    keep = [*df.columns, *specs, *shifts]
    return out.where(F.col(TARGET) == F.col(BLOCK)).select(*[col(c) for c in keep])


def fill(df: DataFrame, specs: Mapping[str, tuple[str, str]], order_by, partition_by: Sequence[str] = (),
         block_rows: int = BLOCK_ROWS, ranges: int | None = None, keep_position: bool = False,
         shared: Layout | None = None) -> DataFrame:
    """Last known value before a gap ("forward") or next known value after it ("backward").

    ``specs`` maps an output name to (column, direction). With ``keep_position`` the results
    are structs (v, at) with the row number the value came from, and the row number is kept.
    """
    b = blocks(df, order_by, partition_by, 0, block_rows, ranges, shared)
    rows = b.df.withColumn(TARGET, F.col(BLOCK))
    known = {n: F.when(col(c).isNotNull(), F.struct(col(c).alias("v"), F.col(RN).alias("at")))
             for n, (c, _) in specs.items()}
    part = [col(p) for p in b.part]

    # Backward fills run forward over the reversed order: a frame that only grows is linear in Spark.
    def nearest(value: Column, keys: list[Column], order: str, direction: str, end: int) -> Column:
        w = W.partitionBy(*keys).orderBy(F.col(order) if direction == "forward" else F.col(order).desc())
        return F.last(value, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, end))

    local = rows.select("*", *[nearest(known[n], [*part, F.col(TARGET)], RN, d, 0).alias(f"__l_{n}")
                               for n, (_, d) in specs.items()])
    per_block = rows.groupBy(*part, BLOCK).agg(*[
        (F.max_by if d == "forward" else F.min_by)(known[n], known[n]["at"]).alias(f"__t_{n}")
        for n, (_, d) in specs.items()])
    carry = per_block.select(
        *[c.alias(f"__p{i}") for i, c in enumerate(part)], F.col(BLOCK).alias("__bk"),
        *[nearest(F.col(f"__t_{n}"), part, BLOCK, d, -1).alias(f"__c_{n}") for n, (_, d) in specs.items()])
    any_known = functools.reduce(lambda x, y: x | y, [F.col(f"__c_{n}").isNotNull() for n in specs])
    same = F.col(BLOCK) == F.col("__bk")
    for i, c in enumerate(part):
        same = same & c.eqNullSafe(F.col(f"__p{i}"))
    joined = local.join(F.broadcast(carry.where(any_known)), same, "left")
    found = {n: F.coalesce(F.col(f"__l_{n}"), F.col(f"__c_{n}")) for n in specs}
    if keep_position:
        return joined.select(*[col(c) for c in df.columns], F.col(RN),
                             *[c.alias(n) for n, c in found.items()])
    replaced = {n: c["v"] for n, c in found.items()}
    kept = [replaced[c].alias(c) if c in replaced else col(c) for c in df.columns]
    return joined.select(*kept, *[c.alias(n) for n, c in replaced.items() if n not in df.columns])


def interpolate(df: DataFrame, columns: Sequence[str], order_by, partition_by: Sequence[str] = (),
                block_rows: int = BLOCK_ROWS, ranges: int | None = None) -> DataFrame:
    """Straight line by row position between known values.

    Leading gaps stay, trailing gaps take the last known value.
    """
    specs = {f"__f_{c}": (c, "forward") for c in columns} | {f"__g_{c}": (c, "backward") for c in columns}
    out = fill(df, specs, order_by, partition_by, block_rows, ranges, keep_position=True)

    def line(c: str) -> Column:
        a, b = F.col(f"`__f_{c}`"), F.col(f"`__g_{c}`")
        slope = F.try_divide((b["v"] - a["v"]).cast("double"), b["at"] - a["at"])
        return (F.when(col(c).isNotNull(), col(c).cast("double"))
                .when(b.isNull(), a["v"].cast("double"))
                .otherwise(a["v"] + slope * (F.col(RN) - a["at"])))

    return out.select(*[line(c).alias(c) if c in columns else col(c) for c in df.columns])
