"""Joins on order instead of equality: the nearest row in time, points in intervals, intervals that overlap.

As-of joins put both tables into one order (keys, time) that is cut into ranges, and carry the last
row of the right table forward as a fill does, so a key with most of the rows is cut like any other.
Interval joins of keys with few intervals join on the keys. Where a key has many, or none is given,
they give every interval to the one or two cells it touches of a grid as wide as itself,
and every point to its cell of each width in use, and join on cells; no pair of rows outside a
shared cell is formed, and a long interval is not copied into many short cells. Cells with many
rows are cut into slices.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from lumenframe.functions.columns import col, normalise_missing, require, time_columns
from lumenframe.operators.ordered import fill
from lumenframe.session import ensure_checkpoint_dir

LOWEST, HIGHEST = -900, 1_000   # powers of two between which cells are as wide as an interval
FLAT = LOWEST - 1               # stands for the width where a key has no grid
CROWD = 1_000                   # intervals of a key above which they are laid on a grid
SLICE_POINTS, SLICE_INTERVALS = 4_096, 65_536   # rows of a cell that meet in one piece
COMPARED = 50_000_000   # pairs of a cell's rows that a joining task compares, about
MOST_TASKS = 20_000


def _names(names: Sequence[str] | str | None, other: list[str] | None = None) -> list[str]:
    return (other or []) if names is None else [names] if isinstance(names, str) else list(names)


def _unpacked(pairs: DataFrame, left: DataFrame, right: DataFrame, dropped: Sequence[str], suffixes: tuple[str, str]) -> DataFrame:
    """Structs l and r as columns; shared names get the suffixes, ``dropped`` columns of the right table go."""
    kept = [c for c in right.columns if c not in dropped]
    clash = set(left.columns) & set(kept)
    return pairs.select(
        *[F.col("l").getField(c).alias(c + suffixes[0] if c in clash else c) for c in left.columns],
        *[F.col("r").getField(c).alias(c + suffixes[1] if c in clash else c) for c in kept])


def asof_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str | None = None, by: Sequence[str] | str = (),
              right_by: Sequence[str] | str | None = None, direction: str = "backward", tolerance: str | float | None = None, exact: bool = True,
              tie: Sequence[str] | str | None = None, how: str = "left", suffixes: tuple[str, str] = ("_x", "_y"), null_keys_match: bool = True) -> DataFrame:
    """Every left row with the last right row at or before its time (``backward``), the first at or
    after it (``forward``), or the closer of both (``nearest``; at equal distance the earlier).

    ``by`` names keys that must be equal. ``tolerance`` is the greatest distance, an interval such
    as "2 hours" or a number; ``exact=False`` leaves out equal times (not for ``nearest``). Among right rows of one time
    the last in the order of ``tie`` counts backward and the first forward; without ``tie`` a hash
    of the row orders them. Left rows without a time or a match get nulls (``how="left"``) or go
    (``"inner"``); right rows without a time match nothing. Repeated left rows match each.
    """
    if direction not in ("backward", "forward", "nearest") or how not in ("left", "inner"):
        raise ValueError(f"unknown as-of join: {direction}, {how}")
    if direction == "nearest" and not exact:
        raise ValueError("nearest rows may have the same time")
    right_time = right_time or left_time
    lk, order = _names(by), _names(tie)
    rk = _names(right_by, lk)
    require(left, [left_time, *lk])
    require(right, [right_time, *rk, *order])
    if len(lk) != len(rk):
        raise ValueError("give as many right keys as left keys")
    left, right = normalise_missing(left), normalise_missing(right)
    kind = left.schema[left_time].dataType
    found_first = (direction != "forward") == exact     # right rows stand before left rows of their time
    ties = [col(c) for c in order] or [F.xxhash64(*[F.to_json(F.struct(col(c))) for c in right.columns])]

    def rows(df: DataFrame, keys: list[str], time: str, is_left: bool) -> DataFrame:
        whole = F.struct(*[col(c) for c in df.columns])
        none = F.lit(None)
        return df.select(
            whole.alias("l") if is_left else none.cast(T.StructType(left.schema.fields)).alias("l"),
            none.cast(T.StructType(right.schema.fields)).alias("r") if is_left else whole.alias("r"),
            *[col(k).cast(left.schema[lk[i]].dataType).alias(f"k{i}") for i, k in enumerate(keys)], col(time).cast(kind).alias("at"),
            F.lit(int(is_left == found_first)).alias("side"),
            *[(none if is_left else c).cast(right.select(c).schema[0].dataType).alias(f"t{i}") for i, c in enumerate(ties)])

    both = rows(left, lk, left_time, True).union(rows(right.where(col(right_time).isNotNull()), rk, right_time, False))
    specs = {"before": ("r", "forward")} if direction != "forward" else {}
    specs |= {"after": ("r", "backward")} if direction != "backward" else {}
    filled = fill(both, specs, ["at", "side", *[f"t{i}" for i in range(len(ties))]], [f"k{i}" for i in range(len(lk))]).where(F.col("l").isNotNull())

    def far(side: str) -> Column:
        """Distance of a match as a number: seconds for times."""
        there, here = F.col(side).getField(right_time).cast(kind), F.col("at")
        if left_time in time_columns(left):
            there, here = [F.unix_micros(x.cast("timestamp")).cast("double") / 1e6 for x in (there, here)]
        return F.abs(here.cast("double") - there.cast("double"))

    match = F.col("before" if direction != "forward" else "after")
    if direction == "nearest":
        match = F.when(F.col("before").isNull() | (far("after") < far("before")), F.col("after")).otherwise(F.col("before"))
    known = F.col("at").isNotNull()
    if not null_keys_match:
        for i in range(len(lk)):
            known = known & F.col(f"k{i}").isNotNull()
    out = filled.select("l", "at", F.when(known, match).alias("r"))
    if tolerance is not None:
        limit = F.lit(float(tolerance)) if not isinstance(tolerance, str) else F.expr(f"cast(unix_micros(timestamp '2000-01-01 00:00:00' + interval {tolerance}) - unix_micros(timestamp '2000-01-01 00:00:00') as double) / 1e6")
        out = out.select("l", F.when(far("r") <= limit, F.col("r")).alias("r"))
    if how == "inner":
        out = out.where(F.col("r").isNotNull())
    return _unpacked(out, left, right, [k for k, l in zip(rk, lk) if k == l], suffixes)


def _number(df: DataFrame, name: str) -> Column:
    """The column as a double that never falls where the column rises."""
    return F.unix_micros(col(name).cast("timestamp")).cast("double") if name in time_columns(df) else col(name).cast("double")


def _sliced(left: DataFrame, right: DataFrame, cells: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Both tables with columns i and j: a cell of many points or intervals is cut into slices of bounded size, and each
    slice of the one table meets each of the other. Cells are the pairs of columns ``cells``; most have one slice."""
    own, other = [a for a, _ in cells], [b for _, b in cells]
    counts = [df.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(
        *[F.col(c).alias(f"s{x}") for x, c in enumerate(names)], F.ceil(F.col("n") / most).alias("n"))
        for df, names, most in ((left, own, SLICE_POINTS), (right, other, SLICE_INTERVALS))]

    def dealt(df: DataFrame, names: list[str], kept: str, copied: str, mine: DataFrame, theirs: DataFrame) -> DataFrame:
        """Rows go to one slice of their own by number, whatever they hold, and to each slice of the other table."""
        out = df.withColumn("row", F.xxhash64(F.monotonically_increasing_id()))
        for table, place in ((mine, kept), (theirs, copied)):
            same = F.lit(True)
            for x, c in enumerate(names):
                same = same & F.col(c).eqNullSafe(F.col(f"s{x}"))
            parts = F.coalesce(F.col("n"), F.lit(1))
            at = F.pmod(F.col("row"), parts) if place == kept else F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))
            out = out.join(F.broadcast(table), same, "left").select(*[c for c in out.columns], at.alias(place))
        return out.drop("row")

    return dealt(left, own, "i", "j", counts[0], counts[1]), dealt(right, other, "j1", "i1", counts[1], counts[0])


def _tasks(left: DataFrame, right: DataFrame, cells: list[tuple[str, str]]) -> int:
    """Tasks that the pairs of rows in shared cells need, 0 where those that the planner takes will do.

    Pairs may grow with the square of the rows, and planners count bytes only.
    """
    a = left.groupBy(*[x for x, _ in cells]).agg(F.count(F.lit(1)).alias("n"))
    b = right.groupBy(*[y for _, y in cells]).agg(F.count(F.lit(1)).alias("m"))
    same = F.lit(True)
    for x, y in cells:
        same = same & F.col(x).eqNullSafe(F.col(y))
    pairs = a.join(b, same).agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0] or 0.0
    tasks = min(MOST_TASKS, math.ceil(pairs / COMPARED))
    return tasks if tasks > left.sparkSession.sparkContext.defaultParallelism else 0


def _crowded(df: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """Keys s0, s1, ... with more rows than ``most``; without keys one row without columns, if there are so many."""
    return df.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(*[col(k).alias(f"s{x}") for x, k in enumerate(keys)])


def _in_crowd(keys: Sequence[str]) -> Column:
    same = F.lit(True)
    for x, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"s{x}"))
    return same


def _meet(points: DataFrame, intervals: DataFrame, point: str, start: str, end: str, on: Sequence[tuple[str, str]], open_start: bool, null_keys_match: bool, few: bool = False) -> DataFrame:
    """Structs (l, r) of the points and the intervals that hold them. Both tables are read several times.

    ``few`` says that no key has many rows in either table."""
    low, high = _number(intervals, start), _number(intervals, end)
    length, size = high - low, F.greatest(F.abs(low), F.abs(high))
    # As wide as the interval, and wide enough that cells can be told apart in a double.
    width = F.greatest(F.when(length > 0, F.ceil(F.log2(length))).otherwise(LOWEST), F.when(size > 0, F.floor(F.log2(size)) - 50).otherwise(LOWEST), F.lit(LOWEST)).cast("int")
    mine, theirs = [f"k{i}" for i in range(len(on))], [f"h{i}" for i in range(len(on))]
    keys_l = [col(a).alias(k) for k, (a, _) in zip(mine, on)]
    keys_r = [col(b).alias(h) for h, (_, b) in zip(theirs, on)]
    right = intervals.where(col(start) <= col(end)).select(F.struct(*[col(c) for c in intervals.columns]).alias("r"), *keys_r, low.alias("low"), high.alias("high"), width.alias("width"))
    right = right.where(F.col("width") <= HIGHEST)
    left = points.where(col(point).isNotNull()).select(F.struct(*[col(c) for c in points.columns]).alias("l"), *keys_l, _number(points, point).alias("x"))

    # Keys with few intervals need no grid: their points meet all of them, and are not copied to the widths in use.
    crowded = None if few else _crowded(right, theirs, CROWD).checkpoint()
    many = not few and not crowded.isEmpty()

    def gridded(df: DataFrame, names: list[str]) -> DataFrame:
        if not on or not many:
            return df.withColumn("grid", F.lit(many))
        return df.join(F.broadcast(crowded.withColumn("found", F.lit(True))), _in_crowd(names), "left").select(*[F.col(c) for c in df.columns], F.col("found").isNotNull().alias("grid"))

    right = gridded(right, theirs)
    widths = sorted(r.width for r in right.where("grid").select("width").distinct().collect()) if many else []    # powers of two that occur: few, 1,900 at most
    power = F.pow(F.lit(2.0), "width")
    right = right.select("r", *theirs, F.when(F.col("grid"), F.col("width")).otherwise(FLAT).alias("width"), F.explode(F.when(
        F.col("grid"), F.sequence(F.floor(F.col("low") / power), F.floor(F.col("high") / power))).otherwise(F.array(F.lit(0).cast("long")))).alias("cell"))
    left = gridded(left, mine).withColumn("w", F.explode(F.when(F.col("grid"), F.array(*[F.lit(w) for w in widths]).cast("array<int>")).otherwise(F.array(F.lit(FLAT)))))
    spot = F.col("x") / F.pow(F.lit(2.0), "w")
    left = left.select("l", *mine, "w", F.when(F.col("w") == FLAT, F.lit(0).cast("long")).when(F.abs(spot) < 2.0 ** 62, F.floor(spot)).alias("spot")).where("spot is not null")
    cells = [*zip(mine, theirs), ("w", "width"), ("spot", "cell")]
    tasks = _tasks(left, right, cells) if widths or not on else 0     # without a grid, a row meets CROWD intervals of its keys at most
    left, right = (left.withColumns({"i": F.lit(0), "j": F.lit(0)}), right.withColumns({"i1": F.lit(0), "j1": F.lit(0)})) if few else _sliced(left, right, cells)
    if tasks:
        left, right = (df.repartition(tasks, *names) for df, names in (
            (left, [*mine, "w", "spot", "i", "j"]), (right, [*theirs, "width", "cell", "i1", "j1"])))
    same = (F.col("w") == F.col("width")) & (F.col("spot") == F.col("cell")) & (F.col("i") == F.col("i1")) & (F.col("j") == F.col("j1"))
    for k, h in zip(mine, theirs):
        same = same & (F.col(k).eqNullSafe(F.col(h)) if null_keys_match else F.col(k) == F.col(h))
    p, a, b = F.col("l").getField(point), F.col("r").getField(start), F.col("r").getField(end)
    # Merged, never broadcast: planners take these tables for smaller than they are, and pairs come from all tasks.
    return left.hint("merge").join(right, same & (p > a if open_start else p >= a) & (p <= b)).select("l", "r")


def _stored(df: DataFrame) -> DataFrame:
    """The rows written once: they are counted, dealt by their numbers and joined."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def _pairs(on: Sequence[str] | str, right_on: Sequence[str] | str | None) -> list[tuple[str, str]]:
    a = _names(on)
    b = _names(right_on, a)
    if len(a) != len(b):
        raise ValueError("give as many right keys as left keys")
    return list(zip(a, b))


def interval_join(points: DataFrame, intervals: DataFrame, point: str, start: str, end: str, on: Sequence[str] | str = (),
                  right_on: Sequence[str] | str | None = None, how: str = "inner", key: Sequence[str] | str | None = None,
                  suffixes: tuple[str, str] = ("_x", "_y"), null_keys_match: bool = True) -> DataFrame:
    """Pairs of a point and an interval with start <= point <= end, and equal keys ``on``.

    Numbers, dates and timestamps. Rows with a null point or bound, and intervals that end before
    they start, match nothing. ``how="left"`` keeps points in no interval, ``"semi"`` and ``"anti"``
    the points in some and in none; these need ``key``, unique columns of the points.
    """
    pairs = _pairs(on, right_on)
    require(points, [point, *[a for a, _ in pairs], *_names(key)])
    require(intervals, [start, end, *[b for _, b in pairs]])
    if how not in ("inner", "left", "semi", "anti") or (how != "inner" and not _names(key)):
        raise ValueError("interval joins are inner, or left, semi or anti with key")
    points, intervals = _stored(normalise_missing(points)), _stored(normalise_missing(intervals))
    met = _meet(points, intervals, point, start, end, pairs, False, null_keys_match)
    dropped = [b for a, b in pairs if a == b]
    if how == "inner":
        return _unpacked(met, points, intervals, dropped, suffixes)
    found = met.select(*[F.col("l").getField(k).alias(f"u{i}") for i, k in enumerate(_names(key))]).distinct()
    same = F.lit(True)
    for i, k in enumerate(_names(key)):
        same = same & col(k).eqNullSafe(F.col(f"u{i}"))
    if how != "left":
        return points.join(found, same, f"left_{how}")
    alone = points.join(found, same, "left_anti").select(F.struct(*[col(c) for c in points.columns]).alias("l"), F.lit(None).cast(T.StructType(intervals.schema.fields)).alias("r"))
    return _unpacked(met.union(alone), points, intervals, dropped, suffixes)


def overlap_join(left: DataFrame, right: DataFrame, left_bounds: tuple[str, str], right_bounds: tuple[str, str], on: Sequence[str] | str = (),
                 right_on: Sequence[str] | str | None = None, suffixes: tuple[str, str] = ("_x", "_y"), null_keys_match: bool = True) -> DataFrame:
    """Pairs of intervals that share a point (bounds belong to them), with equal keys ``on``.

    Of two that overlap, the right one starts inside the left one, or else the left one after the
    right one's start and inside it: two joins of points that have no pair in common. Null bounds
    and intervals that end before they start match nothing. A table joined with itself is written once.
    """
    pairs = _pairs(on, right_on)
    (a, b), (c, d) = left_bounds, right_bounds
    require(left, [a, b, *[x for x, _ in pairs]])
    require(right, [c, d, *[y for _, y in pairs]])
    alike = left is right
    left = _stored(normalise_missing(left))
    right = left if alike else _stored(normalise_missing(right))
    proper = [df.where(col(s) <= col(e)) for df, s, e in ((left, a, b), (right, c, d))]
    # Where no key has many rows in either table, neither join looks for crowds again.
    most, mine, theirs = min(CROWD, SLICE_POINTS, SLICE_INTERVALS), [x for x, _ in pairs], [y for _, y in pairs]
    same = alike and (a, b, *mine) == (c, d, *theirs)
    few = bool(pairs) and all(_crowded(df, keys, most).isEmpty() for df, keys in list(zip(proper, (mine, theirs)))[:1 if same else 2])
    inside = _meet(proper[1], proper[0], c, a, b, [(y, x) for x, y in pairs], False, null_keys_match, few).select(F.col("r").alias("l"), F.col("l").alias("r"))
    later = _meet(proper[0], proper[1], a, c, d, pairs, True, null_keys_match, few)
    return _unpacked(inside.union(later), left, right, [y for x, y in pairs if x == y], suffixes)
