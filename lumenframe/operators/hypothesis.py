"""Hypothesis tests from grouped aggregates; each returns one row.

Rank tests of small samples without ties have exact p-values, others asymptotic ones. The forms
with ``per`` test every group of a table at once.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lumenframe.functions import dist
from lumenframe.functions.columns import col, number, safe_div
from lumenframe.operators.ordered import running
from lumenframe.operators.ranks import lookup
from lumenframe.session import ensure_checkpoint_dir


def _two_sides(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """(value, na, nb): both samples folded by value, written once because it is read several times."""
    ensure_checkpoint_dir(df.sparkSession)
    return (df.select(F.explode(F.array(F.struct(a.alias("v"), F.lit(1).alias("s")),
                                        F.struct(b.alias("v"), F.lit(2).alias("s")))).alias("x"))
            .select("x.v", "x.s").where("v is not null").groupBy("v")
            .agg(F.count_if(F.col("s") == 1).alias("na"), F.count_if(F.col("s") == 2).alias("nb")).checkpoint())


def _samples(df: DataFrame, value: str, by: str | None, groups: Sequence | None, other: str | None):
    if by is not None:
        if not groups or len(groups) != 2:
            raise ValueError("name the two groups to compare")
        v = number(df, value)
        return tuple(F.when(col(by) == F.lit(g), v) for g in groups)
    if other is None:
        raise ValueError("give a grouping column or a second column")
    return number(df, value), number(df, other)


def welch_t(df: DataFrame, value: str, by: str | None = None, groups: Sequence | None = None,
            other: str | None = None) -> DataFrame:
    """Two means with unequal variances; effect size is Cohen's d on the pooled deviation."""
    a, b = _samples(df, value, by, groups, other)
    m = df.agg(F.count(a).alias("n1"), F.count(b).alias("n2"), F.avg(a).alias("mean1"), F.avg(b).alias("mean2"),
               F.var_samp(a).alias("v1"), F.var_samp(b).alias("v2"))
    s1, s2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    pooled = F.sqrt(safe_div((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2"),
                             F.col("n1") + F.col("n2") - 2))
    dof = safe_div((s1 + s2) * (s1 + s2), safe_div(s1 * s1, F.col("n1") - 1) + safe_div(s2 * s2, F.col("n2") - 1))
    out = m.select("n1", "n2", "mean1", "mean2", safe_div(F.col("mean1") - F.col("mean2"), F.sqrt(s1 + s2)).alias("statistic"),
                   dof.alias("dof"), safe_div(F.col("mean1") - F.col("mean2"), pooled).alias("effect_size"))
    return out.withColumn("p_value", dist.t_two_sided(F.col("statistic"), F.col("dof")))


def paired_t(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mean difference of pairs; effect size is mean over deviation of the differences."""
    d = number(df, a) - number(df, b)
    m = df.agg(F.count(d).alias("n"), F.avg(d).alias("mean_difference"), F.stddev_samp(d).alias("sd"))
    effect = safe_div(F.col("mean_difference"), F.col("sd"))
    return m.select("n", "mean_difference", (effect * F.sqrt(F.col("n").cast("double"))).alias("statistic"),
                    effect.alias("effect_size")).withColumn(
        "p_value", dist.t_two_sided(F.col("statistic"), F.col("n") - 1))


def anova(df: DataFrame, value: str, by: str, min_rows: int = 3) -> DataFrame:
    """One-way F over the groups with at least three values.

    Eta squared is taken around the mean of all rows, those of smaller groups included.
    """
    v = number(df, value)
    groups = df.dropna(subset=[by]).groupBy(col(by)).agg(
        F.count(v).alias("n"), F.avg(v).alias("m"), (F.var_pop(v) * F.count(v)).alias("ss")).where(F.col("n") >= min_rows)
    kept = groups.agg(F.sum(F.col("n") * F.col("m")) / F.sum("n")).scalar()
    everyone = df.agg(F.avg(v)).scalar()

    def between(mean: Column) -> Column:
        return F.col("n") * (F.col("m") - mean) * (F.col("m") - mean)

    s = groups.select("n", "ss", between(kept).alias("b"), between(everyone).alias("b_all")).agg(
        F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n"), F.sum("ss").alias("w"),
        F.sum("b").alias("b"), F.sum("b_all").alias("b_all"))
    f = safe_div(safe_div(F.col("b"), F.col("groups") - 1), safe_div(F.col("w"), F.col("n") - F.col("groups")))
    return s.select("groups", "n", f.alias("statistic"),
                    safe_div(F.col("b_all"), F.col("w") + F.col("b_all")).alias("effect_size"),
                    dist.f_upper(f, F.col("groups") - 1, F.col("n") - F.col("groups")).alias("p_value"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Independence of two categories; Yates correction for two-by-two; effect size is Cramer's V.

    The statistic is summed over the cells that occur; cells that do not occur add their expectation.
    """
    cells = df.dropna(subset=[a, b]).groupBy(col(a).alias("a"), col(b).alias("b")).agg(F.count(F.lit(1)).alias("o"))
    rows = cells.groupBy("a").agg(F.sum("o").alias("ra"))
    cols = cells.groupBy("b").agg(F.sum("o").alias("cb"))
    n = cells.agg(F.sum("o")).scalar().cast("double")
    shape = rows.agg(F.count(F.lit(1))).scalar(), cols.agg(F.count(F.lit(1))).scalar()
    joined = cells.join(rows, "a").join(cols, "b").withColumn("e", F.col("ra") * F.col("cb") / n)
    observed = joined.agg(
        F.sum(F.pow(F.col("o") - F.col("e"), 2) / F.col("e")).alias("plain"), F.sum("e").alias("seen"),
        F.sum(F.pow(F.abs(F.col("o") - F.col("e")) - F.least(F.lit(0.5), F.abs(F.col("o") - F.col("e"))), 2)
              / F.col("e")).alias("yates"), F.max(n).alias("n"), F.min("e").alias("least"),
        F.count(F.lit(1)).alias("cells"))
    absent = F.col("n") - F.col("seen")
    k = observed.select("*", shape[0].alias("ka"), shape[1].alias("kb"), absent.alias("absent"))
    dof = (F.col("ka") - 1) * (F.col("kb") - 1)
    # In a two-by-two table at most two cells can be empty; each has the expectation of the absent mass.
    empty = F.greatest(F.lit(1), F.col("ka") * F.col("kb") - F.col("cells"))
    each = F.col("absent") / empty
    yates_empty = F.when(each > 0, empty * F.pow(each - F.least(F.lit(0.5), each), 2) / each).otherwise(F.lit(0.0))
    stat = F.when(dof == 1, F.col("yates") + yates_empty).otherwise(F.col("plain") + F.col("absent"))
    out = k.select("n", dof.alias("dof"), stat.alias("statistic"), "ka", "kb")
    v = F.sqrt(safe_div(F.col("statistic"), F.col("n") * (F.least("ka", "kb") - 1)))
    return out.select(F.col("n").cast("long").alias("n"), "dof", "statistic", v.alias("effect_size"),
                      dist.chi2_upper(F.col("statistic"), F.col("dof")).alias("p_value"))


def _ties(n: Column) -> Column:
    d = n.cast("double")
    return d * d * d - d


EXACT_SIDE, EXACT_PAIRS = 8, 1_000_000  # exact if a sample has so many values or fewer, and the pairs are no more
EXACT_SIGNED = 50                       # exact for so many differences or fewer


def rank_sum_ways(n1: int, n2: int) -> list[int]:
    """In how many ways n1 of n1 + n2 ranks give each U, from 0 to n1 * n2: the coefficients of a Gaussian binomial."""
    small, large = sorted((n1, n2))
    ways = [1] + [0] * (small * large)
    for i in range(1, small + 1):
        for u in range(len(ways) - 1, large + i - 1, -1):   # times 1 - q^(large + i)
            ways[u] -= ways[u - large - i]
        for u in range(i, len(ways)):                       # over 1 - q^i
            ways[u] += ways[u - i]
    return ways


def signed_rank_ways(n: int) -> list[int]:
    """In how many ways signs of the ranks 1 to n give each sum of the positive ones."""
    ways = [1]
    for rank in range(1, n + 1):
        ways = [a + b for a, b in zip(ways + [0] * rank, [0] * rank + ways)]
    return ways


def _two_sided(ways: list[int], statistic: float) -> float:
    """Twice the share of ways at least as far out as the statistic, one at most. The distribution is symmetric."""
    low = int(min(statistic, len(ways) - 1 - statistic))
    return min(1.0, 2 * sum(ways[:low + 1]) / sum(ways))


@F.pandas_udf(T.DoubleType())
def _rank_sum_p(n1: pd.Series, n2: pd.Series, u: pd.Series) -> pd.Series:
    """Exact p-value of U; null where any input is."""
    known: dict[tuple[int, int], list[int]] = {}
    out = []
    for a, b, s in zip(n1, n2, u):
        if pd.isna(a) or pd.isna(s):
            out.append(None)
            continue
        key = (int(a), int(b))
        known = known if key in known or len(known) < 1_000 else {}
        out.append(_two_sided(known.setdefault(key, rank_sum_ways(*key)) if key not in known else known[key], s))
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.DoubleType())
def _signed_rank_p(n: pd.Series, w: pd.Series) -> pd.Series:
    """Exact p-value of the smaller rank sum; null where any input is."""
    known = {int(k): signed_rank_ways(int(k)) for k in n.dropna().unique()}
    return pd.Series([None if pd.isna(k) or pd.isna(s) else _two_sided(known[int(k)], s) for k, s in zip(n, w)], dtype="float64")


def _mann_whitney_rows(s: DataFrame, keys: list[Column]) -> DataFrame:
    """Test results from n1, n2, the first sample's rank sum r1 and the sum t over ties."""
    n = F.col("n1") + F.col("n2")
    product = F.col("n1") * F.col("n2")
    out = s.select(*keys, "n1", "n2", "t", (F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2).alias("statistic"),
                   F.sqrt(F.col("n1") * F.col("n2") / 12 * (n + 1 - safe_div(F.col("t"), n * (n - 1)))).alias("sd"))
    z = safe_div(F.greatest(F.col("statistic"), product - F.col("statistic")) - product / 2 - 0.5, F.col("sd"))
    exact = (F.col("t") == 0) & (F.least("n1", "n2") > 0) & (F.least("n1", "n2") <= EXACT_SIDE) & (product <= EXACT_PAIRS)
    asked = [F.when(exact, c) for c in (F.col("n1"), F.col("n2"), F.col("statistic"))]
    both = F.col("n1") * F.col("n2") > 0
    p = F.when(exact, _rank_sum_p(*asked)).when(both, F.least(F.lit(1.0), 2 * dist.norm_cdf(-z)))
    return out.select(*keys, F.col("n1").cast("long").alias("n1"), F.col("n2").cast("long").alias("n2"), "statistic",
                      (1 - safe_div(2 * F.col("statistic"), product)).alias("effect_size"), p.alias("p_value"), exact.alias("exact"))


def mann_whitney_per(df: DataFrame, value: str, by: str, groups: Sequence, per: Sequence[str]) -> DataFrame:
    """The test of two samples in every group ``per``: its keys, n1, n2, statistic, effect_size, p_value, exact.

    Values rank within their group by ordered scans, so a large group is not brought to one task.
    A group that lacks a sample has no p-value; null keys are a group.
    """
    ensure_checkpoint_dir(df.sparkSession)
    one, two = _samples(df, value, by, groups, None)
    keys = [col(c) for c in per]
    names = [f"k{i}" for i in range(len(per))]
    folded = df.select(*[k.alias(n) for k, n in zip(keys, names)], F.coalesce(one, two).alias("v"), one.isNotNull().cast("int").alias("first")).where("v is not null")
    folded = folded.groupBy(*names, "v").agg(F.sum("first").alias("na"), F.count(F.lit(1)).alias("n")).checkpoint()
    ranked = running(folded, {"upto": ("sum", "n")}, "v", names)
    mean_rank = F.col("upto") - F.col("n") + (F.col("n") + 1) / 2
    s = ranked.groupBy(*names).agg(F.sum("na").cast("double").alias("n1"), F.sum(F.col("n") - F.col("na")).cast("double").alias("n2"),
                                   F.sum(F.col("na") * mean_rank).alias("r1"), F.sum(_ties(F.col("n"))).alias("t"))
    out = _mann_whitney_rows(s, [F.col(n) for n in names])
    return out.withColumnsRenamed(dict(zip(names, per)))


def mann_whitney(df: DataFrame, value: str, by: str | None = None, groups: Sequence | None = None,
                 other: str | None = None) -> DataFrame:
    """U of the first sample, rank-biserial effect, and the two-sided p: exact without ties and with at most
    EXACT_SIDE values in a sample, else normal with tie and continuity correction."""
    a, b = _samples(df, value, by, groups, other)
    ranked = running(_two_sides(df, a, b).withColumn("n", F.col("na") + F.col("nb")), {"upto": ("sum", "n")}, "v")
    mean_rank = F.col("upto") - F.col("n") + (F.col("n") + 1) / 2
    s = ranked.agg(F.sum("na").cast("double").alias("n1"), F.sum("nb").cast("double").alias("n2"),
                   F.sum(F.col("na") * mean_rank).alias("r1"), F.sum(_ties(F.col("n"))).alias("t"))
    return _mann_whitney_rows(s, []).drop("exact")


def kruskal_wallis(df: DataFrame, value: str, by: str, min_rows: int = 3) -> DataFrame:
    """H over the groups with at least three values, corrected for ties."""
    ensure_checkpoint_dir(df.sparkSession)
    folded = (df.dropna(subset=[by]).select(col(by).alias("g"), number(df, value).alias("v")).where("v is not null")
              .groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))).checkpoint()
    sizes = folded.groupBy("g").agg(F.sum("n").alias("size")).where(F.col("size") >= min_rows)
    kept = lookup(folded, sizes, ["g"], ["size"]).where("size is not null")
    values = kept.groupBy("v").agg(F.sum("n").alias("m"))
    ranked = running(values, {"upto": ("sum", "m")}, "v")
    mean_rank = F.col("upto") - F.col("m") + (F.col("m") + 1) / 2
    by_group = lookup(kept, ranked.select("v", mean_rank.alias("rank")), ["v"], ["rank"]).groupBy("g").agg(
        F.max("size").cast("double").alias("size"), F.sum(F.col("n") * F.col("rank")).alias("r"))
    ties = values.agg(F.sum(_ties(F.col("m")))).scalar()
    s = by_group.agg(F.count(F.lit(1)).alias("groups"), F.sum("size").alias("n"),
                     F.sum(F.col("r") * F.col("r") / F.col("size")).alias("q")).withColumn("t", ties)
    n = F.col("n")
    h = safe_div(12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1), 1 - F.col("t") / (n * n * n - n))
    return s.select("groups", F.col("n").cast("long").alias("n"), h.alias("statistic"),
                    dist.chi2_upper(h, F.col("groups") - 1).alias("p_value"))


def _wilcoxon_rows(s: DataFrame, keys: list[Column]) -> DataFrame:
    """Test results from the count n, the positive rank sum and the sum t over ties."""
    n = F.col("n")
    total = n * (n + 1) / 2
    w = F.least(F.col("plus"), total - F.col("plus"))
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("t") / 48)
    exact = (F.col("t") == 0) & (n > 0) & (n <= EXACT_SIGNED)
    p = F.when(exact, _signed_rank_p(F.when(exact, n), F.when(exact, w))).otherwise(F.least(F.lit(1.0), 2 * dist.norm_cdf(safe_div(w - total / 2, sd))))
    return s.select(*keys, n.cast("long").alias("n"), w.alias("statistic"), p.alias("p_value"), exact.alias("exact"))


def wilcoxon(df: DataFrame, a: str, b: str) -> DataFrame:
    """Signed ranks of the pair differences, zeros left out; the p-value is exact without ties and with at
    most EXACT_SIGNED differences, else normal with tie correction."""
    ensure_checkpoint_dir(df.sparkSession)
    return _wilcoxon_rows(_signed(df, a, b, []), []).drop("exact")


def wilcoxon_per(df: DataFrame, a: str, b: str, per: Sequence[str]) -> DataFrame:
    """The signed-rank test in every group ``per``: its keys, n, statistic, p_value, exact. Groups without a difference have no row."""
    ensure_checkpoint_dir(df.sparkSession)
    names = [f"k{i}" for i in range(len(per))]
    out = _wilcoxon_rows(_signed(df, a, b, list(per)), [F.col(n) for n in names])
    return out.withColumnsRenamed(dict(zip(names, per)))


def _signed(df: DataFrame, a: str, b: str, per: list[str]) -> DataFrame:
    """n, the sum of the positive ranks and the sum over ties of the differences, in all or per group."""
    names = [f"k{i}" for i in range(len(per))]
    d = df.select(*[col(c).alias(n) for c, n in zip(per, names)], (number(df, a) - number(df, b)).alias("d"))
    folded = d.where("d is not null and d <> 0").groupBy(*names, F.abs("d").alias("v")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") > 0).alias("up")).checkpoint()
    ranked = running(folded, {"upto": ("sum", "n")}, "v", names)
    mean_rank = F.col("upto") - F.col("n") + (F.col("n") + 1) / 2
    return ranked.groupBy(*names).agg(F.sum("n").cast("double").alias("n"), F.sum(F.col("up") * mean_rank).alias("plus"), F.sum(_ties(F.col("n"))).alias("t"))


def ks_two_sample(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Largest distance of the two cumulative shares, asymptotic p."""
    ranked = running(_two_sides(df, a, b), {"ca": ("sum", "na"), "cb": ("sum", "nb")}, "v")
    sizes = ranked.agg(F.max("ca").cast("double").alias("n1"), F.max("cb").cast("double").alias("n2"))
    n1, n2 = sizes.select("n1").scalar(), sizes.select("n2").scalar()
    s = ranked.agg(F.max(F.abs(safe_div(F.col("ca"), n1) - safe_div(F.col("cb"), n2))).alias("statistic"),
                   F.max("ca").alias("n1"), F.max("cb").alias("n2"))
    both = F.col("n1").cast("double") * F.col("n2") / (F.col("n1") + F.col("n2"))
    return s.select("n1", "n2", "statistic", dist.ks_upper(F.col("statistic"), both).alias("p_value"))
