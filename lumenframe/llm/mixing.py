"""Mixing sources to target weights: a token budget handed down a tree of domains, languages and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lumenframe.llm.tables import written

BUCKET_DIGITS = 4   # hexadecimal digits of the seeded hash that cut a leaf into ranges


def shared_out(nodes: DataFrame, above: list[str], weight: Column) -> DataFrame:
    """Adds ``given``: the parent's tokens (``given``) split among siblings by weight, none over its room.

    What a full sibling cannot take goes to the others in proportion to their weights: with
    siblings ordered by room per weight, one is full exactly when the parent's tokens suffice to
    raise all others to the same level.
    """
    siblings = W.partitionBy(*above) if above else W.partitionBy(F.lit(1))
    order = siblings.orderBy(F.col("room") / F.col("w"), *[F.col(c).asc_nulls_first() for c in nodes.columns if c not in ("room", "given", "w")])
    ahead = order.rowsBetween(W.unboundedPreceding, -1)
    onward = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    return (nodes.withColumn("w", weight)
            .withColumn("full", F.coalesce(F.sum("room").over(ahead), F.lit(0.0)) + F.col("room") / F.col("w") * F.sum("w").over(onward) <= F.col("given"))
            .withColumn("left", F.col("given") - F.sum(F.when(F.col("full"), F.col("room")).otherwise(0.0)).over(siblings))
            .withColumn("others", F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(siblings))
            .withColumn("given", F.when(F.col("full"), F.col("room")).otherwise(F.col("left") * F.col("w") / F.col("others")))
            .drop("w", "full", "left", "others"))


def weight_of(column: Column, weights: dict[str, float]) -> Column:
    """A node's weight by its name; 1 where none is named."""
    out = F.lit(1.0)
    for name, value in weights.items():
        out = F.when(column == name, F.lit(float(value))).otherwise(out)
    return out


def allocation(leaves: DataFrame, levels: list[str], weights: list[dict[str, float]], budget: float, epochs: int) -> DataFrame:
    """Tokens for each leaf: (levels..., tokens, docs, given). ``budget`` is a share of all tokens."""
    room = leaves.withColumn("room", (F.col("tokens") * epochs).cast("double"))
    tree = None
    for depth in range(1, len(levels) + 1):
        nodes = room.groupBy(*levels[:depth]).agg(F.sum("room").alias("room"), F.sum("tokens").alias("own"))
        if tree is None:
            whole = W.partitionBy(F.lit(1))
            nodes = nodes.withColumn("given", F.least(F.sum("room").over(whole), F.floor(F.sum("own").over(whole) * budget).cast("double")))
        else:
            parent = tree.select(*[F.col(c).alias(f"up_{c}") for c in levels[:depth - 1]], "given")
            match = [F.col(c).eqNullSafe(F.col(f"up_{c}")) for c in levels[:depth - 1]]
            nodes = nodes.join(parent, match).drop(*[f"up_{c}" for c in levels[:depth - 1]])
        nodes = nodes.drop("own")
        tree = shared_out(nodes, levels[:depth - 1], weight_of(F.col(levels[depth - 1]), weights[depth - 1]))
    ends = tree.select(*[F.col(c).alias(f"up_{c}") for c in levels], F.floor(F.col("given") + 1e-6).cast("long").alias("given"))
    return leaves.join(ends, [F.col(c).eqNullSafe(F.col(f"up_{c}")) for c in levels]).drop(*[f"up_{c}" for c in levels])


def mix(docs: DataFrame, levels: dict[str, str], weights: list[dict[str, float]], budget: float, epochs: int = 1, tokens: Column | None = None, seed: int = 11, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The chosen rows of ``docs`` with all their columns, the tree's levels as ``mix_<level>``, ``mix_tokens`` and ``mix_epoch``.

    ``levels`` maps the tree's levels, from the top, to SQL expressions; ``weights`` gives siblings'
    weights by name at each level (1 if not named). ``budget`` is a share of all tokens, ``epochs``
    how often a document may be used. Tokens a leaf cannot supply go to its siblings first, and
    reach the parent's siblings only when all of its own are used up. A leaf's documents are taken
    in the order of a seeded hash, whole epochs first, then the longest prefix that fits.

    Nulls are leaves of their own. A null text has no tokens. Rows without tokens come with their
    place in the order. Rows equal in id and text share their place and are taken together or not
    at all. Long texts are counted whole. An empty table gives no rows. Columns of ``docs`` may have
    any name; those called like a column that is added are replaced by it.
    """
    count = tokens if tokens is not None else F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^ \x09-\x0D]+"))
    names = [f"mix_{c}" for c in levels]
    added = [*names, "mix_tokens", "mix_epoch"]
    kept = [c for c in docs.columns if c.lower() not in map(str.lower, added)]
    place = F.md5(F.concat_ws(":", F.coalesce(F.col(id).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")))))
    # Columns of the input go by number, so that no helper's name can clash with theirs.
    full = docs.select(*[F.expr(e).alias(c) for c, e in zip(names, levels.values())], count.cast("long").alias("mix_tokens"), place.alias("mix_place"),
                       *[F.col(f"`{c}`").alias(f"doc_column_{i}") for i, c in enumerate(kept)])
    rows = written(full.select(*names, "mix_tokens", "mix_place"), "mixing")
    leaves = rows.groupBy(*names).agg(F.sum("mix_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    given = (allocation(leaves, names, weights, budget, epochs)
             .withColumn("whole", F.when(F.col("tokens") > 0, F.floor(F.col("given") / F.col("tokens"))).otherwise(epochs).cast("int"))
             .withColumn("rest", F.col("given") - F.col("whole") * F.col("tokens"))
             .select(*[F.col(c).alias(f"at_{c}") for c in names], "whole", "rest"))
    given = written(given, "mixing-leaves")
    own = [F.col(c).eqNullSafe(F.col(f"at_{c}")) for c in names]
    # The order of the epoch that is taken in part.
    hashed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.col("mix_place")))
    partial = rows.join(given.where("rest > 0"), own).withColumn("hash", hashed).withColumn("range", F.substring("hash", 1, BUCKET_DIGITS))
    leaf = [f"at_{c}" for c in names]
    ranges = partial.groupBy(*leaf, "range", "rest").agg(F.sum("mix_tokens").alias("tokens"))
    up_to = W.partitionBy(*leaf).orderBy("range").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranges = ranges.withColumn("before", F.sum("tokens").over(up_to) - F.col("tokens"))
    border = (ranges.where("before <= rest AND before + tokens > rest")
              .select(*[F.col(c).alias(f"b_{c}") for c in leaf], F.col("range").alias("b_range"), "before"))
    border = written(border, "mixing-borders")
    inside = partial.join(border, [F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in leaf] + [F.col("range") == F.col("b_range")])
    in_range = W.partitionBy(*leaf).orderBy("hash").rangeBetween(W.unboundedPreceding, W.currentRow)
    cut = (inside.withColumn("sum", F.col("before") + F.sum("mix_tokens").over(in_range)).groupBy(*leaf)
           .agg(F.coalesce(F.max(F.when(F.col("sum") <= F.col("rest"), F.col("hash"))), F.min("b_range")).alias("last")))
    cut = cut.select(*[F.col(c).alias(f"c_{c}") for c in leaf], "last")
    # Leaves whose rest is zero keep no document of the next epoch: an empty text sorts before every hash.
    ends = written(given.join(cut, [F.col(c).eqNullSafe(F.col(f"c_{c}")) for c in leaf], "left")
                   .select(*leaf, "whole", F.coalesce("last", F.lit("")).alias("last")), "mixing-ends")
    chosen = full.join(ends, own).withColumn("times", F.col("whole") + (F.coalesce(hashed, F.lit("")) <= F.col("last")).cast("int"))
    if epochs == 1:
        chosen = chosen.where("times > 0").withColumn("mix_epoch", F.lit(1))
    else:
        chosen = chosen.where("times > 0").withColumn("mix_epoch", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return chosen.select(*[F.col(f"doc_column_{i}").alias(c) for i, c in enumerate(kept)], *added)
