"""Mixing of sources to target shares of the total size.

Targets stand at the leaves of a tree (domain, language, source). Weights are propagated to the
leaves as budgets in tokens; a leaf that can't fill its budget, even with every document repeated
as often as allowed, leaves a shortage that goes to its siblings with room first and only then to
the ancestors' other branches. A leaf's documents are drawn in epochs: an epoch is an order by a
seeded hash, whole epochs are taken while the budget lasts and of the last one a prefix by tokens.

Leaves, budgets and documents are all distributed, so there may be any number of each: a node's
shortage is spread by running sums over its leaves. Sizes are summed before the shuffle, and a
prefix is found from the sums of hash slices and then inside one slice only, so a leaf with a third
of all rows is never sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens of a budget that are nothing, in parts of the total.
_NOTHING = 1e-12


def leaf_sizes(sizes: DataFrame, path: Sequence[str], tokens: str = "n_tokens") -> DataFrame:
    """Every leaf's ``path``, tokens and documents; documents without a size count as 0 tokens."""
    return sizes.groupBy(*path).agg(F.coalesce(F.sum(tokens), F.lit(0)).cast("bigint").alias("tokens"), F.count(F.lit(1)).alias("documents"))


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    on = F.lit(True)
    for a, b in zip(left, right, strict=True):
        on = on & F.col(a).eqNullSafe(F.col(b))
    return on


def leaves(targets: DataFrame, found: DataFrame, path: Sequence[str]) -> DataFrame:
    """The tree's leaves: the weight of each target falls to the leaves of its source in the parts they have of its tokens.

    ``targets`` has the last part of ``path`` (the source), weight and max_repeats, once for each source;
    ``found`` comes from :func:`leaf_sizes`. A source that has no tokens is one leaf with its whole
    weight and nothing to give. Leaves of other sources have no part in the mix.
    """
    source = path[-1]
    wanted = targets.select(F.col(source).alias("_s"), "weight", "max_repeats")
    own = found.join(wanted, F.col(source).eqNullSafe(F.col("_s"))).where("tokens > 0")
    part = F.col("tokens") / F.sum("tokens").over(Window.partitionBy(source))
    real = own.select(*path, (F.col("weight") * part).alias("weight"), "max_repeats", "tokens", "documents")
    empty = wanted.join(found.where("tokens > 0").select(F.col(source).alias("_f")).distinct(), F.col("_s").eqNullSafe(F.col("_f")), "left_anti")
    zero = F.lit(0).cast("bigint")
    return real.unionByName(empty.select(*[(F.col("_s") if c == source else F.lit(None).cast("string")).alias(c) for c in path], "weight", "max_repeats", zero.alias("tokens"), zero.alias("documents")))


def budgets(tree: DataFrame, path: Sequence[str], total: float) -> DataFrame:
    """``tree`` (path, weight, max_repeats, tokens) with the tokens of each leaf in a mix of ``total``: ``want``, ``initial`` and ``given``.

    ``want`` is the weight's part of the total, ``initial`` that or all the leaf can give (its tokens
    max_repeats times) if that is less. Then, from the deepest level to the root, each node's shortage
    is spread over the leaves below it that have room, in proportion to their weights: of the leaves,
    in the order in which they would run out, the running sums tell how much each can take. What no
    leaf can give is missing from the mix. Weights that are null, negative or not a number count as
    0, and a leaf of weight 0 gives nothing; null or negative repeats are 0. Paths need be unique.
    """
    total = float(total)
    weight = F.when(F.col("weight") > 0, F.nanvl(F.col("weight"), F.lit(0.0))).otherwise(0.0)
    rows = tree.withColumn("_w", weight).withColumn("_capacity", F.coalesce(F.col("tokens") * F.greatest(F.col("max_repeats"), F.lit(0)), F.lit(0)).cast("double"))
    rows = rows.withColumn("want", F.col("_w") * total).withColumn("initial", F.least("want", "_capacity")).withColumn("given", F.col("initial"))
    for level in range(len(path) - 1, -1, -1):
        keys = [F.col(c) for c in path[:level]] or [F.lit(0)]
        node = Window.partitionBy(*keys)
        rows = rows.withColumn("_room", F.when(F.col("_w") > 0, F.col("_capacity") - F.col("given")).otherwise(0.0))
        rows = rows.withColumn("_missing", F.sum("want").over(node) - F.sum("given").over(node))
        # A leaf runs out when each unit of weight has taken _end more.
        rows = rows.withColumn("_end", F.when(F.col("_w") > 0, F.col("_room") / F.col("_w")).otherwise(0.0))
        order = node.orderBy("_end", *path).rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("_room").over(order), F.lit(0.0))
        left = F.sum("_w").over(node) - F.coalesce(F.sum("_w").over(order), F.lit(0.0))
        rows = rows.withColumn("_step", F.when(F.col("_w") > 0, (F.col("_missing") - before) / left))
        # What all take together is a concave function of what a unit of weight takes, made of these straight lines.
        taken = F.least("_room", F.col("_w") * F.coalesce(F.max("_step").over(node), F.lit(0.0)))
        rows = rows.withColumn("given", F.when(F.col("_missing") > total * _NOTHING, F.col("given") + F.greatest(taken, F.lit(0.0))).otherwise(F.col("given")))
    return rows.drop("_w", "_capacity", "_room", "_missing", "_end", "_step")


def shortfalls(planned: DataFrame, source: str, total: float) -> DataFrame:
    """The sources whose leaves can't fill what they want, by the plan of :func:`budgets`."""
    return planned.groupBy(source).agg(F.sum(F.col("want") - F.col("initial")).alias("_short")).where(F.col("_short") > float(total) * _NOTHING).select(source)


def select_mix(sizes: DataFrame, path: Sequence[str], planned: DataFrame, doc_id: str = "doc_id", tokens: str = "n_tokens", seed: int = 0, slices: int = 1024) -> DataFrame:
    """The documents of the mix: ``path``, ``doc_id``, ``n_tokens`` and ``copies``, how often each is used.

    ``sizes`` has one row per document with ``path``, ``doc_id`` and ``tokens``; ``planned`` comes from
    :func:`budgets`. A document is drawn if the tokens before it in its leaf's epoch are less than what
    the epoch still needs, so a leaf exceeds its budget by less than one document. Documents without
    tokens fill nothing and aren't drawn. Equal ids are ordered by nothing else and may be drawn together.
    """
    own = F.col("_tokens")
    plan = planned.where("given > 0 AND tokens > 0").select(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(path)], F.col("tokens").alias("_tokens"), "max_repeats", "given")
    plan = plan.withColumn("_full", F.least(F.floor(F.col("given") / own), F.col("max_repeats")).cast("int"))
    plan = plan.withColumn("_rest", F.when(F.col("_full") < F.col("max_repeats"), F.col("given") - F.col("_full") * own).otherwise(0.0)).drop("_tokens", "max_repeats", "given")
    same = _same(path, [f"_p{i}" for i in range(len(path))])
    # The plan has one row per leaf; Spark broadcasts it if its size allows.
    rows = sizes.join(plan, same).where(F.col(tokens) > 0)
    order = F.xxhash64(F.lit(seed), F.col("_full"), F.col(doc_id))
    rows = rows.withColumn("_h", order).withColumn("_slice", F.shiftright(F.col("_h"), 48).cast("int") + F.lit(32768))
    rows = rows.withColumn("_slice", (F.col("_slice") / F.lit(65536 // slices)).cast("int"))
    leaf = [f"_p{i}" for i in range(len(path))]
    sums = rows.groupBy(*leaf, "_slice", "_rest").agg(F.sum(tokens).alias("_t"))
    before = Window.partitionBy(*leaf).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_t").over(before), F.lit(0)))
    sums = sums.select(*[F.col(c).alias(f"_s{c}") for c in (*leaf, "_slice")], "_before", (F.col("_before") + F.col("_t") <= F.col("_rest")).alias("_in"), ((F.col("_before") < F.col("_rest")) & (F.col("_before") + F.col("_t") > F.col("_rest"))).alias("_border"))
    on = (F.col("_slice") == F.col("_s_slice")) & _same(leaf, [f"_s{c}" for c in leaf])
    placed = rows.join(sums, on)
    inside = Window.partitionBy(*leaf, "_slice").orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
    border = placed.where("_border").withColumn("_at", F.col("_before") + F.coalesce(F.sum(tokens).over(inside), F.lit(0))).withColumn("_extra", (F.col("_at") < F.col("_rest")).cast("int"))
    other = placed.where(~F.col("_border")).withColumn("_at", F.lit(None).cast("bigint")).withColumn("_extra", F.col("_in").cast("int"))
    drawn = border.unionByName(other).withColumn("copies", F.col("_full") + F.col("_extra"))
    return drawn.where(F.col("copies") > 0).select(*path, doc_id, F.col(tokens).alias("n_tokens"), "copies")
