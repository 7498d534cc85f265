"""Algebra of entity lists: tables ``entity, weight`` (and ``score``), one row per entity."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from setweave.functions.text import gaussian
from setweave.runtime import stash

TINY = 1e-8
MIN_LENGTH_PROBABILITY = 1e-4
MIN_LENGTH_RATIO = 0.1
KEEP_ABOVE, KEEP = 10_000, 5_000


def _whole(df: DataFrame, **aggregates: Column) -> DataFrame:
    """``df`` with aggregates over all its rows, which are worked out in partial sums and joined as one row. The list is
    written once before, as it is read twice."""
    df = stash(df, "list")
    return df.crossJoin(F.broadcast(df.agg(*[c.alias(k) for k, c in aggregates.items()])))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Entities of both; of those in both, ``b``'s."""
    return a.join(b, "entity", "left_anti").unionByName(b)


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Entities of both, weights added."""
    return a.select("entity", "weight").unionByName(b.select("entity", "weight")).groupBy("entity").agg(F.sum("weight").alias("weight"))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "entity", "left_semi")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "entity", "left_anti")


def overlap(a: DataFrame, b: DataFrame) -> bool:
    return not intersect(a, b).isEmpty()


def interpolate(a: DataFrame, b: DataFrame, ratio: float) -> DataFrame:
    """Entities of both, ``ratio`` of ``a``'s weight and the rest of ``b``'s; only positive ones stay."""
    other = b.select("entity", F.col("weight").alias("other"))
    return a.join(other, "entity").select("entity", (ratio * F.col("weight") + (1 - ratio) * F.col("other")).alias("weight")).where("weight > 0")


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """Entities of both, weights multiplied; only positive ones stay."""
    other = b.select("entity", F.col("weight").alias("other"))
    return a.join(other, "entity").select("entity", (F.col("weight") * F.col("other")).alias("weight")).where("weight > 0")


def at_least(df: DataFrame, value: float) -> DataFrame:
    return df.where(F.col("weight") >= value)


def at_least_of_max(df: DataFrame, ratio: float) -> DataFrame:
    """Weights of at least ``ratio`` of the greatest."""
    return _whole(df, _m=F.max("weight")).where(F.col("weight") >= F.col("_m") * ratio).drop("_m")


def at_least_mean(df: DataFrame) -> DataFrame:
    return _whole(df, _m=F.avg("weight")).where(F.col("weight") >= F.col("_m")).drop("_m")


def natural_order(by: str = "weight") -> list[Column]:
    """Greatest first; of equal ones the shorter name, then the smaller."""
    return [F.col(by).desc(), F.length("entity"), F.col("entity")]


def top(df: DataFrame, k: int, least: float | None = None, by: str = "weight") -> DataFrame:
    """The first ``k`` in natural order whose value is there and at least ``least``; tasks keep only their own ``k``."""
    known = df.where(F.col(by).isNotNull()) if least is None else df.where(F.col(by) >= least)
    return known.orderBy(*natural_order(by)).limit(k)


def ranked(df: DataFrame, k: int, by: str = "weight") -> DataFrame:
    """``top`` with ``rank`` from 1; the window runs over ``k`` rows only."""
    return top(df, k, by=by).withColumn("rank", F.row_number().over(W.orderBy(*natural_order(by))))


def numbered(df: DataFrame, keys: Sequence[str] = (), by: str = "weight", order: Sequence[Column] | None = None) -> DataFrame:
    """``df`` with ``rank`` from 1 over the whole list in natural order (or ``order``), or over the list of each of ``keys``.

    The order is split by range, wherever the cuts fall; a piece's ranks go on from the counts of the pieces before it,
    so ranks are exact and no task sorts a long list alone. The pieces are written once, as ranges come from a sample.
    """
    keys, order = list(keys), list(order or natural_order(by))
    placed = stash(df.repartitionByRange(*keys, *order).withColumn("_piece", F.spark_partition_id()), "pieces")
    counts = placed.groupBy(*keys, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_piece").alias("_at"), F.coalesce(before, F.lit(0)).alias("_before"))
    same = F.col("_piece") == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    rank = F.col("_before") + F.row_number().over(W.partitionBy(*keys, "_piece").orderBy(*order))
    return placed.join(offsets, same).select(*df.columns, rank.alias("rank"))


def reduce_size(df: DataFrame, above: int = KEEP_ABOVE, keep: int = KEEP) -> DataFrame:
    """A list of more than ``above`` entities cut to the ``keep`` first, less the weight of the first one cut off."""
    if df.limit(above + 1).count() <= above:
        return df
    best = ranked(df, keep + 1)
    last = best.where(F.col("rank") == keep + 1).select(F.col("weight").alias("_w"))
    return best.where(F.col("rank") <= keep).crossJoin(F.broadcast(last)).withColumn("weight", F.col("weight") - F.col("_w")).drop("_w", "rank")


def unique_relations(df: DataFrame, kind: int) -> DataFrame:
    """Pairs ``arg1, arg2, rank`` of a ranked list: the first of each arg1 (1), of each arg2 (2), or (3) those of which
    neither part was taken before, in the order of the list. ``rank`` is anything that has an order, and unique.

    Kind 3 is sequential, but what it takes depends on few pairs: later pairs of an arg1 change nothing, and a pair takes
    its arg2 unless its arg1 is the arg2 that an earlier pair took. Rounds settle all pairs of which the earlier ones are
    settled; there are as many rounds as the longest chain of such pairs has links.
    """
    if kind in (1, 2):
        by = f"arg{kind}"
        return df.withColumn("_k", F.row_number().over(W.partitionBy(by).orderBy("rank"))).where("_k = 1").drop("_k")
    columns = df.columns
    state = stash(unique_relations(df, 1).withColumn("_takes", F.lit(None).cast("boolean")), "relations")
    while not state.where("_takes IS NULL").isEmpty():
        rank, takes = F.col("rank"), F.col("_takes")
        taken = state.where("_takes IS NULL OR _takes").groupBy(F.col("arg2").alias("_arg")).agg(F.min(F.when(takes, rank)).alias("_sure"), F.min(F.when(takes.isNull(), rank)).alias("_perhaps"))
        settled = F.when(takes.isNotNull(), takes).when(F.col("_sure") < rank, False).when(F.col("_perhaps") < rank, F.lit(None)).otherwise(True)
        state = stash(state.join(taken, F.col("arg1").eqNullSafe(F.col("_arg")), "left").select(*columns, settled.alias("_takes")), "relations")
    firsts = unique_relations(state.where("_takes"), 2).select(*columns)
    names = state.select(F.col("arg1").alias("_arg"), F.col("rank").alias("_rank"))
    return firsts.join(names, F.col("arg2").eqNullSafe(F.col("_arg")) & (F.col("_rank") <= F.col("rank")), "left_anti")


def _spread(weight: Column, least: Column, most: Column, seeds: Column | None) -> Column:
    w = weight if seeds is None else F.when(seeds, most + weight * TINY).otherwise(weight)
    return (w - least) / (most + F.abs(most) * TINY - least)


def _for_length(score: Column, n: Column, mean: Column, sigma: Column) -> Column:
    p = gaussian(n, mean, sigma)
    return F.when(sigma == 0, score).when(p < MIN_LENGTH_PROBABILITY, 0.0).otherwise(score + p * TINY)


def assign_score(df: DataFrame, seeds: Column | None = None) -> DataFrame:
    """``score`` in [0, 1) from weights; entities for which ``seeds`` holds go above all others."""
    spread = _whole(df, _min=F.min("weight") - TINY, _max=F.max("weight"))
    return spread.withColumn("score", _spread(F.col("weight"), F.col("_min"), F.col("_max"), seeds)).drop("_min", "_max")


def score_by_length(df: DataFrame) -> DataFrame:
    """Scores with a small bonus for names of usual length, and 0 for very unusual ones; as they are if all are as long."""
    n = F.length("entity").cast("double")
    stats = _whole(df, _avg=F.avg(n), _sigma=F.stddev_pop(n))
    return stats.withColumn("score", _for_length(F.col("score"), n, F.col("_avg"), F.col("_sigma"))).drop("_avg", "_sigma")


def scored(df: DataFrame, seeds: Column | None = None) -> DataFrame:
    """``assign_score`` and ``score_by_length`` at once: one aggregation serves both."""
    n = F.length("entity").cast("double")
    whole = _whole(df, _min=F.min("weight") - TINY, _max=F.max("weight"), _avg=F.avg(n), _sigma=F.stddev_pop(n))
    score = _for_length(_spread(F.col("weight"), F.col("_min"), F.col("_max"), seeds), n, F.col("_avg"), F.col("_sigma"))
    return whole.withColumn("score", score).drop("_min", "_max", "_avg", "_sigma")


def shrink(df: DataFrame, power: float = 1.0) -> DataFrame:
    """Names that are a longer name's beginning or end (at a space, if any name has one) give it their weight.

    From the longest name on, a shorter one of less than ``power`` times its weight is looked for; if it has the greater
    weight, that goes to the longer name, and the shorter one gets 0. As weights move on the way, a list is one group
    here: it takes a list that was cut to a bounded size (``reduce_size``), and raises ``ValueError`` for a longer one.
    Names of equal length go by weight, then name.
    """
    if df.limit(KEEP_ABOVE + 1).count() > KEEP_ABOVE:
        raise ValueError(f"a list of more than {KEEP_ABOVE} entities has to be cut by reduce_size first")

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        order = sorted(zip(rows.entity, rows.weight), key=lambda r: (-len(r[0]), -r[1], r[0]))
        names, weights = [r[0] for r in order], [r[1] for r in order]
        gap = " " if any(" " in n for n in names) else ""
        at = {n: i for i, n in enumerate(names)}
        for i, name in enumerate(names):
            own = weights[i]
            ends = {name[:k] for k in range(1, len(name)) if name[k : k + len(gap)] == gap} | {name[k + len(gap) :] for k in range(len(name) - len(gap)) if name[k : k + len(gap)] == gap}
            for j in sorted(at[x] for x in ends if x in at and 0 < len(x) < len(name)):
                other = weights[j]
                if other and own * power > other and len(names[j]) / len(name) >= MIN_LENGTH_RATIO and other > own:
                    weights[i], weights[j] = other, 0.0
        return pd.DataFrame({"entity": names, "weight": weights})

    return df.select("entity", "weight").withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(walk, "entity string, weight double")


def promote(df: DataFrame, suffix: str, share: float = 0.1, by: str = "score") -> DataFrame:
    """Names that end with a class get a share of what they lack to 1."""
    return df.withColumn(by, F.when(F.col("entity").endswith(suffix), F.col(by) + (1 - F.col(by)) * share).otherwise(F.col(by)))


def stats(df: DataFrame, least: float = 0.0) -> DataFrame:
    """One row about a list."""
    w = F.col("weight")
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(w >= least).alias("n_least"), F.sum(w).alias("total"), F.avg(w).alias("mean"), F.max(w).alias("greatest"), F.sum(F.when(w > 0, F.log(w))).alias("total_log"), F.min(F.length("entity")).alias("shortest"))


def without_containing(df: DataFrame, text: str) -> DataFrame:
    return df.where(~F.col("entity").contains(text))


def has_space(c: Column) -> Column:
    return c.contains(" ")


def is_relational(c: Column) -> Column:
    return c.contains("::")


def shuffled(df: DataFrame, seed: int) -> list[Column]:
    """A repeatable order that looks random."""
    return [F.xxhash64(F.lit(seed), "entity"), F.col("entity")]


def rescaled(df: DataFrame, weight: str = "weight", margin: float = 1e-10) -> DataFrame:
    """``doc_score``: weights between the least and the greatest."""
    whole = _whole(df, _min=F.min(weight) - margin, _max=F.max(weight) + margin)
    return whole.withColumn("doc_score", (F.col(weight) - F.col("_min")) / (F.col("_max") - F.col("_min"))).drop("_min", "_max")
