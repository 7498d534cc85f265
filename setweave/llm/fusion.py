"""One ranking from several scores of different scales: mean of normal scores of the empirical percentiles."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from setweave.runtime import if_small, stash

# The coefficients of Wichura's algorithm AS 241 (PPND16) for the inverse of the normal distribution,
# numerator and denominator by falling power, for the middle, the near tail and the far tail.
CENTRE = ((2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.387132872796366608e0),
          (5.226495278852545925e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0))
NEAR = ((7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e0, 3.64784832476320460504e0, 5.76949722146069140550e0, 4.63033784615654529590e0, 1.42343711074968357734e0),
        (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e0, 2.05319162663775882187e0, 1.0))
FAR = ((2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580e0, 5.46378491116411436990e0, 6.65790464350110377720e0),
       (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0))


def normal_quantile_sql(p: str, double: str = "D") -> str:
    """The inverse normal distribution of the SQL expression ``p`` in (0, 1); ``double`` marks literals as doubles."""
    poly = lambda cs, x: "(" * (len(cs) - 1) + f"{cs[0]!r}{double}" + "".join(f" * {x} + {c!r}{double})" for c in cs[1:])
    ratio = lambda part, x: f"({poly(part[0], x)}) / ({poly(part[1], x)})"
    q, r = f"({p} - 0.5{double})", f"sqrt(-ln(least({p}, 1{double} - {p})))"
    centre = f"{q} * {ratio(CENTRE, f'(0.180625{double} - {q} * {q})')}"
    tail = f"CASE WHEN {r} <= 5 THEN {ratio(NEAR, f'({r} - 1.6{double})')} ELSE {ratio(FAR, f'({r} - 5{double})')} END"
    return f"CASE WHEN abs({q}) <= 0.425{double} THEN {centre} WHEN {q} < 0 THEN -({tail}) ELSE {tail} END"


#: Distinct values of one score of one list above which their order is worked out in several tasks.
SPLIT_ABOVE = 1_000_000
#: Pieces that such an order is split into.
PIECES = 256


def percentiles(values: DataFrame, keys: list[str], value: str, split_above: int = SPLIT_ABOVE, pieces: int = PIECES) -> DataFrame:
    """``keys, value, p``: the empirical percentile of each distinct value, (values below + half of those equal) / all.

    Equal values are counted together before anything is sorted. Where a key has more than ``split_above`` distinct
    values, approximate quantiles cut them into ``pieces``; the counts of the pieces before are added, so the result is
    exact wherever the cuts fall and no task sorts a hot key alone.
    """
    counts = stash(values.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c")), "counts")
    hot = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("d")).where(F.col("d") > split_above).drop("d")
    at = [(i + 1) / pieces for i in range(pieces - 1)]
    cuts = counts.join(hot, keys, "left_semi").groupBy(*keys).agg(F.percentile_approx(value, at, 10 * pieces).alias("cuts"))
    piece = F.coalesce(F.size(F.filter("cuts", lambda x: x < F.col(value))), F.lit(0))
    placed = counts.join(cuts, keys, "left").select(*keys, value, "c", F.when(F.col("cuts").isNull(), 0).otherwise(piece).alias("piece"))
    totals = placed.groupBy(*keys, "piece").agg(F.sum("c").alias("pc"))
    whole = W.partitionBy(*keys)
    before = F.coalesce(F.sum("pc").over(whole.orderBy("piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(*keys, "piece", before.alias("before"), F.sum("pc").over(whole).alias("n"))
    run = F.sum("c").over(W.partitionBy(*keys, "piece").orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    p = (F.col("before") + F.col("run") - F.col("c") / 2) / F.col("n")
    return placed.withColumn("run", run).join(totals, [*keys, "piece"]).select(*keys, value, p.alias("p"))


def latest(rows: DataFrame, keys: list[str], columns: list[str], at: str) -> DataFrame:
    """Of the rows of one key the latest; of equally late ones the largest values. Rows with a null key are left out."""
    whole = rows.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    return whole.groupBy(*keys).agg(F.max(F.struct(F.col(at).alias("at"), *[F.col(c).cast("double").alias(c) for c in columns])).alias("r")).select(*keys, *[f"r.{c}" for c in columns])


def known(x: Column) -> Column:
    """Whether a score says anything: not null, not NaN, not infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def _of_whole_lists(current: DataFrame, scores: Mapping[str, float]) -> DataFrame:
    """The mean normal scores of lists that one task can order: one shuffle by list, then a sort for each score."""
    for k, name in enumerate(scores):
        by = W.partitionBy("list_id").orderBy(F.col(name).asc_nulls_last())
        below, upto, n = F.rank().over(by) - 1, F.count(name).over(by), F.count(name).over(by.rangeBetween(W.unboundedPreceding, W.unboundedFollowing))
        # each normal score is worked out between two sorts, so no one stage of generated code has them all
        current = current.withColumn("p", F.when(F.col(name).isNotNull(), (below + upto) / (2 * n))).withColumn(f"z{k}", F.expr(normal_quantile_sql("p"))).withColumn(f"z{k}", F.when(F.col("p").isNotNull(), F.col(f"z{k}"))).drop("p", name)
    weights = [F.lit(float(w)) for w in scores.values()]
    add = lambda parts: sum(parts[1:], parts[0])
    total = add([F.coalesce(w * F.col(f"z{k}"), F.lit(0.0)) for k, w in enumerate(weights)])
    weight = add([F.when(F.col(f"z{k}").isNotNull(), w).otherwise(0.0) for k, w in enumerate(weights)])
    n_scores = add([F.col(f"z{k}").isNotNull().cast("bigint") for k in range(len(weights))])
    return current.select("list_id", "entity_id", (total / weight).alias("score"), n_scores.alias("n_scores")).where("n_scores > 0")


def _of_split_lists(current: DataFrame, scores: Mapping[str, float], split_above: int, pieces: int) -> DataFrame:
    """The same of lists whose order is worked out in several tasks."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("s"), F.col(s).alias("v"), F.lit(float(w)).alias("w")) for i, (s, w) in enumerate(scores.items())])).alias("x")
    long = current.select("list_id", "entity_id", each).select("list_id", "entity_id", "x.s", "x.v", "x.w").where("v IS NOT NULL")
    ranks = percentiles(long, ["list_id", "s"], "v", split_above, pieces).select("list_id", "s", "v", F.expr(normal_quantile_sql("p")).alias("z"))
    mean = F.sum(F.col("w") * F.col("z")) / F.sum("w")
    return long.join(ranks, ["list_id", "s", "v"]).groupBy("list_id", "entity_id").agg(mean.alias("score"), F.count(F.lit(1)).alias("n_scores"))


def fuse(rows: DataFrame, scores: Mapping[str, float], list_col: str = "list_id", entity_col: str = "entity_id", at: str = "scored_at", split_above: int = SPLIT_ABOVE, pieces: int = PIECES) -> DataFrame:
    """``list_id, entity_id, score, n_scores``: the weighted mean of the normal scores that an entity has.

    A score's percentile within its list is mapped through the inverse normal distribution, so neither range nor shape
    of a score matters. A missing score (null, NaN, infinite) is left out of the mean, it neither helps nor harms; an
    entity without any has no row. A score on which all entities are equal counts 0 for each. Lists of more than
    ``split_above`` entities are ordered in pieces, the others whole.
    """
    clean = [F.when(known(F.col(s)), F.col(s) + 0.0).alias(s) for s in scores]
    current = latest(rows.select(F.col(list_col).alias("list_id"), F.col(entity_col).alias("entity_id"), F.col(at).alias("at_"), *[F.col(s).alias(s) for s in scores]), ["list_id", "entity_id"], list(scores), "at_")
    current = stash(current.select("list_id", "entity_id", *clean), "current")
    long_lists = stash(current.groupBy("list_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > split_above).select("list_id"), "long_lists")
    if long_lists.isEmpty():
        return _of_whole_lists(current, scores)
    whole, split = (current.join(if_small(long_lists), "list_id", how) for how in ("left_anti", "left_semi"))
    return _of_whole_lists(whole, scores).unionByName(_of_split_lists(split, scores, split_above, pieces))


def best(ranking: DataFrame, k: int) -> DataFrame:
    """The ``k`` first of each list, ``rank`` from 1; ties by entity. Tasks cut to k before anything is shuffled."""
    order = W.partitionBy("list_id").orderBy(F.round("score", 9).desc(), "entity_id")
    return ranking.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
