"""Weights of entities from extractions: frequencies, pattern length, Bayesian sets, random walks.

Facts are rows (doc, wrapper, entity, tf, ctx_len, doc_len). The frequency weights are single aggregations with map-side
combining; Bayesian sets are two aggregations and joins by feature and entity; the walks iterate over the graph's edges
as a table, each round one join and one aggregation, with the state written to the shared folder between rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setweave.runtime import stash

EPSILON = 1e-10
MAX_ROUNDS = 50
CONVERGED = 1e-3


def term_frequency(facts: DataFrame) -> DataFrame:
    """``entity, weight``: how often an entity was extracted."""
    return facts.groupBy("entity").agg(F.sum("tf").cast("double").alias("weight"))


def document_frequency(facts: DataFrame) -> DataFrame:
    """On how many pages."""
    return facts.groupBy("entity").agg(F.count_distinct("doc").cast("double").alias("weight"))


def pattern_frequency(facts: DataFrame) -> DataFrame:
    """By how many patterns; the same contexts on another page are another pattern."""
    return facts.select("entity", "doc", "wrapper").where("doc IS NOT NULL AND wrapper IS NOT NULL").distinct().groupBy("entity").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def pattern_length(facts: DataFrame) -> DataFrame:
    """The sum over patterns of the length of their contexts to that of the page, in logarithms."""
    each = facts.where("ctx_len > 0 AND doc_len > 1").groupBy("entity", "doc", "wrapper").agg(F.max(F.log("ctx_len") / F.log("doc_len")).alias("w"))
    return each.groupBy("entity").agg(F.sum("w").alias("weight"))


def features(facts: DataFrame) -> DataFrame:
    """``entity, feature``: the pages and contexts that an entity has, once each."""
    each = F.explode(F.array(F.concat(F.lit("d:"), F.col("doc").cast("string")), F.concat(F.lit("w:"), F.col("wrapper").cast("string")))).alias("feature")
    return facts.where("entity IS NOT NULL").select("entity", each).where("feature IS NOT NULL").distinct()


def bayesian_sets(facts: DataFrame, seeds: Sequence[str], log: bool = True) -> DataFrame:
    """Bayesian-sets score of each entity for the seeds, in logarithms unless ``log`` is false.

    Feature by feature, beta priors are set from the feature's mean over all entities; N is the number of seeds, whether
    they were extracted or not.
    """
    cells = stash(features(facts), "cells")
    seeds = list(dict.fromkeys(seeds))
    n_entities = cells.groupBy("entity").agg(F.first("entity")).agg(F.count(F.lit(1)).alias("n_entities"))
    n = len(seeds)
    stats = cells.groupBy("feature").agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("entity").isin(seeds)).alias("k")).crossJoin(F.broadcast(n_entities))
    mean = F.col("m") / F.col("n_entities")
    alpha, beta = 2 * mean + EPSILON, 2 * (1 - mean) + EPSILON
    alpha2, beta2 = alpha + F.col("k"), beta + n - F.col("k")
    stats = stats.select("feature", (F.log(alpha2) - F.log(alpha) - F.log(beta2) + F.log(beta)).alias("has"), (F.log(alpha + beta) - F.log(alpha + beta + n) + F.log(beta2) - F.log(beta)).alias("base"))
    base = stats.agg(F.sum("base").alias("base"))
    score = F.sum("has") + F.first("base")
    scored = cells.join(stats.drop("base"), "feature").crossJoin(F.broadcast(base)).groupBy("entity").agg(score.alias("weight"))
    return scored if log else scored.withColumn("weight", F.exp("weight"))


def binarized(cells: DataFrame) -> DataFrame:
    """Of ``row, col, value`` the cells whose share of their row is above twice the column's mean share."""
    sums = cells.groupBy("row").agg(F.sum("value").alias("row_sum"))  # not a window: one row may hold a third of all cells
    shares = cells.join(sums, "row").withColumn("share", F.col("value") / F.col("row_sum")).drop("row_sum")
    rows = cells.agg(F.count_distinct("row").alias("n"))
    means = shares.groupBy("col").agg(F.sum("share").alias("total")).crossJoin(F.broadcast(rows)).select("col", (F.col("total") / F.col("n")).alias("mean"))
    return shares.join(means, "col").where(F.col("share") > 2 * F.col("mean")).select("row", "col")


def graph(facts: DataFrame) -> DataFrame:
    """``src, label, dst``: pages contain patterns and contents, patterns extract contents, and the inverse of each edge.

    A pattern is known by its contexts, so the same contexts on two pages are one node; the kind of a node is part of its
    name, so a content never meets a page.
    """
    d, w, c = (F.concat(F.lit(f"{k}:"), F.col(x).cast("string")) for k, x in (("d", "doc"), ("w", "wrapper"), ("c", "entity")))
    three = F.explode(F.array(F.struct(d.alias("src"), F.lit("contain").alias("label"), w.alias("dst")), F.struct(w.alias("src"), F.lit("extract").alias("label"), c.alias("dst")), F.struct(d.alias("src"), F.lit("contain").alias("label"), c.alias("dst")))).alias("e")
    one_way = facts.select(three).select("e.*").where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    both = F.explode(F.array(F.struct("src", "label", "dst"), F.struct(F.col("dst").alias("src"), F.concat("label", F.lit("By")).alias("label"), F.col("src").alias("dst")))).alias("e")
    return one_way.select(both).select("e.*")


def transitions(edges: DataFrame, labelled: bool = True) -> DataFrame:
    """``src, dst, p``: a label of the node is chosen uniformly, then a neighbour; without labels, a neighbour's weight
    is that of any label times that of any neighbour."""
    labels = edges.groupBy("src").agg(F.count_distinct("label").alias("labels"), F.count_distinct("dst").alias("neighbours"))
    if not labelled:
        return edges.select("src", "dst").distinct().join(labels, "src").select("src", "dst", (1 / (F.col("labels") * F.col("neighbours"))).alias("p"))
    fan = edges.groupBy("src", "label").agg(F.count(F.lit(1)).alias("fan"))
    p = F.sum(1 / (F.col("labels") * F.col("fan")))
    return edges.join(fan, ["src", "label"]).join(labels.drop("neighbours"), "src").groupBy("src", "dst").agg(p.alias("p"))


def matvec(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """``id, value``: of a matrix ``row, col, value`` and a vector ``id, value``."""
    v = vector.select(F.col("id").alias("col"), F.col("value").alias("v"))
    return matrix.join(v, "col").groupBy(F.col("row").alias("id")).agg(F.sum(F.col("value") * F.col("v")).alias("value"))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """``row, col, value``: the product of two matrices."""
    right = b.select(F.col("row").alias("k"), F.col("col").alias("c"), F.col("value").alias("v"))
    return a.join(right, a["col"] == right["k"]).groupBy("row", "c").agg(F.sum(F.col("value") * F.col("v")).alias("value")).select("row", F.col("c").alias("col"), "value")


def normalized(vector: DataFrame, value: str = "value") -> DataFrame:
    """A vector divided by its sum; as it is if the sum isn't positive."""
    total = vector.agg(F.sum(value).alias("_total"))
    return vector.crossJoin(F.broadcast(total)).withColumn(value, F.when(F.col("_total") > 0, F.col(value) / F.col("_total")).otherwise(F.col(value))).drop("_total")


def distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the Euclidean distance of two vectors; a missing component is 0."""
    x, y = a.select("id", F.col("value").alias("x")), b.select("id", F.col("value").alias("y"))
    d = F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0))
    return x.join(y, "id", "full").agg(F.coalesce(F.sqrt(F.sum(d * d)), F.lit(0.0)).alias("distance"))


#: Rounds of a walk after which its state is written, so that lineage stays short.
WRITE_EVERY = 5


def _walk(moves: DataFrame, state: DataFrame, total: float, back: Callable[[DataFrame], DataFrame], damping: float, rounds: int, converged: float | None, next_total: Callable[[float], float] | None) -> DataFrame:
    """Rounds of a walk from ``state`` with the sum ``total``. ``back`` adds what doesn't come along edges; the sum of the
    next state is what ``next_total`` says, without it a sum over the written state. A state is written where it is needed
    twice, and after some rounds."""
    for k in range(rounds):
        moved = moves.join(state.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg((F.sum(F.col("p") * F.col("value")) * (damping / total)).alias("value"))
        new = back(moved)
        if converged is not None or next_total is None or k % WRITE_EVERY == WRITE_EVERY - 1:
            new = stash(new, "state")
        if converged is not None and distance(new, state.withColumn("value", F.col("value") / total)).first()["distance"] < converged:
            return new
        total = next_total(total) if next_total else new.agg(F.sum("value")).first()[0] or 1.0
        state = new
    return state


def random_walk(edges: DataFrame, seeds: Sequence[str], restart: float = 0.01, rounds: int = MAX_ROUNDS, converged: float | None = CONVERGED) -> DataFrame:
    """``id, value`` after walking from the seeds (names of nodes) with restarts there.

    Seeds that aren't in the graph keep their share of the start, which is lost. With ``converged`` None exactly
    ``rounds`` rounds are made. A node's transitions add up to 1, so the sums of all rounds follow from the number of
    seeds that the graph has.
    """
    spark = edges.sparkSession
    seeds = list(dict.fromkeys(seeds))
    start = spark.createDataFrame([(s, 1.0) for s in seeds], "id string, value double")
    share = restart / max(1, len(seeds))
    moves = stash(transitions(stash(edges, "edges")), "moves")
    inside = moves.where(F.col("src").isin(seeds)).agg(F.count_distinct("src")).first()[0] if seeds else 0
    outside = share * (len(seeds) - inside)
    mass = [float(inside)]  # of the state, within the graph

    def next_total(total: float) -> float:
        mass[0] = (1 - restart) * mass[0] / total + share * inside
        return mass[0] + outside

    def back(v: DataFrame) -> DataFrame:
        again = start.select("id", F.lit(share).alias("value"))
        return v.unionByName(again).groupBy("id").agg(F.sum("value").alias("value"))

    return _walk(moves, start, float(max(1, len(seeds))), back, 1 - restart, rounds, converged, next_total)


def page_rank(edges: DataFrame, damping: float = 0.85, rounds: int = MAX_ROUNDS, converged: float | None = CONVERGED) -> DataFrame:
    """``id, value`` of all nodes by walking from everywhere, with jumps to any node."""
    moves = stash(transitions(stash(edges, "edges"), labelled=False), "moves")
    start = moves.select(F.col("src").alias("id")).distinct().withColumn("value", F.lit(1.0))
    n = moves.select("dst").distinct().count()  # each edge has its inverse, so every node is reached in every round
    jump = (1 - damping) / max(1, n)
    return _walk(moves, start, float(max(1, n)), lambda v: v.withColumn("value", F.col("value") + jump), damping, rounds, converged, None)


def contents(state: DataFrame) -> DataFrame:
    """``entity, weight`` of those nodes of a walk that are contents."""
    return state.where(F.col("id").startswith("c:")).select(F.substring("id", F.lit(3), F.length("id")).alias("entity"), F.col("value").alias("weight"))


def walk_weights(facts: DataFrame, seeds: Sequence[str], **options) -> DataFrame:
    return contents(random_walk(graph(facts), [f"c:{s}" for s in seeds], **options))


def page_rank_weights(facts: DataFrame, seeds: Sequence[str] = (), **options) -> DataFrame:
    return contents(page_rank(graph(facts), **options))


#: Rankers by name; another is added by an entry (facts, seeds) -> (entity, weight).
RANKERS: dict[str, Callable[[DataFrame, Sequence[str]], DataFrame]] = {
    "ETF": lambda facts, seeds: term_frequency(facts),
    "EDF": lambda facts, seeds: document_frequency(facts),
    "EWF": lambda facts, seeds: pattern_frequency(facts),
    "WLW": lambda facts, seeds: pattern_length(facts),
    "BSW": bayesian_sets,
    "GWW": walk_weights,
    "PRW": page_rank_weights,
}
#: Rankers whose weights are logarithms already.
LOG_RANKERS = frozenset({"BSW"})


def rank(facts: DataFrame, seeds: Sequence[str], feature: str = "WLW") -> DataFrame:
    """``entity, weight`` by the ranker of that name."""
    return RANKERS[feature](facts, seeds)
