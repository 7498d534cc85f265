"""Queries of the entity-list algebra: scored entities against extracted ones, over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setweave.operators import entities as E
from setweave.operators import ranking as R
from setweave.plans.ranking_queries import FACTS, facts
from setweave.plans.text_queries import load


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """``entity, weight``: the greatest pattern-length weight of each scored entity."""
    rows = load(spark, sf, "entity_scores").where("entity IS NOT NULL AND wlw IS NOT NULL AND NOT isnan(wlw) AND abs(wlw) < 1e300")
    return rows.groupBy("entity").agg(F.max("wlw").alias("weight"))


def extracted(spark: SparkSession, sf: str) -> DataFrame:
    """``entity, weight``: how often each content was extracted."""
    return R.term_frequency(facts(spark, sf)).where("weight IS NOT NULL")


def _r(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns or ("weight",):
        df = df.withColumn(c, F.round(c, 9))
    return df


def entity_union(spark, sf):
    return _r(E.union(scored(spark, sf), extracted(spark, sf)))


def entity_merge(spark, sf):
    return _r(E.merge(scored(spark, sf), extracted(spark, sf)))


def entity_intersect(spark, sf):
    return _r(E.intersect(extracted(spark, sf), scored(spark, sf)))


def entity_interpolate(spark, sf):
    return _r(E.interpolate(extracted(spark, sf), scored(spark, sf), 0.25))


def entity_product(spark, sf):
    return _r(E.product(extracted(spark, sf), scored(spark, sf)))


def entity_difference(spark, sf):
    return _r(E.difference(extracted(spark, sf), scored(spark, sf)))


def entity_filters(spark, sf):
    lists = {"absolute": lambda d: E.at_least(d, 10.0), "relative": lambda d: E.at_least_of_max(d, 0.5), "mean": E.at_least_mean}
    out = [f(scored(spark, sf)).select(F.lit(k).alias("kind"), "entity") for k, f in lists.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


def top_entities(spark, sf):
    return E.top(scored(spark, sf), 100, 1.0).select("entity")


def entity_order(spark, sf):
    return E.numbered(extracted(spark, sf)).select(F.col("rank").cast("int").alias("rank"), "entity")


def reduce_size(spark, sf):
    return _r(E.reduce_size(scored(spark, sf), 1000, 500))


def _pairs(spark, sf) -> DataFrame:
    """All pairs, in natural order: ``rank`` is what the order goes by."""
    pairs = extracted(spark, sf).where(E.is_relational(F.col("entity")))
    cut = F.split("entity", "::", 2)
    return pairs.select(F.trim(cut[0]).alias("arg1"), F.trim(cut[1]).alias("arg2"), F.struct((-F.col("weight")).alias("w"), F.length("entity").alias("n"), "entity").alias("rank"))


def relation_filter(spark, sf):
    one, two = (E.unique_relations(_pairs(spark, sf), k).select(F.lit(k).alias("kind"), "arg1", "arg2") for k in (1, 2))
    return one.unionByName(two)


def relation_filter_both(spark, sf):
    return E.unique_relations(_pairs(spark, sf), 3).select("arg1", "arg2")


def assign_score(spark, sf):
    return _r(E.assign_score(scored(spark, sf), F.length("entity") <= 6).select("entity", "score"), "score")


def score_by_length(spark, sf):
    return E.score_by_length(E.assign_score(scored(spark, sf))).select("entity", F.round("score", 10).alias("score"))


def shrink_entities(spark, sf):
    return _r(E.shrink(E.reduce_size(E.merge(scored(spark, sf), extracted(spark, sf)))))


def promote_suffix(spark, sf):
    return _r(E.promote(E.assign_score(scored(spark, sf)), "fo").select("entity", "score"), "score")


def entity_stats(spark, sf):
    return _r(E.stats(scored(spark, sf), 5.0), "total", "mean", "greatest", "total_log").withColumn("total", F.round("total", 3)).withColumn("total_log", F.round("total_log", 3))


def entity_predicates(spark, sf):
    e = F.col("entity")
    return E.without_containing(extracted(spark, sf), "port").select("entity", E.has_space(e).alias("has_space"), E.is_relational(e).alias("is_relational"))


def entity_shuffle(spark, sf):
    return extracted(spark, sf).orderBy(*E.shuffled(extracted(spark, sf), 11)).select("entity")


def doc_score(spark, sf):
    pages = load(spark, sf, "documents").where("weight IS NOT NULL").select("doc_id", "weight")
    return _r(E.rescaled(pages).select("doc_id", "doc_score"), "doc_score")


def positional_weight(spark, sf):
    """The weight of a result by its place in the list of its query: 1 less its share of the list before it."""
    rows = load(spark, sf, "warc").where("query_idx IS NOT NULL AND docid IS NOT NULL").groupBy("query_idx", "docid").agg(F.min("rank").alias("rank"))
    n = rows.groupBy("query_idx").agg(F.max("rank").alias("n"))
    return rows.join(n, "query_idx").select("query_idx", "docid", F.round(1 - (F.col("rank") - 1) / F.col("n"), 9).alias("weight"))


QUERIES = {f.__name__: f for f in (entity_union, entity_merge, entity_intersect, entity_interpolate, entity_product, entity_difference, entity_filters, top_entities, entity_order, reduce_size, relation_filter, relation_filter_both, assign_score, score_by_length, shrink_entities, promote_suffix, entity_stats, entity_predicates, entity_shuffle, doc_score, positional_weight)}

LISTS = f"""{FACTS},
a AS (SELECT entity, max(wlw) AS weight FROM entity_scores WHERE entity IS NOT NULL AND wlw IS NOT NULL AND NOT isnan(wlw) AND abs(wlw) < 1e300 GROUP BY entity),
b AS (SELECT entity, CAST(sum(tf) AS DOUBLE) AS weight FROM facts GROUP BY entity HAVING sum(tf) IS NOT NULL)
"""
_W = f"WITH {LISTS} "
_PAIRS = f"WITH {LISTS}, r AS (SELECT entity, row_number() OVER (ORDER BY weight DESC, length(entity), entity) AS rank FROM b WHERE contains(entity, '::')), p AS (SELECT trim(split_part(entity, '::', 1), ' ') AS arg1, trim(substr(entity, strpos(entity, '::') + 2), ' ') AS arg2, rank FROM r WHERE rank <= 5000)"
_SCORED = "m AS (SELECT min(weight) - 1e-8 AS lo, max(weight) AS hi FROM a), s AS (SELECT entity, {w} AS w, lo, hi FROM a, m), z AS (SELECT entity, (w - lo) / (hi + abs(hi) * 1e-8 - lo) AS score FROM s)"

SQL = {
    "entity_union": _W + "SELECT entity, round(weight, 9) AS weight FROM (SELECT * FROM b UNION ALL SELECT * FROM a WHERE entity NOT IN (SELECT entity FROM b))",
    "entity_merge": _W + "SELECT entity, round(sum(weight), 9) AS weight FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY entity",
    "entity_intersect": _W + "SELECT entity, round(weight, 9) AS weight FROM b SEMI JOIN a USING (entity)",
    "entity_interpolate": _W + "SELECT entity, round(0.25 * b.weight + 0.75 * a.weight, 9) AS weight FROM b JOIN a USING (entity) WHERE 0.25 * b.weight + 0.75 * a.weight > 0",
    "entity_product": _W + "SELECT entity, round(b.weight * a.weight, 9) AS weight FROM b JOIN a USING (entity) WHERE b.weight * a.weight > 0",
    "entity_difference": _W + "SELECT entity, round(weight, 9) AS weight FROM b ANTI JOIN a USING (entity)",
    "entity_filters": _W + "SELECT 'absolute' AS kind, entity FROM a WHERE weight >= 10 UNION ALL SELECT 'relative', entity FROM a WHERE weight >= 0.5 * (SELECT max(weight) FROM a) UNION ALL SELECT 'mean', entity FROM a WHERE weight >= (SELECT avg(weight) FROM a)",
    "top_entities": _W + "SELECT entity FROM a WHERE weight >= 1 ORDER BY weight DESC, length(entity), entity LIMIT 100",
    "entity_order": _W + "SELECT CAST(row_number() OVER (ORDER BY weight DESC, length(entity), entity) AS INTEGER) AS rank, entity FROM b",
    "reduce_size": _W + ", r AS (SELECT *, row_number() OVER (ORDER BY weight DESC, length(entity), entity) AS k FROM a) SELECT entity, round(CASE WHEN (SELECT count(*) FROM a) > 1000 THEN weight - (SELECT weight FROM r WHERE k = 501) ELSE weight END, 9) AS weight FROM r WHERE k <= CASE WHEN (SELECT count(*) FROM a) > 1000 THEN 500 ELSE k END",
    "relation_filter": _PAIRS + ", x AS (SELECT *, row_number() OVER (PARTITION BY arg1 ORDER BY rank) AS k1, row_number() OVER (PARTITION BY arg2 ORDER BY rank) AS k2 FROM p) SELECT 1 AS kind, arg1, arg2 FROM x WHERE k1 = 1 UNION ALL SELECT 2, arg1, arg2 FROM x WHERE k2 = 1",
    "assign_score": _W + ", " + _SCORED.format(w="CASE WHEN length(entity) <= 6 THEN hi + weight * 1e-8 ELSE weight END") + " SELECT entity, round(score, 9) AS score FROM z",
    "score_by_length": _W + ", " + _SCORED.format(w="weight") + """, t AS (SELECT avg(length(entity)) AS m, stddev_pop(length(entity)) AS d FROM z), p AS (SELECT entity, score, d, exp(-0.5 * pow((length(entity) - m) / d, 2)) / (d * sqrt(2 * pi())) AS p FROM z, t)
SELECT entity, round(CASE WHEN d = 0 THEN score WHEN p < 1e-4 THEN 0 ELSE score + p * 1e-8 END, 10) AS score FROM p""",
    "promote_suffix": _W + ", " + _SCORED.format(w="weight") + " SELECT entity, round(CASE WHEN ends_with(entity, 'fo') THEN score + (1 - score) * 0.1 ELSE score END, 9) AS score FROM z",
    "entity_stats": _W + "SELECT count(*) AS n, count(*) FILTER (weight >= 5) AS n_least, round(sum(weight), 3) AS total, round(avg(weight), 9) AS mean, round(max(weight), 9) AS greatest, round(sum(ln(weight)) FILTER (weight > 0), 3) AS total_log, CAST(min(length(entity)) AS INTEGER) AS shortest FROM a",
    "entity_predicates": _W + "SELECT entity, contains(entity, ' ') AS has_space, contains(entity, '::') AS is_relational FROM b WHERE NOT contains(entity, 'port')",
    "entity_shuffle": _W + "SELECT entity FROM b",
    "doc_score": "WITH m AS (SELECT min(weight) - 1e-10 AS lo, max(weight) + 1e-10 AS hi FROM documents) SELECT doc_id, round((weight - lo) / (hi - lo), 9) AS doc_score FROM documents, m WHERE weight IS NOT NULL",
    "positional_weight": "WITH r AS (SELECT query_idx, docid, min(rank) AS rank FROM warc WHERE query_idx IS NOT NULL AND docid IS NOT NULL GROUP BY ALL) SELECT query_idx, docid, round(1 - (rank - 1) / CAST(max(rank) OVER (PARTITION BY query_idx) AS DOUBLE), 9) AS weight FROM r",
}
