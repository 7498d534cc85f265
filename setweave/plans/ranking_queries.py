"""Queries of the rankers, over all contents that wrappers extracted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setweave.functions import text as T
from setweave.operators import ranking as R
from setweave.plans.text_queries import load, tidy_sql

SEEDS = ("naisafofoto", "senizebaro 77", "noto zabaigo")
ROUNDS = 3


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """Facts of the extractions table: contents by wrapper and page, with the lengths of both."""
    pages = load(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.length("text").alias("doc_len"))
    name = F.explode(F.filter(F.array(T.tidy(F.col("content"))), lambda x: x != "")).alias("entity")  # tidied once, not again by a filter
    rows = load(spark, sf, "extractions").select(F.col("doc_id").alias("doc"), F.col("wrapper_id").alias("wrapper"), name, "tf", F.length("wrapper_id").alias("ctx_len"))
    return rows.join(pages, "doc", "left")


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumn("weight", F.round("weight", digits))


def rank_etf(spark, sf):
    return R.term_frequency(facts(spark, sf))


def rank_edf(spark, sf):
    return R.document_frequency(facts(spark, sf))


def rank_ewf(spark, sf):
    return R.pattern_frequency(facts(spark, sf))


def rank_wlw(spark, sf):
    return _rounded(R.pattern_length(facts(spark, sf)))


def _seeds(spark, sf) -> list[str]:
    """The five most extracted entities."""
    best = R.term_frequency(facts(spark, sf)).orderBy(F.col("weight").desc(), "entity").limit(5)
    return [r.entity for r in best.collect()]


def rank_bsw(spark, sf):
    return _rounded(R.bayesian_sets(facts(spark, sf), _seeds(spark, sf)), 5)


#: Added before rounding: many weights of a walk end in a 5 right after the last digit shown, where the order of additions
#: would decide.
OFF_TIES = 1e-13


def rank_gww(spark, sf):
    return _rounded(R.walk_weights(facts(spark, sf), _seeds(spark, sf), rounds=ROUNDS, converged=None).withColumn("weight", F.col("weight") + OFF_TIES), 9)


def rank_gww_converged(spark, sf):
    return _rounded(R.walk_weights(facts(spark, sf), _seeds(spark, sf)), 6)


def rank_prw(spark, sf):
    return _rounded(R.page_rank_weights(facts(spark, sf), rounds=ROUNDS, converged=None), 9)


def rank_prw_converged(spark, sf):
    return _rounded(R.page_rank_weights(facts(spark, sf)), 6)


def build_graph(spark, sf):
    return R.graph(facts(spark, sf))


def transition_matrix(spark, sf):
    return R.transitions(R.graph(facts(spark, sf))).withColumn("p", F.round("p", 9))


def _cells(spark, sf) -> DataFrame:
    cells = load(spark, sf, "matrix_cells").where("row_key IS NOT NULL AND column_key IS NOT NULL AND cell_value IS NOT NULL AND NOT isnan(cell_value)")
    return cells.groupBy(F.col("row_key").alias("row"), F.col("column_key").alias("col")).agg(F.max("cell_value").alias("value"))


def sparse_matvec(spark, sf):
    """The matrix of cells times the vector of its columns' widths."""
    cells = _cells(spark, sf)
    return R.matvec(cells, cells.groupBy(F.col("col").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("value"))).withColumn("value", F.round("value", 3))


def sparse_matmul(spark, sf):
    """Sites by language times sources by site: how often a language's pages share a site with a source's."""
    docs = load(spark, sf, "documents").where("site IS NOT NULL")
    by = lambda a, b: docs.where(f"{a} IS NOT NULL AND {b} IS NOT NULL").groupBy(F.col(a).alias("row"), F.col(b).alias("col")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return R.matmul(by("lang", "site"), by("site", "source"))


def rank_bsw_linear(spark, sf):
    """Bayesian scores without logarithms, to six digits."""
    plain = R.bayesian_sets(facts(spark, sf), _seeds(spark, sf), log=False)
    return plain.select("entity", F.format_string("%.5e", "weight").alias("weight"))


def sparse_binarize(spark, sf):
    return R.binarized(_cells(spark, sf))


def euclid_distance(spark, sf):
    """How far every two consecutive lists' scores are from each other, as one figure for all."""
    rows = load(spark, sf, "entity_scores").where("entity IS NOT NULL AND list_id IS NOT NULL")
    known = lambda c: rows.where(f"{c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) < 1e300").groupBy(F.concat_ws("/", "list_id", "entity").alias("id")).agg(F.max(c).alias("value"))
    return R.distance(known("wlw"), known("cell_value")).select(F.round("distance", 3).alias("distance"))


def normalize_weights(spark, sf):
    return R.normalized(R.term_frequency(facts(spark, sf)), "weight").withColumn("weight", F.round("weight", 12))


QUERIES = {f.__name__: f for f in (rank_etf, rank_edf, rank_ewf, rank_wlw, rank_bsw, rank_bsw_linear, rank_gww, rank_gww_converged, rank_prw, rank_prw_converged, build_graph, transition_matrix, sparse_matvec, sparse_matmul, sparse_binarize, euclid_distance, normalize_weights)}

FACTS = f"""
pages AS (SELECT doc_id AS doc, length(text) AS doc_len FROM documents),
facts AS (SELECT * FROM (SELECT doc_id AS doc, wrapper_id AS wrapper, {tidy_sql('content')} AS entity, tf, length(wrapper_id) AS ctx_len FROM extractions) LEFT JOIN pages USING (doc) WHERE entity <> '')
"""
_SEEDS = "seeds AS (SELECT entity FROM facts GROUP BY entity ORDER BY sum(tf) DESC NULLS LAST, entity LIMIT 5)"
_GRAPH = """
one AS (SELECT DISTINCT * FROM (SELECT 'd:' || doc AS src, 'contain' AS label, 'w:' || wrapper AS dst FROM facts UNION ALL SELECT 'w:' || wrapper, 'extract', 'c:' || entity FROM facts UNION ALL SELECT 'd:' || doc, 'contain', 'c:' || entity FROM facts)
  WHERE src IS NOT NULL AND dst IS NOT NULL),
edges AS (SELECT * FROM one UNION ALL SELECT dst, label || 'By', src FROM one),
labels AS (SELECT src, count(DISTINCT label) AS labels, count(DISTINCT dst) AS neighbours FROM edges GROUP BY src),
fan AS (SELECT src, label, count(*) AS fan FROM edges GROUP BY ALL),
moves AS MATERIALIZED (SELECT src, dst, sum(1.0 / (labels * fan)) AS p FROM edges JOIN fan USING (src, label) JOIN labels USING (src) GROUP BY src, dst),
flat AS MATERIALIZED (SELECT DISTINCT src, dst, 1.0 / (labels * neighbours) AS p FROM edges JOIN labels USING (src))
"""


def _walk_sql() -> str:
    steps = ["s0 AS (SELECT 'c:' || entity AS id, CAST(1 AS DOUBLE) AS value FROM seeds)"]
    for k in range(ROUNDS):
        steps.append(f"""s{k + 1} AS MATERIALIZED (SELECT id, sum(value) AS value FROM (SELECT dst AS id, 0.99 * sum(p * value / (SELECT sum(value) FROM s{k})) AS value FROM moves JOIN s{k} ON id = src GROUP BY dst
  UNION ALL SELECT 'c:' || entity, 0.01 / (SELECT count(*) FROM seeds) FROM seeds) GROUP BY id)""")
    return f"WITH {FACTS}, {_SEEDS}, {_GRAPH}, " + ", ".join(steps) + f" SELECT substr(id, 3) AS entity, round(value + {OFF_TIES}, 9) AS weight FROM s{ROUNDS} WHERE starts_with(id, 'c:')"


def _page_rank_sql() -> str:
    steps = ["s0 AS (SELECT DISTINCT src AS id, CAST(1 AS DOUBLE) AS value FROM edges)"]
    for k in range(ROUNDS):
        steps.append(f"""v{k} AS MATERIALIZED (SELECT dst AS id, 0.85 * sum(p * value / (SELECT sum(value) FROM s{k})) AS value FROM flat JOIN s{k} ON id = src GROUP BY dst),
s{k + 1} AS MATERIALIZED (SELECT id, value + 0.15 / (SELECT count(*) FROM v{k}) AS value FROM v{k})""")
    return f"WITH {FACTS}, {_GRAPH}, " + ", ".join(steps) + f" SELECT substr(id, 3) AS entity, round(value, 9) AS weight FROM s{ROUNDS} WHERE starts_with(id, 'c:')"


_CELLS = "cells AS (SELECT row_key AS row, column_key AS col, max(cell_value) AS value FROM matrix_cells WHERE row_key IS NOT NULL AND column_key IS NOT NULL AND cell_value IS NOT NULL AND NOT isnan(cell_value) GROUP BY ALL)"

_BAYES = f"""WITH {FACTS}, {_SEEDS},
cells AS (SELECT DISTINCT entity, feature FROM (SELECT entity, 'd:' || doc AS feature FROM facts UNION ALL SELECT entity, 'w:' || wrapper FROM facts) WHERE feature IS NOT NULL),
n AS (SELECT count(DISTINCT entity) AS entities, 5 AS n FROM cells),
f AS (SELECT feature, count(*) AS m, count(*) FILTER (entity IN (SELECT entity FROM seeds)) AS k FROM cells GROUP BY feature),
ab AS (SELECT *, 2.0 * m / entities + 1e-10 AS a, 2.0 * (1 - CAST(m AS DOUBLE) / entities) + 1e-10 AS b FROM f, n),
s AS (SELECT feature, ln(a + k) - ln(a) - ln(b + n - k) + ln(b) AS has, ln(a + b) - ln(a + b + n) + ln(b + n - k) - ln(b) AS base FROM ab)"""

SQL = {
    "rank_etf": f"WITH {FACTS} SELECT entity, CAST(sum(tf) AS DOUBLE) AS weight FROM facts GROUP BY entity",
    "rank_edf": f"WITH {FACTS} SELECT entity, CAST(count(DISTINCT doc) AS DOUBLE) AS weight FROM facts GROUP BY entity",
    "rank_ewf": f"WITH {FACTS} SELECT entity, CAST(count(DISTINCT (doc, wrapper)) AS DOUBLE) AS weight FROM facts WHERE doc IS NOT NULL AND wrapper IS NOT NULL GROUP BY entity",
    "rank_wlw": f"WITH {FACTS}, each AS (SELECT entity, doc, wrapper, max(ln(ctx_len) / ln(doc_len)) AS w FROM facts WHERE ctx_len > 0 AND doc_len > 1 GROUP BY ALL) SELECT entity, round(sum(w), 6) AS weight FROM each GROUP BY entity",
    "rank_bsw": f"{_BAYES} SELECT entity, round(sum(has) + (SELECT sum(base) FROM s), 5) AS weight FROM cells JOIN s USING (feature) GROUP BY entity",
    "rank_bsw_linear": f"{_BAYES} SELECT entity, format('{{:.5e}}', exp(sum(has) + (SELECT sum(base) FROM s))) AS weight FROM cells JOIN s USING (feature) GROUP BY entity",
    "rank_gww": _walk_sql(),
    "rank_prw": _page_rank_sql(),
    "build_graph": f"WITH {FACTS}, {_GRAPH} SELECT src, label, dst FROM edges",
    "transition_matrix": f"WITH {FACTS}, {_GRAPH} SELECT src, dst, round(p, 9) AS p FROM moves",
    "sparse_matvec": f"WITH {_CELLS}, widths AS (SELECT col, count(*) AS w FROM cells GROUP BY col) SELECT row AS id, round(sum(value * w), 3) AS value FROM cells JOIN widths USING (col) GROUP BY row",
    "sparse_matmul": """WITH a AS (SELECT lang, site, count(*) AS v FROM documents WHERE lang IS NOT NULL AND site IS NOT NULL GROUP BY ALL), b AS (SELECT site, source, count(*) AS v FROM documents WHERE source IS NOT NULL AND site IS NOT NULL GROUP BY ALL)
SELECT lang AS row, source AS col, CAST(sum(a.v * b.v) AS DOUBLE) AS value FROM a JOIN b USING (site) GROUP BY ALL""",
    "sparse_binarize": f"""WITH {_CELLS}, shares AS (SELECT *, value / sum(value) OVER (PARTITION BY row) AS share FROM cells), means AS (SELECT col, sum(share) / (SELECT count(DISTINCT row) FROM cells) AS mean FROM shares GROUP BY col)
SELECT row, col FROM shares JOIN means USING (col) WHERE share > 2 * mean""",
    "euclid_distance": """WITH k AS (SELECT concat_ws('/', list_id, entity) AS id, max(wlw) FILTER (wlw IS NOT NULL AND NOT isnan(wlw) AND abs(wlw) < 1e300) AS x, max(cell_value) FILTER (cell_value IS NOT NULL AND NOT isnan(cell_value) AND abs(cell_value) < 1e300) AS y
FROM entity_scores WHERE entity IS NOT NULL AND list_id IS NOT NULL GROUP BY 1) SELECT round(sqrt(sum(pow(coalesce(x, 0) - coalesce(y, 0), 2))), 3) AS distance FROM k""",
    "normalize_weights": f"WITH {FACTS}, e AS (SELECT entity, CAST(sum(tf) AS DOUBLE) AS w FROM facts GROUP BY entity) SELECT entity, round(w / (SELECT sum(w) FROM e), 12) AS weight FROM e",
}
