"""Queries of problems 2 to 8 and, where SQL can express them, the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setweave.llm import fusion, garbled, leakage, mixing, sentences, spellings, together

SCORES = {"log_score": 1.0, "cell_value": 1.0, "wlw": 1.0, "gww": 1.0, "edf": 1.0}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spellings.redundant(table(spark, sf_dir, "extractions"))


def p2_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spellings.collapse(table(spark, sf_dir, "extractions")).select("keep_id", "n_copies")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.best(fusion.fuse(table(spark, sf_dir, "entity_scores"), SCORES), 10).select("list_id", "entity_id")


def p3_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.fuse(table(spark, sf_dir, "entity_scores"), SCORES).select("list_id", "entity_id", F.round("score", 6).alias("score"), "n_scores")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return together.co_occurrence(table(spark, sf_dir, "matrix_cells")).select(F.col("item_a").alias("row_key_a"), F.col("item_b").alias("row_key_b"))


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = together.co_occurrence(table(spark, sf_dir, "matrix_cells"), min_llr=10.83)
    return pairs.select("item_a", "item_b", "n_ab", "n_a", "n_b", "n", F.round("lift", 6).alias("lift"), F.round("llr", 6).alias("llr"))


def p5_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    uris = garbled.find_garbled(table(spark, sf_dir, "warc"), "record_id", "warc_target_uri", percent=True).withColumnRenamed("record_id", "rec_id")
    contents = garbled.find_garbled(table(spark, sf_dir, "extractions"), "ext_id", "content").withColumnRenamed("ext_id", "rec_id")
    return uris.select(F.lit("warc").alias("src"), "*").unionByName(contents.select(F.lit("extractions").alias("src"), "*"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_repaired(spark, sf_dir).select("src", "rec_id")


def p6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_leaks(spark, sf_dir).select("item_id", "doc_id")


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.decontaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), mixing.ALL).copies


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tokens used: the smallest source is out of reach and says so."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), mixing.ALL).shares


def p7_reachable_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest mix in which every source reaches its share."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), mixing.REACHABLE).shares


def p8_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sentences.split_sentences(docs, "doc_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_sentences(spark, sf_dir).select("doc_id", "end_pos")


_FORMS = r"""
lowered AS (SELECT ext_id, lower(content) AS c, position('::' IN content) AS cut FROM extractions
  WHERE regexp_matches(content, '[\p{L}\p{N}]') AND ext_id IS NOT NULL),
fields AS (SELECT ext_id, cut, regexp_replace(CASE WHEN cut > 0 THEN substr(c, 1, cut - 1) ELSE c END, '[\s\x0b\x{85}\p{Z}\p{P}$+<=>^`|~]+', '', 'g') AS a,
    CASE WHEN cut > 0 THEN regexp_replace(substr(c, cut + 2), '[\s\x0b\x{85}\p{Z}\p{P}$+<=>^`|~]+', '', 'g') END AS b FROM lowered),
forms AS (SELECT ext_id, CASE WHEN b IS NULL THEN a ELSE least(a, b) || chr(1) || greatest(a, b) END AS form FROM fields)
"""

_RANKED = f"""
rows AS (SELECT list_id, entity_id, arg_max(struct_pack(log_score, cell_value, wlw, gww, edf := CAST(edf AS DOUBLE)), scored_at) AS r
  FROM entity_scores WHERE list_id IS NOT NULL AND entity_id IS NOT NULL GROUP BY ALL),
long AS ({" UNION ALL ".join(f"SELECT list_id, entity_id, {i} AS s, r.{s} AS v FROM rows" for i, s in enumerate(SCORES))}),
fit AS (SELECT *, (rank() OVER w - 1 + count(*) OVER t / 2.0) / count(*) OVER l AS p FROM long WHERE v IS NOT NULL AND isfinite(v)
  WINDOW l AS (PARTITION BY list_id, s), w AS (PARTITION BY list_id, s ORDER BY v), t AS (PARTITION BY list_id, s, v)),
fused AS (SELECT list_id, entity_id, avg({fusion.normal_quantile_sql("p", "")}) AS score, count(*) AS n_scores FROM fit GROUP BY ALL)
"""

_PAIRS = """
cells AS (SELECT DISTINCT row_key AS r, column_key AS c FROM matrix_cells WHERE row_key IS NOT NULL AND column_key IS NOT NULL),
sizes AS (SELECT r, count(*) AS k FROM cells GROUP BY r),
total AS (SELECT count(DISTINCT c) AS n FROM cells),
shared AS (SELECT a.r AS a, b.r AS b, count(*) AS n_ab FROM cells a JOIN cells b ON a.c = b.c AND a.r < b.r GROUP BY ALL HAVING count(*) >= 5),
pairs AS (SELECT a, b, n_ab, x.k AS n_a, y.k AS n_b, n FROM shared JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b, total WHERE n_ab * n >= 10 * x.k * y.k)
"""
_TERM = "CASE WHEN {k} > 0 THEN ({k}) * ln(({k}) * CAST(n AS DOUBLE) / (({r}) * CAST({c} AS DOUBLE))) ELSE 0 END"
_LLR = " + ".join(
    _TERM.format(k=k, r=r, c=c) for k, r, c in (("n_ab", "n_a", "n_b"), ("n_a - n_ab", "n_a", "(n - n_b)"), ("n_b - n_ab", "(n - n_a)", "n_b"), ("n - n_a - n_b + n_ab", "(n - n_a)", "(n - n_b)"))
)

_LEAKS = r"""
texts AS (SELECT 'i' AS kind, item_id AS id, lang, text FROM eval_items UNION ALL SELECT 'd', doc_id, NULL, text FROM documents),
units AS (SELECT kind, id, 'w' AS "by", regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}]+') AS u FROM texts WHERE kind = 'd' OR lang IS NULL OR lang NOT IN ('ja', 'zh-CN')
  UNION ALL SELECT kind, id, 'c', regexp_extract_all(lower(text), '[\p{L}\p{N}]') FROM texts WHERE kind = 'd' OR lang IN ('ja', 'zh-CN')),
sized AS (SELECT *, if("by" = 'w', 12, 24) AS k FROM units),
grams AS (SELECT DISTINCT kind, id, "by", hash(u[i:i + k - 1]) AS g FROM sized, unnest(range(1, greatest(len(u) - k + 2, 1))) AS t(i) WHERE len(u) >= k),
leaked AS (SELECT DISTINCT i.id AS item_id, d.id AS doc_id FROM grams i JOIN grams d ON i.kind = 'i' AND d.kind = 'd' AND i."by" = d."by" AND i.g = d.g)
"""

_PLACES = """
spots AS (SELECT kind, id, "by", k, i - 1 AS at, hash(u[i:i + k - 1]) AS g FROM sized, unnest(range(1, greatest(len(u) - k + 2, 1))) AS t(i) WHERE len(u) >= k),
met AS (SELECT i.id AS item_id, d.id AS doc_id, i.k, i.at AS item_at, d.at AS doc_at FROM spots i JOIN spots d ON i.kind = 'i' AND d.kind = 'd' AND i."by" = d."by" AND i.g = d.g),
runs AS (SELECT *, item_at - row_number() OVER (PARTITION BY item_id, doc_id, item_at - doc_at ORDER BY item_at) AS run FROM (SELECT DISTINCT * FROM met)),
longest AS (SELECT item_id, doc_id, min(item_at) AS item_place, min(doc_at) AS doc_place, count(*) + min(k) - 1 AS length FROM runs GROUP BY item_id, doc_id, item_at - doc_at, run),
first AS (SELECT *, count(*) OVER (PARTITION BY item_id, doc_id) AS n_places, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY length DESC, item_place, doc_place) AS nth FROM longest)
"""

SQL = {
    "p6_leaks": f"WITH {_LEAKS}, {_PLACES} SELECT item_id, doc_id, CAST(length AS INTEGER) AS length, n_places, CAST(item_place AS INTEGER) AS item_place, CAST(doc_place AS INTEGER) AS doc_place FROM first WHERE nth = 1",
    "p6_found": f"WITH {_LEAKS} SELECT item_id, doc_id FROM leaked",
    "p6_clean": f"WITH {_LEAKS} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM leaked)",
    "p4_found": f"WITH {_PAIRS} SELECT a AS row_key_a, b AS row_key_b FROM pairs",
    "p4_pairs": f"""WITH {_PAIRS}, told AS (SELECT *, 2 * ({_LLR}) AS llr FROM pairs)
SELECT a AS item_a, b AS item_b, n_ab, n_a, n_b, n, round(n_ab * CAST(n AS DOUBLE) / (n_a * n_b), 6) AS lift, round(llr, 6) AS llr FROM told WHERE llr >= 10.83""",
    "p2_found": f"""WITH {_FORMS}, firsts AS (SELECT *, min(ext_id) OVER (PARTITION BY form) AS keep_id FROM forms)
SELECT keep_id, ext_id AS dup_id FROM firsts WHERE ext_id > keep_id""",
    "p3_found": f"""WITH {_RANKED}, placed AS (SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY round(score, 9) DESC, entity_id) AS k FROM fused)
SELECT list_id, entity_id FROM placed WHERE k <= 10""",
    "p3_ranking": f"WITH {_RANKED} SELECT list_id, entity_id, round(score, 6) AS score, n_scores FROM fused",
    "p2_copies": f"WITH {_FORMS} SELECT min(ext_id) AS keep_id, count(*) AS n_copies FROM forms GROUP BY form",
}

QUERIES = {"p2_found": p2_found, "p2_copies": p2_copies, "p3_found": p3_found, "p3_ranking": p3_ranking, "p4_found": p4_found, "p4_pairs": p4_pairs, "p5_found": p5_found, "p5_repaired": p5_repaired, "p6_found": p6_found, "p6_leaks": p6_leaks, "p6_clean": p6_clean, "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_reachable_shares": p7_reachable_shares, "p8_found": p8_found, "p8_sentences": p8_sentences}
