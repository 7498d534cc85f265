"""Queries of the text functions, over the whole tables of contents, pages and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setweave.functions import text as T


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy_content(spark, sf):
    return load(spark, sf, "extractions").select("ext_id", T.tidy(F.col("content")).alias("name"), T.tidy(F.col("content"), True).alias("original"))


def content_filter(spark, sf):
    return load(spark, sf, "extractions").select("ext_id", T.plausible(T.tidy(F.col("content"))).alias("ok"))


PHRASES = ("north fort marsh", "little king of old port")


def stopword_filter(spark, sf):
    words = load(spark, sf, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("word"))
    return words.where(T.stopped(F.col("word"), T.STOPWORDS, PHRASES)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def lang_pattern(spark, sf):
    langs = T.detect_languages(T.tidy(F.col("content")))
    return load(spark, sf, "extractions").select(F.explode(langs).alias("lang")).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


def lang_detect(spark, sf):
    return load(spark, sf, "extractions").select("ext_id", F.array_join(T.detect_languages(T.tidy(F.col("content"))), ",").alias("langs"))


def wrapper_level(spark, sf):
    cut = F.split("column_key", r"\[\.\.\.\]")
    parts = load(spark, sf, "matrix_cells").where(F.col("column_key").contains("[...]")).select("column_key").distinct().select("column_key", F.element_at(cut, 1).alias("l"), F.element_at(cut, 2).alias("r"))
    return parts.select("column_key", *[T.html_level(F.col("l"), k, True).alias(f"left_{k}") for k in range(5)], *[T.html_level(F.col("r"), k, False).alias(f"right_{k}") for k in range(5)])


def strip_tags(spark, sf):
    return load(spark, sf, "warc").select("record_id", T.strip_tags(F.col("body")).alias("text"))


def escape_entities(spark, sf):
    return load(spark, sf, "documents").select("doc_id", T.escape_entities(F.col("text")).alias("escaped"))


def unescape_entities(spark, sf):
    twice = T.unescape_entities(T.escape_entities(F.col("text")))
    return load(spark, sf, "documents").select("doc_id", twice.alias("text"))


def extract_between(spark, sf):
    b = F.col("body")
    return load(spark, sf, "warc").select("record_id", T.extract_between(b, "<TITLE>", "</TITLE>").alias("title"), T.extract_between(b, None, "<BODY>").alias("head"), T.extract_between(b, "<BODY>", None).alias("rest"))


def string_helpers(spark, sf):
    c, tf = F.col("content"), F.col("tf")
    return load(spark, sf, "extractions").select(
        "ext_id", F.concat(F.lit('"'), c, F.lit('"')).alias("quoted"), T.unquote(F.concat(F.lit('"'), c, F.lit('"'))).alias("unquoted"), F.repeat("wrapper_id", 2).alias("twice"), F.concat_ws("_", "wrapper_id", "ext_id").alias("merged"),
        F.regexp_replace(F.lower("wrapper_id"), "[^a-z0-9]+", "-").alias("file_name"), F.round(F.log2(tf), 9).alias("log2_tf"), F.lpad(tf.cast("string"), 5, " ").alias("right_aligned"), F.to_number(F.format_number(tf * 1000, 0), F.lit("999,999,999")).cast("bigint").alias("parsed"),
    )


def levenshtein_sim(spark, sf):
    a = F.split("content", "::", 2)
    return load(spark, sf, "extractions").where(F.col("content").contains("::")).select("ext_id", F.round(T.edit_similarity(a[0], a[1]), 9).alias("similarity"))


def jaro_winkler(spark, sf):
    a = F.split("content", "::", 2)
    return load(spark, sf, "extractions").where(F.col("content").contains("::")).select("ext_id", F.round(T.jaro_winkler(a[0], a[1]), 9).alias("similarity"))


def porter_stem(spark, sf):
    words = load(spark, sf, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.withColumn("stem", T.stem("word")).groupBy("stem").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_words"))


def name_tokens(spark, sf):
    tokens = T.name_tokens(F.col("entity"))
    return load(spark, sf, "entity_scores").where("entity IS NOT NULL").select("entity_id", "list_id", "scored_at", F.size(tokens).cast("bigint").alias("n_tokens"), F.array_join(tokens, "|").alias("tokens"))


def stopword_file(spark, sf):
    """Contents that are none of the scored names, which stand for a stop-word file here, nor part of two phrases."""
    words = T.stopword_files(load(spark, sf, "entity_scores"), "entity")
    return T.not_stopped(load(spark, sf, "extractions").select("ext_id", T.tidy(F.col("content")).alias("entity")), words, phrases=PHRASES).select("ext_id")


def combined_language(spark, sf):
    """Which contents of pages fetched in any language are contents of each language."""
    names = load(spark, sf, "extractions").select("ext_id", T.tidy(F.col("content")).alias("name"))
    hits = F.filter(F.array(*[F.when(F.coalesce(F.col("name").rlike(rf"^(?:{T.combined_language('un', x)[1]})\z"), F.lit(False)), F.lit(x)) for x in T.LANGUAGES]), lambda x: x.isNotNull())
    return names.select("ext_id", F.explode(hits).alias("extract_lang"))


def wrapper_escape(spark, sf):
    return load(spark, sf, "extractions").select("ext_id", T.escape_field(F.col("content")).alias("escaped"), T.unescape_field(T.escape_field(F.col("content"))).alias("back"))


def page_meta(spark, sf):
    return load(spark, sf, "warc").select("record_id", T.page_title(F.col("body")).alias("title"), F.array_join(T.keywords(T.strip_tags(F.col("body"))), "|").alias("keywords"))


def hiragana_filter(spark, sf):
    return load(spark, sf, "documents").where(~T.has_hiragana(F.col("text"))).select("doc_id")


def name_density(spark, sf):
    """Gaussian density of the lengths of the names of each list."""
    rows = load(spark, sf, "entity_scores").where("list_id IS NOT NULL AND entity IS NOT NULL").select("list_id", "entity").distinct()
    stats = rows.groupBy("list_id").agg(F.avg(F.length("entity")).alias("m"), F.stddev_pop(F.length("entity").cast("double")).alias("s"))
    return rows.join(stats, "list_id").where("s > 0").select("list_id", "entity", F.round(T.gaussian(F.length("entity"), F.col("m"), F.col("s")), 9).alias("density"))


QUERIES = {f.__name__: f for f in (tidy_content, content_filter, stopword_filter, lang_pattern, lang_detect, wrapper_level, strip_tags, escape_entities, unescape_entities, extract_between, string_helpers, levenshtein_sim, jaro_winkler, porter_stem, name_tokens, stopword_file, combined_language, wrapper_escape, page_meta, hiragana_filter, name_density)}


def q(s: str) -> str:
    """A string as an SQL literal."""
    return "'" + s.replace("'", "''") + "'"


def tidy_sql(c: str, case_sensitive: bool = False) -> str:
    """``tidy`` in SQL."""
    runs = f"regexp_replace({c}, {q(f'[{T.SPACE}_]+')}, ' ', 'g')" if case_sensitive else f"regexp_replace(lower({c}), {q(f'[{T.SPACE}_-]+')}, ' ', 'g')"
    s = f"regexp_replace(regexp_replace({runs}, {q(f'^{T.PUNCT}+')}, ''), {q(f'{T.PUNCT}+$')}, '')"
    return f"regexp_replace(regexp_replace({s}, '^((?s).*?) s ', '\\1''s '), ' s$', '''s')"


def plausible_sql(name: str) -> str:
    return f"coalesce(length({name}) BETWEEN 2 AND 48 AND NOT regexp_full_match({name}, '[A-Za-z]') AND NOT regexp_full_match({name}, '[0-9]+') AND NOT regexp_full_match({name}, {q(T.PUNCT + '+')}), FALSE)"


def stopped_sql(word: str, phrases=()) -> str:
    inside = "".join(f" OR contains({q(p)}, lower(trim({word})))" for p in phrases)
    return f"(lower(trim({word})) IN ({', '.join(map(q, T.STOPWORDS))}){inside})"


def language_sql(name: str, lang: str) -> str:
    return f"coalesce(regexp_full_match({name}, {q(T.language_pattern(lang))}), FALSE)"


_LEFT = {0: "TRUE", 1: "(contains(l, '<') OR contains(l, '>'))", 2: "ends_with(trim(l), '>')", 3: "regexp_matches(l, '<[^<>]+>')", 4: "regexp_matches(trim(l), '<[^<>]+>$')"}
_RIGHT = {0: "TRUE", 1: "(contains(r, '<') OR contains(r, '>'))", 2: "starts_with(trim(r), '<')", 3: "regexp_matches(r, '<[^<>]+>')", 4: "regexp_matches(trim(r), '^<[^<>]+>')"}
_ESCAPED = "replace(replace(replace(replace(replace(text, '&', '&amp;'), '\"', '&quot;'), '<', '&lt;'), '>', '&gt;'), '''', '&#039;')"
_FIELD = "replace(replace(replace(replace(replace(content, '%', '%%'), '\"', '%22'), chr(9), '%09'), chr(10), '%0a'), chr(13), '%0d')"

def same_letters_sql(a: str, b: str) -> tuple[str, str]:
    """Two strings with their characters replaced by ASCII ones, the same for the same, as DuckDB's distances count bytes."""
    known = f"array_to_string(list_distinct(regexp_extract_all({a} || {b}, '(?s).')), '')"
    return tuple(f"translate({x}, {known}, {q(''.join(chr(i) for i in range(33, 127)))})" for x in (a, b))


_A, _B = same_letters_sql("a", "b")
_HALVES = "h AS (SELECT ext_id, substr(content, 1, strpos(content, '::') - 1) AS a, substr(content, strpos(content, '::') + 2) AS b FROM extractions WHERE contains(content, '::'))"

SQL = {
    "levenshtein_sim": f"WITH {_HALVES} SELECT ext_id, round(CASE WHEN a = '' AND b = '' THEN 1.0 ELSE 1 - levenshtein({_A}, {_B}) / CAST(greatest(length(a), length(b)) AS DOUBLE) END, 9) AS similarity FROM h",
    "jaro_winkler": f"WITH {_HALVES} SELECT ext_id, round(jaro_winkler_similarity({_A}, {_B}), 9) AS similarity FROM h",
    "name_tokens": "SELECT entity_id, list_id, scored_at, len(string_split(entity, ' ')) AS n_tokens, array_to_string(string_split(entity, ' '), '|') AS tokens FROM entity_scores WHERE entity IS NOT NULL",
    "stopword_file": f"SELECT ext_id FROM (SELECT ext_id, {tidy_sql('content')} AS entity FROM extractions) WHERE entity IS NOT NULL AND lower(trim(entity, ' ')) NOT IN (SELECT lower(trim(entity, ' ')) FROM entity_scores WHERE entity IS NOT NULL) AND NOT contains('north fort marsh', lower(trim(entity, ' '))) AND NOT contains('little king of old port', lower(trim(entity, ' ')))",
    "combined_language": "SELECT ext_id, x.extract_lang FROM (SELECT ext_id, " + tidy_sql('content') + " AS name FROM extractions), (VALUES " + ", ".join(f"({q(x)})" for x in T.LANGUAGES) + ") AS x(extract_lang) WHERE CASE " + " ".join(f"WHEN extract_lang = {q(x)} THEN {language_sql('name', x)}" for x in T.LANGUAGES) + " END",
    "tidy_content": f"SELECT ext_id, {tidy_sql('content')} AS name, {tidy_sql('content', True)} AS original FROM extractions",
    "content_filter": f"WITH n AS (SELECT ext_id, {tidy_sql('content')} AS name FROM extractions) SELECT ext_id, {plausible_sql('name')} AS ok FROM n",
    "stopword_filter": f"WITH w AS (SELECT unnest(string_split(text, ' ')) AS word FROM documents) SELECT word, count(*) AS n FROM w WHERE {stopped_sql('word', PHRASES)} GROUP BY word",
    "lang_pattern": f"WITH n AS (SELECT {tidy_sql('content')} AS name FROM extractions) " + " UNION ALL ".join(f"SELECT '{x}' AS lang, count(*) AS n FROM n WHERE {language_sql('name', x)} HAVING count(*) > 0" for x in T.LANGUAGES),
    "lang_detect": f"WITH n AS (SELECT ext_id, {tidy_sql('content')} AS name FROM extractions) SELECT ext_id, concat_ws(',', " + ", ".join(f"CASE WHEN {language_sql('name', x)} THEN '{x}' END" for x in T.LANGUAGES) + ") AS langs FROM n",
    "wrapper_level": "WITH p AS (SELECT DISTINCT column_key, split_part(column_key, '[...]', 1) AS l, split_part(column_key, '[...]', 2) AS r FROM matrix_cells WHERE contains(column_key, '[...]')) SELECT column_key, " + ", ".join(f"{_LEFT[k]} AS left_{k}, {_RIGHT[k]} AS right_{k}" for k in range(5)) + " FROM p",
    "strip_tags": "SELECT record_id, regexp_replace(body, '<[^<>]+>', '', 'g') AS text FROM warc",
    "escape_entities": f"SELECT doc_id, {_ESCAPED} AS escaped FROM documents",
    "unescape_entities": "SELECT doc_id, text FROM documents",
    "extract_between": """WITH p AS (SELECT record_id, body, strpos(body, '<TITLE>') AS a, strpos(body, '<BODY>') AS b FROM warc), r AS (SELECT *, CASE WHEN a > 0 THEN substr(body, a + 7) END AS t FROM p)
SELECT record_id, CASE WHEN strpos(t, '</TITLE>') > 0 THEN substr(t, 1, strpos(t, '</TITLE>') - 1) END AS title, CASE WHEN b > 0 THEN substr(body, 1, b - 1) END AS head, CASE WHEN b > 0 THEN substr(body, b + 6) END AS rest FROM r""",
    "string_helpers": """SELECT ext_id, '"' || content || '"' AS quoted, content AS unquoted, wrapper_id || wrapper_id AS twice, concat_ws('_', wrapper_id, ext_id) AS merged, regexp_replace(lower(wrapper_id), '[^a-z0-9]+', '-', 'g') AS file_name,
round(log2(tf), 9) AS log2_tf, lpad(CAST(tf AS VARCHAR), 5, ' ') AS right_aligned, CAST(tf * 1000 AS BIGINT) AS parsed FROM extractions""",
    "wrapper_escape": f"SELECT ext_id, {_FIELD} AS escaped, content AS back FROM extractions",
    "page_meta": """WITH t AS (SELECT record_id, regexp_extract(body, '(?is)<title[^>]*>(.*?)</title>', 1) AS t, list_filter(list_transform(string_split_regex(lower(regexp_replace(body, '<[^<>]+>', '', 'g')), '[-:,|]'), lambda x: trim(x, ' ')), lambda x: x <> '') AS k FROM warc)
SELECT record_id, nullif(trim(regexp_replace(t, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), '') AS title, array_to_string(list_filter(k, lambda x, i: list_position(k, x) = i), '|') AS keywords FROM t""",
    "hiragana_filter": r"SELECT doc_id FROM documents WHERE NOT coalesce(regexp_matches(text, '[\x{3040}-\x{309F}]'), FALSE)",
    "name_density": """WITH r AS (SELECT DISTINCT list_id, entity FROM entity_scores WHERE list_id IS NOT NULL AND entity IS NOT NULL), s AS (SELECT list_id, avg(length(entity)) AS m, stddev_pop(length(entity)) AS s FROM r GROUP BY list_id)
SELECT list_id, entity, round(exp(-0.5 * pow((length(entity) - m) / s, 2)) / (s * sqrt(2 * pi())), 9) AS density FROM r JOIN s USING (list_id) WHERE s > 0""",
}
