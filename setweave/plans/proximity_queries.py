"""Queries of annotation, proximity, translation and categories, over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setweave.functions import text as T
from setweave.operators import bilingual as B
from setweave.operators import category as K
from setweave.operators import entities as E
from setweave.operators import expansion as X
from setweave.operators import patterns as P
from setweave.operators import proximity as N
from setweave.operators import ranking as R
from setweave.plans.expansion_queries import TWO, pages
from setweave.plans.ranking_queries import FACTS
from setweave.plans.text_queries import load, plausible_sql, q, same_letters_sql, stopped_sql, tidy_sql

#: Phrases of the documents that introduce lists.
PHRASES = ("such as", "tales como", "tais como", "tels que")
WORDS = ("under", "entre", "sobre", "dans")
WAY = X.Expansion(P.Settings(bracket=2), "ETF")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", "text")


def excerpt_split(spark, sf):
    return N.excerpts(_docs(spark, sf)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars"))


def annotate(spark, sf):
    return N.annotate(N.excerpts(_docs(spark, sf)), PHRASES, WORDS).select("doc_id", "excerpt", "kind", "start", F.col("end").alias("until"))


def proximity_score(spark, sf):
    return N.proximity_score(N.annotate(N.excerpts(_docs(spark, sf)), PHRASES, WORDS)).select("doc_id", "excerpt", F.round("score", 9).alias("score"))


def chop_excerpt(spark, sf):
    texts = N.excerpts(_docs(spark, sf))
    return texts.select("doc_id", "excerpt", N.chop(F.col("text"), "such as").alias("after"), N.chop(F.col("text"), "such as", False).alias("before")).where("after IS NOT NULL")


def extract_chunks(spark, sf):
    texts = N.excerpts(_docs(spark, sf)).select("doc_id", "excerpt", N.chop(F.col("text"), "such as").alias("rest")).where("rest IS NOT NULL")
    return texts.select("doc_id", "excerpt", F.explode(N.chunks(F.col("rest"), "en", split=False)).alias("entity"))


def split_list_text(spark, sf):
    texts = N.excerpts(_docs(spark, sf)).select("doc_id", "excerpt", N.chop(F.col("text"), "such as").alias("rest")).where("rest IS NOT NULL")
    return texts.select("doc_id", "excerpt", F.posexplode(N.split_list(F.col("rest"))).alias("pos", "part"))


def _found(spark, sf) -> DataFrame:
    return K.instances(_docs(spark, sf), [(p, True) for p in PHRASES])


def _seen(spark, sf) -> DataFrame:
    """Contents as chunks: a page is the snippet, a wrapper the excerpt, the page's language the source."""
    docs = load(spark, sf, "documents").select("doc_id", F.coalesce("lang", F.lit("un")).alias("source"))
    rows = load(spark, sf, "extractions").select("doc_id", F.col("wrapper_id").alias("excerpt"), T.tidy(F.col("content")).alias("entity"), (1 / F.col("tf")).alias("dist"))
    return rows.where("entity <> ''").join(docs, "doc_id")


def hier_counts(spark, sf):
    return N.hierarchical_counts(_seen(spark, sf)).withColumn("dist", F.round("dist", 6))


def instance_score(spark, sf):
    found = _seen(spark, sf)
    return N.instance_scores(N.hierarchical_counts(found), N.totals(found)).withColumn("score", F.round("score", 9))


def noisy_extract(spark, sf):
    return K.noisy_instances(_docs(spark, sf), [(p, True) for p in PHRASES]).withColumn("weight", F.round("weight", 9))


def hearst_queries(spark, sf):
    """The list queries for each source that has a target, in each language."""
    sources = [r.source for r in load(spark, sf, "mix_targets").select("source").collect()]
    rows = [(lang, s, p, first, K.hint(s, lang)) for lang in K.PHRASES for s in sources for p, first in K.list_queries(s, lang)]
    return spark.createDataFrame(rows, "lang string, category string, phrase string, class_first boolean, hint string")


def backoff_queries(spark, sf):
    return load(spark, sf, "extractions").select("ext_id", K.back_off(F.concat(F.lit('"'), "wrapper_id", F.lit('" '), F.regexp_replace("content", '"', ""))).alias("query"))


def general_queries(spark, sf):
    """What the back-off asks for a category of each source: its quoted phrases and words, from both sides."""
    sources = [r.source for r in load(spark, sf, "mix_targets").select("source").collect()]
    rows = [(s, p, first) for s in sources for p, first in K.general_queries(f'"{s} of all" {s} list')]
    return spark.createDataFrame(rows, "category string, phrase string, class_first boolean")


def noisy_expand(spark, sf):
    first = K.noisy_instances(_docs(spark, sf), [(p, True) for p in PHRASES])
    return K.expand_noisy(pages(spark, sf), E.top(first, K.TOP_SEEDS), WAY).withColumn("weight", F.round("weight", 8))


def bootstrap(spark, sf):
    first = K.noisy_instances(_docs(spark, sf), [(p, True) for p in PHRASES])
    scored = E.assign_score(first).select("entity", F.col("score").alias("weight"))
    return K.bootstrap(pages(spark, sf), E.top(scored, 40), WAY).withColumn("weight", F.round("weight", 8))


_LISTS = [(p, True) for p in PHRASES]


def category_extract(spark, sf):
    """Instances that list phrases introduce; how sure they are is 2."""
    got = K.extracted(_docs(spark, sf), "of", phrases=_LISTS)
    return got.entities.select("entity", F.round("weight", 9).alias("weight"), F.lit(got.confidence).alias("confidence"))


def category_backoff(spark, sf):
    """No list phrase has the category, so what stands near its word counts; how sure that is is 1."""
    got = K.extracted(_docs(spark, sf), "glayide")
    return got.entities.select("entity", F.round("weight", 9).alias("weight"), F.lit(got.confidence).alias("confidence"))


def _members(spark, sf) -> K.Members:
    docs = _docs(spark, sf)
    return K.members(docs, docs, "of", how=WAY, phrases=_LISTS, hints=False)


def category_instances(spark, sf):
    found = _members(spark, sf)
    return found.entities.select("entity", F.round("weight", 8).alias("weight"), F.lit(found.confidence).alias("confidence"))


def category_save_wrappers(spark, sf):
    return K.saved_members(_members(spark, sf)).select("doc", "wrapper", "entity", F.round("score", 8).alias("score"))


def hinted_pages(spark, sf):
    """The pages that the hint of a category asks for."""
    return K.hinted(_docs(spark, sf), "glossary").select("doc_id")


def predict_category(spark, sf):
    """Keywords of documents: the words of their URL's last step."""
    last = F.regexp_extract("url", r"/([^/.]*)[^/]*$", 1)
    meta = load(spark, sf, "documents").where("url IS NOT NULL").select("doc_id", F.explode(T.keywords(F.concat_ws(",", last, F.regexp_extract("url", r"://[^/]+/([a-z]+)/", 1)))).alias("keyword"), F.coalesce("weight", F.lit(0.0)).alias("weight"), F.col("site").alias("title"), F.col("text").alias("descr"))
    return K.predict(meta).withColumn("score", F.round("score", 6))


def _weights(spark, sf) -> DataFrame:
    """How near entities stand to each phrase: ``source, entity, weight``."""
    return _found(spark, sf).groupBy("source", "entity").agg(F.sum("dist").alias("weight"))


def translate_score(spark, sf):
    weights = _seen(spark, sf).where("dist IS NOT NULL").groupBy("source", "entity").agg(F.sum("dist").alias("weight"))
    return N.translation_scores(weights).withColumn("score", F.round("score", 9))


def roundtrip_translate(spark, sf):
    forward = N.translation_scores(_weights(spark, sf))
    backward = N.translation_scores(_weights(spark, sf).select(F.col("entity").alias("source"), F.col("source").alias("entity"), "weight"))
    return N.round_trip(forward, backward).withColumn("weight", F.round("weight", 9))


def _names(spark, sf) -> DataFrame:
    """Names of up to 48 characters and how often they were extracted. A filter on them would be pushed below and tidy
    each content again wherever it names them, so what fits comes out of an array."""
    rows = load(spark, sf, "extractions").select(T.tidy(F.col("content")).alias("entity"), "tf")
    fits = F.filter(F.array("entity"), lambda x: (x != "") & (F.length(x) <= 48))
    return R.term_frequency(rows.select(F.explode_outer(fits).alias("entity"), "tf").where("entity IS NOT NULL")).where("weight IS NOT NULL")


def cross_verify(spark, sf):
    """The extracted name that is nearest to each scored entity."""
    scored = load(spark, sf, "entity_scores").where("entity IS NOT NULL").groupBy("entity").agg(F.max("edf").cast("double").alias("score")).where("score IS NOT NULL").select(F.col("entity").alias("source"), "entity", "score")
    return N.cross_verify(scored, _names(spark, sf)).withColumn("weight", F.round("weight", 6))


def similar_names(spark, sf):
    a = load(spark, sf, "entity_scores").select(F.col("entity").alias("name")).where("name IS NOT NULL")
    return N.similar_pairs(a, _names(spark, sf).select(F.col("entity").alias("name"))).withColumn("similarity", F.round("similarity", 9))


def _legacy(spark, sf) -> DataFrame:
    found = _found(spark, sf)
    n = load(spark, sf, "documents").count()
    return N.legacy_scores(found.withColumn("inside", F.col("entity").contains(" ")), n, n)


def legacy_translate(spark, sf):
    return _legacy(spark, sf).withColumn("score", F.round("score", 6))


def collapse_parts(spark, sf):
    """Scored entities without those that are a part of one with a greater score."""
    rows = load(spark, sf, "entity_scores").where("entity IS NOT NULL AND edf IS NOT NULL").groupBy("entity").agg(F.max("edf").alias("score"))
    return N.collapsed(rows)


def bilingual_expand(spark, sf):
    """Rounds in turn over Spanish and Portuguese pages, whose seeds are names that lists there begin with."""
    docs, sides = load(spark, sf, "documents"), []
    for k, lang in enumerate(("es", "pt")):
        own = docs.where(F.col("lang") == lang).select("doc_id", "text")
        first = K.noisy_instances(own, [(PHRASES[1 + k], True)], min_snippets=1)
        seeds = [r.entity for r in E.top(first, 12).collect()]
        sides.append(B.Side(lang, X.SetExpander(own, X.Expansion(P.Settings(bracket=2), "ETF", noisy=True)), X.SeedSelector("FSS_SEMI_SUPERVISED", seeds, n_true=8, n_possible=2)))
    same = lambda known, lang: known.select(F.col("entity").alias("source"), "entity", F.lit(1.0).alias("score"))
    out = spark.createDataFrame([], "round int, lang string, seeds string, entity string, weight double")
    for i, done in enumerate(B.alternate(*sides, rounds=4, translate=same)):
        out = out.unionByName(done.entities.select(F.lit(i).alias("round"), F.lit(done.lang).alias("lang"), F.lit("|".join(done.seeds)).alias("seeds"), "entity", F.round("weight", 8).alias("weight")))
    return out


QUERIES = {f.__name__: f for f in (excerpt_split, annotate, proximity_score, chop_excerpt, extract_chunks, split_list_text, hier_counts, instance_score, noisy_extract, hearst_queries, backoff_queries, general_queries, noisy_expand, bootstrap, category_extract, category_backoff, hinted_pages, category_instances, category_save_wrappers, predict_category, translate_score, roundtrip_translate, cross_verify, similar_names, legacy_translate, collapse_parts, bilingual_expand)}

_CUT = N.CUT
_SEEN = f"{FACTS}, langs AS (SELECT doc_id AS doc, coalesce(lang, 'un') AS source FROM documents), seen AS (SELECT facts.*, source, 1.0 / tf AS dist FROM facts JOIN langs USING (doc))"
_EXCERPTS = f"""pieces AS (SELECT doc_id, string_split_regex(text, {q(_CUT)}) AS p FROM documents WHERE text IS NOT NULL),
excerpts AS (SELECT doc_id, CAST(n AS INTEGER) AS excerpt, p[n + 1] AS text FROM pieces, unnest(range(0, len(p))) AS u(n) WHERE trim(p[n + 1], ' ') <> '')"""


def _hits(phrases, kind, first) -> str:
    rows = ", ".join(f"({q(p)}, {first + i}, {q('(?i)' + p.replace(' ', '[ _' + chr(39) + '-]+'))})" for i, p in enumerate(phrases))
    return f"SELECT e.doc_id, e.excerpt, '{kind}' AS kind, k, i - 1 AS a, i - 1 + length(p) AS b FROM excerpts e, (VALUES {rows}) AS v(p, k, r), unnest(list_filter(range(1, length(text) + 1), lambda j: lower(substr(text, j, length(p))) = p)) AS u(i) WHERE contains(lower(text), p)"


_RANK = f"""hits AS (SELECT * FROM ({_hits(PHRASES, 'source', 0)} UNION ALL {_hits(WORDS, 'target', 10)}))"""
_NEAR = "near AS (SELECT doc_id, excerpt, kind, least(a - max(CASE WHEN kind = 'source' THEN b END) OVER (PARTITION BY doc_id, excerpt ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), min(CASE WHEN kind = 'source' THEN a END) OVER (PARTITION BY doc_id, excerpt ORDER BY a ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - b) AS d FROM hits)"
_CHOP = "chopped AS (SELECT doc_id, excerpt, text, regexp_extract(text, '(?i)such[ \\t\\n\\x0B\\f\\r_''-]+as') AS hit FROM excerpts), parts AS (SELECT doc_id, excerpt, substr(text, strpos(text, hit) + length(hit)) AS rest, substr(text, 1, strpos(text, hit) - 1) AS before FROM chopped WHERE hit <> '')"

_HEARST = "UNION ALL ".join(f"SELECT {q(lang)} AS lang, replace(p, '<1>', source) AS phrase, starts_with(p, '<1>') OR starts_with(p, 'such') AS class_first, source AS category, '(' || {q(' OR '.join(K.LIST_WORDS[lang]))} || ' OR ' || source || ')' AS hint FROM mix_targets, (SELECT unnest([{', '.join(map(q, ps))}]) AS p) " for lang, ps in K.PHRASES.items())
_WORD_CUTS = "|".join(f"(?i:{w})" for w in (x.replace(".", "\\.") for x in N.SPLIT_WORDS["en"]))
_HINTS = " OR ".join(f"contains(lower(text), {q(w)})" for w in (*K.LIST_WORDS["en"], "glossary"))

def _near_sql(a: str, b: str) -> str:
    """The edit similarity of two columns."""
    x, y = same_letters_sql(a, b)
    return f"1 - (CASE WHEN strlen({a}) = length({a}) AND strlen({b}) = length({b}) THEN levenshtein({a}, {b}) ELSE levenshtein({x}, {y}) END) / CAST(greatest(length({a}), length({b})) AS DOUBLE)"


_BETWEEN = chr(91) + " " + r"\t\n\x0B\f\r_'-]+"
_PHRASE_HITS = " UNION ALL ".join(f"SELECT {q(p)} AS source, doc_id, excerpt, text, regexp_extract(text, {q('(?i)' + p.replace(' ', _BETWEEN))}) AS h FROM excerpts" for p in PHRASES)
_PARTS = f"list_filter(list_transform(string_split_regex(regexp_replace(' ' || run || ' ', '([a-z]{{3}})\\.', '\\1' || chr(1), 'g'), {q(_WORD_CUTS + '|')} || chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '')"
_FOUND = f"""{_EXCERPTS}, hit AS ({_PHRASE_HITS}),
rests AS (SELECT source, doc_id, excerpt, substr(text, strpos(text, h) + length(h)) AS rest FROM hit WHERE h <> ''),
runs AS (SELECT source, doc_id, excerpt, rest, unnest(regexp_extract_all(rest, {q(T.language_pattern('en'))})) AS run FROM rests),
split AS (SELECT source, doc_id, excerpt, rest, unnest(CASE WHEN len({_PARTS}) > 0 THEN {_PARTS} ELSE [trim(run, ' ')] END) AS part FROM runs),
named AS (SELECT source, doc_id, excerpt, rest, {tidy_sql("regexp_replace(trim(part, ' '), '(?i)^(?:the |a )', '')")} AS entity FROM split),
found AS (SELECT source, doc_id, excerpt, entity, 1.0 / (greatest(strpos(lower(rest), entity) - 1, 0) + 2) AS dist FROM named WHERE {plausible_sql('entity')} AND NOT {stopped_sql('entity')} AND NOT regexp_matches(entity, '^[0-9]'))"""
_TRANSLATION = """x{k} AS (SELECT *, sum(weight) OVER (PARTITION BY source) AS in_source, count(*) OVER (PARTITION BY source) AS targets, sum(weight) OVER (PARTITION BY entity) AS in_all FROM w{k}),
t{k} AS (SELECT sum(weight) AS everything, count(DISTINCT entity) AS entities FROM w{k}),
s{k} AS (SELECT source, entity, 0.1 * (weight + 1) / (in_source + targets) + 0.9 * (1 - (in_all - weight + 1) / (everything - in_source + entities)) AS score FROM x{k}, t{k}),
top{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, entity) AS k FROM s{k}) WHERE k <= 3)"""
_NAMES = f"{FACTS}, names AS (SELECT {tidy_sql('content')} AS name, CAST(sum(tf) AS DOUBLE) AS weight FROM extractions WHERE {tidy_sql('content')} <> '' AND length({tidy_sql('content')}) <= 48 GROUP BY 1 HAVING sum(tf) IS NOT NULL)"
_CLOSE = f"close AS (SELECT e.entity, n.name, n.weight, {_near_sql('entity', 'name')} AS similarity FROM e JOIN names n ON least(length(entity), length(name)) >= 0.8 * greatest(length(entity), length(name)) - 1e-9)"

SQL = {
    "noisy_extract": f"""WITH {_FOUND}, c AS (SELECT entity, count(DISTINCT source) AS k, count(DISTINCT doc_id) AS s, count(DISTINCT (doc_id, excerpt)) AS e, sum(dist) AS d FROM found GROUP BY entity HAVING count(DISTINCT doc_id) >= 2),
t AS (SELECT count(DISTINCT source) AS tk, count(DISTINCT doc_id) AS ts, count(DISTINCT (doc_id, excerpt)) AS te, count(*) AS tc FROM found) SELECT entity, round((k / CAST(tk AS DOUBLE) + s / CAST(ts AS DOUBLE) + e / CAST(te AS DOUBLE) + d / tc) / 4, 9) AS weight FROM c, t""",
    "legacy_translate": f"""WITH {_FOUND}, c AS (SELECT entity, count(*) AS cf, count(DISTINCT doc_id) AS csf, count(DISTINCT (doc_id, excerpt)) AS cef, sum(dist) AS d, count(*) FILTER (contains(entity, ' ')) AS sf FROM found GROUP BY entity), n AS (SELECT count(*) AS n FROM documents),
t AS (SELECT sum(ln(cf)) AS tc, coalesce(sum(CASE WHEN sf > 0 THEN ln(sf) END), 0) AS ts, sum(d) AS td FROM c) SELECT entity, round(ln((cf + 1) / (tc + 1)) + ln((csf + 1) / (n + 1.0)) + ln(1 / (n + 1.0)) + ln((cef + 1) / (n + 1.0)) + ln(d / td) - ln((sf + 1) / (ts + 1)), 6) AS score FROM c, t, n""",
    "roundtrip_translate": f"""WITH {_FOUND}, w1 AS (SELECT source, entity, sum(dist) AS weight FROM found GROUP BY ALL), w2 AS (SELECT entity AS source, source AS entity, weight FROM w1), {_TRANSLATION.format(k=1)}, {_TRANSLATION.format(k=2)},
trips AS (SELECT a.source, a.entity AS target, a.score AS w1, b.score AS w2, b.entity AS back FROM top1 a JOIN top2 b ON b.source = a.entity), near AS (SELECT *, {_near_sql('back', 'source')} AS s FROM trips)
SELECT source, target, round(weight, 9) AS weight FROM (SELECT *, w1 * w2 * s AS weight, row_number() OVER (PARTITION BY source ORDER BY w1 * w2 * s DESC, target DESC) AS k FROM near WHERE s >= 0.8) WHERE k = 1""",
    "similar_names": f"WITH {_NAMES}, e AS (SELECT DISTINCT entity FROM entity_scores WHERE entity IS NOT NULL AND entity <> ''), {_CLOSE} SELECT entity AS name_a, name AS name_b, round(similarity, 9) AS similarity FROM close WHERE similarity >= 0.8 - 1e-12",
    "cross_verify": f"""WITH {_NAMES}, e AS (SELECT entity, CAST(max(edf) AS DOUBLE) AS score FROM entity_scores WHERE entity IS NOT NULL AND entity <> '' GROUP BY entity HAVING max(edf) IS NOT NULL), {_CLOSE},
r AS (SELECT entity, name, score * weight * similarity AS w FROM close JOIN e USING (entity) WHERE similarity >= 0.8 - 1e-12) SELECT entity AS source, name AS entity, round(w, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY w DESC, name DESC) AS k FROM r) WHERE k = 1""",
    "hearst_queries": _HEARST,
    "backoff_queries": r"""WITH s AS (SELECT ext_id, '"' || wrapper_id || '" ' || replace(content, '"', '') AS s FROM extractions),
p AS (SELECT ext_id, s, array_to_string(regexp_extract_all(s, '"[^"]+"'), ' ') AS a, trim(regexp_replace(regexp_replace(s, '"[^"]*"', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS b FROM s) SELECT ext_id, CASE WHEN s IS NULL THEN '' WHEN a = '' THEN b WHEN b = '' THEN a ELSE a || ' ' || b END AS query FROM p""",
    "general_queries": "SELECT source AS category, p AS phrase, f AS class_first FROM mix_targets, unnest([lower(source) || ' of all', lower(source), 'list']) AS u(p), unnest([true, false]) AS v(f)",
    "hinted_pages": f"SELECT doc_id FROM documents WHERE {_HINTS}",
    "split_list_text": f"""WITH {_EXCERPTS}, {_CHOP}, c AS (SELECT doc_id, excerpt, rest, list_filter(list_transform(string_split_regex(regexp_replace(' ' || rest || ' ', '([a-z]{{3}})\\.', '\\1' || chr(1), 'g'), {q(_WORD_CUTS + "|")} || chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '') AS p FROM parts),
d AS (SELECT doc_id, excerpt, CASE WHEN len(p) > 0 THEN p ELSE [trim(rest, ' ')] END AS p FROM c) SELECT doc_id, excerpt, CAST(k AS INTEGER) AS pos, p[k + 1] AS part FROM d, unnest(range(0, len(p))) AS u(k)""",
    "collapse_parts": """WITH s AS (SELECT entity, max(edf) AS score FROM entity_scores WHERE entity IS NOT NULL AND edf IS NOT NULL GROUP BY entity)
SELECT entity, score FROM s WHERE NOT EXISTS (SELECT 1 FROM s t WHERE t.entity <> s.entity AND contains(t.entity, s.entity) AND s.entity <> '' AND (t.score > s.score OR t.score = s.score AND t.entity < s.entity))""",
    "predict_category": """WITH k AS (SELECT doc_id, coalesce(weight, 0) AS w, lower(site) AS t, lower(text) AS d, unnest(list_distinct(list_filter(list_transform(string_split_regex(lower(concat_ws(',', regexp_extract(url, '/([^/.]*)[^/]*$', 1), regexp_extract(url, '://[^/]+/([a-z]+)/', 1))), '[-:,|]'), lambda x: trim(x, ' ')), lambda x: x <> ''))) AS keyword FROM documents WHERE url IS NOT NULL),
p AS (SELECT keyword, count(DISTINCT doc_id) AS n, sum(w) AS w, sum(coalesce(CAST(contains(t, keyword) AS INTEGER), 0) + coalesce(CAST(contains(d, keyword) AS INTEGER), 0)) AS hits FROM k GROUP BY keyword) SELECT keyword, round(w + n + hits, 6) AS score FROM p WHERE n * 2 >= (SELECT max(n) FROM p)""",
    "excerpt_split": f"WITH {_EXCERPTS} SELECT doc_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM excerpts GROUP BY doc_id",
    "annotate": f"WITH {_EXCERPTS}, {_RANK} SELECT doc_id, excerpt, kind, CAST(a AS INTEGER) AS start, CAST(b AS INTEGER) AS until FROM hits",
    "proximity_score": f"WITH {_EXCERPTS}, {_RANK}, {_NEAR} SELECT doc_id, excerpt, round(sum(1.0 / (d + 2)), 9) AS score FROM near WHERE kind = 'target' AND d IS NOT NULL GROUP BY ALL",
    "chop_excerpt": f"WITH {_EXCERPTS}, {_CHOP} SELECT doc_id, excerpt, rest AS after, before FROM parts",
    "hier_counts": f"WITH {_SEEN} SELECT entity, count(*) AS chunks, count(DISTINCT (doc, wrapper)) FILTER (wrapper IS NOT NULL) AS excerpts, count(DISTINCT doc) AS snippets, count(DISTINCT source) AS sources, round(sum(dist), 6) AS dist FROM seen GROUP BY entity",
    "instance_score": f"""WITH {_SEEN}, c AS (SELECT entity, count(DISTINCT (doc, wrapper)) FILTER (wrapper IS NOT NULL) AS e, count(DISTINCT doc) AS s, count(DISTINCT source) AS k, sum(dist) AS d FROM seen GROUP BY entity),
t AS (SELECT count(*) AS tc, count(DISTINCT (doc, wrapper)) FILTER (wrapper IS NOT NULL) AS te, count(DISTINCT doc) AS ts, count(DISTINCT source) AS tk FROM seen)
SELECT entity, round((k / CAST(tk AS DOUBLE) + s / CAST(ts AS DOUBLE) + e / CAST(te AS DOUBLE) + d / tc) / 4, 9) AS score FROM c, t""",
    "translate_score": f"""WITH {_SEEN}, w AS (SELECT source, entity, sum(dist) AS weight FROM seen WHERE dist IS NOT NULL GROUP BY ALL), t AS (SELECT sum(weight) AS everything, count(DISTINCT entity) AS entities FROM w),
x AS (SELECT *, sum(weight) OVER (PARTITION BY source) AS in_source, count(*) OVER (PARTITION BY source) AS targets, sum(weight) OVER (PARTITION BY entity) AS in_all FROM w)
SELECT source, entity, round(0.1 * (weight + 1) / (in_source + targets) + 0.9 * (1 - (in_all - weight + 1) / (everything - in_source + entities)), 9) AS score FROM x, t""",
    "extract_chunks": f"WITH {_EXCERPTS}, {_CHOP}, c AS (SELECT doc_id, excerpt, unnest(regexp_extract_all(rest, {q(T.language_pattern('en'))})) AS c FROM parts), n AS (SELECT doc_id, excerpt, {tidy_sql('c')} AS entity FROM c) SELECT doc_id, excerpt, entity FROM n WHERE {plausible_sql('entity')} AND NOT {stopped_sql('entity')} AND NOT regexp_matches(entity, '^[0-9]')",
}
