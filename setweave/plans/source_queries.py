"""Queries of the sources and sinks, over the whole tables of pages, contents and listed files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setweave.functions import text as T
from setweave.operators import expansion as X
from setweave.operators import patterns as P
from setweave.operators import ranking as R
from setweave.plans.expansion_queries import _FACTS, _SCORED, SEEDS, TWO, pages
from setweave.plans.small_files import _FILES
from setweave.plans.text_queries import load, q
from setweave.runtime import scratch_path, stash
from setweave.sources import compaction as C
from setweave.sources import pages as G
from setweave.sources import results as S
from setweave.sources import sinks, warc


def scan_pages(spark, sf):
    """Page files scanned from a folder tree: the documents, written as one text file for each of sixteen bins."""
    folder = scratch_path(spark, "page-files")
    rows = load(spark, sf, "documents").where("text IS NOT NULL").select(F.pmod("doc_id", F.lit(16)).alias("bin"), "text")
    rows.repartition("bin").write.partitionBy("bin").text(folder)
    return G.scan(spark, folder).select(F.regexp_extract("path", "bin=([0-9]+)", 1).cast("int").alias("bin"), F.length("text").alias("n_chars"))


def inverted_index(spark, sf):
    return G.postings(load(spark, sf, "documents").select("doc_id", "text")).select("term", "doc_id", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


def index_saved_wrappers(spark, sf):
    """The contents of each saved file: second field of every line after the first, from the consolidated store."""
    store = C.read_store(spark, C.consolidate(spark, load(spark, sf, "wrapper_files")))
    return store.select("file_id", "line_no", F.split("record", "\t")[1].alias("content"))


def offline_search(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "text")
    return G.search(docs, [(0, s) for s in SEEDS], 100).select("doc_id", "score", F.col("rank").cast("int").alias("rank"))


def subseed_queries(spark, sf):
    """A query for each pair of seeds."""
    docs = load(spark, sf, "documents").select("doc_id", "text")
    phrases = [(i, s) for i, c in enumerate(X.subsets(SEEDS, 2)) for s in c]
    return G.search(docs, phrases, 50).select("query", "doc_id", "score", F.col("rank").cast("int").alias("rank"))


def batch_search(spark, sf):
    """Every fiftieth extracted content as a query of one batch over all pages: any of its words may be on a page."""
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(G.WORD), F.lit(0)))).alias("text")
    queries = load(spark, sf, "extractions").where("ext_id % 50 = 0").select(F.col("ext_id").alias("query"), words)
    docs = load(spark, sf, "documents").select("doc_id", "text")
    return G.search(docs, queries, 100).select("query", "doc_id", "score", F.col("rank").cast("int").alias("rank"))


def batch_document(spark, sf):
    """The evaluation items as the parameter document of a batch search."""
    queries = load(spark, sf, "eval_items").select(F.col("item_id").alias("number"), warc.phrase_query(F.col("text")).alias("text"))
    return warc.batch_document(queries)


def fetch_pages(spark, sf):
    """The pages of the batch's results: each URL once, with the first record that has it."""
    rows = load(spark, sf, "warc").select(F.col("warc_target_uri").alias("url"), "record_id", "title")
    return G.fetched(rows.select("url"), rows, id_col="record_id", text_col="title").select("url", "record_id", "n_results", F.col("text").alias("title"))


def fetch_unique_pages(spark, sf):
    """Every document that a page address names, copies of another address's page left out."""
    docs = load(spark, sf, "documents").select("doc_id", "url", "text")
    return G.fetched(docs.select("url"), docs, unique=True).select("url", "doc_id", "n_results")


def purge_cache(spark, sf):
    """Cached pages without the empty ones; every seventh reports an error here."""
    broken = F.when(F.col("record_id") % 7 == 0, F.concat("body", F.lit(G.ERROR_PAGE))).otherwise(F.col("body"))
    return G.purged(load(spark, sf, "warc").select("record_id", broken.alias("text"))).select("record_id")


def dedup_pages(spark, sf):
    return G.first_copies(load(spark, sf, "documents"))


def engine_bits(spark, sf):
    bits = S.engines(F.col("p_size"))
    return load(spark, sf, "part").select("p_partkey", *[bits[i].alias(f"engine_{i}") for i in range(5)])


def search_paging(spark, sf):
    return S.requests(load(spark, sf, "part").select("p_partkey", F.col("p_size").alias("n")), "n", 8).select("p_partkey", F.col("page").alias("page_no"), F.col("start").alias("first"), F.col("size").alias("n_rows"))


def _results(spark, sf) -> DataFrame:
    return load(spark, sf, "warc").where("warc_target_uri IS NOT NULL AND title IS NOT NULL").select("record_id", F.regexp_replace("warc_target_uri", r'["\s]', "").alias("uri"), T.escape_entities(F.col("title")).alias("title"))


def parse_serp_html(spark, sf):
    page = F.concat(F.lit('<ol><li class="g"><p>no result</p></li><li class="g"><h3 class="r"><a href="/url?q='), "uri", F.lit('">'), "title", F.lit('</a></h3><div class=std>A <b>first</b> part... and a second<br><a class=fl href="http://cache.test/1">Cached</a></li></ol>'))
    found = S.parse_html(_results(spark, sf).select("record_id", page.alias("page")), "page")
    return found.select("record_id", "rank", "url", "title", F.array_join(S.excerpts(F.col("summary")), "|").alias("excerpts"), "cache_url")


def parse_serp_json(spark, sf):
    rows = _results(spark, sf)
    out = []
    for kind, (path, url, title, summary, cache) in S.JSON_FORMATS.items():
        one = F.struct(F.col("uri").alias(url), F.col("title").alias(title), F.lit("a  b...c").alias(summary))
        page = F.array(one, one)
        for step in reversed(path.split(".")):
            page = F.struct(page.alias(step))
        found = S.parse_json(rows.select("record_id", F.to_json(page).alias("page")), "page", kind)
        out.append(found.select(F.lit(kind).alias("kind"), "record_id", "rank", "url", "title"))
    return out[0].unionByName(out[1]).unionByName(out[2])


def parse_serp_xml(spark, sf):
    row = F.concat(F.lit("<Result><Url>"), T.escape_entities(F.col("uri")), F.lit("</Url><Title>"), "title", F.lit("</Title><Summary>x</Summary><Cache><Url>c</Url></Cache></Result>"))
    page = F.concat(F.lit("<ResultSet>"), row, row, F.lit("</ResultSet>"))
    boss = F.concat(F.lit("<ysearchresponse><resultset_web><result><url>"), T.escape_entities(F.col("uri")), F.lit("</url><title>"), "title", F.lit("</title><abstract>x</abstract></result></resultset_web></ysearchresponse>"))
    rows = _results(spark, sf).where("title <> ''").select("record_id", page.alias("resultset"), boss.alias("boss"))
    found = [S.parse_xml(rows.select("record_id", F.col(kind).alias("page")), "page", kind).select(F.lit(kind).alias("kind"), "record_id", "rank", "url", "cache_url") for kind in S.XML_FORMATS]
    return found[0].unionByName(found[1])


def parse_warc(spark, sf):
    records = load(spark, sf, "warc").where("body IS NOT NULL").select("record_id", warc.record_of(F.col("warc_target_uri"), F.col("body")).alias("record"))
    return warc.parse(records).select("record_id", "uri", "content_length", "body", "title")


def batch_result_lines(spark, sf):
    line = F.concat_ws(" ", "query_idx", F.lit("Q0"), "docid", "rank", F.lit("1.0"), F.lit("run"))
    return warc.result_lines(load(spark, sf, "warc").where("query_idx IS NOT NULL AND docid IS NOT NULL AND rank IS NOT NULL").select(line.alias("line")))


def phrase_query(spark, sf):
    return load(spark, sf, "extractions").select("ext_id", warc.phrase_query(F.col("content")).alias("phrase"))


def strip_cache_header(spark, sf):
    return load(spark, sf, "documents").select("doc_id", G.without_header(G.with_header(F.col("text"), F.col("url"))).alias("text"))


def cache_bins(spark, sf):
    """How many pages each bin of the page cache gets."""
    return load(spark, sf, "documents").where("url IS NOT NULL").select(F.split(G.cache_path(F.col("url"), 16), "/")[0].alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def recover_cached_page(spark, sf):
    page = F.concat(F.lit('banner<hr><div style="position:relative">'), F.replace("text", F.lit("the"), F.lit('<b style="color:black">the</b>')))
    return load(spark, sf, "documents").select("doc_id", G.recovered(page, '<hr><div style="position:relative">').alias("text"))


def detect_charset(spark, sf):
    """Pages sent as UTF-16 where they say so, else as UTF-8, and read in the character set that they name."""
    head = F.when(F.col("query_idx") > 20, F.lit('<meta http-equiv="Content-Type" content="text/html; charset=ISO-8859-1">')).when(F.col("query_idx") > 10, F.lit("<meta charset='UTF-16'>")).otherwise(F.lit(""))
    page = F.concat(head, F.col("body"))
    charset = G.charset_of(page, F.when(F.col("rank") > 3, F.lit("US-ASCII")))
    sent = F.when(charset == "utf-16", F.encode("body", "utf-16")).otherwise(F.encode("body", "utf-8"))
    return load(spark, sf, "warc").select("record_id", charset.alias("charset"), F.length(G.decoded(sent, charset)).alias("n_chars"))


def url_blacklist(spark, sf):
    docs = load(spark, sf, "documents").where("url IS NOT NULL").select("doc_id", "url")
    hosts = docs.groupBy(G.host_of(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n")).where("n > 5").select(F.concat("host", F.lit("/**")).alias("pattern"))
    twice = docs.groupBy("url").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("url").alias("pattern"))
    return G.not_blacklisted(docs, hosts.unionByName(twice), "url").select("doc_id")


def merge_docs(spark, sf):
    return G.merged(load(spark, sf, "documents"))


def merge_doc_wrappers(spark, sf):
    """The patterns that pages of one address have between them."""
    return G.merged_parts(load(spark, sf, "documents"), load(spark, sf, "extractions"), "wrapper_id").select("url", "wrapper_id")


def merge_snippets(spark, sf):
    rows = load(spark, sf, "warc").select("query_idx", "rank", F.col("warc_target_uri").alias("url"), "title", T.strip_tags(F.col("body")).alias("summary"))
    return S.merge_snippets(rows, ["query_idx"])


def snippet_excerpts(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.posexplode(S.excerpts(F.col("text"))).alias("pos", "excerpt"))


def result_xml(spark, sf):
    return sinks.entity_xml(X.expand(pages(spark, sf), SEEDS, X.Expansion(TWO)))


def result_document(spark, sf):
    """The whole result of an expansion as one document, with the patterns worth saving."""
    found = stash(P.induce(pages(spark, sf), SEEDS, TWO), "patterns")
    facts = X.facts_of(found)
    scored = stash(X.score(R.rank(facts, [X.name_of(s) for s in SEEDS], "WLW"), SEEDS, False), "scored")
    return sinks.response_lines(scored, SEEDS, "un", "en", sinks.worthwhile(facts, scored, len(SEEDS)))


def save_wrappers(spark, sf):
    facts = stash(X.facts_of(P.induce(pages(spark, sf), SEEDS, TWO)), "facts")
    scored = X.score(R.rank(facts, [X.name_of(s) for s in SEEDS], "WLW"), SEEDS, True)
    return sinks.worthwhile(facts, scored, 1).select("doc", "wrapper", "entity", F.round("score", 8).alias("score"))


def saved_wrapper_lines(spark, sf):
    return sinks.saved_lines(P.induce(pages(spark, sf), SEEDS, TWO)).select("doc_id", "line")


def load_gold(spark, sf):
    """Synonyms of a gold list with a line per entity: here every line of the saved files."""
    from setweave.operators import evaluation as V

    lines = load(spark, sf, "wrapper_files").select("file_id", F.posexplode(F.split("payload", "\r?\n")).alias("line_no", "line"))
    return V.gold_of_lines(lines, ["file_id", "line_no"], "line")


def load_trec(spark, sf):
    from setweave.operators import evaluation as V

    text = load(spark, sf, "eval_items").select(F.concat(F.col("item_id").cast("string"), F.lit("  "), F.regexp_replace("text", r"\s+", " ")).alias("line"))
    return V.answer_patterns(text, "line").groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("pattern")).alias("longest"))


QUERIES = {f.__name__: f for f in (scan_pages, inverted_index, index_saved_wrappers, offline_search, subseed_queries, batch_search, batch_document, fetch_pages, fetch_unique_pages, purge_cache, dedup_pages, engine_bits, search_paging, parse_serp_html, parse_serp_json, parse_serp_xml, parse_warc, batch_result_lines, phrase_query, strip_cache_header, cache_bins, recover_cached_page, detect_charset, url_blacklist, merge_docs, merge_doc_wrappers, merge_snippets, snippet_excerpts, result_xml, result_document, save_wrappers, saved_wrapper_lines, load_gold, load_trec)}

_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
_TOKENS = f"docs AS (SELECT doc_id, {_WORDS} AS w FROM documents), tokens AS (SELECT doc_id, unnest(w) AS term, unnest(range(0, len(w))) AS pos FROM docs)"
_SEARCH = """hits AS (SELECT a.query, a.phrase, a.n, t.doc_id, t.pos - a.k AS begin_ FROM tokens t JOIN asked a USING (term)),
tfs AS (SELECT query, phrase, doc_id, count(*) AS tf FROM (SELECT query, phrase, doc_id, begin_ FROM hits GROUP BY query, phrase, n, doc_id, begin_ HAVING count(*) = n) GROUP BY ALL),
idfs AS (SELECT query, phrase, 1 + ln((SELECT count(*) FROM documents) / CAST(count(*) + 1 AS DOUBLE)) AS idf FROM tfs GROUP BY ALL),
scored AS (SELECT query, doc_id, sum(sqrt(tf) * idf * idf) AS s FROM tfs JOIN idfs USING (query, phrase) GROUP BY ALL),
normed AS (SELECT query, doc_id, round(s / sqrt(len(w)), 9) AS score FROM scored JOIN docs USING (doc_id)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM normed)"""


def _asked(phrases) -> str:
    rows = ", ".join(f"({i}, {n}, {q(t)})" for n, (i, t) in enumerate(phrases))
    return f"given(query, phrase, text) AS (VALUES {rows}), split AS (SELECT query, phrase, {_WORDS} AS w FROM given), asked AS (SELECT query, phrase, len(w) AS n, unnest(w) AS term, unnest(range(0, len(w))) AS k FROM split)"


_RESULTS = "r AS (SELECT record_id, regexp_replace(warc_target_uri, '[\"\\s]', '', 'g') AS uri, title FROM warc WHERE warc_target_uri IS NOT NULL AND title IS NOT NULL)"
_TITLE = "trim(regexp_replace(regexp_replace(title, ' +', ' ', 'g'), '\\.\\.\\.$', ''), ' ')"
_TITLE = "regexp_replace(trim(regexp_replace(title, ' +', ' ', 'g'), ' '), '\\.\\.\\.$', '')"
_LINES = "string_split(replace(payload, chr(13) || chr(10), chr(10)), chr(10))"

def _field(c: str) -> str:
    return f"replace(replace(replace(replace(replace({c}, '%', '%%'), '\"', '%22'), chr(9), '%09'), chr(10), '%0a'), chr(13), '%0d')"


SQL = {
    "cache_bins": "SELECT CAST(CAST('0x' || substr(md5(url), 1, 15) AS BIGINT) % 16 AS VARCHAR) AS bin, count(*) AS n FROM documents WHERE url IS NOT NULL GROUP BY 1",
    "saved_wrapper_lines": f"""WITH {_FACTS} SELECT doc_id, CAST(doc_id AS VARCHAR) || chr(9) || {_field("lft || '[...]' || rgt")} AS line FROM (SELECT DISTINCT doc_id, lft, rgt FROM facts)
UNION ALL SELECT doc_id, {_field('lft')} || chr(9) || {_field('name')} || chr(9) || {_field('rgt')} FROM facts""",
    "scan_pages": "SELECT CAST(doc_id % 16 AS INTEGER) AS bin, CAST(sum(length(text) + 1) AS INTEGER) AS n_chars FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "index_saved_wrappers": f"WITH {_FILES} SELECT file_id, CAST(line_no AS INTEGER) AS line_no, string_split(line, chr(9))[2] AS content FROM lines WHERE line_no > 1 AND contains(line, chr(9))",
    "batch_document": r"""WITH l AS (SELECT item_id, unnest(['<query>', '<number>' || item_id || '</number>', '<text>#1(' || trim(regexp_replace(regexp_replace(text, '[^\p{L}\p{N} \t\n\x0B\f\r]', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') || ')</text>', '</query>']) AS line, unnest(range(0, 4)) AS k FROM eval_items)
SELECT item_id * 4 + k + 1 AS pos, line FROM l UNION ALL SELECT 0, '<parameters><printDocuments>true</printDocuments>' UNION ALL SELECT 4611686018427387904, '</parameters>'""",
    "fetch_unique_pages": r"""WITH f AS (SELECT url, min(doc_id) AS doc_id, count(*) AS n_results FROM documents WHERE url IS NOT NULL GROUP BY url), p AS (SELECT f.*, regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+', '', 'g') AS k FROM f JOIN documents USING (doc_id))
SELECT p.url, p.doc_id, n_results FROM p WHERE p.doc_id IN (SELECT min(doc_id) FROM p GROUP BY k)""",
    "purge_cache": "SELECT record_id FROM warc WHERE length(body) > 0 AND record_id % 7 <> 0",
    "merge_doc_wrappers": r"""WITH d AS (SELECT doc_id, url, regexp_replace(url, '(?i)^([^:]+://)www[^.]*\.', '\1') AS key FROM documents WHERE url IS NOT NULL), n AS (SELECT key, arg_min(url, (length(url), url)) AS url FROM d GROUP BY key)
SELECT DISTINCT n.url, wrapper_id FROM d JOIN extractions USING (doc_id) JOIN n USING (key) WHERE wrapper_id IS NOT NULL""",
    "snippet_excerpts": f"""WITH t AS (SELECT doc_id, string_split(trim(regexp_replace(regexp_replace(text, '<[^<>]+>', '', 'g'), ' +', ' ', 'g'), ' '), '...') AS p FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, list_filter(list_transform(p, lambda x: trim(x, ' ')), lambda x: x <> '') AS e FROM t) SELECT doc_id, CAST(k AS INTEGER) AS pos, e[k + 1] AS excerpt FROM e, unnest(range(0, len(e))) AS u(k)""",
    "inverted_index": f"WITH {_TOKENS} SELECT term, doc_id, array_to_string(list(pos ORDER BY pos), ',') AS positions FROM tokens GROUP BY ALL",
    "offline_search": f"WITH {_TOKENS}, {_asked([(0, s) for s in SEEDS])}, {_SEARCH} SELECT doc_id, score, rank FROM ranked WHERE rank <= 100",
    "subseed_queries": f"WITH {_TOKENS}, {_asked([(i, s) for i, c in enumerate(X.subsets(SEEDS, 2)) for s in c])}, {_SEARCH} SELECT query, doc_id, score, rank FROM ranked WHERE rank <= 50",
    "batch_search": f"""WITH {_TOKENS}, asked AS (SELECT ext_id AS query, term AS phrase, 1 AS n, term, 0 AS k FROM (SELECT DISTINCT ext_id, unnest({_WORDS.replace('text', 'content')}) AS term FROM extractions WHERE ext_id % 50 = 0)), {_SEARCH}
SELECT query, doc_id, score, rank FROM ranked WHERE rank <= 100""",
    "fetch_pages": "WITH f AS (SELECT warc_target_uri, min(record_id) AS record_id, count(*) AS n_results FROM warc WHERE warc_target_uri IS NOT NULL GROUP BY 1) SELECT warc_target_uri AS url, record_id, n_results, title FROM f JOIN (SELECT record_id, title FROM warc) USING (record_id)",
    "dedup_pages": r"SELECT min(doc_id) AS doc_id FROM documents GROUP BY regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+', '', 'g')",
    "engine_bits": "SELECT p_partkey, " + ", ".join(f"(p_size & {1 << i}) <> 0 AS engine_{i}" for i in range(5)) + " FROM part",
    "search_paging": "SELECT p_partkey, CAST(p AS INTEGER) AS page_no, CAST((p - 1) * 8 AS INTEGER) AS first, CAST(least(8, p_size - (p - 1) * 8) AS INTEGER) AS n_rows FROM part, unnest(range(1, CAST(ceil(p_size / 8.0) AS BIGINT) + 1)) AS u(p)",
    "parse_serp_html": f"WITH {_RESULTS} SELECT record_id, 1 AS rank, uri AS url, {_TITLE} AS title, 'A first part|and a second' AS excerpts, 'http://cache.test/1' AS cache_url FROM r WHERE title <> '' AND starts_with(uri, 'http://')",
    "parse_serp_json": f"WITH {_RESULTS}, k(kind) AS (VALUES ('ajax'), ('items'), ('web')) SELECT kind, record_id, rank, uri AS url, {_TITLE} AS title FROM r, k, (VALUES (1), (2)) AS n(rank) WHERE uri <> ''",
    "parse_serp_xml": f"WITH {_RESULTS} SELECT kind, record_id, rank, uri AS url, cache_url FROM r, (VALUES ('resultset', 1, 'c'), ('resultset', 2, 'c'), ('boss', 1, NULL)) AS n(kind, rank, cache_url) WHERE uri <> '' AND title <> ''",
    "parse_warc": """SELECT record_id, nullif(trim(regexp_replace(warc_target_uri, '^[ \\t]+', '')), '') AS uri, CAST(length(body) + 41 AS INTEGER) AS content_length, replace(body, chr(13) || chr(10), chr(10)) AS body,
nullif(trim(regexp_replace(regexp_extract(body, '(?is)<title[^>]*>(.*?)</title>', 1), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), '') AS title FROM warc WHERE body IS NOT NULL""",
    "batch_result_lines": "SELECT query_idx, docid, rank FROM warc WHERE query_idx IS NOT NULL AND docid IS NOT NULL AND rank IS NOT NULL",
    "phrase_query": r"SELECT ext_id, '#1(' || trim(regexp_replace(regexp_replace(content, '[^\p{L}\p{N} \t\n\x0B\f\r]', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') || ')' AS phrase FROM extractions",
    "strip_cache_header": "SELECT doc_id, CASE WHEN url IS NOT NULL THEN text END AS text FROM documents",
    "recover_cached_page": "SELECT doc_id, text FROM documents",
    "detect_charset": "SELECT record_id, CASE WHEN body IS NULL THEN (CASE WHEN rank > 3 THEN 'us-ascii' ELSE 'utf-8' END) WHEN query_idx > 20 THEN 'iso-8859-1' WHEN query_idx > 10 THEN 'utf-16' WHEN rank > 3 THEN 'us-ascii' ELSE 'utf-8' END AS charset, CAST(CASE WHEN query_idx > 20 OR NOT coalesce(query_idx > 10, FALSE) AND rank > 3 THEN strlen(trim(body, ' ')) ELSE length(trim(body, ' ')) END AS INTEGER) AS n_chars FROM warc",
    "url_blacklist": r"""WITH d AS (SELECT doc_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1)) AS host FROM documents WHERE url IS NOT NULL)
SELECT doc_id FROM d WHERE host NOT IN (SELECT host FROM d GROUP BY host HAVING count(*) > 5) AND url NOT IN (SELECT url FROM d GROUP BY url HAVING count(*) > 1)""",
    "merge_docs": r"""WITH d AS (SELECT regexp_replace(url, '(?i)^([^:]+://)www[^.]*\.', '\1') AS key, url, weight FROM documents WHERE url IS NOT NULL)
SELECT arg_min(url, (length(url), url)) AS url, count(*) AS n_pages, max(weight) AS weight FROM d GROUP BY key""",
    "merge_snippets": r"""WITH s AS (SELECT query_idx, rank, warc_target_uri AS url, title, regexp_replace(body, '<[^<>]+>', '', 'g') AS summary, regexp_replace(warc_target_uri, '(?i)^([^:]+://)www[^.]*\.', '\1') AS key FROM warc WHERE warc_target_uri IS NOT NULL)
SELECT query_idx, min(rank) AS rank, arg_min(url, (length(url), url)) AS url, arg_min(title, (-length(title), title)) FILTER (title IS NOT NULL) AS title, count(DISTINCT summary) AS n_summaries FROM s GROUP BY query_idx, key""",
    "save_wrappers": f"""WITH {_SCORED}, wrapped AS (SELECT *, regexp_replace(lft || '[...]' || rgt, '[ \\t\\n\\x0B\\f\\r]', ' ', 'g') AS wrapper FROM facts),
known AS (SELECT wrapped.*, scored.score FROM wrapped JOIN scored ON name = entity), gain AS (SELECT doc_id, wrapper FROM known GROUP BY ALL HAVING sum(score) - 1 >= 0.5 AND max(ctx_len) >= 3)
SELECT doc_id AS doc, wrapper, name AS entity, round(score, 8) AS score FROM known SEMI JOIN gain USING (doc_id, wrapper) WHERE score >= 0.01""",
    "load_gold": f"SELECT file_id, CAST(n AS INTEGER) AS line_no, CAST(p AS INTEGER) AS pos, trim(string_split(line, chr(9))[p + 1], ' ') AS synonym FROM (SELECT file_id, unnest({_LINES}) AS line, unnest(range(0, len({_LINES}))) AS n FROM wrapper_files WHERE payload IS NOT NULL), unnest(range(0, len(string_split(line, chr(9))))) AS u(p) WHERE trim(string_split(line, chr(9))[p + 1], ' ') <> ''",
    "load_trec": r"SELECT CAST(item_id AS VARCHAR) AS qid, count(*) AS n, CAST(max(length(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' '))) AS INTEGER) AS longest FROM eval_items GROUP BY item_id",
}
SQL = {k: s for k, s in SQL.items() if s}
