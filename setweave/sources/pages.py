"""Pages: scanning them, an index of their words, and phrase search over it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

PAGE_FILES = "*.{html,htm,txt}"
WORD = r"[\p{L}\p{N}]+"


def scan(spark: SparkSession, root: str) -> DataFrame:
    """``path, text`` of all page files below ``root``, each read whole; empty files give no row."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", PAGE_FILES).text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def is_page(url: Column) -> Column:
    return F.coalesce(url.rlike(r"\.(html|htm|txt)$"), F.lit(False))


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, term, pos``: the words of each page in order, lower-cased."""
    return docs.select(id_col, F.posexplode(F.regexp_extract_all(F.lower(text_col), F.lit(WORD), F.lit(0))).alias("pos", "term"))


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``term, id_col, positions``: the inverted index. A group is one term of one page, so frequent terms don't skew."""
    return tokens(docs, id_col, text_col).groupBy("term", id_col).agg(F.array_sort(F.collect_list("pos")).alias("positions"))


def phrases_of(spark: SparkSession, phrases: DataFrame | Sequence[tuple[int, str]]) -> DataFrame:
    """``query, phrase, words``: the phrases of queries, given as a table (query, text) or as pairs. A phrase is known by
    its words; one without words is none."""
    if not isinstance(phrases, DataFrame):
        phrases = spark.createDataFrame(list(phrases), "query int, text string")
    words = F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))
    return phrases.select("query", words.alias("words")).where(F.size("words") > 0).select("query", F.array_join("words", " ").alias("phrase"), "words").distinct()


def phrase_counts(docs: DataFrame, phrases: DataFrame | Sequence[tuple[int, str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``phrase, id_col, tf``: how often each phrase stands on each page; phrases are given as in ``search``.

    Words of pages meet words of phrases by an equi-join, each phrase once however many queries ask for it; a phrase
    stands where all its words follow each other.
    """
    words = phrases_of(docs.sparkSession, phrases).select("phrase", "words").distinct()
    asked = words.select("phrase", F.size("words").alias("n"), F.posexplode("words").alias("offset", "term"))
    hits = tokens(docs, id_col, text_col).join(asked, "term").select("phrase", "n", id_col, (F.col("pos") - F.col("offset")).alias("at"))
    whole = hits.groupBy("phrase", "n", id_col, "at").agg(F.count(F.lit(1)).alias("k")).where("k = n")
    return whole.groupBy("phrase", id_col).agg(F.count(F.lit(1)).alias("tf"))


def search(docs: DataFrame, phrases: DataFrame | Sequence[tuple[int, str]], most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``query, id_col, score, rank``: the ``most`` best pages of each query, any of whose phrases they hold.

    Queries are a table (query, text), a row per phrase, of any size, or a few pairs; all are answered in one pass over
    the pages. A phrase counts the root of its frequency times the square of its inverse document frequency; the sum is
    divided by the root of the page's words. Ties go by page.
    """
    asked = phrases_of(docs.sparkSession, phrases)
    counts = phrase_counts(docs, phrases, id_col, text_col)
    n_docs = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    rarity = counts.groupBy("phrase").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n_docs)).select("phrase", (1 + F.log(F.col("n_docs") / (F.col("df") + 1))).alias("idf"))
    length = docs.select(id_col, F.size(F.regexp_extract_all(F.lower(text_col), F.lit(WORD), F.lit(0))).alias("words"))
    weighed = counts.join(rarity, "phrase").select("phrase", id_col, (F.sqrt("tf") * F.col("idf") * F.col("idf")).alias("w"))
    scored = weighed.join(asked.select("query", "phrase"), "phrase").groupBy("query", id_col).agg(F.sum("w").alias("sum"))
    scored = scored.join(length, id_col).select("query", id_col, F.round(F.col("sum") / F.sqrt("words"), 9).alias("score"))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.col("score").desc(), id_col))).where(F.col("rank") <= most)


def fetched(snippets: DataFrame, pages: DataFrame, url: str = "url", cache_url: str | None = None, id_col: str = "doc_id", text_col: str = "text", unique: bool = False) -> DataFrame:
    """``url, n_results, id_col, text``: the pages of search results, each URL once, as the first page that has it.

    ``pages`` has ``url``, an id and a text. Where the page isn't there, its copy in a search engine's cache
    (``cache_url``) is taken. With ``unique`` pages that differ in nothing but case and marks from an earlier one are
    left out. URLs of which there is no page are left out.
    """
    cached = F.lit(None).cast("string") if cache_url is None else F.col(cache_url)
    wanted = snippets.where(F.col(url).isNotNull()).groupBy(F.col(url).alias("url")).agg(F.count(F.lit(1)).alias("n_results"), F.min(cached).alias("_cache"))
    first = pages.where("url IS NOT NULL").groupBy("url").agg(F.min(F.struct(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).alias("p"))
    got = wanted.join(first, "url", "left").select("url", "n_results", "_cache", "p")
    if cache_url is not None:
        copies = first.select(F.col("url").alias("_cache"), F.col("p").alias("_p"))
        got = got.join(copies, "_cache", "left").withColumn("p", F.coalesce("p", "_p"))
    got = got.where("p IS NOT NULL").select("url", "n_results", F.col("p.id").alias(id_col), F.col("p.text").alias("text"))
    return got.join(first_copies(got, id_col, "text"), id_col, "left_semi").select("url", "n_results", id_col, "text") if unique else got


# Fixed value: what a page says that stands for one a server couldn't give.
ERROR_PAGE = "service temporarily unavailable [C:28]"


def purged(pages: DataFrame, text_col: str = "text") -> DataFrame:
    """Cached pages without empty ones and without those that only report an error."""
    return pages.where((F.length(text_col) > 0) & ~F.contains(F.col(text_col), F.lit(ERROR_PAGE)))


def fingerprint(text: Column) -> Column:
    """Text without case and anything but letters, digits and ``_``."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", "")


def first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids of pages without those whose fingerprint an earlier one has; only hashes are shuffled."""
    f = fingerprint(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(id_col, F.md5(f).alias("h"), F.xxhash64(f).alias("k")).groupBy("h", "k").agg(F.min(id_col).alias(id_col)).select(id_col)


def host_of(url: Column) -> Column:
    """``scheme://host`` of a URL, lower-cased; null if it has none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)), F.lit(""))


def without_www(url: Column) -> Column:
    """A URL without its host's leading ``www`` label."""
    return F.regexp_replace(url, r"(?i)^([^:]+://)www[^.]*\.", "$1")


def not_blacklisted(pages: DataFrame, blacklist: DataFrame, url_col: str) -> DataFrame:
    """Pages of which neither the URL nor its host (as ``scheme://host/**``) is in ``blacklist(pattern)``."""
    listed = blacklist.select("pattern").distinct()
    keyed = pages.withColumn("_host", F.concat(host_of(F.col(url_col)), F.lit("/**")))
    return keyed.join(listed, keyed[url_col] == listed["pattern"], "left_anti").join(listed, F.col("_host") == listed["pattern"], "left_anti").drop("_host")


def merged(docs: DataFrame, url_col: str = "url") -> DataFrame:
    """One row per URL (its host without ``www``): the shortest spelling, how many pages, the greatest weight."""
    key = without_www(F.col(url_col))
    spelled = F.min(F.struct(F.length(url_col).alias("n"), F.col(url_col).alias("u"))).alias("s")
    return docs.where(F.col(url_col).isNotNull()).groupBy(key.alias("key")).agg(spelled, F.count(F.lit(1)).alias("n_pages"), F.max("weight").alias("weight")).select(F.col("s.u").alias("url"), "n_pages", "weight")


def merged_parts(docs: DataFrame, parts: DataFrame, part: str, id_col: str = "doc_id", url_col: str = "url") -> DataFrame:
    """``url, part``: what the pages that ``merged`` makes one have between them (patterns, snippets), each part once.

    ``parts`` has the page's id and the column ``part``. ``url`` is that of ``merged``. A part is a row, so a page with
    very many of them isn't one group.
    """
    key = without_www(F.col(url_col)).alias("key")
    ids = docs.where(F.col(url_col).isNotNull()).select(id_col, key, F.col(url_col).alias("url"))
    names = ids.groupBy("key").agg(F.min(F.struct(F.length("url").alias("n"), "url")).alias("s")).select("key", F.col("s.url").alias("url"))
    return ids.select(id_col, "key").join(parts.where(F.col(part).isNotNull()).select(id_col, part), id_col).select("key", part).distinct().join(names, "key").select("url", part)


HEADER = "<!-- Downloaded from: "


def cache_path(url: Column, bins: int = 1024) -> Column:
    """Where a page is kept: its bin, then bin and hash (the first 60 bits of the URL's MD5)."""
    h = F.conv(F.substring(F.md5(url), 1, 15), 16, 10).cast("bigint")
    b = F.pmod(h, F.lit(bins))
    return F.concat_ws("/", b.cast("string"), F.concat_ws(".", b.cast("string"), F.hex(h), F.lit("html")))


def with_header(text: Column, url: Column) -> Column:
    return F.concat(F.lit(HEADER), url, F.lit(" -->\n"), text)


def without_header(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{HEADER}[^\n]*\n", "")


def recovered(text: Column, before: str, after: str | None = None, mark: str = r"(?i)<b style=[^>]*>(.*?)</b>") -> Column:
    """A page from a search engine's cache: what is after its banner (and before its footer), without marked words; null
    if the banner is missing."""
    start = F.locate(before, text)
    rest = F.when(start > 0, F.substring(text, start + len(before), F.length(text)))
    if after is not None:
        rest = F.when(F.locate(after, rest) > 0, F.substring(rest, F.lit(1), F.locate(after, rest) - 1))
    return F.regexp_replace(rest, mark, "$1")


def charset_of(html: Column, header: Column | None = None) -> Column:
    """The character set that a page's mark-up names, else that of its header, else UTF-8."""
    named = F.nullif(F.lower(F.regexp_extract(html, r"(?i)charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", 1)), F.lit(""))
    return F.coalesce(named, F.lower(header), F.lit("utf-8")) if header is not None else F.coalesce(named, F.lit("utf-8"))


#: Character sets that Spark's decoder knows beside UTF-8; ASCII is read as the larger set that includes it.
DECODABLE = {"us-ascii": "iso-8859-1", "iso-8859-1": "iso-8859-1", "utf-16be": "utf-16be", "utf-16le": "utf-16le", "utf-16": "utf-16", "utf-32": "utf-32"}


def decoded(content: Column, charset: Column) -> Column:
    """Binary content in its character set, trimmed; unknown sets count as UTF-8, of which broken bytes are replaced."""
    out = F.make_valid_utf8(content.cast("string"))
    for name, reader in DECODABLE.items():
        out = F.when(charset == name, F.decode(content, reader)).otherwise(out)
    return F.trim(out)
