"""Result pages of searches: requests, parsers for their formats, and the snippets they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setweave.functions.text import strip_tags, unescape_entities
from setweave.sources.pages import without_www

#: Snippets have these columns beside those that come along.
FIELDS = ("rank", "url", "title", "summary", "cache_url")

# Where the fields of each JSON format are: the path of the list, then url, title, summary, cache.
JSON_FORMATS = {
    "ajax": ("responseData.results", "unescapedUrl", "titleNoFormatting", "content", "cacheUrl"),
    "items": ("items", "link", "title", "snippet", "cacheId"),
    "web": ("SearchResponse.Web.Results", "Url", "Title", "Description", "CacheUrl"),
}
# The same of the XML formats: the row's path, then url, title, summary, cache.
XML_FORMATS = {
    "resultset": ("ResultSet/Result", "Url", "Title", "Summary", "Cache/Url"),
    "boss": ("ysearchresponse/resultset_web/result", "url", "title", "abstract", None),
}


def parse_json(pages: DataFrame, page: str, kind: str) -> DataFrame:
    """Snippets of JSON result pages: all other columns of ``pages`` and ``FIELDS``; broken pages have none."""
    path, *fields = JSON_FORMATS[kind]
    row = "struct<" + ",".join(f"`{f}`:string" for f in fields) + ">"
    schema = f"array<{row}>"
    for step in reversed(path.split(".")):
        schema = f"struct<`{step}`:{schema}>"
    keep = [c for c in pages.columns if c != page]
    found = pages.select(*keep, F.from_json(page, schema).alias("_p")).select(*keep, F.posexplode(f"_p.{path}").alias("_pos", "_r"))
    return _clean(found.select(*keep, (F.col("_pos") + 1).alias("rank"), *[F.col(f"_r.`{f}`").alias(a) for f, a in zip(fields, FIELDS[1:])]))


def parse_xml(pages: DataFrame, page: str, kind: str) -> DataFrame:
    """Snippets of XML result pages."""
    path, *fields = XML_FORMATS[kind]
    keep = [c for c in pages.columns if c != page]
    row = f"/{path}"
    n = F.size(F.expr(f"xpath(`{page}`, '{row}/{fields[0]}/text()')"))
    numbered = pages.select(*keep, page, F.explode(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))).alias("rank"))
    value = lambda f: F.element_at(F.expr(f"xpath(`{page}`, '{row}/{f}/text()')"), F.col("rank")) if f else F.lit(None).cast("string")
    return _clean(numbered.select(*keep, "rank", *[value(f).alias(a) for f, a in zip(fields, FIELDS[1:])]))


# How the fields of an HTML result stand: what is before, the field, what follows.
HTML_FIELDS = (
    ("url", r'<h[23] class="r"><a href="[^"]*?', r'http://[^"]+?', r'(?:"|&amp;\w+=)'),
    ("title", '">', ".+?", "</a></h[23]>"),
    ("cache_1", '<a href="', '[^"]+', '"[^<>]*>View as HTML'),
    ("summary", "(?:<div class=std>|</a><br>)", ".+?", "<br>"),
    ("cache_2", '<a class=fl href="', '[^"]+', '"[^<>]*>Cached</a>'),
)


def parse_html(pages: DataFrame, page: str) -> DataFrame:
    """Snippets of HTML result pages: list items of class g, in which each field is looked for after the one before.

    Items without a URL or a title are none, and the others are numbered without them.
    """
    keep = [c for c in pages.columns if c != page]

    def fields(item: Column) -> Column:
        got = []
        for name, before, value, after in HTML_FIELDS:
            found = F.regexp_extract(item, f"(?s){before}({value}){after}", 1)
            got.append(F.nullif(found, F.lit("")).alias(name))
            until = F.length(F.regexp_extract(item, f"(?s)^(.*?{before}{value})(?={after})", 1))
            item = F.substring(item, until + 1, F.length(item))
        return F.struct(*got)

    items = F.transform(F.regexp_extract_all(page, F.lit(r'(?s)<li class="g">(.+?)</li>'), F.lit(1)), fields)
    valid = F.filter(items, lambda x: x["url"].isNotNull() & x["title"].isNotNull())
    rows = pages.select(*keep, F.posexplode(valid).alias("_pos", "_r"))
    return _clean(rows.select(*keep, (F.col("_pos") + 1).alias("rank"), "_r.url", "_r.title", "_r.summary", F.coalesce("_r.cache_1", "_r.cache_2").alias("cache_url")))


def _tidy_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(unescape_entities(strip_tags(c)), " +", " "))


def _clean(found: DataFrame) -> DataFrame:
    title = F.regexp_replace(_tidy_text(F.col("title")), r"\.\.\.$", "")
    return found.where("url IS NOT NULL AND url <> '' AND title IS NOT NULL").withColumn("title", title)


def excerpts(summary: Column) -> Column:
    """The excerpts that a summary is made of, as an array: without mark-up, cut at ellipses, none of them empty."""
    return F.filter(F.transform(F.split(_tidy_text(summary), r"\.\.\."), lambda x: F.trim(x)), lambda x: x != "")


def merge_snippets(snippets: DataFrame, by: list[str] = ()) -> DataFrame:
    """One row per page, whatever its host's ``www``: best rank, shortest URL, longest title (of equal ones the smallest),
    all different summaries, at most once each."""
    size = lambda c, sign: F.min(F.struct((F.length(c) * sign).alias("n"), F.col(c).alias("v"))).alias(c)
    keyed = snippets.where("url IS NOT NULL").withColumn("_key", without_www(F.col("url")))
    got = keyed.groupBy(*by, "_key").agg(F.min("rank").alias("rank"), size("url", 1), size("title", -1), F.count_distinct(F.md5("summary")).alias("n_summaries"))
    return got.select(*by, "rank", F.col("url.v").alias("url"), F.col("title.v").alias("title"), "n_summaries")


def requests(queries: DataFrame, n_results: str, page_size: int) -> DataFrame:
    """``page, start, size`` of the requests that get ``n_results`` results; the last one is clipped."""
    n = F.col(n_results)
    pages = F.ceil(n / page_size).cast("int")
    each = queries.withColumn("page", F.explode(F.when(pages > 0, F.sequence(F.lit(1), pages)).otherwise(F.array().cast("array<int>"))))
    start = (F.col("page") - 1) * page_size
    return each.withColumn("start", start).withColumn("size", F.least(F.lit(page_size), n - start))


def engines(bits: Column, n: int = 5) -> Column:
    """Which search engines a bit field names, the lowest bit first."""
    return F.array(*[bits.bitwiseAND(1 << i) != 0 for i in range(n)])
