import json

import pytest
from pyspark.sql import functions as F

from setweave.operators import expansion as X
from setweave.operators import patterns as P
from setweave.sources import expander_source, pages, results, sinks, warc
from setweave.streaming import expansion as S

LIST = "<ul><li><b>{}</b></li><li><b>{}</b></li><li><b>{}</b></li><li><b>{}</b></li></ul>"


def test_scan_and_search(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name, text in {"a.html": "New York is big. new-york", "d/b.txt": "york new", "c.gif": "new york", "e.htm": ""}.items():
        (tmp_path / name).write_text(text)
    docs = pages.scan(spark, str(tmp_path)).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("doc_id"), "text")
    assert sorted(r.doc_id for r in docs.collect()) == ["a.html", "b.txt"]
    found = pages.search(docs, [(0, "new york"), (1, "York"), (2, ""), (3, "nothing")], 10)
    assert sorted((r.query, r.doc_id, r["rank"]) for r in found.collect()) == [(0, "a.html", 1), (1, "a.html", 2), (1, "b.txt", 1)]
    tf = {(0, r.doc_id): r.tf for r in pages.phrase_counts(docs, [(0, "new york")]).collect()}
    assert tf == {(0, "a.html"): 2}
    assert pages.search(docs.limit(0), [(0, "new")], 10).count() == 0


def test_pages_edges(spark):
    df = spark.createDataFrame([(1, "A b!"), (2, "a  B"), (3, None), (4, ""), (5, "x" * 50_000)], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in pages.first_copies(df).collect()) == [1, 3, 5]
    urls = spark.createDataFrame([("http://www.a.test/x",), ("http://WWW2.a.test/x",), ("a.test",), (None,)], "u string")
    assert [r[0] for r in urls.select(pages.without_www(F.col("u"))).collect()] == ["http://a.test/x", "http://a.test/x", "a.test", None]
    listed = spark.createDataFrame([("http://www.a.test/**",), ("b",)], "pattern string")
    assert pages.not_blacklisted(urls, listed, "u").count() == 3
    heads = spark.createDataFrame([("<meta charset='UTF-16'>", "x"), ("", "ISO-8859-1"), (None, None)], "h string, c string")
    assert [r[0] for r in heads.select(pages.charset_of(F.col("h"), F.col("c"))).collect()] == ["utf-16", "iso-8859-1", "utf-8"]
    assert spark.range(1).select(pages.decoded(F.encode(F.lit(" é "), "iso-8859-1"), F.lit("iso-8859-1"))).first()[0] == "é"
    assert spark.range(1).select(pages.recovered(F.lit("b<hr>x <b style=\"c\">y</b>"), "<hr>")).first()[0] == "x y"


def test_result_parsers(spark):
    html = '<li class="g">no</li><li class="g"><h3 class="r"><a href="/url?q=http://a.test/x&amp;sa=1">T &amp; <b>u</b></a></h3><br><div class=std>one ... two<br><a class=fl href="http://c.test">Cached</a></li><li class="g"><h2 class="r"><a href="http://b.test/">B...</a></h2></li>'
    got = results.parse_html(spark.createDataFrame([(7, html), (8, None), (9, "")], "id int, page string"), "page").collect()
    assert [(r.id, r["rank"], r.url, r.title, r.cache_url) for r in got] == [(7, 1, "http://a.test/x", "T & u", "http://c.test"), (7, 2, "http://b.test/", "B", None)]
    assert spark.range(1).select(results.excerpts(F.lit(got[0].summary))).first()[0] == ["one", "two"]
    page = json.dumps({"items": [{"link": "u", "title": "<b>t</b>"}, {"title": "no url"}, {"link": "v", "title": "w"}]})
    df = spark.createDataFrame([(1, page), (2, "broken"), (3, None)], "id int, page string")
    assert [(r.url, r.title) for r in results.parse_json(df, "page", "items").collect()] == [("u", "t"), ("v", "w")]
    assert [x[1] for x in expander_source.SearchResults.parse("items", page)] == ["u", "v"] and not list(expander_source.SearchResults.parse("items", "{"))


def test_data_source(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.json").write_text(json.dumps({"items": [{"link": f"u{i}", "title": "t"}]}))
    spark.dataSource.register(expander_source.SearchResults)
    got = spark.read.format("searchresults").option("path", str(tmp_path)).option("kind", "items").option("split", "2").load()
    assert sorted((r.file, r["rank"], r.url) for r in got.collect()) == [(f"{i}.json", 1, f"u{i}") for i in range(3)]


def test_warc(spark, tmp_path):
    (tmp_path / "a.warc").write_text("WARC/1.0\r\nWARC-Target-URI: http://a\r\nContent-Length: 9\r\n\r\nHTTP/1.1 200 OK\r\nX: y\r\n\r\n<title> A\n b</title>\r\n\r\nmore WARC/1.0\r\nWARC-Target-URI: http://b\r\n\r\nplain")
    got = warc.parse(warc.read(spark, str(tmp_path / "a.warc"))).collect()
    assert [(r.uri, r.content_length, r.title) for r in got] == [("http://a", 9, "A b"), ("http://b", None, None)] and got[1].body.strip() == "plain"
    lines = spark.createDataFrame([("1 Q0 d 3 0.5 r",), ("bad line",), ("",), (None,)], "line string")
    assert [tuple(r) for r in warc.result_lines(lines).collect()] == [(1, "d", 3)]


def test_requests_and_bits(spark):
    df = spark.createDataFrame([(1, 0), (2, 8), (3, 17)], "id int, n int")
    assert [(r.id, r.page, r.start, r.size) for r in results.requests(df, "n", 8).collect()] == [(2, 1, 0, 8), (3, 1, 0, 8), (3, 2, 8, 8), (3, 3, 16, 1)]
    assert spark.range(1).select(results.engines(F.lit(5))).first()[0] == [True, False, True, False, False]


def test_stream_adds_up_to_the_batch(spark, tmp_path):
    names = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    rows = [(i, LIST.format(*(names[(i + k) % 6] for k in range(4)))) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for k in range(3):
        df.where(F.pmod("doc_id", F.lit(3)) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    S.expand_stream(stream, ["alpha", "beta"], str(tmp_path / "out"), str(tmp_path / "c"), availableNow=True).awaitTermination()
    want = S.batch_weights(df, ["alpha", "beta"], P.Settings(bracket=2))
    as_set = lambda d: {(r.entity, r.etf, r.edf, r.ewf, round(r.wlw, 9)) for r in d.collect()}
    assert as_set(S.running_weights(spark, str(tmp_path / "out"))) == as_set(want) and want.count() > 2


def test_expander_keeps_its_state_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, LIST.format("ann", "bob", "cy", "dee")), (2, LIST.format("bob", "cy", "eve", "fay")), (3, None)], "doc_id bigint, text string")
    x = X.SetExpander(df, X.Expansion(P.Settings(bracket=2))).configured(feature="ETF", noisy=True)
    first = {r.entity: r.weight for r in x.expand(["bob", "cy"]).collect()}
    again = {r.entity: r.weight for r in x.expand(["bob", "cy"]).collect()}
    assert first == again and {"bob", "cy"} <= set(first) and x.quality() > 0 and x.past_seeds == ["bob", "cy"]
    sinks.write_result(x.entities, str(tmp_path / "xml"))
    back = spark.read.format("xml").option("rowTag", "entity").load(str(tmp_path / "xml"))
    assert back.count() == len(first)
    assert sinks.saved_lines(x.patterns).where(F.col("line").contains("\t")).count() > 0
    assert sinks.entity_xml(x.entities).first().xml.startswith("<entity")
    with pytest.raises(KeyError):
        X.expand(df, ["bob", "cy"], X.Expansion(P.Settings(bracket=2), "NONE"))


def test_search_takes_tables_of_queries(spark):
    docs = spark.createDataFrame([(1, "new york is new"), (2, "york new"), (3, None), (4, "")], "doc_id bigint, text string")
    pairs = [(7, "New York"), (7, "is"), (8, "york"), (9, "..."), (9, "none")]
    table = spark.createDataFrame(pairs, "query bigint, text string")
    by = lambda df: sorted((r.query, r.doc_id, r.score, r["rank"]) for r in df.collect())
    assert by(pages.search(docs, table, 10)) == by(pages.search(docs, pairs, 10)) and {(q, d) for q, d, *_ in by(pages.search(docs, table, 10))} == {(7, 1), (8, 1), (8, 2)}


def test_fetching_and_purging(spark):
    found = spark.createDataFrame([("a", "ca"), ("a", "ca"), ("b", "cb"), ("c", None), (None, "x")], "url string, cache string")
    known = spark.createDataFrame([("a", 2, "Text!"), ("a", 5, "later"), ("cb", 3, "text"), ("e", 9, "z")], "url string, doc_id bigint, text string")
    got = lambda df: sorted((r.url, r.n_results, r.doc_id, r.text) for r in df.collect())
    assert got(pages.fetched(found, known)) == [("a", 2, 2, "Text!")]
    assert got(pages.fetched(found, known, cache_url="cache")) == [("a", 2, 2, "Text!"), ("b", 1, 3, "text")]
    assert got(pages.fetched(found, known, cache_url="cache", unique=True)) == [("a", 2, 2, "Text!")]
    rows = spark.createDataFrame([(1, ""), (2, None), (3, f"x {pages.ERROR_PAGE}"), (4, " ")], "id int, text string")
    assert [r.id for r in pages.purged(rows).collect()] == [4]


def test_parts_of_merged_pages(spark):
    docs = spark.createDataFrame([(1, "http://www.a.test/x"), (2, "http://a.test/x"), (3, "http://b.test"), (4, None)], "doc_id bigint, url string")
    parts = spark.createDataFrame([(1, "w1"), (2, "w1"), (2, "w2"), (3, None), (4, "w3")], "doc_id bigint, w string")
    assert sorted((r.url, r.w) for r in pages.merged_parts(docs, parts, "w").collect()) == [("http://a.test/x", "w1"), ("http://a.test/x", "w2")]


def test_decoding_by_the_detected_set(spark):
    from pyspark.sql import functions as F

    rows = [(1, "é".encode(), "utf-8"), (2, b"\xe9", "iso-8859-1"), (3, b"\xe9", "us-ascii"), (4, "é".encode("utf-16"), "utf-16"), (5, b"a\xff", "utf-8"), (6, b"x", "klingon"), (7, None, "utf-8")]
    df = spark.createDataFrame(rows, "id int, content binary, charset string")
    assert {r.id: r.t for r in df.select("id", pages.decoded(F.col("content"), F.col("charset")).alias("t")).collect()} == {1: "é", 2: "é", 3: "é", 4: "é", 5: "a\ufffd", 6: "x", 7: None}


def test_response_document(spark, tmp_path):
    import xml.etree.ElementTree as ET

    from setweave.sources import sinks

    scored = spark.createDataFrame([("a & b", 2.0, 0.9), ("<c>", 1.0, 0.1)], "entity string, weight double, score double")
    saved = spark.createDataFrame([(1, "<b>[...]</b>", "a & b")], "doc bigint, wrapper string, entity string")
    out = tmp_path / "out"
    sinks.write_response(sinks.response_lines(scored, ["s & t"], "en", "ja", saved), str(out))
    root = ET.fromstring("".join(p.read_text() for p in sorted(out.glob("part-*"))))
    assert [e.text for e in root.iter("seed")] == ["s & t"] and root.find("setting/fetch-language").text == "ja"
    assert [(e.get("rank"), e.text) for e in root.iter("entity")] == [("1", "a & b"), ("2", "<c>")] and root.find("entities").get("numEntities") == "2"
    assert [(e.get("context"), e.text) for e in root.iter("wrapper")] == [("<b>[...]</b>", "a & b")]


def test_batch_document(spark):
    from setweave.sources import warc

    rows = warc.batch_document(spark.createDataFrame([(0, "#1(a b)"), (1, "c")], "number int, text string")).orderBy("pos").collect()
    assert [r.line for r in rows] == ["<parameters><printDocuments>true</printDocuments>", "<query>", "<number>0</number>", "<text>#1(a b)</text>", "</query>", "<query>", "<number>1</number>", "<text>c</text>", "</query>", "</parameters>"]
