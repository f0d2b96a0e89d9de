import base64
import gzip
import hashlib

from pyspark.sql import functions as F

from shopgrain.llm import warc

PAGES = [
    (1, "http://a.example/x?y", "<html><head><title>T &amp; U</title><script>var a='<p>';</script></head>"
     "<body><!-- no --><h1>Head</h1><p>One  two&nbsp;three &#233;&copy;</p>x<br>y</body></html>", 5),
    (2, None, None, 6), (3, "u", "", 7), (None, "u", "<p>only &amp;lt; &#55296; text", 8), (1, "v", "plain", 9), (1, "v", "plain", 9),
]


def derivatives(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, block int")
    return warc.derive(warc.responses_of_pages(pages))


def digest(text):
    return "sha1:" + base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_pairs_refer_to_their_source(spark):
    rows = derivatives(spark).collect()
    assert len(rows) == 2 * len(PAGES)
    sources = {r.record_id for r in warc.responses_of_pages(spark.createDataFrame(PAGES, "page_id long, url string, html string, b int")).collect()}
    assert {r.refers_to for r in rows} == sources and len(sources) == 5  # two equal rows
    texts = {(r.page_id, r.target_uri): r for r in rows if r.warc_type == "conversion"}
    first = texts[1, "http://a.example/x?y"]
    assert first.block == "T & U\nHead\nOne two three é©\nx\ny"
    assert texts[None, "u"].block == "only &lt; � text"
    assert texts[2, None].block == texts[3, "u"].block == ""
    for r in rows:
        assert r.block_digest == digest(r.block) and r.content_length == len(r.block.encode())
    meta = next(r for r in rows if r.warc_type == "metadata" and r.refers_to == first.refers_to)
    assert first.record_id in meta.block and first.source_payload_digest in meta.block
    assert first.source_payload_digest == digest(PAGES[0][2])
    assert "http-header: Content-Type: text/html; charset=utf-8\r\n" in meta.block


def test_response_without_headers_end_and_clashing_columns(spark):
    df = spark.createDataFrame([("<urn:x>", None, None, "HTTP/1.1 404 Not Found\r\nX: y", None, None, 1, 2)],
                               "record_id string, target_uri string, date string, block string, block_digest string, payload_digest string, head int, text int")
    rows = {r.warc_type: r for r in warc.derive(df).collect()}
    assert rows["conversion"].block == "" and "http-header: X: y\r\n" in rows["metadata"].block
    assert rows["conversion"].head == 1 and rows["conversion"].text == 2


def test_archive_files_parse_back(spark, tmp_path):
    df = derivatives(spark)
    path = str(tmp_path / "out")
    warc.write_archive(df, path)
    found = []
    for file in (tmp_path / "out").glob("*.gz"):
        data = gzip.decompress(file.read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            assert lines[0] == "WARC/1.1"
            fields = dict(x.split(": ", 1) for x in lines[1:])
            n = int(fields["Content-Length"])
            assert rest[n: n + 4] == b"\r\n\r\n"
            found.append((fields["WARC-Record-ID"], fields["WARC-Refers-To"], rest[:n].decode()))
            data = rest[n + 4:]
    assert sorted(found) == sorted((r.record_id, r.refers_to, r.block) for r in df.collect())


def test_empty_table(spark):
    assert warc.derive(warc.responses_of_pages(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_character_references_are_looked_for_once(spark):
    """Names that occur are replaced, not every known name in every text; an escaped ampersand is decoded once."""
    html = {k: f"&{name};&#38;{name};&amp;{name};&{name} &{name.upper()};" for k, name in enumerate(warc.ENTITIES)}
    html |= {100: "&nosuch;&lt;&lt;&#65;&#65;", 101: "none", 102: "&", 103: "&&gt;;"}
    df = spark.createDataFrame(list(html.items()), "k int, html string").select("k", warc.plain_text(F.col("html")).alias("text"))
    got = {r.k: r.text for r in df.collect()}
    for k, (name, character) in enumerate(warc.ENTITIES.items()):
        shown = " " if name == "nbsp" else character
        if name != "amp":
            assert got[k] == f"{shown}&{name};&{name};&{name} &{name.upper()};".lstrip(" ")
    assert [got[k] for k in (100, 101, 102, 103)] == ["&nosuch;<<AA", "none", "&", "&>;"]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("replace(") < len(warc.ENTITIES)
