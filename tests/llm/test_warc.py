import hashlib

import compare
from odd_tables import empty, odd

from stationlens.llm import warc
from stationlens.llm.registry import ORACLES, QUERIES


def test_against_sql(spark, duck, sf_dir):
    rows, problems = compare.differences(QUERIES["op2_warc_derivatives"](spark, sf_dir), duck, ORACLES["op2_warc_derivatives"])
    assert not problems and rows > 0


def parse(data):
    """Records of a WARC file by their Content-Length."""
    out = []
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        fields = dict(line.split(": ", 1) for line in lines[1:])
        size = int(fields["Content-Length"])
        block, end = rest[:size], rest[size : size + 4]
        assert end == b"\r\n\r\n"
        assert fields["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
        out.append((fields, block.decode()))
        data = rest[size + 4 :]
    return out


def test_files_hold_linked_records(spark, tmp_path):
    pages = [(1, "http://a/ü", "<p>Über &amp;lt; <b>x</b><script>no()</script><br>y\r\n\r\nz</p>"), (2, "http://b", "")]
    responses = warc.responses_of_pages(spark.createDataFrame(pages, "page_id long, url string, html string"))
    warc.write_warc(warc.derivatives(responses), str(tmp_path / "w"))
    records = [r for f in sorted((tmp_path / "w").glob("part-*")) for r in parse(f.read_bytes())]
    assert len(records) == 4
    by_type = {(f["WARC-Type"], f["WARC-Target-URI"]): (f, b) for f, b in records}
    fields, text = by_type["conversion", "http://a/ü"]
    meta_fields, meta = by_type["metadata", "http://a/ü"]
    assert text == "Über &lt; x\ny\nz"
    source = responses.filter("page_id = 1").first()["record"]
    source_id = source.split("WARC-Record-ID: ")[1].split("\r\n")[0]
    assert fields["WARC-Refers-To"] == meta_fields["WARC-Refers-To"] == source_id
    assert f"conversion: {fields['WARC-Record-ID']}\r\n" in meta
    assert "source-header-Content-Type: text/html; charset=utf-8\r\n" in meta
    digest = "sha256:" + hashlib.sha256(pages[0][2].encode()).hexdigest()
    assert f"source-payload-digest: {digest}\r\n" in meta


def test_odd_records(spark):
    docs = odd(spark).selectExpr("*", "text as record", "1 as record_id", "2 as target_uri")
    rows = warc.derivatives(docs).collect()
    assert len(rows) == 2 * docs.count()
    assert all(r["refers_to"] == "" and r["content_length"] == len(r["record"].split("\r\n\r\n", 1)[1].encode()) for r in rows)
    pages = spark.createDataFrame([(None, None, None), (1, "u", None), (1, "u", None)], "page_id long, url string, html string")
    got = warc.derivatives(warc.responses_of_pages(pages)).collect()
    assert len(got) == 6 and len({r["record_id"] for r in got}) == 4


def test_empty(spark):
    assert warc.derivatives(empty(spark).withColumnRenamed("text", "record")).collect() == []


def response(body, kind="response", http="HTTP/1.1 200 OK\r\nContent-Type: text/html", behind="\r\n\r\n", length=None):
    block = f"{http}\r\n\r\n{body}"
    length = len(block.encode()) if length is None else length
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: {length}\r\n\r\n{block}{behind}"


def texts(spark, records):
    rows = warc.derivatives(spark.createDataFrame(list(enumerate(records)), "n int, record string")).collect()
    out = [None] * len(records)
    for r in rows:
        if r["warc_type"] == "conversion":
            out[r["n"]] = r["record"].split("\r\n\r\n", 1)[1]
    return rows, out


def test_block_ends_where_its_header_says(spark):
    records = [response("<p>über</p>"), response("<p>über</p>", behind=""), response("abc", behind="\r\n\r\nWARC/1.1\r\nnext"), response("abc", length=10**6), response("abc", length="many")]
    rows, found = texts(spark, records)
    assert found == ["über", "über", "abc", "abc", "abc"]
    digests = {(r["n"], r["source_payload_digest"]) for r in rows}
    want = lambda b: "sha256:" + hashlib.sha256(b.encode()).hexdigest()
    assert digests == {(0, want("<p>über</p>")), (1, want("<p>über</p>")), (2, want("abc")), (3, want("abc\r\n\r\n")), (4, want("abc\r\n\r\n"))}


def test_only_textual_responses_are_converted(spark):
    html = "HTTP/1.1 200 OK\r\nContent-Type: "
    records = [response("x", http=html + "image/png"), response("x", kind="request"), response("x", http=html + "text/plain; charset=utf-8"),
               response("x", http="HTTP/1.1 200 OK"), response("x", http=html + "application/xhtml+xml"), response("x", kind="Response")]
    rows, found = texts(spark, records)
    assert found == [None, None, "x", "x", "x", "x"]
    assert [sum(r["n"] == i for r in rows) for i in range(6)] == [1, 1, 2, 2, 2, 2]
    assert all(("conversion: " in r["record"]) == (found[r["n"]] is not None) for r in rows if r["warc_type"] == "metadata")


def test_entities(spark):
    cases = [
        ("a &mdash; b &#8212; c &#x2014; d &eacute;&Eacute;", "a — b — c — d éÉ"), ("&amp;mdash; &#38;lt; &AMP;#65;", "&mdash; &lt; &#65;"),
        ("&lt;b&gt; &LT; &quot;&#39;&apos;", "<b> < \"''"), ("1&#160;2&nbsp;3", "1 2 3"), ("&#150;&#x80;&#129;", "–€\ufffd"), ("&#0;&#xD800;&#9999999;&#x1F600;", "\ufffd\ufffd\ufffd😀"),
        ("AT&T; R&D &unknown; & &; &copy", "AT&T; R&D &unknown; & &; &copy"), ("&&eacute;&", "&é&"),
    ]
    _, found = texts(spark, [response(a) for a, _ in cases])
    assert found == [b for _, b in cases]


def test_columns_with_clashing_names_are_kept(spark):
    df = spark.createDataFrame([(response("x"), "i", "d", "u", "t")], "record string, _id string, _date string, _uri string, _text string")
    for r in warc.derivatives(df).collect():
        assert (r["_id"], r["_date"], r["_uri"], r["_text"]) == ("i", "d", "u", "t") and r["refers_to"] == "<urn:x>"


def test_blanks_are_tidied_as_by_the_patterns(spark):
    import re

    cases = ["a \t b\r\n \n c  ", " \f\n x \n\n  y\t", "a\n b", "a \nb", "\r", "a &nbsp; b &amp;nbsp;\n", "x  ", "a  b\n\n\n c d"]
    want = []
    for text in cases:
        for entity, character in warc.ENTITIES:
            text = text.replace(entity, character)
        for pattern, new in warc.TIDY:
            text = re.sub(pattern, new, text)
        want.append(text)
    df = spark.createDataFrame(list(enumerate(cases)), "n int, t string")
    got = df.select("n", warc.tidied(df["t"]).alias("t")).orderBy("n")
    assert [r["t"] for r in got.collect()] == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 2
