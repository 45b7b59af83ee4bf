"""WARC derivatives: a metadata and a plain-text conversion record for each response.

Input are complete response records (header lines, empty line, HTTP message), as rows.
A response with a textual body becomes two linked records, other records (requests,
images) only the metadata one. The block of a record has the length its header states; what
lies behind it, such as the two line ends between records, is no part of it. Both refer to the response by its record id, target URI
and date. The conversion record holds the page as plain text. The metadata record keeps
what the text loses: status line and HTTP headers of the source, its payload digest and
length, and the ids and digests that link the three records. Ids of derivatives are made
of the type and the id of the source, so a second run gives the same ids.

Text: comments, scripts and styles go; tags of block elements end a line, others vanish;
entities with a semicolon are decoded once, numeric ones and all names of HTML 5; runs of
blanks become one, empty lines go.

Everything is DataFrame functions. ``write_warc`` writes records as a WARC file per task
with Spark's own text writer, so lost tasks and commits are handled by Spark.

A null or malformed record counts as a response with empty fields: its derivatives have an
empty text and refer to the empty id. A header that is not there is empty, a length that is
not there or beyond the end is that of the rest. Null pages are empty
responses. Repeated rows give repeated records with equal ids. Further columns are kept
unless their names are those of the new columns; names with the prefix ``_warc_`` are used
inside and dropped. No rows give no rows.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
# What is taken out of a page, in this order, and what takes its place.
STRIP = (
    (r"(?s)<!--.*?-->", ""),
    (r"(?is)<script\b[^>]*>.*?</script[ \t\r\n]*>", ""),
    (r"(?is)<style\b[^>]*>.*?</style[ \t\r\n]*>", ""),
    (r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|article|section|nav|header|footer|title|head|body|html|hr|pre|blockquote)\b[^>]*>", "\n"),
    (r"<[!/?a-zA-Z][^>]*>", ""),
)
ENTITIES = (("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
TIDY = ((r"[ \t\r\f]+", " "), (r" ?\n ?", "\n"), (r"\n+", "\n"), (r"^[ \n]+|[ \n]+$", ""))
# Fixed value: bodies that are converted; a response that does not name its type is, too.
TEXTUAL = r"(?i)^(text/|application/(xhtml\+)?xml)"
ADDED = ("warc_type", "record_id", "refers_to", "target_uri", "source_date", "content_type", "content_length", "block_digest", "source_payload_digest", "record")


_REFERENCE = r"(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"
_OTHER = "&(?!(?:" + "|".join(e[1:-1] for e, _ in ENTITIES) + ");)" + _REFERENCE


def _decoded(html: Column) -> Column:
    """Entities other than ``ENTITIES`` as characters; an ampersand stays an entity for the last step."""
    names = {n[:-1]: c.replace("\xa0", " ").replace("&", "&amp;") for n, c in html5.items() if n.endswith(";")}
    # What numbers stand for that are no characters: those of the old code page, as browsers read them.
    page = {n: bytes([n]).decode("cp1252", errors="ignore") or "\ufffd" for n in range(128, 160)}
    page |= {0: "\ufffd", 38: "&amp;", 160: " "}
    table = lambda d: F.from_json(F.lit(json.dumps(d)), "map<string,string>")

    def piece(part: Column) -> Column:
        name = F.regexp_extract(part, "^" + _REFERENCE, 1)
        digits = F.regexp_extract(name, "^#([0-9]+)$", 1).try_cast("long")
        code = F.coalesce(digits, F.conv(F.regexp_extract(name, "^#[xX]([0-9a-fA-F]+)$", 1), 16, 10).try_cast("long"))
        real = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        point = F.when(real, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("\ufffd")
        numeric = F.coalesce(F.try_element_at(table({str(n): c for n, c in page.items()}), code.cast("string")), point)
        found = F.when(F.startswith(name, F.lit("#")), numeric).otherwise(F.try_element_at(table(names), name))
        rest = F.substring(part, F.length(name) + 2, F.length(part))
        return F.when((name != "") & found.isNotNull(), F.concat(found, rest)).otherwise(F.concat(F.lit("&"), part))

    parts = F.split(html, "&", -1)
    return F.when(html.rlike(_OTHER), F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), piece), ""))).otherwise(html)


def without_tags(html: Column) -> Column:
    for pattern, new in STRIP:
        html = F.regexp_replace(html, pattern, new)
    return html


def tidied(stripped: Column) -> Column:
    """Text without tags as plain text. Pass a column: it is used several times."""
    text = _decoded(stripped)
    for entity, character in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(character))
    text = F.when(F.contains(stripped, F.lit("&")), text).otherwise(stripped)
    # ``TIDY`` with plain replacements, and patterns that begin with a character of their own.
    for blank in "\t\r\f":
        text = F.replace(text, F.lit(blank), F.lit(" "))
    text = F.regexp_replace(F.regexp_replace(text, "  +", " "), r"\n[ \n]+", "\n")
    return F.btrim(F.replace(text, F.lit(" \n"), F.lit("\n")), F.lit(" \n"))


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def _lines(*pairs: tuple[str, Column]) -> Column:
    return F.concat(*[F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)) for name, value in pairs])


def responses_of_pages(pages: DataFrame, date: str = DATE) -> DataFrame:
    """``pages`` (page_id, url, html) with ``record``: the page as a response record."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    size = lambda c: F.octet_length(c).cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size("_warc_html"), F.lit(CRLF * 2), F.col("_warc_html"))
    header = _lines(
        ("WARC-Type", F.lit("response")), ("WARC-Record-ID", _uuid(F.lit("response"), text("page_id"), text("url"))), ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", text("url")), ("WARC-Payload-Digest", _digest(F.col("_warc_html"))),
        ("Content-Type", F.lit("application/http; msgtype=response")), ("Content-Length", size("_warc_http")),
    )
    made = pages.withColumn("_warc_html", text("html")).withColumn("_warc_http", http)
    return made.withColumn("record", F.concat(F.lit(f"WARC/1.1{CRLF}"), header, F.lit(CRLF), F.col("_warc_http"))).drop("_warc_html", "_warc_http")


def derivatives(responses: DataFrame, record_col: str = "record") -> DataFrame:
    """A metadata row for each record, and a conversion row for each textual response; other columns are kept."""
    others = [F.col(f"`{c}`") for c in responses.columns if c != record_col and c not in ADDED]
    record = F.coalesce(F.col(f"`{record_col}`").cast("string"), F.lit(""))
    break_at = lambda c: F.locate(CRLF * 2, F.col(c))
    head = lambda c, at: F.when(F.col(at) > 0, F.substring(F.col(c), F.lit(1), F.col(at) - 1)).otherwise(F.col(c))
    tail = lambda c, at: F.when(F.col(at) > 0, F.substring(F.col(c), F.col(at) + 4, F.length(c))).otherwise("")
    field = lambda name: F.trim(F.regexp_extract("_warc_head", rf"(?im)^{name}:([^\r\n]*)", 1))
    read = (
        responses.select(*others, record.alias("_warc_record"))
        .withColumn("_warc_at", break_at("_warc_record"))
        .withColumns({"_warc_head": head("_warc_record", "_warc_at"), "_warc_rest": tail("_warc_record", "_warc_at")})
        .withColumn("_warc_stated", field("Content-Length").try_cast("int"))
        .withColumn(
            "_warc_block",
            F.when(F.col("_warc_stated").between(0, F.octet_length("_warc_rest") - 1), F.substring(F.col("_warc_rest").cast("binary"), F.lit(1), F.col("_warc_stated")).cast("string"))
            .otherwise(F.col("_warc_rest")),
        )
        .withColumn("_warc_at", break_at("_warc_block"))
        .withColumns({"_warc_http": head("_warc_block", "_warc_at"), "_warc_payload": tail("_warc_block", "_warc_at")})
        .withColumn("_warc_type", F.trim(F.regexp_extract("_warc_http", r"(?im)^Content-Type:([^\r\n]*)", 1)))
        .withColumn("_warc_textual", F.lower(field("WARC-Type")).isin("", "response") & ((F.col("_warc_type") == "") | F.col("_warc_type").rlike(TEXTUAL)))
        .withColumns({"_warc_id": field("WARC-Record-ID"), "_warc_uri": field("WARC-Target-URI"), "_warc_date": field("WARC-Date"), "_warc_claimed": field("WARC-Payload-Digest")})
        .withColumns(
            {
                "_warc_digest": F.when(F.col("_warc_claimed") != "", F.col("_warc_claimed")).otherwise(_digest(F.col("_warc_payload"))),
                "_warc_length": F.octet_length("_warc_payload").cast("string"),
                "_warc_stripped": F.when(F.col("_warc_textual"), without_tags(F.col("_warc_payload"))).otherwise(""),
                "_warc_meta_id": _uuid(F.lit("metadata"), F.col("_warc_id")),
                "_warc_text_id": _uuid(F.lit("conversion"), F.col("_warc_id")),
            }
        )
        .drop("_warc_record", "_warc_rest", "_warc_stated", "_warc_block", "_warc_payload", "_warc_head", "_warc_claimed", "_warc_at", "_warc_type")
        .withColumn("_warc_text", tidied(F.col("_warc_stripped")))
        .withColumn("_warc_text_digest", _digest(F.col("_warc_text")))
    )
    source = F.concat(F.lit("source-"), F.regexp_replace("_warc_http", CRLF, f"{CRLF}source-header-"))
    meta = F.concat(
        _lines(("refers-to", F.col("_warc_id")), ("source-payload-digest", F.col("_warc_digest")), ("source-payload-length", F.col("_warc_length"))),
        F.when(F.col("_warc_textual"), _lines(("conversion", F.col("_warc_text_id")), ("conversion-digest", F.col("_warc_text_digest")))).otherwise(""),
        F.when(F.col("_warc_http") != "", F.concat(source, F.lit(CRLF))).otherwise(""),
    )
    rows = F.array(
        F.struct(F.lit("metadata").alias("t"), F.col("_warc_meta_id").alias("i"), F.lit("application/warc-fields").alias("c"), meta.alias("b"), _digest(meta).alias("d")),
        F.struct(F.lit("conversion").alias("t"), F.col("_warc_text_id").alias("i"), F.lit("text/plain; charset=utf-8").alias("c"), F.col("_warc_text").alias("b"), F.col("_warc_text_digest").alias("d")),
    )
    two = read.withColumn("_warc_r", F.explode(F.slice(rows, F.lit(1), F.when(F.col("_warc_textual"), 2).otherwise(1)))).drop("_warc_text", "_warc_stripped")
    block = F.col("_warc_r.b")
    header = _lines(
        ("WARC-Type", F.col("_warc_r.t")), ("WARC-Record-ID", F.col("_warc_r.i")), ("WARC-Date", F.col("_warc_date")), ("WARC-Target-URI", F.col("_warc_uri")),
        ("WARC-Refers-To", F.col("_warc_id")), ("WARC-Refers-To-Target-URI", F.col("_warc_uri")), ("WARC-Refers-To-Date", F.col("_warc_date")),
        ("WARC-Block-Digest", F.col("block_digest")), ("Content-Type", F.col("_warc_r.c")), ("Content-Length", F.col("content_length").cast("string")),
    )
    two = two.withColumns({"content_length": F.octet_length(block).cast("long"), "block_digest": F.col("_warc_r.d")})
    return two.select(
        *others, F.col("_warc_r.t").alias("warc_type"), F.col("_warc_r.i").alias("record_id"), F.col("_warc_id").alias("refers_to"), F.col("_warc_uri").alias("target_uri"),
        F.col("_warc_date").alias("source_date"), F.col("_warc_r.c").alias("content_type"), "content_length", "block_digest",
        F.col("_warc_digest").alias("source_payload_digest"), F.concat(F.lit(f"WARC/1.1{CRLF}"), header, F.lit(CRLF), block).alias("record"),
    )


def write_warc(records: DataFrame, path: str, compression: str | None = None) -> None:
    """Records as WARC files, two line ends behind each; ``compression`` is one of Spark's text codecs."""
    writer = records.select("record").write.option("lineSep", CRLF * 2)
    (writer.option("compression", compression) if compression else writer).text(path)


def _sql_replace(text: str, steps, regex: bool) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    for old, new in steps:
        text = f"regexp_replace({text}, {quote(old)}, {quote(new)}, 'g')" if regex else f"replace({text}, {quote(old)}, {quote(new)})"
    return text


def oracle() -> str:
    """The derivatives of ``pages`` for DuckDB; digests stand for the records."""
    uuid = lambda h: f"'<urn:uuid:' || {h}[1:8] || '-' || {h}[9:12] || '-' || {h}[13:16] || '-' || {h}[17:20] || '-' || {h}[21:32] || '>'"
    text = _sql_replace(_sql_replace(_sql_replace("html", STRIP, True), ENTITIES, False), TIDY, True)
    line = lambda name, value: f"'{name}: ' || {value} || e"
    meta = " || ".join([
        line("refers-to", "id"), line("source-payload-digest", "digest"), line("source-payload-length", "strlen(html)::varchar"),
        line("conversion", "text_id"), line("conversion-digest", "'sha256:' || sha256(txt)"),
        "'source-HTTP/1.1 200 OK' || e || 'source-header-Content-Type: text/html; charset=utf-8' || e || 'source-header-Content-Length: ' || strlen(html)::varchar || e",
    ])
    header = " || ".join([
        line("WARC-Type", "warc_type"), line("WARC-Record-ID", "record_id"), line("WARC-Date", f"'{DATE}'"), line("WARC-Target-URI", "url"),
        line("WARC-Refers-To", "id"), line("WARC-Refers-To-Target-URI", "url"), line("WARC-Refers-To-Date", f"'{DATE}'"),
        line("WARC-Block-Digest", "'sha256:' || sha256(block)"), line("Content-Type", "content_type"), line("Content-Length", "strlen(block)::varchar"),
    ])
    return f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, chr(13) || chr(10) AS e FROM pages),
a AS (SELECT *, md5('response|' || coalesce(page_id::varchar, '') || '|' || url) AS h, {text} AS txt, 'sha256:' || sha256(html) AS digest FROM p),
b AS (SELECT *, {uuid('h')} AS id FROM a),
c AS (SELECT *, md5('metadata|' || id) AS hm, md5('conversion|' || id) AS hc FROM b),
d AS (SELECT *, {uuid('hm')} AS meta_id, {uuid('hc')} AS text_id FROM c),
r AS (SELECT *, 'metadata' AS warc_type, meta_id AS record_id, 'application/warc-fields' AS content_type, {meta} AS block FROM d
      UNION ALL SELECT *, 'conversion', text_id, 'text/plain; charset=utf-8', txt FROM d)
SELECT page_id, warc_type, record_id, id AS refers_to, url AS target_uri, '{DATE}' AS source_date, content_type,
       strlen(block)::bigint AS content_length, 'sha256:' || sha256(block) AS block_digest, digest AS source_payload_digest,
       sha256('WARC/1.1' || e || {header} || e || block) AS record_sha256
FROM r"""
