"""WARC derivatives: a metadata and a plain-text conversion record for each response.

Everything is DataFrame functions.  Record ids are name-based (from a digest of what they name), so a second
run makes the same records.  Both derivatives refer to the response by its id and carry its target address,
headers and payload digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
#: Character references that are resolved, in this order.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def record_id(*parts: Column) -> Column:
    """<urn:uuid:..> from the md5 of the parts joined by a unit separator (null: empty)."""
    h = F.md5(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *(x for i, (at, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] if i else []) + [F.substring(h, at, n)]), F.lit(">"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def plain_text(html: Column) -> Column:
    """Scripts, styles and comments removed, block ends as line ends, tags removed, references resolved,
    blanks collapsed and lines trimmed."""
    x = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script\s*>", " ")
    x = F.regexp_replace(x, r"(?is)<style[^>]*>.*?</style\s*>", " ")
    x = F.regexp_replace(x, r"(?s)<!--.*?-->", " ")
    x = F.regexp_replace(x, r"[ \t\r\n\f]+", " ")
    x = F.regexp_replace(x, r"(?i)<(br|/p|/div|/li|/h[1-6]|/tr|/title|/ul|/nav|/article|/section|/table)[^>]*>", "\n")
    x = F.regexp_replace(x, r"<[^>]*>", "")
    for name, char in ENTITIES:
        x = F.replace(x, F.lit(name), F.lit(char))
    return F.regexp_replace(F.regexp_replace(x, r"[ ]*\n[ \n]*", "\n"), r"^[ \n]+|[ \n]+$", "")


def page_title(html: Column) -> Column:
    """The first title's text, blanks collapsed; null if there is none."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title", 1), r"[ \t\r\n\f]+", " ")), F.lit(""))


def derivatives(responses: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", headers_col: str | None = None, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Two rows for each response: record_type metadata and conversion.

    Columns: the id, record_type, record_id, refers_to, target_uri, warc_date, content_type,
    source_headers, source_digest, block_digest, content_length (bytes), block.  A response's own id is made from
    its id, address and digest.  Null bodies count as empty; null addresses stay null.  Repeated rows give
    repeated records with the same ids.  Only the named columns are read.
    """
    body = F.coalesce(F.col(body_col).cast("string"), F.lit(""))
    headers = F.col(headers_col).cast("string") if headers_col else F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF))
    rows = responses.select(F.col(id_col), F.col(url_col).cast("string").alias("target_uri"), headers.alias("source_headers"), digest(body).alias("source_digest"), plain_text(body).alias("text_"), page_title(body).alias("title_"), F.octet_length(body).alias("size_"))
    rows = rows.withColumn("refers_to", record_id(F.lit("response"), F.col(id_col), F.col("target_uri"), F.col("source_digest")))
    facts = F.concat(F.lit("title: "), F.coalesce("title_", F.lit("")), F.lit("\r\nsource-length: "), F.col("size_").cast("string"), F.lit("\r\ntext-length: "), F.octet_length("text_").cast("string"), F.lit(CRLF))
    kinds = F.array(*(F.struct(F.lit(k).alias("record_type"), F.lit(t).alias("content_type"), b.alias("block")) for k, t, b in (("metadata", "application/warc-fields", facts), ("conversion", "text/plain; charset=utf-8", F.col("text_")))))
    rows = rows.select(id_col, "target_uri", "source_headers", "source_digest", "refers_to", F.explode(kinds).alias("k")).select("*", "k.*")
    return rows.select(id_col, "record_type", record_id(F.col("record_type"), F.col("refers_to")).alias("record_id"), "refers_to", "target_uri", F.lit(date).alias("warc_date"), "content_type", "source_headers", "source_digest", digest(F.col("block")).alias("block_digest"), F.octet_length("block").alias("content_length"), "block")


def warc_text(records: DataFrame) -> DataFrame:
    """(value): each derivative as a WARC 1.1 record, ready for a text writer with an empty line separator."""
    line = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(c).cast("string"), F.lit(CRLF))).otherwise("")
    head = [line(n, c) for n, c in (("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"), ("WARC-Source-Digest", "source_digest"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"))]
    return records.select(F.concat(F.lit("WARC/1.1\r\n"), *head, F.lit(CRLF), F.col("block"), F.lit(CRLF + CRLF)).alias("value"))


def write_warc(records: DataFrame, path: str) -> None:
    """Writes the derivatives as gzip-compressed WARC part files, one a partition."""
    warc_text(records).write.option("lineSep", "\n").option("compression", "gzip").text(path)


def oracle_sql(pages: str = "pages") -> str:
    """DuckDB SQL for :func:`derivatives` with the default columns and date."""
    uuid = lambda x: "'<urn:uuid:'||" + "||'-'||".join(f"substr({x},{a},{n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + "||'>'"
    text = "html"
    for pattern, to in ((r"(?is)<script[^>]*>.*?</script\s*>", "' '"), (r"(?is)<style[^>]*>.*?</style\s*>", "' '"), (r"(?s)<!--.*?-->", "' '"), (r"[ \t\r\n\f]+", "' '"), (r"(?i)<(br|/p|/div|/li|/h[1-6]|/tr|/title|/ul|/nav|/article|/section|/table)[^>]*>", "chr(10)"), (r"<[^>]*>", "''")):
        text = f"regexp_replace({text}, '{pattern}', {to}, 'g')"
    for name, char in ENTITIES:
        text = "replace({}, '{}', '{}')".format(text, name, char.replace("'", "''"))
    text = rf"regexp_replace(regexp_replace({text}, '[ ]*\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"
    title = r"nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1), '[ \t\r\n\f]+', ' ', 'g')), '')"
    return rf"""
WITH b AS (SELECT page_id, url AS target_uri, coalesce(html, '') AS html FROM {pages}),
r AS (SELECT page_id, target_uri, 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) AS source_headers,
  'sha256:' || sha256(html) AS source_digest, {text} AS text_, {title} AS title_, strlen(html) AS size_ FROM b),
s AS (SELECT *, md5(concat_ws(chr(31), 'response', coalesce(page_id::VARCHAR, ''), coalesce(target_uri, ''), source_digest)) AS h FROM r),
t AS (SELECT *, {uuid("h")} AS refers_to FROM s),
k AS (
  SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS content_type, 'title: ' || coalesce(title_, '') || chr(13) || chr(10) || 'source-length: ' || size_ || chr(13) || chr(10) || 'text-length: ' || strlen(text_) || chr(13) || chr(10) AS block FROM t
  UNION ALL
  SELECT *, 'conversion', 'text/plain; charset=utf-8', text_ FROM t),
n AS (SELECT *, md5(concat_ws(chr(31), record_type, refers_to)) AS g FROM k)
SELECT page_id, record_type, {uuid("g")} AS record_id, refers_to, target_uri, '1970-01-01T00:00:00Z' AS warc_date, content_type, source_headers, source_digest,
  'sha256:' || sha256(block) AS block_digest, strlen(block)::INTEGER AS content_length, block FROM n
"""
