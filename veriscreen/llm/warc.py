"""WARC derivatives: response records become linked metadata and plain-text conversion records.

From each response two records follow: `metadata` (application/warc-fields: title, links, the source's status line and HTTP
headers, its digests) and `conversion` (text/plain of its HTML). Both refer to the response by its id, URI and date and
to each other by WARC-Concurrent-To. Ids are made from digests of content, so a record lost with an executor comes back
the same. One pass, no shuffle; all but the decoding of character references is DataFrame expressions.

Null URLs and payloads count as empty: an empty page gives records with empty blocks. Repeated rows give equal records
with equal ids. Empty tables give no rows; other columns are ignored. All named and numeric character references of HTML5
are decoded, once, by the rules of html.unescape; a no-break space so written becomes a space. Texts are UTF-8; a response
block without an empty line has headers and no payload. Control characters of an address are percent-encoded in header
lines, and those of other values become spaces, so that no value writes a line of its own.
"""

from __future__ import annotations

import html as entities
import html.entities
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DATE = "2026-01-01T00:00:00Z"
CRLF = "\r\n"
VERSION = "WARC/1.1"

#: Elements whose content is no text, and elements that end a line.
SILENT = ("script", "style", "noscript", "template", "svg")
BREAKING = "address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr|li|main|nav|ol|option|p|pre|section|table|td|th|title|tr|ul"

#: Regex and replacement, in order; valid alike in Java and RE2.
STEPS = (
    ("(?is)<(?:!--.*?--|" + "|".join(rf"{x}\b[^>]*>.*?</{x}\s*" for x in SILENT) + ")>", ""),
    (rf"(?i)</?(?:{BREAKING})\b[^>]*>", "\n"),
    (r"</?[A-Za-z!][^>]*>", ""),
)
LINK = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*["']?([^"'\s>]+)"""
TIDY = ((r"[ \t\f\r]{2,}|[\t\f\r]", " "), (r" ?\n[ \n]*", "\n"))


#: Names of HTML5 have letters and digits only, 31 at most.
REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]{1,31};?)")
LONGEST = 4000  # characters of a numeric reference that html.unescape takes without an error


@lru_cache(maxsize=4096)
def _character(reference: str) -> str:
    if len(reference) > LONGEST:
        reference = "&#x" + reference[3:].lstrip("0") if reference[2] in "xX" else "&#" + reference[2:].lstrip("0")
        if len(reference) > LONGEST:
            return "\ufffd"
    return entities.unescape(reference).replace("\xa0", " ")


def decode(text: str) -> str:
    """The text with each character reference decoded once."""
    return REFERENCE.sub(lambda m: _character(m[0]), text) if "&" in text else text


def decoded(text: Column) -> Column:
    def run(values: pa.Array) -> pa.Array:
        return pa.array([x and decode(x) for x in values.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(text)


def html_text(html: Column) -> Column:
    """The text of HTML, one line for each block element."""
    for regex, by in STEPS:
        html = F.regexp_replace(html, regex, by)
    html = decoded(html)
    for regex, by in TIDY:
        html = F.regexp_replace(html, regex, by)
    return F.btrim(html, F.lit(" \n"))


def _digest(x: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(x, 256))


def _urn(kind: str, *parts: Column) -> Column:
    h = F.sha2(F.concat_ws("\n", F.lit(kind), *parts), 256)
    return F.concat(F.lit("urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-8"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def _one_line(value: Column) -> Column:
    return F.regexp_replace(value, r"[\x00-\x1F\x7F]+", " ")


def _address(url: Column) -> Column:
    """An address for a header line: control characters, spaces among them, are percent-encoded."""
    return F.when(url.rlike(r"[\x00-\x20\x7F]"), F.array_join(F.transform(F.split(url, ""), lambda x: F.when(x.rlike(r"^[\x00-\x20\x7F]\z"), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(x)), 2, "0"))).otherwise(x)), "")).otherwise(url)


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records (page_id, record_id, target_uri, date, block) of pages(page_id, url, html)."""
    url, html = (F.coalesce(F.col(c), F.lit("")) for c in ("url", "html"))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(html).cast("string"), F.lit(CRLF * 2))
    return pages.select("page_id", _urn("response", url, F.lit(date), html).alias("record_id"), url.alias("target_uri"), F.lit(date).alias("date"), F.concat(head, html).alias("block"))


def _fields(*pairs: tuple[str, Column]) -> Column:
    return F.concat(*(x for name, value in pairs for x in (F.lit(f"{name}: "), value, F.lit(CRLF))))


def derive(found: DataFrame, *, decode_title: bool = False) -> DataFrame:
    """Metadata and conversion records of response records (page_id, record_id, target_uri, date, block). The metadata's
    title is as the page writes it, or with decode_title as a reader sees it.

    (page_id, warc_type, record_id, refers_to, target_uri, content_length, block_digest, header, block)
    """
    cut = F.instr("block", CRLF * 2)
    at = F.when(cut > 0, cut).otherwise(F.char_length("block") + 1)
    out = found.withColumn("http", F.substring("block", F.lit(1), at - 1)).withColumn("payload", F.expr("substring(block, char_length(http) + 5)"))
    out = out.withColumn("text", html_text(F.col("payload")))
    lines = F.split("http", CRLF, -1)
    headers = F.array_join(F.transform(F.filter(F.slice(lines, F.lit(2), F.size(lines)), lambda x: x != ""), lambda x: F.concat(F.lit("source-header: "), _one_line(x), F.lit(CRLF))), "")
    title = F.regexp_extract("payload", r"(?is)<title[^>]*>(.*?)</title", 1)
    title = F.trim(F.regexp_replace(decoded(title) if decode_title else title, r"\s+", " "))
    out = out.withColumn("digest", _digest(F.col("payload"))).withColumn("metadata_id", _urn("metadata", F.col("record_id"))).withColumn("conversion_id", _urn("conversion", F.col("record_id"), F.col("text")))
    out = out.withColumn("links", F.regexp_extract_all("payload", F.lit(LINK), F.lit(1)))
    links = F.array_join(F.transform("links", lambda x: F.concat(F.lit("outlink: "), _one_line(x), F.lit(CRLF))), "")
    about = F.concat(_fields(("title", title), ("outlinks", F.size("links").cast("string"))), links, _fields(("source-status", _one_line(F.element_at(lines, 1)))), headers, _fields(("source-payload-digest", F.col("digest")), ("source-block-digest", _digest(F.col("block")))))
    kinds = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.col("metadata_id").alias("id"), F.col("conversion_id").alias("other"), F.lit("application/warc-fields").alias("kind"), about.alias("body")),
        F.struct(F.lit("conversion").alias("warc_type"), F.col("conversion_id").alias("id"), F.col("metadata_id").alias("other"), F.lit("text/plain; charset=utf-8").alias("kind"), F.col("text").alias("body")),
    )
    out = out.select("page_id", "record_id", "target_uri", "date", _address(F.col("target_uri")).alias("address"), F.inline(kinds))
    size, digest = F.octet_length("body"), _digest(F.col("body"))
    angle = lambda c: F.concat(F.lit("<"), F.col(c), F.lit(">"))
    header = F.concat(F.lit(VERSION + CRLF), _fields(
        ("WARC-Type", F.col("warc_type")), ("WARC-Record-ID", angle("id")), ("WARC-Date", F.col("date")), ("WARC-Target-URI", F.col("address")),
        ("WARC-Refers-To", angle("record_id")), ("WARC-Refers-To-Target-URI", F.col("address")), ("WARC-Refers-To-Date", F.col("date")),
        ("WARC-Concurrent-To", angle("other")), ("WARC-Block-Digest", digest), ("Content-Type", F.col("kind")), ("Content-Length", size.cast("string")),
    ))
    return out.select("page_id", "warc_type", F.col("id").alias("record_id"), F.col("record_id").alias("refers_to"), "target_uri", size.cast("long").alias("content_length"), digest.alias("block_digest"), header.alias("header"), F.col("body").alias("block"))


def record(header: Column, block: Column) -> Column:
    """A record as it stands in a file, without the two line ends behind it."""
    return F.concat(header, F.lit(CRLF), block)


def write_warc(records: DataFrame, path: str) -> None:
    """Files of records(header, block), uncompressed; a record ends with the two line ends that the writer puts there."""
    records.select(record(F.col("header"), F.col("block"))).write.option("lineSep", CRLF * 2).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(fields, all_fields, block) of the records of uncompressed WARC files, cut by their Content-Length. fields maps
    lower-cased names to values, of a repeated field to the first; all_fields has every name and value in order. A file is
    read as a whole by one task. Blocks are text; bytes that are no UTF-8 become U+FFFD. A record that breaks off raises."""
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                found = list(cut_records(raw))
                for k in range(0, len(found), 500):
                    rows = [{"fields": list(dict(reversed([(n.lower(), v) for n, v in names])).items()), "all_fields": [{"name": n, "value": v} for n, v in names], "block": body.decode("utf-8", "replace")} for names, body in found[k : k + 500]]
                    yield pa.RecordBatch.from_pylist(rows, pa.schema([("fields", pa.map_(pa.string(), pa.string())), ("all_fields", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), ("block", pa.string())]))

    return files.mapInArrow(run, "fields map<string,string>, all_fields array<struct<name:string,value:string>>, block string")


def cut_records(raw: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(name and value of each field, block) of the records of a file."""
    at = 0
    while at < len(raw):
        if raw[at : at + 2] == b"\r\n":  # between records
            at += 2
            continue
        end = raw.find(b"\r\n\r\n", at)
        if end < 0 or not raw.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        lines = raw[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        names = [(name.strip(), value.strip()) for name, _, value in (x.partition(":") for x in lines)]
        size = next((int(v) for n, v in names if n.lower() == "content-length"), None)
        if size is None or end + 4 + size > len(raw):
            raise ValueError(f"the record at byte {at} has no length, or breaks off")
        yield names, raw[end + 4 : end + 4 + size]
        at = end + 4 + size


def _decoded_sql(text: str) -> str:
    """DuckDB: the text with each character reference of HTML5 decoded once; names and rules from Python's html module."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    table = lambda pairs: f"MAP([{', '.join(k for k, _ in pairs)}], [{', '.join(v for _, v in pairs)}])"
    plain = lambda s: s.replace("\xa0", " ")
    names = table([(quote(k), quote(plain(v))) for k, v in sorted(entities.entities.html5.items())])
    odd = table([(str(k), f"chr({ord(plain(v))})") for k, v in sorted(entities._invalid_charrefs.items())])
    gone = ", ".join(map(str, sorted(entities._invalid_codepoints)))
    number = "coalesce(CASE WHEN r[2] IN ('x', 'X') THEN try_cast('0x' || coalesce(nullif(ltrim(regexp_extract(r, '[0-9a-fA-F]+', 0, ''), '0'), ''), '0') AS BIGINT) ELSE try_cast(regexp_extract(r, '[0-9]+') AS BIGINT) END, 1114112)".replace("regexp_extract(r, '[0-9a-fA-F]+', 0, '')", "rtrim(substr(r, 3), ';')")
    character = f"CASE WHEN map_contains({odd}, c) THEN {odd}[c] WHEN c BETWEEN 55296 AND 57343 OR c > 1114111 THEN chr(65533) WHEN c IN ({gone}) THEN '' WHEN c = 160 THEN ' ' ELSE chr(c::INTEGER) END"
    return f"""u AS (SELECT k, string_split(t, '&') AS p FROM ({text})),
u1 AS (SELECT k, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM u),
u2 AS (SELECT k, i, x, CASE WHEN i = 1 THEN '' ELSE regexp_extract(x, '^(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]{{1,31}};?)') END AS r FROM u1),
u3 AS (SELECT *, CASE WHEN r[1] = '#' THEN {number} END AS c, {names} AS names FROM u2),
u4 AS (SELECT k, i, x, r, CASE WHEN i = 1 THEN x WHEN r = '' THEN '&' || x WHEN r[1] = '#' THEN {character} || substr(x, length(r) + 1) WHEN map_contains(names, r) THEN names[r] || substr(x, length(r) + 1)
  ELSE coalesce(list_extract(list_transform(list_filter(range(length(r) - 1, 1, -1), lambda n: map_contains(names, substr(r, 1, n))), lambda n: names[substr(r, 1, n)] || substr(x, n + 1)), 1), '&' || x) END AS y FROM u3),
dec AS (SELECT k, string_agg(y, '' ORDER BY i) AS t FROM u4 GROUP BY k)"""


def duckdb_sql(date: str = DATE) -> str:
    """The rows (page_id, warc_type, record_id, refers_to, target_uri, content_length, block_digest, record) in DuckDB."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    n, text, tidy = "chr(13) || chr(10)", "payload", "dec.t"
    for regex, by in STEPS:
        text = f"regexp_replace({text}, {quote(regex)}, {quote(by)}, 'g')"
    for regex, by in TIDY:
        tidy = f"regexp_replace({tidy}, {quote(regex)}, {quote(by)}, 'g')"
    tidy = f"trim({tidy}, ' ' || chr(10))"
    title = "regexp_extract(payload, '(?is)<title[^>]*>(.*?)</title', 1)"
    urn = lambda h: f"'urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-8' || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"
    of = lambda kind, *parts: urn("sha256(" + " || chr(10) || ".join((quote(kind), *parts)) + ")")
    rows = []
    for kind, own, other, mime, body in (("metadata", "mid", "cid", "application/warc-fields", "about"), ("conversion", "cid", "mid", "text/plain; charset=utf-8", "text")):
        fields = (("WARC-Type", quote(kind)), ("WARC-Record-ID", f"'<' || {own} || '>'"), ("WARC-Date", quote(date)), ("WARC-Target-URI", "url"), ("WARC-Refers-To", "'<' || rid || '>'"), ("WARC-Refers-To-Target-URI", "url"), ("WARC-Refers-To-Date", quote(date)),
                  ("WARC-Concurrent-To", f"'<' || {other} || '>'"), ("WARC-Block-Digest", f"'sha256:' || sha256({body})"), ("Content-Type", quote(mime)), ("Content-Length", f"strlen({body})"))
        head = f"'{VERSION}' || {n} || " + " || ".join(f"'{k}: ' || {v} || {n}" for k, v in fields)
        rows.append(f"SELECT page_id, '{kind}' AS warc_type, {own} AS record_id, rid AS refers_to, url AS target_uri, strlen({body})::BIGINT AS content_length, 'sha256:' || sha256({body}) AS block_digest, {head} || {n} || {body} AS record FROM a")
    space = "[ \\t\\n\\x0B\\f\\r]+"
    return f"""WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS payload, row_number() OVER () AS k FROM pages),
r AS (SELECT *, {of("response", "url", quote(date), "payload")} AS rid, 'HTTP/1.1 200 OK' || {n} || 'Content-Type: text/html; charset=utf-8' || {n} || 'Content-Length: ' || strlen(payload) AS http FROM p),
{_decoded_sql(f"SELECT 2 * k AS k, {text} AS t FROM p UNION ALL SELECT 2 * k + 1, {title} FROM p")},
t AS (SELECT r.*, {tidy} AS text, trim(regexp_replace(d.t, '{space}', ' ', 'g')) AS title, regexp_extract_all(payload, {quote(LINK)}, 1) AS links FROM r JOIN dec ON dec.k = 2 * r.k JOIN dec d ON d.k = 2 * r.k + 1),
i AS (SELECT *, {of("metadata", "rid")} AS mid, {of("conversion", "rid", "text")} AS cid FROM t),
a AS (SELECT *, 'title: ' || title || {n} || 'outlinks: ' || len(links) || {n} || array_to_string(list_transform(links, lambda x: 'outlink: ' || x || {n}), '') || 'source-status: HTTP/1.1 200 OK' || {n}
  || 'source-header: Content-Type: text/html; charset=utf-8' || {n} || 'source-header: Content-Length: ' || strlen(payload) || {n} || 'source-payload-digest: sha256:' || sha256(payload) || {n} || 'source-block-digest: sha256:' || sha256(http || {n} || {n} || payload) || {n} AS about FROM i)
{" UNION ALL ".join(rows)}"""
