"""Derivative WARC records: metadata and plain-text conversions of response records.

Every response gives one ``metadata`` record (links out, title, language, charset, size of the text)
and one ``conversion`` record (the page as plain text). Both refer to the response by its record id
and carry its target URI, date and digests; their own ids are computed from the response's id and the
record type, so a second run makes the same records. All of it is column expressions: rows are
neither moved nor seen by Python.

Defined results: a response without a payload gives a conversion of an empty text and metadata
without links; null addresses, dates and header fields leave out their header line; rows repeat as
they come, with equal ids for equal responses; extra columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
# The named character references that are resolved, beside all numeric ones.
REFERENCES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "trade": "™", "euro": "€", "hellip": "…",
    "mdash": "—", "ndash": "–", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»", "bull": "•", "middot": "·", "times": "×",
}
REFERENCE = "#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]{2,8}"
#: Elements that are no text, ends of blocks, and any other tag.
DROPPED = r"(?is)<!--.*?-->|<(?:script|style|noscript|template)\b[^>]*>.*?</(?:script|style|noscript|template)\s*>"
BLOCK_END = r"(?i)<br\b[^>]*>|</(?:p|div|h[1-6]|li|ul|ol|tr|table|article|section|nav|header|footer|title|head)\s*>"
TAG = r"(?s)<[^>]*>"


#: The value of an attribute in any quoting.
_VALUE = r"""\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
LINK = r"""(?i)<a\b[^>]*?[\s"']href""" + _VALUE
LANGUAGE = r"""(?i)<html\b[^>]*?[\s"']lang""" + _VALUE


def without_dropped(html: Column) -> Column:
    """A page without comments, scripts, styles and the like."""
    return F.regexp_replace(html, DROPPED, " ")


def _letter(name: Column) -> Column:
    """The character of a reference; a code that is none gives U+FFFD, an unknown name null."""
    hexadecimal = F.lower(F.substring(name, 1, 2)) == "#x"
    code = F.when(hexadecimal, F.conv(F.substr(name, F.lit(3)), 16, 10)).otherwise(F.substr(name, F.lit(2))).cast("bigint")
    none = (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    letter = F.decode(F.unhex(F.lpad(F.hex(F.when(none, 0xFFFD).otherwise(code)), 8, "0")), "UTF-32")
    names = F.create_map(*[F.lit(x) for pair in REFERENCES.items() for x in pair])
    return F.when(name.startswith("#"), letter).otherwise(F.try_element_at(names, name))


def resolved(text: Column) -> Column:
    """A text with its character references resolved, each once; what is none stays as it is."""

    def piece(part: Column, i: Column) -> Column:
        # What stands between an ampersand and the first semicolon behind it.
        end = F.instr(part, ";")
        name = F.substr(part, F.lit(1), end - 1)
        letter = F.when((end > 2) & (end < 11) & name.rlike(f"^(?:{REFERENCE})$"), _letter(name))
        told = F.coalesce(F.concat(letter, F.substr(part, end + 1)), F.concat(F.lit("&"), part))
        return F.when(i == 0, part).otherwise(told)

    return F.when(text.contains("&"), F.array_join(F.transform(F.split(text, "&", -1), piece), "")).otherwise(text)


def plain_text(bare: Column) -> Column:
    """Text of a page ``without_dropped``: blocks on lines of their own, runs of blanks as one, no empty lines."""
    text = F.regexp_replace(bare, BLOCK_END, "\n")
    text = resolved(F.regexp_replace(text, TAG, " "))
    text = F.regexp_replace(text, r"[ \t\r\f]{2,}|[\t\r\f]", " ")
    lines = F.replace(F.regexp_replace(text, r"\n[ \n]+", "\n"), F.lit(" \n"), F.lit("\n"))
    return F.trim(F.btrim(lines, F.lit("\n")))


def _unquoted(value: Column) -> Column:
    return F.regexp_replace(value, r"""^["']|["']$""", "")


def links(bare: Column) -> Column:
    """Addresses of the links of a page ``without_dropped``, in order, as they are written."""
    return F.transform(F.regexp_extract_all(bare, F.lit(LINK), 1), _unquoted)


def title(bare: Column) -> Column:
    """Text of the first title element, null without one."""
    found = F.regexp_extract(bare, r"(?is)<title[^>]*>(.*?)</title\s*>", 1)
    return F.when(found != "", F.trim(F.regexp_replace(found, r"\s+", " ")))


def language(bare: Column) -> Column:
    found = _unquoted(F.regexp_extract(bare, LANGUAGE, 1))
    return F.when(found != "", F.lower(found))


def digest(block: Column) -> Column:
    """Digest of a block's UTF-8 bytes, as WARC-Block-Digest has it."""
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def record_id(response_id: Column, kind: str) -> Column:
    """A urn:uuid made of the response's id and the record type."""
    h = F.md5(F.concat(response_id, F.lit(" " + kind)))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def responses_of_pages(pages: DataFrame) -> DataFrame:
    """Response records of crawled pages (page_id, url, html): the general input of ``derivatives``."""
    html = F.coalesce(F.col("html"), F.lit(""))
    address = F.coalesce(F.col("url"), F.lit(""))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(html).cast("string"), F.lit(CRLF))
    return pages.select(
        F.col("page_id"),
        record_id(F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(" "), address), "response").alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(None).cast("string").alias("date"),
        head.alias("http_headers"),
        html.alias("payload"),
    )


def _headers(fields: list[tuple[str, Column]]) -> Column:
    """Header lines; a field whose value is null has none."""
    lines = [F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))) for name, value in fields]
    return F.concat(F.lit("WARC/1.1" + CRLF), F.concat_ws("", *lines))


def derivatives(responses: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Two records per response (record_id, target_uri, date, http_headers, payload).

    Columns: those named in ``keep``, then record_type, record_id, refers_to, target_uri, source_type,
    source_digest (of the response's payload), block, block_digest, content_length and headers."""
    keep = keep or []
    source = responses.select(
        *[F.col(c) for c in keep],
        F.col("record_id").alias("refers_to"),
        "target_uri",
        F.col("date").alias("date_"),
        F.coalesce(F.col("payload"), F.lit("")).alias("payload_"),
        without_dropped(F.coalesce(F.col("payload"), F.lit(""))).alias("bare_"),
        F.regexp_extract(F.coalesce(F.col("http_headers"), F.lit("")), r"(?im)^content-type:\s*([^\r\n]*)", 1).alias("type_"),
        F.filter(F.split(F.coalesce(F.col("http_headers"), F.lit("")), r"\r?\n"), lambda line: line.rlike(r"^[^:\s]+:")).alias("lines_"),
    )
    html, bare = F.col("payload_"), F.col("bare_")
    # Columns of their own: each is worked out once.
    source = source.select("*", links(bare).alias("links_"), title(bare).alias("title_"), language(bare).alias("language_"))
    out = F.col("links_")
    fields = F.concat_ws(
        "",
        F.concat(F.lit("title: "), F.col("title_"), F.lit(CRLF)),
        F.concat(F.lit("language: "), F.col("language_"), F.lit(CRLF)),
        F.when(F.size(out) > 0, F.concat(F.array_join(F.transform(out, lambda u: F.concat(F.lit("outlink: "), u)), CRLF), F.lit(CRLF))),
    )
    both = source.select(
        "*",
        digest(html).alias("source_digest"),
        F.explode(F.array(
            F.struct(F.lit("metadata").alias("kind"), fields.alias("block"), F.lit("application/warc-fields").alias("mime")),
            F.struct(F.lit("conversion").alias("kind"), plain_text(bare).alias("block"), F.lit("text/plain; charset=utf-8").alias("mime")),
        )).alias("r"),
    )
    block = F.col("r.block")
    kind = F.col("r.kind")
    own_id = F.when(kind == "metadata", record_id(F.col("refers_to"), "metadata")).otherwise(record_id(F.col("refers_to"), "conversion"))
    made = both.select(
        *keep, kind.alias("record_type"), own_id.alias("record_id"), "refers_to", "target_uri", "date_",
        F.when(F.col("type_") != "", F.col("type_")).alias("source_type"), "source_digest",
        block.alias("block"), digest(block).alias("block_digest"), F.octet_length(block).cast("long").alias("content_length"), F.col("r.mime").alias("mime_"), "lines_",
    )
    # Every header line of the source, under a name that tells whose it is.
    sources = F.concat_ws("", F.transform("lines_", lambda line: F.concat(F.lit("X-Source-"), line, F.lit(CRLF))))
    headers = _headers([
        ("WARC-Type", F.col("record_type")), ("WARC-Record-ID", F.col("record_id")), ("WARC-Refers-To", F.col("refers_to")),
        ("WARC-Refers-To-Target-URI", F.col("target_uri")), ("WARC-Target-URI", F.col("target_uri")), ("WARC-Date", F.col("date_")),
        ("X-Source-Payload-Digest", F.col("source_digest")),
        ("WARC-Block-Digest", F.col("block_digest")), ("Content-Type", F.col("mime_")), ("Content-Length", F.col("content_length").cast("string")),
    ])
    return made.withColumn("headers", F.concat(headers, sources)).drop("date_", "mime_", "lines_")


def record_bytes(headers: Column, block: Column) -> Column:
    """A whole record as it stands in a WARC file."""
    return F.concat(headers, F.lit(CRLF), block, F.lit(CRLF + CRLF)).cast("binary")


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def oracle() -> str:
    """The query over ``pages`` in SQL."""
    names = ", ".join(f"{_sql(n)}: {_sql(c)}" for n, c in REFERENCES.items())
    code = "(CASE WHEN lower(x[1:2]) = '#x' THEN CAST('0x' || x[3:] AS BIGINT) ELSE CAST(x[2:] AS BIGINT) END)"
    letter = f"CASE WHEN {code} = 0 OR {code} BETWEEN 55296 AND 57343 OR {code} > 1114111 THEN chr(65533) ELSE chr(CAST({code} AS INTEGER)) END"
    one = f"CASE WHEN x[1:1] = '#' THEN {letter} ELSE coalesce(names[x], '&' || x || ';') END"
    unquoted = "regexp_replace({0}, '^[\"'']|[\"'']$', '', 'g')"
    crlf = "chr(13) || chr(10)"
    fields = [
        ("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Refers-To-Target-URI", "target_uri"),
        ("WARC-Target-URI", "target_uri"), ("X-Source-Payload-Digest", "source_digest"), ("WARC-Block-Digest", "block_digest"),
        ("Content-Type", "CASE record_type WHEN 'metadata' THEN 'application/warc-fields' ELSE 'text/plain; charset=utf-8' END"), ("Content-Length", "content_length::VARCHAR"),
        ("X-Source-Content-Type", "source_type"), ("X-Source-Content-Length", "strlen(html)::VARCHAR"),
    ]
    headers = " || ".join([f"'WARC/1.1' || {crlf}"] + [f"coalesce('{name}: ' || {value} || {crlf}, '')" for name, value in fields])
    uuid = "'<urn:uuid:' || {0}[1:8] || '-' || {0}[9:12] || '-' || {0}[13:16] || '-' || {0}[17:20] || '-' || {0}[21:32] || '>'"
    return f"""
    WITH p AS (
        SELECT page_id, url AS target_uri, coalesce(html, '') AS html, {uuid.format('u')} AS refers_to,
               regexp_replace(coalesce(html, ''), {_sql(DROPPED)}, ' ', 'g') AS bare, MAP {{{names}}} AS names
        FROM (SELECT *, md5(coalesce(page_id::VARCHAR, '') || ' ' || coalesce(url, '') || ' response') AS u FROM pages)
    ), parts AS (
        SELECT *, regexp_extract(bare, '(?is)<title[^>]*>(.*?)</title\\s*>', 1) AS t, lower({unquoted.format(f"regexp_extract(bare, {_sql(LANGUAGE)}, 1)")}) AS l,
               list_transform(regexp_extract_all(bare, {_sql(LINK)}, 1), lambda x: {unquoted.format('x')}) AS o,
               regexp_replace(regexp_replace(bare, {_sql(BLOCK_END)}, chr(10), 'g'), {_sql(TAG)}, ' ', 'g') AS shown
        FROM p
    ), pieces AS (
        SELECT *, string_split_regex(shown, {_sql(f"&(?:{REFERENCE});")}) AS k, list_transform(regexp_extract_all(shown, {_sql(f"&({REFERENCE});")}, 1), lambda x: {one}) AS r FROM parts
    ), clean AS (
        SELECT *, regexp_replace(array_to_string(list_transform(range(1, len(k) + 1), lambda i: k[i] || coalesce(r[i], '')), ''), '[ \\t\\r\\f]+', ' ', 'g') AS spaced FROM pieces
    ), blocks AS (
        SELECT page_id, 'conversion' AS record_type, refers_to, target_uri, html,
               trim(regexp_replace(regexp_replace(spaced, ' ?\\n[ \\n]*', chr(10), 'g'), '^\\n+|\\n+$', '', 'g'), ' ') AS block
        FROM clean
        UNION ALL
        SELECT page_id, 'metadata', refers_to, target_uri, html,
               CASE WHEN t <> '' THEN 'title: ' || trim(regexp_replace(t, '\\s+', ' ', 'g')) || {crlf} ELSE '' END
               || CASE WHEN l <> '' THEN 'language: ' || l || {crlf} ELSE '' END
               || CASE WHEN len(o) > 0 THEN array_to_string(list_transform(o, lambda x: 'outlink: ' || x), {crlf}) || {crlf} ELSE '' END
        FROM clean
    ), made AS (
        SELECT page_id, record_type, target_uri, refers_to, {uuid.format('i')} AS record_id, 'text/html; charset=utf-8' AS source_type,
               'sha256:' || sha256(html) AS source_digest, 'sha256:' || sha256(block) AS block_digest, strlen(block)::BIGINT AS content_length, block, html
        FROM (SELECT *, md5(refers_to || ' ' || record_type) AS i FROM blocks)
    )
    SELECT * EXCLUDE (html), {headers} AS headers FROM made
    """
