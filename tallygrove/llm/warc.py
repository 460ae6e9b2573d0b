"""WARC derivative builder: response records become linked ``metadata`` and ``conversion`` records.

A response record is a row with its record id, target URI, date, HTTP header block and payload text. For each one the
builder makes a metadata record (``application/warc-fields``: title, source content type, size and digest) and a
conversion record (``text/plain``: the page's text). Both name the response in ``WARC-Refers-To``, keep its target URI
and HTTP headers, and carry digests of the source payload and of their own block. Everything is a projection: no
shuffle, no Python, and a lost task is simply run again with the same ids (ids are name-based, from a SHA-256).

Nothing in a page can write a line of a record's header or fields: control characters and spaces in a target URI are
percent-encoded, in a title (after entities are resolved) and in a source header they become a space, folded source headers
become one line, blank ones are left out and those without a name are called unnamed; record ids lose control characters; a date that is no UTC time of ISO 8601 is left out.

Defined cases: a missing payload is an empty one (its conversion block is empty); a missing URI leaves the header out;
repeated responses give repeated derivatives with equal ids; an unclosed script, style or comment ends at the end of the
page; extra columns are ignored. Numeric entities and those of ``ENTITIES`` are resolved, others stay as written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Named entities and what they stand for.
ENTITIES = {
    "nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&", "copy": "\u00a9", "reg": "\u00ae", "trade": "\u2122", "middot": "\u00b7", "bull": "\u2022", "hellip": "\u2026",
    "ndash": "\u2013", "mdash": "\u2014", "lsquo": "\u2018", "rsquo": "\u2019", "ldquo": "\u201c", "rdquo": "\u201d", "laquo": "\u00ab", "raquo": "\u00bb", "euro": "\u20ac", "pound": "\u00a3", "yen": "\u00a5", "cent": "\u00a2",
    "sect": "\u00a7", "para": "\u00b6", "deg": "\u00b0", "plusmn": "\u00b1", "times": "\u00d7", "divide": "\u00f7", "frac12": "\u00bd", "szlig": "\u00df", "eacute": "\u00e9", "egrave": "\u00e8", "agrave": "\u00e0", "ccedil": "\u00e7",
    "auml": "\u00e4", "ouml": "\u00f6", "uuml": "\u00fc", "Auml": "\u00c4", "Ouml": "\u00d6", "Uuml": "\u00dc", "ntilde": "\u00f1", "iexcl": "\u00a1", "iquest": "\u00bf", "shy": "\u00ad", "thinsp": "\u2009", "ensp": "\u2002", "emsp": "\u2003",
}
ENTITY = r"^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,9});"
#: What is removed whole, and which tags end a line.
UNSEEN = (r"(?s)<!--.*?(-->|\z)", r"(?is)<script\b.*?(</script\s*>|\z)", r"(?is)<style\b.*?(</style\s*>|\z)", r"(?is)<title\b.*?(</title\s*>|\z)")
LINES = r"(?i)</?(address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h1|h2|h3|h4|h5|h6|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b[^>]*>"
TITLE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"


CONTROL = r"[\x00-\x1F\x7F\x{85}\x{2028}\x{2029}]"
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]{1,9})?Z\z"

NAMED = r"^([A-Za-z0-9!#$%&'*+.^_`|~-]+):[ ]*"


def on_one_line(text: Column) -> Column:
    """Text without control characters and line ends: each run of them is a space, none at either end."""
    return F.trim(F.regexp_replace(text, CONTROL + "+", " "))


def encoded_uri(uri: Column) -> Column:
    """A URI whose spaces, control characters and line ends are percent-encoded."""
    bad = r"[\x00-\x20\x7F\x{85}\x{2028}\x{2029}]"
    byte = lambda c: F.regexp_replace(F.hex(c.cast("binary")), "(..)", "%$1")
    return F.when(uri.rlike(bad), F.array_join(F.transform(F.split(uri, ""), lambda c: F.when(c.rlike(bad), byte(c)).otherwise(c)), "")).otherwise(uri)


def header_lines(headers: Column) -> Column:
    """Source headers as an array of single lines: folded lines joined, blank ones left out."""
    lines = F.split(F.regexp_replace(headers, r"\r?\n[ \t]+", " "), r"\r\n|\r|\n")
    return F.filter(F.transform(lines, on_one_line), lambda x: x != "")


def _entities(text: Column) -> Column:
    """Named and numeric entities resolved once, from left to right; others stay as written. ``text`` is to be a column: it is read more than once."""
    names = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])
    pieces = F.transform(F.split(text, "&"), lambda p: F.struct(p.alias("p"), F.regexp_extract(p, ENTITY, 1).alias("name")))

    def part(piece: Column, i: Column) -> Column:
        p, name = piece["p"], piece["name"]
        number = F.when(F.lower(name.substr(1, 2)) == "#x", F.conv(F.substring(name, 3, 6), 16, 10)).otherwise(F.substring(name, 2, 7)).cast("long")
        real = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        char = F.when(name.startswith("#"), F.when(real, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))).otherwise(names[name])
        rest = F.substr(p, F.length(name) + 2)
        return F.when(i == 0, p).when(name == "", F.concat(F.lit("&"), p)).otherwise(F.coalesce(F.concat(char, rest), F.concat(F.lit("&"), p)))

    return F.when(text.contains("&"), F.array_join(F.transform(pieces, part), "")).otherwise(text)


def _tidy(text: Column) -> Column:
    """Entities resolved, runs of blanks as one blank and of lines as one line end, none at either end."""
    text = _entities(text)
    text = F.regexp_replace(text, r"[ \t\r\f\x0B]+", " ")
    text = F.regexp_replace(text, r" ?\n[ \n]*", "\n")
    return F.btrim(text, F.lit(" \n"))


def untagged(html: Column) -> Column:
    """The text of a page before ``_tidy``: unseen parts go, block tags end lines, other tags vanish."""
    for pattern in UNSEEN:
        html = F.regexp_replace(html, pattern, " ")
    for space in "\t\n\x0b\f\r":  # one by one without a pattern: runs of blanks are left to _tidy
        html = F.replace(html, F.lit(space), F.lit(" "))
    html = F.regexp_replace(html, LINES, "\n")
    return F.regexp_replace(html, r"<[^>]*>", "")


def record_id(*parts: Column) -> Column:
    """``<urn:uuid:...>`` fixed by the parts; a null part counts as empty."""
    h = F.sha2(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), h.substr(13, 4), h.substr(17, 4), h.substr(21, 12)), F.lit(">"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def _date(date: str | Column) -> Column:
    if not isinstance(date, Column):
        return F.lit(date)
    return F.when(date.cast("string").rlike(DATE), date.cast("string")).otherwise(F.date_format(F.to_utc_timestamp(F.try_to_timestamp(date.cast("string")), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def responses_from_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", date: str | Column = "2024-01-01T00:00:00Z") -> DataFrame:
    """Raw pages as response records (page_id, record_id, target_uri, warc_date, http_headers, payload).

    ``date`` is a column of the pages (a timestamp, or text of ISO 8601 in UTC), or one time for all where the pages have none."""
    payload = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    crlf = "\r\n"
    return pages.select(
        F.col(f"`{page_id}`").alias("page_id"),
        record_id(F.lit("response"), F.col(f"`{page_id}`"), F.col(f"`{url}`")).alias("record_id"),
        F.col(f"`{url}`").alias("target_uri"), _date(date).alias("warc_date"),
        F.concat(F.lit(f"HTTP/1.1 200 OK{crlf}Content-Type: text/html; charset=utf-8{crlf}Content-Length: "), F.octet_length(payload).cast("string"), F.lit(crlf)).alias("http_headers"),
        payload.alias("payload"),
    )


def derive(responses: DataFrame, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Two rows for each response: ``keep`` columns, warc_type, record_id, refers_to, target_uri, source_headers,
    source_digest, content_type, content_length, block_digest, warc_header, block."""
    crlf = "\r\n"
    payload = F.coalesce(F.col("payload"), F.lit(""))
    base = responses.select(*keep, "record_id", "target_uri", "warc_date", F.coalesce("http_headers", F.lit("")).alias("source_headers"), payload.alias("payload"))
    plain = lambda c: F.regexp_replace(c, CONTROL, "")
    base = base.withColumns({"record_id": plain("record_id"), "target_uri": encoded_uri(F.col("target_uri")), "warc_date": F.when(F.col("warc_date").rlike(DATE), F.col("warc_date")), "_lines": header_lines(F.col("source_headers"))})
    base = base.withColumn("source_digest", digest(F.col("payload")))
    # columns of their own: resolving entities reads a text more than once, and must not strip the page as often
    base = base.withColumns({"_title": F.regexp_replace(F.regexp_extract("payload", TITLE, 1), r"\s+", " "), "_text": untagged(F.col("payload"))})
    title = on_one_line(_tidy(F.col("_title")))
    named = lambda line: F.when(line.rlike(NAMED), F.concat(F.lit("source-http-"), F.regexp_replace(line, NAMED, "$1: "))).otherwise(F.concat(F.lit("source-http-unnamed: "), line))
    told = F.transform("_lines", lambda line, i: F.concat(F.when(i == 0, F.concat(F.lit("source-http-status: "), line)).otherwise(named(line)), F.lit(crlf)))
    fields = F.concat(
        F.lit("title: "), title, F.lit(f"{crlf}source-content-length: "), F.octet_length("payload").cast("string"),
        F.lit(f"{crlf}source-digest: "), F.col("source_digest"), F.lit(crlf),
        F.array_join(told, ""),
    )
    made = [F.struct(F.lit(kind).alias("warc_type"), F.lit(mime).alias("content_type"), block.alias("block")) for kind, mime, block in (("metadata", "application/warc-fields", fields), ("conversion", "text/plain; charset=utf-8", _tidy(F.col("_text"))))]
    rows = base.select("*", F.explode(F.array(*made)).alias("made")).select("*", "made.warc_type", "made.content_type", "made.block")
    rows = rows.withColumns({"refers_to": F.col("record_id"), "content_length": F.octet_length("block").cast("long"), "block_digest": digest(F.col("block"))})
    rows = rows.withColumn("record_id", record_id(F.col("warc_type"), F.col("refers_to"), F.col("source_digest")))
    header = F.concat_ws(
        crlf, F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.col("warc_type")), F.concat(F.lit("WARC-Record-ID: "), F.col("record_id")),
        F.concat(F.lit("WARC-Refers-To: "), F.col("refers_to")), F.concat(F.lit("WARC-Target-URI: "), F.col("target_uri")),
        F.concat(F.lit("WARC-Date: "), F.col("warc_date")), F.concat(F.lit("WARC-Block-Digest: "), F.col("block_digest")),
        F.concat(F.lit("X-Source-Payload-Digest: "), F.col("source_digest")),
        F.when(F.size("_lines") > 0, F.concat(F.lit("X-Source-HTTP-Headers: "), F.array_join("_lines", "; "))),
        F.concat(F.lit("Content-Type: "), F.col("content_type")), F.concat(F.lit("Content-Length: "), F.col("content_length").cast("string")),
    )
    return rows.select(*keep, "warc_type", "record_id", "refers_to", "target_uri", "source_headers", "source_digest", "content_type", "content_length", "block_digest", header.alias("warc_header"), "block")


def write_warc(records: DataFrame, path: str) -> None:
    """Records as WARC text, one file a partition: header, blank line, block and two line ends, the last by Spark's text writer, which also compresses."""
    crlf = "\r\n"
    records.select(F.concat("warc_header", F.lit(crlf * 2), "block", F.lit(crlf)).alias("value")).write.option("lineSep", crlf).option("compression", "gzip").text(path)


def _sql_entities(x: str) -> str:
    quoted = lambda c: c.replace("'", "''")
    name = f"regexp_extract(p, '{ENTITY}', 1)"
    number = f"(CASE WHEN lower(substr({name}, 1, 2)) = '#x' THEN TRY_CAST('0x' || substr({name}, 3) AS BIGINT) ELSE TRY_CAST(substr({name}, 2) AS BIGINT) END)"
    char = f"CASE WHEN starts_with({name}, '#') THEN CASE WHEN {number} BETWEEN 1 AND 55295 OR {number} BETWEEN 57344 AND 1114111 THEN chr(CAST({number} AS INTEGER)) END ELSE CASE {name} " + " ".join(f"WHEN '{n}' THEN '{quoted(c)}'" for n, c in ENTITIES.items()) + " END END"
    part = f"CASE WHEN i = 1 THEN p WHEN {name} = '' THEN '&' || p ELSE coalesce(({char}) || regexp_replace(p, '{ENTITY}', ''), '&' || p) END"
    return f"array_to_string(list_transform(string_split({x}, '&'), lambda p, i: {part}), '')"


def _sql_tidy(x: str) -> str:
    x = _sql_entities(x)
    x = rf"regexp_replace({x}, '[ \t\r\f\x0B]+', ' ', 'g')"
    x = rf"regexp_replace({x}, ' ?\n[ \n]*', chr(10), 'g')"
    return rf"regexp_replace({x}, '^[ \n]+|[ \n]+\z', '', 'g')"


def _sql_text(x: str) -> str:
    for pattern in UNSEEN:
        x = f"regexp_replace({x}, '{pattern}', ' ', 'g')"
    x = f"regexp_replace({x}, '\\s+', ' ', 'g')"
    x = f"regexp_replace({x}, '{LINES}', chr(10), 'g')"
    return _sql_tidy(f"regexp_replace({x}, '<[^>]*>', '', 'g')")


def _sql_id(*parts: str) -> str:
    h = "sha256(" + " || chr(10) || ".join(f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts) + ")"
    cuts = " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"('<urn:uuid:' || {cuts} || '>')"


_CRLF = "chr(13) || chr(10)"
_TITLE_SQL = f"trim(regexp_replace({_sql_tidy(f"regexp_replace(regexp_extract(payload, '{TITLE}', 1), '\\s+', ' ', 'g')")}, '{CONTROL}+', ' ', 'g'))"
_URI_SQL = r"CASE WHEN regexp_matches(url, '[\x00-\x20\x7F]') THEN array_to_string(list_transform(string_split(url, ''), lambda c: CASE WHEN regexp_matches(c, '[\x00-\x20\x7F]') THEN '%' || hex(encode(c)) ELSE c END), '') ELSE url END"
ORACLE_SQL = f"""
WITH responses AS (
  SELECT page_id, {_sql_id("'response'", "page_id", "url")} AS refers_to, {_URI_SQL} AS target_uri,
    'HTTP/1.1 200 OK' || {_CRLF} || 'Content-Type: text/html; charset=utf-8' || {_CRLF} || 'Content-Length: ' || strlen(coalesce(html, '')) || {_CRLF} AS source_headers,
    coalesce(html, '') AS payload, 'sha256:' || sha256(coalesce(html, '')) AS source_digest
  FROM pages),
made AS (
  SELECT *, 'metadata' AS warc_type, 'application/warc-fields' AS content_type,
    'title: ' || {_TITLE_SQL} || {_CRLF} || 'source-content-length: ' || strlen(payload) || {_CRLF} || 'source-digest: ' || source_digest || {_CRLF}
      || 'source-http-status: ' || regexp_replace(source_headers, '\\n([^\\r\\n])', chr(10) || 'source-http-\\1', 'g') AS block
  FROM responses
  UNION ALL
  SELECT *, 'conversion', 'text/plain; charset=utf-8', {_sql_text("payload")} FROM responses),
named AS (
  SELECT *, {_sql_id("warc_type", "refers_to", "source_digest")} AS record_id, CAST(strlen(block) AS BIGINT) AS content_length, 'sha256:' || sha256(block) AS block_digest FROM made)
SELECT page_id, warc_type, record_id, refers_to, target_uri, source_headers, source_digest, content_type, content_length, block_digest,
  'WARC/1.1' || {_CRLF} || 'WARC-Type: ' || warc_type || {_CRLF} || 'WARC-Record-ID: ' || record_id || {_CRLF} || 'WARC-Refers-To: ' || refers_to || {_CRLF}
    || coalesce('WARC-Target-URI: ' || target_uri || {_CRLF}, '') || 'WARC-Date: 2024-01-01T00:00:00Z' || {_CRLF} || 'WARC-Block-Digest: ' || block_digest || {_CRLF}
    || 'X-Source-Payload-Digest: ' || source_digest || {_CRLF}
    || 'X-Source-HTTP-Headers: ' || replace(regexp_replace(source_headers, '\\r\\n\\z', ''), {_CRLF}, '; ') || {_CRLF}
    || 'Content-Type: ' || content_type || {_CRLF} || 'Content-Length: ' || content_length AS warc_header, block
FROM named
"""
