"""WARC derivatives: response records to linked metadata and plain-text conversion records.

Responses are rows with a record id, target URI, HTTP header block and payload. Each gives a metadata
record (application/warc-fields: title, status line, one http-header field per line of the source's
header block, outlinks resolved against the target by RFC 3986) and a conversion record (text/plain).
Both carry WARC-Refers-To and WARC-Refers-To-Target-URI of the response, the payload digest of the
source, its HTTP status line, content type and every header line (WARC-Source-Header, folded lines
joined), besides a digest and length of their own block. All of it is column expressions; no shuffle
is needed.

Links are href values of anchors in double, single or no quotes; blanks around them and line ends and
tabs inside go, as browsers do. Character references are resolved once: decimal, hexadecimal and the
named ones of HTML 4; what is none stays as it is, and numbers that are no character give U+FFFD.

Defined results: null payloads, headers and URIs are empty; an empty payload gives an empty text and
no links; repeated rows give repeated records with equal ids, as the ids derive from the response's;
rows keep their other columns in `keep`, but for those with the name of an output column; an empty
table gives no rows. A relative link whose target has no scheme and host stays as it is.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywick.functions.uris import let, resolve, uri_parts

_BLOCKS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|th|thead|title|tr|ul"
OUTPUTS = ("kind", "record_id", "refers_to", "target_uri", "source_digest", "n_links", "header", "block", "block_digest")
#: What a text does not show: comments, scripts and styles with their content.
HIDDEN = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
BREAKS = rf"(?i)</?(?:{_BLOCKS})\b[^>]*>"
TAGS = r"(?i)</?[a-z][^>]*>|<![^>]*>"
BLANKS = r"[ \t\r\f]{2,}|[\t\r\f]"
LINKS = r"(?i)<a\s(?:[^>]*?\s)?href\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"
TITLE = r"(?is)<title\b[^>]*>(.*?)</title"
REFERENCE = "^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,7});"
HEADER_LINE = r"^[!#$%&'*+.^_`|~0-9A-Za-z-]+:"


def character(code: Column) -> Column:
    """The character of a code point; U+FFFD where there is none."""
    known = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    packed = F.unhex(F.lpad(F.hex(F.when(known, code).otherwise(0xFFFD)), 8, "0"))
    return F.decode(packed, "UTF-32")


def unescape_entities(text: Column) -> Column:
    """Character references resolved, each once, so an escaped reference stays readable."""
    names = F.create_map(*(F.lit(x) for k, v in [*sorted(name2codepoint.items()), ("apos", 39)] for x in (k, chr(v))))

    def numeric(name: Column) -> Column:
        code = F.when(F.lower(F.substring(name, 2, 1)) == "x", F.conv(F.substring(name, 3, 6), 16, 10)).otherwise(F.substring(name, 2, 8))
        return character(code.cast("long"))

    def shown(p: Column, name: Column) -> Column:
        char = F.when(name.startswith("#"), numeric(name)).when(name != "", F.try_element_at(names, name))
        return let(char, lambda c: F.when(c.isNull(), F.concat(F.lit("&"), p)).otherwise(F.concat(c, F.substr(p, F.length(name) + 2))))

    def part(p: Column) -> Column:
        other = let(F.regexp_extract(p, REFERENCE, 1), lambda name: shown(p, name))
        return F.when(p.startswith("amp;"), F.concat(F.lit("&"), F.substr(p, F.lit(5)))).otherwise(other)

    def made(parts: Column) -> Column:
        return F.concat(parts[0], F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), part), ""))

    return let(text, lambda t: F.when(t.contains("&"), let(F.split(t, "&"), made)).otherwise(t))


def plain_text(html: Column) -> Column:
    """Visible text: block elements break lines, runs of blanks are one, empty lines go."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, HIDDEN, ""), BREAKS, "\n"), TAGS, "")
    text = F.regexp_replace(F.replace(unescape_entities(text), F.lit("\u00a0"), F.lit(" ")), BLANKS, " ")
    return F.trim(F.regexp_replace(text, " ?\n[ \n]*", "\n"), F.lit(" \n"))


def link_value(raw: Column) -> Column:
    """The reference that an href attribute's value stands for."""
    quoted = F.substring(raw, 1, 1).isin("'", '"')
    bare = F.when(quoted, F.substr(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
    return F.trim(F.translate(unescape_entities(bare), "\t\r\n", ""))


def record_urn(*parts: Column) -> Column:
    """A UUID URN that the given columns determine."""
    d = F.md5(F.concat_ws("\n", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(d, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def _each(name: str, values: Column) -> Column:
    """A line for every value."""
    return F.array_join(F.transform(values, lambda x: F.concat(F.lit(name), x, F.lit("\r\n"))), "")


def _record(kind: str, content_type: str, block: Column) -> Column:
    own = record_urn(F.lit(kind), F.col("record_id"))
    fields = [
        ("WARC-Type", F.lit(kind)),
        ("WARC-Record-ID", own),
        ("WARC-Date", F.col("date")),
        ("WARC-Refers-To", F.col("record_id")),
        ("WARC-Refers-To-Target-URI", F.col("target")),
        ("WARC-Target-URI", F.col("target")),
        ("WARC-Source-Payload-Digest", F.col("source_digest")),
        ("WARC-Source-Status", F.col("status")),
        ("WARC-Source-Content-Type", F.col("source_type")),
        ("WARC-Block-Digest", digest(block)),
        ("Content-Type", F.lit(content_type)),
        ("Content-Length", F.octet_length(block).cast("string")),
    ]
    lines = (F.concat(F.lit(f"{k}: "), v, F.lit("\r\n")) for k, v in fields)
    header = F.concat(F.lit("WARC/1.1\r\n"), *lines, _each("WARC-Source-Header: ", F.col("source_headers")), F.lit("\r\n"))
    return F.struct(F.lit(kind).alias("kind"), own.alias("record_id"), header.alias("header"), block.alias("block"), digest(block).alias("block_digest"))


def derive(responses: DataFrame, keep: list[str], record_id: str = "record_id", target: str = "target_uri", date: str = "date", http_headers: str = "http_headers", payload: str = "payload") -> DataFrame:
    """Two rows per response: keep, kind, record_id, refers_to, target_uri, source_digest, n_links, header, block, block_digest."""
    keep = [c for c in keep if c not in OUTPUTS]
    kept = F.struct(*(F.col(c) for c in keep)) if keep else F.lit(None)
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (record_id, target, date, http_headers, payload)}
    rows = responses.select(
        kept.alias("kept"),
        text[record_id].alias("record_id"),
        text[target].alias("target"),
        text[date].alias("date"),
        text[payload].alias("payload"),
        F.regexp_extract(text[http_headers], r"^([^\r\n]*)", 1).alias("status"),
        F.regexp_extract(text[http_headers], r"(?im)^content-type: *([^\r\n]*)", 1).alias("source_type"),
        F.filter(F.split(F.regexp_replace(text[http_headers], r"\r?\n[ \t]+", " "), r"\r?\n"), lambda x: x.rlike(HEADER_LINE)).alias("source_headers"),
        digest(text[payload]).alias("source_digest"),
        uri_parts(text[target]).alias("base"),
        F.regexp_extract_all(text[payload], F.lit(LINKS), 1).alias("links"),
    )
    links = _each("outlink: ", F.transform("links", lambda x: let(link_value(x), lambda y: resolve(y, F.col("base")))))
    title = F.trim(F.regexp_replace(unescape_entities(F.regexp_extract("payload", TITLE, 1)), "[ \t\r\n]+", " "))
    heads = _each("http-header: ", F.col("source_headers"))
    fields = F.concat(F.lit("title: "), title, F.lit("\r\nhttp-status: "), F.col("status"), F.lit("\r\n"), heads, links)
    both = rows.select("kept", F.col("record_id").alias("refers_to"), "record_id", "target", "date", "status", "source_type", "source_headers", "source_digest", F.size("links").alias("n_links"), fields.alias("fields"), plain_text(F.col("payload")).alias("text"))
    records = F.array(_record("metadata", "application/warc-fields", F.col("fields")), _record("conversion", "text/plain; charset=utf-8", F.col("text")))
    out = both.select("kept", "refers_to", F.col("target").alias("target_uri"), "source_digest", "n_links", F.explode(records).alias("r"))
    return out.select(*(F.col("kept")[c].alias(c) for c in keep), F.col("r.kind").alias("kind"), F.col("r.record_id").alias("record_id"), "refers_to", "target_uri", "source_digest", "n_links", F.col("r.header").alias("header"), F.col("r.block").alias("block"), F.col("r.block_digest").alias("block_digest"))


def responses_of_pages(pages: DataFrame, fetched: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Landed pages as response rows: id from page id and URL. A page has neither headers nor a time of
    fetch: its header block states type and length of the body, and the caller gives the time."""
    body = F.coalesce(F.col("html"), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    record = record_urn(F.lit("response"), F.col("page_id").cast("string"), F.col("url"))
    return pages.select("page_id", record.alias("record_id"), F.col("url").alias("target_uri"), F.lit(fetched).alias("date"), head.alias("http_headers"), body.alias("payload"))
