"""WARC derivatives: metadata and plain-text conversion records of responses.

Every response becomes one ``metadata`` record (JSON with the source's WARC and HTTP headers, its
digests, title and links) and one ``conversion`` record (the page's text). Both refer to the
response by its identifier and keep its address, date and digest.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.blocks import kept_schema

#: Date of responses made from a table that has none.
UNDATED = "1970-01-01T00:00:00Z"

_PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b.*?(?:</\1\s*>|\Z)|<!?/?([a-zA-Z][a-zA-Z0-9]*)\b((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>",
    re.S | re.I,
)
# A name is tried only where it begins and given back to nothing, so a long tag is read once.
_ATTRIBUTE = re.compile(r"""(?<![-a-zA-Z0-9_:.])([a-zA-Z_:][-a-zA-Z0-9_:.]*+)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
#: What a page may hold open behind its last tag.
_OPENED = re.compile(r"<!--|<(?:script|style|template|noscript)\b", re.I)
_SPACE = re.compile(r"[ \t\r\f\v ]+")

# Elements that begin a line, and those whose addresses count as links.
BLOCKS = frozenset(
    "address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html head "
    "body li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split()
)
LINKS = {"a": "href", "area": "href", "link": "href", "img": "src", "iframe": "src", "form": "action", "video": "src", "audio": "src"}


def _pieces(source: str) -> Iterator[tuple[int, int, str, str | None]]:
    """Start, stop, element and attributes of every tag; comments and scripts have no element.

    Behind the last ``>`` no tag can end, so only what opens a comment or script is looked for there.
    """
    end, last = source.rfind(">") + 1, None
    for last in _PIECE.finditer(source, 0, end):
        closed = last.end() < end or not _swallows(last)
        yield last.start(), last.end() if closed else len(source), (last[2] or "").lower(), last[3]
        if not closed:
            return
    opened = _OPENED.search(source, end)
    if opened:
        yield opened.start(), len(source), "", None


def _swallows(piece: re.Match[str]) -> bool:
    """Whether a comment or script is open at its end, and so holds all that follows."""
    if piece[0].startswith("<!--"):
        return len(piece[0]) < 7 or not piece[0].endswith("-->")
    return bool(piece[1]) and not re.search(rf"</{piece[1]}\s*>\Z", piece[0], re.I)


def read_page(source: str) -> tuple[str, str, list[dict[str, str]]]:
    """Title, text by lines, and links (path: element@attribute, url) of a page."""
    lines: list[list[str]] = [[]]
    title: list[str] | None = None
    links, named, at = [], "", 0
    for start, stop, tag, attributes in _pieces(source):
        (title if title is not None else lines[-1]).append(source[at:start])
        at, closing = stop, source.startswith("</", start)
        if tag == "title":
            if title is None and not closing:
                title = []
            elif title is not None:
                named, title = named or _plain("".join(title)), None
        elif title is None and tag in BLOCKS:
            lines.append([])
        if tag in LINKS and not closing:
            for a in _ATTRIBUTE.finditer(attributes):
                if a[1].lower() == LINKS[tag]:
                    links.append({"path": f"{tag.upper()}@/{a[1].lower()}", "url": html.unescape(a[2] or a[3] or a[4] or "")})
    (title if title is not None else lines[-1]).append(source[at:])
    if title is not None:
        named = named or _plain("".join(title))
    plain = (_plain("".join(line)) for line in lines)
    return named, "\n".join(line for line in plain if line), links


def _plain(text: str) -> str:
    return "\n".join(x for x in (_SPACE.sub(" ", line).strip() for line in html.unescape(text).split("\n")) if x)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """An identifier that the same parts always give."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def sha1_base32(data: Column) -> Column:
    """SHA-1 in base 32: four groups of ten hexadecimal digits are eight base-32 digits each."""
    hexed = F.sha1(data)
    digits = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(F.lit(""), *digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", date: str | None = None) -> DataFrame:
    """Response records of a table of pages: record_id, target_uri, date, http_headers, payload, payload_digest.

    The identifier is made of the key's and the address's digest, so a second run makes the same.
    """
    payload = F.encode(F.coalesce(F.col(body), F.lit("")), "UTF-8")
    named = F.sha2(F.concat_ws("\x00", F.coalesce(F.col(key).cast("string"), F.lit("\x01")), F.coalesce(F.col(url), F.lit("\x01"))), 256)
    parts = [F.substring(named, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    headers = F.array(
        F.struct(F.lit("Content-Type").alias("name"), F.lit("text/html; charset=utf-8").alias("value")),
        F.struct(F.lit("Content-Length").alias("name"), F.octet_length(payload).cast("string").alias("value")),
    )
    return pages.select(
        F.col(key).alias("page_id"),
        F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">")).alias("record_id"),
        F.col(url).alias("target_uri"),
        (F.col(date).cast("string") if date else F.lit(UNDATED)).alias("date"),
        F.lit("HTTP/1.1 200 OK").alias("status_line"),
        headers.alias("http_headers"),
        payload.alias("payload"),
        F.concat(F.lit("sha1:"), sha1_base32(payload)).alias("payload_digest"),
    )


_SCHEMA = (
    "warc_type string, record_id string, refers_to string, target_uri string, date string, content_type string, "
    "content_length bigint, block_digest string, source_digest string, block string"
)


def _derived(source: dict) -> list[dict]:
    named, text, links = read_page((source["payload"] or b"").decode("utf-8", "replace"))
    headers = [[h["name"], h["value"]] for h in source["http_headers"] or []]
    envelope = {
        "Envelope": {
            "WARC-Header-Metadata": {
                "WARC-Type": "response", "WARC-Record-ID": source["record_id"], "WARC-Target-URI": source["target_uri"],
                "WARC-Date": source["date"], "WARC-Payload-Digest": source["payload_digest"],
            },
            "Payload-Metadata": {
                "HTTP-Response-Metadata": {
                    "Response-Message": source["status_line"], "Headers": headers,
                    "HTML-Metadata": {"Head": {"Title": named}, "Links": links},
                }
            },
        }
    }
    made = []
    for kind, content, block in (
        ("metadata", "application/json", json.dumps(envelope, ensure_ascii=False, separators=(",", ":"))),
        ("conversion", "text/plain", text),
    ):
        raw = block.encode("utf-8", "replace")
        made.append({
            "warc_type": kind, "record_id": record_id(kind, source["record_id"] or ""), "refers_to": source["record_id"],
            "target_uri": source["target_uri"], "date": source["date"], "content_type": content, "content_length": len(raw),
            "block_digest": digest(raw), "source_digest": source["payload_digest"], "block": block,
        })
    return made


def derivatives(source: DataFrame, keep: str = "page_id") -> DataFrame:
    """A metadata and a conversion record for every response, in two rows.

    A null or empty payload gives an empty text and no title or links; a null address or date stays
    null; repeated responses give repeated records with the same identifiers; other columns are
    not read; no responses give no records.
    """
    columns = ["record_id", "target_uri", "date", "status_line", "http_headers", "payload", "payload_digest"]
    schema = pa.schema([
        *[(c, pa.string()) for c in ("warc_type", "record_id", "refers_to", "target_uri", "date", "content_type")],
        ("content_length", pa.int64()), *[(c, pa.string()) for c in ("block_digest", "source_digest", "block")],
    ])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):  # pages are large; their records leave in small batches
                part = batch.slice(at, 200)
                made = [(i, r) for i, row in enumerate(part.select(columns).to_pylist()) for r in _derived(row)]
                kept = part.column(0).take(pa.array([i for i, _ in made], pa.int64()))
                rest = pa.RecordBatch.from_pylist([r for _, r in made], schema=schema)
                yield pa.RecordBatch.from_arrays([kept, *rest.columns], names=[keep, *schema.names])

    return source.select(keep, *columns).mapInArrow(run, f"{kept_schema(source, [keep])}, {_SCHEMA}")


def serialized(records: DataFrame) -> Column:
    """A record as it stands in a WARC file: version, headers, empty line, block, two line ends.

    Line ends in a header's value are percent-encoded, so no value can begin a header of its own.
    """
    fields = (
        ("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"),
        ("WARC-Date", "date"), ("WARC-Block-Digest", "block_digest"), ("X-Source-Payload-Digest", "source_digest"),
        ("Content-Type", "content_type"), ("Content-Length", "content_length"),
    )
    value = lambda c: F.replace(F.replace(records[c].cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    lines = [F.when(records[c].isNotNull(), F.concat(F.lit(f"{name}: "), value(c))) for name, c in fields]
    return F.concat(F.concat_ws("\r\n", F.lit("WARC/1.1"), *lines), F.lit("\r\n\r\n"), F.coalesce(records["block"], F.lit("")), F.lit("\r\n\r\n"))


def write(records: DataFrame, path: str) -> None:
    """Plain files of serialized records, which a reader can seek in; every task writes its own.

    Spark's text files end every row by themselves, so the last of a record's line ends is left to them. They
    are not compressed: one gzip stream over a whole file would allow no seeking to a record.
    """
    whole = serialized(records)
    one = records.select(F.left(whole, F.length(whole) - 2).alias("value"))
    one.write.option("lineSep", "\r\n").text(path)
