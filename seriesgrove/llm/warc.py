"""Operator 8, WARC derivatives.

Every response record gives two linked records: a metadata record, whose block
repeats the response's digests and HTTP headers as fields, and a conversion
record, whose block is the page's plain text. Both name the response in
WARC-Refers-To, keep its target, date and warcinfo, and get ids that depend on
the response's id alone, so that reruns agree.

Defined results: null bytes have no records. A record that is cut off or
malformed gives one row with the reason in `error`, and ends its file's rows,
since what follows cannot be found; so does a gzip member that unpacks to more
than UNPACKED bytes. Records other than responses are skipped. A body whose
chunks or packing are broken, or that unpacks to more than that, is taken as it
is; an unknown or unusable charset counts as UTF-8. For pages, a null text
counts as an empty body, a null address as none.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names ids and dates where a source has none.
SPACE = uuid.UUID("6c0e2f0e-3a5b-5d0c-9f4e-1d2b7c8a9e01")
UNDATED = "1970-01-01T00:00:00Z"
#: Bytes to which a packed member or body may unpack.
UNPACKED = 1 << 28


class Malformed(ValueError):
    """The bytes are not a WARC record."""


@dataclass
class Record:
    kind: str
    headers: list[tuple[str, str]] = field(default_factory=list)
    block: bytes = b""

    def get(self, name: str) -> str | None:
        return next((v for k, v in self.headers if k.lower() == name.lower()), None)

    def to_bytes(self) -> bytes:
        lines = [("WARC-Type", self.kind), *self.headers, ("Content-Length", str(len(self.block)))]
        return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + self.block + b"\r\n\r\n"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def header_lines(data: bytes) -> list[tuple[str, str]]:
    """Names and values; lines that begin with white space continue the one before."""
    out: list[tuple[str, str]] = []
    for line in data.decode("utf-8", "replace").replace("\r\n", "\n").split("\n"):
        if line[:1] in " \t" and line.strip() and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            k, _, v = line.partition(":")
            out.append((k.strip(), v.strip()))
    return out


def unpacked(data: bytes, limit: int) -> tuple[bytes, bytes]:
    """The first gzip member of some bytes, and what follows it."""
    unpack = zlib.decompressobj(31)
    try:
        part = unpack.decompress(data, limit)
    except zlib.error as e:
        raise Malformed(f"gzip: {e}") from e
    if not unpack.eof:
        raise Malformed("a gzip member is too long" if len(part) >= limit else "a gzip member is cut off")
    return part, unpack.unused_data


def members(data: bytes, limit: int = UNPACKED) -> Iterator[bytes]:
    """The parts of a file, unpacked if each is a gzip member."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data:
        part, data = unpacked(data, limit)
        yield part


LENGTH = re.compile(r"[0-9]{1,18}", re.ASCII)


def records(data: bytes) -> Iterator[Record]:
    """The records of a file, one after the other."""
    for part in members(data):
        at = 0
        while True:
            while part[at : at + 1] in (b"\r", b"\n"):
                at += 1
            if at >= len(part):
                break
            if part[at : at + 5] != b"WARC/":
                raise Malformed("no version line")
            end = part.find(b"\r\n\r\n", at)
            if end < 0:
                raise Malformed("headers are cut off")
            headers = header_lines(part[part.find(b"\r\n", at) + 2 : end])
            found = Record("", headers)
            length = found.get("Content-Length") or ""
            if not LENGTH.fullmatch(length):
                raise Malformed("no content length")
            block = part[end + 4 : end + 4 + int(length)]
            if len(block) < int(length):
                raise Malformed("a block is cut off")
            kind = found.get("WARC-Type") or ""
            yield Record(kind, [(k, v) for k, v in headers if k.lower() not in ("warc-type", "content-length")], block)
            at = end + 4 + int(length)


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and body."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        head, gap, body = block.partition(b"\n\n")
    status, _, rest = head.replace(b"\r\n", b"\n").partition(b"\n")
    return status.decode("utf-8", "replace"), header_lines(rest), body


CHUNK = re.compile(rb"[ \t]*([0-9a-fA-F]{1,15})[ \t]*(?:;[^\r\n]*)?\r\n")


def unchunked(body: bytes) -> bytes | None:
    """The chunks of a body; None if they are broken. A body that ends early is what came."""
    out, at = [], 0
    while at < len(body):
        size = CHUNK.match(body, at)
        if not size:
            return None
        n = int(size[1], 16)
        if not n:
            break
        out.append(body[size.end() : size.end() + n])
        at = size.end() + n + 2
    return b"".join(out)


def decoded_body(headers: list[tuple[str, str]], body: bytes, limit: int = UNPACKED) -> bytes:
    """The body without transfer and content encodings; as it is where these are broken or unknown."""
    named = {k.lower(): v.lower() for k, v in headers}
    if "chunked" in named.get("transfer-encoding", ""):
        whole = unchunked(body)
        if whole is None:
            return body
        body = whole
    if "gzip" in named.get("content-encoding", ""):
        try:
            parts, rest = [], body
            while rest[:2] == b"\x1f\x8b" or not parts:
                part, rest = unpacked(rest, limit - sum(map(len, parts)) + 1)
                parts.append(part)
            if sum(map(len, parts)) <= limit:
                body = b"".join(parts)
        except Malformed:
            pass
    return body


DROPPED = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
BREAKS = re.compile(r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>", re.I)
TAGS = re.compile(r"<[a-zA-Z/!?][^>]*>")
BLANKS = re.compile(r"[ \t\r\f\v]+")
LINES = re.compile(r" ?\n[ \n]*")
CHARSET = re.compile(r"charset=[\"']?([\w.:-]+)", re.I)


def plain_text(page: str) -> str:
    """The text of a page, a line for each block."""
    page = BREAKS.sub("\n", DROPPED.sub(" ", page))
    page = html.unescape(TAGS.sub("", page)) if "<" in page or "&" in page else page
    return LINES.sub("\n", BLANKS.sub(" ", page)).strip()


#: Codecs that Python knows by name but no page is written in.
NO_CHARSETS = {"idna", "punycode", "undefined", "unicode-escape", "raw-unicode-escape"}


def text_of(headers: list[tuple[str, str]], body: bytes) -> str:
    kind = next((v for k, v in headers if k.lower() == "content-type"), "")
    name = CHARSET.search(kind) or CHARSET.search(body[:1024].decode("latin-1"))
    body = decoded_body(headers, body)
    try:
        text = body.decode(name[1] if name and codecs.lookup(name[1]).name not in NO_CHARSETS else "utf-8", "replace")
    except (LookupError, UnicodeError):
        text = body.decode("utf-8", "replace")
    return plain_text(text) if "html" in kind.lower() or not kind or "<html" in text[:1024].lower() else text


def urn(of: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{kind}:{of}')}>"


def derive(response: Record) -> tuple[Record, Record, str]:
    """The metadata and the conversion record of a response, and its plain text."""
    own = response.get("WARC-Record-ID") or urn(digest(response.block), "response")
    status, headers, body = split_http(response.block)
    payload = response.get("WARC-Payload-Digest") or digest(body)
    kept = [(k, v) for k in ("WARC-Target-URI", "WARC-Date", "WARC-Warcinfo-ID", "WARC-IP-Address") if (v := response.get(k)) is not None]
    fields = [("refers-to", own), ("source-block-digest", response.get("WARC-Block-Digest") or digest(response.block)), ("source-payload-digest", payload), ("http-status", status), *((f"http-header-{k}", v) for k, v in headers)]
    text = text_of(headers, body)
    made = []
    for kind, content, block in (("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields).encode()), ("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace"))):
        made.append(Record(kind, [("WARC-Record-ID", urn(own, kind)), ("WARC-Refers-To", own), *kept, ("WARC-Block-Digest", digest(block)), ("Content-Type", content)], block))
    made[0].headers.append(("WARC-Concurrent-To", made[1].get("WARC-Record-ID")))
    made[1].headers.append(("WARC-Concurrent-To", made[0].get("WARC-Record-ID")))
    return made[0], made[1], text


def response(address: str | None, page: str | None, key: str, date: str = UNDATED) -> Record:
    """A page as the response that a crawler would have stored."""
    body = (page or "").encode()
    block = b"HTTP/1.1 200 OK\r\n" + f"Content-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n".encode() + b"\r\n" + body
    target = [] if address is None else [("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]+", "%20", address))]
    headers = [("WARC-Record-ID", urn(f"{key} {address} {digest(body)}", "response")), *target, ("WARC-Date", date), ("WARC-Block-Digest", digest(block)), ("WARC-Payload-Digest", digest(body)), ("Content-Type", "application/http; msgtype=response")]
    return Record("response", headers, block)


FIELDS = {
    "response_id": pa.string(), "target_uri": pa.string(), "date": pa.string(), "payload_digest": pa.string(), "http_headers": pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())])),
    "metadata_id": pa.string(), "conversion_id": pa.string(), "refers_to": pa.string(), "metadata_digest": pa.string(), "text_digest": pa.string(), "text": pa.string(), "metadata": pa.binary(), "conversion": pa.binary(), "error": pa.string(),
}


def rows(data: bytes | None) -> Iterator[dict]:
    """What derive() makes of each response of a file."""
    blank = dict.fromkeys(FIELDS)
    if data is None:
        return
    try:
        for r in records(data):
            if r.kind == "response":
                about, converted, text = derive(r)
                _, headers, body = split_http(r.block)
                yield blank | {
                    "response_id": about.get("WARC-Refers-To"), "target_uri": r.get("WARC-Target-URI"), "date": r.get("WARC-Date"), "payload_digest": r.get("WARC-Payload-Digest") or digest(body), "http_headers": [{"name": k, "value": v} for k, v in headers],
                    "metadata_id": about.get("WARC-Record-ID"), "conversion_id": converted.get("WARC-Record-ID"), "refers_to": converted.get("WARC-Refers-To"), "metadata_digest": about.get("WARC-Block-Digest"), "text_digest": converted.get("WARC-Block-Digest"), "text": text, "metadata": about.to_bytes(), "conversion": converted.to_bytes(),
                }
    except Malformed as e:
        yield blank | {"error": str(e)}


def _schema(keys: list[T.StructField]) -> T.StructType:
    kinds = {pa.string(): T.StringType(), pa.binary(): T.BinaryType()}
    pair = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]))
    return T.StructType([*keys, *(T.StructField(k, kinds.get(v, pair)) for k, v in FIELDS.items())])


#: Bytes of files for which a worker holds results at once.
HELD = 4 << 20


def derive_records(files: DataFrame, data: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """A row of FIELDS, after the keys, for each response in a column of WARC bytes; one scan, no shuffle."""

    def run(batches):
        names = [*keys, *FIELDS]

        def made(taken, found):
            columns = [c.take(pa.array(taken, pa.int64())) for c in batch.columns[:-1]]
            return pa.RecordBatch.from_arrays([*columns, *(pa.array([r[k] for r in found], t) for k, t in FIELDS.items())], names=names)

        for batch in batches:
            taken, found, held = [], [], 0
            for i in range(batch.num_rows):
                file = batch.column(batch.num_columns - 1)[i].as_py()
                for r in rows(file):
                    taken.append(i)
                    found.append(r)
                    held += len(r["text"] or "") + 2 * len(r["conversion"] or b"")
                    if held > HELD:
                        yield made(taken, found)
                        taken, found, held = [], [], 0
            if found:
                yield made(taken, found)

    return files.select(*keys, F.col(data)).mapInArrow(run, _schema([files.schema[k] for k in keys]))


def page_responses(pages: DataFrame, key: str = "page_id", address: str = "url", page: str = "html") -> DataFrame:
    """key, and the page as WARC bytes in `warc`."""

    @F.arrow_udf("binary")
    def store(k: pa.Array, a: pa.Array, p: pa.Array) -> pa.Array:
        return pa.array([response(y.as_py(), z.as_py(), str(x.as_py())).to_bytes() for x, y, z in zip(k, a, p, strict=True)], pa.binary())

    return pages.select(F.col(key), store(F.col(key), F.col(address), F.col(page)).alias("warc"))


def op8_warc_derivatives(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return derive_records(page_responses(pages), "warc", ("page_id",))
