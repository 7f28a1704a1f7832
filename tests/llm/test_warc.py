import base64
import gzip
import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from seriesgrove.llm import warc


def sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_links_headers_and_digests():
    r = warc.response("http://x.example/a b", "<p>Hello &amp; <b>you</b></p><script>var a='<p>'</script><p>two", "7")
    about, made, text = warc.derive(r)
    assert text == "Hello & you\ntwo" and made.block.decode() == text
    for d in (about, made):
        assert d.get("WARC-Refers-To") == r.get("WARC-Record-ID")
        assert d.get("WARC-Target-URI") == r.get("WARC-Target-URI") == "http://x.example/a%20b"
        assert d.get("WARC-Date") == r.get("WARC-Date") and d.get("WARC-Block-Digest") == sha1(d.block)
    assert about.get("WARC-Concurrent-To") == made.get("WARC-Record-ID")
    body = warc.split_http(r.block)[2]
    assert f"source-payload-digest: {sha1(body)}" in about.block.decode() and "http-header-Content-Type: text/html; charset=utf-8" in about.block.decode()
    assert r.get("WARC-Payload-Digest") == sha1(body) and r.get("WARC-Block-Digest") == sha1(r.block)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=50), st.binary(max_size=300)), max_size=5), st.booleans())
def test_records_round_trip(found, packed):
    made = [warc.Record("response", [("WARC-Record-ID", f"<urn:{i}>"), ("X-Note", a.encode("ascii", "ignore").decode().translate({c: None for c in range(33)}))], b) for i, (a, b) in enumerate(found)]
    data = b"".join(gzip.compress(r.to_bytes()) if packed else r.to_bytes() for r in made)
    assert list(warc.records(data)) == made


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=300), st.integers(0, 400))
def test_broken_files_give_a_reason(noise, cut):
    good = warc.response("u", "<p>x</p>", "1").to_bytes()
    for data in (noise, good[:cut], good + noise):
        rows = list(warc.rows(data))
        assert all((r["error"] is None) != (r["response_id"] is None) for r in rows)


def test_encodings():
    page = "<p>é</p>".encode("latin-1")
    packed = gzip.compress(page)
    chunked = f"{len(packed):x}\r\n".encode() + packed + b"\r\n0\r\n\r\n"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked
    about, _, text = warc.derive(warc.Record("response", [("WARC-Payload-Digest", "sha1:ABC")], block))
    assert text == "é" and "source-payload-digest: sha1:ABC" in about.block.decode()


def test_query_edges_and_reruns(spark, tmp_path):
    rows = [(1, "http://a.example/", "<title>T</title><p>a<p>b"), (1, "http://a.example/", "<title>T</title><p>a<p>b"), (2, None, None), (3, "u", ""), (None, "v", "plain"), (4, "w", "<p>" * 20000 + "end")]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.mode("overwrite").parquet(f"{tmp_path}/pages.parquet")
    key = lambda r: repr((r.page_id, r.response_id))
    one, two = (sorted(warc.op8_warc_derivatives(spark, str(tmp_path)).collect(), key=key) for _ in range(2))
    assert one == two and len(one) == len(rows)
    texts = {r.page_id: r.text for r in one}
    assert texts == {1: "T\na\nb", 2: "", 3: "", None: "plain", 4: "end"}
    for r in one:
        (about,), (made,) = list(warc.records(r.metadata)), list(warc.records(r.conversion))
        assert r.error is None and r.refers_to == r.response_id == about.get("WARC-Refers-To") == made.get("WARC-Refers-To")
        assert made.block.decode() == r.text and r.text_digest == sha1(made.block)
    files = spark.createDataFrame([(1, None), (2, bytearray(b"WARC/1.1\r\nWARC-Type: response\r\n"))], "text int, data binary")
    assert [(r.key, r.error) for r in warc.derive_records(files.withColumnRenamed("text", "key"), "data", ("key",)).collect()] == [(2, "headers are cut off")]


def html(body, headers="Content-Type: text/html"):
    return warc.Record("response", [], f"HTTP/1.1 200 OK\r\n{headers}\r\n\r\n".encode() + body)


def test_hostile_chunks_end():
    chunked = "Content-Type: text/html\r\nTransfer-Encoding: chunked"
    for body in (b"-6\r\nabc", b"+3\r\nabc", b"0x3\r\nabc", b"1_0\r\nabc", b"\r\n" * 50, b"f" * 40 + b"\r\nabc", b"", b"3"):
        assert warc.derive(html(body, chunked))[2] == warc.plain_text(body.decode())
    assert warc.derive(html(b"3;x=1\r\nabc\r\n2\r\nde\r\n0\r\n\r\n", chunked))[2] == "abcde"
    assert warc.derive(html(b"3\r\nabc\r\nffff\r\nde", chunked))[2] == "abcde"


def test_unusable_charsets_count_as_utf8():
    for name in ("undefined", "idna", "punycode", "rot13", "base64", "no-such", "utf-8"):
        assert warc.derive(html("<p>é ok</p>".encode(), f"Content-Type: text/html; charset={name}"))[2].endswith("ok")
    assert warc.derive(html("<p>é</p>".encode(), "Content-Type: text/html; charset=undefined"))[2] == "é"


def test_lengths_and_packed_bombs_give_a_reason():
    head = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {}\r\n\r\n"
    for n in ("9" * 5000, "-1", "１", "1_0", ""):
        assert [r["error"] for r in warc.rows(head.format(n).encode())] == ["no content length"]
    bomb = gzip.compress(bytes(100_000))
    try:
        list(warc.members(bomb, 1000))
    except warc.Malformed as e:
        assert str(e) == "a gzip member is too long"
    assert list(warc.members(bomb + bomb, 100_001)) == [bytes(100_000)] * 2
    packed = [("Content-Encoding", "gzip")]
    assert warc.decoded_body(packed, bomb, 1000) == bomb and warc.decoded_body(packed, bomb, 100_000) == bytes(100_000)
    assert warc.decoded_body(packed, gzip.compress(b"a") + gzip.compress(b"b"), 10) == b"ab" and warc.decoded_body(packed, b"plain") == b"plain"


def test_the_query_matches_a_brute_force_reading(spark, tmp_path):
    """Every record is read back line by line, with no help of the module."""
    rows = [(i, f"http://h{i % 3}.example/p{i}", f"<html><title>T{i}</title><body><p>one {i}<p>two &lt;{i}&gt;</body></html>") for i in range(40)] + [(40, None, None)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.mode("overwrite").parquet(f"{tmp_path}/pages.parquet")
    got = warc.op8_warc_derivatives(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)

    def read(data):
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        block = rest[: int(fields["Content-Length"])]
        assert lines[0] == "WARC/1.1" and rest[len(block) :] == b"\r\n\r\n" and fields["WARC-Block-Digest"] == sha1(block)
        return fields, block

    source = {r[0]: r for r in rows}
    for r in got:
        _, url, page = source[r.page_id]
        body = (page or "").encode()
        (about, facts), (made, text) = read(bytes(r.metadata)), read(bytes(r.conversion))
        assert (about["WARC-Type"], made["WARC-Type"]) == ("metadata", "conversion")
        assert about["WARC-Refers-To"] == made["WARC-Refers-To"] == r.response_id and about.get("WARC-Target-URI") == made.get("WARC-Target-URI") == url
        assert about["WARC-Concurrent-To"] == made["WARC-Record-ID"] and made["WARC-Concurrent-To"] == about["WARC-Record-ID"]
        assert text.decode() == r.text == ("" if page is None else f"T{r.page_id}\none {r.page_id}\ntwo <{r.page_id}>")
        listed = dict(line.split(": ", 1) for line in facts.decode().split("\r\n") if line)
        assert listed["refers-to"] == r.response_id and listed["source-payload-digest"] == r.payload_digest == sha1(body) and listed["http-header-Content-Length"] == str(len(body))
    assert len({r.response_id for r in got}) == len(rows)
