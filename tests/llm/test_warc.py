from __future__ import annotations

import base64
import gzip
import hashlib
import io
import os

import pytest

from pactum.llm import warc
from pactum.llm.shared import shared_dir


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, digest string").repartition(3)


def test_round_trip(spark):
    big, other = "é" * 600, "z" * 1000
    rows = [(1, "http://a/", big), (9, "http://b/\r\nX: 1", big), (4, None, big), (2, "u", "small"), (3, "u", "small"), (5, "u", None), (6, "u", ""), (7, "u", other), (7, "u", other), (8, "u", "z" * 999), (10, "u", "z" * 999), (None, "u", big), (11, "u", "\r\n\r\nWARC/1.1\r\n" * 9)]
    got = warc.read_warc(spark, warc.write_warc(pages(spark, rows), shared_dir(spark)), with_payload=True).collect()
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        same = [j for j, _, x in rows if j is not None and (x or "").encode() == body]
        to = max(same) if len(body) >= 1000 and same and i is not None and max(same) > i else None
        want.append((i, len(body), hashlib.sha1(body).hexdigest(), "response" if to is None else "revisit", to, body if to is None else None))
    assert sorted(map(repr, ((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got))) == sorted(map(repr, want))


def test_empty_table(spark):
    assert warc.read_warc(spark, warc.write_warc(pages(spark, []), shared_dir(spark))).count() == 0


def archive(*payloads):
    return b"".join(warc.record(i, "u", p, len(p), hashlib.sha1(p).hexdigest(), None) for i, p in enumerate(payloads))


def test_one_member_a_record_and_any_piece_size(monkeypatch):
    body = archive(b"one" * 5000, b"", b"two")
    for size in (1, 7, 1 << 16):
        monkeypatch.setattr(warc, "READ", size)
        stream = io.BytesIO(body)
        got = [warc.page(*warc.parse(m)) for m in warc.members(stream.read)]
        assert [g[5] for g in got] == [b"one" * 5000, b"", b"two"]
    assert gzip.decompress(body).count(b"WARC/1.1\r\n") == 3


def test_damage_is_found():
    read = lambda b: [warc.page(*warc.parse(m)) for m in warc.members(io.BytesIO(b).read)]
    body = archive(b"payload")
    for bad in (body[:-5], b"no gzip", gzip.compress(b"no warc"), gzip.compress(gzip.decompress(body).replace(b"payload\r\n", b"PAYLOAD\r\n")), gzip.compress(gzip.decompress(body)[:-2])):
        with pytest.raises(warc.BadRecord):
            read(bad)


def foreign(kind, block, **headers):
    named = ({"WARC_Type": kind} if kind else {}) | headers | {"Content_Length": len(block)}
    head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in named.items())
    return gzip.compress(b"WARC/1.0\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n")


def test_records_of_other_writers(spark):
    """Other types are passed over; what the format doesn't ask for may be missing; digests may be in base 32."""
    http = b"HTTP/1.1 200 OK\r\n\r\nhello"
    b32 = "sha1:" + base64.b32encode(hashlib.sha1(b"hello").digest()).decode()
    body = foreign("warcinfo", b"software: x") + foreign("request", b"GET / HTTP/1.1\r\n\r\n") + foreign("metadata", b"a: b")
    body += foreign("response", http) + foreign("response", http, WARC_Record_ID="<urn:uuid:1>", WARC_Payload_Digest=b32, WARC_Block_Digest="sha1:" + base64.b32encode(hashlib.sha1(http).digest()).decode())
    body += foreign("revisit", b"HTTP/1.1 200 OK\r\n\r\n", WARC_Payload_Digest="sha1:abc") + archive(b"own")
    folder = shared_dir(spark).removeprefix("file:")
    os.makedirs(folder)
    with open(f"{folder}/other.warc.gz", "wb") as f:
        f.write(body)
    got = warc.read_warc(spark, spark.createDataFrame([(f"file://{folder}/other.warc.gz",)], "path string"), with_payload=True).collect()
    sha = hashlib.sha1(b"hello").hexdigest()
    want = [(None, 5, sha, "response", None, b"hello")] * 2 + [(None, None, "abc", "revisit", None, None), (0, 3, hashlib.sha1(b"own").hexdigest(), "response", None, b"own")]
    assert [(*r[:5], None if r.payload is None else bytes(r.payload)) for r in got] == want
    for bad in (foreign("response", http, WARC_Payload_Digest="sha1:" + "0" * 40), foreign(None, b"x")):
        with pytest.raises(warc.BadRecord):
            [warc.page(*warc.parse(m)) for m in warc.members(io.BytesIO(bad).read)]
