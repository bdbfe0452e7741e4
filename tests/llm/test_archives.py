"""Archives of other writers: several files and indexes, packed or not, records of other kinds, damaged payloads."""

import gzip
import json
import zipfile

import pytest

from lodestack.llm import warc


def one(kind, url, block, content="application/http; msgtype=response", **more):
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{abs(hash(url))}>", "WARC-Date": "2020-02-03T04:05:06Z", "WARC-Target-URI": url}
    return warc.headers("WARC/1.0", head | {"Content-Type": content} | more | {"Content-Length": str(len(block))}) + block + b"\r\n\r\n"


@pytest.fixture
def foreign(tmp_path):
    """Two files, one of them not packed, two indexes, one of them packed; the first index has a heading and blank lines."""
    body = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    a = [gzip.compress(one("response", f"http://www.x.org/{k}", body + b"page %d" % k)) for k in range(300)]
    b = [one("resource", "http://y.org/r", b"plain text", "text/plain"), one("revisit", "http://y.org/v", body, **{"WARC-Refers-To": "<urn:uuid:1>"})]
    bad = body + b"damaged"
    b.append(one("response", "http://y.org/bad", bad, **{"WARC-Payload-Digest": f"sha1:{warc.digest_of(b'other')}"}))
    path = tmp_path / "foreign.wacz"

    def lines(name, records):
        at = 0
        for k, r in enumerate(records):
            yield f"org,x)/{k} 20200203040506 " + json.dumps({"offset": at, "length": len(r), "filename": name, "url": "u"}) + "\n"
            at += len(r)

    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("archive/a.warc.gz", b"".join(a))
        z.writestr("archive/b.warc", b"".join(b))
        z.writestr("indexes/a.cdxj", "!meta {}\n\n" + "".join(lines("a.warc.gz", a)))
        z.writestr("indexes/b.cdxj.gz", gzip.compress("".join(lines("b.warc", b)).encode()))
        z.writestr("pages/pages.jsonl", "{}")
    return path


@pytest.mark.parametrize("span", [50, 1 << 20])
def test_foreign_archives(spark, foreign, span, monkeypatch):
    monkeypatch.setattr(warc, "INDEX_SPAN", span)
    monkeypatch.setattr(warc, "SPAN", 700)
    archives = spark.createDataFrame([(foreign.as_uri(),)], "uri string")
    got = {r.url: r for r in warc.read_archives(archives, strict=False).collect()}
    assert len(got) == 303
    assert all(bytes(got[f"http://www.x.org/{k}"].payload) == b"page %d" % k for k in range(300))
    r, v, bad = (got[f"http://y.org/{x}"] for x in ("r", "v", "bad"))
    assert (r.record_type, bytes(r.payload), r.digest_ok) == ("resource", b"plain text", None)
    assert (v.record_type, v.payload, v.refers_to_id, v.payload_bytes) == ("revisit", None, "<urn:uuid:1>", None)
    assert bad.digest_ok is False and bad.page_id is None
    with pytest.raises(Exception):  # noqa: B017
        warc.read_archives(archives).collect()


def test_own_index_is_cdxj(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://www.B.org:8/x?Y=1#z", "b"), (2, "https://a.b.org", "c"), (3, None, None)], "page_id long, url string, html string")
    (uri,) = [r.uri for r in warc.write_archives(pages.coalesce(1), tmp_path.as_uri()).collect()]
    with zipfile.ZipFile(uri.removeprefix("file://")) as z:
        lines = z.read(warc.INDEX).decode().splitlines()
        data = z.read(warc.DATA)
    assert lines == sorted(lines)
    assert [x.split(" ")[0] for x in lines] == ["org,b,a)/", "org,b:8)/x?y=1", "urn:page:3"]
    for line in lines:
        about = json.loads(line.split(" ", 2)[2])
        at, n = int(about["offset"]), int(about["length"])
        assert gzip.decompress(data[at : at + n]).startswith(b"WARC/1.1") and about["filename"] == "data.warc.gz"
