import base64
import hashlib

import pytest

from matchform.llm import archives


def plain(rows):
    first = {}
    for page, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault((html or "").encode(), page)
    seen, out = set(), []
    for page, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        kind = "revisit" if data in seen else "response"
        seen.add(data)
        out.append((page, len(data), digest, kind, first[data] if kind == "revisit" else None))
    return sorted(out, key=repr)


def test_pages_go_through_both_formats_and_come_back(spark, folder, monkeypatch):
    real = [tuple(r) for r in spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html").collect()]
    odd = [(1000, None, None), (1001, "http://a b/\n", ""), (1002, "u", "HTTP/1.1\r\n\r\n\r\n\r\n"), (1003, "u", "é" * 200_000), (1003, "u", "é" * 200_000),
           (2, "copy", real[5][2]), (1004, "copy", real[5][2]), (None, "copy", real[5][2]), (1005, "u", "\n\nWARC/1.0\r\n")]
    rows = [r for r in real if r[0] != 2] + odd
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, path string")
    found = sorted(map(tuple, archives.archived(pages).collect()), key=repr)
    assert found == plain(rows)


def test_headers_of_both_versions_and_synthesised_fields(tmp_path):
    for version in (1, 2):
        path = f"{tmp_path}/v{version}.arc.gz"
        body = b"HTTP/1.1 200 OK\r\nX-Page-Id: 7\r\nContent-Length: 5\r\n\r\nhello"
        import gzip

        with open(path, "wb") as f:
            f.write(gzip.compress(archives.arc_opening(version, path)))
            f.write(gzip.compress(archives.arc_record(version, "http://x/a b", "1.2.3.4", "20110203040506", "text/html", body)))
            f.write(gzip.compress(archives.arc_record(version, "dns:x", "1.2.3.4", "2011020304", "text/dns", b"answer")))
        web, dns = archives.read_arc(path)
        assert (web.url, web.ip, web.date, web.content_type, web.document) == ("http://x/a b", "1.2.3.4", "20110203040506", "text/html", body)
        out = f"{tmp_path}/v{version}.warc.gz"
        with open(out, "wb") as f:
            for record in (archives.warc_opening(out), archives.warc_record(web), archives.warc_record(web, ("<id>", "u", "d")), archives.warc_record(dns)):
                f.write(gzip.compress(record))
        info, response, revisit, resource = archives.read_warc(out)
        assert [r[0]["WARC-Type"] for r in (info, response, revisit, resource)] == ["warcinfo", "response", "revisit", "resource"]
        assert response[0]["WARC-Date"] == "2011-02-03T04:05:06Z" and resource[0]["WARC-Date"] == "2011-02-03T04:00:00Z"
        assert response[0]["WARC-Payload-Digest"] == "sha1:" + archives.base32_sha1(b"hello") == revisit[0]["WARC-Payload-Digest"]
        assert response[1] == body and revisit[1] == body[:-5] and revisit[0]["WARC-Refers-To"] == "<id>"
        assert response[0]["WARC-Record-ID"].startswith("<urn:uuid:") and response[0]["WARC-Record-ID"] != resource[0]["WARC-Record-ID"]


def test_broken_archives_are_refused(tmp_path):
    import gzip

    path = f"{tmp_path}/bad.arc.gz"
    with open(path, "wb") as f:
        f.write(gzip.compress(archives.arc_opening(1, path)) + gzip.compress(b"http://x 1.1.1.1 20110101000000 text/html 99\nshort\n"))
    with pytest.raises(ValueError):
        list(archives.read_arc(path))
    with open(path, "wb") as f:
        f.write(gzip.compress(archives.arc_opening(1, path))[:-9])
    with pytest.raises(ValueError):
        list(archives.read_arc(path))


def test_small_payloads_may_all_be_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    folder = archives.work_folder(spark)
    found = archives.pages_in(archives.convert(archives.write_arc(pages, f"{folder}/a"), f"{folder}/w", least_bytes=3)).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in found) == [(1, "response", None), (2, "response", None), (3, "response", None), (4, "revisit", 3)]


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert archives.archived(pages).count() == 0
