"""Archives and their index: exact round trips."""

import gzip
import hashlib
from collections import Counter

import pytest

from noctua.llm import common, warc
from tests.llm import edge
from tests.oracle import assert_same


def stored(spark, pages):
    folder = common.shared_folder(spark, "warc")
    captures = warc.write(pages, folder)
    return folder, captures, warc.index(captures, folder)


def wanted(rows):
    first = {}
    for r in rows:
        first.setdefault(r.html or "", []).append(r.page_id)
    out = Counter()
    for r in rows:
        data = (r.html or "").encode()
        least = min((p for p in first[r.html or ""] if p is not None), default=None)
        revisit = len(data) >= 100 and least is not None and r.page_id != least
        out[(r.page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", least if revisit else None)] += 1
    return out


@pytest.mark.parametrize("lines, file_lines", [(1000, 50_000), (2, 4)])
def test_round_trip(spark, monkeypatch, lines, file_lines):
    """Every page comes back by the look-up of its address; with small files, addresses lie in several of them."""
    monkeypatch.setattr(warc, "LINES", lines)
    monkeypatch.setattr(warc, "FILE_LINES", file_lines)
    pages = edge.pages(spark)
    folder, captures, index = stored(spark, pages)
    found = warc.look_up_urls(pages, index)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found.collect()) == wanted(pages.collect())
    assert sum(f[3] for f in index.files) == captures.count() == pages.count()
    assert (len(index.files) > 1) == (file_lines == 4)
    # each record is where the capture says, and the archives hold nothing else
    places = sorted((r.archive, r.offset, r.length) for r in captures.collect())
    assert [warc.parse(m)["page_id"] for m in warc.members(places, folder)].count(3) == 1
    system, path = common.open_fs(folder)
    names = {f.base_name: f.size for f in system.get_file_info(warc.fs.FileSelector(path)) if f.base_name.endswith(".warc.gz")}
    assert sum(names.values()) == sum(p[2] for p in places) and not system.get_file_info(f"{path}/staged").is_file
    assert set(names) == {p[0] for p in places}


def test_look_up(spark, monkeypatch):
    monkeypatch.setattr(warc, "LINES", 2)
    pages = edge.pages(spark)
    _, _, index = stored(spark, pages)
    for address in [r.url for r in pages.collect()] + ["http://nowhere.example/"]:
        urls = spark.createDataFrame([(address,)], "url string")
        found = warc.look_up_urls(urls, index)
        key = warc.url_key(address)
        assert sorted((r.page_id is None, r.page_id or 0) for r in found.collect()) == sorted((r.page_id is None, r.page_id or 0) for r in pages.collect() if warc.url_key(r.url) == key)


def test_members_are_the_bytes_of_their_ranges(tmp_path, monkeypatch):
    """Near ranges are read at once, far ones on their own."""
    (tmp_path / "a").write_bytes(bytes(range(200)))
    places = [("a", 0, 3), ("a", 3, 2), ("a", 12, 4), ("a", 100, 1), ("a", 150, 50)]
    for gap, read in ((10, 8 << 20), (0, 8 << 20), (1000, 20)):
        monkeypatch.setattr(warc, "GAP", gap)
        monkeypatch.setattr(warc, "READ", read)
        assert list(warc.members(places, f"file://{tmp_path}")) == [bytes(range(o, o + n)) for _, o, n in places]


def test_records_are_plain_warc(spark):
    body = ("ü" * 100).encode()
    data = gzip.decompress(warc.record(7, "http://x/", body, hashlib.sha256(body).hexdigest()))
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and data.endswith(body + b"\r\n\r\n")
    revisit = warc.parse(warc.record(9, "http://x/", None, hashlib.sha256(body).hexdigest(), len(body), 7))
    assert (revisit["refers_to"], revisit["payload"], revisit["payload_bytes"]) == (7, None, 200)
    with pytest.raises(ValueError):
        warc.parse(warc.record(9, "http://x/", body, "0" * 64))


def test_keys():
    assert warc.url_key("HTTP://www.Example.com:80/a?b=1#c") == "com,example,www)/a?b=1"
    assert warc.url_key("https://x.org:8443") == "org,x:8443)/"
    assert warc.url_key(None) == warc.url_key("") == ")/"
    assert [warc.page_of(warc.record_id(p)) for p in (0, 5, -3, (1 << 63) - 1, None)] == [0, 5, -3, (1 << 63) - 1, None]


def test_no_pages(spark):
    pages = edge.pages(spark, empty=True)
    _, captures, index = stored(spark, pages)
    assert captures.count() == len(index.files) == warc.look_up_urls(pages, index).count() == 0


def test_same_as_sql(spark, sf_dir):
    assert_same(spark, sf_dir, warc.op8_warc, warc.SQL)
