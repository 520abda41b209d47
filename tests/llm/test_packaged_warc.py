import hashlib
import io
import json
import uuid
import zipfile

import pytest

from larkspur.llm import packaged_warc as P
from larkspur.sources.storage import shared_dir


def brute(pages):
    first = {}
    for page, _, html in pages:
        raw = (html or "").encode()
        if len(raw) >= P.LEAST and page is not None:
            first[raw] = min(first.get(raw, page), page)
    out = []
    for page, _, html in pages:
        raw = (html or "").encode()
        again = raw in first and page != first[raw]
        out.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[raw] if again else None))
    return sorted(out, key=repr)


def packed(spark, pages, folder=None, **how):
    given = spark.createDataFrame([(*p, "x", 7) for p in pages], "page_id long, url string, html string, digest string, salt int")
    return P.write(P.typed(given.select("page_id", "url", "html", "digest", "salt")), folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}", **how)


LONG = "é" * 60
PAGES = [
    (5, "http://a.example/x", LONG), (3, "http://b.example/", LONG), (9, None, LONG), (3, "http://b.example/again", LONG), (None, "http://n.example/", LONG),
    (1, "http://s.example/", "short"), (2, "http://s.example/2", "short"), (4, "bad url\r\nX: y", None), (6, "", ""), (None, None, None),
    (7, "http://u.example/ ", "WARC/1.1\r\n\r\nPK\x05\x06" * 20), (8, "http://t.example/", "x" * 99), (10, "http://t.example/", "x" * 100), (11, "http://t.example/", "x" * 100), (12, "http://l.example/", "y\r\n\r\n" * 400_000),
]


def test_round_trip_against_brute_force(spark):
    found = P.read(P.located(packed(spark, PAGES))).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=repr) == brute(PAGES)
    payload = {r.page_id: bytes(r.payload).decode() for r in found if r.record_type == "response"}
    assert payload[3] == LONG and payload[12] == PAGES[-1][2] and payload[7] == PAGES[10][2]
    urls = {r.page_id: r.url for r in found if r.page_id is not None}
    assert urls[4] == "bad%20url%0D%0AX:%20y" and urls[9] == "urn:page:9" and urls[6] == ""


def test_several_packages_and_splits(spark, monkeypatch):
    monkeypatch.setattr(P, "HOT", 1)
    pages = [(i, f"http://h{i % 3}.example/{i}", "a page of text " * (i % 7 + 4)) for i in range(40)]
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    packages = packed(spark, pages, folder, most_records=3)
    rows = packages.collect()
    assert sum(r.records for r in rows) == 40 and max(r.records for r in rows) == 3
    found = P.read(P.located(packages), split_bytes=400, read_bytes=500).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=repr) == brute(pages)
    assert P.read(P.located(P.listed(spark, folder))).count() == 40


def test_nothing_gives_nothing(spark):
    packages = packed(spark, [])
    assert packages.count() == 0 and P.read(P.located(packages)).count() == 0


def members(raw):
    return list(P.directory(io.BytesIO(raw), len(raw), "here"))


def zipped(names, note=b"", before=b"", method=zipfile.ZIP_STORED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name in names:
            z.writestr(name, name.encode() * 3)
        z.comment = note
    return before + out.getvalue()


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("before", [b"", b"leading bytes"])
def test_directories(monkeypatch, wide, before):
    """Notes that look like an end, bytes before the package, and ZIP64 records of every kind."""
    if wide:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 4)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    names = ["archive/a.warc", "indexes/index.cdx", "é" * 200] + [f"m/{i}" for i in range(300)]
    for note in (b"", b"PK\5\6" + b"x" * 30, b"z" * 60_000):
        raw = zipped(names, note, before)
        found = members(raw)
        assert [m.name for m in found] == names
        for m in found:
            start = P.first_byte(io.BytesIO(raw), m, "here")
            assert m.method == 0 and raw[start : start + m.size] == m.name.encode() * 3


def test_more_members_than_two_bytes_count():
    names = [f"{i}" for i in range(70_000)]
    assert [m.name for m in members(zipped(names))] == names


def test_damage_is_named(spark, tmp_path):
    for raw in (b"", b"PK\5\6", b"no package at all" * 9, zipped(["a"])[:-30]):
        with pytest.raises(ValueError, match="here: "):
            members(raw)
    raw = bytearray(zipped(["a", "b"]))
    raw[raw.index(b"PK\1\2") + 1] = 0
    with pytest.raises(ValueError, match="without its mark"):
        members(bytes(raw))
    whole = P.record(1, "http://a/", "response", None, b"text", hashlib.sha256(b"other").hexdigest())
    with pytest.raises(ValueError, match="digest"):
        P.parsed(whole, "here")
    (tmp_path / "x.wacz").write_bytes(zipped(["archive/data.warc.gz"], method=zipfile.ZIP_DEFLATED))
    with pytest.raises(Exception, match="isn't stored"):
        P.located(P.listed(spark, str(tmp_path))).collect()


def test_foreign_package(spark, tmp_path):
    """Plain records, an index with file names without their folder, and members that don't matter."""
    raw = P.record(3, "http://a/", "response", None, b"text", hashlib.sha256(b"text").hexdigest())
    with zipfile.ZipFile(tmp_path / "x.wacz", "w") as z:
        z.writestr("datapackage.json", "{}", zipfile.ZIP_DEFLATED)
        z.writestr("archive/a.warc", b"padding" + raw)
        z.writestr("indexes/a.cdxj", f"a)/ 2000 {json.dumps({'filename': 'a.warc', 'offset': '7', 'length': str(len(raw))})}")
    found = P.read(P.located(P.listed(spark, str(tmp_path)))).collect()
    assert [(r.page_id, bytes(r.payload), r.member) for r in found] == [(3, b"text", "archive/a.warc")]
