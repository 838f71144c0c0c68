import gzip
import hashlib

import pytest

from fleetlens.llm import shared, warc

SCHEMA = "page_id long, url string, html string"
PAGES = [
    (1, "http://a/", "x" * 1000), (2, "http://b/", "x" * 1000), (3, "http://c/", "x" * 999), (4, "http://d/", "x" * 999),
    (5, None, None), (6, "http://e/\r\nX: y", ""), (7, "http://f/", "é" * 500 + "\r\n\r\nWARC/1.1\r\n" + "\u0000"), (8, "u", "é" * 500),
    (9, "u", "é" * 500), (9, "u", "é" * 500), (None, "n", "no id"), (2**60 + 1, "big", "q" * 2_000_000), (2**60 + 2, "big", "q" * 2_000_000),
]


def test_round_trip(frame, spark):
    archives = warc.write(frame(PAGES, SCHEMA), shared.new_folder(spark, "warc"), archive_bytes=5000)
    got = warc.read(archives).collect()
    want = []
    for page_id, _, html in PAGES:
        body = (html or "").encode()
        same = max(p for p, _, h in PAGES if (h or "").encode() == body and p is not None) if page_id is not None else None
        again = len(body) >= 1000 and page_id != same
        want.append((page_id, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", same if again else None, None if again else body))
    rows = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got]
    assert sorted(rows, key=repr) == sorted(want, key=repr)


def test_hot_payload(frame, spark):
    pages = [(i, f"http://h/{i}", "same" * 300) for i in range(600)]
    got = warc.read(warc.write(frame(pages, SCHEMA), shared.new_folder(spark, "warc"))).collect()
    assert sorted(r.page_id for r in got) == list(range(600))
    assert [r.page_id for r in got if r.record_type == "response"] == [599] and {r.refers_to for r in got} == {None, 599}


def test_one_member_per_record(frame, spark):
    path = warc.write(frame(PAGES[:3], SCHEMA).coalesce(1), shared.new_folder(spark, "warc")).first().path
    with open(path, "rb") as f:
        members = list(warc.members(f, block_bytes=7))
    assert len(members) == 3
    with gzip.open(path) as f:
        assert f.read() == b"".join(members)


def test_damage_is_seen():
    good = warc.record(1, "http://a/", b"payload", warc.sha1_name(b"payload"), None, "2024-01-01T00:00:00Z")
    assert warc.parsed(good)[0]["x-page-id"] == "1"
    for bad in (good.replace(b"payload", b"pAyload"), good[:-5], good + b"x", b"HTTP" + good):
        with pytest.raises(ValueError):
            warc.parsed(bad)
    import io

    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(gzip.compress(good)[:-9])))


def test_empty(frame, spark):
    assert warc.read(warc.write(frame([], SCHEMA), shared.new_folder(spark, "warc"))).count() == 0
