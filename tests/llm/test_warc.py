"""WARC: round trips, revisits and damaged archives."""

import gzip
import io

import pytest

from stemsonde.llm import warc


def test_reader_takes_members_one_by_one_and_in_small_pieces():
    data = warc.record(1, "http://a/", b"<p>x</p>" * 1000, None) + warc.record(2, None, b"", None) + warc.record(3, "u\r\nX: y", b"<p>x</p>" * 1000, 1)

    class Slow(io.BytesIO):
        def read(self, n=-1):
            return super().read(7)

    for file in (io.BytesIO(data), Slow(data)):
        a, b, c = warc.read(file)
        assert (a["page_id"], a["payload"], a["record_type"]) == (1, b"<p>x</p>" * 1000, "response")
        assert (b["payload"], b["payload_bytes"], b["url"]) == (b"", 0, "urn:page:2")
        assert (c["record_type"], c["refers_to"], c["payload"], c["payload_bytes"], c["payload_digest"]) == ("revisit", 1, None, 8000, a["payload_digest"])
    assert list(warc.read(io.BytesIO(b""))) == []
    assert gzip.decompress(data).startswith(b"WARC/1.1\r\n")


def test_reader_refuses_damage():
    good = warc.record(1, "http://a/", b"payload", None)
    inside = gzip.decompress(good)
    for bad in (good[:-9], gzip.compress(inside.replace(b"payload\r", b"pAyload\r")), gzip.compress(inside[:-1]), gzip.compress(b"x" + inside), b"no gzip at all", gzip.compress(inside.replace(b"Content-Length: ", b"Content-Length: 1"))):
        with pytest.raises(warc.DamagedRecord):
            list(warc.read(io.BytesIO(bad)))


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(5, "http://a/", "same"), (2, "http://b/", "same"), (9, "http://c/", None), (7, None, ""), (3, "http://d/", "é日本"), (3, "http://d/", "é日本"), (None, "http://e/", "same"), (8, "x", "y" * 300_000)]
    return spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, payload string").repartition(3)


def test_round_trip_through_archives(spark, pages):
    rows = warc.records(warc.written(pages)).collect()
    got = sorted(((r.page_id, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload).decode(), r.payload_bytes) for r in rows), key=str)
    assert got == sorted([(2, "response", None, "same", 4), (5, "revisit", 2, None, 4), (None, "revisit", 2, None, 4), (7, "response", None, "", 0), (9, "revisit", 7, None, 0),
                          (3, "response", None, "é日本", 8), (3, "response", None, "é日本", 8), (8, "response", None, "y" * 300_000, 300_000)], key=str)
    assert all(r.payload_digest == warc.digest(bytes(r.payload)) for r in rows if r.payload is not None)


def test_small_payloads_are_not_revisited(pages):
    kinds = {(r.page_id, r.record_type) for r in warc.records(warc.written(pages, least=5), with_payload=False).collect()}
    assert (5, "response") in kinds and (9, "response") in kinds


def test_empty_table(spark, pages):
    assert warc.records(warc.written(pages.where("false"))).collect() == []
