import struct

import pytest

from tessera.llm import warc as W
from tessera.session import scratch


def test_round_trip(spark):
    rows = [(1, "http://a", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (3, "http://c", None), (4, "http://d", ""), (5, "u\r\nv", "é" * 5000), (9, "http://e", "<p>x</p>"), (9, "http://e", "<p>x</p>"), (7, None, "only")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, refers_to string").repartition(3)
    got = W.archive_pages(df, payloads=True).collect()
    assert len(got) == len(rows)
    tops = {}
    for k, _, h in rows:
        tops[h or ""] = max(tops.get(h or "", k), k)
    for g in got:
        h = {r[0]: r[2] or "" for r in rows}[g.page_id]
        assert g.payload_bytes == len(h.encode()) and g.payload_digest == W.digest(h.encode())
        if g.page_id == tops[h]:
            assert (g.record_type, g.refers_to, bytes(g.payload)) == ("response", None, h.encode())
        else:
            assert (g.record_type, g.refers_to, g.payload) == ("revisit", tops[h], None)


def test_archive_format(spark, tmp_path):
    df = spark.createDataFrame([(i, "http://x", f"<html>{i} some words that repeat</html>" * 20) for i in range(300)], "page_id long, url string, html string").coalesce(1)
    folder = scratch(spark, "warc-test")
    listing = W.write_archives(df, folder, archive_bytes=8000, train_bytes=20_000).collect()
    assert sum(r.records for r in listing) == 300 and len(listing) > 1
    with open(listing[0].path, "rb") as f:
        magic, size = struct.unpack("<II", f.read(8))
        assert magic == W.MAGIC and size > 0
        f.seek(0)
        first = next(W.read_archive(f))
    assert first.startswith(b"WARC/1.1\r\nWARC-Type: response")
    # a standard decoder skips the dictionary frame and reads frames with the dictionary
    assert W.parse(first)["payload_bytes"] == len(f"<html>{W.parse(first)['page_id']} some words that repeat</html>" * 20)


def test_damage_is_noticed():
    raw = W.record(1, "u", b"payload", W.digest(b"payload"), None)
    with pytest.raises(ValueError, match="damaged"):
        W.parse(raw.replace(b"payload\r\n\r\n", b"paylOad\r\n\r\n"))


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert W.archive_pages(df).count() == 0
