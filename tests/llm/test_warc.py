"""Archives: written, read back, dictionaries, revisits, odd pages."""

import base64
import hashlib
import random
import struct

import pytest

from featlab.llm import warc

PAGES = "page_id long, url string, html string, payload string, key int, size int, n long, file string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "p", 1, 2, 3, "f") for i, u, h in rows], PAGES)


def some(n, seed=1):
    r = random.Random(seed)
    words = ["word%d" % k for k in range(400)]
    return [(i, f"http://example.com/{i}", "<html><p>" + " ".join(r.choices(words, k=200)) + "</p></html>") for i in range(n)]


def want(rows):
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        ids = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        top = max(ids) if len([1 for _, _, g in rows if (g or "") == (h or "")]) > 1 and ids else None
        again = top is not None and i != top
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


def read(spark, path):
    return sorted((tuple(r) for r in warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


ODD = [
    (100, "http://a/b c\r\nX-Y: 1", "same"), (101, None, "same"), (102, "", "same"), (None, "http://n", "same"), (103, "http://e", None), (104, "http://e", ""), (2**60 + 1, "http://ü/é", "ünïcödé \U0001f600"),
    (105, "http://r", "repeated"), (105, "http://r", "repeated"), (106, "http://r", "\r\n\r\nHTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nWARC/1.1\r\n"), (None, None, "only without an id"), (None, None, "only without an id"), (107, "u", "x" * 3_000_000),
]


@pytest.mark.parametrize("archive_bytes", [20_000, 32 << 20])
def test_round_trip(spark, tmp_path, archive_bytes):
    rows = some(120) + [(1000 + i, "http://copy", "<p>copied</p>") for i in range(50)] + ODD
    path = f"file://{tmp_path}/out"
    index = warc.write_archives(pages(spark, rows).repartition(3), path, archive_bytes=archive_bytes)
    assert index.count() == len(rows) and read(spark, path) == want(rows)
    payloads = {(r["page_id"], r["url"]): r["payload"] for r in warc.read_archives(spark, path).where("record_type = 'response'").collect()}
    assert payloads[2**60 + 1, "http://ü/é"].decode() == "ünïcödé \U0001f600" and len(payloads[107, "u"]) == 3_000_000
    for r in index.collect()[:40]:  # each record can be read alone
        fields, _ = warc.parsed(warc.record_at(r["file"], r["offset"], r["length"]))
        assert fields.get("page-id") == (None if r["page_id"] is None else str(r["page_id"])) and fields["warc-type"] == r["record_type"]


def test_dictionary_leads_the_archive_and_pays(spark):
    import zstandard

    records = [warc.record(i, u, h.encode(), len(h), warc.sha1_digest(h.encode()), None, "2020-01-01T00:00:00Z") for i, u, h in some(300)]
    data, places = warc.archived(records)
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D and data[8:12] == b"\x37\xa4\x30\xec" and places[0][0] == 8 + size
    plain = sum(len(zstandard.ZstdCompressor(level=3).compress(r)) for r in records)
    assert sum(n for _, n in places) < 0.9 * plain
    own = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    assert [own.decompress(data[a : a + n]) for a, n in places] == records
    with pytest.raises(zstandard.ZstdError):
        zstandard.ZstdDecompressor().decompress(data[places[0][0] : sum(places[0])])


def test_compressed_dictionary_is_read(tmp_path):
    import zstandard

    records = [warc.record(i, u, h.encode(), len(h), warc.sha1_digest(h.encode()), None, "2020-01-01T00:00:00Z") for i, u, h in some(100)]
    data, places = warc.archived(records)
    packed = zstandard.ZstdCompressor().compress(data[8 : places[0][0]])
    (tmp_path / "a.warc.zst").write_bytes(struct.pack("<II", warc.MAGIC, len(packed)) + packed + data[places[0][0] :])
    assert list(warc.records_of(str(tmp_path / "a.warc.zst"))) == records


def test_few_records_have_no_dictionary_and_cut_files_raise(tmp_path):
    records = [b"WARC/1.1\r\nContent-Length: 1\r\n\r\nx\r\n\r\n"]
    data, places = warc.archived(records)
    assert places[0][0] == 0
    (tmp_path / "a.warc.zst").write_bytes(data)
    assert list(warc.records_of(str(tmp_path / "a.warc.zst"))) == records
    (tmp_path / "b.warc.zst").write_bytes(data[:-3])
    with pytest.raises(ValueError):
        list(warc.records_of(str(tmp_path / "b.warc.zst")))


def test_files_that_the_index_does_not_name_are_left_alone(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    warc.write_archives(pages(spark, some(5)), path)
    (tmp_path / "out/archives/left-by-a-lost-task.warc.zst").write_bytes(b"half a file")
    assert read(spark, path) == want(some(5))


def test_a_changed_payload_is_noticed(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    file = warc.write_archives(pages(spark, some(1)), path).first()["file"].removeprefix("file://")
    bad = warc.record(0, "http://x", b"other", 5, warc.sha1_digest(b"told"), None, "2020-01-01T00:00:00Z")
    with open(file, "wb") as f:
        f.write(warc.archived([bad])[0])
    with pytest.raises(Exception, match="isn't what was written"):
        warc.read_archives(spark, path).collect()


def test_least_bytes(spark):
    rows = warc.decided(pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")]), least_bytes=3).collect()
    assert {r["page_id"]: r["record_type"] for r in rows} == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_no_pages(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    assert warc.write_archives(pages(spark, []), path).count() == 0 and read(spark, path) == []


def test_the_query_equals_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    import pandas as pd

    from featlab.llm import queries

    rows = some(30) + [(1000 + i, "u", "copied") for i in range(9)] + [(50, "u", None), (51, "u", "")]
    frame = pd.DataFrame(rows, columns=["page_id", "url", "html"])
    con = duckdb.connect()
    con.register("pages", frame)
    assert sorted(con.sql(queries.OP12_SQL).fetchall(), key=str) == want(rows)
