import gzip
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tidegrid.llm import warc
from tidegrid.sources.tables import shared_folder

PAGES = "page_id bigint, url string, html string"


@pytest.fixture(scope="module")
def pages(spark, corpus):
    big = "<p>é" + "copy " * 400
    rows = [(1, "http://a", big), (2, "http://b", big), (9, None, big), (3, "u v", "small"), (4, "x", "small"), (5, "y", None), (6, "z", "")]
    rows += [(100 + i, f"http://h/{i}", f"page {i} " * (i % 50) + "\r\n\r\n<b>") for i in range(120)] + [(500, "long", "z" * 3_000_000)]
    return spark.createDataFrame(rows, PAGES)


@pytest.fixture(scope="module")
def files(spark, pages):
    return warc.write(pages.repartition(4), shared_folder(spark), file_bytes=4000)


@pytest.mark.parametrize("split", [97, 1000, 1 << 20])
def test_every_record_once_at_any_split(pages, files, split):
    rows = {r.page_id: r for r in warc.read(files, keep_payload=True, split_bytes=split).collect()}
    want = {r.page_id: (r.html or "") for r in pages.collect()}
    assert set(rows) == set(want)
    for i, html in want.items():
        r = rows[i]
        assert (r.payload_bytes, r.payload_digest) == (len(html.encode()), hashlib.sha1(html.encode()).hexdigest())
        assert r.digest_ok and (r.html == html if r.record_type == "response" else r.html is None)
    assert {i: r.refers_to for i, r in rows.items() if r.record_type == "revisit"} == {1: 9, 2: 9}


def test_a_magic_inside_a_member_is_no_record(tmp_path):
    """A stored member whose payload has the magic, and one that looks like a member but holds no record."""
    head = warc._record(1, "u", b"A" * 50, 50, hashlib.sha1(b"A" * 50).hexdigest(), None)
    inner = gzip.compress(b"not a record " * 20)
    body = inner + warc.MAGIC + b"junk" + head
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)
    record = zlib.decompress(warc._record(2, "u", body, len(body), hashlib.sha1(body).hexdigest(), None), 31)
    data = inner + head + stored.compress(record) + stored.flush() + b"\x00\x01" + warc._record(3, None, b"", 0, hashlib.sha1().hexdigest(), None)
    path = tmp_path / "x.warc.gz"
    path.write_bytes(data)
    for step in (len(data), 200):
        ids = [r[0] for a in range(0, len(data), step) for r in warc.read_range(str(path), a, min(a + step, len(data)))]
        # the record inside the stored payload starts in a range of its own only if that range begins inside the member
        assert [i for i in ids if i in (2, 3)] == [2, 3] and ids[0] == 1
        if step == len(data):
            assert ids == [1, 2, 3]


def test_a_cut_archive_fails_loudly(tmp_path):
    member = warc._record(1, "u", b"A" * 5000, 5000, "0", None)
    path = tmp_path / "cut.warc.gz"
    path.write_bytes(member[:-20])
    with pytest.raises(EOFError):
        list(warc.read_range(str(path), 0, len(member)))


def test_empty_tables_and_extra_columns(spark, pages):
    assert warc.read(warc.write(pages.where("false"), shared_folder(spark))).count() == 0
    clash = pages.limit(5).withColumn("payload_digest", F.lit("x")).withColumn("refers_to", F.lit(0))
    assert warc.read(warc.write(clash, shared_folder(spark))).count() == 5
    null_id = spark.createDataFrame([(None, "u", "a" * 2000), (None, "u", "a" * 2000), (4, None, "a" * 2000)], PAGES)
    rows = warc.read(warc.write(null_id, shared_folder(spark))).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in rows) == [("4", "response", None)] + [("None", "revisit", 4)] * 2
