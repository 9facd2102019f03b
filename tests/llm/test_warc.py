import base64
import io
from collections import Counter, defaultdict
from hashlib import sha1

import duckdb
import pytest
import zstandard
from llm_cases import SF, none, odd  # noqa: F401
from pyspark.sql import functions as F

from codegauge.llm import queries as Q
from codegauge.llm import warc

SCHEMA = "page_id long, url string, html string"
BIG = "<p>é☃𝄞</p>" * 90000
ROWS = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (9, "http://a/9", "<p>x</p>"), (9, "http://a/9", "<p>x</p>"), (3, None, None), (4, "http://a/4", ""),
        (5, "http://a/ 5\r\nWARC-Type: x", "\r\n\r\nWARC/1.1\r\n\r\n"), (None, "u", "<p>x</p>"), (None, "u", "only null"), (None, "u", "only null"),
        (6, "http://b/6", BIG), (7, "http://b/7", BIG), (8, "http://b/8", BIG + "."), (-5, "n", "neg"), (10, "http://b/10", "z" * 50)]


@pytest.fixture(scope="module")
def pages(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    for c in ("block", "digest", "doc_id", "row", "file", "n", "all", "last"):
        df = df.withColumn(c, F.lit("x"))
    return df


def brute(rows, least=0):
    """page_id, size, digest, type, refers_to; of rows sharing the largest id of a payload one is the response."""
    by, out = defaultdict(list), Counter()
    for page, html in rows:
        by[(html or "").encode()].append(page)
    for body, ids in by.items():
        ids.sort(key=lambda x: (x is not None, x or 0))
        base = len(body), base64.b32encode(sha1(body).digest()).decode()
        for k, page in enumerate(ids):
            again = len(body) >= least and k < len(ids) - 1
            out[(page, *base, "revisit" if again else "response", ids[-1] if again else None)] += 1
    return out


def archived(pages, **kw):
    index = warc.write_archives(pages, warc.archive_folder(pages.sparkSession), **kw)
    got = warc.read_archives(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return index, Counter(map(tuple, got.collect()))


@pytest.mark.parametrize("least", [0, 5, 10**9])
def test_odd_rows(pages, least):
    assert archived(pages, least=least)[1] == brute([(r.page_id, r.html) for r in pages.collect()], least)


def test_empty_table(pages):
    index, got = archived(pages.where("false"))
    assert index.count() == 0 and not got


def test_many_blocks_and_frames(spark):
    p = spark.read.parquet(f"{SF}/pages.parquet")
    many = p.union(p.select(F.col("page_id") + 1000, "url", "html")).union(p.select(F.col("page_id") + 5000, "url", F.lit("same")))
    index, got = archived(many, block_bytes=60_000, frame_bytes=9_000)
    assert got == brute([(r.page_id, r.html) for r in many.collect()])
    assert index.select("file").distinct().count() > 5
    assert index.groupBy("file").agg(F.countDistinct("frame").alias("n")).agg(F.max("n")).first()[0] > 3
    assert index.where("record_type = 'response' and page_id >= 5000").count() == 1


def test_fetch_by_id(spark, pages):
    index, _ = archived(pages, frame_bytes=64)
    want = spark.createDataFrame([(1,), (9,), (7,), (3,), (404,)], "page_id long")
    got = Counter((r.page_id, r.record_type, r.payload) for r in warc.fetch(index, want).collect())
    assert got == Counter({(1, "revisit", "<p>x</p>"): 1, (9, "response", "<p>x</p>"): 1, (9, "revisit", "<p>x</p>"): 1, (7, "response", BIG): 1, (3, "revisit", ""): 1})


def test_any_zstd_reader_and_index(pages):
    """A plain reader sees one stream of records (the seek table is a frame that it skips); index entries point at their records."""
    index = archived(pages, frame_bytes=64)[0].collect()
    seen = Counter()
    for name in {r.file for r in index}:
        raw = open("/" + name.split(":", 1)[-1].lstrip("/"), "rb").read()
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
        heads = [h for h, _ in warc.parse(whole)]
        assert heads[0]["WARC-Type"] == "warcinfo"
        seen.update(h["WARC-Record-ID"] for h in heads[1:])
        for r in (r for r in index if r.file == name):
            frame = zstandard.ZstdDecompressor().decompress(raw[r.frame_start:r.frame_start + r.frame_size])
            (head, _), = warc.parse(frame[r.offset:r.offset + r.length])
            assert head["WARC-Record-ID"] == r.record_id and head["WARC-Type"] == r.record_type
    assert seen == Counter(r.record_id for r in index) and max(seen.values()) == 1


def test_broken_archives_are_noticed():
    good = warc.record("<urn:x-page:1:0>", "u", b"abc")
    (head, block), = warc.parse(good)
    assert bytes(warc.payload_of(head, block)[1]) == b"abc"
    for bad in (good[:-6], b"junk" + good, good.replace(b"abc", b"abd")):
        with pytest.raises(ValueError):
            [warc.payload_of(h, b) for h, b in warc.parse(bad)]


def test_sql_and_columns(spark):
    c = duckdb.connect()
    c.sql(f"create view pages as select * from '{SF}/pages.parquet'")
    got = Q.QUERIES["op12_warc"](spark, SF)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert Counter(map(tuple, got.collect())) == Counter(c.sql(Q.ORACLE["op12_warc"]).fetchall())
