"""WARC archives as seekable Zstandard bundles.

A page becomes a WARC record: ``response`` with its payload, or ``revisit`` (identical payload digest) that names the response which holds
it. Records are grouped into frames that decompress on their own; a footer, the seek table of the Zstandard seekable format, lists
the sizes of the frames, so any reader finds any frame without the others. The index maps record identifiers to file, frame and the place inside it.

Pages are dealt to blocks by their row number, one archive a block. Which payloads are equal is settled on digests: a block sends each distinct digest once
with its last page, so a payload that a third of all pages share reaches its shuffle key once per block. Tasks write archives through
``pyarrow.fs`` (local, HDFS, S3, GCS paths) under names of their own; the index names the archives of the tasks that ended well, so a
lost executor or a second attempt leaves at most a file that nothing names.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codegauge.session import scratch_dir

from .common import BLOCK_BYTES, Blocks, n_blocks, ship_code

FRAME_BYTES = 256 << 10
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
# fixed values of the seekable format: magic numbers of the skippable frame and of its footer
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = ("record_id string, page_id long, record_type string, refers_to_record string, file string, frame int, frame_start long, frame_size long, "
         "offset long, length long")
RECORD = "record_id string, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string"


# ------------------------------------------------------------------ records
def record_name(page_id: int | None, row: int) -> str:
    """The identifier of a page's record: its page id and its number in the input, so that repeated ids stay apart."""
    return f"<urn:x-page:{'' if page_id is None else page_id}:{row}>"


def page_of(name: str) -> int | None:
    """The page id inside a record identifier."""
    page = name.strip("<>").split(":")[2]
    return int(page) if page else None


def sha1_base32(payload) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str) -> str:
    """A URL without the characters that would end its header line."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(name: str, url: str | None, payload, refers_to: str | None = None) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP header, whose Content-Length tells the full payload's size, and drops the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else b"".join((http, payload))
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_uri(url)}")
    if refers_to:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return b"".join(("\r\n".join(head).encode(), b"\r\n\r\n", block, b"\r\n\r\n"))


def _info() -> bytes:
    body = b"software: codegauge\r\nformat: WARC File Format 1.1\r\n"
    return b"".join((f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x-info:0>\r\nWARC-Date: {DATE}\r\n"
                     f"Content-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n".encode(), body, b"\r\n\r\n"))


def parse(frame: bytes, at: int = 0):
    """(headers, block) of the records from ``at`` to the end of a frame. Raises ValueError where the bytes are no record."""
    while at < len(frame):
        end = frame.find(b"\r\n\r\n", at)
        lines = frame[at:end].decode().split("\r\n") if end >= 0 else [""]
        if not lines[0].startswith("WARC/1."):
            raise ValueError(f"no record at byte {at} of the frame")
        head = dict(line.split(": ", 1) for line in lines[1:])
        start = end + 4
        at = start + int(head["Content-Length"])
        if frame[at:at + 4] != b"\r\n\r\n":
            raise ValueError(f"record {head.get('WARC-Record-ID')} is cut short")
        yield head, memoryview(frame)[start:at]
        at += 4


def payload_of(head: dict, block: memoryview) -> tuple[int, memoryview | None]:
    """Size of the full payload, and the payload (None for a revisit). Digests are checked."""
    raw = bytes(block[:4096])
    cut = raw.index(b"\r\n\r\n") + 4
    size = int(next(x for x in raw[:cut].decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    if head["WARC-Block-Digest"] != "sha1:" + sha1_base32(block):
        raise ValueError(f"block of {head['WARC-Record-ID']} does not match its digest")
    if head["WARC-Type"] == "revisit":
        return size, None
    body = block[cut:]
    if len(body) != size or head["WARC-Payload-Digest"] != "sha1:" + sha1_base32(body):
        raise ValueError(f"payload of {head['WARC-Record-ID']} does not match its digest")
    return size, body


# ------------------------------------------------------------------ archives
class Bundle:
    """Writes records into frames of about ``frame_bytes``, then the seek table."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.out, self.most = out, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.frames: list[tuple[int, int]] = []
        self.held: list[bytes] = []
        self.size = self.written = 0
        self.places: list[tuple[int, int, int, int, int]] = []  # of each record: frame, frame's start and size, offset, length
        self.waiting: list[tuple[int, int]] = []
        self.out.write(self._frame(_info()))

    def _frame(self, raw: bytes) -> bytes:
        packed = self.zstd.compress(raw)
        self.frames.append((len(packed), len(raw)))
        self.written += len(packed)
        return packed

    def add(self, rec: bytes) -> None:
        if self.held and self.size + len(rec) > self.most:
            self.flush()
        self.waiting.append((self.size, len(rec)))
        self.held.append(rec)
        self.size += len(rec)

    def flush(self) -> None:
        if self.held:
            start, number = self.written, len(self.frames)
            self.out.write(self._frame(b"".join(self.held)))
            self.places += [(number, start, self.frames[-1][0], at, n) for at, n in self.waiting]
            self.held, self.waiting, self.size = [], [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames)
        foot = struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + len(foot)) + table + foot)


def seek_table(file) -> list[tuple[int, int]]:
    """(start, compressed size) of the frames of an archive, from its footer alone."""
    size = file.size()
    n, flags, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    step = 12 if flags & 0x80 else 8
    table, at, out = file.read_at(n * step, size - 9 - n * step), 0, []
    for k in range(n):
        packed = struct.unpack_from("<I", table, k * step)[0]
        out.append((at, packed))
        at += packed
    return out


def storage(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


# ------------------------------------------------------------------ jobs
def write_archives(pages: DataFrame, folder: str, html: str = "html", least: int = 0, block_bytes: int = BLOCK_BYTES, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """One record per row of ``pages`` (page_id, url, ``html``) in archives of about ``block_bytes`` under ``folder``; returns the index, as a table in that folder.

    Of the rows with equal payloads of at least ``least`` bytes the one with the largest page_id is the response and the others revisit it (null
    ids stand before all others; of rows that share the largest id, the last of the input is the response). Smaller payloads are all
    responses. A null payload is empty, a null url gives no target. No rows give an index without rows.
    """
    spark = pages.sparkSession
    ship_code(spark)
    rows = pages.select(F.monotonically_increasing_id().alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.col(html).alias("html"))
    blocks = Blocks(rows, n_blocks(rows, "html", block_bytes), ["doc_id", "page_id", "url", "html"], text="html")
    store = folder.rstrip("/")

    def digest_of(texts) -> list[bytes]:
        return [hashlib.sha256(memoryview(x.as_buffer()) if x.is_valid else b"").digest() for x in texts]

    def request(t: pa.Table) -> pa.Table:
        last: dict = {}
        for d, page, row, size in zip(digest_of(t["html"]), t["page_id"].to_pylist(), t["doc_id"].to_pylist(), pc.fill_null(pc.binary_length(t["html"]), 0).to_pylist()):
            if size >= least:
                mine = (page is not None, page or 0, row)
                n, best = last.get(d, (0, mine))
                last[d] = n + 1, max(best, mine)
        return pa.table({"block": pa.array([t["block"][0].as_py()] * len(last), pa.int32()), "digest": pa.array(list(last), pa.binary()),
                         "n": pa.array([x[0] for x in last.values()], pa.int64()), "page": pa.array([x[1][1] if x[1][0] else None for x in last.values()], pa.int64()),
                         "row": pa.array([x[1][2] for x in last.values()], pa.int64())})

    # one row per payload and block: a payload's window has at most as many rows as there are blocks
    same = W.partitionBy("digest")
    asked = blocks.each(request, "block int, digest binary, n long, page long, row long")
    replies = (asked.withColumn("all", F.sum("n").over(same)).withColumn("last", F.max(F.struct("page", "row")).over(same))
               .where(F.col("all") > 1).select("block", "digest", F.col("last.page").alias("page"), F.col("last.row").alias("row")))

    def write(t: pa.Table, reply: pa.Table) -> pa.Table:
        lead = {d: (p, r) for d, p, r in zip(reply["digest"].to_pylist(), reply["page"].to_pylist(), reply["row"].to_pylist())}
        where, path = storage(store)
        where.create_dir(path, recursive=True)
        name = f"pages-{t['block'][0].as_py():06d}-{uuid.uuid4().hex}.warc.zst"
        cols: list[list] = [[] for _ in range(4)]
        with where.open_output_stream(f"{path}/{name}", compression=None) as out:
            bundle = Bundle(out, frame_bytes)
            for d, page, row, url, text in zip(digest_of(t["html"]), t["page_id"].to_pylist(), t["doc_id"].to_pylist(), t["url"].to_pylist(), t["html"]):
                payload = memoryview(text.as_buffer()) if text.is_valid else b""
                first = lead.get(d) if len(payload) >= least else None
                refers = record_name(*first) if first is not None and first[1] != row else None
                mine = record_name(page, row)
                bundle.add(record(mine, url, payload, refers))
                for c, v in zip(cols, (mine, page, "revisit" if refers else "response", refers)):
                    c.append(v)
            bundle.close()
        n = len(cols[0])
        number = lambda k: pa.array([p[k] for p in bundle.places], pa.int32() if not k else pa.int64())
        return pa.table({"record_id": pa.array(cols[0], pa.string()), "page_id": pa.array(cols[1], pa.int64()), "record_type": pa.array(cols[2], pa.string()),
                         "refers_to_record": pa.array(cols[3], pa.string()), "file": pa.array([f"{store}/{name}"] * n, pa.string()), "frame": number(0), "frame_start": number(1),
                         "frame_size": number(2), "offset": number(3), "length": number(4)})

    index = blocks.meet(replies, write, INDEX)
    index.write.parquet(f"{store}/index.parquet")
    return spark.read.schema(index.schema).parquet(f"{store}/index.parquet")


def read_archives(files: DataFrame) -> DataFrame:
    """All records (:data:`RECORD`) of the archives that the column ``file`` names, each once: frame by frame as the seek table lists them. A broken
    archive raises ValueError; a revisit's payload size and digest are those of the full payload."""
    ship_code(files.sparkSession)
    schema = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])

    def read(batches):
        zstd = zstandard.ZstdDecompressor()
        for batch in batches:
            for name in batch.column(0).to_pylist():
                where, path = storage(name)
                with where.open_input_file(path) as file:
                    for start, size in seek_table(file):
                        cols: list[list] = [[] for _ in schema]
                        for head, block in parse(zstd.decompress(file.read_at(size, start))):
                            if head["WARC-Type"] == "warcinfo":
                                continue
                            full, _ = payload_of(head, block)
                            refers = head.get("WARC-Refers-To")
                            values = (head["WARC-Record-ID"], page_of(head["WARC-Record-ID"]), head["WARC-Type"], page_of(refers) if refers else None, full, head["WARC-Payload-Digest"][5:])
                            for c, v in zip(cols, values):
                                c.append(v)
                        if cols[0]:
                            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return files.select("file").distinct().mapInArrow(read, RECORD)


def fetch(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """page_id, record_type and payload of the records whose page_id is in ``wanted``: one read of one frame each, revisits through the response that they name.

    Rows come in the order of file and frame inside a task, which reads a frame once for all its records."""
    ship_code(index.sparkSession)
    hits = index.join(wanted.select("page_id").distinct(), "page_id", "left_semi").select("page_id", "record_type", F.coalesce("refers_to_record", "record_id").alias("holder"))
    places = index.where("record_type = 'response'").select(F.col("record_id").alias("holder"), "file", "frame_start", "frame_size", "offset", "length")
    jobs = hits.join(places, "holder").select("page_id", "record_type", "file", "frame_start", "frame_size", "offset", "length").sortWithinPartitions("file", "frame_start")

    def read(batches):
        zstd, held, raw, opened, file = zstandard.ZstdDecompressor(), None, b"", None, None
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part, out = batch.slice(k, 64), []
                for name, start, size, at, n in zip(*[part.column(c).to_pylist() for c in range(2, 7)]):
                    if opened != name:
                        where, path = storage(name)
                        file, opened = where.open_input_file(path), name
                    if held != (name, start):
                        held, raw = (name, start), zstd.decompress(file.read_at(size, start))
                    head, block = next(parse(raw[at:at + n]))
                    out.append(bytes(payload_of(head, block)[1]).decode())
                yield pa.record_batch([part.column(0), part.column(1), pa.array(out, pa.string())], names=["page_id", "record_type", "payload"])

    return jobs.mapInArrow(read, "page_id long, record_type string, payload string")


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives in the shared place of the cluster."""
    return scratch_dir(spark, "warc")


_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ORACLE_SQL = f"""SELECT page_id, strlen(body) AS payload_bytes,
    array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform([15, 10, 5, 0],
      lambda b: substr('{_DIGITS}', CAST((CAST('0x' || substr(sha1(body), 5 * g + 1, 5) AS BIGINT) >> b) & 31 AS BIGINT) + 1, 1)), '')), '') AS payload_digest,
    CASE WHEN strlen(body) >= 0 AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN strlen(body) >= 0 AND last <> page_id THEN last END AS refers_to
  FROM (SELECT *, max(page_id) OVER (PARTITION BY body) AS last FROM (SELECT page_id, coalesce(html, '') AS body FROM pages) p) t"""
