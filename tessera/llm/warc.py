"""WARC archives compressed record by record with a Zstandard dictionary that travels in a leading skippable frame.

Each task writes archives of bounded size. For each, the first records up to ``TRAIN_BYTES`` are held back, a dictionary is
trained on their payloads, and the archive starts with that dictionary in a skippable frame (magic 0x184D2A5D); every
record then is a frame of its own, so any record can be read alone with the dictionary. Archives are files in the
shared folder under a name of the attempt; only those that a committed attempt lists are read, so a lost executor leaves at
most an unlisted file.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch, ship, table, width, written
from .columns import slices

MAGIC, TRAIN_BYTES, DICT_BYTES, ARCHIVE_BYTES, LEVEL = 0x184D2A5D, 2 << 20, 64 << 10, 256 << 20, 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(page: int | None) -> str:
    return f"<urn:tessera:page:{'' if page is None else page}>"


def record(page, url: str, payload: bytes, sha: str, refers) -> bytes:
    """A response record, or a revisit of page ``refers`` (given as a tuple), which has the head of the response alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: {urn(page)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{sha}", "Content-Type: application/http; msgtype=response"]
    if refers:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {urn(refers[0])}"]
    block = head if refers else head + payload
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's fields; the digest of a response is taken from its payload and must be the one stated."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x.split(b": ")[1] for x in http.split(b"\r\n") if x.startswith(b"Content-Length")))
    sha = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (digest(payload) != sha or len(payload) != length):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")

    def page(s: str | None) -> int | None:
        return int(n) if s and (n := s.removeprefix("<urn:tessera:page:").rstrip(">")) else None

    return {"page_id": page(fields["WARC-Record-ID"]), "payload_bytes": length, "payload_digest": sha, "record_type": kind, "refers_to": page(fields.get("WARC-Refers-To")), "url": fields["WARC-Target-URI"], "payload": payload if kind == "response" else None}


class Writer:
    """One archive: records held until the dictionary is trained, then compressed one by one."""

    def __init__(self, out, train_bytes: int = TRAIN_BYTES):
        self.out, self.held, self.bytes, self.packer, self.written = out, [], 0, None, 0
        self.train_bytes = train_bytes

    def add(self, raw: bytes) -> None:
        if self.packer:
            self._put(raw)
        else:
            self.held.append(raw)
            self.bytes += len(raw)
            if self.bytes >= self.train_bytes:
                self._train()

    def _train(self) -> None:
        import zstandard as z

        try:
            d = z.train_dictionary(DICT_BYTES, self.held)
        except z.ZstdError:  # too few or too small samples to train on: their bytes serve as a raw dictionary
            d = z.ZstdCompressionDict(b"".join(self.held)[:DICT_BYTES] or b"WARC/1.1", dict_type=z.DICT_TYPE_RAWCONTENT)
        blob = d.as_bytes()
        self.out.write(struct.pack("<II", MAGIC, len(blob)) + blob)
        self.written = len(blob) + 8
        self.packer = z.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=True)
        held, self.held = self.held, []
        for raw in held:
            self._put(raw)

    def _put(self, raw: bytes) -> None:
        frame = self.packer.compress(raw)
        self.out.write(frame)
        self.written += len(frame)

    def close(self) -> None:
        if not self.packer:
            self._train()
        self.out.close()


def read_archive(stream, chunk: int = 256 << 10):
    """The records of an archive, in turn; memory is one record and one chunk."""
    import zstandard as z

    magic, size = struct.unpack("<II", stream.read(8))
    if magic != MAGIC:
        raise ValueError("no dictionary frame")
    blob = stream.read(size)
    trained = blob[:4] == b"\x37\xa4\x30\xec"
    d = z.ZstdCompressionDict(blob, dict_type=z.DICT_TYPE_FULLDICT if trained else z.DICT_TYPE_RAWCONTENT)
    unpacker, data = z.ZstdDecompressor(dict_data=d), b""
    while True:
        data = data or stream.read(chunk)
        if not data:
            return
        one, parts = unpacker.decompressobj(), []
        while not one.eof:
            if not data:
                data = stream.read(chunk)
                if not data:
                    raise ValueError("archive ends within a record")
            parts.append(one.decompress(data))
            data = one.unused_data if one.eof else b""
        yield b"".join(parts)


def filesystem(path: str):
    """The file system of a folder Spark names, and the path in it."""
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def plan_records(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """Every page with ``refers``: the page whose equal payload it revisits, or null. Digests are aggregated before the join.

    Among equal payloads the largest page is the response. The digests are stored first: then both sides of the join are plain
    exchanges, and adaptive execution splits a digest that many pages have.
    """
    p = pages.select(F.col(key).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    p = p.withColumn("sha", F.sha1(F.encode("html", "UTF-8")))
    same = written(p.groupBy("sha").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).filter("n > 1").select("sha", "top"), "same-payloads")
    return p.join(same, "sha", "left").select("page_id", "url", "html", F.when(F.col("top") != F.col("page_id"), F.col("top")).when(F.col("page_id").isNull(), F.col("top")).alias("refers"))


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", archive_bytes: int = ARCHIVE_BYTES, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """Write the archives and return (path, records) of each. The table is stored, so no archive is written twice."""
    ship(pages.sparkSession)

    def run(batches):
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        ctx, made, writer = TaskContext.get(), [], None
        for b in slices(batches, "html"):
            for page, u, h, ref in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("page_id", "url", "html", "refers")), strict=True):
                if writer is None or writer.written >= archive_bytes:
                    if writer:
                        writer.close()
                    made.append([f"{root}/part-{ctx.partitionId():06d}-{ctx.taskAttemptId()}-{len(made):04d}.warc.zst", 0])
                    writer = Writer(fs.open_output_stream(made[-1][0], compression=None), train_bytes)
                payload = h.encode()
                writer.add(record(page, u.replace("\r", "%0D").replace("\n", "%0A"), payload, digest(payload), (ref,) if ref is not None else None))
                made[-1][1] += 1
        if writer:
            writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], names=["path", "records"])

    return written(plan_records(pages, key, url, html).mapInArrow(run, "path string, records long"), "warc-list")


def read_archives(listing: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """A row per record of the listed archives."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"] + ["payload"] * payloads
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches):
        fs, _ = filesystem(folder)
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for raw in read_archive(stream):
                        rows.append(parse(raw))
                        size += len(raw)
                        if size > 4 << 20:
                            yield out(rows)
                            rows, size = [], 0
                yield out(rows)

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=False)], names=names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * payloads
    return listing.select("path").repartition(width(listing.sparkSession)).mapInArrow(run, schema)


def archive_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", payloads: bool = False) -> DataFrame:
    """Write every page as a WARC record and read the archives back.

    Null and empty html is an empty payload. Rows of one page_id are records of their own; those with equal payloads and the
    largest page_id are all responses. A null page_id is kept as null. Other columns are not archived. No pages give no archive.
    """
    folder = scratch(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, key, url, html), folder, payloads)


def op1_warc(spark, sf_dir: str) -> DataFrame:
    ship(spark)
    return archive_pages(table(spark, sf_dir, "pages"))


#: Records, digests and duplicates of the archives; base32 is spelt out of the hexadecimal digest, 20 bits at a time.
ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, encode(coalesce(html, '')) AS b FROM pages), h AS (SELECT page_id, url, octet_length(b) AS n, sha1(b) AS x FROM p), m AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS top FROM h)
SELECT page_id, n::BIGINT AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(x, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4)) & 31)::BIGINT + 1, 1)), '') AS payload_digest,
 CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, (CASE WHEN page_id <> top THEN top END)::BIGINT AS refers_to, url FROM m
"""
