"""A deterministic, sharded WARC writer and its reader.

Records are sorted by page id into shards of about SHARD_BYTES of payload, whose bounds follow from the table alone (sums
over CELLS equal spans of ids; a span is never divided), not from the session or from sampling. A shard is written as
files that are rolled once they reach a compressed size. Every record is a gzip member of its own, with headers and
digests made anew. A file is written under a temporary name of the task attempt and renamed when complete; one that a
former attempt has completed holds the same bytes and stays, so no reader finds a file gone. The archive counts once
its manifest is there, which is renamed into place last; a folder that has one already is refused.

Of records with equal payloads (of ``min_bytes`` at least) the one with the smallest id is a ``response``; the others
are ``revisit`` records without payload that refer to it. Smaller payloads are all responses.

Null html is an empty payload; a null url leaves its header out; rows without a page id have no id header, are
responses and read back with a null id. Rows that repeat a page id with an equal payload are all written as the first
is. Extra columns are ignored; an empty table makes an archive without files.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.scratch import Scratch, partitions_for

ROLL_BYTES, SHARD_BYTES, CELLS = 8 << 20, 64 << 20, 4096
DATE = "2024-01-01T00:00:00Z"
_MANIFEST = "file string, n_records long, first_id long, last_id long, n_bytes long, sha256 string"
_ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)  # a gzip header of zlib has no time stamp
    return z.compress(data) + z.flush()


def _record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"WARC-Block-Digest: sha1:{digest32(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _clean(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    headers = [("WARC-Date", DATE)]
    if page_id is not None:
        headers.append(("WARC-Record-ID", f"<urn:page:{page_id}>"))
    if url is not None:
        headers.append(("WARC-Target-URI", _clean(url)))
    headers.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        return _record("response", [*headers, ("Content-Type", "application/http;msgtype=response")], http + payload)
    headers += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("Content-Type", "application/http;msgtype=response")]
    return _record("revisit", headers, http)


class _Rolling:
    """Files of one range: write, roll by compressed size, rename when complete."""

    def __init__(self, uri: str, shard: int, attempt: int, roll_bytes: int, done: list):
        self.fs, self.base = pafs.FileSystem.from_uri(uri)
        self.fs.create_dir(self.base, recursive=True)
        self.shard, self.attempt, self.roll = shard, attempt, roll_bytes
        self.seq, self.out, self.done = 0, None, done

    def write(self, page_id: int | None, record: bytes) -> None:
        if self.out is None:
            self.name = f"pages-{self.shard:06d}-{self.seq:05d}.warc.gz"
            self.temp = f"{self.base}/_{self.name}.{self.attempt}.part"
            self.out = self.fs.open_output_stream(self.temp, compression=None)
            self.size, self.n, self.first, self.sha = 0, 0, page_id, hashlib.sha256()
            self._put(_record("warcinfo", [("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        self._put(record)
        self.n, self.last = self.n + 1, page_id
        if self.size >= self.roll:
            self.close()

    def _put(self, record: bytes) -> None:
        data = _member(record)
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        final = f"{self.base}/{self.name}"
        if self.fs.get_file_info(final).type == pafs.FileType.NotFound:
            self.fs.move(self.temp, final)
        else:  # of an attempt before; the same bytes
            self.fs.delete_file(self.temp)
        self.done.append((self.name, self.n, self.first, self.last, self.size, self.sha.hexdigest()))
        self.out, self.seq = None, self.seq + 1


def _cell(page_id, low: int, span: int):
    """The span of ids that a page is in; pages without an id are before all others. Decimals, as ids may take all 64 bits."""
    at = ((page_id.cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")) / F.lit(span).cast("decimal(20,0)")).cast("int")
    return F.coalesce(at, F.lit(-1))


def _shards(pages: DataFrame, shard_bytes: int) -> tuple[list[tuple[int, int]], int, int]:
    """((cell, shard) of the cells that hold pages, the least id, and the ids of a cell): shards of whole cells."""
    low, high = pages.agg(F.min("page_id"), F.max("page_id")).first()
    low, high = (0, 0) if low is None else (low, high)
    span = (high - low) // CELLS + 1
    sums = pages.groupBy(_cell(F.col("page_id"), low, span).alias("cell")).agg(F.sum(F.coalesce(F.octet_length("html"), F.lit(0)).cast("long")).alias("n"))
    out, shard, held = [], 0, 0
    for cell, n in sorted((r.cell, r.n) for r in sums.collect()):  # CELLS rows at most, and one
        if held and held + n > shard_bytes:
            shard, held = shard + 1, 0
        out.append((cell, shard))
        held += n
    return out, low, span


def write_archive(pages: DataFrame, where: str, min_bytes: int = 0, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES, scratch: Scratch | None = None) -> DataFrame:
    """Write (page_id, url, html) as WARC files below ``where``; gives the manifest (one row a file)."""
    spark = pages.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    temp, final = f"{where}/_manifest.part", f"{where}/_manifest"
    files = path(final).getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(path(final)):
        raise FileExistsError(f"{where} holds an archive")
    scratch = scratch or Scratch(spark, "warc")
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    slim = pages.select("page_id", F.unhex(F.sha1(payload)).alias("digest"), F.length(payload).alias("n")).where(F.col("n") >= min_bytes)
    firsts = slim.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    marks = scratch.table(slim.join(firsts, "digest").where("page_id > first").select("page_id", "digest", "first").distinct(), "revisits")
    rows = pages.select("page_id", F.lit(1).alias("kind"), "url", F.coalesce("html", F.lit("")).alias("html"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("long").alias("first"))
    both = rows.unionByName(marks.select("page_id", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "first"))
    cells, low, span = _shards(pages, shard_bytes)
    spread = both.withColumn("cell", _cell(F.col("page_id"), low, span)).join(F.broadcast(spark.createDataFrame(cells, "cell int, shard int")), "cell")
    n = max(partitions_for(spark, 0), len({shard for _, shard in cells}))
    order = ["page_id", "kind", "url", "html"]
    ordered = spread.repartition(n, "shard").sortWithinPartitions("shard", *order).select(*order, "digest", "first", "shard")

    def run(batches):
        task = TaskContext.get()
        out, done, marks_of, at = None, [], {}, None
        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                page_id, kind, url, html, digest, first, shard = r
                if out is None or shard != out.shard:
                    if out is not None:
                        out.close()
                    out = _Rolling(where, shard, task.taskAttemptId(), roll_bytes, done)
                if page_id != at:
                    marks_of, at = {}, page_id
                if kind == 0:
                    marks_of[digest] = first
                    continue
                data = html.encode()
                own = hashlib.sha1(data).digest()
                out.write(page_id, page_record(page_id, url, data, base64.b32encode(own).decode(), marks_of.get(own)))
        if out is not None:
            out.close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["file", "n_records", "first_id", "last_id", "n_bytes", "sha256"])

    manifest = ordered.mapInArrow(run, _MANIFEST)
    manifest.write.mode("overwrite").json(temp)
    if not files.rename(path(temp), path(final)):
        raise OSError(f"{temp} cannot be renamed")
    return read_manifest(spark, where)


def read_manifest(spark: SparkSession, where: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).json(f"{where}/_manifest")


def members(data: bytes):
    """The uncompressed gzip members of a file, one at a time."""
    at = 0
    while at < len(data):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(data):
                raise ValueError("a gzip member is cut off")
            piece = data[at : at + 65536]
            parts.append(z.decompress(piece))
            at += len(piece)
        at -= len(z.unused_data)
        yield b"".join(parts)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if headers.get("WARC-Block-Digest") != f"sha1:{digest32(block)}":
        raise ValueError(f"block digest of {headers.get('WARC-Record-ID')} does not match")
    return headers, block


def _id(urn: str | None) -> int | None:
    return int(urn.removeprefix("<urn:page:").removesuffix(">")) if urn else None


def read_archive(spark: SparkSession, where: str) -> DataFrame:
    """What the archive's records say, one row a record; digests are computed anew and compared.

    Files are named by the manifest, whose rows (one for each rolled file) go to the driver.
    """
    files = [f"{where}/{r.file}" for r in read_manifest(spark, where).select("file").orderBy("file").collect()]
    if not files:
        return spark.createDataFrame([], _ROWS)

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for raw in members(data.as_py()):
                    headers, block = parse_record(raw)
                    kind = headers["WARC-Type"]
                    if kind not in ("response", "revisit"):
                        continue
                    head, _, body = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"Content-Length: (\d+)", head)[1])
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and (len(body) != size or digest32(body) != digest):
                        raise ValueError(f"payload of {headers.get('WARC-Record-ID')} does not match its digest")
                    rows.append((_id(headers.get("WARC-Record-ID")), size, digest, kind, _id(headers.get("WARC-Refers-To"))))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return spark.read.format("binaryFile").load(files).select("content").mapInArrow(run, _ROWS)
