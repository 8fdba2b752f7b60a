"""WARC archives: writing, normalising to one gzip member a record with a sidecar offset index, and reading back.

An archive that is one gzip stream can only be read from its start. The normaliser inflates such a stream once, piece by
piece, rewrites every record as a member of its own and notes where it lies. Through the index, Spark then reads records
of all archives in tasks of equal size. Archives are files of the shared folder, opened with pyarrow's file systems;
a file gets its name when it is complete, and a task that runs again writes the same bytes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tranche.llm.common import map_batches, written_once

#: Payloads of fewer bytes are always stored: a revisit record would be no shorter.
LEAST_BYTES = 100
#: An archive is closed at so many bytes before compression.
ARCHIVE_BYTES = 1_000_000_000
PIECE = 1 << 20
LEVEL = 4
DATE = "2000-01-01T00:00:00Z"
#: Fixed values of the format.
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BREAK = b"\r\n"


def decided(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``(page_id, url, payload, digest, record_type, refers_to)`` per row.

    Of equal payloads of at least ``least_bytes`` bytes, that of the smallest id is the response and the others are
    revisits of it. A null html is an empty payload. Rows that repeat an id and payload are alike; where all ids of a
    payload are null there is nothing to refer to, and all are responses. Payloads are shuffled once, by digest.
    """
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    copies = rows.where(F.octet_length("payload") >= least_bytes).groupBy("digest")
    copies = copies.agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.join(copies.select("digest", "first_id"), "digest", "left").select(
        "page_id", "url", "payload", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first_id")).alias("refers_to"),
    )


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """A record whose block is the HTTP response; that of a revisit has the headers only."""
    http = BREAK.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload), b"", b""])
    block = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + 2 * BREAK + block + 2 * BREAK


class Output:
    """A file that gets its name when it is closed."""

    def __init__(self, path: str):
        self.files, self.path = fs.FileSystem.from_uri(path)
        task = TaskContext.get()
        self.draft = f"{self.path}.{task.taskAttemptId() if task else 0}.draft"
        self.stream = self.files.open_output_stream(self.draft, compression=None)

    def write(self, raw: bytes) -> None:
        self.stream.write(raw)

    def close(self) -> None:
        self.stream.close()
        self.files.move(self.draft, self.path)


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write rows of ``decided`` as archives that are one gzip stream each; ``(archive, records)`` for each of them.

    A task writes one archive, and a further one whenever ``archive_bytes`` are reached.
    """
    start_folder(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, done = TaskContext.get().partitionId(), 0, []
        out, size, records = None, 0, 0
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                if out is None:
                    name = f"{folder}/pages-{part:06d}-{number:04d}.warc.gz"
                    out, gz, size, records = Output(name), zlib.compressobj(LEVEL, wbits=31), 0, 0
                raw = record(*(x.as_py() for x in row))
                out.write(gz.compress(raw))
                size, records = size + len(raw), records + 1
                if size >= archive_bytes:
                    out.write(gz.flush())
                    out.close()
                    done.append((name, records))
                    out, number = None, number + 1
        if out is not None:
            out.write(gz.flush())
            out.close()
            done.append((name, records))
        names, counts = zip(*done, strict=True) if done else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=["archive", "records"])

    return written_once(map_batches(rows, run, "archive string, records long"), "warc-archives")


def start_folder(folder: str) -> None:
    files, path = fs.FileSystem.from_uri(folder)
    files.create_dir(path, recursive=True)


class Inflated:
    """The inflated bytes of a file, read piece by piece; members that follow each other are one stream."""

    def __init__(self, path: str):
        files, inner = fs.FileSystem.from_uri(path)
        self.stream = files.open_input_stream(inner, compression=None)
        self.gz = zlib.decompressobj(31)
        self.begun = False
        self.raw = b""
        self.held, self.at = b"", 0

    def more(self) -> bool:
        """Inflate a further piece; false at the end of the file."""
        while True:
            if self.gz.eof:
                self.raw = self.gz.unused_data or self.raw
                self.gz, self.begun = zlib.decompressobj(31), False
            raw = self.raw or self.stream.read(PIECE)
            if not raw:
                if self.begun:
                    raise ValueError("the archive ends within its stream")
                return False
            self.begun = True
            piece = self.gz.decompress(raw, PIECE)
            self.raw = self.gz.unconsumed_tail
            if piece:
                self.held, self.at = self.held[self.at :] + piece, 0
                return True

    def until(self, mark: bytes) -> bytes:
        """What comes before ``mark``, with it; empty at the end of the file."""
        while (end := self.held.find(mark, self.at)) < 0:
            if not self.more():
                if self.held[self.at :].strip():
                    raise ValueError("the archive ends within a record")
                return b""
        start, self.at = self.at, end + len(mark)
        return self.held[start : self.at]

    def pieces(self, n: int) -> Iterator[bytes]:
        while n:
            if self.at == len(self.held) and not self.more():
                raise ValueError("the archive ends within a record")
            out = self.held[self.at : self.at + n]
            self.at += len(out)
            n -= len(out)
            yield out


def headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "surrogatepass").strip("\r\n").split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite archives with a member for each record, and write ``<archive>.idx`` beside each: ``(index, records)``.

    A line of the index has the file, the offset and length of the member, the record's id and type, with tabs between.
    Memory holds a piece of a record at a time. A truncated or damaged archive fails the job.
    """
    start_folder(folder)

    def one(path: str, name: str) -> int:
        source, out, lines, offset = Inflated(path), Output(name), [], 0
        while head := source.until(2 * BREAK):
            fields = headers(head)
            gz, size = zlib.compressobj(LEVEL, wbits=31), 0
            for raw in chain((head,), source.pieces(int(fields["content-length"])), source.pieces(2 * len(BREAK))):
                packed = gz.compress(raw)
                out.write(packed)
                size += len(packed)
            packed = gz.flush()
            out.write(packed)
            size += len(packed)
            lines.append(f"{name}\t{offset}\t{size}\t{fields['warc-record-id']}\t{fields['warc-type']}\n")
            offset += size
        out.close()
        index = Output(name + ".idx")
        index.write("".join(lines).encode())
        index.close()
        return len(lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(0).to_pylist()
            names = [f"{folder}/{p.rpartition('/')[2]}" for p in paths]
            counts = [one(p, n) for p, n in zip(paths, names, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([n + ".idx" for n in names], pa.string()), pa.array(counts, pa.int64())], names=["index", "records"])

    each = archives.select("archive").repartition(max(1, archives.count()), "archive")
    return written_once(map_batches(each, run, "index string, records long"), "warc-index")


def read_archives(indexes: DataFrame) -> DataFrame:
    """Read records by their offsets: ``(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to)``.

    The payload of a response must have its digest. A revisit has a null payload, and the length and digest that it names.
    """
    spark = indexes.sparkSession
    folder = indexes.select(F.regexp_extract("index", "^(.*)/", 1)).first()
    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    if folder is None:
        return spark.createDataFrame([], schema)
    index = spark.read.csv(f"{folder[0]}/*.idx", sep="\t", quote="", schema="archive string, at long, size long, record string, kind string")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    index = index.repartitionByRange(parts, "archive", "at").sortWithinPartitions("archive", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, file = None, None
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                rows = []
                for name, at, size in zip(*whole.slice(start, 500).columns[:3], strict=True):
                    if name.as_py() != known:
                        known = name.as_py()
                        files, inner = fs.FileSystem.from_uri(known)
                        file = files.open_input_file(inner)
                    file.seek(at.as_py())
                    rows.append(parsed(zlib.decompress(file.read(size.as_py()), wbits=31)))
                columns = zip(*rows, strict=True)
                kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return map_batches(index, run, schema)


def number(record_id: str | None) -> int | None:
    digits = (record_id or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def parsed(raw: bytes) -> tuple:
    head, _, rest = raw.partition(2 * BREAK)
    fields = headers(head)
    http, _, payload = rest[: int(fields["content-length"])].partition(2 * BREAK)
    size, digest, kind = int(headers(http)["content-length"]), fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"]
    if kind == "revisit":
        payload = None
    elif len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"the payload of {fields['warc-record-id']} isn't what its headers say")
    return number(fields["warc-record-id"]), fields.get("warc-target-uri"), payload, size, digest, kind, number(fields.get("warc-refers-to"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages as archives, normalise these, and read all records back by the index. Archives stay in the shared folder."""
    names = written_once(pages.sparkSession.range(1), "warc")  # tells the shared folder's full address
    folder = names.inputFiles()[0].rpartition("/")[0]
    archives = write_archives(decided(pages), f"{folder}/streams")
    return read_archives(normalise(archives, f"{folder}/members"))


#: The rows of ``op4``.
ORACLE_SQL = """
WITH p AS (
  SELECT page_id, strlen(COALESCE(html, '')) AS n, sha256(COALESCE(html, '')) AS digest FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN MIN(page_id) OVER (PARTITION BY digest) END AS first_id FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id < page_id THEN first_id END AS refers_to
FROM f
"""
