"""WARC archives of pages, compressed with a Zstandard dictionary.

Each task writes its records to files of about ``file_bytes`` in the shared folder.
A file's first records, up to ``sample_bytes``, train a dictionary that a leading
skippable frame carries; then every record is a frame of its own, so one record can
be read without the others. Of records with equal payloads of at least
``least_bytes`` bytes the one with the smallest page_id is a response and the others
are revisits that refer to it and hold no payload.

A file is written under a name of its own and moved in place when complete; its name
has the run, the partition, the task's attempt and its number, so two attempts of one
task never write the same file. The manifest is a stored table of the attempts that
Spark accepted, and only listed files are read.

Nulls, empty and repeated rows: a null html is an empty payload. A null url leaves
the target out. Rows that repeat a page_id are records of their own: all of them are
responses if the page_id is the smallest of their payload, else revisits. A null
page_id is written and comes back as null; it is a revisit if a row of its payload has
a page_id, else a response. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldgraph.llm.skew import split_join
from veldgraph.llm.tokens import blocks
from veldgraph.storage import scratch_path, stored

LEAST_BYTES = 100
FILE_BYTES = 256 << 20
SAMPLE_BYTES = 1 << 20
DICTIONARY_BYTES = 32 << 10
LEVEL = 3
#: Duplicate groups up to this many are sent to all tasks; more are joined by a shuffle, with the same result.
SENT_GROUPS = 100_000
#: The skippable frame that holds a dictionary for the frames after it.
DICTIONARY_MAGIC = 0x184D2A5D
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"


def classified(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, html with payload_digest, record_type and refers_to."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("html"), F.sha2(F.encode(payload, "UTF-8"), 256).alias("payload_digest"))
    long_enough = rows.filter(F.octet_length("html") >= least_bytes)
    groups = long_enough.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("size")).filter("size > 1")
    groups = stored(groups, "payloads")
    if groups.limit(SENT_GROUPS + 1).count() <= SENT_GROUPS:
        out = rows.join(F.broadcast(groups.drop("size")), "payload_digest", "left")
    else:
        # Null, empty and short payloads, which share few digests, take no part; digests of many pages are split.
        short = rows.filter(F.octet_length("html") < least_bytes).withColumn("first_id", F.lit(None).cast("long"))
        out = split_join(long_enough, groups, ["payload_digest"], how="left").unionByName(short)
    revisit = F.col("first_id").isNotNull() & (F.octet_length("html") >= least_bytes) & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first_id")))
    return out.select("page_id", "url", "html", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_id")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC 1.1 record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n%]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _File:
    """One archive: gathers a sample, trains its dictionary and then writes frame after frame."""

    def __init__(self, fs: pafs.FileSystem, path: str, sample_bytes: int):
        self.fs, self.path, self.sample_bytes = fs, path, sample_bytes
        self.out = fs.open_output_stream(path + ".part", compression=None)
        self.waiting: list[bytes] | None = []
        self.held = self.written = self.records = 0
        self.compress = zstandard.ZstdCompressor(level=LEVEL)

    def _begin(self) -> None:
        waiting, self.waiting = self.waiting or [], None
        try:
            trained = zstandard.train_dictionary(DICTIONARY_BYTES, waiting, k=256, d=8)
        except zstandard.ZstdError:  # too few or too short records
            trained = zstandard.ZstdCompressionDict(b"".join(waiting)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.out.write(struct.pack("<II", DICTIONARY_MAGIC, len(trained.as_bytes())) + trained.as_bytes())
        self.compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained)
        for r in waiting:
            self._frame(r)

    def _frame(self, r: bytes) -> None:
        frame = self.compress.compress(r)
        self.out.write(frame)
        self.written += len(frame)

    def add(self, r: bytes) -> None:
        self.records += 1
        if self.waiting is None:
            self._frame(r)
            return
        self.waiting.append(r)
        self.held += len(r)
        if self.held >= self.sample_bytes:
            self._begin()

    def close(self) -> None:
        if self.waiting is not None:
            self._begin()
        self.out.close()
        self.fs.move(self.path + ".part", self.path)


#: Names of one store in Hadoop and in pyarrow.fs.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gcs": "gs", "wasbs": "abfss"}


def filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder that Spark knows, and its path there. What pyarrow has no store for goes through Hadoop's client."""
    scheme = urlsplit(folder).scheme
    known = folder.replace(scheme, SCHEMES[scheme], 1) if scheme in SCHEMES else folder
    try:
        return pafs.FileSystem.from_uri(known)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        parts = urlsplit(folder)
        return pafs.HadoopFileSystem(f"{parts.scheme}://{parts.netloc}"), parts.path


def write(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES, file_bytes: int = FILE_BYTES, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """Writes the archives below ``folder`` (a URI in the shared folder); the manifest has path and n_records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        task = TaskContext.get()
        mine, done, current = f"{base}/part-{task.partitionId():06d}-{task.taskAttemptId()}", [], None
        for batch in blocks(batches, "html"):
            for page_id, url, html, digest, kind, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if current is None:
                    current = _File(fs, f"{mine}-{len(done):04d}.warc.zst", sample_bytes)
                current.add(record(page_id, url, html.encode(), digest, kind, refers_to))
                if current.written >= file_bytes:
                    current.close()
                    done.append(current)
                    current = None
        if current is not None:
            current.close()
            done.append(current)
        yield pa.RecordBatch.from_arrays([pa.array([f.path for f in done], pa.string()), pa.array([f.records for f in done], pa.int64())], names=["path", "n_records"])

    return stored(classified(pages, least_bytes).mapInArrow(run, "path string, n_records long"), "manifest")


def records(fs: pafs.FileSystem, path: str) -> Iterator[dict]:
    """The records of one archive, one after another."""
    with fs.open_input_stream(path, compression=None) as raw:
        magic, size = struct.unpack("<II", raw.read(8))
        if magic != DICTIONARY_MAGIC:
            raise ValueError(f"{path} has no leading dictionary frame")
        stream = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw.read(size))).stream_reader(raw, read_across_frames=True)
        kept = bytearray()

        def more() -> bool:
            got = stream.read(1 << 20)
            kept.extend(got)
            return bool(got)

        def head_end(start: int) -> int:
            at = kept.find(b"\r\n\r\n", start)
            while at < 0:
                if not more():
                    raise ValueError(f"{path} ends within a record")
                at = kept.find(b"\r\n\r\n", start)
            return at + 4

        while kept or more():
            body = head_end(0)
            head = dict(line.split(": ", 1) for line in kept[: body - 4].decode().split("\r\n")[1:])
            end = body + int(head["Content-Length"])
            while len(kept) < end + 4:
                if not more():
                    raise ValueError(f"{path} ends within a record")
            http = head_end(body)
            length = int(re.search(rb"Content-Length: (\d+)", kept[body:http])[1])
            yield head | {"payload": bytes(kept[http:end]), "length": length}
            del kept[: end + 4]


def read(spark: SparkSession, manifest: DataFrame, folder: str, keep_payload: bool = True) -> DataFrame:
    """The archives' records. Digest and length of a response are computed from the payload that is read, and checked against its head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) else None
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, size = [], 0
                for r in records(fs, path):
                    digest = r["WARC-Payload-Digest"].removeprefix("sha256:")
                    if r["WARC-Type"] == "response" and (digest != hashlib.sha256(r["payload"]).hexdigest() or r["length"] != len(r["payload"])):
                        raise ValueError(f"{path}: a payload differs from its digest")
                    url = r.get("WARC-Target-URI")
                    url = url if url is None else re.sub("%(0D|0A|25)", lambda m: chr(int(m[1], 16)), url)
                    whole = r["payload"].decode() if keep_payload and r["WARC-Type"] == "response" else None
                    rows.append((number(r["WARC-Record-ID"]), url, r["length"], digest, r["WARC-Type"], number(r["WARC-Refers-To"]) if "WARC-Refers-To" in r else None, whole))
                    size += len(r["payload"]) if keep_payload else 0
                    if len(rows) >= 4096 or size > 8 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    n = max(1, manifest.count())
    return manifest.select("path").repartition(min(n, 10_000), "path").mapInArrow(run, READ)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[c.split()[0] for c in READ.split(", ")])


def archived(pages: DataFrame) -> DataFrame:
    """Writes all pages to new archives in the shared folder and reads them back."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    return read(spark, write(pages, folder), folder, keep_payload=False).drop("payload")
