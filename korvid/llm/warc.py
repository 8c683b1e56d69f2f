"""WARC archives, Zstandard-compressed record by record with a dictionary in the file.

A file starts with a skippable frame (magic ``0x184D2A5D``) that holds a
dictionary trained on the file's own first records; each record follows as a
frame of its own, so that it can be read alone.  Rows with equal payloads are
written once: the one with the largest page_id is a ``response``, the others
are ``revisit`` records that name it.

Recovery: a task writes under a name that only its attempt uses and reports the
name; the reported names are staged, and only they are read.  A file of a lost
or doubled attempt is never looked at.

Defined results: null html is an empty payload; a null url becomes
``urn:page:<id>``; a null page_id is written and read back as null, never is
the response while another id has the payload, and rows that all lack an id are
all responses; rows that repeat the largest page_id are all responses; an empty
table gives no archive and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korvid.llm.common import new_folder, staged

#: Bytes of records from which a file's dictionary is trained, and the dictionary's size.
SAMPLE_BYTES, DICT_BYTES = 2 << 20, 64 << 10
#: Compressed bytes after which a task starts another file.
ARCHIVE_BYTES = 64 << 20
LEVEL = 3
# Fixed values of the formats.
DICT_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
MANIFEST = "path string, records long, bytes long"
ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, archive string"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, sha1: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit keeps the headers and leaves the payload out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    target = "".join(c if c > " " else f"%{ord(c):02X}" for c in url) if url else f"urn:page:{page_id}"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A trained dictionary; of too few or too uniform records one of their raw bytes, of none none."""
    if not any(samples):
        return None
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples)
    except zstandard.ZstdError:
        raw = b"".join(samples)[-DICT_BYTES:]
        return zstandard.ZstdCompressionDict(raw) if len(raw) >= 8 else None


class Writer:
    """Writes one archive file; the first records wait until the dictionary is built of them."""

    def __init__(self, files: fs.FileSystem, path: str):
        self.files, self.path = files, path
        self.waiting: list[bytes] = []
        self.held = self.size = self.records = 0
        self.out = self.zip = None

    def add(self, rec: bytes) -> None:
        self.records += 1
        if self.zip:
            self._put(rec)
            return
        self.waiting.append(rec)
        self.held += len(rec)
        if self.held >= SAMPLE_BYTES:
            self._begin()

    def _put(self, rec: bytes) -> None:
        frame = self.zip.compress(rec)
        self.out.write(frame)
        self.size += len(frame)

    def _begin(self) -> None:
        # compression=None: by its name the file would be compressed once more as a whole.
        self.out = self.files.open_output_stream(self.path, compression=None)
        trained = build_dictionary(self.waiting)
        if trained:
            raw = trained.as_bytes()
            self.out.write(struct.pack("<II", DICT_MAGIC, len(raw)) + raw)
            self.size += 8 + len(raw)
            trained.precompute_compress(level=LEVEL)
        self.zip = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained)
        for r in self.waiting:
            self._put(r)
        self.waiting = []

    def close(self) -> None:
        if not self.zip:
            self._begin()
        self.out.close()


def read_records(stream) -> Iterator[bytes]:
    """The records of an archive, one at a time; ``stream`` has read(n)."""
    head = stream.read(8)
    words, buf = None, head
    if len(head) == 8:
        magic, size = struct.unpack("<II", head)
        if magic == DICT_MAGIC:
            words, buf = zstandard.ZstdCompressionDict(stream.read(size)), b""
    unzip = zstandard.ZstdDecompressor(dict_data=words) if words else zstandard.ZstdDecompressor()
    frame, parts = unzip.decompressobj(), []
    while True:
        if not buf:
            buf = stream.read(1 << 18)
            if not buf:
                if parts:
                    raise ValueError("an archive ends inside a record")
                return
        parts.append(frame.decompress(buf))
        buf = frame.unused_data if frame.eof else b""
        if frame.eof:
            yield b"".join(parts)
            frame, parts = unzip.decompressobj(), []


def parse(rec: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of a record."""
    top, _, rest = rec.partition(b"\r\n\r\n")
    lines = top.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def _row(rec: bytes, archive: str) -> tuple:
    f, block = parse(rec)
    said = f["warc-payload-digest"].removeprefix("sha1:")
    size = int(f["x-payload-length"])
    if f["warc-type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != said:
            raise ValueError(f"{archive}: the payload of page {f.get('x-page-id')} does not match its digest")
    num = lambda k: int(f[k]) if k in f else None
    return num("x-page-id"), size, said, f["warc-type"], num("x-refers-to-page-id"), f["warc-target-uri"], archive


def write_archives(pages: DataFrame, folder: str, dedup_min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) under ``folder``; returns the staged manifest.

    Payloads of fewer than ``dedup_min_bytes`` bytes are all responses.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", html.alias("payload"), F.sha1(html).alias("sha1"), F.xxhash64(html).alias("h"))
    # Combined before the shuffle, and staged: its measured size decides whether the
    # payloads must be shuffled to meet it.  Without copies they stay where they are read.
    again = staged(
        keyed.filter(F.octet_length("payload") >= dedup_min_bytes)
        .groupBy("sha1", "h").agg(F.max("page_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1").drop("n"),
        "warc-copies",
    )
    rows = keyed.join(again, ["sha1", "h"], "left").select("page_id", "url", "payload", F.unhex("sha1").alias("sha1"), "keep_id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(folder)
        made, w = [], None
        attempt = uuid.uuid4().hex
        for batch in batches:
            for page_id, url, payload, sha1, keep_id in zip(*(batch.column(i) for i in range(5))):
                if w is None:
                    files.create_dir(base, recursive=True)
                    w = Writer(files, f"{base}/{attempt}-{len(made):05d}.warc.zst")
                i, k = page_id.as_py(), keep_id.as_py()
                w.add(record(i, url.as_py(), payload.as_buffer().to_pybytes(), sha1.as_py(), k, k is not None and i != k))
                if w.size >= ARCHIVE_BYTES:
                    w.close()
                    made.append(w)
                    w = None
        if w:
            w.close()
            made.append(w)
        names = [f"{folder}/{x.path.rpartition('/')[2]}" for x in made]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([x.records for x in made], pa.int64()), pa.array([x.size for x in made], pa.int64())], ["path", "records", "bytes"])

    return staged(rows.mapInArrow(write, MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """A row for each record of the archives that ``manifest`` names."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, at = fs.FileSystem.from_uri(path)
                rows = []
                with files.open_input_stream(at, compression=None) as stream:
                    for rec in read_records(stream):
                        rows.append(_row(rec, path))
                        if len(rows) == 5000:
                            yield _batch(rows)
                            rows = []
                yield _batch(rows)

    return manifest.select("path").repartition(max(1, manifest.count())).mapInArrow(read, ROWS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    cols = list(zip(*rows)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], [x.split()[0] for x in ROWS.split(", ")])


def round_trip(pages: DataFrame, dedup_min_bytes: int = 0) -> DataFrame:
    """Archive ``pages`` in the shared folder and read the archives back."""
    folder = new_folder(pages.sparkSession, "warc")
    return read_archives(write_archives(pages.select("page_id", "url", "html"), folder, dedup_min_bytes))
