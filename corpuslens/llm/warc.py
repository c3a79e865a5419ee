"""WARC archives as seekable Zstandard bundles.

Each task writes the records of its pages to bundle files in the folder that all
executors share.  Records are grouped into frames that can be decompressed on their own.
Behind the frames stand two skippable frames, so that any zstd tool still reads the file:
a map from record identifiers to (frame, offset in the frame, length), and the footer of
the public seekable format, a table of the frames' sizes.  A reader takes the footer from
the end of the file and then only the frames it needs.

Files carry a name of their own for each attempt and count only if the stored index, which
Spark commits once per task, lists them: a lost or repeated task leaves nothing wrong.
Frames and bundles are bounded in bytes, except that one record is never cut.

Pages with equal payloads of some length are stored once: the others become ``revisit``
records that refer to it.  Rows: a null html is an empty payload, a null url an empty
address; rows that share the smallest id of their payload are all responses; ids compare
with null as none; an empty table writes no bundle.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow.fs as fs
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import stored
from corpuslens.session import scratch_path

# Fixed values of the WARC 1.1 and zstd seekable formats.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAP_MAGIC, TABLE_MAGIC, FOOTER_MAGIC = 0x184D2A51, 0x184D2A5E, 0x8F92EAB1

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 64 << 20
MIN_SHARED = 100
DATE = "1970-01-01T00:00:00Z"  # the pages carry no date; a fixed one keeps archives reproducible

INDEX = "page_id long, path string, frame int, offset long, length long"
RECORD = "page_id long, record_type string, refers_to long, target_uri string, declared_digest string, declared_bytes long, payload binary"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else int(page_id)}>"


def page_of(identifier: str | None) -> int | None:
    name = (identifier or "").strip("<>").removeprefix("urn:page:")
    return int(name) if name and name != "none" else None


def record_bytes(page_id, url, payload: bytes, digest: str, size: int, refers_to) -> bytes:
    """One WARC record; a revisit (`refers_to` given) has the headers of its payload only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head[2:2] = [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes, start: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and body of the record at `start`, and where the next one begins."""
    end = data.index(b"\r\n\r\n", start)
    headers = dict(line.split(": ", 1) for line in data[start:end].decode().split("\r\n")[1:])
    body = data[end + 4 : end + 4 + int(headers["Content-Length"])]
    return headers, body, end + 4 + len(body) + 4


def row_of(headers: dict[str, str], body: bytes) -> tuple:
    http, _, payload = body.partition(b"\r\n\r\n")
    size = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    response = headers["WARC-Type"] == "response"
    return (
        page_of(headers["WARC-Record-ID"]),
        headers["WARC-Type"],
        page_of(headers.get("WARC-Refers-To")),
        headers["WARC-Target-URI"],
        headers["WARC-Payload-Digest"].removeprefix("sha256:"),
        size,
        payload if response else None,
    )


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and plain path of a Spark path (``file:/x`` has one slash there)."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


class Bundle:
    """A bundle being written: records in, frames out, footer at the end."""

    def __init__(self, folder: str, frame_bytes: int):
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        store, plain = filesystem(self.path)
        store.create_dir(plain.rpartition("/")[0], recursive=True)
        self.out = store.open_output_stream(plain, compression=None)  # else the ending makes it compress again
        self.frame_bytes, self.buffer, self.table, self.index, self.size = frame_bytes, io.BytesIO(), [], [], 0

    def add(self, page_id, record: bytes) -> None:
        self.index.append((page_id, self.path, len(self.table), self.buffer.tell(), len(record)))
        self.buffer.write(record)
        self.size += len(record)
        if self.buffer.tell() >= self.frame_bytes:
            self.end_frame()

    def end_frame(self) -> None:
        if self.buffer.tell():
            frame = zstandard.ZstdCompressor(level=3).compress(self.buffer.getvalue())
            self.out.write(frame)
            self.table.append((len(frame), self.buffer.tell()))
            self.buffer = io.BytesIO()

    def close(self) -> list[tuple]:
        self.end_frame()
        named = [[record_id(p), frame, offset, length] for p, _, frame, offset, length in self.index]
        content = zstandard.ZstdCompressor(level=3).compress(json.dumps(named).encode())
        self.out.write(struct.pack("<II", MAP_MAGIC, len(content)) + content)
        self.table.append((len(content) + 8, 0))
        entries = b"".join(struct.pack("<II", *x) for x in self.table)
        footer = struct.pack("<IBI", len(self.table), 0, FOOTER_MAGIC)
        self.out.write(struct.pack("<II", TABLE_MAGIC, len(entries) + len(footer)) + entries + footer)
        self.out.close()
        return self.index


class Reader:
    """Random access to the frames of one bundle."""

    def __init__(self, path: str):
        store, plain = filesystem(path)
        self.file = store.open_input_file(plain)
        size = self.file.size()
        count, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != FOOTER_MAGIC:
            raise ValueError(f"{path} has no seek table")
        entries = self.file.read_at(8 * count, size - 9 - 8 * count)
        self.frames, at = [], 0
        for i in range(count):
            packed, plain_size = struct.unpack_from("<II", entries, 8 * i)
            self.frames.append((at, packed, plain_size))
            at += packed

    def frame(self, i: int) -> bytes:
        at, packed, size = self.frames[i]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=size)

    def record_map(self) -> list[list]:
        """[record identifier, frame, offset in the frame, length] of every record."""
        at, packed, _ = self.frames[-1]
        content = self.file.read_at(packed - 8, at + 8)
        return json.loads(zstandard.ZstdDecompressor().decompress(content))

    def records(self) -> Iterator[tuple]:
        for i, (_, _, size) in enumerate(self.frames):
            if not size:
                continue
            data, at = self.frame(i), 0
            while at < len(data):
                headers, body, at = parse_record(data, at)
                yield row_of(headers, body)


def payload_columns(html: Column) -> list[Column]:
    payload = F.encode(F.coalesce(html, F.lit("")), "UTF-8")
    return [payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("size")]


def with_references(pages: DataFrame, min_shared: int = MIN_SHARED) -> DataFrame:
    """page_id, url, payload, digest, size, and the page a revisit refers to.

    Only payloads that occur more than once are joined back.  A hot payload is counted
    before it is shuffled; the join is broadcast when that table is small and otherwise
    one that adaptive execution splits.
    """
    rows = pages.select("page_id", "url", *payload_columns(F.col("html")))
    shared = (
        rows.where(F.col("size") >= min_shared)
        .groupBy("digest")
        .agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
        .where("_n > 1")
        .select("digest", "_first")
    )
    joined = rows.join(stored(shared, "warc-shared"), "digest", "left")
    again = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return joined.select("page_id", "url", "payload", "digest", "size", F.when(again, F.col("_first")).alias("refers_to"))


def write_bundles(
    pages: DataFrame, folder: str | None = None, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES
) -> DataFrame:
    """Archives `pages` (page_id, url, html) below `folder` and returns the stored index:
    page_id, path, frame, offset in the frame, length."""
    folder = folder or scratch_path(pages.sparkSession, "warc")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bundle = None
        for batch in batches:
            for page_id, url, payload, digest, size, refers_to in batch.itertuples(index=False):
                page_id, refers_to = (None if pd.isna(x) else int(x) for x in (page_id, refers_to))
                bundle = bundle or Bundle(folder, frame_bytes)
                bundle.add(page_id, record_bytes(page_id, url, bytes(payload), digest, size, refers_to))
                if bundle.size >= bundle_bytes:
                    yield frame_of(bundle.close(), INDEX)
                    bundle = None
        if bundle:
            yield frame_of(bundle.close(), INDEX)

    # Ids travel as text: pandas would turn a column with nulls into floating point.
    rows = with_references(pages).select(
        F.col("page_id").cast("string"), "url", "payload", "digest", "size", F.col("refers_to").cast("string")
    )
    return stored(rows.mapInPandas(write, INDEX), "warc-index")


def frame_of(rows: list[tuple], schema: str) -> pd.DataFrame:
    kinds = [x.split() for x in schema.split(", ")]
    columns = {name: [r[i] for r in rows] for i, (name, _) in enumerate(kinds)}
    return pd.DataFrame({name: pd.Series(columns[name], dtype="Int64" if kind in ("long", "int") else object) for name, kind in kinds})


def read_bundles(index: DataFrame) -> DataFrame:
    """Every record of the bundles that the index names, read from the files."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                held, size = [], 0
                for row in Reader(path).records():
                    held.append(row)
                    size += len(row[-1] or b"")
                    if size >= FRAME_BYTES * 16:
                        yield frame_of(held, RECORD)
                        held, size = [], 0
                if held:
                    yield frame_of(held, RECORD)

    paths = index.select("path").distinct()
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return paths.repartition(parts, "path").mapInPandas(read, RECORD)


def fetch(index: DataFrame, ids: DataFrame) -> DataFrame:
    """The records of the pages in `ids` (page_id); only their frames are read."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, frames in batch.groupby("path"):
                reader = Reader(path)
                for frame, places in frames.groupby("frame"):
                    data = reader.frame(int(frame))
                    rows = [row_of(*parse_record(data, int(at))[:2]) for at in places["offset"]]
                    yield frame_of(rows, RECORD)

    wanted = index.join(ids.select("page_id").distinct(), "page_id", "left_semi")
    return wanted.repartition(F.col("path")).sortWithinPartitions("path", "frame").mapInPandas(read, RECORD)


def archived(pages: DataFrame) -> DataFrame:
    """Writes the pages, reads the archives back, and describes every record.

    Size and digest of a response are computed from the payload that was read; a revisit
    has no payload, so they are what its headers declare.
    """
    records = read_bundles(write_bundles(pages))
    response = F.col("record_type") == "response"
    return records.select(
        "page_id",
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("declared_bytes")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.col("declared_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
