"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each a group of whole WARC records, ended by a skippable frame that holds the
seek table: compressed and decompressed size of every frame, their number, and the format's magic number. Any
Zstandard tool can read it from start to end. Writing returns an index (record id, bundle, frame offset, offset
in the frame), with which one record is read by opening its frame alone. A record larger than ``FRAME_BYTES`` is a frame of its own.

Of the records with equal payloads of at least ``min_bytes``, that with the largest page id is the response and the
others are revisits that name its target. Payloads are compared by digest and length, in an aggregation of small
rows; only responses carry their payload to the writer. Each task writes one bundle after another in the shared folder,
frame by frame, with one frame and its seek table in memory.

Defined cases: a null payload is empty, and so stored like an empty one; a null page id is smaller than any other and its record
refers or is referred to as null; rows that are equal in id and payload are all responses if their id is the largest of
the group, else all revisits; an empty table writes no bundle; long payloads are stored whole; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import SharedFile, filesystem, written
from lexmill.session import scratch

# Fixed values of the seekable format.
SKIPPABLE, SEEKABLE, DESCRIPTOR = 0x184D2A5E, 0x8F92EAB1, 0
BUNDLE_BYTES = 256 << 20
FRAME_BYTES = 1 << 18  # of records in a frame, before compression
MIN_BYTES = 0
READERS = 2_000  # tasks that read bundles, if there are so many
DATE = "2000-01-01T00:00:00Z"  # the tables hold no time of capture
INDEX = "record_id string, bundle string, frame_offset bigint, frame_bytes bigint, record_offset bigint, record_bytes bigint"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(row, name: str) -> bytes:
    """Bytes of one WARC/1.1 record with the identifier ``name``."""
    page = None if pd.isna(row.page_id) else int(row.page_id)
    keeper = None if pd.isna(row.keeper) else int(row.keeper)
    response = row.record_type == "response"
    body = (row.payload or "").encode("utf-8", "surrogatepass") if response else b""
    head = [
        "WARC/1.1", f"WARC-Type: {row.record_type}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: urn:page:{'' if page is None else page}", f"WARC-Payload-Digest: sha1:{row.payload_digest}",
        f"WARC-Payload-Length: {row.payload_bytes}",
    ]
    if not response:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To-Target-URI: urn:page:{'' if keeper is None else keeper}", f"WARC-Refers-To-Date: {DATE}",
        ]
    head += ["Content-Type: text/html" if response else "Content-Type: application/octet-stream", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes, start: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Header fields and block of the record that begins at ``start``, and where it ends."""
    body = data.index(b"\r\n\r\n", start) + 4
    version, *lines = data[start : body - 4].decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    end = body + int(fields["Content-Length"])
    if version != "WARC/1.1" or data[end : end + 4] != b"\r\n\r\n":
        raise ValueError(f"broken record {fields.get('WARC-Record-ID')}")
    return fields, data[body:end], end + 4


class Bundle:
    """A seekable file under construction."""

    def __init__(self, folder: str, name: str, frame_bytes: int = FRAME_BYTES):
        self.name, self.file, self.frames, self.frame_bytes = name, SharedFile(folder, name), [], frame_bytes
        self.zip = zstandard.ZstdCompressor(level=3)
        self.held: list[bytes] = []
        self.size = self.count = 0
        self.waiting: list[tuple[str, int, int]] = []  # records of the open frame: name, offset in it, bytes
        self.index: list[tuple] = []

    def next_name(self) -> str:
        """An identifier that no other record has, equal pages included."""
        self.count += 1
        return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{self.name}/{self.count}')}"

    def add(self, name: str, data: bytes) -> None:
        if self.held and self.size + len(data) > self.frame_bytes:
            self._frame()
        self.waiting.append((name, self.size, len(data)))
        self.held.append(data)
        self.size += len(data)

    def _frame(self) -> None:
        frame = self.zip.compress(b"".join(self.held))
        self.frames.append((len(frame), self.size))
        offset = self.file.write(frame)
        self.index += [(name, self.name, offset, len(frame), at, size) for name, at, size in self.waiting]
        self.held, self.size, self.waiting = [], 0, []

    def close(self) -> None:
        if self.held:
            self._frame()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), DESCRIPTOR, SEEKABLE)
        self.file.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.file.close()


def seek_table(source) -> list[tuple[int, int, int]]:
    """(offset, compressed size, decompressed size) of every frame of an open bundle."""
    end = source.size()
    source.seek(end - 9)
    n, descriptor, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE or descriptor != DESCRIPTOR:
        raise ValueError("no seek table at the end")
    source.seek(end - 9 - 8 * n - 8)
    kind, size = struct.unpack("<II", source.read(8))
    if kind != SKIPPABLE or size != 8 * n + 9:
        raise ValueError("broken seek table")
    out, at = [], 0
    for packed, plain in struct.iter_unpack("<II", source.read(8 * n)):
        out.append((at, packed, plain))
        at += packed
    return out


def read_record(folder: str, bundle: str, frame_offset: int, frame_bytes: int, record_offset: int, record_bytes: int) -> bytes:
    """One record, by the place that the index gives."""
    fs, root = filesystem(folder)
    with fs.open_input_file(f"{root}/{bundle}") as f:
        f.seek(frame_offset)
        return zstandard.ZstdDecompressor().decompress(f.read(frame_bytes))[record_offset : record_offset + record_bytes]


def _writer(folder: str, bundle_bytes: int, frame_bytes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bundle = None

        def finish():
            bundle.close()
            return pd.DataFrame(bundle.index, columns=["record_id", "bundle", "frame_offset", "frame_bytes", "record_offset", "record_bytes"])

        for batch in batches:
            for row in batch.itertuples(index=False):
                if bundle is None:
                    bundle = Bundle(folder, f"{uuid.uuid4().hex}.warc.zst", frame_bytes)
                name = bundle.next_name()
                bundle.add(name, record(row, name))
                if bundle.file.at >= bundle_bytes:
                    yield finish()
                    bundle = None
        if bundle is not None:
            yield finish()

    return run


def _reader(folder: str):
    def page(uri: str | None):
        return None if not uri or uri == "urn:page:" else int(uri.removeprefix("urn:page:"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = filesystem(folder)
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            for name in batch["bundle"]:
                with fs.open_input_file(f"{root}/{name}") as f:
                    out = []
                    for offset, packed, plain in seek_table(f):
                        f.seek(offset)
                        data, at = unzip.decompress(f.read(packed), max_output_size=plain), 0
                        while at < len(data):
                            fields, block, at = parse(data, at)
                            kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                            size = int(fields["WARC-Payload-Length"])
                            if kind == "response" and (len(block) != size or digest_of(block) != digest):
                                raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
                            refers = page(fields.get("WARC-Refers-To-Target-URI"))
                            out.append((page(fields["WARC-Target-URI"]), size, digest, kind, refers, name, offset))
                        if len(out) >= 10_000:
                            yield _rows(out)
                            out = []
                    yield _rows(out)

    return run


def _rows(out: list[tuple]) -> pd.DataFrame:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "bundle", "frame_offset"]
    columns = dict(zip(names, zip(*out))) if out else {n: [] for n in names}
    return pd.DataFrame({n: pd.array(c, "Int64") if n in ("page_id", "refers_to") else list(c) for n, c in columns.items()})


READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, bundle string, frame_offset bigint"


def base32(hexed):
    """Upper-case base32 of a 40-digit hexadecimal column: five bits at a time, twenty to a step."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    parts = []
    for i in range(0, 40, 5):
        number = F.conv(F.substring(hexed, i + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(letters), F.shiftright(number, 15 - 5 * j).bitwiseAND(31) + 1, F.lit(1)) for j in range(4)]
    return F.concat(*parts)


def plan_records(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """A row per record to write; only responses have a payload."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.sha1(F.col("payload").cast("binary"))).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    light = rows.select("page_id", "sha", "payload_bytes")
    light = written(light, "warc-digests")
    shared = light.where(F.col("payload_bytes") >= min_bytes).groupBy("sha", "payload_bytes").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("copies"))
    shared = written(shared.where(F.col("copies") > 1).drop("copies"), "warc-shared")
    grouped = light.join(shared, ["sha", "payload_bytes"])
    revisits = grouped.where(~F.col("page_id").eqNullSafe(F.col("keeper"))).select("page_id", "sha", "payload_bytes", "keeper")
    # this join's key holds the page id, so that no key is hot where payloads move
    gone = revisits.select("page_id", "sha", "payload_bytes").distinct()
    on = ["sha", "payload_bytes"]
    left, right = rows.alias("r"), gone.alias("g")
    same = [F.col(f"r.{c}") == F.col(f"g.{c}") for c in on] + [F.col("r.page_id").eqNullSafe(F.col("g.page_id"))]
    responses = left.join(right, same, "left_anti")
    cols = ["page_id", "payload_bytes", base32(F.col("sha")).alias("payload_digest")]
    return responses.select(*cols, F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("keeper"), "payload").unionByName(
        revisits.select(*cols, F.lit("revisit").alias("record_type"), "keeper", F.lit(None).cast("string").alias("payload"))
    )


def write(pages: DataFrame, folder: str, id_col: str = "page_id", payload_col: str = "html", min_bytes: int = MIN_BYTES,
          bundle_bytes: int = BUNDLE_BYTES, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Write the archives and return the index: record id, bundle, the frame's offset and size, and the record's inside it."""
    records = plan_records(pages, id_col, payload_col, min_bytes)
    records = records.withColumns({c: F.col(c).cast("string") for c in ("page_id", "keeper")})  # whole numbers beyond 2^53 survive beside nulls
    return written(records.mapInPandas(_writer(folder, bundle_bytes, frame_bytes), INDEX), "warc-index")


def read(index: DataFrame, folder: str) -> DataFrame:
    """Every record of the bundles that the index names, a task per bundle."""
    bundles = index.select("bundle").distinct()
    tasks = max(1, min(bundles.count(), READERS))  # the few names would else be merged into one task
    return bundles.repartition(tasks).mapInPandas(_reader(folder), READ)


def round_trip(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    folder = scratch(pages.sparkSession, "warc")
    return read(write(pages, folder, id_col, payload_col, min_bytes), folder)
