"""Fill-in-middle transformation over seekable compressed frames.

A text is kept as independent Zstandard frames with a seek table: bytes, code points and units up to each frame's end, and
whether a letter comes right before it. Units are ``[A-Za-z]+|[^A-Za-z]``. A cut after ``u`` units is found by a binary search over the cumulative
units; only the frame that holds it is decompressed. The output is written as frames of its own, from the frames of the text in the order
that the form asks for, and the text is rebuilt from the output's frames alone: its three marks are found in a scan, then its ranges are read
in the text's order. Digests follow the frames as they stream by, so a task holds one row's frames and one open frame.

The numbers that choose cuts and form come from the hex SHA-256 of ``1:`` and the decimal id. A mark never arises at a seam of a part
and a mark, since no mark can begin inside another or end in the text after it; texts with marks of their own stay plain.

Defined cases: a null or empty text is empty, plain, and 0 units long; a null id counts as an empty one; repeated rows give a row each;
an empty table gives an empty result; texts of any length go through in frames; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import written

FRAME = 1 << 16  # bytes of a frame before compression
LEVEL = 3
PIECE = 1 << 23  # bytes of rows that a task hands on at once
MARKS = ("<P>", "<S>", "<M>")  # prefix, suffix, middle
PLAIN_FROM, SPM_BELOW = 90, 20  # of 100
FRAMES = "array<struct<bytes:bigint,chars:bigint,units:bigint,after_letter:boolean,data:binary>>"
_FRAMES = pa.list_(pa.struct([("bytes", pa.int64()), ("chars", pa.int64()), ("units", pa.int64()), ("after_letter", pa.bool_()), ("data", pa.binary())]))
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _leads(raw: np.ndarray) -> np.ndarray:
    """Which bytes begin a code point."""
    return (raw & 0xC0) != 0x80


def _unit_starts(raw: np.ndarray, after_letter: bool) -> np.ndarray:
    letter = _LETTER[raw]
    before = np.empty_like(letter)
    before[0], before[1:] = after_letter, letter[:-1]
    return np.where(letter, ~before, _leads(raw))


class Writer:
    """Frames under construction, from pieces of any size."""

    def __init__(self, packer: zstandard.ZstdCompressor):
        self.packer, self.frames, self.held, self.size = packer, [], [], 0
        self.bytes = self.chars = self.units = 0
        self.after_letter = False

    def add(self, piece: bytes) -> None:
        if piece:
            self.held.append(piece)
            self.size += len(piece)
            if self.size >= FRAME:
                self._cut(False)

    def _cut(self, last: bool) -> None:
        data, at = b"".join(self.held), 0
        while len(data) - at >= FRAME or (last and at < len(data)):
            stop = min(len(data), at + FRAME)
            for _ in range(3):  # a frame ends where a code point does
                if stop < len(data) and stop > at + 1 and data[stop] & 0xC0 == 0x80:
                    stop -= 1
            self._frame(data[at:stop])
            at = stop
        self.held, self.size = ([data[at:]], len(data) - at) if at < len(data) else ([], 0)

    def _frame(self, data: bytes) -> None:
        raw = np.frombuffer(data, np.uint8)
        self.bytes += len(raw)
        self.chars += int(_leads(raw).sum())
        self.units += int(_unit_starts(raw, self.after_letter).sum())
        self.frames.append({"bytes": self.bytes, "chars": self.chars, "units": self.units, "after_letter": self.after_letter, "data": self.packer.compress(data)})
        self.after_letter = bool(_LETTER[raw[-1]])

    def close(self) -> list[dict]:
        self._cut(True)
        return self.frames


class Reader:
    """Frames with their seek table; keeps the frame last opened."""

    def __init__(self, frames: list[dict], opener: zstandard.ZstdDecompressor):
        self.frames, self.opener, self.at, self.open = frames, opener, -1, b""
        self.ends = [f["bytes"] for f in frames]
        self.unit_ends = [f["units"] for f in frames]
        self.bytes, self.units, self.chars = (frames[-1][k] if frames else 0 for k in ("bytes", "units", "chars"))

    def frame(self, i: int) -> bytes:
        if i != self.at:
            self.at, self.open = i, self.opener.decompress(self.frames[i]["data"])
        return self.open

    def cut(self, units: int) -> tuple[int, int]:
        """Bytes and code points of the first ``units`` units; opens the one frame that holds the cut."""
        if units >= self.units:
            return self.bytes, self.chars
        i = bisect_right(self.unit_ends, units)
        before = self.frames[i - 1] if i else {"bytes": 0, "chars": 0, "units": 0}
        raw = np.frombuffer(self.frame(i), np.uint8)
        at = int(np.flatnonzero(_unit_starts(raw, self.frames[i]["after_letter"]))[units - before["units"]])
        return before["bytes"] + at, before["chars"] + int(_leads(raw[:at]).sum())

    def stream(self, start: int, stop: int) -> Iterator[bytes]:
        """The bytes from ``start`` to ``stop``, frame by frame."""
        i = bisect_right(self.ends, start)
        while start < stop:
            base = self.ends[i - 1] if i else 0
            yield self.frame(i)[start - base : stop - base]
            start, i = self.ends[i], i + 1

    def places(self, marks: tuple[bytes, ...]) -> Iterator[int]:
        """Where marks stand, ascending; those across two frames too."""
        most, tail = max(map(len, marks)), b""
        for i in range(len(self.frames)):
            seen = tail + self.frame(i)
            base = self.ends[i] - len(seen)
            found = set()
            for m in marks:
                at = seen.find(m)
                while at >= 0:
                    if at + len(m) > len(tail):  # else told before
                        found.add(base + at)
                    at = seen.find(m, at + 1)
            yield from sorted(found)
            tail = seen[len(seen) - most + 1 :] if len(seen) >= most else seen


def numbers(doc_id: object) -> list[int]:
    text = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(text[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(reader: Reader, doc_id: object, packer: zstandard.ZstdCompressor, marks: tuple[bytes, ...]) -> tuple[str, int | None, int | None, list[dict], str]:
    """Form, code points of prefix and middle, the output's frames and its digest."""
    h, n = numbers(doc_id), reader.units
    out, digest = Writer(packer), hashlib.sha256()

    def put(piece: bytes) -> None:
        digest.update(piece)
        out.add(piece)

    def put_range(start: int, stop: int) -> None:
        for piece in reader.stream(start, stop):
            put(piece)

    if n == 0 or h[2] % 100 >= PLAIN_FROM or next(reader.places(marks), None) is not None:
        put_range(0, reader.bytes)
        return "plain", None, None, out.close(), digest.hexdigest()
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    (a, a_chars), (b, b_chars) = reader.cut(first), reader.cut(second)
    form = "spm" if h[3] % 100 < SPM_BELOW else "psm"
    prefix, suffix, middle = ((marks[0], 0, a), (marks[1], b, reader.bytes), (marks[2], a, b))
    for mark, start, stop in (suffix, prefix, middle) if form == "spm" else (prefix, suffix, middle):
        put(mark)
        put_range(start, stop)
    return form, a_chars, b_chars - a_chars, out.close(), digest.hexdigest()


def restore(reader: Reader, form: str, marks: tuple[bytes, ...]) -> Iterator[bytes]:
    """The text again, from the output's frames and its form."""
    if form == "plain":
        yield from reader.stream(0, reader.bytes)
        return
    at = list(reader.places(marks))
    if len(at) != 3:
        raise ValueError("an output holds each mark once")
    ends = [*at[1:], reader.bytes]
    one, two, middle = ((start + len(marks[0]), stop) for start, stop in zip(at, ends))
    prefix, suffix = (two, one) if form == "spm" else (one, two)
    for start, stop in (prefix, middle, suffix):
        yield from reader.stream(start, stop)


def _pieces(rows: Iterator[tuple[tuple, int]], kind: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of bounded size."""
    held, size = [], 0
    for row, weight in rows:
        held.append(row)
        size += weight
        if size >= PIECE:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), kind.types)], schema=kind)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), kind.types)], schema=kind)


def _packed(frames: list[dict]) -> int:
    return sum(len(f["data"]) for f in frames) + 64


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the text as ``frames``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=LEVEL)

        def rows() -> Iterator[tuple[tuple, int]]:
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    out = Writer(packer)
                    data = memoryview(text.as_buffer()) if text.is_valid else b""
                    for at in range(0, len(data), FRAME):
                        out.add(bytes(data[at : at + FRAME]))
                    frames = out.close()
                    yield (doc_id, frames), _packed(frames)

        yield from _pieces(rows(), pa.schema([("doc_id", pa.int64()), ("frames", _FRAMES)]))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id bigint, frames {FRAMES}")


def transformed(stored: DataFrame, marks: tuple[str, ...] = MARKS) -> DataFrame:
    """Stored texts in their forms: ``doc_id``, ``n``, ``form``, ``prefix_chars``, ``middle_chars``, ``frames`` of the output, ``output_sha256``."""
    return _worked(stored, marks, False)


def _worked(stored: DataFrame, marks: tuple[str, ...], check: bool) -> DataFrame:
    marked = tuple(m.encode() for m in marks)
    last = ("restored_sha256", pa.string()) if check else ("frames", _FRAMES)
    kind = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output_sha256", pa.string()), last])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, opener = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()

        def rows() -> Iterator[tuple[tuple, int]]:
            for batch in batches:
                for doc_id, frames in zip(batch.column(0).to_pylist(), batch.column(1)):
                    text = Reader(frames.as_py(), opener)
                    form, prefix, middle, out, digest = transform(text, doc_id, packer, marked)
                    row = (doc_id, text.units, form, prefix, middle, digest)
                    if check:
                        again = hashlib.sha256()
                        for piece in restore(Reader(out, opener), form, marked):
                            again.update(piece)
                        yield (*row, again.hexdigest()), 256
                    else:
                        yield (*row, out), _packed(out)

        yield from _pieces(rows(), kind)

    ends = "restored_sha256 string" if check else f"frames {FRAMES}"
    return stored.select("doc_id", "frames").mapInArrow(run, f"doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, {ends}")


def texts(framed: DataFrame, restored: bool = False, marks: tuple[str, ...] = MARKS) -> DataFrame:
    """``doc_id`` and ``text`` of frames as they stand, or, of transformed ones, the text rebuilt from output and ``form``."""
    marked = tuple(m.encode() for m in marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()

        def rows() -> Iterator[tuple[tuple, int]]:
            for batch in batches:
                for doc_id, form, frames in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    reader = Reader(frames.as_py(), opener)
                    data = b"".join(restore(reader, form, marked))
                    yield (doc_id, data.decode("utf-8")), len(data)

        yield from _pieces(rows(), pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))

    form = F.col("form") if restored else F.lit("plain")
    return framed.select("doc_id", form.alias("form"), "frames").mapInArrow(run, "doc_id bigint, text string")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", marks: tuple[str, ...] = MARKS) -> DataFrame:
    """The frames of all texts, transformed: see :func:`transformed`."""
    return transformed(written(store(docs, id_col, text_col), "fim-frames"), marks)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", marks: tuple[str, ...] = MARKS) -> DataFrame:
    """One row per document: units, form, lengths, and the digests of the output and of the text rebuilt from it."""
    return _worked(written(store(docs, id_col, text_col), "fim-frames"), marks, True)
