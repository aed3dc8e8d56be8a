"""Token ids in binary shards, compressed by Re-Pair grammars.

Documents are dealt to shards by range of id and lie there in ascending order. A shard is a file of blocks, each a
stretch of the shard's ids; a document may go on in the next block. In a block, frequent pairs of neighbouring symbols are replaced
by nonterminals, again and again, until no pair stands ``LEAST`` times; where two pairs share a symbol the more frequent one goes first. The end
id never enters a pair, so documents begin and end at symbols. Rules are stored with their expansion lengths:
summing lengths finds the symbols that hold any range of ids, and only those are expanded.

File, little-endian: blocks, then the table of blocks (offset, ids, symbols, rules, bytes per symbol), then the table of
documents (has id, id, number of ids), then counts of both tables and the magic number. A block: rules as pairs of 32-bit symbols,
32-bit expansion lengths, symbols. The first nonterminal's number is in the footer.

A text is cut before blanks that stand alone between other characters, where the tokeniser's pattern cuts too; pieces and words seen
before come from a bounded store, the library encodes the others.

Defined cases: a null or empty text has the end id alone; null ids come first; repeated ids lie in the order of
their texts; an empty table writes no shard; texts are encoded whole; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexmill.llm.common import SharedFile, filesystem, written
from lexmill.session import scratch

END_ID = 2
BLOCK_IDS = 1 << 20
LEAST = 8  # a pair that is replaced stands so often at least: a rule takes 12 bytes, a symbol 2 or 4
SYMBOL_BITS, PLACE_BITS = 21, 21  # two symbols and a place are sorted as one number
MAGIC = b"RPTK0001"
BLOCK_ROW, DOC_ROW, FOOTER = struct.Struct("<qqqqi"), struct.Struct("<?qq"), struct.Struct("<qqi8s")
REMEMBERED = 400_000  # pieces, and words, in each of the two generations of the stores
PUNCTUATION = (".", ",", ";", ":", "!", "?")
READERS = 2_000  # tasks that read shards, if there are so many
# Fixed value: the pattern that cuts words in this family of vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself where it prints, the next free ones from U+0100 for the others."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(others)}


class Unparted(Exception):
    """A piece with a blank of another kind at its edge: the tokeniser's pattern does not cut before it."""


class Pieces(dict):
    """Ids of pieces, each without the blank before it; one that is not here is encoded and kept."""

    def __init__(self, code: Encoder):
        super().__init__()
        self.code = code

    def __missing__(self, piece: str) -> bytes:
        code = self.code
        got = code.old.get(piece)
        if got is None:
            if piece.isalpha():
                got = code.letters(code.blank + piece if piece.isascii() else code.written(" " + piece))
            elif piece[-1:] in PUNCTUATION and piece[:-1].isalpha():
                got = self[piece[:-1]] + code.word(piece[-1])
            elif not piece or piece[0].isspace() or piece[-1].isspace():
                raise Unparted
            else:
                got = code.first(" " + piece)
        self[piece] = got
        return got


class Encoder:
    """Ids of texts as 32-bit little-endian bytes, with stores of pieces and words that keep two generations."""

    def __init__(self, path: str):
        self.lib = Tokenizer.from_file(path)
        self.words = regex.compile(PATTERN)
        self.model = self.lib.model
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.byte_level = byte_letters()
        self.blank = self.byte_level[32]
        size = max(self.lib.get_vocab(with_added_tokens=True).values(), default=-1) + 1
        self.packed = [struct.pack("<I", i) for i in range(size)]
        self.young, self.old = Pieces(self), {}
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def written(self, word: str) -> str:
        """A word in the letters that stand for its bytes."""
        return word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.byte_level)

    def letters(self, letters: str) -> bytes:
        packed = self.packed
        return b"".join([packed[t.id] for t in self.model.tokenize(letters)])

    def word(self, word: str) -> bytes:
        got = self.known.get(word)
        if got is None:
            got = self.before.get(word)
            if got is None:
                got = self.letters(self.written(word))
            self.known[word] = got
        return got

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        for text in texts:
            if not text:
                yield b""
                continue
            first, *rest = text.split(" ")
            try:
                if rest and first[-1:].isspace():
                    raise Unparted
                yield b"".join([self.first(first), *map(self.young.__getitem__, rest)])
            except Unparted:
                yield self.whole([text])[0]
            if len(self.young) > REMEMBERED:
                self.old, self.young = self.young, Pieces(self)
            if len(self.known) > REMEMBERED:
                self.before, self.known = self.known, {}

    def first(self, piece: str) -> bytes:
        for s in self.special:
            if s in piece:
                return self.whole([piece])[0]
        return b"".join([self.word(w) for w in self.words.findall(piece)])


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def re_pair(ids: np.ndarray, end_id: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Rules (pairs of symbols) and the symbols they leave of the ids; rule r stands for symbol ``first + r``.

    A round sorts the places of the pairs that may still be frequent, gives every pair its rank by occurrences that do not overlap,
    and replaces a pair wherever it outranks the pairs that share a symbol with it; a rule is made if this happens ``LEAST`` times.
    Pairs of old symbols only get rarer, so places of a rare pair leave for good and new ones arise beside replaced places alone.
    The most frequent pair wins everywhere, so every round makes a rule, until no pair stands ``LEAST`` times.
    """
    if len(ids) > 1 << PLACE_BITS or first + len(ids) // LEAST > 1 << SYMBOL_BITS:
        raise ValueError("block or vocabulary too large")
    symbols, rules, made = ids.astype(np.uint32), [], 0
    open_ = (symbols[:-1] != end_id) & (symbols[1:] != end_id)
    while True:
        at = np.flatnonzero(open_)
        if len(at) < LEAST:
            break
        keyed = symbols[at].astype(np.uint64) << np.uint64(SYMBOL_BITS) | symbols[at + 1]
        keyed = np.sort(keyed << np.uint64(PLACE_BITS) | at.astype(np.uint64))
        # a pair one place after the same pair overlaps it, as in aaaa: every other one of such a run is passed over
        chain = np.flatnonzero(keyed[1:] - keyed[:-1] == 1) + 1
        begin = np.flatnonzero(np.diff(chain, prepend=-1) != 1)
        passed = chain[(np.arange(len(chain)) - np.repeat(begin, np.diff(begin, append=len(chain)))) % 2 == 0]
        pair, place = keyed >> np.uint64(PLACE_BITS), (keyed & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int32)
        edge = np.empty(len(pair), bool)
        edge[0] = True
        np.not_equal(pair[1:], pair[:-1], out=edge[1:])
        head = np.flatnonzero(edge)
        size = np.diff(head, append=len(pair)).astype(np.int32)
        n = size - np.bincount(np.searchsorted(head, passed, "right") - 1, minlength=len(head)).astype(np.int32)
        often = n >= LEAST
        if not often.any():
            break
        rank = np.zeros(len(head), np.int32)
        some = np.flatnonzero(often)
        rank[some[np.argsort(n[some], kind="stable")]] = np.arange(1, len(some) + 1)
        ranked = np.repeat(rank, size)
        open_[place[ranked == 0]] = False
        ranked[passed] = 0
        here = np.zeros(len(symbols) + 1, np.int32)  # rank of the pair that begins one place before
        here[place + 1] = ranked
        won = ((here[1:-1] > here[:-2]) & (here[1:-1] > here[2:]))[place]
        won[passed] = False
        uses = np.add.reduceat(won, head, dtype=np.int32)
        ruled = uses >= LEAST
        won &= np.repeat(ruled, size)
        left = place[won]
        new = np.repeat(np.arange(ruled.sum(), dtype=np.uint32) + np.uint32(first + made), uses[ruled])
        found = pair[head[ruled]]
        rules.append(np.column_stack([found >> np.uint64(SYMBOL_BITS), found & np.uint64((1 << SYMBOL_BITS) - 1)]).astype(np.uint32))
        made += len(found)
        symbols[left] = new
        stays = np.ones(len(symbols), bool)
        stays[left + 1] = False
        # pairs to both sides of a new symbol are new
        open_ = np.append(open_, False)
        open_[left] = True
        open_[left[left > 0] - 1] = True
        before = left - 2  # the symbol before may be a new one whose second half goes
        open_[before[before >= 0]] |= ~stays[left[before >= 0] - 1]
        symbols, open_ = symbols[stays], open_[stays][:-1]
        open_ &= (symbols[:-1] != end_id) & (symbols[1:] != end_id)
    return np.concatenate(rules) if rules else np.empty((0, 2), np.uint32), symbols


def lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Expansion length of each rule; a rule's parts come before it."""
    out = np.ones(len(rules), np.int64)
    for r, (a, b) in enumerate(rules.tolist()):
        out[r] = (out[a - first] if a >= first else 1) + (out[b - first] if b >= first else 1)
    return out


def expand(symbols: np.ndarray, rules: np.ndarray, sizes: np.ndarray, first: int) -> np.ndarray:
    """The ids that symbols stand for; every node of their trees is visited once, whatever the depth."""
    def size(of: np.ndarray) -> np.ndarray:
        out = np.ones(len(of), np.int64)
        inner = of >= first
        out[inner] = sizes[of[inner] - first]
        return out

    ends = np.cumsum(size(symbols))
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
    at = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    while len(symbols):
        inner = symbols >= first
        out[at[~inner]] = symbols[~inner]
        rule, at = rules[symbols[inner] - first], at[inner]
        symbols = rule.ravel()
        at = np.column_stack([at, at + size(rule[:, 0])]).ravel()
    return out


class Shard:
    """A file under construction."""

    def __init__(self, folder: str, name: str, end_id: int, first: int):
        self.file, self.end_id, self.first = SharedFile(folder, name), end_id, first
        self.held, self.size, self.blocks, self.docs = [], 0, [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(DOC_ROW.pack(doc_id is not None, doc_id or 0, len(ids) // 4))
        self.held.append(ids)
        self.size += len(ids)
        while self.size >= 4 * BLOCK_IDS:
            data = b"".join(self.held)
            self._block(np.frombuffer(data[: 4 * BLOCK_IDS], "<u4"))
            self.held = [data[4 * BLOCK_IDS :]]
            self.size = len(self.held[0])

    def _block(self, ids: np.ndarray) -> None:
        rules, symbols = re_pair(ids, self.end_id, self.first)
        width = 2 if self.first + len(rules) <= 1 << 16 else 4
        at = self.file.write(rules.astype("<u4").tobytes() + lengths(rules, self.first).astype("<u4").tobytes() + symbols.astype(f"<u{width}").tobytes())
        self.blocks.append(BLOCK_ROW.pack(at, len(ids), len(symbols), len(rules), width))

    def close(self) -> None:
        if self.size:
            self._block(np.frombuffer(b"".join(self.held), "<u4"))
        self.file.write(b"".join(self.blocks) + b"".join(self.docs) + FOOTER.pack(len(self.blocks), len(self.docs), self.first, MAGIC))
        self.file.close()


class Reader:
    """An open shard: its tables, whole blocks, and any range of ids."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - FOOTER.size)
        n_blocks, n_docs, self.first, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        source.seek(size - FOOTER.size - n_blocks * BLOCK_ROW.size - n_docs * DOC_ROW.size)
        self.blocks = list(BLOCK_ROW.iter_unpack(source.read(n_blocks * BLOCK_ROW.size)))
        self.docs = source.read(n_docs * DOC_ROW.size)
        self.starts = np.cumsum([0, *[b[1] for b in self.blocks]])

    def documents(self) -> Iterator[tuple[int | None, int]]:
        for has_id, doc_id, n in DOC_ROW.iter_unpack(self.docs):
            yield doc_id if has_id else None, n

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, _, n_symbols, n_rules, width = self.blocks[i]
        self.source.seek(at)
        data = self.source.read(12 * n_rules + n_symbols * width)
        rules = np.frombuffer(data, "<u4", 2 * n_rules).reshape(-1, 2)
        return rules, np.frombuffer(data, "<u4", n_rules, 8 * n_rules), np.frombuffer(data, f"<u{width}", n_symbols, 12 * n_rules).astype(np.uint32)

    def ids(self, start: int, n: int) -> np.ndarray:
        """Ids ``start`` to ``start + n`` of the shard; only symbols that reach into the range are expanded."""
        out, stop = [np.empty(0, np.uint32)], start + n
        i = int(np.searchsorted(self.starts, start, "right")) - 1
        while start < stop and i < len(self.blocks):
            rules, sizes, symbols = self.block(i)
            size = np.ones(len(symbols), np.int64)
            inner = symbols >= self.first
            size[inner] = sizes[symbols[inner] - self.first]
            ends = np.cumsum(size)
            here, upto = start - self.starts[i], min(stop, self.starts[i + 1]) - self.starts[i]
            a, b = int(np.searchsorted(ends, here, "right")), int(np.searchsorted(ends, upto, "left")) + 1
            before = int(ends[a - 1]) if a else 0
            out.append(expand(symbols[a:b], rules, sizes, self.first)[here - before : upto - before])
            start, i = int(self.starts[i + 1]), i + 1
        return np.concatenate(out)


def _writer(folder: str, path: str, end_id: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, code, end = None, encoder(path), np.array([end_id], "<u4").tobytes()
        place = TaskContext.get().partitionId()
        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"].tolist(), code.encode(batch["text"].tolist())):
                if shard is None:
                    shard = Shard(folder, f"{place:06d}.ids", end_id, max(code.lib.get_vocab_size(), end_id + 1))
                    total = 0
                shard.add(None if pd.isna(doc_id) else int(doc_id), ids + end)
                total += len(ids) // 4 + 1
        if shard is not None:
            shard.close()
            yield pd.DataFrame({"shard": [place], "ids": [total], "bytes": [shard.file.at]})

    return run


def write(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards and return a row for each: its number, ids, bytes, and the ids of all shards before it."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    dealt = dealt.withColumn("doc_id", F.col("doc_id").cast("string"))  # whole numbers beyond 2^53 survive beside nulls
    shards = written(dealt.mapInPandas(_writer(folder, path, end_id), "shard int, ids bigint, bytes bigint"), "token-shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    return shards.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def _reader(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = filesystem(folder)
        for batch in batches:
            for shard, start in zip(batch["shard"], batch["start"]):
                with fs.open_input_file(f"{root}/{shard:06d}.ids") as f:
                    reader, out, at = Reader(f), [], 0
                    held, i = b"", -1
                    base = 0  # ids of the shard before what is held
                    for doc_id, n in reader.documents():
                        parts, crc, left = n, 0, n
                        while left:
                            if at >= base + len(held) // 4:
                                base += len(held) // 4
                                i += 1
                                rules, sizes, symbols = reader.block(i)
                                held = expand(symbols, rules, sizes, reader.first).astype("<u4").tobytes()
                            part = held[4 * (at - base) : 4 * (at - base + left)]
                            crc = zlib.crc32(part, crc)
                            at += len(part) // 4
                            left -= len(part) // 4
                        out.append((doc_id, start + at - n, parts, crc))
                        if len(out) == 20_000:
                            yield _frame(out)
                            out = []
                    yield _frame(out)

    return run


def _frame(rows: list[tuple]) -> pd.DataFrame:
    ids, start, n, crc = zip(*rows) if rows else ([], [], [], [])
    return pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "start": list(start), "n_tokens": list(n), "ids_crc32": list(crc)})


def read(shards: DataFrame, folder: str) -> DataFrame:
    """A row per document of the shards, in whose order ``start`` counts."""
    tasks = max(1, min(shards.count(), READERS))  # the shards' few rows would else be merged into one task
    return shards.select("shard", "start").repartition(tasks, "shard").mapInPandas(_reader(folder), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    folder = scratch(docs.sparkSession, "tokens")
    return read(write(docs, folder, path, end_id, id_col, text_col), folder)
