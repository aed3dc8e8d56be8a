"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word there is one token that its encoding ends with. It is found among the vocabulary entries that
end there (an automaton over the vocabulary with suffix links reports them all): the entry whose start is a prefix
again, and whose pair with that prefix's own last token the merges leave alone. Following the stored tokens back from
the end of the word gives exactly the ids that merging in rank order gives, in time linear in the word.

Two tokens are compatible when no merge crosses their border. While both sides are being merged, the symbol left of
the border climbs the right edge of the left token's merge tree and the symbol right of it climbs the left edge of the
right token's. A pair of such symbols merges across only if its rank comes before the merge that would take away
the left symbol (a tie goes to the left one) and not after the one that would take away the right symbol.

White space never enters a token of this vocabulary, so a text is cut at blanks and each piece is encoded once and
remembered, in a store of bounded size. Memory does not grow with the text.

Defined cases: a null or empty text has no ids and decodes to the empty text; repeated rows and null ids give a row
each; an empty table gives an empty result; texts are encoded whole; extra columns are ignored by :func:`digests` and kept by :func:`encoded`.
"""

from __future__ import annotations

import hashlib
import json
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from lexmill.llm.common import free

REMEMBERED = 200_000  # pieces, and words, in each of the two generations of the stores
END = "</w>"
MARK = "\0"  # stands for END inside the automaton; no byte-level character equals it
NEVER = 1 << 40
SLICE = 1 << 22  # bytes of text that a task encodes before it hands them on
PAIRS = 1_000_000  # pairs of tokens remembered
PUNCTUATION = (".", ",", ";", ":", "!", "?")


class Codec:
    """One vocabulary file: its normaliser, its word pattern, and an exact encoder of words."""

    def __init__(self, path: str):
        lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        self.rank = {pair: r for r, pair in enumerate(merges)}
        self.parts: dict[str, tuple[int, str, str]] = {}
        for r, (left, right) in enumerate(merges):
            self.parts.setdefault(left + right, (r, left, right))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in (self.ids | self.special).items()}
        self.normalise = lib.normalizer.normalize_str if lib.normalizer else str
        self.split = lib.pre_tokenizer.pre_tokenize_str
        self.plain = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.byte_level = {i: lib.pre_tokenizer.pre_tokenize_str(chr(i))[0][0] for i in range(33, 127)}
        for i in range(0xC0, 0x250):  # the bytes of two-byte letters, as the file's own splitter writes them
            for byte, char in zip(chr(i).encode(), "".join(w for w, _ in self.split(chr(i)))):
                self.byte_level[byte] = char
        self.edges: tuple[dict, dict] = ({}, {})
        self.matcher = ahocorasick.Automaton()
        for s in self.ids:
            if self._whole(s):
                key = s.removesuffix(END) + MARK if s.endswith(END) and s != END else s
                self.matcher.add_word(key, (len(key), s))
        self.matcher.make_automaton()
        self.after: dict[str, dict[str, bool]] = defaultdict(dict)
        self.n_known = 0
        self.known: dict[str, tuple] = {}
        self.before: dict[str, tuple] = {}
        self.young: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    def _whole(self, s: str) -> bool:
        """Whether merging the text of an entry gives the entry: its two parts merge last, and are whole themselves."""
        return s not in self.parts or self.border_holds(self.parts[s][1], self.parts[s][2], own=s)

    def _edge(self, token: str, side: int) -> list[tuple[str, int]]:
        """Symbols on one edge of a token's merge tree, each with the rank of the merge that takes it away."""
        out = self.edges[side - 1].get(token)
        if out is None:
            out, gone, symbol = [], NEVER, token
            while True:
                out.append((symbol, gone))
                if symbol not in self.parts:
                    break
                gone, symbol = self.parts[symbol][0], self.parts[symbol][side]
            self.edges[side - 1][token] = out
        return out

    def border_holds(self, left: str, right: str, own: str | None = None) -> bool:
        rank, others = self.rank.get, self._edge(right, 1)
        for a, a_gone in self._edge(left, 2):
            for b, b_gone in others:
                r = rank((a, b))
                if r is not None and r < a_gone and r <= b_gone and not (own is not None and a == left and b == right):
                    return False
        return True

    def compatible(self, left: str, right: str) -> bool:
        """Whether the border holds; remembered below the left token."""
        known = self.after[left][right] = self.border_holds(left, right)
        self.n_known += 1
        if self.n_known > PAIRS:
            self.n_known = 0
            for pairs in self.after.values():
                pairs.clear()
        return known

    def word(self, word: str) -> list[str]:
        """Tokens of one word given in byte-level characters."""
        marked = word + MARK
        n = len(marked)
        last: list[str | None] = [None] * (n + 1)
        pairs: list[dict[str, bool] | None] = [None] * (n + 1)
        for end, (size, token) in self.matcher.iter(marked):
            end += 1
            if last[end] is None:
                if size < end:
                    after = pairs[end - size]
                    if after is None:
                        continue
                    fits = after.get(token)
                    if fits is None:
                        fits = self.compatible(last[end - size], token)
                    if not fits:
                        continue
                last[end], pairs[end] = token, self.after[token]
        out, at = [], n
        while at:
            token = last[at]
            if token is None:
                raise ValueError(f"no encoding of {word!r}")
            out.append(token)
            at -= len(token) - len(END) + 1 if token.endswith(END) and at == n else len(token)
        return out[::-1]

    def _words(self, text: str) -> list[str]:
        """Words in byte-level characters. Latin letters below U+0250 need no composing and lower-case one by one."""
        if text.isascii():
            if text.isalpha():
                return [text.lower()]
            if text[-1:] in PUNCTUATION and text[:-1].isalpha():
                return [text[:-1].lower(), text[-1]]
        if _LATIN.fullmatch(text):
            return [w.encode().decode("latin-1").translate(self.byte_level) for w in self.plain.findall(text.lower())]
        return [w for w, _ in self.split(self.normalise(text))]

    def _normal(self, text: str) -> list[str]:
        return [t for w in self._words(text) for t in self.word(w)]

    def _remembered(self, word: str) -> tuple[int, str, str]:
        got = self.known.get(word)
        if got is None:
            got = self.before.get(word)
            if got is None:
                ids = [self.ids[t] for t in self.word(word)]
                got = (len(ids), " ".join(map(str, ids)), self.decode(ids))
            if len(self.known) >= REMEMBERED:
                self.before, self.known = self.known, {}
            if len(word) <= 64:
                self.known[word] = got
        return got

    def tokens(self, text: str) -> list[str]:
        """Tokens of a text; strings of special tokens are those tokens."""
        out, at = [], 0
        places = {s: text.find(s) for s in self.special}
        while found := [(p, -len(s), s) for s, p in places.items() if p >= 0]:
            p, _, s = min(found)
            if p > at:
                out += self._normal(text[at:p])
            out.append(s)
            at = p + len(s)
            for other, q in places.items():
                if 0 <= q < at:
                    places[other] = text.find(other, at)
        return out + self._normal(text[at:]) if at < len(text) else out

    def piece(self, text: str) -> tuple[int, str, str]:
        """Of a piece without blanks: number of ids, ids joined by one space, decoded text."""
        if not text:
            return (0, "", "")
        got = self.young.get(text)
        if got is None:
            got = self.old.get(text)
            if got is None:
                if any(s in text for s in self.special):
                    ids = [self.special[t] if t in self.special else self.ids[t] for t in self.tokens(text)]
                    got = (len(ids), " ".join(map(str, ids)), self.decode(ids))
                else:
                    got = _joined([self._remembered(w) for w in self._words(text)])
            if len(self.young) >= REMEMBERED:
                self.old, self.young = self.young, {}
            if len(text) <= 64:
                self.young[text] = got
        return got

    def forget(self) -> None:
        """Drops the older generations: a worker that waits for its next task holds the younger ones only."""
        self.before, self.old = {}, {}

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder: tokens joined by one space, as they stand in the vocabulary."""
        return " ".join([self.strings[i] for i in ids])

    def encode(self, text: str | None) -> tuple[int, str, str]:
        """Of a whole text: number of ids, ids joined by one space, decoded text."""
        pieces = (text or "").split(" ")
        young = self.young
        for p in set(pieces).difference(young):
            self.piece(p)
        if self.young is not young:  # the store has turned over meanwhile
            got = [self.piece(p) for p in pieces if p]
        else:
            got = [young[p] if p in young else self.piece(p) for p in pieces if p]
        got = [g for g in got if g[0]]
        return _joined(got)


_LATIN = regex.compile("[!-~\u00c0-\u024f]+")


def _joined(got: list[tuple[int, str, str]]) -> tuple[int, str, str]:
    if len(got) == 1:
        return got[0]
    return sum([g[0] for g in got]), " ".join([g[1] for g in got]), " ".join([g[2] for g in got])


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


RESULT = T.StructType([
    T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
])


def _digest(s: str) -> str:
    return hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: number of ids and the digests of the ids and of the text decoded from them."""

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for texts in batches:
            rows = [(n, _digest(ids), _digest(text)) for n, ids, text in map(c.encode, texts)]
            yield pd.DataFrame(rows, columns=RESULT.names)

    return docs.select(F.col(id_col).alias("doc_id"), run(F.col(text_col)).alias("_r")).select("doc_id", "_r.*")


def encoded(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """The table with ``ids`` and the text ``decoded`` from them; a table with columns of these names gets ``ids_`` or ``decoded_``.

    Batches go through in slices of bounded text, and ids as 32-bit arrays, so a task's memory follows neither the batch nor the table.
    """
    ids_name, decoded_name = free(docs, "ids", "decoded")
    at = docs.columns.index(text_col)
    kind = T.StructType([*docs.schema.fields, T.StructField(ids_name, T.ArrayType(T.IntegerType())), T.StructField(decoded_name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            piece = (np.cumsum(sizes) - sizes) // SLICE
            for part in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(piece)) + 1):
                if not len(part):
                    continue
                rows = batch.slice(int(part[0]), len(part))
                ids, ends, texts = [], [0], []
                for text in rows.column(at).to_pylist():
                    n, joined, decoded = c.encode(text)
                    ids.append(np.fromstring(joined, np.int32, sep=" "))
                    ends.append(ends[-1] + n)
                    texts.append(decoded)
                arrays = [*rows.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids), pa.int32())), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=kind.names)
        c.forget()

    return docs.mapInArrow(run, kind)
