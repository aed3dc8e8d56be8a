"""Tokenisation, normalisation and other text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Token classes (Unicode word characters spelled out; Latin/Cyrillic tokens
# that keep dots, underscores and hyphens).
WORD = r"[\p{L}\p{N}_]+"
CODE_TOKEN = r"[a-zA-Zа-яёА-ЯЁ0-9][a-zA-Zа-яёА-ЯЁ0-9._-]*"


def words(text: Column) -> Column:
    """Lower-case Unicode words."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def code_tokens(text: Column) -> Column:
    """Lower-case tokens that keep 10.10.0.53 and billing-api whole."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"({CODE_TOKEN})"), F.lit(1)), F.lower)


def sentences(text: Column) -> Column:
    """Split after . ! ? followed by white space; blanks dropped."""
    flat = F.regexp_replace(text, "\n", " ")
    parts = F.transform(F.split(flat, r"(?<=[.!?])\s+"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: s != "")


def once(df: DataFrame, keep: list[str], **cols: Column) -> DataFrame:
    """Evaluate ``cols`` once per row.

    A plain projection may be folded into every later use of its columns; a generator is
    not, so an expensive array is computed a single time.
    """
    packed = F.struct(*[c.alias(n) for n, c in cols.items()])
    return df.select(*keep, F.inline(F.array(packed)))


def ngrams(tokens: str, n: int) -> Column:
    """All runs of n consecutive elements of an array column, as structs g0..g(n-1)."""
    t = F.col(tokens)
    zipped = F.arrays_zip(t, *[F.slice(t, k + 1, F.size(t)) for k in range(1, n)])
    whole = F.filter(zipped, lambda p: p[str(n - 1)].isNotNull()) if n > 1 else zipped
    names = [tokens, *[str(k) for k in range(1, n)]]
    return F.transform(whole, lambda p: F.struct(*[p[x].alias(f"g{k}") for k, x in enumerate(names)]))


def stems(sentence: Column, length: int = 5, stop: tuple[str, ...] = ()) -> Column:
    """Distinct word beginnings of words longer than two letters, stop words left out."""
    long = F.filter(words(sentence), lambda w: F.length(w) > 2)
    if stop:
        long = F.filter(long, lambda w: ~w.isin(*stop))
    return F.array_distinct(F.transform(long, lambda w: F.substring(w, 1, length)))
