"""N-grams of many texts at once, grouped in numpy over packed code points."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from loamdex import schema as S

BLANKS = np.array([9, 10, 11, 12, 13, 32], np.uint32)
#: Stands for the third character of a term of two; no text has it.
NO_CHAR = 0x1FFFFF
#: Most texts, and most characters but for a single longer text, that are grouped together.
BLOCK, BLOCK_CHARS = 2048, 1 << 20


class Grouped(NamedTuple):
    """Terms in the order of their codes, then texts, then positions.

    code, first_of_term: of each term, the latter pointing into owner; owner, tf, first: of each pair of term and text, the
    last pointing into place; place: of each n-gram.
    """

    code: np.ndarray
    first_of_term: np.ndarray
    owner: np.ndarray
    tf: np.ndarray
    first: np.ndarray
    place: np.ndarray


def starts(*keys: np.ndarray) -> np.ndarray:
    """Where any of the keys differs from the row before."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def grouped(texts: list[str], only: np.ndarray | None = None) -> Grouped:
    """The n-grams of folded texts, those of ASCII blanks alone left out; with ``only`` (codes) no others."""
    lengths = np.array([len(t) for t in texts], np.int64)
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    within = (np.arange(len(chars)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
    blank = np.isin(chars, BLANKS)
    owners, codes, places = [], [], []
    for n in range(S.NGRAM_LOW, S.NGRAM_HIGH + 1):
        m = max(len(chars) - n + 1, 0)
        code, bare = np.zeros(m, np.int64), np.ones(m, bool)
        for i in range(S.NGRAM_HIGH):
            code = code << 21 | (chars[i : i + m] if i < n else NO_CHAR)
            if i < n:
                bare &= blank[i : i + m]
        whole = (owner[:m] == owner[n - 1 : n - 1 + m]) & ~bare
        if only is not None:
            whole &= np.isin(code, only)
        owners.append(owner[:m][whole])
        codes.append(code[whole])
        places.append(within[:m][whole])
    own, code, place = (np.concatenate(x) for x in (owners, codes, places))
    order = np.argsort(code, kind="stable")  # a code is of one length, so its texts and places are in order already
    own, code, place = own[order], code[order], place[order]
    first = starts(code, own)
    tf = np.diff(np.append(first, len(code)))
    at = starts(code[first])
    return Grouped(code[first][at], at, own[first], tf, first, place)


def term_text(code: int) -> str:
    return "".join(chr(c) for c in (code >> 42, code >> 21 & NO_CHAR, code & NO_CHAR) if c != NO_CHAR)


def term_code(term: str) -> int:
    a, b, c = [*map(ord, term), NO_CHAR][:3]
    return a << 42 | b << 21 | c


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """(numbers, ids, texts) of up to BLOCK neighbouring rows of three such columns; the numbers of a block rise and span less than 2^15."""
    for b in batches:
        numbers, ids = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        sizes = np.cumsum(np.append(0, pc.fill_null(pc.utf8_length(b.column(2)), 0).to_numpy(zero_copy_only=False)))
        at = 0
        while at < b.num_rows:
            end = min(at + BLOCK, b.num_rows)
            far = np.flatnonzero((np.diff(numbers[at:end]) <= 0) | (numbers[at + 1 : end] - numbers[at] >= 1 << 15))
            end = min(end, at + 1 + int(far[0])) if len(far) else end
            end = max(at + 1, min(end, int(np.searchsorted(sizes, sizes[at] + BLOCK_CHARS, "right")) - 1))
            yield numbers[at:end], ids[at:end], b.column(2).slice(at, end - at).to_pylist()
            at = end
