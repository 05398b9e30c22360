"""Harmonic packing of tokenised documents into fixed-capacity sequences.

Each document becomes its token ids plus an end id; one above the capacity C gives full pieces of C and a tail. A piece
of class k (C/(k+1) < length <= C/k) goes to a bin of its class, which holds exactly k of them: a worker packs
independently of all others, without a shuffle and with no state but its open bins. A bin that has its k pieces waits
for fillers of the room that is left: a later document that fits goes in whole, tightest room first. Only when a worker's
rooms add up to ROOMS sequences is a document cut to fill them. What is left open when a partition ends is laid end to
end, cut at C, and its last rest is cut at powers of two, which sequences need no padding for.
"""

from __future__ import annotations

import bisect
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Fixed value: the pre-tokenizer pattern of byte-level BPE tokenizers with "use_regex".
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BIN_BITS = 36
#: Sequences' worth of waiting room from which documents are cut to fill it, and the share of a sequence's room that stays padding.
ROOMS, PADDING = 16, 1 / 256


class ByteLevelEncoder:
    """Ids of a byte-level BPE file as the tokenizers library gives them (add_special_tokens=False).

    The vocabulary's order is its merge order, so the same ids come from the faster tiktoken, built here
    from the same file; its added tokens count as such in a text, as they do in tokenizers. A text that
    tiktoken's pattern engine gives up on goes to tokenizers itself. Files that are not plain byte-level
    BPE go to tokenizers altogether.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path, self.slow, self.fast = path, None, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = model["type"] == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        if plain:
            import tiktoken

            shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
            hidden = [b for b in range(256) if b not in set(shown)]
            byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
            added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
            ranks = {bytes(byte[c] for c in w): i for w, i in model["vocab"].items() if w not in added}
            self.fast = tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=added)

    def __call__(self, text: str) -> list[int]:
        if self.fast:
            try:
                return self.fast.encode(text, allowed_special="all", disallowed_special=())
            except BaseException as e:  # a panic of the pattern engine is no Exception
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError, GeneratorExit)):
                    raise
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return self.slow.encode(text, add_special_tokens=False).ids


class Bins:
    """The open bins of one worker. A piece is (doc_id, start, length, ids, doc_tokens)."""

    def __init__(self, capacity: int, worker: int):
        self.capacity, self.worker, self.made, self.room, self.number = capacity, worker, 0, 0, 0
        self.open: dict[int, list[tuple]] = {}
        self.waiting: list[tuple[int, int, list[tuple]]] = []  # (room, number, pieces) by room

    def close(self, pieces: list[tuple]) -> list[tuple]:
        sequence, at, out = (self.worker << BIN_BITS) + self.made, 0, []
        self.made += 1
        for p in pieces:
            out.append((*p, sequence, at))
            at += p[2]
        return out

    def wait(self, pieces: list[tuple]) -> list[tuple]:
        """Close a bin without room worth filling, or let it wait."""
        room = self.capacity - sum(p[2] for p in pieces)
        if room <= PADDING * self.capacity:
            return self.close(pieces)
        self.number += 1
        bisect.insort(self.waiting, (room, self.number, pieces))
        self.room += room
        return []

    def take(self, at: int) -> tuple[int, list[tuple]]:
        room, _, pieces = self.waiting.pop(at)
        self.room -= room
        return room, pieces

    def document(self, doc_id, ids: bytes, tokens: int) -> list[tuple]:
        out, whole = [], tokens // self.capacity * self.capacity
        for start in range(0, whole, self.capacity):
            out += self.close([(doc_id, start, self.capacity, ids[4 * start : 4 * (start + self.capacity)], tokens)])
        return out + (self.add((doc_id, whole, tokens - whole, ids[4 * whole :], tokens)) if tokens > whole else [])

    def add(self, piece: tuple) -> list[tuple]:
        n = piece[2]
        at = bisect.bisect_left(self.waiting, (n,))
        if at < len(self.waiting):
            return self.wait([*self.take(at)[1], piece])
        if self.room >= ROOMS * self.capacity:
            return self.cut(piece)
        held = self.open.setdefault(self.capacity // n, [])
        held.append(piece)
        return self.wait(self.open.pop(self.capacity // n)) if len(held) == self.capacity // n else []

    def cut(self, piece: tuple) -> list[tuple]:
        """Fill the widest rooms with a document's parts; it is wider than any of them, and all together are wider than it."""
        out, (doc, start, n, ids, tokens) = [], piece
        while n:
            room, pieces = self.take(len(self.waiting) - 1)
            part = min(n, room)
            out += self.wait([*pieces, (doc, start, part, ids[: 4 * part], tokens)])
            start, n, ids = start + part, n - part, ids[4 * part :]
        return out

    def finish(self) -> list[tuple]:
        out, loose = [], sorted((p for k in self.open for p in self.open[k]), key=lambda p: -p[2])
        left = []
        for p in loose:
            at = bisect.bisect_left(self.waiting, (p[2],))
            if at < len(self.waiting):
                out += self.wait([*self.take(at)[1], p])
            else:
                left.append(p)
        left += [p for _, _, pieces in self.waiting for p in pieces]
        total = sum(p[2] for p in left)
        sizes = [self.capacity] * (total // self.capacity)
        sizes += [1 << b for b in reversed(range(self.capacity.bit_length())) if (total % self.capacity) >> b & 1]
        held, room = [], sizes.pop(0) if sizes else 0
        for doc, start, length, ids, tokens in left:
            while length:
                n = min(length, room)
                held.append((doc, start, n, ids[: 4 * n], tokens))
                start, length, ids, room = start + n, length - n, ids[4 * n :], room - n
                if not room:
                    out += self.close(held)
                    held, room = [], sizes.pop(0) if sizes else 0
        return out


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset.

    Null texts count as empty (the end id alone). Very long texts are encoded whole. Repeated rows are documents of their own. Null ids stay
    null. An empty table gives no rows. Sequence ids hold the partition and a counter, so they are unique
    without a shuffle and the same when a task is run again.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, bins = ByteLevelEncoder(tokenizer_path), Bins(capacity, TaskContext.get().partitionId())
        out: list[tuple] = []

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for b in batches:
            for key, text in zip(b.column(0), b.column(1), strict=True):
                ids = [*encode(text.as_py() or ""), end_id]
                out += bins.document(key.as_py(), np.array(ids, "<u4").tobytes(), len(ids))
                if len(out) >= 1000:
                    yield batch(out)
                    out = []
        out += bins.finish()
        if out:
            yield batch(out)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES)
