"""Line dedup: lines found in many documents go, by arrays under a sharded minimal perfect hash.

Lines are never joined. Their keys are counted once, as pairs of 64-bit hashes; the keys that reach the index's
floor are dealt into shards, and a task turns a shard into a minimal perfect hash over its first hashes, an array of
fingerprints (the second hashes) and an array of document counts. Documents then probe those arrays, which a worker
reads from the shared folder and keeps while they fit: a key that the index lacks meets a strange fingerprint.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loamdex.llm.warc import open_fs
from loamdex.session import discard, scratch_path, stored

#: Keys a shard: about 12.5 MB of arrays.
SHARD_KEYS = 1 << 20
#: Bytes of shards that a worker keeps; beyond that the one used longest ago goes.
HELD_BYTES = 256 << 20
#: Bits a key in each level of the hash.
SPREAD = 2
#: The most that a count can hold.
MOST_COUNT = (1 << 32) - 1
INDEX = "shard int, n long, sizes array<bigint>, words binary, prints binary, counts binary"
BLANKS = "\t\n\x0b\x0c\r "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    """The lines between line feeds; a null or empty text is one empty line."""
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    """The line without ASCII blanks at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def first_hash(key: Column) -> Column:
    return F.xxhash64(key)


def second_hash(key: Column) -> Column:
    """Of another seed: the fingerprint."""
    return F.xxhash64(F.lit("fingerprint"), key)


def mixed(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    """Unsigned hashes of pairs of hashes, other ones at every level."""
    x = h1 + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
    x ^= (x >> np.uint64(31)) ^ h2
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(16)


class PerfectHash:
    """A minimal perfect hash over distinct pairs of hashes.

    A level is a bit array, SPREAD bits a key. Keys alone at their place set its bit; the others go on to the next
    level. A key's number is the count of bits set before its own.
    """

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def of(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        sizes, levels = [], []
        while len(h1):
            m = 64 * -(-SPREAD * len(h1) // 64)
            at = (mixed(h1, h2, len(sizes)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            sizes.append(m)
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            rest = ~alone[at]
            h1, h2 = h1[rest], h2[rest]
        return cls(np.array(sizes, np.int64), np.concatenate(levels) if levels else np.empty(0, np.uint64))

    def numbers(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Each pair's number: 0 to n - 1 for the pairs it was made of, any of them or -1 for others."""
        out = np.full(len(h1), -1, np.int64)
        left = np.arange(len(h1))
        for level, m in enumerate(self.sizes):
            at = self.starts[level] + (mixed(h1[left], h2[left], level) % np.uint64(m)).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            low = word & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[hit]] = (self.before[at >> 6] + np.bitwise_count(low))[hit]
            left = left[~hit]
            if not len(left):
                break
        return out


class Shard:
    """A shard's arrays: perfect hash, fingerprints, document counts."""

    def __init__(self, row: dict):
        self.hash = PerfectHash(np.array(row["sizes"], np.int64), np.frombuffer(row["words"], np.uint64))
        self.prints, self.found = np.frombuffer(row["prints"], np.uint64), np.frombuffer(row["counts"], np.uint32)
        self.bytes = sum(len(row[c]) for c in ("words", "prints", "counts")) + self.hash.before.nbytes

    def counts(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Documents of each key, 0 for keys that the index lacks."""
        n = self.hash.numbers(h1, h2)
        return np.where((n >= 0) & (self.prints[n] == h2), self.found[n], 0)


def make_shard(h1: np.ndarray, h2: np.ndarray, counts: np.ndarray) -> dict:
    h = PerfectHash.of(h1, h2)
    n = h.numbers(h1, h2)
    prints, found = np.empty(len(h1), np.uint64), np.empty(len(h1), np.uint32)
    prints[n], found[n] = h2, np.minimum(counts, MOST_COUNT)
    return {"n": len(h1), "sizes": h.sizes.tolist(), "words": h.words.tobytes(), "prints": prints.tobytes(), "counts": found.tobytes()}


def build_index(docs: DataFrame, text_col: str = "text", floor: int = 1, least_points: int = 1, shard_keys: int = SHARD_KEYS) -> tuple[str, int]:
    """(folder, shards) of the index over the distinct line keys that ``floor`` or more rows of ``docs`` hold.

    Keys of fewer than ``least_points`` code points are not indexed. A row counts once for a key, however often it
    has it. Nothing is collected but the number of keys.
    """
    spark = docs.sparkSession
    keys = F.array_distinct(F.transform(lines_of(F.col(text_col)), key_of))
    each = docs.select(F.explode(keys).alias("key")).where(F.length("key") >= least_points)
    counts = each.select(first_hash(F.col("key")).alias("h1"), second_hash(F.col("key")).alias("h2")).groupBy("h1", "h2").agg(F.count("*").alias("n"))
    counts = stored(counts.where(F.col("n") >= floor), "line-counts")
    shards = -(-counts.count() // shard_keys)
    path = scratch_path(spark, "line-index")

    def make(key, pdf: pd.DataFrame) -> pd.DataFrame:
        unsigned = [pdf[c].to_numpy(np.int64).view(np.uint64) for c in ("h1", "h2")]
        return pd.DataFrame([{"shard": key[0]} | make_shard(*unsigned, pdf["n"].to_numpy())])

    if shards:
        dealt = counts.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int")).repartitionById(shards, F.col("shard"))
        dealt.groupBy("shard").applyInPandas(make, INDEX).write.partitionBy("shard").parquet(path)
    discard(counts)
    return path, shards


_held: OrderedDict[tuple[str, int], Shard] = OrderedDict()


def shard_at(path: str, shard: int) -> Shard:
    """A shard from the shared folder, or from this worker's memory."""
    import pyarrow.dataset as ds

    if (path, shard) not in _held:
        fs, at = open_fs(path)
        _held[path, shard] = Shard(ds.dataset(f"{at}/shard={shard}", filesystem=fs, format="parquet").to_table().to_pylist()[0])
        while len(_held) > 1 and sum(s.bytes for s in _held.values()) > HELD_BYTES:
            _held.popitem(last=False)
    _held.move_to_end((path, shard))
    return _held[path, shard]


def probe(path: str, shards: int):
    """A column function of two arrays, the hashes of a document's keys: the documents that hold each."""

    @F.arrow_udf("array<bigint>")
    def counts(firsts: pa.Array, seconds: pa.Array) -> pa.Array:
        h1, h2 = (a.flatten().to_numpy(zero_copy_only=False) for a in (firsts, seconds))
        out, home = np.zeros(len(h1), np.int64), h1 % shards
        order = np.argsort(home, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(home[order])) + 1) if len(order) else []:
            out[part] = shard_at(path, int(home[part[0]])).counts(h1[part].view(np.uint64), h2[part].view(np.uint64))
        offsets = pa.array(np.concatenate([[0], np.cumsum(firsts.value_lengths().to_numpy(zero_copy_only=False))]), pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(out))

    return counts


def dedup(docs: DataFrame, least: int = 10, least_points: int = 1, text_col: str = "text", shard_keys: int = SHARD_KEYS) -> DataFrame:
    """``row`` (all columns as given) and ``lines`` (n_lines, n_dropped, kept) of each row of ``docs``.

    Lines whose key stands in ``least`` or more rows go, every one of them, in every row; the others stay in order,
    joined by line feeds. Keys of fewer than ``least_points`` code points never go. Null and empty texts are one empty
    line, and keep an empty text. Each row is a document: repeated rows and repeated ids count once each. Other columns
    are untouched, whatever their names. An empty table gives no rows.

    The index holds the keys of ``least`` rows or more, as no other can go. Two keys are taken for one only
    where both 64-bit hashes agree.
    """
    path, shards = build_index(docs, text_col, floor=least, least_points=least_points, shard_keys=shard_keys)
    rows = docs.select(F.struct("*").alias("row"), lines_of(F.col(text_col)).alias("_lines"))
    if shards:
        keys = F.transform("_lines", key_of)
        hashed = rows.withColumns({"_h1": F.transform(keys, first_hash), "_h2": F.transform(keys, second_hash)})
        rows = hashed.withColumn("_counts", probe(path, shards)("_h1", "_h2"))
        kept = F.filter("_lines", lambda _, i: F.get(F.col("_counts"), i) < least)
    else:
        kept = F.col("_lines")
    rows = rows.withColumn("_kept", kept)
    n, stay = F.size("_lines").cast("long"), F.size("_kept").cast("long")
    return rows.select("row", F.struct(n.alias("n_lines"), (n - stay).alias("n_dropped"), F.array_join("_kept", "\n").alias("kept")).alias("lines"))
