"""SimHash near-duplicates found by multi-index hashing.

A fingerprint has a bit set where over half of the XXH64 values of the document's word shingles have it.
Documents with equal fingerprints fold into one row first. Two distinct fingerprints within 3 bits differ
in at most one bit in one of their two 32-bit halves, so each probes, in a table keyed by (half, value),
the half itself and its one-bit neighbours: of two halves one bit apart, one has a 0 there, so setting
one 0 bit of either is enough and each pair meets once. Matches are verified by the whole distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loamdex.llm.common import first_of_each, text_hash
from loamdex.operators.components import connected_components
from loamdex.session import stored

BITS, HALF = 64, 32
#: A fingerprint is hot if it has more than 1 / HOT_SHARE of all rows.
HOT_SHARE = 1000


def shingles(text: bytes, words: int, seed: int = 42) -> list[int]:
    """XXH64 values of the word shingles of UTF-8 text in order; none without a word, one of a text of at most ``words``."""
    import xxhash

    parts = text.lower().split()  # of bytes: A-Z alone, and exactly \\x20 and \\x09-\\x0D
    if not parts:
        return []
    h = xxhash.xxh64_intdigest
    joined = b" ".join(parts)
    if len(parts) <= words:
        return [h(joined, seed)]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends = np.cumsum(sizes)
    starts, stops = (ends - sizes)[: len(parts) - words + 1].tolist(), (ends - 1)[words - 1 :].tolist()
    return [h(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)]


def fold_bits(values: list[int]) -> int:
    """The signed 64-bit fingerprint of shingle values: a bit is set where over half of them have it."""
    if not values:
        return 0
    count = np.zeros(BITS, np.int64)
    for at in range(0, len(values), 1 << 14):  # a block at a time: bounded memory for any text
        block = np.array(values[at : at + (1 << 14)], "<u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(values), bitorder="little").view("<i8")[0])


def fingerprint(text: bytes, words: int, seed: int = 42) -> int:
    """The signed 64-bit fingerprint of UTF-8 text; zero without a word."""
    return fold_bits(shingles(text, words, seed))


def fingerprints(docs: DataFrame, words: int = 5, seed: int = 42, hashed: bool = False) -> DataFrame:
    """doc_id, fp (long) of every row, and _th (hash of the text) if ``hashed``; null text is empty, a null id stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint((t.as_py() or "").encode(), words, seed) for t in b.column(1)]
            more = b.columns[2:]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), *more], names=["doc_id", "fp", "_th"][: 2 + len(more)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([text_hash().alias("_th")] if hashed else []))
    return rows.mapInArrow(run, "doc_id long, fp long" + (", _th long" if hashed else ""))


def _halves() -> Column:
    return F.array(F.shiftrightunsigned("fp", HALF), F.col("fp").bitwiseAND(F.lit((1 << HALF) - 1)))


def probes(marked: DataFrame, *keep: str) -> DataFrame:
    """keep, part, own, value: the entries of multi-index tables that each row's fingerprint (column fp) looks up.

    Two fingerprints within 3 bits meet: the half (``own``) of one is a value of the other, or they have a half in common.
    """
    table = marked.select(*keep, F.posexplode(_halves()).alias("part", "own"))
    ball = "transform(sequence(0, 31), i -> if((own & shiftleft(1L, i)) = 0, own | shiftleft(1L, i), null))"
    return table.select(*keep, "part", "own", F.explode(F.expr(f"filter(concat(array(own), {ball}), x -> x is not null)")).alias("value"))


def links(distinct: DataFrame, most: int = 3) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints (column fp) within ``most`` (0 to 3) differing bits, a < b, each once or twice."""
    table = distinct.select("fp", F.posexplode(_halves()).alias("part", "value"))
    return (
        probes(distinct, "fp").withColumnRenamed("fp", "a").join(table, ["part", "value"])
        .where((F.col("own") != F.col("value")) | (F.col("a") < F.col("fp")))
        .where((F.col("a") != F.col("fp")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= most))
        .select(F.least("a", "fp").alias("a"), F.greatest("a", "fp").alias("b"))
    )


def _linked(distinct: DataFrame, most: int) -> DataFrame:
    """fp, component of the distinct fingerprints that have a link."""
    pairs = stored(links(distinct.select("fp"), most).distinct(), "simhash-links")
    return connected_components(pairs, "a", "b").withColumnRenamed("node", "fp")


def classes(marked: DataFrame, most: int = 3) -> DataFrame:
    """marked (doc_id, fp and more) with component_id: the smallest doc_id reachable over links of fingerprints within ``most`` bits."""
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-distinct")
    # fingerprints without a link are their own component: the rounds below see linked ones alone
    linked = _linked(distinct, most)
    reach = linked.join(distinct, "fp").groupBy("component").agg(F.min("least").alias("component_id"))
    to = linked.join(reach, "component").select("fp", "component_id")
    known = stored(distinct.join(to, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id")), "simhash-known")
    # a fingerprint with over a HOT_SHARE-th of all rows is broadcast: there are fewer than HOT_SHARE of them whatever the
    # input; all others are joined by a shuffle in which no key has more rows than that
    whole = known.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(known.where(F.col("n") * HOT_SHARE > whole).drop("n"))
    rest = marked.join(hot, "fp", "left_anti").join(known.where(F.col("n") * HOT_SHARE <= whole).drop("n"), "fp")
    return marked.join(hot, "fp").unionByName(rest).select(*marked.columns, "component_id")


def near_duplicates(docs: DataFrame, words: int = 5, most: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp, component_id of every row: the smallest doc_id that can be reached over links.

    Texts without a word have fingerprint zero and link like any other. Null ids stay in the result and
    take the component of their fingerprint; a group of null ids alone has a null component. Repeated rows
    are repeated. An empty table gives no rows.
    """
    return classes(stored(fingerprints(docs, words, seed), "simhash"), most)


def one_of_each(docs: DataFrame, words: int = 5, most: int = 3, seed: int = 42) -> DataFrame:
    """The documents without near-duplicates: of each component the row with the smallest doc_id stays.

    Of rows that repeat a doc_id and text one stays; where texts of a component share its smallest doc_id, that of
    the smallest text hash. Rows with a null id cannot be told apart and all stay.
    """
    marked = stored(fingerprints(docs, words, seed, hashed=True), "simhash")
    nodes = stored(marked.groupBy("fp").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "_th"))).alias("least")), "simhash-distinct")
    return first_of_each(docs, marked, nodes.join(_linked(nodes, most), "fp", "left").select(F.coalesce("component", "fp").alias("root"), "least"))
