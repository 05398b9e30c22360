"""Near-duplicates by exact Jaccard similarity of word shingles: SimHash tables and MinHash bands as candidates.

Texts with equal shingle sets fold into one node first. A node's keys are the entries of the SimHash multi-index tables
that its fingerprint looks up, where all within 3 bits of it meet it, and BANDS more, each of ROWS minima of its shingles' XXH64 values under fixed mixings. A pair of
similarity s shares a band with probability 1 - (1 - s^ROWS)^BANDS: at 0.8 all but 3 in a million pairs meet.

Nodes that share a key are compared by their whole sets, but not all with all. First each key's nodes are held against
the one that shares most keys with others, then those outside the key's largest component against changing members of
it, as long as that helps; nodes of one component need no further test. What still stands beside a largest component is
compared with all its members, but those that bitmaps of the sets rule out: a bit that one set has and the other lacks is
a shingle not shared. So no link between components is lost, and a large group of near copies costs a few rows a member
as long as few of them have no link to the rest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loamdex.llm.common import BROADCAST_ROWS, first_of_each, text_hash
from loamdex.llm.simhash import fold_bits, links, probes, shingles
from loamdex.operators.components import connected_components
from loamdex.session import discard, stored

BANDS, ROWS = 32, 5
#: Shingles mixed at a time.
BLOCK = 256
#: Pairs left to test, for each row of a key, up to which they are tested one by one; rounds against one member before
#: that, as long as a round leaves less than HELPS of the pairs before it.
PAIRS_A_ROW, ROUNDS_MOST, HELPS = 4, 6, 0.8
#: Bits of a set's bitmap, in words of 64.
MAP_WORDS = 16
#: Rows of one node that a join keeps in one task.
HOT_ROWS, DEALT_ROWS = 4096, 128


def shingle_set(text: bytes, words: int, seed: int = 42) -> np.ndarray:
    return np.unique(np.array(shingles(text, words, seed), np.uint64))


@lru_cache
def mixings(seed: int) -> tuple[np.ndarray, np.ndarray]:
    flips, odds = np.random.default_rng(seed).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
    return flips, odds | np.uint64(1)


def minima(values: np.ndarray, seed: int = 42) -> np.ndarray:
    """BANDS x ROWS minima of the values under fixed mixings."""
    flips, odds = mixings(seed)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    mixed = np.empty((min(BLOCK, len(values)), BANDS * ROWS), np.uint64)
    for at in range(0, len(values), BLOCK):  # a block at a time, in place: bounded memory for any text, kept in cache
        block = values[at : at + BLOCK, None]
        here = mixed[: len(block)]
        np.multiply(np.bitwise_xor(block, flips, out=here), odds, out=here)
        np.minimum(least, here.min(axis=0), out=least)
    return least.reshape(BANDS, ROWS)


def bitmap(values: np.ndarray) -> np.ndarray:
    """A bit for each remainder that a value of the set has, in MAP_WORDS words."""
    bits = np.zeros(64 * MAP_WORDS, np.uint8)
    bits[(values % np.uint64(64 * MAP_WORDS)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def may_be_alike(a: str, b: str, na: str, nb: str, least: float) -> Column:
    """Whether bitmaps and sizes of two sets leave a similarity of ``least`` possible; never false for sets that have it."""
    only = lambda x, y: reduce(Column.__add__, [F.bit_count(F.get(x, F.lit(w)).bitwiseAND(F.bitwise_not(F.get(y, F.lit(w))))) for w in range(MAP_WORDS)])
    need = F.lit(least) * (F.col(na) + F.col(nb)) / (1 + least) - 1e-6  # the least that two sets of that similarity share
    return (F.col(na) - only(a, b) >= need) & (F.col(nb) - only(b, a) >= need)


def sketches(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """doc_id, _th (hash of the text), node (hash of the shingle set), size, fp, bands, map (bitmap of the set) of every row; null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            nodes, sizes, fps, bands, signs = [], [], [], [], []
            for t in b.column(2):
                values = shingles((t.as_py() or "").encode(), words, seed)
                s = np.unique(np.array(values, np.uint64))
                nodes.append(xxhash.xxh64_intdigest(s.tobytes(), seed))
                sizes.append(len(s))
                fps.append(fold_bits(values))
                signs.append(bitmap(s))
                keys = [xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(minima(s, seed))] if len(s) else []
                bands.append(np.array(keys, np.uint64).view(np.int64))
            columns = [b.column(0), b.column(1), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(fps, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(signs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "_th", "node", "size", "fp", "bands", "map"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("_th"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, _th long, node long, size long, fp long, bands array<long>, map array<long>")


def sets(texts: DataFrame, words: int, seed: int) -> DataFrame:
    """node, shingles (distinct values) of rows (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_set((t.as_py() or "").encode(), words, seed).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], names=["node", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node long, shingles array<long>")


def shared_keys(nodes: DataFrame) -> DataFrame:
    """key, node, size of the keys that two nodes or more share: MinHash bands, and entries of the SimHash multi-index tables."""
    bands = nodes.select("node", "size", F.explode("bands").alias("key"))
    tables = probes(nodes.where("size > 0"), "node", "size").select("node", "size", F.xxhash64(F.lit("table"), "part", "value").alias("key"))
    keys = bands.unionByName(tables)
    several = stored(keys.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("key"), "minhash-several")
    shared = stored(keys.join(short(several), "key"), "minhash-keys")  # most keys are of one node: a short list spares moving them again
    discard(several)
    return shared


def short(rows: DataFrame) -> DataFrame:
    """rows of a stored table with few columns, to be broadcast if they are at most BROADCAST_ROWS."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def hot(pairs: DataFrame, side: str) -> DataFrame:
    """The nodes of a side that have more than HOT_ROWS pairs, and over how many tasks they are dealt; at most one row for HOT_ROWS pairs."""
    return stored(pairs.groupBy(side).agg(F.ceil(F.count("*") / HOT_ROWS).cast("int").alias("_deals")).where("_deals > 1"), "minhash-hot")


def dealt(rows: DataFrame, heat: DataFrame, side: str, deal: Column) -> DataFrame:
    """rows with _deal, made by ``deal`` from _deals (1 for nodes that are not hot)."""
    return rows.join(short(heat), side, "left").withColumn("_deals", F.coalesce("_deals", F.lit(1))).withColumn("_deal", deal).drop("_deals")


def attach(pairs: DataFrame, whole: DataFrame, side: str, name: str, heat: DataFrame) -> DataFrame:
    """pairs with the shingles of a side's node. A hot node is dealt over tasks, about HOT_ROWS of its pairs in each."""
    other = "a" if side == "b" else "b"
    held = dealt(whole.select(F.col("node").alias(side), F.col("shingles").alias(name)), heat, side, F.explode(F.sequence(F.lit(0), F.col("_deals") - 1)))
    return dealt(pairs, heat, side, F.pmod(F.xxhash64(other), F.col("_deals")).cast("int")).join(held, [side, "_deal"]).drop("_deal")


def verified(pairs: DataFrame, whole: DataFrame, least: float) -> tuple[DataFrame, list[DataFrame]]:
    """The pairs (a, b) of a stored table whose sets have a Jaccard similarity of ``least`` or more, and the stored tables that they hang on.

    Few pairs go to the sets of their a where these lie; beyond that both meet by a shuffle. The sets of a then move to those of b once.
    """
    heat = hot(pairs, "b")
    if pairs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        first, used = F.broadcast(pairs).join(whole.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a"), [heat]
    else:
        warm = hot(pairs, "a")
        first, used = attach(pairs, whole, "a", "sa", warm), [heat, warm]
    ends = stored(pairs.select(F.col("b").alias("node")).distinct(), "minhash-ends")
    both = attach(first, whole.join(short(ends), "node", "left_semi"), "b", "sb", heat)
    shared = both.select("a", "b", (F.size("sa") + F.size("sb")).alias("n"), F.size(F.array_intersect("sa", "sb")).alias("s"))
    return shared.where(F.col("s") >= F.lit(least) * (F.col("n") - F.col("s")) - 1e-9).select("a", "b"), [*used, ends]


def may_meet(pairs: DataFrame, signs: DataFrame, least: float) -> DataFrame:
    """The distinct pairs (a, b) that bitmaps and sizes do not rule out, so that fewer sets are moved."""
    of = lambda side: signs.select(F.col("node").alias(side), F.col("size").alias(f"n{side}"), F.col("map").alias(f"p{side}"))
    return pairs.distinct().join(of("a"), "a").join(of("b"), "b").where(may_be_alike("pa", "pb", "na", "nb", least)).select("a", "b")


def components(docs: DataFrame, marked: DataFrame, nodes: DataFrame, words: int, least: float, seed: int) -> DataFrame:
    """node, component of the nodes that have a link."""
    keys = shared_keys(nodes)
    signs = stored(nodes.join(keys.select("node").distinct(), "node").select("node", "size", "map", F.col("any.doc_id").alias("_id"), F.col("any._th").alias("_h")), "minhash-met")
    wanted = signs.select("node", "_id", "_h")
    small = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("_th"), F.col("text").cast("string").alias("text"))
    texts = rows.join(F.broadcast(wanted) if small else wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_h")))
    # rows that repeat an id and text give a node twice: one of them is enough, told apart before the sets are made
    whole = stored(sets(texts.groupBy("node").agg(F.min("text").alias("text")) if _repeats(marked) else texts, words, seed), "minhash-sets")
    alike = lambda x, y: F.least(x, y) >= F.lit(least) * F.greatest(x, y) - 1e-9  # noqa: E731  (sizes further apart cannot reach it)
    popular = keys.join(keys.groupBy("key").agg(F.count("*").alias("n")), "key").groupBy("node").agg(F.sum("n").alias("score"))
    state, before = stored(keys.join(popular, "node").withColumn("component", F.col("node")), "minhash-state"), math.inf
    linked, ties = docs.sparkSession.createDataFrame([], "node long, component long"), True
    for turn in range(ROUNDS_MOST + 1):
        if ties:
            order = F.struct("score", "node") if not turn else F.struct(F.xxhash64("node", "key", F.lit(turn)), "node")
            # of each component in a key its size and one member: the most popular at first, then a changing one
            parts = state.groupBy("key", "component").agg(F.count("*").alias("n"), F.max(order).alias("by"), F.max_by(F.struct("node", "size"), order).alias("one"))
            split = parts.groupBy("key").agg(F.sum("n").alias("rows"), F.max("n").alias("most"), F.max_by(F.struct("component", "one"), F.struct("n", "by")).alias("big")).where("rows > most")
            split = stored(split, "minhash-split")
            left = split.agg(F.sum((F.col("rows") - F.col("most")) * F.col("rows")).alias("pairs"), F.sum("rows").alias("rows")).first()
            if not left["pairs"]:
                break
            beside = state.join(split.select("key", "big"), "key").where(F.col("component") != F.col("big.component"))
        last = not ties or left["pairs"] <= PAIRS_A_ROW * left["rows"] or turn == ROUNDS_MOST or left["pairs"] > HELPS * before
        before = left["pairs"]
        if last:
            met = remaining(beside, linked, signs, alike, least)
        else:
            met = may_meet(beside.where(alike("size", "big.one.size")).select(F.col("node").alias("a"), F.col("big.one.node").alias("b")), signs, least)
        met = stored(met, "minhash-pairs")
        links, used = verified(met, whole, least)
        linked, ties = tied(linked, links)
        discard(met, *used)
        if last:
            break
        if ties:
            still = state.join(split.select("key"), "key", "left_semi").drop("component")
            old, state = state, stored(still.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node")), "minhash-state")
            discard(old, split)
    discard(keys, signs, whole, state)
    return linked


def tied(linked: DataFrame, links: DataFrame) -> tuple[DataFrame, bool]:
    """linked (node, component) after more links (a, b), and whether they tie any components; only those are joined anew."""
    of = lambda side: linked.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    ties = stored(ends.where("a <> b").distinct(), "minhash-ties")
    if ties.isEmpty():
        discard(ties)
        return linked, False
    roots = connected_components(ties, "a", "b").select(F.col("node").alias("component"), F.col("component").alias("root"))
    again = linked.join(roots, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    new = roots.select(F.col("component").alias("node"), F.col("root").alias("component")).join(linked, "node", "left_anti")
    out = stored(again.unionByName(new), "minhash-linked")
    discard(ties, *([linked] if hasattr(linked, "stored_at") else []))
    return out, True


def remaining(beside: DataFrame, linked: DataFrame, signs: DataFrame, alike, least: float) -> DataFrame:
    """Pairs (a, b) that the nodes beside a key's largest component leave to test: with its members, and with one another."""
    members = signs.join(linked, "node", "left").select(F.coalesce("component", "node").alias("at"), F.col("node").alias("b"), F.col("size").alias("nb"), F.col("map").alias("pb"))
    mine = signs.select(F.col("node").alias("a"), F.col("size").alias("na"), F.col("map").alias("pa"))
    far = beside.select(F.col("node").alias("a"), F.col("big.component").alias("at")).distinct().join(mine, "a")
    # a component that very many nodes stand beside is dealt over tasks, DEALT_ROWS of those nodes in each
    heat = far.groupBy("at").agg(F.ceil(F.count("*") / DEALT_ROWS).cast("int").alias("deals"))
    far = far.join(heat, "at").withColumn("deal", F.pmod(F.xxhash64("a"), F.col("deals")).cast("int"))
    members = members.join(heat, "at").withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)))
    with_big = far.join(members, (far["at"] == members["at"]) & (far["deal"] == members["deal"]) & alike("na", "nb") & may_be_alike("pa", "pb", "na", "nb", least)).select("a", "b")
    few = beside.join(signs.select("node", "map"), "node")
    x = few.select("key", F.col("node").alias("a"), F.col("size").alias("na"), F.col("map").alias("pa"), F.col("component").alias("ca"))
    y = few.select("key", F.col("node").alias("b"), F.col("size").alias("nb"), F.col("map").alias("pb"), F.col("component").alias("cb"))
    among = x.join(y, (x["key"] == y["key"]) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & alike("na", "nb") & may_be_alike("pa", "pb", "na", "nb", least)).select("a", "b")
    return with_big.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(among).distinct()


def simhash_links(nodes: DataFrame, bits: int) -> DataFrame:
    """Pairs (a, b) of nodes that tie all whose fingerprints are equal or, found by multi-index hashing and verified by the whole distance, within ``bits``."""
    of = stored(nodes.groupBy("fp").agg(F.min("node").alias("node")), "minhash-prints")  # one node stands for a fingerprint
    side = lambda x: of.select(F.col("fp").alias(x), F.col("node").alias(f"n{x}"))
    near = links(of.select("fp"), bits).distinct().join(side("a"), "a").join(side("b"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    equal = nodes.select(F.col("node").alias("b"), "fp").join(of.withColumnRenamed("node", "a"), "fp").where("a <> b").select("a", "b")
    return near.unionByName(equal)


def _repeats(marked: DataFrame) -> bool:
    return not marked.groupBy(F.col("doc_id"), F.col("_th")).agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def one_of_each(docs: DataFrame, words: int = 5, least: float = 0.8, seed: int = 42, bits: int | None = None) -> DataFrame:
    """The documents without near-duplicates: of each component of links the row with the smallest doc_id stays.

    With ``bits`` fingerprints within that many bits (0 to 3) are links too, as those of near_duplicates() in simhash are.

    Texts without a word are copies of each other. Of rows that repeat a doc_id and text one stays. Rows with a
    null id cannot be told apart and all stay. Very long texts are taken whole, their shingles in blocks. An empty
    table gives no rows.
    """
    marked = stored(sketches(docs, words, seed), "minhash")
    row = F.struct("doc_id", "_th")
    same = [F.first(c).alias(c) for c in ("size", "fp", "bands", "map")]  # equal in all rows of a node
    nodes = stored(marked.groupBy("node").agg(F.min(row).alias("any"), F.min(F.when(F.col("doc_id").isNotNull(), row)).alias("least"), *same), "minhash-nodes")
    linked = components(docs, marked, nodes, words, least, seed)
    if bits is not None:
        linked, _ = tied(linked, stored(simhash_links(nodes, bits), "minhash-prints-met"))
    kept = first_of_each(docs, marked, nodes.join(linked, "node", "left").select(F.coalesce("component", "node").alias("root"), "least"))
    discard(marked, nodes)  # what is kept hangs on the documents and on the table of those that go
    return kept
