"""Summaries of many fragments: a tree of summaries under a budget of characters, whose nodes are cached by content.

A round groups neighbouring fragments as far as the budget goes and replaces each group by its summary; names that fit
the budget get their last summary and leave. A node is known by the digest of what it is made of, so a changed fragment
has only the nodes above it made anew.

Groups and digests need lengths and digests of the texts alone. A text moves once, to the call that summarises its
group, and not at all where the cache has its node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loamdex.session import discard, stored

#: Characters of one call, of a summary, and fragments from which a name is summarised.
BUDGET, MOST_CHARS, LEAST_FRAGMENTS = 14_000, 900, 8
#: Fragments of one name that are grouped together in the first round; the next rounds take this many times more.
SEGMENT, WIDER = 4096, 8
CACHE = "key string, summary string"


def opening(name: str, pieces: list[str]) -> str:
    """A stand-in for a model: how each piece begins."""
    return f"{name}: " + " ".join(p[:40] for p in pieces)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """key, summary of the nodes made so far."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    rows = spark.read.schema(CACHE).parquet(path) if there else spark.createDataFrame([], CACHE)
    return rows.groupBy("key").agg(F.min("summary").alias("summary"))


def digested(rows: DataFrame) -> DataFrame:
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


def ranked(frags: DataFrame, texts: DataFrame) -> DataFrame:
    """frags with rank: the order of texts that share a name and place. Only such texts are looked at."""
    tied = stored(frags.groupBy("name", "place").agg(F.count("*").alias("n")).where("n > 1").select("name", "place"), "fold-tied")
    if not tied.limit(1).count():
        return frags.withColumn("rank", F.lit(0))
    rank = F.dense_rank().over(Window.partitionBy("name", "place").orderBy("text"))
    order = texts.join(tied, ["name", "place"], "left_semi").select("name", "place", "digest", rank.alias("rank")).distinct()
    return frags.join(order, ["name", "place", "digest"], "left").fillna(0, ["rank"])


def grouped(frags: DataFrame, budget: int, version: str) -> DataFrame:
    """Each fragment's node: its number in the segment, its place (the first fragment's) and key, and i, the fragment's place in it."""

    def greedy(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["place", "rank"], kind="stable").reset_index(drop=True)
        node, used, at = -1, 0, []
        for chars, whole in zip(pdf["chars"], pdf["whole"], strict=True):
            if node < 0 or (used + chars > budget and not whole):
                node, used = node + 1, 0
            at.append(node)
            used += chars
        nodes = pdf.assign(node=at).groupby(at, sort=False)
        # lengths before names: no two nodes give the same digest
        head = f"{len(version)} {len(key[0])} {version}{key[0]}".encode()
        keys = {n: hashlib.sha256(head + b"".join(own)).hexdigest() for n, own in nodes["digest"]}
        return pdf.assign(node=at, i=nodes.cumcount(), key=[keys[n] for n in at], place=nodes["place"].transform("first"))[MEMBER_COLUMNS]

    return frags.groupBy("name", "segment").applyInPandas(greedy, MEMBERS)


MEMBERS = "name string, segment long, whole boolean, node long, place long, key string, i long, digest binary"
MEMBER_COLUMNS = [c.split()[0] for c in MEMBERS.split(", ")]


def summarised(members: DataFrame, texts: DataFrame, cache_path: str, summarise: Callable[[str, list[str]], str]) -> tuple[DataFrame, int]:
    """(name, place, whole, summary of the members' nodes; how many were made anew); new summaries are appended to the cache.

    texts: name, segment, digest, text of all fragments.
    """
    spark = members.sparkSession

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        text = dict(zip(left["digest"], left["text"], strict=True))
        out = []
        for k, own in right.sort_values(["node", "i"]).groupby("key", sort=False):
            pieces = [text[d] for d in own["digest"]]
            out.append((k, (summarise(key[0], pieces) or " ".join(pieces))[:MOST_CHARS]))
        return pd.DataFrame(out, columns=["key", "summary"])

    nodes = members.where("i = 0").select("name", "segment", "node", "place", "whole", "key")
    once = nodes.groupBy("key").agg(F.min(F.struct("segment", "node")).alias("at"))
    missing = stored(once.join(read_cache(spark, cache_path).select("key"), "key", "left_anti").select("key", "at.segment", "at.node"), "fold-missing")
    n = missing.count()
    if n:
        needed = stored(members.join(missing, ["key", "segment", "node"], "left_semi").select("name", "segment", "node", "i", "digest", "key"), "fold-needed")
        where = stored(needed.select("name", "segment").distinct(), "fold-segments")
        here = texts.join(where, ["name", "segment"], "left_semi").select("name", "segment", "digest", "text")
        here.groupBy("name", "segment").cogroup(needed.groupBy("name", "segment")).applyInPandas(run, CACHE).write.mode("append").parquet(cache_path)
        discard(needed, where)
    discard(missing)
    return stored(nodes.join(read_cache(spark, cache_path), "key").select("name", "place", "whole", "summary"), "fold-summaries"), n


def fold(fragments: DataFrame, cache_path: str, summarise: Callable[[str, list[str]], str] = opening, version: str = "1", budget: int = BUDGET, least: int = LEAST_FRAGMENTS, segment: int = SEGMENT) -> tuple[DataFrame, int]:
    """(name, fragments, rounds, summary of each name with ``least`` distinct fragments or more; nodes made anew).

    ``fragments`` has name, place (a whole number: the order), text. Null and empty texts are no fragments, an equal text
    of a name counts once, at its first place. A group holds neighbours within a segment of places, and more than
    ``budget`` characters only where a single fragment does. Where nothing can be grouped, the texts are joined and cut.
    """
    texts = digested(fragments.where("name is not null and text <> ''").select("name", F.col("place").cast("long").alias("place"), "text"))
    kept = texts.groupBy("name", "digest").agg(F.min("place").alias("place"), F.max(F.char_length("text")).alias("chars"))
    kept = stored(kept, "fold-0")
    wanted = stored(kept.groupBy("name").agg(F.count("*").alias("fragments")).where(F.col("fragments") >= least), "fold-names")
    frags = kept.join(wanted.select("name"), "name", "left_semi")
    out, made, round_, width = None, 0, 0, segment
    while True:
        round_ += 1
        sizes = frags.groupBy("name").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.max("place").alias("last"), F.min("place").alias("low"))
        sizes = stored(sizes.withColumn("whole", (F.col("chars") <= budget) | (F.col("n") <= 2)), "fold-sizes")
        left = sizes.where("not whole").count()
        # a name that fits is one segment, whatever its places
        dealt = lambda rows: rows.join(sizes.select("name", "whole"), "name").withColumn("segment", F.when(F.col("whole"), F.lit(-1)).otherwise(F.floor(F.col("place") / width)))  # noqa: B023, E731
        members = stored(grouped(dealt(ranked(frags, texts)), budget, version), "fold-members")
        # a name that nothing could be grouped of, though all its places were looked at together, will never shrink
        after = members.where("i = 0 and not whole").groupBy("name").agg(F.count("*").alias("groups"))
        stuck = stored(after.join(sizes, "name").where((F.col("groups") >= F.col("n")) & (F.floor(F.col("low") / width) == F.floor(F.col("last") / width))).select("name"), "fold-stuck")
        done = None
        if stuck.limit(1).count():
            order = F.row_number().over(Window.partitionBy("name").orderBy("node", "i"))
            head = members.join(stuck, "name", "left_semi").withColumn("_i", order).where(F.col("_i") <= MOST_CHARS)  # no text is empty, so these fill a summary
            own = texts.join(stuck, "name", "left_semi").select("name", "digest", F.substring("text", 1, MOST_CHARS).alias("text"))
            pieces = head.join(own, ["name", "digest"]).groupBy("name", "_i").agg(F.min("text").alias("text"))
            joined = pieces.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "text"))), lambda x: x["text"]), " ").alias("t"))
            done = stored(joined.select("name", F.lit(round_).alias("rounds"), F.substring("t", 1, MOST_CHARS).alias("summary")), "fold-joined")
        folded, n = summarised(members.join(stuck, "name", "left_anti"), dealt(texts), cache_path, summarise)
        made += n
        last = folded.where("whole").select("name", F.lit(round_).alias("rounds"), "summary")
        for part in (last, done):
            out = part if out is None else out if part is None else out.unionByName(part)
        discard(members, sizes, stuck)
        if not left:
            break
        texts = digested(folded.where("not whole").select("name", "place", F.col("summary").alias("text")))
        frags = texts.select("name", "digest", "place", F.char_length("text").alias("chars"))
        width *= WIDER
    discard(kept)
    return wanted.join(out, "name").select("name", "fragments", "rounds", "summary"), made
