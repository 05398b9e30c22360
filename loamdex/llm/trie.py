"""Conversation prefix trie: levels built from the root down, totals rolled up by joins from the deepest level back.

At each depth the live conversations are grouped by (parent node, next turn), and each group, a node, is named by its
smallest conv_id. A conversation alone in its node leaves the levels: what is left of it is a chain of nodes of its
own, known from its length. So there are as many levels as the deepest node that two conversations share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from loamdex.llm.common import BROADCAST_ROWS
from loamdex.session import discard, scratch_path, stored

#: Most turns taken over from the first conversation of a hundred is one less than this.
HEADS = 6
FAMILY = 100
#: Ids that agree but for so many last bits are a block, joined in one row before they are hashed.
ID_BITS = 12
#: Nodes of a chain that one row is unfolded to at a time.
SEGMENT = 1 << 16
#: A node with more than this part of the live conversations is joined by broadcast; there are at most as many as this.
HOT = 1000
NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"


def digested(table: DataFrame) -> DataFrame:
    """conv_id, turn, key (a SHA-256 of role and text, null: empty), points (code points of the text); null conv_ids are left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    return table.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), key.alias("key"), F.length(text).cast("long").alias("points"))


def placed(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, pieces): stored turns in sorted pieces, and where in its conversation each piece's share starts.

    Turns are dealt by ranges of (conv_id, turn, key), so that a very long conversation stands in many pieces; a turn's
    place is its place in the piece after those of the pieces before.
    """
    order = ["conv_id", "turn", "key"]
    n = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = digested(table).repartitionByRange(n, *order).sortWithinPartitions(*order)
    turns = stored(dealt.select("conv_id", "key", "points", F.monotonically_increasing_id().alias("at")), "trie-turns")
    piece = F.shiftright("at", 33).alias("piece")  # the partition's number stands in the upper bits
    pieces = turns.groupBy("conv_id", piece).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    return turns, stored(pieces.withColumn("before", F.coalesce(before, F.lit(0))), "trie-pieces")


def heads_taken(conv: Column) -> Column:
    """How many turns a conversation takes over: unsigned crc32 of the decimal id, modulo HEADS."""
    return F.crc32(conv.cast("string").cast("binary")) % HEADS


def rebuilt(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(convs, turns): conv_id, len of each conversation; conv_id, d (from 1), key, points of its turns.

    The turns are stored by band of depth (the depth's binary digits), sorted by depth, so a level reads a part.
    """
    spark = table.sparkSession
    turns, pieces = placed(table)
    lengths = pieces.groupBy("conv_id").agg(F.sum("n").alias("own"))
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    info = lengths.select("conv_id", "own", heads_taken(F.col("conv_id")).alias("h"), base.alias("base"))
    info = info.join(lengths.select(F.col("conv_id").alias("base"), F.col("own").alias("there")), "base", "left")
    info = info.withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    info = stored(info.withColumn("len", F.col("taken") + F.greatest(F.lit(0), F.col("own") - F.col("h"))), "trie-info")
    starts = pieces.join(info.select("conv_id", "h", "taken"), "conv_id")
    # by piece as well, so no key has more rows than a piece
    at = turns.withColumn("piece", F.shiftright("at", 33)).join(starts, ["conv_id", "piece"])
    at = at.withColumn("place", F.col("at") - F.col("first") + F.col("before") + 1)
    own = at.where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("d"), "key", "points")
    heads = at.where((F.col("place") < HEADS) & (F.col("conv_id") % FAMILY == 0)).select(F.col("conv_id").alias("base"), F.col("place").alias("d"), "key", "points")
    from_base = heads.join(info.select("conv_id", "base", "h"), "base").where("d <= h").select("conv_id", "d", "key", "points")
    path = scratch_path(spark, "trie-rebuilt")
    every = own.unionByName(from_base).withColumn("band", F.length(F.bin("d")))
    every.sortWithinPartitions("band", "d").write.partitionBy("band").parquet(path)
    discard(turns, pieces)
    return info.select("conv_id", "len"), spark.read.schema("conv_id bigint, d bigint, key binary, points bigint, band int").parquet(path)


def members_of(at: DataFrame, groups: DataFrame, live: int, several: int) -> DataFrame:
    """conv_id, len, parent (their node) of the live conversations in nodes of several: a node of very many is joined by broadcast."""
    shared = groups.where("n > 1").select("parent", "key", "node", "n")
    on = ["parent", "key"]
    out = ["conv_id", "len", F.col("node").alias("parent")]
    if several <= BROADCAST_ROWS:
        return at.join(F.broadcast(shared), on).select(*out)
    hot = shared.where(F.col("n") * HOT > live)  # HOT rows at most
    rest = at.join(F.broadcast(hot), on, "left_anti").join(shared.where(F.col("n") * HOT <= live), on)
    return at.join(F.broadcast(hot), on).select(*out).unionByName(rest.select(*out))


def levels(convs: DataFrame, turns: DataFrame, root: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(groups, members) by depth from 1: every node that starts in a shared one, and the conversations in shared ones."""
    live = convs.select("conv_id", "len", F.lit(root).cast("long").alias("parent"))
    all_groups, all_members = [], []
    while True:
        d = len(all_groups) + 1
        at = stored(turns.where((F.col("band") == d.bit_length()) & (F.col("d") == d)).join(live.where(F.col("len") >= d), "conv_id").select("conv_id", "len", "parent", "key", "points"), "trie-live")
        named = at.groupBy("parent", "key").agg(F.min("conv_id").alias("node"), F.count("*").alias("n"), F.max("points").alias("points"), F.max("len").alias("len"))
        groups = stored(named, "trie-groups")
        count = groups.agg(F.count("*").alias("all"), F.count_if(F.col("n") > 1).alias("several"), F.sum("n").alias("live")).first()
        if count["all"]:
            all_groups.append(groups)
        if not count["several"]:
            discard(at)
            return all_groups, all_members
        live = stored(members_of(at, groups, count["live"], count["several"]), "trie-members")
        all_members.append(live)
        discard(at)


def ends(enders: DataFrame) -> DataFrame:
    """depth, node, ends_sha256: of each node's conv_ids, ascending, joined by commas.

    Ids are joined in blocks first; a digest is then one stream over a node's blocks, in bounded memory.
    """
    block = F.shiftright("conv_id", ID_BITS).alias("block")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = enders.groupBy("depth", "node", block).agg(ids.alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        for b in batches:
            out = []
            for depth, node, ids in zip(*(b.column(c).to_pylist() for c in ("depth", "node", "ids")), strict=True):
                if held != (depth, node):
                    if held:
                        out.append((*held, state.hexdigest()))
                    held, state = (depth, node), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield rows(out)
        if held:
            yield rows([(*held, state.hexdigest())])

    def rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["depth", "node", "ends_sha256"])

    n = int(enders.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks.repartition(n, "depth", "node").sortWithinPartitions("depth", "node", "block")
    return dealt.select("depth", "node", "ids").mapInArrow(digest, "depth long, node long, ends_sha256 string")


def rolled_up(groups: list[DataFrame], top: DataFrame) -> list[DataFrame]:
    """The shared nodes of every depth, root first, with n_children, n_leaves and saved_tokens of their subtrees."""
    out, below = [], None
    for depth in range(len(groups), -1, -1):
        own = (groups[depth - 1].where("n > 1") if depth else top).select("parent", "node", "n", ((F.col("n") - 1) * F.col("points")).alias("saved"))
        if below is None:
            here = own.withColumns({"n_children": F.lit(0).cast("long"), "n_leaves": F.lit(1).cast("long")})
        else:
            sums = below.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("more"))
            here = own.join(sums, "node", "left").select(
                "parent", "node", "n", (F.col("saved") + F.coalesce("more", F.lit(0))).alias("saved"),
                F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("leaves", F.lit(1)).alias("n_leaves"),
            )
        here = stored(here.withColumn("depth", F.lit(depth).cast("long")), "trie-rolled")
        out.append(here)
        if depth:
            alone = groups[depth - 1].where("n = 1").select("parent", F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved"))
            below = here.select("parent", "n_leaves", "saved").unionByName(alone)
    return out[::-1]


def chains(groups: list[DataFrame]) -> DataFrame:
    """The nodes of conversations that are alone, from the depth where they part to their ends; long ones in segments."""
    alone = [g.where("n = 1").select("node", "parent", "len", F.lit(d).cast("long").alias("top")) for d, g in enumerate(groups, 1)]
    every = alone[0]
    for a in alone[1:]:
        every = every.unionByName(a)
    pieces = every.withColumn("low", F.explode(F.sequence("top", "len", F.lit(SEGMENT).cast("long"))))
    nodes = pieces.withColumn("depth", F.explode(F.sequence("low", F.least(F.col("len"), F.col("low") + SEGMENT - 1))))
    inner, one, none = F.col("depth") < F.col("len"), F.lit(1).cast("long"), F.lit(0).cast("long")
    return nodes.select(
        F.col("node").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("top"), F.col("parent")).otherwise(F.col("node")).alias("parent_conv_id"), one.alias("n_convs"),
        F.when(inner, one).otherwise(none).alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"),
        F.sha2(F.when(inner, F.lit("")).otherwise(F.col("node").cast("string")).cast("binary"), 256).alias("ends_sha256"),
    )


def trie(table: DataFrame) -> DataFrame:
    """A row per node of the trie of rebuilt conversations: the columns of NODE.

    A conversation c takes the first h turns of conversation c - c % 100 (all, if it has fewer; none, if there is no
    such conversation) in place of its own first h, with h = crc32(c) % 6. Turns are ordered by turn, null first; turns of
    equal number by the SHA-256 of role and text, and repeated rows are turns of their own. Null role or text is empty;
    rows without conv_id belong to no conversation. Other columns are not read. An empty table has no root: no rows.
    """
    spark = table.sparkSession
    convs, turns = rebuilt(table)
    count = convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("node")).first()
    if not count["n"]:
        return spark.createDataFrame([], NODE)
    groups, members = levels(convs, turns, count["node"])
    top = spark.createDataFrame([(None, count["node"], count["n"], 0)], "parent bigint, node bigint, n bigint, points bigint")
    shared = rolled_up(groups, top)
    enders = convs.where("len = 0").select(F.lit(0).cast("long").alias("depth"), F.lit(count["node"]).cast("long").alias("node"), "conv_id")
    for d, m in enumerate(members, 1):
        enders = enders.unionByName(m.where(F.col("len") == d).select(F.lit(d).cast("long").alias("depth"), F.col("parent").alias("node"), "conv_id"))
    nodes = shared[0]
    for s in shared[1:]:
        nodes = nodes.unionByName(s)
    nodes = nodes.join(ends(enders), ["depth", "node"], "left").select(
        F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
    return nodes.unionByName(chains(groups)) if groups else nodes
