"""Session transcripts: noise, repeats within a session, roles, caps; tails and continuation chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from loamdex.functions import text as X
from loamdex.session import settled

TURN_CAP = 6000


def assemble(turns: DataFrame, session: str = "session", order: str = "turn", prefix: bool = True, cap: int = TURN_CAP, fold_whole: bool = False) -> DataFrame:
    """session, text, n_msg, first_turn, last_turn: turns that are no noise, the first of each repeat, capped, joined in order.

    Repeats are told by the folded first 400 characters, or by the whole folded text.
    """
    key = F.md5(F.regexp_replace(F.btrim("text"), r"\s+", " ")) if fold_whole else X.dedupe_key("text")
    kept = turns.where(~X.is_noise("text")).withColumn("_k", key)
    first = kept.withColumn("_r", F.row_number().over(Window.partitionBy(session, "_k").orderBy(order))).where("_r = 1")
    part = F.substring("text", 1, cap)
    part = F.concat(F.lit("**"), F.when(F.col("role") == "user", "Me").otherwise("Agent"), F.lit("**: "), part) if prefix else part
    joined = first.groupBy(session).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), part.alias("t")))).alias("_p"), F.count("*").alias("n_msg"), F.min(order).alias("first_turn"), F.max(order).alias("last_turn"))
    return joined.select(session, F.array_join(F.transform("_p", lambda p: p["t"]), "\n\n").alias("text"), "n_msg", "first_turn", "last_turn")


def tail(turns: DataFrame, since, through, order: str = "turn") -> DataFrame:
    """Turns after one point up to another (its own included)."""
    return turns.where((F.col(order) > since) & (F.col(order) <= through))


def fragments(text: DataFrame, key: str, size: int = 6000, most: int = 8) -> DataFrame:
    """key, idx, text: windows of a long session, of which at most ``most`` stay, from both ends."""
    n = F.ceil(F.char_length("text") / F.lit(size)).cast("int")
    rows = text.withColumn("_n", n).where("_n > 0").select(key, "_n", "text", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("idx"))
    return rows.where(X.head_tail(F.col("_n"), F.col("idx"), most)).select(key, "idx", F.expr(f"substring(text, idx * {size} + 1, {size})").alias("text"))


def chain_roots(sessions: DataFrame, most: int = 64) -> DataFrame:
    """id, root: the start of each continuation chain (id, parent). Pointer doubling: rounds grow with the logarithm of the longest chain."""
    known = sessions.select(F.col("id").alias("parent"))
    now = settled(sessions.join(known, "parent", "left_semi").select("id", "parent").unionByName(sessions.join(known, "parent", "left_anti").select("id", F.col("id").alias("parent"))))
    for _ in range(most):
        up = now.select(F.col("id").alias("parent"), F.col("parent").alias("_up"))
        nxt = settled(now.join(up, "parent").select("id", F.col("_up").alias("parent"), (F.col("_up") != F.col("parent")).alias("_moved")))
        if nxt.where("_moved").isEmpty():
            return nxt.select("id", F.col("parent").alias("root"))
        now = nxt.select("id", "parent")
    raise ValueError("a chain of sessions loops")


def excluding(records: DataFrame, excluded: DataFrame) -> DataFrame:
    """Records (members array) without those any member of which is excluded (id)."""
    hit = records.select("session", F.explode("members").alias("id")).join(excluded.select("id"), "id", "left_semi").select("session").distinct()
    return records.join(hit, "session", "left_anti")


def settled_sessions(sessions: DataFrame, now: str, quiet: str = "6 hours") -> DataFrame:
    """Sessions whose last event is ``quiet`` past; an unknown one counts as open."""
    return sessions.withColumn("open", F.coalesce(F.col("last_ts") > F.lit(now).cast("timestamp") - F.expr(f"interval {quiet}"), F.lit(True)))


def collision_slugs(rows: DataFrame, slug: str = "slug", order: str = "ord") -> DataFrame:
    """Adds unique_slug: the second of a slug gets -v2, and so on."""
    n = F.row_number().over(Window.partitionBy(slug).orderBy(order))
    return rows.withColumn("unique_slug", F.when(n > 1, F.concat(F.col(slug), F.lit("-v"), n)).otherwise(F.col(slug)))
