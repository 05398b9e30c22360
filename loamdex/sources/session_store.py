"""A relational session store read over JDBC: split reads, filters that the store itself runs, and lineage by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loamdex.operators.transcripts import chain_roots

# Roles that are read, endings of a session that was reset, row kinds that are shown, marks of a session's origin.
ROLES = ("user", "assistant")
RESETS = ("session_reset", "session_switch", "idle", "daily", "suspended", "resume_pending_expired")
SHOWN = ("", "steer", "hidden")
SESSION = ("id", "source", "title", "parent_session_id", "session_key", "started_at", "ended_at", "end_reason", "handoff_state", "hidden", "model_config")


def table(spark: SparkSession, url: str, name: str, driver: str | None = None, split: str | None = None, parts: int = 8, columns: dict[str, str] | None = None) -> DataFrame:
    """A table over JDBC. With ``split``, a whole-number column, its range is read by ``parts`` connections, each a share of it."""
    options = {"url": url, "dbtable": name} | ({"driver": driver} if driver else {})
    reader = spark.read.format("jdbc").options(**options)
    if split:
        ends = reader.load().agg(F.min(split).alias("low"), F.max(split).alias("high")).first()  # the store works this out
        if ends["low"] is not None and ends["low"] < ends["high"]:
            reader = reader.options(partitionColumn=split, lowerBound=str(ends["low"]), upperBound=str(ends["high"] + 1), numPartitions=str(parts))
    df = reader.load()
    return df.select(*[F.col(c).alias(n) for n, c in columns.items()]) if columns else df


def marked(name: str) -> Column:
    """A mark of a session's settings, if these are JSON at all."""
    return F.get_json_object("model_config", f"$.{name}")


def lineage(sessions: DataFrame) -> DataFrame:
    """sessions (SESSION) with branched, continues, delegated and root, the first session of the conversation.

    Parents are looked up by one join on the session's id, and roots by doubling pointers over 'continues'. A branch
    started after its parent ended as 'branched', or says so; a session continues a parent that ended by compression, if
    no mark names that parent otherwise; a child that is neither, and was not reset, was delegated.
    """
    parent = sessions.select(F.col("id").alias("parent_session_id"), F.col("end_reason").alias("_reason"), F.col("ended_at").alias("_ended"), F.col("session_key").alias("_key"))
    rows = sessions.join(parent, "parent_session_id", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    branched = marked("_branched_from").isNotNull() | yes((F.col("_reason") == "branched") & (F.col("started_at") >= F.col("_ended")))
    compressed = yes(F.col("_reason") == "compression")
    reset = marked("_reset_from").isNotNull() | yes(F.col("_reason").isin(*RESETS) & (F.col("session_key") != "") & (F.col("session_key") == F.col("_key")))
    child = F.col("parent_session_id").isNotNull()
    named = [yes(marked(m) == F.col("parent_session_id")) for m in ("_delegate_from", "_branched_from", "_reset_from")]
    continues = compressed & ~(named[0] | named[1] | named[2])
    delegated = (child & ~branched & ~compressed & ~reset) | marked("_delegate_from").isNotNull()
    out = rows.withColumns({"branched": branched, "continues": continues, "delegated": delegated}).drop("_reason", "_ended", "_key")
    roots = chain_roots(out.select("id", F.when(F.col("continues"), F.col("parent_session_id")).alias("parent")))
    return out.join(roots, "id")


def messages(rows: DataFrame, roles: tuple[str, ...] = ROLES) -> DataFrame:
    """Messages that are shown: by role, neither observed nor taken back, of a kind that is read. The store runs these filters."""
    return rows.where(F.col("role").isin(*roles)).where("(active is null or active = 1 or compacted = 1) and (observed is null or observed = 0)").where(F.col("display_kind").isNull() | F.col("display_kind").isin(*SHOWN))


def conversations(sessions: DataFrame, excluded: DataFrame, sources: tuple[str, ...]) -> DataFrame:
    """root, members, fork, started_at, branched, cut, why (null: it is read) of each conversation of lineage() rows.

    Any session counts for all of its conversation. First reason wins: excluded (an entry without cutoff), hidden,
    delegated, handoff, platform (a source that was not asked for).
    """
    entries = excluded.select(F.col("id").alias("_low"), "cutoff", F.lit(True).alias("_listed"))
    rows = sessions.withColumn("_low", F.lower("id")).join(entries, "_low", "left")
    first = F.col("id") == F.col("root")
    whole = rows.groupBy("root").agg(
        F.array_sort(F.collect_list(F.struct("started_at", "id"))).alias("_m"), F.bool_or(first & F.col("parent_session_id").isNotNull()).alias("fork"),
        F.min(F.when(first, F.col("started_at"))).alias("started_at"), F.bool_or(first & F.col("branched")).alias("branched"), F.min("cutoff").alias("cut"),
        F.bool_or(F.col("_listed") & F.col("cutoff").isNull()).alias("_whole"), F.bool_or(F.coalesce(F.col("hidden") != 0, F.lit(False))).alias("_hidden"), F.bool_or("delegated").alias("_delegated"),
        F.bool_or(F.coalesce(F.col("handoff_state") != "", F.lit(False))).alias("_handoff"), F.min(F.when(~F.col("source").isin(*sources), F.col("source"))).alias("_off"),
    )
    why = F.when(F.coalesce("_whole", F.lit(False)), "excluded").when(F.col("_hidden"), "hidden").when(F.col("_delegated"), "delegated").when(F.col("_handoff"), "handoff").when(F.col("_off").isNotNull(), F.concat(F.lit("platform:"), "_off"))
    return whole.select("root", F.transform("_m", lambda x: x["id"]).alias("members"), "fork", "started_at", "branched", "cut", why.alias("why"))


def turns(sessions: DataFrame, kept: DataFrame, shown: DataFrame) -> DataFrame:
    """session (the root), member, ts, role, text of the messages of conversations that are read.

    A fork's messages from before it began are its parent's copy and are left out, and so is all from a cutoff on.
    """
    read = kept.where("why is null").select("root", "fork", F.col("started_at").alias("_began"), "cut")
    of = sessions.select(F.col("id").alias("session_id"), "root").join(read, "root")
    rows = shown.join(of, "session_id")
    copied = F.col("fork") & (F.col("timestamp") < F.col("_began"))
    late = F.col("cut").isNotNull() & ~F.coalesce(F.col("timestamp") < F.col("cut"), F.lit(False))
    return rows.where(~F.coalesce(copied, F.lit(False)) & ~late).select(F.col("root").alias("session"), F.col("session_id").alias("member"), F.col("timestamp").alias("ts"), "role", F.col("content").alias("text"))
