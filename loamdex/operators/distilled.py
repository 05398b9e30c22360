"""What became of each session: done, grown, waiting or new; and lists of sessions to leave out, whole or from an instant on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Names of pages that may be carried over, and hours of quiet before a session is taken.
PAGE = r"(?U)^[\w-]{1,80}$"
SETTLE_HOURS = 6.0


def source_type(agent: str = "agent") -> Column:
    return F.concat(F.coalesce(agent, F.lit("claude")), F.lit("_session"))


def state(sessions: DataFrame, markers: DataFrame, ledger: DataFrame, staged: DataFrame, now: float, hours: float = SETTLE_HOURS, as_of: str | None = None) -> DataFrame:
    """sessions (agent, session_id, last_ts) with marked, done, done_ts, grew, settled, pages and next (done, continue, wait, distil).

    ``markers``: agent (null: a marker of the oldest kind, which is claude's), session_id, last_ts, pages. ``ledger``:
    source_type, source_id, device, seq, recorded_at, distilled_through_last_ts, pages, of every device; of a session its
    latest row counts. ``staged``: source_type, source_id of rows not yet in the ledger. Times are seconds.

    With ``as_of``, a column of sessions, each session meets the ledger as it stood at that time, its own instant
    included: of the rows of that session alone, so the join is on the session and not on times. Sessions without a time
    count as settled. Pages are the marker's, else those of the latest row that has any; names of other shapes are left out.
    """
    rows = sessions.withColumns({"_type": source_type(), "_agent": F.coalesce("agent", F.lit("claude"))})
    kept = markers.select(F.coalesce("agent", F.lit("claude")).alias("_agent"), "session_id", F.col("last_ts").alias("_m"), F.col("pages").alias("_mp"), F.col("agent").isNotNull().alias("_named"))
    # a session's own marker before one of the oldest kind
    marker = kept.groupBy("_agent", "session_id").agg(F.max_by(F.struct("_m", "_mp"), F.struct("_named", F.coalesce("_m", F.lit(float("-inf"))))).alias("_marker"))
    rows = rows.join(marker, ["_agent", "session_id"], "left")
    told = ledger.select(F.col("source_type").alias("_type"), F.col("source_id").alias("session_id"), F.struct("recorded_at", "device", "seq").alias("_at"), F.col("distilled_through_last_ts").alias("_through"), F.col("pages").alias("_lp"))
    if as_of:
        points = rows.select("_type", "session_id", F.col(as_of).alias("_point")).distinct()
        met = points.join(told, ["_type", "session_id"]).where(F.col("_at.recorded_at") <= F.col("_point"))
        keys = ["_type", "session_id", "_point"]
    else:
        met, keys = told, ["_type", "session_id"]
    has_pages = F.size(F.coalesce("_lp", F.array().cast("array<string>"))) > 0
    latest = met.groupBy(*keys).agg(F.max_by("_through", "_at").alias("_through"), F.max_by(F.when(has_pages, F.col("_lp")), F.when(has_pages, F.col("_at"))).alias("_lp"), F.lit(True).alias("_in_ledger"))
    rows = rows.withColumn("_point", F.col(as_of)).join(latest, keys, "left").drop("_point") if as_of else rows.join(latest, keys, "left")
    waiting = staged.select(F.col("source_type").alias("_type"), F.col("source_id").alias("session_id"), F.lit(True).alias("_staged")).distinct()
    rows = rows.join(waiting, ["_type", "session_id"], "left")
    marked = F.col("_marker").isNotNull()
    done = marked | F.coalesce("_in_ledger", F.lit(False)) | F.coalesce("_staged", F.lit(False))
    done_ts = F.greatest(F.col("_marker._m"), F.col("_through"))
    own = F.coalesce("_marker._mp", F.array().cast("array<string>"))
    pages = F.filter(F.when(F.size(own) > 0, own).otherwise(F.coalesce("_lp", F.array().cast("array<string>"))), lambda p: F.coalesce(p.rlike(PAGE), F.lit(False)))
    out = rows.withColumns({"marked": marked, "done": done, "done_ts": done_ts, "pages": pages}).withColumns({
        "grew": F.coalesce(F.col("last_ts") > F.col("done_ts"), F.lit(False)),
        "settled": F.coalesce(F.lit(now) - F.col("last_ts") >= hours * 3600, F.lit(True)),
    })
    step = F.when(~F.col("settled") & (~F.col("done") | F.col("grew")), "wait").when(~F.col("done"), "distil").when(F.col("grew"), "continue").otherwise("done")
    return out.withColumn("next", step).drop("_type", "_agent", "_marker", "_through", "_lp", "_in_ledger", "_staged")


def listed(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, cutoff; lines that cannot be read): an exclusion list, one ``value`` a line: an id, or an id and an instant with an offset.

    ``#`` starts a comment. Ids are folded to lower case. An id without an instant is left out whole (cutoff null), and
    of an id listed twice the stricter entry holds: whole, else the earlier instant.
    """
    words = F.filter(F.split(F.regexp_replace(F.regexp_replace("value", "^﻿", ""), "#.*$", ""), r"\s+"), lambda w: w != "")
    offset = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"
    rows = lines.select("value", words.alias("w")).where(F.size("w") > 0)
    instant = F.when(F.get("w", F.lit(1)).rlike(offset), F.try_to_timestamp(F.get("w", F.lit(1))).cast("double"))
    rows = rows.select("value", F.lower(F.get("w", F.lit(0))).alias("id"), F.size("w").alias("n"), instant.alias("cutoff"))
    bad = rows.where("n > 2 or (n = 2 and cutoff is null)").select("value")
    good = rows.where("n = 1 or (n = 2 and cutoff is not null)")
    return good.groupBy("id").agg(F.when(F.count("cutoff") == F.count("*"), F.min("cutoff")).alias("cutoff")), bad


def refused(entries: DataFrame, roots: DataFrame, reached: DataFrame, strict: bool = True) -> DataFrame:
    """id, problem of entries (id, cutoff) that cannot do what they say; while there is one, nothing may be collected.

    ``roots``: id, root (the first session of the conversation) of all known sessions. ``reached``: id, at (how far what
    was made of a conversation goes). Problems: 'distilled' (left out whole, but made into pages already), 'past cutoff'
    (pages go as far as the cutoff or beyond), 'abbreviated' (only the start of a known id), 'unknown' (if ``strict``).
    """
    known = roots.select(F.lower("id").alias("id"), F.lower("root").alias("root")).groupBy("id").agg(F.min("root").alias("root"))
    rows = entries.join(known, "id", "left")
    made = reached.groupBy(F.lower("id").alias("_made")).agg(F.max("at").alias("at"))
    names = rows.select("id", "cutoff", F.explode(F.array_distinct(F.array_compact(F.array("id", "root")))).alias("_made"))
    at = names.join(made, "_made").groupBy("id").agg(F.max("at").alias("at"), F.max("cutoff").alias("cutoff"))
    late = at.where("cutoff is null or at >= cutoff").select("id", F.when(F.col("cutoff").isNull(), "distilled").otherwise("past cutoff").alias("problem"))
    strange = rows.where("root is null").select("id").join(late, "id", "left_anti")
    # prefixes of known ids, of the lengths that occur: an equi-join, where a join on startsWith would compare all pairs
    lengths = [r[0] for r in strange.select(F.char_length("id")).distinct().collect()]  # at most as many as an id is long
    if lengths:
        starts = known.select(F.explode(F.array(*[F.substring("id", 1, n) for n in lengths])).alias("id")).distinct().withColumn("_short", F.lit(True))
        strange = strange.join(starts, "id", "left")
    else:
        strange = strange.withColumn("_short", F.lit(None).cast("boolean"))
    odd = strange.where("_short" if not strict else "true").select("id", F.when(F.coalesce("_short", F.lit(False)), "abbreviated").otherwise("unknown").alias("problem"))
    return late.unionByName(odd)


def without(turns: DataFrame, roots: DataFrame, entries: DataFrame) -> DataFrame:
    """turns (session, ts, ...) less what the entries leave out: conversations with a session listed whole, and of others all from the earliest cutoff on.

    A cutoff on any session of a conversation cuts the whole conversation at that instant; a turn without a time goes
    when there is a cutoff, since it cannot be told to lie before it.
    """
    known = roots.select(F.lower("id").alias("_id"), F.lower("root").alias("_root")).distinct()
    hit = known.join(entries.select(F.col("id").alias("_id"), "cutoff"), "_id").groupBy("_root").agg(F.bool_or(F.col("cutoff").isNull()).alias("_whole"), F.min("cutoff").alias("_cut"))
    members = known.join(hit, "_root").select("_id", "_whole", "_cut")
    rows = turns.withColumn("_id", F.lower("session")).join(members, "_id", "left")
    stays = F.col("_whole").isNull() | (~F.col("_whole") & F.coalesce(F.col("ts") < F.col("_cut"), F.lit(False)))
    return rows.where(stays).drop("_id", "_whole", "_cut")
