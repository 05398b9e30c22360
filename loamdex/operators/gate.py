"""Release gate: what may be shown of a row whose provenance includes blocked documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loamdex import schema as S


def verdicts(rows: DataFrame, blocked: DataFrame, key: str, doc_ids: str = "doc_ids") -> DataFrame:
    """rows with verdict and open_ids (released documents, in order).

    Nothing blocked at all: pass. All provenance blocked, none included: block. Some: redact. The provenance is
    exploded and joined, so the blocked set may be of any size.
    """
    any_blocked = blocked.limit(1).agg((F.count("*") > 0).alias("_any"))  # one row
    each = rows.select(key, F.posexplode(doc_ids).alias("_pos", "doc_id")).join(blocked.select("doc_id").distinct().withColumn("_b", F.lit(True)), "doc_id", "left")
    folded = each.groupBy(key).agg(
        F.count_if(F.col("_b").isNotNull()).alias("_blocked"), F.count("*").alias("_n"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_b").isNull(), F.struct("_pos", "doc_id")))), lambda x: x["doc_id"]).alias("open_ids"),
    )
    verdict = F.when(~F.col("_any"), "pass").when(F.coalesce("_n", F.lit(0)) == F.coalesce("_blocked", F.lit(0)), "block").when(F.col("_blocked") > 0, "redact").otherwise("pass")
    out = rows.join(folded, key, "left").crossJoin(F.broadcast(any_blocked))
    return out.withColumn("verdict", verdict).withColumn("open_ids", F.coalesce("open_ids", F.array().cast(rows.schema[doc_ids].dataType))).drop("_any", "_blocked", "_n")


def released_events(rows: DataFrame, blocked: DataFrame, key: str, events: str = "events") -> DataFrame:
    """key, events: those of released documents only; events without a document go, also on a pass."""
    b = blocked.select("doc_id").distinct()
    each = rows.select(key, F.posexplode(events).alias("_pos", "_e")).withColumn("doc_id", F.col("_e.doc_id")).where("doc_id is not null").join(b, "doc_id", "left_anti")
    return each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_e"))), lambda x: x["_e"]).alias(events))


def release(rows: DataFrame, blocked: DataFrame, key: str) -> DataFrame:
    """Rows that may be shown: blocked ones gone, redacted ones without description, timeline, keywords and degree,
    provenance and events filtered, first and last seen from the events that are left."""
    judged = verdicts(rows, blocked, key).where("verdict <> 'block'")
    has = set(rows.columns)
    if "events" in has:
        judged = judged.drop("events").join(released_events(rows, blocked, key), key, "left").withColumn("events", F.coalesce("events", F.array().cast(rows.schema["events"].dataType)))
    cut = F.col("verdict") == "redact"
    changes = {"doc_ids": F.when(cut, F.col("open_ids")).otherwise(F.col("doc_ids"))}
    for c, empty in (("description", F.lit("")), ("degree", F.lit(None)), ("timeline", F.array()), ("keywords", F.array())):
        if c in has:
            changes[c] = F.when(cut, empty.cast(rows.schema[c].dataType)).otherwise(F.col(c))
    if "events" in has:
        ats = F.transform("events", lambda e: e["at"])
        for c, f in (("first_seen", F.array_min), ("last_seen", F.array_max)):
            if c in has:
                changes[c] = F.when(cut, F.coalesce(f(ats), F.lit(""))).otherwise(F.col(c))
    return judged.withColumns(changes).drop("open_ids")


def candidates(rows: DataFrame, blocked: DataFrame, key: str, cap: int = S.CANDIDATE_CAP) -> DataFrame:
    """The released rows of highest degree: the gate comes before the cut."""
    return verdicts(rows, blocked, key).where("verdict <> 'block'").drop("open_ids").orderBy(F.desc("degree"), key).limit(cap)
