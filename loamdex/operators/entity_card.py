"""Entity cards: names asked for are resolved, gated and described in one job, with an error contract."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window, functions as F

from loamdex import schema as S
from loamdex.functions import text as X
from loamdex.operators import gate, lookup
from loamdex.session import stored

#: Letters of the parts by which asked names meet the names that contain them.
PART = 3


def clamp(value, low: int, high: int, default: int) -> int:
    """A limit within its bounds; what is no number gives the default."""
    try:
        return max(low, min(int(value), high))
    except (TypeError, ValueError, OverflowError):
        return default


def containing(asked: DataFrame, names: DataFrame) -> DataFrame:
    """asked, entity_id, name, degree of names (_q) that contain what was asked (_q); blank ones are in no name.

    They meet on that part of PART letters (all letters, where fewer were asked) which fewest names have.
    """
    q = asked.where("_q <> ''").withColumn("_g", F.least(F.lit(PART), F.char_length("_q")))
    sizes = sorted(r["_g"] for r in q.select("_g").distinct().collect())  # PART numbers at most
    cut = lambda size: F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length("_q") - size + 1), lambda i: F.substring(F.col("_q"), i, F.lit(size))))
    parts = F.concat(F.array().cast("array<string>"), *[F.when(F.char_length("_q") >= s, cut(s)).otherwise(F.array().cast("array<string>")) for s in sizes])
    own = F.concat(F.array().cast("array<string>"), *[F.when(F.col("_g") == s, cut(s)).otherwise(F.array().cast("array<string>")) for s in sizes])
    of_names = names.select("entity_id", F.explode(parts).alias("_part"))
    of_asked = q.select("asked", "_q", F.explode(own).alias("_part"))
    held = of_names.join(of_asked.select("_part").distinct(), "_part", "left_semi").groupBy("_part").agg(F.count("*").alias("_n"))
    rarest = of_asked.join(held, "_part", "left").groupBy("asked", "_q").agg(F.min_by("_part", F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_part")).alias("_part"))
    met = rarest.join(of_names, "_part").select("asked", "_q", "entity_id")
    full = names.select("entity_id", "name", "degree", F.col("_q").alias("_name"))
    return met.join(full, "entity_id").where(F.contains("_name", "_q")).select("asked", "entity_id", "name", "degree")


def resolve_all(names: DataFrame, asked: DataFrame) -> DataFrame:
    """asked, entity_id, name, degree, tier for every row of ``asked``: by the normalised name (1), else by the merge key
    (2), else all names that contain it (3). Three joins for all that is asked; names that nothing matches have no row."""
    fold = lambda c: F.lower(X.norm_name(c))
    q = asked.select(F.coalesce("asked", F.lit("")).alias("asked")).distinct().withColumns({"_q": fold("asked"), "_k": X.merge_key("asked", True)})
    n = names.select("entity_id", "name", "degree").withColumns({"_q": fold("name"), "_k": X.merge_key("name", True)})
    found = ["asked", "entity_id", "name", "degree"]
    tiers = [q.where("_q <> ''").select("asked", "_q").join(n, "_q").select(found), q.where("_k <> ''").select("asked", "_k").join(n, "_k").select(found), containing(q, n)]
    rows = tiers[0].withColumn("tier", F.lit(1))
    for i, t in enumerate(tiers[1:], 2):
        rows = rows.unionByName(t.withColumn("tier", F.lit(i)))
    best = rows.groupBy("asked").agg(F.min("tier").alias("tier"))
    return rows.join(best, ["asked", "tier"]).select(*found, "tier")


def cards(entities: DataFrame, asked: DataFrame, docs: DataFrame, blocked: DataFrame, as_of: str | None = None, cap: int = S.CANDIDATE_CAP, docs_cap: int = S.DOCS_CAP) -> DataFrame:
    """A row for each distinct name asked: asked, error, matched, type, degree, description, first_seen, change_count,
    latest_change, changes_after, not_yet, events_total, docs, total, truncated, candidates, hint.

    A row with an error is no answer, one without is: ``bad_date``, ``graph_empty`` (there are no entities at all),
    ``name_not_found`` (the candidates, if any, contain what was asked), ``blocked`` (all provenance is). Rows that the
    gate cuts show what release() leaves of them, and blocked entities are no candidates. Among equal names the one of
    highest degree counts, then the smaller id. Null names are blank. With ``as_of`` changes are counted up to that day.
    """
    bad = bool(as_of) and not re.fullmatch(r"\d{4}-\d{2}-\d{2}", as_of)
    cap, docs_cap = clamp(cap, 1, 50, S.CANDIDATE_CAP), clamp(docs_cap, 1, 100, S.DOCS_CAP)
    found = stored(resolve_all(entities, asked), "card-matches")  # read by the gate, the answers and the candidates
    judged = gate.verdicts(entities.join(found.select("entity_id").distinct(), "entity_id", "left_semi").select("entity_id", "doc_ids"), blocked, "entity_id").select("entity_id", "verdict")
    judged = found.join(judged, "entity_id").where("tier < 3 or verdict <> 'block'")
    placed = judged.withColumn("place", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("degree"), "entity_id"))).where(f"place <= {cap}")
    placed = stored(placed, "card-places")
    hits = placed.where("tier < 3 and place = 1").select("asked", "entity_id", F.col("verdict").alias("_verdict"))
    few = placed.where("tier = 3").groupBy("asked").agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("_c"))
    shown = stored(gate.release(entities.join(hits.select("entity_id").distinct(), "entity_id", "left_semi"), blocked, "entity_id"), "card-entities")
    when = lookup.as_of(shown, as_of if as_of and not bad else "9999-12-31").select("entity_id", "change_count", "latest_change", "changes_after", "not_yet")
    owned = lookup.docs_of(shown, docs, "entity_id", docs_cap).select("entity_id", "docs", "total", "truncated")
    body = shown.select("entity_id", X.safe_name("name").alias("matched"), X.safe_name("type", 40).alias("type"), "degree", "description", "first_seen", F.size("events").alias("events_total"))
    some = entities.limit(1).agg((F.count("*") > 0).alias("_some"))  # one row
    rows = asked.select(F.coalesce("asked", F.lit("")).alias("asked")).distinct().join(hits, "asked", "left").join(few, "asked", "left").crossJoin(F.broadcast(some))
    rows = rows.join(body, "entity_id", "left").join(when, "entity_id", "left").join(owned, "entity_id", "left")
    error = F.when(F.lit(bad), "bad_date").when(~F.col("_some"), "graph_empty").when(F.col("entity_id").isNull(), "name_not_found").when(F.col("_verdict") == "block", "blocked")
    candidates = F.coalesce(F.transform("_c", lambda c: c["name"]), F.array().cast("array<string>"))
    hint = F.when(error == "bad_date", "dates are written YYYY-MM-DD").when(error == "graph_empty", "there are no entities yet: extract and index first").when(error == "blocked", "its documents are not released")
    hint = hint.when(error == "name_not_found", F.when(F.size(candidates) > 0, "ask for one of the candidates as it is written").otherwise("no name contains this: search for it first"))
    answer = ["matched", "type", "degree", "description", "first_seen", "change_count", "latest_change", "changes_after", "not_yet", "events_total", "docs", "total", "truncated"]
    out = rows.withColumns({"error": error, "candidates": F.when(F.lit(bad), F.array().cast("array<string>")).otherwise(candidates), "hint": hint})
    return out.select("asked", "error", *[F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in answer], "candidates", "hint")
