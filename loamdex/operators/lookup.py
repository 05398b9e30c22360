"""Name, time and provenance lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from loamdex import schema as S
from loamdex.functions import text as X


def docs_of(rows: DataFrame, docs: DataFrame, key: str, cap: int = S.DOCS_CAP) -> DataFrame:
    """key, docs (newest first, at most cap), total, truncated, all_ids (null unless truncated) of released documents."""
    known = docs.select("doc_id", "title", X.effective_date("doc_date", "doc_updated").alias("at")) if "doc_updated" in docs.columns else docs.select("doc_id", "title", F.col("doc_date").alias("at"))
    each = rows.select(key, F.explode("doc_ids").alias("doc_id")).distinct().join(known, "doc_id")
    order = Window.partitionBy(key).orderBy(F.desc("at"), "doc_id")
    placed = each.withColumn("_place", F.row_number().over(order))
    first = F.array_sort(F.collect_list(F.when(F.col("_place") <= cap, F.struct("_place", "doc_id", "title", "at"))))
    out = placed.groupBy(key).agg(first.alias("_first"), F.count("*").alias("total"), F.sort_array(F.collect_list("doc_id")).alias("_all"))
    return out.select(key, F.transform("_first", lambda d: F.struct(d["doc_id"].alias("doc_id"), d["title"].alias("title"), d["at"].alias("at"))).alias("docs"), "total", (F.col("total") > cap).alias("truncated"), F.when(F.col("total") > cap, F.col("_all")).alias("all_ids"))


def refs_of(docs: DataFrame, sources: DataFrame, notes: DataFrame) -> DataFrame:
    """doc_id, slug, status, url: document to source slug to source note to address; ok, unresolved or none."""
    joined = docs.select("doc_id").join(sources.select("doc_id", "slug"), "doc_id", "left").join(notes.select("slug", "url"), "slug", "left")
    status = F.when(F.col("slug").isNull(), "none").when(X.external_url("url").isNull(), "unresolved").otherwise("ok")
    return joined.select("doc_id", "slug", status.alias("status"), X.external_url("url").alias("url"))


def resolve(names: DataFrame, asked: str, cap: int = S.CANDIDATE_CAP) -> DataFrame:
    """entity_id, name, how: the exact normalised name, else the merge key, else parts of names by degree."""
    q = X.norm_name(F.lit(asked))
    tier = F.when(F.lower("name_norm") == F.lower(q), 1).when(X.merge_key("name", True) == X.merge_key(F.lit(asked), True), 2).when(F.lower("name").contains(F.lower(q)), 3)
    hits = names.withColumn("_tier", tier).where("_tier is not null").orderBy("_tier", F.desc("degree"), "entity_id").limit(cap)
    best = hits.agg(F.min("_tier").alias("_best"))
    how = F.element_at(F.array(F.lit("exact"), F.lit("key"), F.lit("candidate")), F.col("_tier"))
    place = F.row_number().over(Window.orderBy(F.desc("degree"), "entity_id"))  # of at most cap rows
    found = hits.crossJoin(F.broadcast(best)).where("_tier = _best").withColumn("_place", place)
    return found.where((F.col("_tier") == 3) | (F.col("_place") == 1)).select("entity_id", "name", how.alias("how"))


def events_between(events: str, since: str | None = None, until: str | None = None, cap: int = 20) -> tuple:
    """Columns: the newest ``cap`` events in the range (ends included), and how many there are."""
    found = F.filter(events, lambda e: (F.lit(True) if since is None else e["at"] >= since) & (F.lit(True) if until is None else e["at"] <= until))
    n = F.size(found)
    return F.slice(found, F.greatest(n - cap, F.lit(0)) + 1, F.lit(cap)), n


def as_of(entities: DataFrame, date: str) -> DataFrame:
    """change_count and latest_change up to a date, changes_after it, and whether the entity was not yet known."""
    upto = F.filter("timeline", lambda c: c["at"] <= date)
    return entities.select(
        "entity_id", F.size(upto).alias("change_count"), F.array_max(F.transform(upto, lambda c: c["at"])).alias("latest_change"),
        (F.size("timeline") - F.size(upto)).alias("changes_after"), (F.col("first_seen") > date).alias("not_yet"), "description",
    )


def neighbours(relations: DataFrame, entities: DataFrame, entity: DataFrame, least_degree: int = 0, cap: int = S.NEIGHBOUR_CAP) -> DataFrame:
    """entity_id, other_id, other, degree, place: relations from either side as two equi-joins, by degree of the other end."""
    pairs = relations.select(F.col("src_id").alias("entity_id"), F.col("tgt_id").alias("other_id")).unionByName(relations.select(F.col("tgt_id").alias("entity_id"), F.col("src_id").alias("other_id")))
    found = pairs.join(entity.select("entity_id"), "entity_id", "left_semi").distinct()
    others = entities.select(F.col("entity_id").alias("other_id"), F.col("name").alias("other"), "degree").where(F.col("degree") >= least_degree)
    place = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("degree"), "other_id"))
    return found.join(others, "other_id").withColumn("place", place).where(F.col("place") <= cap).select("entity_id", "other_id", "other", "degree", "place")


def document_text(chunks: DataFrame, doc: DataFrame, size: int = S.CHUNK_SIZE, overlap: int = S.CHUNK_OVERLAP) -> DataFrame:
    """doc_id, text: a document put together from its chunks, overlaps cut."""
    own = chunks.join(doc.select("doc_id"), "doc_id", "left_semi")
    part = F.when(F.col("seq") == 0, F.col("text")).otherwise(F.expr(f"substring(text, {overlap} + 1)"))
    parts = own.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", part.alias("text")))).alias("_p"))
    return parts.select("doc_id", F.array_join(F.transform("_p", lambda p: p["text"]), "").alias("text"))


def stats(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """kind, name, n: documents by origin and by agent, entities by type, in one frame."""
    by = lambda df, kind, c: df.groupBy(F.col(c).cast("string").alias("name")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    parts = [by(docs, "origin", "origin"), by(entities, "type", "type")]
    if "agent" in docs.columns:
        parts.append(by(docs.where("agent <> ''"), "agent", "agent"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def date_range(docs: DataFrame) -> DataFrame:
    d = F.nullif(F.col("doc_date"), F.lit(""))
    return docs.agg(F.min(d).alias("first"), F.max(d).alias("last"))
