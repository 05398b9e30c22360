"""Incremental maintenance: differences, renames, pending work, stale marks, guarded replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from loamdex import schema as S


def diff(old: DataFrame, new: DataFrame, key: str = "path", compare: tuple[str, ...] = ("content_hash",)) -> DataFrame:
    """key, change (added, deleted, modified, unchanged): one full outer join."""
    o = old.select(key, F.struct(*compare).alias("_o"))
    n = new.select(key, F.struct(*compare).alias("_n"))
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "deleted").when(~F.col("_o").eqNullSafe(F.col("_n")), "modified").otherwise("unchanged")
    return o.join(n, key, "full_outer").select(key, change.alias("change"))


def renames(old: DataFrame, new: DataFrame, key: str = "path", content: str = "content_hash") -> DataFrame:
    """old_path, new_path: vanished and new paths of equal content, paired in order within a content."""
    gone = old.join(new.select(key), key, "left_anti").select(F.col(key).alias("old_path"), F.col(content).alias("_c"))
    came = new.join(old.select(key), key, "left_anti").select(F.col(key).alias("new_path"), F.col(content).alias("_c"))
    gone = gone.withColumn("_r", F.row_number().over(Window.partitionBy("_c").orderBy("old_path")))
    came = came.withColumn("_r", F.row_number().over(Window.partitionBy("_c").orderBy("new_path")))
    return gone.join(came, ["_c", "_r"]).select("old_path", "new_path")


def rescue(deleted: DataFrame, unreadable: DataFrame, key: str = "path") -> DataFrame:
    """Deletions that are none: files that are there but cannot be read."""
    return deleted.join(unreadable.select(key), key, "left_anti")


def upsert(table: DataFrame, changed: DataFrame, gone: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """The next version of a table: changed rows replace those of their key, gone keys leave."""
    kept = table.join(changed.select(key).distinct(), key, "left_anti")
    if gone is not None:
        kept = kept.join(gone.select(key), key, "left_anti")
    return kept.unionByName(changed)


def guard_shrink(new: int, old: int | None, least: float = S.SHRINK_GUARD) -> None:
    """Refuse a replacement that lost too many rows; an earlier table that could not be read (None) refuses too."""
    if old is None:
        raise ValueError("the earlier table cannot be read")
    if new < least * old:
        raise ValueError(f"{new} rows would replace {old}")


def pending(chunks: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("doc", "idx", "h", "pv")) -> DataFrame:
    return chunks.join(done.select(*keys).distinct(), list(keys), "left_anti")


def history(rows: DataFrame, live: DataFrame) -> DataFrame:
    """Cached rows whose text is not live but whose place (doc, idx) is."""
    return rows.join(live.select("doc", "idx", "h").distinct(), ["doc", "idx", "h"], "left_anti").join(live.select("doc", "idx").distinct(), ["doc", "idx"], "left_semi")


def scope_gap(indexed: DataFrame, extracted: DataFrame, deliberate: DataFrame, key: str = "path") -> DataFrame:
    """key, side: indexed but not extracted (nor left out on purpose), and extracted but not indexed."""
    missing = indexed.select(key).join(extracted.select(key), key, "left_anti").join(deliberate.select(key), key, "left_anti").distinct()
    extra = extracted.select(key).join(indexed.select(key), key, "left_anti").distinct()
    return missing.withColumn("side", F.lit("not_extracted")).unionByName(extra.withColumn("side", F.lit("not_indexed")))


def prune(rows: DataFrame, live: DataFrame, key: str, doc_ids: str = "doc_ids") -> DataFrame:
    """Rows with dead document ids dropped from their provenance, in order; rows left with none go."""
    each = rows.select(key, F.posexplode(doc_ids).alias("_p", "doc_id")).join(live.select("doc_id").distinct(), "doc_id", "left_semi")
    kept = each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "doc_id"))), lambda x: x["doc_id"]).alias(doc_ids))
    return rows.drop(doc_ids).join(kept, key)


def drift(snapshot: DataFrame, docs: DataFrame) -> DataFrame:
    """path, reason of documents whose hash differs from the snapshot's; vanished paths are reported as missing."""
    j = snapshot.select("path", F.col("content_hash").alias("_was")).join(docs.select("path", F.col("content_hash").alias("_is")), "path", "left")
    return j.select("path", F.when(F.col("_is").isNull(), "missing").when(F.col("_is") != F.col("_was"), "modified").alias("reason")).where("reason is not null")


def stale_latest(marks: DataFrame) -> DataFrame:
    """The last mark of each document."""
    return marks.groupBy("doc_id").agg(F.max_by(F.struct("path", "reason", "marked_at"), F.struct("marked_at", "reason")).alias("m")).select("doc_id", "m.*")


def stale_summary(marks: DataFrame, documents: int) -> DataFrame:
    """reason, n, ratio of all documents."""
    return stale_latest(marks).groupBy("reason").agg(F.count("*").alias("n")).withColumn("ratio", F.col("n") / F.lit(float(max(1, documents))))


def carry_marks(at_start: DataFrame, now: DataFrame, drifted: DataFrame) -> DataFrame:
    """Marks after a build: those made while it ran stay, and drifted documents without one get theirs."""
    kept = now.join(at_start.select("doc_id", "marked_at"), ["doc_id", "marked_at"], "left_anti")
    return kept.unionByName(drifted.join(kept.select("doc_id"), "doc_id", "left_anti"))


def completeness(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """doc, total, finished, complete."""
    d = done.select("doc", "idx", "h").distinct().withColumn("_d", F.lit(1))
    j = chunks.join(d, ["doc", "idx", "h"], "left")
    return j.groupBy("doc").agg(F.count("*").alias("total"), F.count("_d").alias("finished")).withColumn("complete", F.col("total") == F.col("finished"))
