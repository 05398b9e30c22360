"""Media links: which entity a file shows, on what basis, and the manifest of files by content."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from loamdex.functions import text as X

# Bases of a link, weakest first.
BASES = ("ocr", "section", "caption", "sidecar")


def basis_rank(basis: str = "basis"):
    return F.coalesce(F.array_position(F.array(*[F.lit(b) for b in BASES]), F.col(basis)), F.lit(0))


def name_links(texts: DataFrame, names: DataFrame, n: int = 24) -> DataFrame:
    """sha, entity, basis of names that stand in a media text as whole words.

    Texts (sha, basis, text) and names meet on words first: a name is looked for only where its first word stands.
    """
    words = texts.select("sha", "basis", "text", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^0-9a-z_]+"))).alias("_w")).where("_w <> ''")
    named = names.select("entity", F.element_at(F.filter(F.split(F.lower("entity"), r"[^0-9a-z_]+"), lambda w: w != ""), 1).alias("_w"))
    return words.join(named, "_w").where(X.occurs(F.col("entity"), F.col("text"))).select("sha", "entity", "basis").distinct()


def generic_names(links: DataFrame, frequency: DataFrame) -> DataFrame:
    """OCR links without names that stand in over five times as many texts as the entity has documents."""
    j = links.join(frequency.select("entity", "texts", "docs"), "entity", "left")
    return j.where((F.col("basis") != "ocr") | (F.coalesce("texts", F.lit(0)) <= 5 * F.greatest(F.coalesce("docs", F.lit(0)), F.lit(1)))).drop("texts", "docs")


def strongest(links: DataFrame, keys: tuple[str, ...] = ("sha", "entity")) -> DataFrame:
    """The strongest basis of each link; equal ones to the higher score, then the first document."""
    rest = [c for c in links.columns if c not in keys]
    order = F.struct(basis_rank(), *[F.col(c) for c in ("score",) if c in rest])
    return links.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_l")).select(*keys, "_l.*")


def manifest(files: DataFrame, links: DataFrame) -> DataFrame:
    """sha, paths, entities (by score, then name): files of one content are one medium."""
    f = files.groupBy("sha").agg(F.sort_array(F.collect_set("path")).alias("paths"), F.max("taken_at").alias("taken_at"))
    e = strongest(links).groupBy("sha").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "entity"))), lambda x: x["entity"]).alias("entities"))
    return f.join(e, "sha", "left")


def best_media(links: DataFrame, cap: int = 12) -> DataFrame:
    """The media of each entity by score, then date, at most ``cap``."""
    place = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("score"), F.desc("taken_at"), "sha"))
    return links.withColumn("place", place).where(F.col("place") <= cap)


def embed_targets(refs: DataFrame, files: DataFrame) -> DataFrame:
    """note, ref, path of embedded files: beside the note, then from the root, then by name, nearest folder and shortest path first."""
    f = files.select("path", X.basename("path").alias("_base"))
    r = refs.withColumns({"_dir": F.regexp_replace("note", r"[^/]*$", ""), "_base": X.basename("ref")})
    j = r.join(f, "_base")
    kind = F.when(F.col("path") == F.concat("_dir", "ref"), 0).when(F.col("path") == F.col("ref"), 1).when(F.col("path").endswith(F.concat(F.lit("/"), F.col("ref"))), 2).otherwise(3)
    near = F.when(F.col("path").startswith(F.col("_dir")), 0).otherwise(1)
    order = Window.partitionBy("note", "ref").orderBy(kind, near, F.length("path"), "path")
    return j.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("note", "ref", "path")
