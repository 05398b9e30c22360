"""Wiki links to Markdown links: found by place, resolved by one join, put back in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loamdex.functions import text as X

# What is a link, and what is code, where a link is left as it stands.
WIKILINK = r"\[\[([^\]|#]+)(?:#([^\]|]+))?(?:\|([^\]]+))?\]\]"
CODE = r"(?s)```.*?(?:```|\z)|`[^`\n]*`"
#: A text is cut at these: code, or a link.
CUT = f"{CODE}|{WIKILINK}"


def pieces(text: str | Column) -> Column:
    """array of (plain, link) in order: what stands before each link, code included, and the link itself; the last link is empty."""
    t = F.coalesce(X.col(text), F.lit(""))
    found = F.regexp_extract_all(t, F.lit(CUT), 0)
    between = F.split(t, CUT, -1)
    # code goes back into what stands around it: it is no link
    both = F.arrays_zip(between.alias("plain"), F.concat(found, F.array(F.lit(""))).alias("link"))
    return F.transform(both, lambda p: F.when(p["link"].startswith("`"), F.struct(F.concat(p["plain"], p["link"]).alias("plain"), F.lit("").alias("link"))).otherwise(p))


def parts(link: Column) -> tuple[Column, Column, Column]:
    """(target, anchor, label) of a wiki link; what is not there is empty."""
    target, anchor, label = (F.regexp_extract(link, WIKILINK, i) for i in (1, 2, 3))
    return F.btrim(target), F.btrim(anchor), label


def unresolved_path(target: Column) -> Column:
    return F.concat(F.lit("/unresolved/"), F.lower(F.btrim(F.regexp_replace(target, r"(?U)[^\w-]+", "-"), F.lit("-"))), F.lit(".md"))


def converted(notes: DataFrame, index: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(notes with wiki links written as Markdown links, links that name nothing): notes (doc_id, text, ...), index (key, path).

    A target is looked up as written, then in lower case. One that names nothing stays a link, under /unresolved/. Code
    spans and fenced code stay as they are. Distinct targets are joined with the index, and each note with its own paths;
    notes of one doc_id, or of none, share theirs.
    """
    rows = notes.withColumn("_pieces", pieces(text))
    links = F.filter("_pieces", lambda p: p["link"] != "")
    named = rows.select("doc_id", F.explode(F.transform(links, lambda p: parts(p["link"])[0])).alias("target")).distinct()
    targets = named.select("target").distinct().withColumn("low", F.lower("target"))
    exact = index.select(F.col("key").alias("target"), F.col("path").alias("a"))
    lower = index.select(F.col("key").alias("low"), F.col("path").alias("b"))
    found = targets.join(exact, "target", "left").join(lower, "low", "left").select("target", F.coalesce("a", "b").alias("path"))
    known = named.join(found, "target")
    paths = known.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("target", F.coalesce("path", unresolved_path(F.col("target")))))).alias("_paths")).withColumnRenamed("doc_id", "_id")

    def written(p: Column) -> Column:
        target, anchor, label = parts(p["link"])
        tail = F.when(anchor != "", F.concat(F.lit("#"), F.regexp_replace(anchor, r"\s+", "-"))).otherwise("")
        shown = F.when(label != "", label).otherwise(target)
        return F.concat(p["plain"], F.when(p["link"] == "", "").otherwise(F.concat(F.lit("["), shown, F.lit("]("), F.try_element_at(F.col("_paths"), target), tail, F.lit(")"))))

    out = rows.join(paths, F.col("doc_id").eqNullSafe(F.col("_id")), "left").withColumn(text, F.when(F.col(text).isNotNull(), F.array_join(F.transform("_pieces", written), "")))
    return out.drop("_pieces", "_paths", "_id"), known.where("path is null").select("doc_id", "target")
