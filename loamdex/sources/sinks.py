"""Sinks: versioned tables with meta last, graph exports, notes, scrubbed copies, index pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loamdex.functions import text as X
from loamdex.operators.sync import guard_shrink


def publish(tables: dict[str, DataFrame], root: str, version: str, meta: dict[str, str], previous: dict[str, int | None] | None = None) -> str:
    """Write all tables of a version, guarded against shrinking, and meta last: its presence marks a whole version."""
    spark = next(iter(tables.values())).sparkSession
    where = f"{root.rstrip('/')}/{version}"
    for name, df in tables.items():
        out = df.write.mode("overwrite")
        (out.partitionBy("origin") if "origin" in df.columns else out).parquet(f"{where}/{name}")
        if previous and name in previous:
            guard_shrink(spark.read.parquet(f"{where}/{name}").count(), previous[name])
    spark.createDataFrame(list(meta.items()), "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{where}/meta")
    return where


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON line per node and edge, for graphs of any size."""
    n = nodes.select(F.to_json(F.struct(F.lit("node").alias("kind"), *nodes.columns)).alias("value"))
    return n.unionByName(edges.select(F.to_json(F.struct(F.lit("edge").alias("kind"), *edges.columns)).alias("value")))


def viewer_json(nodes: DataFrame, edges: DataFrame, built_at: str, least_degree: int) -> DataFrame:
    """One row, one JSON document: nodes by degree, edges as pairs of node indexes. For cut graphs."""
    place = F.row_number().over(Window.orderBy(F.desc("degree"), "id")) - 1
    n = nodes.withColumn("_i", place)
    e = edges.join(n.select(F.col("id").alias("src"), F.col("_i").alias("a")), "src").join(n.select(F.col("id").alias("dst"), F.col("_i").alias("b")), "dst")
    entities = n.agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", F.struct("id", "name", "type", "degree").alias("e")))), lambda x: x["e"]).alias("entities"))
    relations = e.agg(F.array_sort(F.collect_list(F.array("a", "b"))).alias("relations"))
    row = entities.crossJoin(relations)  # one row each
    return row.select(F.to_json(F.struct(F.lit(1).alias("version"), F.lit(built_at).alias("built_at"), F.lit(least_degree).alias("min_degree"), "entities", "relations")).alias("value"))


def _xml(c):
    c = F.coalesce(F.col(c).cast("string"), F.lit("")) if isinstance(c, str) else c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """ord, value: lines of a GraphML document, in order."""
    spark = nodes.sparkSession
    lines = lambda rows: spark.createDataFrame(rows, "ord int, value string")
    head = lines([(0, '<?xml version="1.0" encoding="UTF-8"?>'), (1, '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">'), (2, '<graph edgedefault="undirected">')])
    n = nodes.select(F.lit(3).alias("ord"), F.concat(F.lit('<node id="n'), "id", F.lit('"><data key="label">'), _xml("name"), F.lit("</data></node>")).alias("value"))
    e = edges.select(F.lit(4).alias("ord"), F.concat(F.lit('<edge source="n'), "src", F.lit('" target="n'), "dst", F.lit('"/>')).alias("value"))
    return head.unionByName(n).unionByName(e).unionByName(lines([(5, "</graph>"), (6, "</graphml>")]))


def entity_notes(entities: DataFrame, relations: DataFrame, docs: DataFrame, most: int = 40) -> DataFrame:
    """entity_id, name, note: a Markdown note per entity with its relations, the best connected first, and its sources."""
    both = relations.select(F.col("src_id").alias("entity_id"), F.col("tgt_id").alias("other_id")).unionByName(relations.select(F.col("tgt_id").alias("entity_id"), F.col("src_id").alias("other_id")))
    other = entities.select(F.col("entity_id").alias("other_id"), F.col("name").alias("other"), F.col("degree").alias("od"))
    place = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("od"), "other_id"))
    rel = both.distinct().join(other, "other_id").withColumn("_p", place).where(F.col("_p") <= most)
    rel = rel.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "other"))), lambda x: F.concat(F.lit("- [["), x["other"], F.lit("]]"))).alias("_rel"))
    src = entities.select("entity_id", F.explode("doc_ids").alias("doc_id")).join(docs.select("doc_id", "title"), "doc_id")
    src = src.groupBy("entity_id").agg(F.array_sort(F.collect_set(F.concat(F.lit("- "), "title"))).alias("_src"))
    none = F.array().cast("array<string>")
    note = F.concat(F.lit("# "), "name", F.lit("\n\n"), F.coalesce("description", F.lit("")), F.lit("\n\n## Relations\n"), F.array_join(F.coalesce("_rel", none), "\n"), F.lit("\n\n## Sources\n"), F.array_join(F.coalesce("_src", none), "\n"))
    return entities.join(rel, "entity_id", "left").join(src, "entity_id", "left").select("entity_id", X.safe_name("name").alias("name"), note.alias("note"))


def scrubbed(tables: dict[str, DataFrame], blocked: DataFrame) -> dict[str, DataFrame]:
    """A copy that may leave: rows of blocked documents gone, columns of rows with some blocked provenance blanked,
    index tables and local paths left out."""
    from loamdex.operators import gate

    keys = {"lr_entities": "entity_id", "lr_relations": "rel_id"}
    out = {}
    for name, df in tables.items():
        if name.startswith("ix_"):
            continue
        if name in keys:
            df = gate.release(df, blocked, keys[name]).drop("verdict")
        elif "doc_id" in df.columns:
            df = df.join(blocked.select("doc_id"), "doc_id", "left_anti")
        elif name == "meta":
            df = df.where("key <> 'vault_path'")
        out[name] = df.withColumn("abs_path", F.lit("")) if "abs_path" in df.columns else df
    return out


def index_pages(paths: DataFrame) -> DataFrame:
    """dir, entries, page: an index page of each directory and all above it; entries are files, then directories as dir/."""
    parts = F.split("path", "/")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i - 1), "/").alias("dir"), F.concat(F.get(parts, i - 1), F.when(i < F.size(parts), F.lit("/")).otherwise(F.lit(""))).alias("entry")))
    each = paths.select(F.inline(steps)).distinct()
    pages = each.groupBy("dir").agg(F.array_sort(F.collect_list("entry")).alias("entries"))
    return pages.withColumn("page", F.concat(F.lit("# "), F.when(F.col("dir") == "", "/").otherwise(F.col("dir")), F.lit("\n\n"), F.array_join(F.transform("entries", lambda e: F.concat(F.lit("- ["), e, F.lit("]("), e, F.lit(")"))), "\n")))


def corpus_map(docs: DataFrame, types: int = 10, projects: int = 15, tags: int = 20) -> DataFrame:
    """kind, name, n: the most frequent types, projects and tags."""
    by = lambda kind, c, k: docs.select(c.alias("name")).where("name is not null and name <> ''").groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(k).select(F.lit(kind).alias("kind"), "name", "n")
    return by("type", F.col("doc_type"), types).unionByName(by("project", F.col("project"), projects)).unionByName(by("tag", F.explode(F.array_distinct("tags")), tags))


def capped_rows(rows: DataFrame, entities: int = 20, relationships: int = 25) -> DataFrame:
    """Extraction rows cut to shape: the first entities, then relationships between names among them."""
    e = F.slice("entities", 1, entities)
    names = F.transform("entities", lambda x: F.lower(F.btrim(x["name"])))
    known = F.filter("relationships", lambda r: F.array_contains(names, F.lower(F.btrim(r["source"]))) & F.array_contains(names, F.lower(F.btrim(r["target"]))))
    return rows.withColumn("entities", e).withColumn("relationships", F.slice(known, 1, relationships))


def okf_document(docs: DataFrame) -> DataFrame:
    """doc_id, path, value: each document with a frontmatter of title, type, date and source."""
    q = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r'(["\\])', r"\\$1"), F.lit('"'))
    head = F.concat(F.lit("---\ntitle: "), q("title"), F.lit("\ntype: "), q("doc_type"), F.lit("\ncreated: "), q("doc_date"), F.lit("\nsource: "), q("source_url"), F.lit("\n---\n\n"))
    return docs.select("doc_id", "path", F.concat(head, "text").alias("value"))


def link_index(files: DataFrame) -> DataFrame:
    """key, path: the shortest path (then the first) of each note name, as written and in lower case."""
    name = F.regexp_replace(X.basename("path"), r"\.md$", "")
    keys = files.select("path", F.explode(F.array_distinct(F.array(name, F.lower(name), F.regexp_replace("path", r"\.md$", "")))).alias("key"))
    return keys.groupBy("key").agg(F.min_by("path", F.struct(F.length("path"), "path")).alias("path"))


def resolved_links(notes: DataFrame, index: DataFrame) -> DataFrame:
    """src, target, dst (null: unresolved), n of the wiki links of notes (path, text)."""
    each = notes.select(F.col("path").alias("src"), F.explode(X.wikilinks("text")).alias("target")).groupBy("src", "target").agg(F.count("*").alias("n"))
    exact = index.select(F.col("key").alias("target"), F.col("path").alias("_a"))
    lower = index.select(F.col("key").alias("_low"), F.col("path").alias("_b"))
    return each.join(exact, "target", "left").withColumn("_low", F.lower("target")).join(lower, "_low", "left").select("src", "target", F.coalesce("_a", "_b").alias("dst"), "n")


def drop_old_versions(spark: SparkSession, root: str, keep: str, older_than_ms: int) -> list[str]:
    """Delete version folders older than a time, but the one kept; names of those deleted."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = []
    for s in fs.listStatus(path):
        name = s.getPath().getName()
        if s.isDirectory() and name != keep and s.getModificationTime() < older_than_ms:
            fs.delete(s.getPath(), True)
            gone.append(name)
    return sorted(gone)
