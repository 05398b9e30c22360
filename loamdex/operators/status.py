"""State of a deployment: index against disk, configuration drift, reports, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def index_state(index: DataFrame, disk: DataFrame) -> DataFrame:
    """path, state: fresh, changed, missing on disk, or not indexed."""
    a = index.select("path", F.col("content_hash").alias("_i"))
    b = disk.select("path", F.col("content_hash").alias("_d"))
    state = F.when(F.col("_d").isNull(), "missing").when(F.col("_i").isNull(), "not_indexed").when(F.col("_i") == F.col("_d"), "fresh").otherwise("changed")
    return a.join(b, "path", "full_outer").select("path", state.alias("state"))


def config_drift(built: DataFrame, now: DataFrame) -> DataFrame:
    """key, was, is of settings that differ from those an index was built with."""
    j = built.select("key", F.col("value").alias("was")).join(now.select("key", F.col("value").alias("is")), "key", "full_outer")
    return j.where(~F.col("was").eqNullSafe(F.col("is")))


def systematic_sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """n rows evenly spaced in key order, numbers by value and texts by code points; all rows, if there are no more."""
    from loamdex.operators.index import dense_ids

    size = rows.count()
    if size <= n:
        return rows
    keyed = dense_ids(rows, key, "_i")
    step = F.lit(float(size) / n)
    return keyed.where(F.floor((F.col("_i") + 1) / step) > F.floor(F.col("_i") / step)).drop("_i")


def report(tables: dict[str, DataFrame], docs: DataFrame, entities: DataFrame) -> str:
    """A Markdown report: rows of each table, documents by origin, entities by type. Only counts reach the driver."""
    lines = ["# Index", "", "| table | rows |", "|---|---|", *(f"| {n} | {df.count()} |" for n, df in sorted(tables.items()))]
    for title, df, c in (("Documents by origin", docs, "origin"), ("Entities by type", entities, "type")):
        found = df.groupBy(c).count().orderBy(F.desc("count"), c).collect()
        lines += ["", f"## {title}", "", *(f"- {r[c]}: {r['count']}" for r in found)]
    return "\n".join(lines) + "\n"


def group_index(nodes: DataFrame, group: str, order: str) -> DataFrame:
    """Adds group_index: groups numbered from 0 by first appearance, "Other" last."""
    first = nodes.groupBy(group).agg(F.min(order).alias("_f"))
    by = Window.partitionBy(F.lit(1)).orderBy(F.when(F.col(group) == "Other", 1).otherwise(0), "_f", group)  # a row a group
    return nodes.join(first.select(group, (F.row_number().over(by) - 1).alias("group_index")), group)


def community_labels(members: DataFrame, nodes: DataFrame, n: int = 3) -> DataFrame:
    """community, n, label: the names of its best connected members."""
    j = members.join(nodes.select("id", "name", "degree"), "id")
    place = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("degree"), "id"))
    kept = j.withColumn("p", place)
    return kept.groupBy("community").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("p") <= n, F.struct("p", "name")))), lambda x: x["name"]), ", ").alias("label"))


def binary_payload(places: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: positions, types and edges of a cut graph as base64 of JSON arrays, by node index."""
    at = Window.partitionBy(F.lit(1)).orderBy("id")
    n = places.withColumn("_i", F.row_number().over(at) - 1)
    pos = n.agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", F.array("x", "y", "z").alias("p")))), lambda v: v["p"]).alias("pos"))
    e = edges.join(n.select(F.col("id").alias("src"), F.col("_i").alias("a")), "src").join(n.select(F.col("id").alias("dst"), F.col("_i").alias("b")), "dst")
    pairs = e.agg(F.array_sort(F.collect_list(F.array("a", "b"))).alias("edges"))
    code = lambda c: F.base64(F.to_json(F.struct(c)).cast("binary")).alias(c)
    return pos.crossJoin(pairs).select(code("pos"), code("edges"))  # one row each


def group_nodes(rows: DataFrame, canon: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entity and relation mentions of extraction rows (doc, idx, entities, relationships), names by canon, in order."""
    c = canon.select(F.col("name").alias("_n"), "canon")
    e = rows.select("doc", "idx", F.posexplode("entities").alias("ord", "e")).select("doc", "idx", "ord", F.lower(F.btrim("e.name")).alias("_n"), "e.name", "e.type", "e.description")
    r = rows.select("doc", "idx", F.posexplode("relationships").alias("ord", "r")).select("doc", "idx", "ord", F.lower(F.btrim("r.source")).alias("_s"), F.lower(F.btrim("r.target")).alias("_t"), "r.keywords", "r.description")
    named = e.join(c, "_n", "left").select("doc", "idx", "ord", F.coalesce("canon", "_n").alias("key"), "name", "type", "description")
    ends = r.join(c.select(F.col("_n").alias("_s"), F.col("canon").alias("_cs")), "_s", "left").join(c.select(F.col("_n").alias("_t"), F.col("canon").alias("_ct")), "_t", "left")
    return named, ends.select("doc", "idx", "ord", F.coalesce("_cs", "_s").alias("source"), F.coalesce("_ct", "_t").alias("target"), "keywords", "description")
