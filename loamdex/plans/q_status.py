"""Suggestions, status and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamdex.operators import graph, resolve, status, suggest
from loamdex.plans import views as V
from loamdex.plans.q_graph import MENTIONS, mentions
from loamdex.plans.registry import query

NODES = f"WITH {V.GRAPH}, nodes AS (SELECT id, id AS name, degree FROM gdeg)"


def nodes(spark, sf):
    return graph.degrees(V.graph(spark, sf)).select("id", F.col("id").alias("name"), "degree")


@query("homonym_signals", "WITH m AS (SELECT doc_id % 50 AS name, doc_id, list_distinct(list_filter(string_split_regex(lower(text), '[^0-9a-z가-힣]+'), lambda w: length(w) >= 2)) AS w FROM documents), f AS (SELECT name, arg_min(w, doc_id) AS f FROM m GROUP BY 1), a AS (SELECT name, count(*) AS docs, count(*) FILTER (WHERE NOT list_has_any(w, f)) AS apart FROM m JOIN f USING (name) GROUP BY 1) SELECT name, docs, apart FROM a WHERE docs >= 2 AND apart >= 0.4 * docs")
def homonym_signals(spark, sf):
    return suggest.homonym_signals(V.table(spark, sf, "documents").selectExpr("doc_id % 50 AS name", "doc_id", "text"))


@query("cue_words", f"WITH {MENTIONS}, c AS (SELECT k AS name, kind AS w, count(*) AS n, min(ord) AS f FROM m GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, f) AS p FROM c) SELECT name, string_agg(w, ',' ORDER BY p) AS cues FROM p WHERE p <= 3 GROUP BY 1")
def cue_words(spark, sf):
    m = mentions(spark, sf).selectExpr("k AS name", "ord", "kind AS text")
    return suggest.cue_words(m, shown=3).withColumn("cues", F.array_join("cues", ","))


@query("weak_aliases")
def weak_aliases(spark, sf):
    return resolve.weak_aliases(V.table(spark, sf, "part").selectExpr("p_partkey AS entity_id", "p_name AS name", "p_brand AS type"))


@query("search_box", f"{NODES}, s AS (SELECT *, CASE WHEN name = 'c12' THEN 4 WHEN starts_with(name, 'c12') THEN 3 WHEN contains(name, 'c12') THEN 2 WHEN levenshtein(name, 'c12') <= 2 THEN 1 END AS fit FROM nodes) SELECT id, name, degree, fit FROM s WHERE fit IS NOT NULL ORDER BY fit DESC, degree DESC, id LIMIT 50")
def search_box(spark, sf):
    return suggest.search_box(nodes(spark, sf), " C12 ")


@query("search_box_hubs", f"{NODES} SELECT id, degree FROM nodes ORDER BY degree DESC, id LIMIT 20")
def search_box_hubs(spark, sf):
    return suggest.search_box(nodes(spark, sf), "").select("id", "degree")


@query("display_names", f"WITH {MENTIONS}, c AS (SELECT k AS key, name AS form, count(*) AS n FROM m GROUP BY 1, 2) SELECT key, form AS name FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, form) = 1")
def display_names(spark, sf):
    return suggest.display_name(mentions(spark, sf).selectExpr("k AS key", "name AS form"))


@query("index_state", f"WITH {V.OLD_NEW} SELECT coalesce(o.path, n.path) AS path, CASE WHEN n.path IS NULL THEN 'missing' WHEN o.path IS NULL THEN 'not_indexed' WHEN o.content_hash = n.content_hash THEN 'fresh' ELSE 'changed' END AS state FROM old_v o FULL JOIN new_v n ON o.path = n.path")
def index_state(spark, sf):
    return status.index_state(*V.versions(spark, sf))


@query("config_drift", "SELECT key, was, \"is\" FROM (VALUES ('b', '0.75', '0.5'), ('new', NULL, '1'), ('old', '2', NULL)) v(key, was, \"is\")")
def config_drift(spark, sf):
    rows = lambda *p: spark.createDataFrame(list(p), "key string, value string")
    return status.config_drift(rows(("k1", "1.2"), ("b", "0.75"), ("old", "2")), rows(("k1", "1.2"), ("b", "0.5"), ("new", "1")))


@query("systematic_sample", "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT doc_id FROM r WHERE floor((i + 1) / (n / 37.0)) > floor(i / (n / 37.0))")
def systematic_sample(spark, sf):
    return status.systematic_sample(V.table(spark, sf, "documents").select("doc_id"), "doc_id", 37)


@query("group_index", "WITH f AS (SELECT lang, min(doc_id) AS f FROM documents GROUP BY 1), g AS (SELECT lang, row_number() OVER (ORDER BY f, lang) - 1 AS group_index FROM f) SELECT doc_id, lang, CAST(group_index AS INTEGER) AS group_index FROM documents JOIN g USING (lang)")
def group_index(spark, sf):
    return status.group_index(V.table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id")


@query("community_labels", f"{NODES}, p AS (SELECT substr(id, 1, 1) AS community, name, row_number() OVER (PARTITION BY substr(id, 1, 1) ORDER BY degree DESC, id) AS p FROM nodes) SELECT community, count(*) AS n, string_agg(CASE WHEN p <= 3 THEN name END, ', ' ORDER BY p) AS label FROM p GROUP BY 1")
def community_labels(spark, sf):
    n = nodes(spark, sf)
    return status.community_labels(n.select("id", F.substring("id", 1, 1).alias("community")), n)


@query("group_nodes", "SELECT n_name AS doc, 'k' AS key, CAST(2 AS BIGINT) AS mentions FROM nation UNION ALL SELECT n_name, lower(n_name), 1 FROM nation")
def group_nodes(spark, sf):
    e = F.array(*[F.struct(n.alias("name"), F.lit("tool").alias("type"), F.lit("").alias("description")) for n in (F.lit("K one"), F.col("n_name"), F.lit("k1"))])
    r = F.array(F.struct(F.lit("K one").alias("source"), F.col("n_name").alias("target"), F.lit("").alias("keywords"), F.lit("").alias("description")))
    rows = V.table(spark, sf, "nation").select(F.col("n_name").alias("doc"), F.lit(0).alias("idx"), e.alias("entities"), r.alias("relationships"))
    canon = spark.sql("SELECT * FROM VALUES ('k one', 'k'), ('k1', 'k') AS t(name, canon)")
    return status.group_nodes(rows, canon)[0].groupBy("doc", "key").agg(F.count("*").alias("mentions"))


@query("binary_payload")
def binary_payload(spark, sf):
    e = graph.subgraph(nodes(spark, sf), V.graph(spark, sf), 1, 300)[1]
    places = graph.carried_places(nodes(spark, sf).where("degree > 1").select("id"), spark.sql("SELECT 'n1' AS id, 0.0D AS x, 0.0D AS y, 0.0D AS z"))
    return status.binary_payload(places, e)
