"""Graph, gate, lookup and entity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamdex.functions import text as X
from loamdex.operators import components, gate, graph, lookup, resolve
from loamdex.plans import views as V
from loamdex.plans.q_search import rounded
from loamdex.plans.registry import query
from loamdex.sources import sinks

VERDICT = f"""{V.ENTITIES}, {V.TOXIC}, each AS (SELECT entity_id, pos, d FROM (SELECT entity_id, unnest(doc_ids) AS d, unnest(range(1, len(doc_ids) + 1)) AS pos FROM ent)),
    f AS (SELECT entity_id, count(*) AS n, count(*) FILTER (WHERE d IN (FROM blocked)) AS b, string_agg(CAST(CASE WHEN d NOT IN (FROM blocked) THEN d END AS VARCHAR), ',' ORDER BY pos) AS open_ids FROM each GROUP BY 1),
    verdicts AS (SELECT entity_id, CASE WHEN n = b THEN 'block' WHEN b > 0 THEN 'redact' ELSE 'pass' END AS verdict, coalesce(open_ids, '') AS open_ids FROM f)"""


@query("gate_verdicts", f"WITH {VERDICT} SELECT * FROM verdicts")
def gate_verdicts(spark, sf):
    v = gate.verdicts(V.entities(spark, sf), V.toxic(spark, sf), "entity_id")
    return v.select("entity_id", "verdict", F.array_join(F.transform("open_ids", lambda d: d.cast("string")), ",").alias("open_ids"))


@query("gate_candidates", f"WITH {VERDICT} SELECT entity_id, degree FROM ent JOIN verdicts USING (entity_id) WHERE verdict <> 'block' ORDER BY degree DESC, entity_id LIMIT 10")
def gate_candidates(spark, sf):
    return gate.candidates(V.entities(spark, sf), V.toxic(spark, sf), "entity_id").select("entity_id", "degree")


EVENTS = """ev AS (SELECT vec_id AS entity_id, d, strftime(DATE '2024-01-01' + CAST(d % 365 AS INTEGER), '%Y-%m-%d') AS dt FROM (SELECT vec_id, unnest([vec_id, vec_id + 100, vec_id * 2 + 1]) AS d FROM embeddings))"""


def with_events(spark, sf):
    """entities() with an event per provenance document."""
    e = V.entities(spark, sf)
    made = F.transform("doc_ids", lambda d: F.struct(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (d % 365).cast("int")), "yyyy-MM-dd").alias("at"), d.alias("doc_id"), F.lit("current").alias("rev"), F.lit(True).alias("at_exact"), F.concat(F.lit("seen in "), d).alias("text")))
    e = e.withColumn("events", made)
    ats = F.transform("events", lambda x: x["at"])
    return e.withColumns({"first_seen": F.array_min(ats), "last_seen": F.array_max(ats), "timeline": F.array_sort(F.transform("events", lambda x: F.struct(x["at"].alias("at"), x["text"].alias("change")))), "description": F.concat(F.lit("about "), "name")})


@query("release_filter_rows", f"WITH {VERDICT}, {EVENTS}, kept AS (SELECT entity_id, count(*) AS n_events, min(dt) AS a, max(dt) AS z FROM ev WHERE d NOT IN (FROM blocked) GROUP BY 1), whole AS (SELECT entity_id, min(dt) AS a, max(dt) AS z FROM ev GROUP BY 1) SELECT entity_id, verdict, CASE verdict WHEN 'redact' THEN '' ELSE concat('about ', name) END AS description, CASE verdict WHEN 'redact' THEN NULL ELSE degree END AS degree, coalesce(n_events, 0) AS n_events, CASE verdict WHEN 'redact' THEN coalesce(kept.a, '') ELSE whole.a END AS first_seen, CASE verdict WHEN 'redact' THEN coalesce(kept.z, '') ELSE whole.z END AS last_seen FROM ent JOIN verdicts USING (entity_id) JOIN whole USING (entity_id) LEFT JOIN kept USING (entity_id) WHERE verdict <> 'block'")
def release_filter_rows(spark, sf):
    r = gate.release(with_events(spark, sf), V.toxic(spark, sf), "entity_id")
    return r.select("entity_id", "verdict", "description", "degree", F.size("events").cast("long").alias("n_events"), "first_seen", "last_seen")


@query("docs_of_provenance", f"WITH {V.DOCS}, {V.ENTITIES}, e AS (SELECT DISTINCT entity_id, unnest(doc_ids) AS doc_id FROM ent), j AS (SELECT entity_id, doc_id, doc_date, row_number() OVER (PARTITION BY entity_id ORDER BY doc_date DESC, doc_id) AS p FROM e JOIN docs USING (doc_id)) SELECT entity_id, string_agg(CAST(CASE WHEN p <= 2 THEN doc_id END AS VARCHAR), ',' ORDER BY p) AS newest, count(*) AS total, count(*) > 2 AS truncated FROM j GROUP BY 1")
def docs_of_provenance(spark, sf):
    d = lookup.docs_of(V.entities(spark, sf), V.plain_docs(spark, sf), "entity_id", cap=2)
    return d.select("entity_id", F.array_join(F.transform("docs", lambda x: x["doc_id"].cast("string")), ",").alias("newest"), "total", "truncated")


def resolve_name(spark, sf):
    e = V.entities(spark, sf).where("name <> 'Entity 12'").withColumn("name_norm", X.norm_name("name"))
    return lookup.resolve(e, "entity 12")


RESOLVE = f"WITH {V.ENTITIES} SELECT entity_id, name, 'candidate' AS how FROM ent WHERE name <> 'Entity 12' AND contains(lower(name), 'entity 12') ORDER BY degree DESC, entity_id LIMIT 10"
query("resolve_name", RESOLVE)(resolve_name)


@query("resolve_exact", f"WITH {V.ENTITIES} SELECT entity_id, name, 'exact' AS how FROM ent WHERE lower(name) = lower(trim(regexp_replace(regexp_replace('  entity   42 (note)', '\\s*\\([^)]*\\)\\s*$', ''), '\\s+', ' ', 'g')))")
def resolve_exact(spark, sf):
    return lookup.resolve(V.entities(spark, sf).withColumn("name_norm", X.norm_name("name")), "  entity   42 (note)")


@query("entity_as_of", f"WITH {EVENTS} SELECT entity_id, CAST(count(*) FILTER (WHERE dt <= '2024-06-30') AS INTEGER) AS change_count, max(dt) FILTER (WHERE dt <= '2024-06-30') AS latest_change, CAST(count(*) FILTER (WHERE dt > '2024-06-30') AS INTEGER) AS changes_after, min(dt) > '2024-06-30' AS not_yet FROM ev GROUP BY 1")
def entity_as_of(spark, sf):
    return lookup.as_of(with_events(spark, sf), "2024-06-30").drop("description")


@query("timeline_range", f"WITH {EVENTS} SELECT entity_id, CAST(count(*) AS INTEGER) AS total, string_agg(dt, ',' ORDER BY dt) AS ats FROM ev WHERE dt BETWEEN '2024-03-01' AND '2024-09-30' GROUP BY 1")
def timeline_range(spark, sf):
    shown, n = lookup.events_between("events", "2024-03-01", "2024-09-30")
    e = with_events(spark, sf).select("entity_id", n.alias("total"), F.array_join(F.array_sort(F.transform(shown, lambda x: x["at"])), ",").alias("ats"))
    return e.where("total > 0")


@query("events_fold60", "WITH f AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS dt, event_type AS text, min(event_id) AS o FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY dt DESC, o DESC) AS back FROM f) SELECT user_id, CAST(count(*) AS INTEGER) AS n, string_agg(concat(dt, text), '|' ORDER BY dt, o) AS folded FROM r WHERE back <= 10 GROUP BY 1")
def events_fold60(spark, sf):
    e = V.table(spark, sf, "events").select("user_id", F.col("event_id").alias("ord"), F.date_format("ts", "yyyy-MM-dd").alias("at"), F.col("event_type").alias("text"), F.lit(None).cast("int").alias("doc_id"), F.lit("current").alias("rev"), F.lit(True).alias("at_exact"))
    f = resolve.fold_events(e, "user_id", 10)
    return f.select("user_id", F.size("events").alias("n"), F.array_join(F.transform("events", lambda x: F.concat(x["at"], x["text"])), "|").alias("folded"))


@query("neighbors_top20", f"WITH {V.ENTITIES}, b AS (SELECT DISTINCT * FROM (SELECT src_id AS entity_id, tgt_id AS other_id FROM rel UNION ALL SELECT tgt_id, src_id FROM rel) WHERE entity_id IN (1, 2, 3, 50)) SELECT b.entity_id, other_id, name AS other, degree, CAST(row_number() OVER (PARTITION BY b.entity_id ORDER BY degree DESC, other_id) AS INTEGER) AS place FROM b JOIN ent ON ent.entity_id = other_id QUALIFY place <= 20")
def neighbors_top20(spark, sf):
    e = V.entities(spark, sf)
    return lookup.neighbours(V.relations(spark, sf), e, e.where("entity_id in (1, 2, 3, 50)"))


@query("stats_by_kind", f"WITH {V.DOCS}, {V.ENTITIES} SELECT 'origin' AS kind, origin AS name, count(*) AS n FROM docs GROUP BY 2 UNION ALL SELECT 'type', type, count(*) FROM ent GROUP BY 2")
def stats_by_kind(spark, sf):
    return lookup.stats(V.plain_docs(spark, sf), V.entities(spark, sf))


@query("date_range", f"WITH {V.DOCS} SELECT min(doc_date) AS first, max(doc_date) AS last FROM docs")
def date_range(spark, sf):
    return lookup.date_range(V.plain_docs(spark, sf))


# --- resolution ------------------------------------------------------------------------------------
MENTIONS = """m AS (SELECT event_id AS ord, user_id % 40 AS k, event_type AS kind, CASE event_id % 3 WHEN 0 THEN concat('Node-', user_id % 40) WHEN 1 THEN concat('node ', user_id % 40) ELSE concat('NODE', user_id % 40) END AS name, strftime(ts, '%Y-%m-%d') AS dt FROM events)"""


def mentions(spark, sf):
    return V.table(spark, sf, "events").selectExpr("event_id AS ord", "user_id % 40 AS k", "event_type AS kind", "CASE event_id % 3 WHEN 0 THEN concat('Node-', user_id % 40) WHEN 1 THEN concat('node ', user_id % 40) ELSE concat('NODE', user_id % 40) END AS name", "date_format(ts, 'yyyy-MM-dd') AS at")


@query("canon_merge", f"WITH {MENTIONS}, s AS (SELECT lower(name) AS name, count(*) AS touches FROM m GROUP BY 1), r AS (SELECT name, regexp_replace(name, '[^0-9a-z]', '', 'g') AS key, touches FROM s) SELECT name, first_value(name) OVER (PARTITION BY key ORDER BY touches DESC, name) AS canon FROM r")
def canon_merge(spark, sf):
    s = mentions(spark, sf).groupBy(F.lower("name").alias("name")).agg(F.count("*").alias("touches")).withColumn("docs", F.lit(0))
    return resolve.build_canon(s, key=lambda n: X.merge_key(n, True))


@query("mode_type", f"WITH {MENTIONS}, c AS (SELECT k, kind, count(*) AS n, min(ord) AS f FROM m GROUP BY 1, 2) SELECT k, first_value(kind) OVER (PARTITION BY k ORDER BY n DESC, f) AS kind FROM c QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, f) = 1")
def mode_type(spark, sf):
    return resolve.first_mode(mentions(spark, sf), "k", "kind", "ord")


@query("ordered_distinct_desc", f"WITH {MENTIONS}, c AS (SELECT k, name, min(ord) AS f FROM m GROUP BY 1, 2) SELECT k, string_agg(name, '|' ORDER BY f) AS names FROM c GROUP BY 1")
def ordered_distinct_desc(spark, sf):
    return resolve.ordered_distinct(mentions(spark, sf), "k", "name", "ord", "names").withColumn("names", F.array_join("names", "|"))


@query("merge_relations", f"WITH {MENTIONS}, r AS (SELECT k AS s, (k * 3 + ord % 4) % 40 AS t, ord, kind FROM m), g AS (SELECT least(s, t) AS a, greatest(s, t) AS b, arg_min(s, ord) AS src_id, arg_min(t, ord) AS tgt_id, string_agg(DISTINCT kind, ',' ORDER BY kind) AS keywords, count(*) AS n FROM r WHERE s <> t GROUP BY 1, 2) SELECT CAST(src_id AS INTEGER) AS src_id, CAST(tgt_id AS INTEGER) AS tgt_id, keywords, n FROM g")
def merge_relations(spark, sf):
    r = mentions(spark, sf).selectExpr("k AS source", "(k * 3 + ord % 4) % 40 AS target", "ord", "kind AS keywords", "CAST(ord AS INT) AS doc_id")
    e = spark.range(40).selectExpr("id AS key", "CAST(id AS INT) AS entity_id")
    return resolve.merge_relations(r, e).select("src_id", "tgt_id", F.array_join("keywords", ",").alias("keywords"), "n")


@query("entity_degree", f"WITH {V.ENTITIES} SELECT entity_id, degree FROM deg")
def entity_degree(spark, sf):
    return resolve.degree(V.relations(spark, sf))


@query("merge_entities", f"WITH {MENTIONS}, c AS (SELECT k, name, count(*) AS n FROM m GROUP BY 1, 2), d AS (SELECT k, first_value(name) OVER (PARTITION BY k ORDER BY n DESC, name) AS name FROM c QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, name) = 1) SELECT concat('node', k) AS key, d.name, min(dt) AS first_seen, max(dt) AS last_seen, count(DISTINCT ord % 50) AS n_docs FROM m JOIN d USING (k) GROUP BY 1, 2")
def merge_entities(spark, sf):
    m = mentions(spark, sf).selectExpr("name", "kind AS type", "kind AS description", "CAST(ord % 50 AS INT) AS doc_id", "at", "ord")
    names = m.select(F.lower("name").alias("name")).distinct().withColumn("canon", X.merge_key("name", True))
    e = resolve.merge_entities(m, names)
    return e.select("key", "name", "first_seen", "last_seen", F.size("doc_ids").cast("long").alias("n_docs"))


@query("split_senses", f"WITH {MENTIONS} SELECT ord, name, CASE WHEN contains(kind, 'click') THEN 'clicked' WHEN contains(kind, 'i') THEN 'other i' ELSE name END AS sense FROM m WHERE lower(name) = 'node 7' UNION ALL SELECT ord, name, name FROM m WHERE lower(name) <> 'node 7'")
def split_senses(spark, sf):
    rules = spark.sql("SELECT * FROM VALUES ('Node 7', 'click', 'clicked', 0), ('Node 7', 'i', 'other i', 1) AS t(name, cue, label, ord)").withColumnRenamed("ord", "rule_ord")
    m = mentions(spark, sf).select(F.col("ord").alias("id"), "name", F.col("kind").alias("text"))
    return resolve.split_senses(m, rules.withColumnRenamed("rule_ord", "ord")).select(F.col("id").alias("ord"), "name", "sense")


#: A word for each nation, drawn by its key from consonants and vowels that no fold touches: with its region in two words,
#: the other way round in one, shortened, in Hangul and romanised.
NAMES = """WITH n AS (SELECT CAST(n_nationkey AS BIGINT) AS k, lower(r_name) AS r FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def named(spark, sf):
    n = V.table(spark, sf, "nation").join(V.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k, r = F.col("n_nationkey").cast("long"), F.lower("r_name")
    pick = lambda table, at: F.get(F.array(*[F.lit(x) for x in table]), at.cast("int"))

    def syllable(i):
        code = 44032 + 588 * pick([2, 5, 6, 9, 18], F.floor(i / 5)) + 28 * pick([0, 5, 8, 13, 20], i % 5)
        bits = [0xE0 + F.floor(code / 4096), 0x80 + F.floor(code / 64) % 64, 0x80 + code % 64]
        return F.decode(F.unhex(F.concat(*[F.hex(x.cast("long")) for x in bits])), "UTF-8"), F.concat(pick(["n", "r", "m", "s", "h"], F.floor(i / 5)), pick(["a", "e", "o", "u", "i"], i % 5))

    (h1, l1), (h2, l2) = syllable(k), syllable((k + 7) % 25)
    w = F.concat(F.lit("z"), l1, F.lit("z"))
    forms = {0: F.concat(w, F.lit(" "), r), 100: F.concat(r, w), 200: F.concat(F.lit("x "), w, F.lit(" "), r), 300: F.concat(F.lit("xz"), F.substring(r, 1, 1)), 400: F.concat(h1, h2), 500: F.concat(l1, l2)}
    rows = F.explode(F.array(*[F.struct((k + at).alias("entity_id"), name.alias("name"), F.lit("kind").alias("type")) for at, name in forms.items()]))
    return n.select(rows.alias("e")).select("e.*")


@query("alias_pairs", f"""{NAMES} SELECT k AS a, 100 + k AS b, 'fused spelling' AS why FROM n WHERE NOT contains(r, ' ')
UNION ALL SELECT a.k + 200, b.k + 300, 'abbreviation' FROM n a JOIN n b ON a.r[1] = b.r[1] WHERE NOT contains(a.r, ' ')
UNION ALL SELECT k + 400, k + 500, 'romanised match' FROM n""")
def alias_pairs(spark, sf):
    return resolve.alias_pairs(named(spark, sf))


# --- graph -----------------------------------------------------------------------------------------
@query("graph_degrees", f"WITH {V.GRAPH} SELECT id, count(*) FILTER (WHERE o) AS out_degree, count(*) FILTER (WHERE NOT o) AS in_degree, count(*) AS degree FROM (SELECT src AS id, true AS o FROM edges UNION ALL SELECT dst, false FROM edges) GROUP BY 1")
def graph_degrees(spark, sf):
    return graph.degrees(V.graph(spark, sf))


@query("adjacency", f"WITH {V.GRAPH} SELECT src AS id, string_agg(DISTINCT dst, ',' ORDER BY dst) AS neighbours FROM both_ways GROUP BY 1")
def adjacency(spark, sf):
    return graph.adjacency(V.graph(spark, sf)).withColumn("neighbours", F.array_join("neighbours", ","))


@query("bfs_depth2", f"WITH {V.GRAPH}, d1 AS (SELECT DISTINCT dst AS id FROM both_ways WHERE src = 's1'), d2 AS (SELECT DISTINCT b.dst AS id FROM d1 JOIN both_ways b ON b.src = d1.id WHERE b.dst <> 's1' AND b.dst NOT IN (FROM d1)) SELECT 's1' AS id, CAST(0 AS INTEGER) AS depth UNION ALL SELECT id, 1 FROM d1 UNION ALL SELECT id, 2 FROM d2")
def bfs_depth2(spark, sf):
    return graph.within(V.graph(spark, sf), spark.range(1).select(F.lit("s1").alias("id")), 2)


FAR_END = "far_end AS (SELECT min(c_custkey) AS k FROM customer JOIN nation a ON c_nationkey = a.n_nationkey WHERE a.n_regionkey = (SELECT n_regionkey FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_suppkey = 1) AND a.n_nationkey <> (SELECT s_nationkey FROM supplier WHERE s_suppkey = 1))"


@query("shortest_path", f"WITH {FAR_END} SELECT concat('s1>n', s_nationkey, '>r', b.n_regionkey, '>n', c_nationkey, '>c', k) AS path FROM far_end JOIN customer ON c_custkey = k, supplier JOIN nation b ON s_nationkey = n_nationkey WHERE s_suppkey = 1")
def shortest_path(spark, sf):
    """From a supplier to a customer of another nation of its region."""
    n, s, c = (V.table(spark, sf, t) for t in ("nation", "supplier", "customer"))
    home = s.where("s_suppkey = 1").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("n_nationkey", "n_regionkey").first()
    end = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).where((F.col("n_regionkey") == home["n_regionkey"]) & (F.col("n_nationkey") != home["n_nationkey"])).agg(F.min("c_custkey")).first()[0]
    path = graph.shortest_path(V.graph(spark, sf), "s1", f"c{end}")
    return spark.range(1).select(F.lit(">".join(path)).alias("path"))


@query("components", "WITH n AS (SELECT n_nationkey, n_regionkey FROM nation), x AS (SELECT concat('c', c_custkey) AS node, n_regionkey AS r FROM customer JOIN n ON c_nationkey = n_nationkey UNION ALL SELECT concat('s', s_suppkey), n_regionkey FROM supplier JOIN n ON s_nationkey = n_nationkey UNION ALL SELECT concat('n', n_nationkey), n_regionkey FROM n UNION ALL SELECT DISTINCT concat('r', n_regionkey), n_regionkey FROM n) SELECT node, min(node) OVER (PARTITION BY r) AS component FROM x")
def connected(spark, sf):
    return components.connected_components(V.graph(spark, sf), "src", "dst")


@query("subgraph_min_degree", f"WITH {V.GRAPH}, k AS (SELECT id FROM gdeg WHERE degree >= 3 ORDER BY degree DESC, id LIMIT 25) SELECT src, dst FROM edges WHERE src IN (FROM k) AND dst IN (FROM k)")
def subgraph_min_degree(spark, sf):
    e = V.graph(spark, sf)
    return graph.subgraph(graph.degrees(e).select("id", "degree"), e, 3, 25)[1].select("src", "dst")


@query("subgraph_hubs", f"WITH {V.ENTITIES}, k AS (SELECT entity_id FROM ent WHERE degree >= 3 ORDER BY degree DESC, entity_id LIMIT 60) SELECT src_id AS src, tgt_id AS dst FROM rel WHERE src_id IN (FROM k) AND tgt_id IN (FROM k)")
def subgraph_hubs(spark, sf):
    e = V.entities(spark, sf).select(F.col("entity_id").alias("id"), "degree")
    r = V.relations(spark, sf).select(F.col("src_id").alias("src"), F.col("tgt_id").alias("dst"))
    return graph.subgraph(e, r, 3, 60)[1].select("src", "dst")


@query("node_cap", f"WITH {V.GRAPH} SELECT id, degree FROM gdeg ORDER BY degree DESC, id LIMIT 40")
def node_cap(spark, sf):
    e = V.graph(spark, sf)
    return graph.subgraph(graph.degrees(e).select("id", "degree"), e, 0, 40)[0]


@query("link_cap", f"WITH {V.GRAPH} SELECT src, dst, least(a.degree, b.degree) AS weaker FROM edges JOIN gdeg a ON a.id = src JOIN gdeg b ON b.id = dst ORDER BY weaker DESC, src, dst LIMIT 60")
def link_cap(spark, sf):
    e = V.graph(spark, sf)
    return graph.capped_links(e, graph.degrees(e), 60).select("src", "dst", "weaker")


@query("degree_recount", f"WITH {V.GRAPH}, k AS (SELECT id FROM gdeg ORDER BY degree DESC, id LIMIT 40), e AS (SELECT * FROM edges WHERE src IN (FROM k) AND dst IN (FROM k)) SELECT id, (SELECT count(*) FROM e WHERE src = k.id) + (SELECT count(*) FROM e WHERE dst = k.id) AS degree FROM k")
def degree_recount(spark, sf):
    e = V.graph(spark, sf)
    nodes, kept = graph.subgraph(graph.degrees(e).select("id", "degree"), e, 0, 40)
    return graph.recounted(nodes, kept)


@query("ghost_edges", "SELECT least(a, b) AS src, greatest(a, b) AS dst, round(CASE WHEN d THEN s * 0.6 ELSE s END, 9) AS score FROM (SELECT concat('n', s_nationkey) AS a, concat('n', s_suppkey % 30) AS b, least(greatest(coalesce(CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_acctbal / 8000.0 END, 0.5), 0), 1) AS s, s_suppkey % 3 = 0 AS d FROM supplier) WHERE a <> b AND a IN (SELECT concat('n', n_nationkey) FROM nation) AND b IN (SELECT concat('n', n_nationkey) FROM nation)")
def ghost_edges(spark, sf):
    s = V.table(spark, sf, "supplier").selectExpr("concat('n', s_nationkey) AS src", "concat('n', s_suppkey % 30) AS dst", "CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_acctbal / 8000.0D END AS score", "s_suppkey % 3 = 0 AS deferred")
    return rounded(graph.ghost_edges(s, V.table(spark, sf, "nation").selectExpr("concat('n', n_nationkey) AS id")), "score", digits=9)


@query("link_overlay", "SELECT src, dst, max(n) AS n FROM (SELECT c_mktsegment AS src, c_nationkey AS dst, count(*) AS n FROM customer GROUP BY 1, 2 UNION ALL SELECT 'BUILDING', s_nationkey, count(*) FROM supplier GROUP BY 2) GROUP BY 1, 2")
def link_overlay(spark, sf):
    a = V.table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("src"), F.col("c_nationkey").alias("dst")).agg(F.count("*").alias("n"))
    b = V.table(spark, sf, "supplier").groupBy(F.lit("BUILDING").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.count("*").alias("n"))
    return graph.overlay(a, b)


LINKS = f"""{V.NOTES}, idx AS (SELECT key, arg_min(path, length(path) * 1000000) AS path FROM (SELECT path, concat('n', doc_id) AS key FROM notes) GROUP BY 1),
    raw AS (SELECT path AS src, unnest([concat('n', doc_id + 1), concat('n', doc_id * 2), concat('N', doc_id + 3)]) AS target FROM notes), cnt AS (SELECT src, target, count(*) AS n FROM raw GROUP BY 1, 2),
    links AS (SELECT src, target, idx.path AS dst, n FROM cnt LEFT JOIN idx ON key = lower(target))"""


def links(spark, sf):
    n = V.notes(spark, sf)
    return sinks.resolved_links(n, sinks.link_index(n))


@query("wikilink_resolve", f"WITH {LINKS} SELECT src, target, dst, n FROM links")
def wikilink_resolve(spark, sf):
    return links(spark, sf)


@query("note_graph", f"WITH {LINKS}, e AS (SELECT src, coalesce(dst, target) AS dst FROM links), d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY 1), v AS (SELECT path AS id, false AS unresolved, size FROM notes UNION ALL SELECT DISTINCT target, true, 0 FROM links WHERE dst IS NULL) SELECT id, unresolved, size, coalesce(degree, 0) AS degree FROM v LEFT JOIN d USING (id)")
def note_graph(spark, sf):
    rows = links(spark, sf).select("src", F.coalesce("dst", "target").alias("dst"), "n")
    return graph.note_graph(V.notes(spark, sf), rows)[0].select("id", "unresolved", "size", "degree")


@query("tag_hubs", f"WITH {V.NOTES}, u AS (SELECT DISTINCT path, unnest(tags) AS t FROM notes) SELECT concat('#', t) AS id, count(*) AS degree FROM u GROUP BY t ORDER BY 2 DESC, t LIMIT 3")
def tag_hubs(spark, sf):
    none = links(spark, sf).where("false").select("src", F.coalesce("dst", "target").alias("dst"), "n")
    return graph.note_graph(V.notes(spark, sf), none, tag_hubs=3)[0].where("tag").select("id", "degree")


@query("top_tags", f"WITH {V.NOTES}, c AS (SELECT t AS tag, count(*) AS n FROM (SELECT DISTINCT path, unnest(tags) AS t FROM notes) GROUP BY 1), f AS (SELECT * FROM c ORDER BY n DESC, tag LIMIT 5) SELECT * FROM f UNION SELECT * FROM c WHERE tag = 'es'")
def top_tags(spark, sf):
    return graph.tag_counts(V.notes(spark, sf), 5, "es")


@query("tag_focus", f"WITH {LINKS} SELECT src, dst FROM links WHERE dst IS NOT NULL AND src IN (SELECT path FROM notes WHERE list_contains(tags, 't3')) AND dst IN (SELECT path FROM notes WHERE list_contains(tags, 't3'))")
def tag_focus(spark, sf):
    return graph.tag_focus(V.notes(spark, sf), links(spark, sf).where("dst is not null"), "t3")[1].select("src", "dst")


@query("modularity", f"WITH {V.GRAPH}, m AS (SELECT id, substr(id, 1, 1) AS c FROM gdeg), i AS (SELECT count(*) FILTER (WHERE a.c = b.c) AS inside, count(*) AS m FROM edges JOIN m a ON a.id = src JOIN m b ON b.id = dst), g AS (SELECT sum(power(d / (2.0 * (SELECT m FROM i)), 2)) AS s FROM (SELECT c, sum(degree) AS d FROM gdeg JOIN m USING (id) GROUP BY 1)) SELECT round(inside / m - s, 6) AS modularity FROM i, g")
def modularity(spark, sf):
    e = V.graph(spark, sf)
    m = graph.degrees(e).select("id", F.substring("id", 1, 1).alias("community"))
    return rounded(graph.modularity(e, m), "modularity")


@query("communities_louvain")
def communities_louvain(spark, sf):
    return graph.ranked_communities(graph.communities(V.graph(spark, sf)), 30, 20)


@query("community_ranks", "WITH s AS (SELECT c_nationkey AS community, count(*) AS n, min(c_custkey) AS f FROM customer GROUP BY 1 HAVING count(*) >= 30), r AS (SELECT community, row_number() OVER (ORDER BY n DESC, f) - 1 AS rank FROM s QUALIFY rank < 20) SELECT c_custkey AS id, CAST(coalesce(rank, -1) AS INTEGER) AS community FROM customer LEFT JOIN r ON community = c_nationkey")
def community_ranks(spark, sf):
    m = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("community"))
    return graph.ranked_communities(m)


@query("layout_fr")
def layout_fr(spark, sf):
    e = V.graph(spark, sf)
    return graph.layout(graph.subgraph(graph.degrees(e).select("id", "degree"), e, 1, 500)[1])


@query("graph_json", f"WITH {V.GRAPH} SELECT concat('{{\"kind\":\"edge\",\"src\":\"', src, '\",\"dst\":\"', dst, '\"}}') AS value FROM edges UNION ALL SELECT concat('{{\"kind\":\"node\",\"id\":\"', id, '\",\"degree\":', degree, '}}') FROM gdeg")
def graph_json(spark, sf):
    e = V.graph(spark, sf)
    return sinks.graph_json(graph.degrees(e).select("id", "degree"), e)


@query("graphml_nodes", f"WITH {V.GRAPH} SELECT concat('<node id=\"n', id, '\"><data key=\"label\">', id, ' &amp; co</data></node>') AS value FROM gdeg")
def graphml_nodes(spark, sf):
    e = V.graph(spark, sf)
    return sinks.graphml(graph.degrees(e).select("id", F.concat("id", F.lit(" & co")).alias("name")), e).where("ord = 3").select("value")
