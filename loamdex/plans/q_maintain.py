"""Incremental maintenance, ledgers, run logs and exports."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from loamdex.operators import index, ledger, media, resolve, sync
from loamdex.plans import views as V
from loamdex.plans.q_search import rounded
from loamdex.plans.registry import query
from loamdex.sources import sinks
from loamdex.streaming import incremental

DIFF = "CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' WHEN o.content_hash <> n.content_hash THEN 'modified' ELSE 'unchanged' END"


@query("diff_documents", f"WITH {V.OLD_NEW} SELECT coalesce(o.path, n.path) AS path, {DIFF} AS change FROM old_v o FULL JOIN new_v n ON o.path = n.path")
def diff_documents(spark, sf):
    return sync.diff(*V.versions(spark, sf))


@query("renames_by_hash", f"WITH {V.OLD_NEW}, g AS (SELECT path, content_hash, row_number() OVER (PARTITION BY content_hash ORDER BY path) AS r FROM old_v WHERE path NOT IN (SELECT path FROM new_v)), c AS (SELECT path, content_hash, row_number() OVER (PARTITION BY content_hash ORDER BY path) AS r FROM new_v WHERE path NOT IN (SELECT path FROM old_v)) SELECT g.path AS old_path, c.path AS new_path FROM g JOIN c USING (content_hash, r)")
def renames_by_hash(spark, sf):
    return sync.renames(*V.versions(spark, sf))


@query("unreadable_rescue", f"WITH {V.OLD_NEW} SELECT path FROM old_v WHERE path NOT IN (SELECT path FROM new_v) AND doc_id % 3 <> 0")
def unreadable_rescue(spark, sf):
    old, new = V.versions(spark, sf)
    gone = old.join(new.select("path"), "path", "left_anti").select("path", "doc_id")
    return sync.rescue(gone, gone.where("doc_id % 3 = 0")).select("path")


@query("document_upsert", f"WITH {V.OLD_NEW}, ch AS (SELECT n.* FROM new_v n JOIN old_v o USING (path) WHERE n.content_hash <> o.content_hash) SELECT doc_id, content_hash FROM old_v WHERE doc_id NOT IN (SELECT doc_id FROM ch) AND doc_id % 7 <> 0 UNION ALL SELECT doc_id, content_hash FROM ch")
def document_upsert(spark, sf):
    old, new = V.versions(spark, sf)
    changed = new.join(old.select("path", F.col("content_hash").alias("_o")), "path").where("content_hash <> _o").select("doc_id", "content_hash")
    return sync.upsert(old.select("doc_id", "content_hash"), changed, old.where("doc_id % 7 = 0"))


@query("extraction_drift", f"WITH {V.OLD_NEW} SELECT o.path, CASE WHEN n.path IS NULL THEN 'missing' ELSE 'modified' END AS reason FROM old_v o LEFT JOIN new_v n USING (path) WHERE n.path IS NULL OR n.content_hash <> o.content_hash")
def extraction_drift(spark, sf):
    return sync.drift(*V.versions(spark, sf))


MARKS = "marks AS (SELECT user_id AS doc_id, event_type AS reason, event_id AS marked_at, concat('p', user_id) AS path FROM events WHERE event_type IN ('view', 'click', 'error'))"


def marks(spark, sf):
    return V.table(spark, sf, "events").where("event_type in ('view', 'click', 'error')").selectExpr("user_id AS doc_id", "event_type AS reason", "event_id AS marked_at", "concat('p', user_id) AS path")


@query("stale_latest", f"WITH {MARKS} SELECT doc_id, arg_max(path, marked_at) AS path, arg_max(reason, marked_at) AS reason, max(marked_at) AS marked_at FROM marks GROUP BY 1")
def stale_latest(spark, sf):
    return sync.stale_latest(marks(spark, sf))


@query("stale_summary", f"WITH {MARKS}, l AS (SELECT doc_id, arg_max(reason, marked_at) AS reason FROM marks GROUP BY 1) SELECT reason, count(*) AS n, round(count(*) / 1000.0, 6) AS ratio FROM l GROUP BY 1")
def stale_summary(spark, sf):
    return rounded(sync.stale_summary(marks(spark, sf), 1000), "ratio")


@query("carry_marks", f"WITH {MARKS}, kept AS (SELECT * FROM marks WHERE marked_at >= 5000) SELECT doc_id, reason, marked_at, path FROM kept UNION ALL SELECT n_nationkey, 'drift', 1, 'x' FROM nation WHERE n_nationkey NOT IN (SELECT doc_id FROM kept)")
def carry_marks(spark, sf):
    m = marks(spark, sf)
    d = V.table(spark, sf, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS doc_id", "'drift' AS reason", "1L AS marked_at", "'x' AS path")
    return sync.carry_marks(m.where("marked_at < 5000"), m, d)


def pieces(spark, sf):
    """Chunks and finished rows of an extraction: line items by order, those returned are done."""
    c = V.table(spark, sf, "lineitem").selectExpr("l_orderkey AS doc", "l_linenumber AS idx", "CAST(l_partkey % 5 AS STRING) AS h", "'1' AS pv", "l_returnflag AS flag")
    return c, c.where("flag = 'R'")


@query("pending_anti", "WITH c AS (SELECT l_orderkey AS doc, l_linenumber AS idx, CAST(l_partkey % 5 AS VARCHAR) AS h, '1' AS pv, l_returnflag AS flag FROM lineitem) SELECT doc, idx, h FROM c WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.flag = 'R' AND d.doc = c.doc AND d.idx = c.idx AND d.h = c.h)")
def pending_anti(spark, sf):
    return sync.pending(*pieces(spark, sf)).select("doc", "idx", "h")


@query("extraction_history", "WITH c AS (SELECT l_orderkey AS doc, l_linenumber AS idx, CAST(l_partkey % 5 AS VARCHAR) AS h, l_returnflag AS flag FROM lineitem), live AS (SELECT doc, idx, CASE WHEN flag = 'A' THEN 'x' ELSE h END AS h FROM c WHERE flag <> 'N') SELECT doc, idx, h FROM c WHERE (doc, idx, h) NOT IN (SELECT doc, idx, h FROM live) AND (doc, idx) IN (SELECT doc, idx FROM live)")
def extraction_history(spark, sf):
    c, _ = pieces(spark, sf)
    live = c.where("flag <> 'N'").withColumn("h", F.when(F.col("flag") == "A", "x").otherwise(F.col("h")))
    return sync.history(c, live).select("doc", "idx", "h")


@query("job_completeness", "WITH c AS (SELECT l_orderkey AS doc, l_linenumber AS idx, l_partkey % 5 AS h, l_returnflag AS flag FROM lineitem), f AS (SELECT doc, (doc, idx, h) IN (SELECT (doc, idx, h) FROM c WHERE flag = 'R') AS done FROM c) SELECT doc, count(*) AS total, count(*) FILTER (WHERE done) AS finished, count(*) = count(*) FILTER (WHERE done) AS complete FROM f GROUP BY 1")
def job_completeness(spark, sf):
    return sync.completeness(*pieces(spark, sf))


@query("scope_gap", f"WITH {V.OLD_NEW} SELECT path, 'not_extracted' AS side FROM old_v WHERE path NOT IN (SELECT path FROM new_v) AND doc_id % 14 <> 0 UNION SELECT path, 'not_indexed' FROM new_v WHERE path NOT IN (SELECT path FROM old_v)")
def scope_gap(spark, sf):
    old, new = V.versions(spark, sf)
    return sync.scope_gap(old, new, old.where("doc_id % 14 = 0"))


@query("prune_ghosts", f"WITH {V.ENTITIES}, x AS (SELECT entity_id, unnest(doc_ids) AS d, unnest([1, 2, 3]) AS p FROM ent) SELECT entity_id, string_agg(CAST(d AS VARCHAR), ',' ORDER BY p) AS doc_ids FROM x WHERE d IN (SELECT doc_id FROM documents WHERE doc_id % 4 <> 0) GROUP BY 1")
def prune_ghosts(spark, sf):
    live = V.table(spark, sf, "documents").where("doc_id % 4 <> 0").select("doc_id")
    p = sync.prune(V.entities(spark, sf), live, "entity_id")
    return p.select("entity_id", F.array_join(F.transform("doc_ids", lambda d: d.cast("string")), ",").alias("doc_ids"))


@query("vector_reuse", "SELECT count(*) AS chunks, count(*) FILTER (WHERE k % 3 = 0) AS reused FROM (SELECT vec_id % 100 AS k FROM embeddings)")
def vector_reuse(spark, sf):
    e = V.table(spark, sf, "embeddings").selectExpr("concat('text ', vec_id % 100) AS text", "embedding AS vector", "vec_id % 100 AS k")
    r = index.reuse_vectors(e.select("text"), e.where("k % 3 = 0").select("text", "vector"))
    return r.agg(F.count("*").alias("chunks"), F.count("vector").alias("reused"))


# --- ledgers and logs ------------------------------------------------------------------------------
@query("ledger_latest", "SELECT user_id, event_type, max(event_id) AS event_id, round(arg_max(value, event_id), 6) AS value FROM events GROUP BY 1, 2")
def ledger_latest(spark, sf):
    e = V.table(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    return rounded(ledger.latest(e, ["user_id", "event_type"], ["event_id"]), "value")


@query("ledger_append", "WITH o AS (SELECT count(*) AS n FROM supplier) SELECT n_name AS source_id, CAST((SELECT n FROM o) + row_number() OVER (ORDER BY n_name) AS BIGINT) AS seq FROM nation")
def ledger_append(spark, sf):
    old = V.table(spark, sf, "supplier").select(F.lit("d").alias("device"), F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("s_suppkey")).cast("long").alias("seq"))
    new = V.table(spark, sf, "nation").select(F.lit("n").alias("source_type"), F.col("n_name").alias("source_id"))
    return ledger.appended(old, new, "d").select("source_id", "seq")


@query("ledger_summary", "SELECT event_type AS source_type, count(*) AS n, max(strftime(ts, '%Y-%m-%d')) AS last FROM events GROUP BY 1")
def ledger_summary(spark, sf):
    e = V.table(spark, sf, "events").select(F.col("event_type").alias("source_type"), F.date_format("ts", "yyyy-MM-dd").alias("source_updated_at"))
    return ledger.summary(e)


@query("merged_revisions", "WITH r AS (SELECT user_id, event_id, event_id % 7 AS rev, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events) SELECT user_id, event_id, greatest(i, i + max(rev - i) OVER (PARTITION BY user_id ORDER BY event_id)) AS revision FROM r")
def merged_revisions(spark, sf):
    e = V.table(spark, sf, "events").selectExpr("user_id", "event_id", "event_id AS ord", "event_id % 7 AS rev")
    return ledger.merged_revisions(e, ["user_id"]).select("user_id", "event_id", "revision")


@query("median_rate", "WITH r AS (SELECT event_type AS step, user_id AS units, value AS seconds FROM events WHERE value > 0 AND event_id % 4 <> 0) SELECT step, count(*) AS n, round(CASE WHEN count(*) >= 3 THEN median(units / seconds) END, 6) AS rate, round(min(seconds), 6) AS floor FROM r GROUP BY 1")
def median_rate(spark, sf):
    r = V.table(spark, sf, "events").selectExpr("event_type AS step", "user_id AS units", "value AS seconds", "CASE WHEN event_id % 4 = 0 THEN 'failed' ELSE 'ok' END AS status")
    return rounded(ledger.median_rate(r), "rate", "floor")


@query("pending_estimate", "WITH r AS (SELECT event_type AS step, median(user_id / value) AS rate, min(value) AS floor FROM events WHERE value > 0 GROUP BY 1) SELECT step, round(greatest(1000 / rate, floor), 6) AS seconds FROM r")
def pending_estimate(spark, sf):
    r = ledger.median_rate(V.table(spark, sf, "events").selectExpr("event_type AS step", "user_id AS units", "value AS seconds", "'ok' AS status"))
    p = V.table(spark, sf, "events").select(F.col("event_type").alias("step"), F.lit(1000).alias("units")).distinct()
    return rounded(ledger.estimate(p, r), "seconds")


@query("usage_monthly", "SELECT strftime(ts, '%Y-%m') AS month, CAST(sum(user_id) AS BIGINT) AS total FROM events GROUP BY 1")
def usage_monthly(spark, sf):
    return ledger.monthly(V.table(spark, sf, "events"), "ts", "user_id")


@query("failure_verdict", "SELECT count(*) AS calls, count(*) FILTER (WHERE event_type = 'error') AS failed, round(count(*) FILTER (WHERE event_type = 'error') / count(*), 6) AS rate, count(*) FILTER (WHERE event_type = 'error') / count(*) >= 0.1 AS abort FROM events")
def failure_verdict(spark, sf):
    c = V.table(spark, sf, "events").selectExpr("event_id AS ord", "CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status")
    return rounded(ledger.failure_verdict(c), "rate")


@query("severity_first", "WITH r AS (SELECT CAST(user_id % 20 AS VARCHAR) AS step, CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'warn' ELSE 'info' END AS severity, concat('do ', event_id) AS action FROM events), s AS (SELECT *, CASE severity WHEN 'error' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END AS k FROM r) SELECT step, severity, action FROM s QUALIFY row_number() OVER (PARTITION BY step ORDER BY k, action) = 1")
def severity_first(spark, sf):
    return ledger.severity_first(V.table(spark, sf, "events").selectExpr("CAST(user_id % 20 AS STRING) AS step", "CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'warn' ELSE 'info' END AS severity", "concat('do ', event_id) AS action"))


# --- media, exports ----------------------------------------------------------------------------------
@query("media_links", "WITH t AS (SELECT doc_id AS sha, lower(text) AS text FROM documents), n AS (SELECT * FROM (VALUES ('idiot'), ('The'), ('version 3'), ('mit license')) v(entity)) SELECT sha, entity, 'ocr' AS basis FROM t JOIN n ON regexp_matches(text, concat('(^|[^0-9a-z_])', lower(entity), '($|[^0-9a-z_])'))")
def media_links(spark, sf):
    t = V.table(spark, sf, "documents").selectExpr("doc_id AS sha", "'ocr' AS basis", "text")
    n = spark.sql("SELECT * FROM VALUES ('idiot'), ('The'), ('version 3'), ('mit license') AS t(entity)")
    return media.name_links(t, n)


@query("media_strongest", "WITH l AS (SELECT user_id AS sha, event_id % 5 AS entity, CASE event_type WHEN 'view' THEN 'ocr' WHEN 'click' THEN 'section' WHEN 'error' THEN 'caption' ELSE 'sidecar' END AS basis, event_id AS score FROM events), k AS (SELECT *, CASE basis WHEN 'ocr' THEN 1 WHEN 'section' THEN 2 WHEN 'caption' THEN 3 ELSE 4 END AS r FROM l) SELECT sha, entity, basis, score FROM k QUALIFY row_number() OVER (PARTITION BY sha, entity ORDER BY r DESC, score DESC) = 1")
def media_strongest(spark, sf):
    links = V.table(spark, sf, "events").selectExpr("user_id AS sha", "event_id % 5 AS entity", "CASE event_type WHEN 'view' THEN 'ocr' WHEN 'click' THEN 'section' WHEN 'error' THEN 'caption' ELSE 'sidecar' END AS basis", "event_id AS score")
    return media.strongest(links)


@query("media_top12", "SELECT event_type AS entity, event_id AS sha, CAST(row_number() OVER (PARTITION BY event_type ORDER BY user_id DESC, ts DESC, event_id) AS INTEGER) AS place FROM events QUALIFY place <= 12")
def media_top12(spark, sf):
    return media.best_media(V.table(spark, sf, "events").selectExpr("event_type AS entity", "event_id AS sha", "user_id AS score", "ts AS taken_at")).select("entity", "sha", "place")


@query("index_pages", f"WITH {V.OLD_NEW}, e AS (SELECT DISTINCT split_part(path, '/', 1) AS dir, split_part(path, '/', 2) AS entry FROM new_v UNION SELECT '', concat(split_part(path, '/', 1), '/') FROM new_v) SELECT dir, count(*) AS n, min(entry) AS first, max(entry) AS last FROM e GROUP BY 1")
def index_pages(spark, sf):
    p = sinks.index_pages(V.versions(spark, sf)[1].select("path"))
    return p.select("dir", F.size("entries").cast("long").alias("n"), F.array_min("entries").alias("first"), F.array_max("entries").alias("last"))


@query("corpus_map", f"WITH {V.NOTES}, t AS (SELECT lang AS name, count(*) AS n FROM documents GROUP BY 1), p AS (SELECT source AS name, count(*) AS n FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15), g AS (SELECT t AS name, count(*) AS n FROM (SELECT DISTINCT path, unnest(tags) AS t FROM notes) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20) SELECT 'type' AS kind, * FROM t UNION ALL SELECT 'project', * FROM p UNION ALL SELECT 'tag', * FROM g")
def corpus_map(spark, sf):
    d = V.notes(spark, sf).join(V.table(spark, sf, "documents").select("doc_id", F.col("lang").alias("doc_type"), F.col("source").alias("project")), "doc_id")
    return sinks.corpus_map(d)


@query("scrubbed_copy", f"WITH {V.TOXIC} SELECT doc_id, '' AS abs_path FROM documents WHERE doc_id NOT IN (FROM blocked)")
def scrubbed_copy(spark, sf):
    d = V.table(spark, sf, "documents").selectExpr("doc_id", "concat('/home/', doc_id) AS abs_path")
    out = sinks.scrubbed({"documents": d, "ix_terms": d}, V.toxic(spark, sf))
    return out["documents"]


@query("entity_notes")
def entity_notes(spark, sf):
    e = V.entities(spark, sf).withColumn("description", F.lit(None).cast("string"))
    return sinks.entity_notes(e, V.relations(spark, sf), V.plain_docs(spark, sf))


# --- extensions over event time ----------------------------------------------------------------------
@query("event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf):
    return rounded(incremental.tumbling(V.table(spark, sf, "events")), "total")


@query("event_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS \"end\", count(*) AS n FROM s GROUP BY user_id, k")
def event_sessions(spark, sf):
    return incremental.sessions(V.table(spark, sf, "events"))


@query("events_once", "SELECT count(*) AS n FROM (SELECT DISTINCT event_id FROM events)")
def events_once(spark, sf):
    e = V.table(spark, sf, "events")
    return incremental.once(e.unionByName(e)).agg(F.count("*").alias("n"))


@query("name_stats", "WITH r AS (SELECT lower(event_type) AS a, lower(concat('u', user_id % 9)) AS b FROM events), t AS (SELECT name, count(*) AS touches FROM (SELECT a AS name FROM r UNION ALL SELECT b FROM r) GROUP BY 1) SELECT coalesce(name, d) AS name, coalesce(touches, 0) AS touches, CAST(coalesce(n, 0) AS BIGINT) AS docs FROM t FULL JOIN (VALUES ('view', 2), ('other', 1)) v(d, n) ON d = name")
def name_stats(spark, sf):
    r = V.table(spark, sf, "events").selectExpr("event_type AS src_name", "concat('u', user_id % 9) AS tgt_name")
    e = spark.sql("SELECT * FROM VALUES ('View', array(1, 2)), ('other', array(3)) AS t(name, doc_ids)")
    return resolve.name_stats(r, e)
