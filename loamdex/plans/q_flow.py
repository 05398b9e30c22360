"""Shared streams, sessions and their state, summaries, links, evaluation protocol, comparison of builds."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamdex import schema as S
from loamdex.functions import links
from loamdex.operators import distilled, evaluation as ev, folding, migrate, search, view
from loamdex.plans import views as V
from loamdex.plans.q_search import GRID, rounded
from loamdex.plans.registry import query
from loamdex.session import scratch_path
from loamdex.sources import session_store, sinks, streams

# --- extraction streams: a JSON line an event, every kind of fault among them ----------------------
GOOD = """concat('{"doc":"d', CAST(user_id % 40 AS STRING), '","idx":', CAST(event_id % 3 AS STRING), ',"h":"x","repository":"r","revision":', CAST(event_id % 7 AS STRING), ',"entities":[{"name":"', event_type, '"}],"relationships":[]}')"""
LINE = f"""CASE event_id % 12 WHEN 0 THEN '{{broken' WHEN 1 THEN '[1]' WHEN 2 THEN '{{"failed":true}}' WHEN 3 THEN replace({GOOD}, '"idx":', '"idx":-1') WHEN 4 THEN replace({GOOD}, '"entities":[', '"entities":[1,')
    WHEN 5 THEN replace({GOOD}, '"h":', '"revision":-1,"h":') WHEN 6 THEN replace({GOOD}, '"r"', '"other"') WHEN 7 THEN replace({GOOD}, '"h":', '"import_id":"zz","h":')
    WHEN 8 THEN replace({GOOD}, '"h":', '"origin_device":"elsewhere","h":') ELSE {GOOD} END"""
REASONS = ["invalid JSON", "not an object", "skipped", "key", "shape", "invalid JSON", "repository", "receipt", "origin"]
REASON = "CASE event_id % 12 " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(REASONS)) + " END"
STREAM = "e AS (SELECT concat('dev-', user_id % 5) AS device, event_id, user_id, event_type FROM events)"


def stream_rows(spark, sf):
    e = V.table(spark, sf, "events").selectExpr("concat('dev-', user_id % 5) AS device", "event_id AS position", f"{LINE} AS value")
    return streams.merged(streams.checked(e, "m"), "r")


@query("stream_rejects", f"WITH {STREAM} SELECT device, {REASON} AS reason, count(*) AS n FROM e WHERE event_id % 12 < 9 GROUP BY 1, 2")
def stream_rejects(spark, sf):
    """A second revision key makes a line no JSON of one meaning, so remainder 5 is refused as such."""
    return stream_rows(spark, sf)[1].groupBy("device", "reason").agg(F.count("*").alias("n"))


@query("stream_held", f"""WITH {STREAM}, g AS (SELECT *, concat('d', user_id % 40) AS doc, event_id % 3 AS idx, row_number() OVER (PARTITION BY device, user_id % 40, event_id % 3 ORDER BY event_id) AS i FROM e WHERE event_id % 12 > 8),
    r AS (SELECT *, greatest(i, i + max(event_id % 7 - i) OVER (PARTITION BY device, doc, idx ORDER BY event_id ROWS UNBOUNDED PRECEDING)) AS revision FROM g)
    SELECT doc, idx, CAST(max(revision) AS BIGINT) AS revision, arg_max(device, (revision, device)) AS device, arg_max(event_type, (revision, device)) AS entity FROM r GROUP BY 1, 2""")
def stream_held(spark, sf):
    held = streams.held(stream_rows(spark, sf)[0])
    return held.select("doc", "idx", F.col("revision").cast("long").alias("revision"), "device", F.get("entities", F.lit(0))["name"].alias("entity"))


# --- state of sessions ------------------------------------------------------------------------------
SESSIONS = "s AS (SELECT user_id, CAST(floor(epoch(max(ts))) AS DOUBLE) AS last_ts FROM events GROUP BY 1), mk AS (SELECT user_id, last_ts - 100 AS m FROM s WHERE user_id % 4 = 0), lg AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS DOUBLE) AS t FROM events WHERE event_type = 'purchase' AND user_id % 3 = 0)"


def sessions_and_ledger(spark, sf):
    e = V.table(spark, sf, "events").withColumn("t", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)").cast("double"))
    sid = F.concat(F.lit("s"), F.col("user_id").cast("string"))
    s = e.groupBy("user_id").agg(F.max("t").alias("last_ts")).select(F.lit("claude").alias("agent"), sid.alias("session_id"), "last_ts", "user_id", (F.col("last_ts") - 86400 * 5).alias("point"))
    markers = s.where("user_id % 4 = 0").select(F.when(F.col("user_id") % 8 == 0, F.lit("claude")).alias("agent"), "session_id", (F.col("last_ts") - 100).alias("last_ts"), F.array(F.concat(F.lit("page-"), "session_id"), F.lit("bad/page")).alias("pages"))
    rows = e.where("event_type = 'purchase' and user_id % 3 = 0").select(F.lit("claude_session").alias("source_type"), sid.alias("source_id"), F.lit("dev").alias("device"), F.col("event_id").alias("seq"), F.col("t").alias("recorded_at"), F.col("t").alias("distilled_through_last_ts"), F.when(F.col("event_id") % 2 == 0, F.array(F.concat(F.lit("l"), F.col("event_id").cast("string")))).alias("pages"))
    staged = s.where("user_id % 10 = 7").select(F.lit("claude_session").alias("source_type"), F.col("session_id").alias("source_id"))
    return s, markers, rows, staged


@query("distilled_state", f"""WITH {SESSIONS}, now AS (SELECT max(last_ts) AS now FROM s),
    a AS (SELECT lg.user_id, max(t) AS through, arg_max(event_id, (t, event_id)) FILTER (event_id % 2 = 0) AS page FROM lg JOIN s USING (user_id) WHERE t <= last_ts - 432000 GROUP BY 1),
    j AS (SELECT user_id, last_ts, m IS NOT NULL AS marked, m IS NOT NULL OR through IS NOT NULL OR user_id % 10 = 7 AS done, CASE WHEN m IS NULL THEN through WHEN through IS NULL THEN m ELSE greatest(m, through) END AS done_ts,
        CASE WHEN m IS NOT NULL THEN concat('page-s', user_id) WHEN page IS NOT NULL THEN concat('l', page) ELSE '' END AS pages, now - last_ts >= 21600 AS settled FROM s LEFT JOIN mk USING (user_id) LEFT JOIN a USING (user_id), now)
    SELECT concat('s', user_id) AS session_id, marked, done, done_ts, pages, coalesce(last_ts > done_ts, false) AS grew, settled,
        CASE WHEN NOT settled AND (NOT done OR coalesce(last_ts > done_ts, false)) THEN 'wait' WHEN NOT done THEN 'distil' WHEN coalesce(last_ts > done_ts, false) THEN 'continue' ELSE 'done' END AS "next" FROM j""")
def distilled_state(spark, sf):
    """Each session beside the ledger as it stood five days before the session's last turn."""
    s, markers, rows, staged = sessions_and_ledger(spark, sf)
    now = s.agg(F.max("last_ts")).first()[0]
    out = distilled.state(s, markers, rows, staged, now, as_of="point")
    return out.select("session_id", "marked", "done", "done_ts", F.array_join("pages", ",").alias("pages"), "grew", "settled", "next")


def exclusion(spark, sf):
    c = V.table(spark, sf, "conversations").select(F.concat(F.lit("C"), F.col("conv_id").cast("string")).alias("session"), F.col("turn"), (F.col("turn") * 60.0).alias("ts"), "conv_id")
    ids = c.select("conv_id").distinct()
    roots = ids.select(F.concat(F.lit("C"), F.col("conv_id").cast("string")).alias("id"), F.concat(F.lit("C"), (F.col("conv_id") - F.col("conv_id") % 3).cast("string")).alias("root"))
    line = F.when(F.col("conv_id") % 7 == 1, F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(" # whole"))).when(F.col("conv_id") % 7 == 2, F.concat(F.lit("C"), F.col("conv_id").cast("string"), F.lit("  1970-01-01T00:02:00Z")))
    lines = ids.select(line.alias("value")).where("value is not null")
    again = ids.where("conv_id % 14 = 2").select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(" 1970-01-01T00:01:00+00:00")).alias("value"))
    return c, roots, lines.unionByName(again)


@query("excluded_turns", """WITH x AS (SELECT DISTINCT conv_id, conv_id - conv_id % 3 AS root FROM conversations),
    r AS (SELECT root, bool_or(conv_id % 7 = 1) AS whole, min(CASE WHEN conv_id % 14 = 2 THEN 60 WHEN conv_id % 7 = 2 THEN 120 END) AS cut FROM x GROUP BY 1)
    SELECT concat('C', conv_id) AS session, turn FROM conversations JOIN x USING (conv_id) JOIN r USING (root) WHERE NOT whole AND (cut IS NULL OR turn * 60 < cut)""")
def excluded_turns(spark, sf):
    c, roots, lines = exclusion(spark, sf)
    return distilled.without(c, roots, distilled.listed(lines)[0]).select("session", "turn")


@query("exclusion_problems", """WITH x AS (SELECT DISTINCT conv_id, conv_id - conv_id % 3 AS root FROM conversations), l AS (SELECT conv_id, root, CASE WHEN conv_id % 14 = 2 THEN 60 WHEN conv_id % 7 = 2 THEN 120 END AS cut FROM x WHERE conv_id % 7 IN (1, 2)),
    made AS (SELECT conv_id, 30.0 * (conv_id % 5) AS reach FROM x WHERE conv_id % 2 = 0), j AS (SELECT l.conv_id, cut, max(reach) AS reach FROM l JOIN made m ON m.conv_id = l.conv_id OR m.conv_id = l.root GROUP BY 1, 2)
    SELECT concat('c', conv_id) AS id, CASE WHEN cut IS NULL THEN 'distilled' ELSE 'past cutoff' END AS problem FROM j WHERE cut IS NULL OR reach >= cut
    UNION ALL SELECT 'nobody', 'unknown' FROM x WHERE conv_id = 1 UNION ALL SELECT 'c', 'abbreviated' FROM x WHERE conv_id = 1""")
def exclusion_problems(spark, sf):
    c, roots, lines = exclusion(spark, sf)
    odd = roots.where("id = 'C1'").select(F.explode(F.array(F.lit("nobody"), F.lit("c"))).alias("value"))
    reached = c.where("conv_id % 2 = 0").select(F.col("session").alias("id"), (30.0 * (F.col("conv_id") % 5)).alias("at")).distinct()
    return distilled.refused(distilled.listed(lines.unionByName(odd))[0], roots, reached)


# --- a session store: customers as sessions, in chains by their number -------------------------------
@query("session_lineage", """WITH s AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 > 0 AND c_custkey > 1 THEN c_custkey - 1 END AS parent FROM customer),
    f AS (SELECT s.id, s.parent, coalesce(p.id % 5 < 2, false) AS continues, coalesce(p.id % 5 = 2, false) AS branched FROM s LEFT JOIN s p ON s.parent = p.id),
    u AS (SELECT id, CASE WHEN NOT continues THEN id WHEN id % 5 = 1 THEN id - 1 ELSE id - 2 END AS root0, continues, branched, parent FROM f)
    SELECT id, CASE WHEN id = 2 THEN 1 ELSE root0 END AS root, continues, branched, parent IS NOT NULL AND NOT branched AND NOT continues AS delegated FROM u""")
def session_lineage(spark, sf):
    """Endings by remainder: 0 and 1 compressed, 2 branched, 3 and 4 nothing in particular."""
    ending = F.when(F.col("c_custkey") % 5 < 2, "compression").when(F.col("c_custkey") % 5 == 2, "branched")
    child = (F.col("c_custkey") % 5 > 0) & (F.col("c_custkey") > 1)
    s = V.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.when(child, F.col("c_custkey") - 1).alias("parent_session_id"), ending.alias("end_reason"), F.col("c_custkey").cast("double").alias("started_at"),
        F.col("c_custkey").cast("double").alias("ended_at"), F.lit("").alias("session_key"), F.lit("not JSON").alias("model_config"),
    )
    return session_store.lineage(s).select("id", "root", "continues", "branched", "delegated")


# --- summaries ---------------------------------------------------------------------------------------
@query("summary_fold")
def summary_fold(spark, sf):
    """Texts of a source are fragments of one name; sources hold far more than one call's budget."""
    d = V.table(spark, sf, "documents").select(F.col("source").alias("name"), F.col("doc_id").alias("place"), "text")
    return folding.fold(d, scratch_path(spark, "summaries"))[0]


# --- links -------------------------------------------------------------------------------------------
LINKED = "concat(text, ' see [[n', doc_id + 1, ']], [[N', doc_id * 2, '|later]] and [[n', doc_id, '#Part two]]; `[[n1]]` stays, [[no such note]] too')"
FOUND = "CASE WHEN EXISTS (SELECT 1 FROM documents x WHERE x.doc_id = {0}) THEN concat('/', (SELECT min(source) FROM documents x WHERE x.doc_id = {0}), '/n', {0}, '.md') ELSE concat('/unresolved/n', {0}, '.md') END"


@query("links_converted", f"""SELECT doc_id, concat(text, ' see [n', doc_id + 1, '](', {FOUND.format('(d.doc_id + 1)')}, '), [later](', {FOUND.format('(d.doc_id * 2)')}, ') and [n', doc_id, '](', {FOUND.format('d.doc_id')}, '#Part-two); `[[n1]]` stays, [no such note](/unresolved/no-such-note.md) too') AS text FROM documents d WHERE NOT contains(text, '`') AND NOT contains(text, '[[')""")
def links_converted(spark, sf):
    """Whole texts of all documents that have no links or code of their own, since the SQL knows no others."""
    d = V.table(spark, sf, "documents")
    index = sinks.link_index(d.select(F.concat(F.lit("/"), "source", F.lit("/n"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path")))
    notes = d.where("not contains(text, '`') and not contains(text, '[[')").select("doc_id", F.expr(LINKED).alias("text"))
    return links.converted(notes, index)[0].select("doc_id", "text")


@query("okf_texts", r"""SELECT doc_id, concat(E'---\ntitle: "', lang, E'"\ntype: "note"\ncreated: "2024-01-01"\nsource: ""\n---\n\n', text) AS value FROM documents WHERE NOT contains(text, '[[')""")
def okf_texts(spark, sf):
    """Whole texts, links converted, as documents of the open format."""
    d = V.table(spark, sf, "documents").where("not contains(text, '[[')")
    index = sinks.link_index(d.select(F.concat("source", F.lit("/n"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path")))
    notes = links.converted(d.selectExpr("doc_id", "lang AS path", "lang AS title", "'note' AS doc_type", "'2024-01-01' AS doc_date", "CAST(NULL AS STRING) AS source_url", "text"), index)[0]
    return sinks.okf_document(notes).select("doc_id", "value")


# --- evaluation: sources are queries, their documents candidates, labels judgements -------------------
COMPS = ", ".join(f"('{c}')" for c in S.COMPONENTS)
PER_QUERY = f"""{V.SCORES}, raw AS (SELECT comp, source AS qid, doc_id, score FROM scores JOIN documents USING (doc_id)),
    normed AS (SELECT comp, qid, doc_id, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-12 THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS norm FROM raw WINDOW w AS (PARTITION BY comp, qid)),
    g(gid, comp, w) AS (VALUES {', '.join(f"({i}, '{c}', {w})" for i, ws in enumerate(GRID) for c, w in zip(S.COMPONENTS, ws, strict=True))}),
    run AS (SELECT gid, qid, doc_id, round(sum(norm * w), 9) AS score FROM normed JOIN g USING (comp) GROUP BY ALL),
    rel AS (SELECT source AS qid, doc_id, max(quality) + max(toxic) AS rel FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2 HAVING rel > 0),
    p AS (SELECT *, row_number() OVER (PARTITION BY gid, qid ORDER BY score DESC, doc_id) AS place FROM run),
    dcg AS (SELECT gid, qid, sum((power(2, rel) - 1) / log2(place + 1)) AS dcg FROM p JOIN rel USING (qid, doc_id) WHERE place <= 10 GROUP BY 1, 2),
    ideal AS (SELECT qid, sum((power(2, rel) - 1) / log2(place + 1)) AS best FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, doc_id) AS place FROM rel) WHERE place <= 10 GROUP BY 1),
    pq AS (SELECT gid, qid, coalesce(dcg / best, 0) AS value FROM ideal CROSS JOIN (SELECT DISTINCT gid FROM g) LEFT JOIN dcg USING (gid, qid))"""
DRAWN = "CAST(concat('0x', substr(md5({0}), 1, 8)) AS BIGINT)"
SPLITS = f"sp AS (SELECT seed, qid, row_number() OVER (PARTITION BY seed ORDER BY {DRAWN.format('concat(seed, chr(58), qid)')}, qid) % 2 = 1 AS in_a FROM (SELECT DISTINCT source AS qid FROM documents), (SELECT unnest(range(20)) AS seed))"


def per_query(spark, sf):
    """gid, qid, value: nDCG of every weight of the grid for every query."""
    of = V.table(spark, sf, "documents").select("doc_id", F.col("source").alias("qid"))
    both = F.concat_ws("|", "comp", "qid")
    scores = V.scores(spark, sf).join(of, "doc_id").withColumn("group", both)
    normed = search.minmax(scores, "group")
    weights = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(i).alias("gid"), F.lit(c).alias("comp"), F.lit(float(w)).alias("w")) for i, ws in enumerate(GRID) for c, w in zip(S.COMPONENTS, ws, strict=True)])))
    run = ev.sweep(normed, weights).withColumn("score", F.round("score", 9))
    rel = V.table(spark, sf, "labels").join(of, "doc_id").groupBy("qid", "doc_id").agg((F.max("quality") + F.max("toxic")).alias("rel")).where("rel > 0")
    grid = F.explode(F.sequence(F.lit(0), F.lit(len(GRID) - 1))).alias("gid")
    key = F.struct("gid", "qid").alias("qid")
    got = ev.metrics(run.select(key, "doc_id", "score"), rel.select("qid", "doc_id", "rel", grid).select(key, "doc_id", "rel"))
    return got.select("qid.gid", "qid.qid", F.col("ndcg").alias("value"))


@query("split_members", f"WITH {SPLITS} SELECT CAST(seed AS INTEGER) AS seed, qid, in_a FROM sp")
def split_members(spark, sf):
    return ev.splits(V.table(spark, sf, "documents").select(F.col("source").alias("qid")))


@query("split_protocol", f"""WITH {PER_QUERY}, {SPLITS.replace('(SELECT DISTINCT source AS qid FROM documents)', '(SELECT qid FROM ideal)')}, m AS (SELECT seed, gid, round(avg(value), 9) AS mean FROM pq JOIN sp USING (qid) WHERE in_a GROUP BY 1, 2), b AS (SELECT seed, arg_max(gid, (mean, -gid)) AS best FROM m GROUP BY 1)
    SELECT CAST(seed AS INTEGER) AS seed, CAST(best AS INTEGER) AS best, count(*) AS n, round(avg(x.value - y.value), 6) AS delta FROM b JOIN sp USING (seed) JOIN pq x ON x.gid = best AND x.qid = sp.qid JOIN pq y ON y.gid = 0 AND y.qid = sp.qid WHERE NOT in_a GROUP BY 1, 2""")
def split_protocol(spark, sf):
    return rounded(ev.protocol(per_query(spark, sf), baseline=0), "delta").drop("p")


@query("bootstrap_interval", f"""WITH {PER_QUERY}, d AS (SELECT concat('g', x.gid) AS comparison, qid, x.value - y.value AS d, row_number() OVER (PARTITION BY x.gid ORDER BY qid) - 1 AS place, count(*) OVER (PARTITION BY x.gid) AS n FROM pq x JOIN pq y USING (qid) WHERE y.gid = 0 AND x.gid IN (7, 20, 34)),
    r AS (SELECT comparison, n, r, {DRAWN.format("concat(comparison, ':', r, ':', place)")} % n AS place FROM d, (SELECT unnest(range(500)) AS r)), m AS (SELECT comparison, r, avg(d.d) AS mean FROM r JOIN d USING (comparison, place) GROUP BY 1, 2)
    SELECT comparison, any_value(n) AS n, any_value(round(delta, 6)) AS delta, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM m JOIN (SELECT comparison, n, avg(d) AS delta FROM d GROUP BY 1, 2) USING (comparison) GROUP BY 1""")
def bootstrap_interval(spark, sf):
    pq = per_query(spark, sf)
    base = pq.where("gid = 0").select("qid", F.col("value").alias("b"))
    d = pq.where("gid in (7, 20, 34)").join(base, "qid").select(F.concat(F.lit("g"), F.col("gid").cast("string")).alias("comparison"), "qid", (F.col("value") - F.col("b")).alias("d"))
    return rounded(ev.bootstrap(d, 500), "delta", "low", "high")


@query("mode_ceiling", f"""WITH {PER_QUERY}, m AS (SELECT qid, CASE gid WHEN 0 THEN 'a' WHEN 20 THEN 'b' ELSE 'c' END AS mode, value FROM pq WHERE gid IN (0, 20, 34))
    SELECT concat('always ', mode) AS strategy, count(*) AS n, round(avg(value), 6) AS mean FROM m GROUP BY 1 UNION ALL SELECT 'auto', count(*), round(avg(value), 6) FROM m WHERE mode = CASE WHEN length(qid) <= 4 THEN 'b' ELSE 'c' END
    UNION ALL SELECT 'ceiling', count(*), round(avg(value), 6) FROM (SELECT qid, max(value) AS value FROM m GROUP BY 1)""")
def mode_ceiling(spark, sf):
    m = per_query(spark, sf).where("gid in (0, 20, 34)").select("qid", F.when(F.col("gid") == 0, "a").when(F.col("gid") == 20, "b").otherwise("c").alias("mode"), "value")
    rule = m.select("qid").distinct().withColumn("mode", F.when(F.length("qid") <= 4, "b").otherwise("c"))
    return rounded(ev.ceiling(m, rule), "mean")


# --- two builds of one graph ----------------------------------------------------------------------------
BUILDS = "i AS (SELECT user_id AS item, strftime(ts, '%Y-%m-%d') AS doc, event_id AS e FROM events WHERE user_id % 4 > 0 OR event_id % 50 = 0), ia AS (SELECT item, count(DISTINCT doc) AS n FROM i WHERE e % 3 <> 0 GROUP BY 1), ib AS (SELECT item, count(DISTINCT doc) AS n FROM i WHERE e % 3 <> 1 AND item % 11 <> 0 GROUP BY 1)"


def builds(spark, sf):
    i = V.table(spark, sf, "events").where("user_id % 4 > 0 or event_id % 50 = 0").select(F.col("user_id").alias("item"), F.date_format("ts", "yyyy-MM-dd").alias("doc"), F.col("event_id").alias("e"))
    return i.where("e % 3 <> 0").select("item", "doc"), i.where("e % 3 <> 1 and item % 11 <> 0").select("item", "doc")


@query("frequency_strata", f"WITH {BUILDS}, j AS (SELECT coalesce(a.n, 0) AS a, coalesce(b.n, 0) AS b, f FROM ia a FULL JOIN ib b USING (item), (VALUES (1), (2), (3), (5)) x(f)) SELECT f AS floor, count(*) FILTER (a >= f) AS n_a, count(*) FILTER (b >= f) AS n_b, count(*) FILTER (a >= f AND b >= f) AS \"both\", round(count(*) FILTER (a >= f AND b >= f) / count(*) FILTER (a >= f OR b >= f), 6) AS jaccard FROM j GROUP BY 1")
def frequency_strata(spark, sf):
    return rounded(ev.frequency_strata(*builds(spark, sf)), "jaccard")


@query("edge_loss", f"""WITH {BUILDS}, e AS (SELECT DISTINCT least(user_id, user_id * 7 % 50) AS src, greatest(user_id, user_id * 7 % 50) AS dst FROM events), k AS (SELECT DISTINCT least(user_id, user_id * 7 % 50) AS src, greatest(user_id, user_id * 7 % 50) AS dst FROM events WHERE user_id % 5 > 0),
    j AS (SELECT e.*, k.src IS NULL AS lost, bs.item IS NOT NULL AND bd.item IS NOT NULL AND s.item IS NOT NULL AND d.item IS NOT NULL AS alive, least(coalesce(s.n, 0), coalesce(d.n, 0)) AS low FROM e LEFT JOIN k USING (src, dst) LEFT JOIN ia s ON s.item = e.src LEFT JOIN ia d ON d.item = e.dst LEFT JOIN ib bs ON bs.item = e.src LEFT JOIN ib bd ON bd.item = e.dst)
    SELECT f AS floor, count(*) AS edges, count(*) FILTER (lost) AS lost, count(*) FILTER (alive) AS alive, count(*) FILTER (lost AND alive) AS lost_alive FROM j, (VALUES (1), (2), (3), (5)) x(f) WHERE low >= f GROUP BY 1""")
def edge_loss(spark, sf):
    e = V.table(spark, sf, "events").select(F.col("user_id").alias("src"), (F.col("user_id") * 7 % 50).alias("dst"))
    return ev.edge_loss(e, e.where("src % 5 > 0").select(F.col("dst").alias("src"), F.col("src").alias("dst")), *builds(spark, sf))


# --- whole views ------------------------------------------------------------------------------------------
NOTE_VIEW = f"""{V.NOTES}, n AS (SELECT doc_id, path, size, tags FROM notes), raw AS (SELECT doc_id, concat('n', doc_id + 1) AS t, 1 AS n FROM notes UNION ALL SELECT doc_id, concat('n', doc_id * 2), 1 FROM notes),
    lk AS (SELECT a.path AS src, coalesce(b.path, t) AS dst, sum(n) AS n FROM raw r JOIN n a USING (doc_id) LEFT JOIN n b ON concat('n', b.doc_id) = t GROUP BY 1, 2),
    ov AS (SELECT a.path AS src, b.path AS dst FROM n a JOIN n b ON b.doc_id = a.doc_id // 3 WHERE a.doc_id % 5 = 0), laid AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM lk UNION ALL SELECT src, dst FROM ov)),
    f AS (SELECT * FROM n WHERE NOT contains(path, 'src1/')), e0 AS (SELECT src, dst FROM laid WHERE src IN (SELECT path FROM f) AND (dst NOT IN (SELECT path FROM n) OR dst IN (SELECT path FROM f))),
    tg AS (SELECT DISTINCT path, unnest(tags) AS t FROM f), hub AS (SELECT t FROM tg GROUP BY t ORDER BY count(*) DESC, t LIMIT 4), e1 AS (SELECT * FROM e0 UNION ALL SELECT path, concat('#', t) FROM tg WHERE t IN (FROM hub)),
    d1 AS (SELECT id, count(*) AS d FROM (SELECT src AS id FROM e1 UNION ALL SELECT dst FROM e1) GROUP BY 1), v1 AS (SELECT id, coalesce(d, 0) AS d FROM (SELECT path AS id FROM f UNION SELECT dst FROM e1) LEFT JOIN d1 USING (id)),
    v2 AS (SELECT * FROM v1 ORDER BY d DESC, id LIMIT 150), e2 AS (SELECT src, dst, least(a.d, b.d) AS w FROM e1 JOIN v2 a ON a.id = src JOIN v2 b ON b.id = dst), e3 AS (SELECT src, dst FROM e2 ORDER BY w DESC, src, dst LIMIT 120)"""


def noted(spark, sf):
    n = V.table(spark, sf, "documents").selectExpr("doc_id", "concat(source, '/n', doc_id, '.md') AS path", "CAST(n_chars AS BIGINT) AS size", "array(concat('t', doc_id % 5), concat('t', doc_id % 7), lang) AS tags")
    raw = n.select(F.col("path").alias("src"), F.explode(F.array((F.col("doc_id") + 1), F.col("doc_id") * 2)).alias("k"))
    to = n.select(F.col("doc_id").alias("k"), F.col("path").alias("there"))
    links_ = raw.join(to, "k", "left").select("src", F.coalesce("there", F.concat(F.lit("n"), F.col("k").cast("string"))).alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("n"))
    over = n.where("doc_id % 5 = 0").select(F.col("path").alias("src"), F.floor(F.col("doc_id") / 3).alias("k")).join(to, "k").select("src", F.col("there").alias("dst"), F.lit(1).cast("long").alias("n"))
    return view.note_view(n, links_, (over,), view.Options(filter="-path:src1/", nodes=150, links=120, tag_hubs=4))


@query("note_view_nodes", f"WITH {NOTE_VIEW} SELECT v2.id, (SELECT count(*) FROM e3 WHERE src = v2.id) + (SELECT count(*) FROM e3 WHERE dst = v2.id) AS degree FROM v2")
def note_view_nodes(spark, sf):
    """The whole chain: filter, overlay, ghosts, tag hubs, node cap, link cap, recount."""
    return noted(spark, sf).nodes.select("id", "degree")


@query("note_view_edges", f"WITH {NOTE_VIEW} SELECT src, dst FROM e3")
def note_view_edges(spark, sf):
    return noted(spark, sf).edges


ENTITY_VIEW = f"""{V.ENTITIES}, g AS (SELECT entity_id AS id, degree, CASE WHEN entity_id % 4 = 0 THEN 'Other' ELSE concat('com', entity_id % 4) END AS grp FROM ent WHERE degree >= 2 AND NOT contains(lower(name), '7')),
    k AS (SELECT * FROM g WHERE grp <> 'com2' ORDER BY degree DESC, id LIMIT 90), l AS (SELECT rel_id AS ord, src_id AS src, tgt_id AS dst FROM rel WHERE src_id <> tgt_id AND src_id IN (SELECT id FROM k) AND tgt_id IN (SELECT id FROM k) ORDER BY 1 LIMIT 50)"""


def seen_entities(spark, sf):
    community = F.when(F.col("entity_id") % 4 > 0, F.concat(F.lit("com"), (F.col("entity_id") % 4).cast("string")))
    e = V.entities(spark, sf).select(F.col("entity_id").alias("id"), "name", "type", community.alias("community"), "degree")
    r = V.relations(spark, sf).select(F.col("rel_id").alias("ord"), F.col("src_id").alias("src"), F.col("tgt_id").alias("dst"))
    return view.entity_view(e, r, "community", view.Options(filter="-7", nodes=90, links=50, least_degree=2, hidden=("com2",)))


@query("entity_view_nodes", f"WITH {ENTITY_VIEW} SELECT id, grp AS \"group\", (SELECT count(*) FROM l WHERE src = k.id) AS out_degree, (SELECT count(*) FROM l WHERE dst = k.id) AS in_degree FROM k")
def entity_view_nodes(spark, sf):
    return seen_entities(spark, sf).nodes.select("id", "group", "out_degree", "in_degree")


@query("entity_view_edges", f"WITH {ENTITY_VIEW} SELECT src, dst FROM l")
def entity_view_edges(spark, sf):
    return seen_entities(spark, sf).edges.select("src", "dst")


@query("entity_view_legend", f"WITH {ENTITY_VIEW} SELECT grp AS name, count(*) AS n, grp = 'Other' AS last FROM g GROUP BY 1")
def entity_view_legend(spark, sf):
    """Hidden groups are counted too."""
    return view.ordered_legend(seen_entities(spark, sf))


# --- migration of frontmatter ------------------------------------------------------------------------------
FRONT = """concat('---\\ntitle: d', doc_id, CASE doc_id % 4 WHEN 0 THEN '\\nsources: [a, "s3:b", c]' WHEN 1 THEN '\\nsources: ["s1:a"]' WHEN 2 THEN '\\nsources: none' ELSE '' END,
    CASE WHEN doc_id % 3 = 0 THEN '\\ndistilled_by: model: x' WHEN doc_id % 3 = 1 THEN '\\ndistilled_by: m\\ngenerated_by: me' ELSE '' END, CASE WHEN doc_id % 5 = 0 THEN '\\ncaptured: 2024-01-02' ELSE '' END, '\\n---\\n', text)"""
FRONT_SQL = FRONT.replace("\\n", "' || chr(10) || '")
DONE_SQL = """concat('---', chr(10), 'title: d', doc_id, CASE doc_id % 4 WHEN 0 THEN chr(10) || 'sources: ["s4:a", "s3:b", "s5:c"]' WHEN 1 THEN chr(10) || 'sources: ["s1:a"]' WHEN 2 THEN chr(10) || 'sources: none' ELSE '' END,
    CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'distilled_by: model: x' WHEN doc_id % 3 = 1 THEN chr(10) || 'distilled_by: m' || chr(10) || 'generated_by: me' ELSE '' END, CASE WHEN doc_id % 5 = 0 THEN chr(10) || 'captured: 2024-01-02' ELSE '' END,
    CASE WHEN doc_id % 5 = 0 THEN chr(10) || 'generated_at: 2024-01-02' ELSE '' END, CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'generated_by: "model: x"' ELSE '' END, chr(10), '---', chr(10), text)"""


def fronted(spark, sf):
    return V.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.expr(FRONT).alias("raw"))


@query("frontmatter_plan", """SELECT CAST(doc_id AS VARCHAR) AS path, 'sources numbered' AS change FROM documents WHERE doc_id % 4 = 0 UNION ALL SELECT CAST(doc_id AS VARCHAR), 'generated_by from distilled_by' FROM documents WHERE doc_id % 3 = 0
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 'generated_at from captured' FROM documents WHERE doc_id % 5 = 0""")
def frontmatter_plan(spark, sf):
    return migrate.plan(fronted(spark, sf)).select("path", "change")


@query("frontmatter_migrated", f"SELECT CAST(doc_id AS VARCHAR) AS path, {DONE_SQL} AS raw FROM documents")
def frontmatter_migrated(spark, sf):
    """Whole notes, rewritten by the plan; a plan on the result is empty, which a test holds."""
    notes = fronted(spark, sf)
    return migrate.apply(notes, migrate.plan(notes))
