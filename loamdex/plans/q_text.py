"""Text, privacy, transcript and extraction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamdex.functions import filters, masking, text as X
from loamdex.operators import extract, transcripts
from loamdex.plans import views as V
from loamdex.plans.q_search import chunk_cte, chunks
from loamdex.plans.registry import query
from loamdex.session import spread
from loamdex.sources import records, sinks, vault


@query("content_hash", "SELECT doc_id, substr(sha256(text), 1, 16) AS content_hash, md5(substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 400)) AS dedupe_key FROM documents")
def content_hash(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", X.content_hash("text").alias("content_hash"), X.dedupe_key("text").alias("dedupe_key"))


@query("doc_ids_crc32")
def doc_ids_crc32(spark, sf):
    return vault.refuse_collisions(V.plain_docs(spark, sf).select(X.stable_doc_id("path").alias("doc_id"), "path"))


@query("effective_date", "SELECT doc_id, greatest(a, b) AS day FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('2024-0', 1 + doc_id % 9, '-10') END AS a, CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat('2024-0', 1 + doc_id % 7, '-20') END AS b FROM documents)")
def effective_date(spark, sf):
    d = V.table(spark, sf, "documents").selectExpr("doc_id", "CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('2024-0', 1 + doc_id % 9, '-10') END AS a", "CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat('2024-0', 1 + doc_id % 7, '-20') END AS b")
    return d.select("doc_id", X.effective_date("a", "b").alias("day"))


@query("bad_dates", "SELECT d, d <> '' AND NOT regexp_full_match(d, '\\d{4}-\\d{2}-\\d{2}') AS bad FROM (VALUES ('2024-01-02'), ('2026-13-99'), (''), ('01/02/2024'), ('2024-1-2')) v(d)")
def bad_dates(spark, sf):
    return spark.sql("SELECT * FROM VALUES ('2024-01-02'), ('2026-13-99'), (''), ('01/02/2024'), ('2024-1-2') AS t(d)").withColumn("bad", X.bad_date("d"))


@query("norm_names", "SELECT p_partkey, trim(trim(regexp_replace(concat(' ', p_name, '  x '), '\\s+', ' ', 'g')), ' .,·-') AS name FROM part")
def norm_names(spark, sf):
    return V.table(spark, sf, "part").select("p_partkey", X.norm_name(F.concat(F.lit(" "), "p_name", F.lit("  x  (a note)"))).alias("name"))


@query("norm_types", "SELECT k, t FROM (VALUES ('Bug', 'failure'), ('person', 'actor'), ('tool', 'tool'), ('widget', 'other'), ('', 'concept')) v(k, t)")
def norm_types(spark, sf):
    return spark.sql("SELECT * FROM VALUES ('Bug'), ('person'), ('tool'), ('widget'), ('') AS t(k)").withColumn("t", X.norm_type("k"))


@query("merge_keys", "SELECT p_partkey, regexp_replace(lower(p_name), '[^0-9a-z가-힣]', '', 'g') AS key, regexp_replace(lower(p_name), '[^0-9a-z]+', '-', 'g') AS slug FROM part")
def merge_keys(spark, sf):
    return V.table(spark, sf, "part").select("p_partkey", X.merge_key("p_name").alias("key"), X.slugify("p_name").alias("slug"))


@query("token_estimate", "SELECT doc_id, CAST(floor(strlen(text) / 3) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", X.token_estimate("text").alias("tokens"))


@query("url_extract", "WITH u AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS url FROM pages) SELECT page_id, url, count(*) AS n FROM u WHERE regexp_full_match(url, '(?i)https?://[^\\s/@?#:]+\\.[^\\s/@?#:]+(:\\d+)?([/?#]\\S*)?') GROUP BY 1, 2")
def url_extract(spark, sf):
    u = V.table(spark, sf, "pages").select("page_id", F.explode(X.hrefs("html")).alias("url"))
    return u.where(X.external_url("url").isNotNull()).groupBy("page_id", "url").agg(F.count("*").alias("n"))


OWN_LINKS = "html || '<a href=\"https://site' || page_id % 7 || '.example.org:80/p?q=' || page_id || '\">x</a><a href=\"ftp://a.b/c\"><a href=\"http://u@a.b/\"><a href=\"http://nodot/\"><a href=\"HTTP://a.b\">'"


@query("url_extract_external", f"WITH u AS (SELECT page_id, unnest(regexp_extract_all({OWN_LINKS}, 'href=\"([^\"]*)\"', 1)) AS url FROM pages) SELECT page_id, url, count(*) AS n FROM u WHERE regexp_full_match(url, '(?i)https?://[^\\s/@?#:]+\\.[^\\s/@?#:]+(:\\d+)?([/?#]\\S*)?') GROUP BY 1, 2")
def url_extract_external(spark, sf):
    """Whole pages with five more links, of which two are external addresses."""
    u = V.table(spark, sf, "pages").select("page_id", F.explode(X.hrefs(F.expr(OWN_LINKS))).alias("url"))
    return u.where(X.external_url("url").isNotNull()).groupBy("page_id", "url").agg(F.count("*").alias("n"))


@query("page_urls", "SELECT page_id, url FROM pages WHERE regexp_full_match(url, '(?i)https?://[^\\s/@?#:]+\\.[^\\s/@?#:]+(:\\d+)?([/?#]\\S*)?')")
def page_urls(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", X.external_url("url").alias("url")).where("url is not null")


@query("note_filter_dsl", f"WITH {V.NOTES} SELECT path FROM notes WHERE contains(lower(path), 'src1') AND contains(lower(split_part(path, '/', -1)), 'n1') AND NOT contains(lower(path), '5') AND list_contains(tags, 't2')")
def note_filter_dsl(spark, sf):
    return V.notes(spark, sf).where(filters.matches('path:SRC1 file:n1 -"5" tag:t2', tags="tags")).select("path")


@query("skip_paths", f"WITH {V.NOTES} SELECT path FROM notes WHERE NOT (path LIKE 'src3/%' OR path LIKE 'src7/%')")
def skip_paths(spark, sf):
    return V.notes(spark, sf).where(~vault.skipped("path", folders=("src3",), prefixes=("SRC7",))).select("path")


@query("folder_stats", f"WITH {V.NOTES} SELECT split_part(path, '/', 1) AS folder, count(*) AS n FROM notes GROUP BY 1")
def folder_stats(spark, sf):
    return V.notes(spark, sf).groupBy(X.top_folder("path").alias("folder")).agg(F.count("*").alias("n"))


@query("legend_other_last", "SELECT lang AS kind, count(*) AS n, CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS last FROM documents GROUP BY 1")
def legend_other_last(spark, sf):
    d = V.table(spark, sf, "documents").groupBy(F.col("lang").alias("kind")).agg(F.count("*").alias("n"))
    return d.withColumn("last", F.when(F.col("kind") == "en", 1).otherwise(0)).orderBy("last", F.desc("n"), "kind")


@query("mask_secrets")
def mask_secrets(spark, sf):
    """Every document masked, with the count of each pattern; a test holds it against the plain expressions."""
    m = masking.masked(spread(V.table(spark, sf, "documents").select("doc_id", "text")))
    counts = F.array_sort(F.transform(F.map_entries("mask_counts"), lambda e: F.concat_ws(":", e["key"], e["value"])))
    return m.select("doc_id", F.md5("text").alias("masked_md5"), F.array_join(counts, ",").alias("counts"))


@query("leak_counts", "SELECT 'AWS_KEY' AS name, count(*) AS n FROM documents WHERE regexp_matches(text, '\\bAKIA[0-9A-Z]{16}\\b') HAVING count(*) > 0 UNION ALL SELECT 'GENERIC_SECRET', count(*) FROM documents WHERE regexp_matches(text, '(?i)(^|[^A-Za-z0-9])(api[_\\-]?key|access[_\\-]?token|client[_\\-]?secret|password|passwd|token|secret|key)[\"'']?\\s*[=:]\\s*[\"'']?[A-Za-z0-9_\\-/+=]{16,}') HAVING count(*) > 0")
def leak_counts(spark, sf):
    return spread(V.table(spark, sf, "documents").select("text")).select(F.explode(masking.leaks("text")).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


@query("noise_filter", r"""WITH s AS (SELECT conv_id, turn, trim(text, E' \t\r\n') AS s FROM conversations), h AS (SELECT *, string_split(s, E'\n')[1:20] AS head FROM s) SELECT conv_id, turn FROM h WHERE NOT (length(s) < 40 OR len(list_filter(head, lambda x: regexp_matches(x, '^\s*(\d+[\t→|]|\|.*\||[-=_*]{3,}\s*$|[+-]{3} )'))) >= greatest(3.0, len(head) * 0.5))""")
def noise_filter(spark, sf):
    return V.table(spark, sf, "conversations").where(~X.is_noise("text")).select("conv_id", "turn")


@query("transcript_dedupe", r"""WITH k AS (SELECT conv_id, turn, role, text, md5(substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 400)) AS k FROM conversations WHERE length(trim(text, E' \t\r\n')) >= 40), f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY conv_id, k ORDER BY turn) = 1) SELECT conv_id AS session, count(*) AS n_msg, min(turn) AS first_turn, max(turn) AS last_turn, md5(string_agg(concat('**', CASE role WHEN 'user' THEN 'Me' ELSE 'Agent' END, '**: ', substr(text, 1, 6000)), E'\n\n' ORDER BY turn)) AS text_hash FROM f GROUP BY 1""")
def transcript_dedupe(spark, sf):
    t = transcripts.assemble(V.table(spark, sf, "conversations").withColumnRenamed("conv_id", "session"))
    return t.select("session", "n_msg", "first_turn", "last_turn", F.md5("text").alias("text_hash"))


@query("session_tail", "SELECT conv_id, turn FROM conversations WHERE turn > 1 AND turn <= 3")
def session_tail(spark, sf):
    return transcripts.tail(V.table(spark, sf, "conversations"), 1, 3).select("conv_id", "turn")


@query("session_windows_head_tail", "WITH n AS (SELECT doc_id, text, CAST(ceil(length(text) / 1000.0) AS BIGINT) AS n FROM documents), e AS (SELECT doc_id, n, i AS idx, substr(text, i * 1000 + 1, 1000) AS t FROM n, LATERAL (SELECT unnest(range(0, n)) AS i) r) SELECT doc_id, CAST(idx AS INTEGER) AS idx, md5(t) AS text_hash FROM e WHERE n <= 8 OR idx < 4 OR idx >= n - 4")
def session_windows_head_tail(spark, sf):
    f = transcripts.fragments(V.table(spark, sf, "documents").select("doc_id", "text"), "doc_id", size=1000, most=8)
    return f.select("doc_id", "idx", F.md5("text").alias("text_hash"))


@query("slug_collisions", "WITH s AS (SELECT p_partkey AS ord, lower(p_brand) AS slug FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY ord) AS n FROM s) SELECT ord, CASE WHEN n > 1 THEN concat(slug, '-v', n) ELSE slug END AS unique_slug FROM r")
def slug_collisions(spark, sf):
    s = V.table(spark, sf, "part").select(F.col("p_partkey").alias("ord"), F.lower("p_brand").alias("slug"))
    return transcripts.collision_slugs(s).select("ord", "unique_slug")


@query("session_lineage_root", "WITH RECURSIVE s AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 6 = 0 THEN -1 ELSE s_suppkey - 1 END AS parent FROM supplier), w AS (SELECT id, id AS root FROM s WHERE parent NOT IN (SELECT id FROM s) UNION ALL SELECT s.id, w.root FROM s JOIN w ON s.parent = w.id) SELECT id, root FROM w")
def session_lineage_root(spark, sf):
    return transcripts.chain_roots(V.table(spark, sf, "supplier").selectExpr("s_suppkey AS id", "CASE WHEN s_suppkey % 6 = 0 THEN -1 ELSE s_suppkey - 1 END AS parent"))


@query("sessions_excluding", "WITH m AS (SELECT conv_id AS session, conv_id * 10 + turn AS id FROM conversations) SELECT DISTINCT session FROM m WHERE session NOT IN (SELECT session FROM m WHERE id % 7 = 0)")
def sessions_excluding(spark, sf):
    m = V.table(spark, sf, "conversations").selectExpr("conv_id AS session", "conv_id * 10 + turn AS id")
    grouped = m.groupBy("session").agg(F.collect_list("id").alias("members"))
    return transcripts.excluding(grouped, m.where("id % 7 = 0").select("id")).select("session")


@query("settled_sessions", "SELECT user_id, max(ts) > TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 6 HOUR AS open FROM events GROUP BY 1")
def settled_sessions(spark, sf):
    s = V.table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("last_ts"))
    return transcripts.settled_sessions(s, "2024-01-30 12:00:00").select("user_id", "open")


@query("canvas_links", "SELECT n_name AS src, concat('f', n_regionkey, '.md') AS dst, CAST(2 AS BIGINT) AS n FROM nation")
def canvas_links(spark, sf):
    raw = F.concat(F.lit('{"nodes":[{"type":"file","file":"f'), "n_regionkey", F.lit('.md"},{"type":"text"},{"type":"file","file":"f'), "n_regionkey", F.lit('.md"}]}'))
    return records.canvas_links(V.table(spark, sf, "nation").select(F.col("n_name").alias("path"), raw.alias("raw")))


@query("okf_documents", """SELECT doc_id, concat(E'---\\ntitle: "', lang, E'"\\ntype: "note"\\ncreated: "2024-01-01"\\nsource: ""\\n---\\n\\n', text) AS value FROM documents""")
def okf_documents(spark, sf):
    d = V.table(spark, sf, "documents").selectExpr("doc_id", "lang AS path", "lang AS title", "'note' AS doc_type", "'2024-01-01' AS doc_date", "CAST(NULL AS STRING) AS source_url", "text")
    return sinks.okf_document(d).select("doc_id", "value")


@query("clean_descriptions", r"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents), p AS (SELECT doc_id, t, list_filter(list_transform(string_split(regexp_replace(t, '([.。!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' .·')), lambda x: length(x) >= 12) AS p FROM t),
    s AS (SELECT doc_id, t, p[1] AS a, list_filter(p, lambda x: lower(substr(x, 1, 40)) <> lower(substr(p[1], 1, 40)))[1] AS b FROM p), o AS (SELECT doc_id, CASE WHEN a IS NULL THEN t WHEN b IS NULL THEN a ELSE concat(a, '. ', b) END AS o FROM s)
    SELECT doc_id, CASE WHEN length(o) > 240 THEN concat(rtrim(substr(o, 1, 240)), '…') ELSE o END AS description FROM o""")
def clean_descriptions(spark, sf):
    return spread(V.table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", X.clean_desc("text").alias("description"))


@query("extraction_batches", f"WITH {chunk_cte()} SELECT chunk_id, CAST(floor((row_number() OVER (ORDER BY CAST(chunk_id AS VARCHAR)) - 1) / 50) AS BIGINT) AS batch FROM chunks")
def extraction_batches(spark, sf):
    c = chunks(spark, sf).withColumn("chunk_id", F.col("chunk_id").cast("string"))
    return extract.batches(c, 50).select(F.col("chunk_id").cast("long").alias("chunk_id"), "batch")


@query("summary_groups", "WITH g AS (SELECT user_id AS name, list(concat(event_type, event_id) ORDER BY event_id) AS d FROM events GROUP BY 1) SELECT name, CAST(len(d) AS INTEGER) AS n FROM g WHERE len(d) >= 70")
def summary_groups(spark, sf):
    g = V.table(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("name")).agg(F.array_sort(F.collect_list(F.concat("event_type", "event_id"))).alias("descriptions"))
    cache = spark.sql("SELECT '' AS key")
    return extract.to_summarise(g, cache, 70).select(F.col("name").cast("long").alias("name"), F.size("descriptions").alias("n"))


@query("encode_hashed")
def encode_hashed(spark, sf):
    return extract.encode(V.table(spark, sf, "benchmark").select("item_id", "text"))


@query("extract_rules")
def extract_rules(spark, sf):
    c = chunks(spark, sf).select(F.col("doc_id").alias("doc"), F.col("seq").alias("idx"), "text")
    return extract.extract(c).select("doc", "idx", "h", "pv", F.size("entities").alias("entities"), F.size("relationships").alias("relationships"))
