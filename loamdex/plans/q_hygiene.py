"""Queries of transcript hygiene, masks of stores, page ownership and entity cards."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamdex.operators import entity_card, hygiene
from loamdex.plans import views as V
from loamdex.plans.q_graph import EVENTS, VERDICT, with_events
from loamdex.plans.registry import query
from loamdex.session import spread

PROMPT = f"""concat(CASE conv_id % 5 WHEN 0 THEN '  {hygiene.MARK} a -->' WHEN 1 THEN 'log **Me**: {hygiene.OPENINGS[0]} ' WHEN 2 THEN 'why is it called {hygiene.MARK} here' ELSE '' END, text)"""


@query("pipeline_calls", rf"""WITH t AS (SELECT conv_id, turn, substr({PROMPT}, 1, 1200) AS h FROM conversations), f AS (SELECT conv_id, turn, ltrim(CASE WHEN contains(h, '**Me**:') THEN substr(h, instr(h, '**Me**:') + 7) ELSE h END, E' \t\r\n\f\v') AS first FROM t)
    SELECT conv_id, turn, {" OR ".join(f"starts_with(first, '{o}')" for o in (hygiene.MARK, *hygiene.OPENINGS))} AS called FROM f""")
def pipeline_calls(spark, sf):
    return V.table(spark, sf, "conversations").select("conv_id", "turn", hygiene.is_pipeline_call(F.expr(PROMPT)).alias("called"))


TURN = r"""concat(CASE turn % 3 WHEN 0 THEN '# Rules of the house{nl}<INSTRUCTIONS>{nl}be brief{nl}</INSTRUCTIONS>{nl}' WHEN 1 THEN '# A heading of its own{nl}' ELSE '' END, text, '{nl}{nl}<system-reminder> x{nl}{nl}| a | b |{nl}{nl}    12{tab}code{nl}{nl}', repeat('-', 40))"""
SQL_TURN = TURN.replace("{nl}", "' || chr(10) || '").replace("{tab}", "' || chr(9) || '")


@query("rollout_assembly", rf"""WITH t AS (SELECT conv_id, turn, {SQL_TURN} AS t FROM conversations WHERE role IN ('user', 'assistant')),
    r AS (SELECT conv_id, turn, trim(CASE WHEN regexp_matches(t, '(?s)<INSTRUCTIONS>.*?</INSTRUCTIONS>') THEN regexp_replace(regexp_replace(t, '(?s)<INSTRUCTIONS>.*?</INSTRUCTIONS>', '', 'g'), '(?m)^\s*#{{1,6}}[^\n]*$', '', 'g') ELSE t END, E' \t\r\n\f\v') AS b FROM t),
    p AS (SELECT conv_id, turn, trim(array_to_string(list_filter(string_split(b, E'\n\n'), lambda x: trim(x, E' \t\r\n\f\v') <> '' AND NOT regexp_matches(trim(x, E' \t\r\n\f\v'), '^(<system-reminder>|<command-name>|<local-command-|Caveat: The messages below|\[Request interrupted|\s*\|.{{0,4}}\|.{{0,4}}\||\s*(\d+→|\s{{4,}}\d+\t)|[\s\-=_*#]{{40,}}$)')), E'\n\n'), E' \t\r\n\f\v') AS b FROM r),
    f AS (SELECT * FROM p WHERE b <> '' QUALIFY row_number() OVER (PARTITION BY conv_id, md5(regexp_replace(b, '\s+', ' ', 'g')) ORDER BY turn) = 1)
    SELECT conv_id, count(*) AS n_msg, min(turn) AS first_turn, max(turn) AS last_turn, md5(string_agg(b, E'\n\n' ORDER BY turn)) AS text_md5 FROM f GROUP BY 1""")
def rollout_assembly(spark, sf):
    turns = V.table(spark, sf, "conversations").withColumn("text", F.expr(TURN.replace("{nl}", r"\n").replace("{tab}", r"\t")))
    return hygiene.assemble_rollout(turns, "conv_id").select("conv_id", "n_msg", "first_turn", "last_turn", F.md5("text").alias("text_md5"))


@query("clean_tail")
def clean_tail(spark, sf):
    """What was said after the first turn of each conversation; a test holds it against a plain walk."""
    turns = V.table(spark, sf, "conversations").withColumn("text", F.concat("text", F.lit("\npassword = "), F.md5("text")))
    tail = hygiene.clean_tail(spread(turns), 0, through=6, session="conv_id")
    return tail.select("conv_id", "n_msg", "last_turn", F.md5("text").alias("text_md5"), F.try_element_at("mask_counts", F.lit("GENERIC_SECRET")).alias("masked"))


@query("remask_totals")
def remask_totals(spark, sf):
    """Patterns found in a store of documents, one of which was written into each; a test holds it against the plain expressions and runs it twice."""
    store = V.table(spark, sf, "documents").select("doc_id", F.concat("text", F.lit("\npassword = "), F.md5("text")).alias("text"))
    return hygiene.remask_totals(hygiene.remask(spread(store)))


RAW = r"""concat('---{nl}title: x{nl}', CASE doc_id % 5 WHEN 0 THEN 'sources:{nl}  - resource: agent-session://a' WHEN 1 THEN 'about: |{nl}  resource: agent-session://a{nl}  more{nl}last: 1' WHEN 2 THEN 'about: >-{nl}  words{nl}resource: "agent-session://b"' WHEN 3 THEN 'about: |2{nl}  words{nl}{nl}  resource: agent-session://c' ELSE 'note: 1' END, '{nl}---{nl}resource: agent-session://z{nl}', text)"""
PATH = "concat(source, '/', CASE doc_id % 7 WHEN 0 THEN 'deep/' ELSE '' END, doc_id, CASE doc_id % 11 WHEN 0 THEN '.txt' ELSE '.md' END)"


@query("page_ownership", rf"""WITH p AS (SELECT {PATH} AS path, {RAW.replace("{nl}", "' || chr(10) || '")} AS raw FROM documents), touched AS (SELECT DISTINCT source AS dir FROM documents),
    h AS (SELECT path, regexp_extract(raw, '(?s)^\s*---[ \t]*\r?\n(.*?)\r?\n(?:---|\.\.\.)[ \t]*(?:\r?\n|$)', 1) AS fm FROM p WHERE regexp_extract(path, '^(.*)/[^/]*$', 1) IN (SELECT dir FROM touched)),
    s AS (SELECT path, regexp_replace(fm, '(?m)^([^ \t\n:#][^:\n]*:[ \t]*[|>][-+0-9]*[ \t]*)((?:\n[ \t]+[^ \t\n][^\n]*)+)', '\1', 'g') AS fm FROM h)
    SELECT path, CASE WHEN path LIKE '%.md' AND regexp_matches(fm, '(?m)^[ \t]*(?:-[ \t]+)?resource:[ \t]*["'']?[a-z]+-session://') THEN 'ours' ELSE 'foreign' END AS owner FROM s""")
def page_ownership(spark, sf):
    d = V.table(spark, sf, "documents")
    pages = d.select(F.expr(PATH).alias("path"), F.expr(RAW.replace("{nl}", r"\n")).alias("raw"))
    return hygiene.ownership(pages, d.select(F.col("source").alias("dir")))


ASKED = "CASE n_nationkey % 5 WHEN 0 THEN concat('ENTITY ', n_nationkey * 7) WHEN 1 THEN concat('entity-', n_nationkey * 3) WHEN 2 THEN concat('ity ', n_nationkey) WHEN 3 THEN n_name ELSE concat('  Entity   ', n_nationkey, ' (note)') END"


@query("entity_cards", rf"""WITH {V.DOCS}, {VERDICT}, {EVENTS}, a AS (SELECT DISTINCT {ASKED} AS asked FROM nation),
    q AS (SELECT asked, lower(trim(regexp_replace(regexp_replace(asked, '\s+', ' ', 'g'), '\s*\([^)]*\)\s*$', ''))) AS q, regexp_replace(lower(asked), '[^0-9a-z]', '', 'g') AS k FROM a),
    m AS (SELECT asked, entity_id, name, degree, verdict, CASE WHEN lower(name) = q THEN 1 WHEN regexp_replace(lower(name), '[^0-9a-z]', '', 'g') = k THEN 2 ELSE 3 END AS tier FROM q JOIN ent ON lower(name) = q OR regexp_replace(lower(name), '[^0-9a-z]', '', 'g') = k OR contains(lower(name), q) JOIN verdicts USING (entity_id)),
    b AS (SELECT * FROM m QUALIFY tier = min(tier) OVER (PARTITION BY asked)), r AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY degree DESC, entity_id) AS place FROM b WHERE tier < 3 OR verdict <> 'block'),
    hit AS (SELECT * FROM r WHERE tier < 3 AND place = 1), cand AS (SELECT asked, string_agg(name, ',' ORDER BY place) AS candidates FROM r WHERE tier = 3 AND place <= 10 GROUP BY 1),
    ch AS (SELECT entity_id, count(*) FILTER (WHERE dt <= '2024-06-30') AS upto, count(*) FILTER (WHERE dt > '2024-06-30') AS after FROM ev GROUP BY 1),
    d AS (SELECT entity_id, doc_id, row_number() OVER (PARTITION BY entity_id ORDER BY doc_date DESC, doc_id) AS p FROM (SELECT DISTINCT ev.entity_id, d AS doc_id FROM ev JOIN verdicts USING (entity_id) WHERE verdict = 'pass' OR d NOT IN (FROM blocked)) JOIN docs USING (doc_id)),
    dd AS (SELECT entity_id, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY p) AS docs FROM d WHERE p <= 10 GROUP BY 1)
    SELECT asked, CASE WHEN hit.entity_id IS NULL THEN 'name_not_found' WHEN verdict = 'block' THEN 'blocked' END AS error, CASE WHEN verdict <> 'block' THEN name END AS matched, CASE WHEN verdict = 'pass' THEN degree END AS degree,
        CAST(CASE verdict WHEN 'pass' THEN upto WHEN 'redact' THEN 0 END AS INTEGER) AS change_count, CAST(CASE verdict WHEN 'pass' THEN after WHEN 'redact' THEN 0 END AS INTEGER) AS changes_after,
        CASE WHEN verdict <> 'block' THEN docs END AS docs, coalesce(candidates, '') AS candidates FROM a LEFT JOIN hit USING (asked) LEFT JOIN cand USING (asked) LEFT JOIN ch USING (entity_id) LEFT JOIN dd USING (entity_id)""")
def entity_cards(spark, sf):
    asked = V.table(spark, sf, "nation").select(F.expr(ASKED).alias("asked"))
    c = entity_card.cards(with_events(spark, sf), asked, V.plain_docs(spark, sf), V.toxic(spark, sf), "2024-06-30")
    listed = F.array_join(F.transform("docs", lambda d: d["doc_id"].cast("string")), ",").alias("docs")
    return c.select("asked", "error", "matched", "degree", "change_count", "changes_after", listed, F.array_join("candidates", ",").alias("candidates"))
