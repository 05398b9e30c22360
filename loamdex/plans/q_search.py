"""Search queries: chunks, inverted index, BM25, vectors, fusion, snippets, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loamdex import schema as S
from loamdex.functions import text as X
from loamdex.operators import evaluation as ev, index, lookup, search
from loamdex.plans import views as V
from loamdex.plans.registry import query
from loamdex.sources import published

ASKED = "thation with there"


def chunk_cte(size: int = 500, step: int = 450, keep_blank: bool = False) -> str:
    keep = "" if keep_blank else r" WHERE regexp_matches(text, '\S')"
    return f"""chunks AS (SELECT * FROM (SELECT d.doc_id, i AS seq, d.doc_id * 10000 + i AS chunk_id, i * {step} AS char_start, substr(d.text, i * {step} + 1, {size}) AS text
        FROM documents d, LATERAL (SELECT unnest(range(0, CAST(ceil(length(d.text) / {step}.0) AS BIGINT))) AS i) r){keep})"""


GRAMS = r"""grams AS (SELECT c.doc_id, c.chunk_id, p - 1 AS pos, substr(lower(c.text), p, n) AS term FROM chunks c, (VALUES (2), (3)) s(n), LATERAL (SELECT unnest(range(1, length(c.text) - n + 2)) AS p) r WHERE regexp_matches(substr(lower(c.text), p, n), '\S'))"""
CHUNKED = chunk_cte()


def asked_terms() -> str:
    return ", ".join("'" + t.replace("'", "''") + "'" for t in X.query_terms(ASKED))


def bm25_cte(k1: float = 1.2, b: float = 0.75, binary: bool = False) -> str:
    tf = "1.0" if binary else "tf"
    return f"""{CHUNKED}, {GRAMS}, lens AS (SELECT c.chunk_id, count(g.term) AS n FROM chunks c LEFT JOIN grams g USING (chunk_id) GROUP BY 1),
        tot AS (SELECT count(*) AS chunks, sum(n) / count(*) AS mean FROM lens),
        tfs AS (SELECT doc_id, chunk_id, term, count(*) AS tf FROM grams WHERE term IN ({asked_terms()}) GROUP BY ALL),
        dfs AS (SELECT term, ln((chunks - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM tfs, tot GROUP BY term, chunks),
        hits AS (SELECT doc_id, chunk_id, sum(idf * {tf} * ({k1} + 1) / ({tf} + {k1} * (1 - {b} + {b} * n / mean))) AS score FROM tfs JOIN dfs USING (term) JOIN lens USING (chunk_id), tot GROUP BY 1, 2),
        best AS (SELECT doc_id, max(score) AS score FROM hits GROUP BY 1)"""


def chunks(spark, sf, **kw) -> DataFrame:
    return index.chunk_table(V.table(spark, sf, "documents").select("doc_id", "text"), **kw)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("bm25_top20", f"WITH {V.DOCS}, {bm25_cte()} SELECT best.doc_id, round(score, 6) AS score, title, path FROM best JOIN docs USING (doc_id) ORDER BY round(best.score, 9) DESC, best.doc_id LIMIT 20")
def bm25_top20(spark, sf):
    held = V.search_index(spark, sf)
    hits = search.top(search.best_per_doc(published.bm25(held, ASKED)), S.ANSWERS)
    return rounded(search.with_metadata(hits, held.table("documents")), "score")


@query("bm25_scan", f"WITH {bm25_cte()} SELECT doc_id, round(score, 6) AS score FROM best")
def bm25_scan(spark, sf):
    """Without an index: the texts are read."""
    return rounded(search.best_per_doc(search.bm25(chunks(spark, sf), ASKED)), "score")


@query("index_tables", f"""WITH {CHUNKED}, {GRAMS}, t AS (SELECT term, chunk_id, count(*) AS tf, min(pos) AS first, max(pos) AS last FROM grams GROUP BY 1, 2)
    SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf, CAST(sum(first) AS BIGINT) AS firsts, CAST(sum(last) AS BIGINT) AS lasts, max(chunk_id) AS last_chunk, round(ln(((SELECT count(*) FROM chunks) - count(*) + 0.5) / (count(*) + 0.5) + 1), 6) AS idf FROM t GROUP BY 1""")
def index_tables(spark, sf):
    """All terms of the published index, from its postings and term table."""
    held = V.search_index(spark, sf)
    # a posting's positions rise: its first and last stand at the ends of its share of the row's
    ends = F.aggregate("tfs", F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("firsts"), F.lit(0).cast("long").alias("lasts")), lambda s, tf: F.struct(
        (s["at"] + tf).alias("at"), (s["firsts"] + F.get("positions", s["at"])).alias("firsts"), (s["lasts"] + F.get("positions", s["at"] + tf - 1)).alias("lasts"),
    ))
    sums = held.packed().select("term", F.size("positions").alias("tf"), "last_chunk", ends.alias("e")).groupBy("term").agg(
        F.sum("tf").alias("tf"), F.sum("e.firsts").alias("firsts"), F.sum("e.lasts").alias("lasts"), F.max("last_chunk").alias("last_chunk"),
    )
    return rounded(sums.join(held.table("ix_terms").select("term", "df", "idf"), "term"), "idf")


def _variant(name: str, **kw) -> None:
    sql = {k: v for k, v in kw.items()}

    @query(name, f"WITH {bm25_cte(**sql)} SELECT doc_id, round(score, 6) AS score FROM best ORDER BY round(best.score, 9) DESC, doc_id LIMIT 50")
    def run(spark, sf):
        return rounded(search.top(search.best_per_doc(published.bm25(V.search_index(spark, sf), ASKED, **kw)), 50), "score")


_variant("bm25_nolen", b=0.0)
_variant("bm25_idf_only", k1=0.0)
_variant("bm25_binary_tf", binary=True)
_variant("bm25_k1_half", k1=0.5)
_variant("bm25_k1_two", k1=2.0)


@query("chunks_500_50", f"WITH {CHUNKED} SELECT doc_id, CAST(seq AS INTEGER) AS seq, chunk_id, CAST(char_start AS INTEGER) AS char_start, substr(sha256(text), 1, 16) AS text_hash FROM chunks")
def chunks_500_50(spark, sf):
    return chunks(spark, sf).select("doc_id", "seq", "chunk_id", "char_start", X.content_hash("text").alias("text_hash"))


@query("chunks_2400_200", f"WITH {chunk_cte(2400, 2200, True)} SELECT doc_id, CAST(seq AS INTEGER) AS seq, CAST(length(text) AS INTEGER) AS n, substr(sha256(text), 1, 16) AS text_hash FROM chunks")
def chunks_2400_200(spark, sf):
    c = chunks(spark, sf, size=S.EXTRACT_CHUNK, overlap=S.EXTRACT_OVERLAP, keep_blank=True)
    return c.select("doc_id", "seq", F.char_length("text").alias("n"), X.content_hash("text").alias("text_hash"))


@query("ngram_doclen", f"WITH {CHUNKED}, {GRAMS} SELECT c.chunk_id, CAST(count(g.term) AS INTEGER) AS num_tokens FROM chunks c LEFT JOIN grams g USING (chunk_id) GROUP BY 1")
def ngram_doclen(spark, sf):
    return index.doclen(chunks(spark, sf))


@query("ngram_terms_df", f"WITH {CHUNKED}, {GRAMS}, t AS (SELECT term, count(DISTINCT chunk_id) AS df FROM grams GROUP BY 1) SELECT CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS term_id, term, CAST(df AS INTEGER) AS df, round(ln(((SELECT count(*) FROM chunks) - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM t")
def ngram_terms_df(spark, sf):
    c = chunks(spark, sf)
    terms = index.terms(index.chunk_counts(c), c.count())
    return rounded(terms.select("term_id", "term", "df", "idf"), "idf")


@query("ngram_postings", f"WITH {CHUNKED}, {GRAMS} SELECT term, chunk_id, CAST(count(*) AS INTEGER) AS tf, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM grams WHERE term IN ({asked_terms()}) GROUP BY 1, 2")
def ngram_postings(spark, sf):
    p = index.postings(chunks(spark, sf), X.query_terms(ASKED))
    return p.select("term", "chunk_id", "tf", F.array_join(F.transform("positions", lambda x: x.cast("string")), ",").alias("positions"))


@query("document_from_chunks", "SELECT doc_id, substr(sha256(text), 1, 16) AS text_hash FROM documents WHERE length(text) > 0")
def document_from_chunks(spark, sf):
    docs = V.table(spark, sf, "documents")
    c = index.chunk_table(docs.select("doc_id", "text"), keep_blank=True)
    return lookup.document_text(c, docs).select("doc_id", X.content_hash("text").alias("text_hash"))


@query("vector_topk", f"WITH v AS (SELECT vec_id, embedding AS vector FROM embeddings) SELECT vec_id, round({V.SQUARED}, 6) AS dist FROM v ORDER BY {V.SQUARED}, vec_id LIMIT 30")
def vector_topk(spark, sf):
    e = V.table(spark, sf, "embeddings").withColumnRenamed("embedding", "vector")
    return rounded(search.vector_top(e, V.query_vector(spark, sf), 30, "vec_id").select("vec_id", "dist"), "dist")


@query("chunk_vec_max_per_doc", f"WITH v AS (SELECT vec_id, embedding AS vector FROM embeddings), t AS (SELECT vec_id, {V.SQUARED} AS dist FROM v ORDER BY 2, 1 LIMIT 300) SELECT CAST(floor(vec_id / 4.0) AS BIGINT) AS doc_id, round(max(1 - dist / 2), 6) AS score FROM t GROUP BY 1")
def chunk_vec_max_per_doc(spark, sf):
    e = V.table(spark, sf, "embeddings").withColumnRenamed("embedding", "vector")
    t = search.vector_top(e, V.query_vector(spark, sf), S.DEPTHS["chunk"], "vec_id")
    return rounded(search.best_per_doc(t.select(F.floor(F.col("vec_id") / 4).alias("doc_id"), (1 - F.col("dist") / 2).alias("score"))), "score")


ENT_HITS = f"eh AS (SELECT entity_id, doc_ids, row_number() OVER (ORDER BY {V.SQUARED}, entity_id) - 1 AS rank FROM ent QUALIFY rank < 30)"
REL_HITS = f"rh AS (SELECT rel_id, src_id, tgt_id, doc_ids, row_number() OVER (ORDER BY {V.SQUARED}, rel_id) - 1 AS rank FROM rel QUALIFY rank < 40)"


def entity_hits(spark, sf):
    return search.ranked(search.vector_top(V.entities(spark, sf), V.query_vector(spark, sf), S.DEPTHS["entity"], "entity_id"), "dist", "entity_id")


def relation_hits(spark, sf, k=S.DEPTHS["relation"]):
    return search.ranked(search.vector_top(V.relations(spark, sf), V.query_vector(spark, sf), k, "rel_id"), "dist", "rel_id")


@query("entity_rrf", f"WITH {V.ENTITIES}, {ENT_HITS} SELECT doc_id, round(sum(1.0 / (60 + rank)), 6) AS score FROM (SELECT unnest(doc_ids) AS doc_id, rank FROM eh) GROUP BY 1")
def entity_rrf(spark, sf):
    return rounded(search.entity_component(entity_hits(spark, sf)), "score")


def hop_sql(hop: float) -> str:
    return f"""SELECT doc_id, sum(w) AS score FROM (SELECT unnest(doc_ids) AS doc_id, 1.0 / (60 + rank) AS w FROM rh
        UNION ALL SELECT unnest(ent.doc_ids), {hop} / (60 + rank) FROM (SELECT src_id AS e, rank FROM rh UNION ALL SELECT tgt_id, rank FROM rh) x JOIN ent ON entity_id = e) GROUP BY 1"""


@query("relation_rrf_hop", f"WITH {V.ENTITIES}, {REL_HITS}, s AS ({hop_sql(1.0)}) SELECT doc_id, round(score, 6) AS score FROM s")
def relation_rrf_hop(spark, sf):
    return rounded(search.relation_component(relation_hits(spark, sf), V.entities(spark, sf)), "score")


@query("hop_ablation", f"WITH {V.ENTITIES}, {REL_HITS}, " + ", ".join(f"s{i} AS ({hop_sql(h)})" for i, h in enumerate((0.0, 0.25, 0.5, 1.0))) + " " + " UNION ALL ".join(f"SELECT CAST({h} AS DOUBLE) AS hop, count(*) FILTER (WHERE score > 0) AS docs, round(sum(score), 6) AS total FROM s{i}" for i, h in enumerate((0.0, 0.25, 0.5, 1.0))))
def hop_ablation(spark, sf):
    hits, ents, out = relation_hits(spark, sf), V.entities(spark, sf), None
    for hop in (0.0, 0.25, 0.5, 1.0):
        s = search.relation_component(hits, ents, hop).agg(F.count_if(F.col("score") > 0).alias("docs"), F.round(F.sum("score"), 6).alias("total")).select(F.lit(hop).alias("hop"), "docs", "total")
        out = s if out is None else out.unionByName(s)
    return out


@query("relation_min_degree", f"WITH {V.ENTITIES}, h AS (SELECT *, row_number() OVER (ORDER BY {V.SQUARED}, rel_id) - 1 AS rank FROM rel QUALIFY rank < 160) SELECT rel_id, h.src_id, h.tgt_id, CAST(rank AS INTEGER) AS rank FROM h JOIN ent a ON a.entity_id = h.src_id JOIN ent b ON b.entity_id = h.tgt_id WHERE greatest(a.degree, b.degree) >= 3 ORDER BY rank LIMIT 40")
def relation_min_degree(spark, sf):
    k = S.DEPTHS["relation"]
    return search.relations_by_degree(relation_hits(spark, sf, 4 * k), V.entities(spark, sf), 3, k).select("rel_id", "src_id", "tgt_id", "rank")


NORMED = f"{V.SCORES}, normed AS (SELECT comp, doc_id, score, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-12 THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS norm FROM scores WINDOW w AS (PARTITION BY comp))"


@query("minmax_scores", f"WITH {NORMED} SELECT comp, doc_id, round(norm, 6) AS norm FROM normed")
def minmax_scores(spark, sf):
    return rounded(search.minmax(V.scores(spark, sf)).select("comp", "doc_id", "norm"), "norm")


def fuse_sql(weights) -> str:
    return "CASE comp " + " ".join(f"WHEN '{c}' THEN {w}" for c, w in zip(S.COMPONENTS, weights, strict=True)) + " END"


def _fusion(mode: str) -> None:
    w = S.PRESETS[mode]

    @query(f"fuse_{mode}", f"WITH {NORMED} SELECT doc_id, round(sum(norm * {fuse_sql(w)}), 6) AS score FROM normed GROUP BY 1 ORDER BY round(sum(norm * {fuse_sql(w)}), 9) DESC, doc_id LIMIT 20")
    def run(spark, sf):
        fused = search.fuse(search.minmax(V.scores(spark, sf)), w)
        return rounded(fused.orderBy(F.desc(F.round("score", 9)), "doc_id").limit(S.ANSWERS), "score")


for _mode in S.PRESETS:
    _fusion(_mode)


def _rrf(k: int) -> None:
    @query(f"rrf_k{k}", f"WITH {V.SCORES}, r AS (SELECT comp, doc_id, row_number() OVER (PARTITION BY comp ORDER BY score DESC, doc_id) AS r FROM scores) SELECT doc_id, round(sum(1.0 / ({k} + r)), 6) AS score FROM r GROUP BY 1")
    def run(spark, sf):
        return rounded(search.rrf(V.scores(spark, sf), k), "score")


for _k in (10, 30, 60):
    _rrf(_k)


@query("zscore_fusion", f"WITH {V.SCORES}, z AS (SELECT comp, doc_id, (score - avg(score) OVER w) / stddev_pop(score) OVER w AS norm FROM scores WINDOW w AS (PARTITION BY comp)) SELECT doc_id, round(sum(norm * {fuse_sql(S.PRESETS['default'])}), 6) AS score FROM z GROUP BY 1")
def zscore_fusion(spark, sf):
    return rounded(search.fuse(search.zscore(V.scores(spark, sf))), "score")


@query("cc_alpha", f"WITH {NORMED} SELECT doc_id, round(sum(norm * CASE comp WHEN 'bm25' THEN 0.2 ELSE 0.8 END), 6) AS score FROM normed WHERE comp IN ('bm25', 'chunk') GROUP BY 1")
def cc_alpha(spark, sf):
    two = search.minmax(V.scores(spark, sf).where("comp in ('bm25', 'chunk')"))
    return rounded(search.fuse(two, (0.2, 0.8), ("bm25", "chunk")), "score")


@query("tm2c2_fusion", f"WITH {V.SCORES}, n AS (SELECT comp, doc_id, (score - CASE comp WHEN 'chunk' THEN -1 ELSE 0 END) / (max(score) OVER (PARTITION BY comp) - CASE comp WHEN 'chunk' THEN -1 ELSE 0 END) AS norm FROM scores) SELECT doc_id, round(sum(norm * CASE comp WHEN 'bm25' THEN 0.2 ELSE 0.8 END), 6) AS score FROM n WHERE comp IN ('bm25', 'chunk') GROUP BY 1")
def tm2c2_fusion(spark, sf):
    two = search.theoretical_minmax(V.scores(spark, sf).where("comp in ('bm25', 'chunk')"), {"chunk": -1.0})
    return rounded(search.fuse(two, (0.2, 0.8), ("bm25", "chunk")), "score")


@query("search_origin_filtered", f"WITH {V.DOCS}, {V.SCORES}, kept AS (SELECT s.*, count(*) OVER (PARTITION BY comp) AS n FROM scores s JOIN docs USING (doc_id) WHERE origin = 'slack'), n AS (SELECT comp, doc_id, (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) AS norm FROM kept WHERE comp NOT IN ('entity', 'relation') OR n >= 3 WINDOW w AS (PARTITION BY comp)), f AS (SELECT doc_id, sum(norm * {fuse_sql(S.PRESETS['default'])}) AS score FROM n GROUP BY 1 ORDER BY round(score, 9) DESC, 1 LIMIT 20) SELECT doc_id, round(score, 6) AS score, title, path FROM f JOIN docs USING (doc_id) WHERE NOT no_llm")
def search_origin_filtered(spark, sf):
    s = V.scores(spark, sf)
    parts = {c: s.where(F.col("comp") == c) for c in S.COMPONENTS}
    return rounded(search.search(parts, V.docs(spark, sf), "default", origin="slack"), "score")


@query("search_hybrid", f"""WITH {V.DOCS}, {bm25_cte()}, {V.ENTITIES}, {ENT_HITS}, {REL_HITS}, v AS (SELECT vec_id, embedding AS vector FROM embeddings), cv AS (SELECT vec_id, {V.SQUARED} AS dist FROM v ORDER BY 2, 1 LIMIT 300),
    b3 AS (SELECT doc_id, chunk_id, score FROM hits ORDER BY round(score, 9) DESC, chunk_id LIMIT 300),
    s AS (SELECT 'bm25' AS comp, doc_id, max(score) AS score FROM b3 GROUP BY 2 UNION ALL SELECT 'chunk', CAST(floor(vec_id / 4.0) AS BIGINT), max(1 - dist / 2) FROM cv GROUP BY 2
        UNION ALL SELECT 'entity', doc_id, sum(1.0 / (60 + rank)) FROM (SELECT unnest(doc_ids) AS doc_id, rank FROM eh) GROUP BY 2 UNION ALL SELECT 'relation', * FROM ({hop_sql(1.0)})),
    n AS (SELECT comp, doc_id, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-12 THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS norm FROM s WINDOW w AS (PARTITION BY comp)),
    f AS (SELECT doc_id, sum(norm * {fuse_sql(S.PRESETS['default'])}) AS score FROM n GROUP BY 1 ORDER BY round(score, 9) DESC, 1 LIMIT 20) SELECT doc_id, round(score, 6) AS score, title, path FROM f JOIN docs USING (doc_id) WHERE NOT no_llm""")
def search_hybrid(spark, sf):
    q, vectors = V.query_vector(spark, sf), V.table(spark, sf, "embeddings").withColumnRenamed("embedding", "vector")
    near = search.vector_top(vectors, q, S.DEPTHS["chunk"], "vec_id").select(F.floor(F.col("vec_id") / 4).alias("doc_id"), (1 - F.col("dist") / 2).alias("score"))
    held = V.search_index(spark, sf)
    words = search.top(published.bm25(held, ASKED), S.DEPTHS["bm25"], tie="chunk_id")
    parts = {"bm25": search.best_per_doc(words), "chunk": search.best_per_doc(near), "entity": search.entity_component(entity_hits(spark, sf)), "relation": search.relation_component(relation_hits(spark, sf), V.entities(spark, sf))}
    return rounded(search.search(parts, V.indexed_docs(spark, sf, held)), "score")


@query("snippets_top2", f"WITH c AS (SELECT vec_id AS chunk_id, CAST(floor(vec_id / 4.0) AS BIGINT) AS doc_id, concat('chunk ', vec_id) AS text, list_inner_product(embedding::DOUBLE[], {V.QUERY_VECTOR}) AS d FROM embeddings) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY d DESC, chunk_id) AS INTEGER) AS place, chunk_id, substr(text, 1, 340) AS snippet FROM c QUALIFY place <= 2")
def snippets_top2(spark, sf):
    c = V.table(spark, sf, "embeddings").selectExpr("vec_id AS chunk_id", "CAST(floor(vec_id / 4.0) AS BIGINT) AS doc_id", "concat('chunk ', vec_id) AS text", "embedding AS vector")
    return search.snippets(c, c.select("doc_id"), V.query_vector(spark, sf))


# --- evaluation: component scores as runs, quality labels as judgements -----------------------------
RUNS = f"{V.SCORES}, run AS (SELECT comp AS qid, doc_id, score FROM scores), qrels AS (SELECT c.comp AS qid, doc_id, max(quality) + max(toxic) AS rel FROM labels, (VALUES ('bm25'), ('chunk'), ('entity'), ('relation')) c(comp) GROUP BY 1, 2)"


def run_and_qrels(spark, sf):
    comps = F.explode(F.array(*[F.lit(c) for c in S.COMPONENTS])).alias("qid")
    rel = V.table(spark, sf, "labels").groupBy("doc_id").agg((F.max("quality") + F.max("toxic")).alias("rel")).select(comps, "doc_id", "rel")
    return V.scores(spark, sf).select(F.col("comp").alias("qid"), "doc_id", "score"), rel


METRICS = f"""{RUNS}, p AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS place FROM run), h AS (SELECT p.*, rel FROM p LEFT JOIN qrels USING (qid, doc_id) WHERE place <= 20),
    got AS (SELECT qid, sum(CASE WHEN place <= 10 THEN (power(2, coalesce(rel, 0)) - 1) / log2(place + 1) ELSE 0 END) AS dcg, count(*) FILTER (WHERE rel > 0) AS found, min(CASE WHEN rel > 0 THEN place END) AS first, count(*) FILTER (WHERE place <= 10 AND rel IS NULL) AS unj, count(*) FILTER (WHERE place <= 10) AS shown FROM h GROUP BY 1),
    ideal AS (SELECT qid, sum(CASE WHEN place <= 10 THEN (power(2, rel) - 1) / log2(place + 1) ELSE 0 END) AS idcg, count(*) AS relevant FROM (SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, doc_id) AS place FROM qrels WHERE rel > 0) GROUP BY 1)"""


@query("ndcg_recall_mrr", f"WITH {METRICS} SELECT qid, round(coalesce(dcg / idcg, 0), 6) AS ndcg, round(coalesce(found / relevant, 0), 6) AS recall, round(coalesce(1.0 / first, 0), 6) AS mrr, round(coalesce(unj / shown, 0), 6) AS unjudged FROM ideal LEFT JOIN got USING (qid)")
def ndcg_recall_mrr(spark, sf):
    return rounded(ev.metrics(*run_and_qrels(spark, sf)), "ndcg", "recall", "mrr", "unjudged")


@query("known_item_mrr", f"WITH {V.SCORES}, p AS (SELECT comp AS qid, doc_id, row_number() OVER (PARTITION BY comp ORDER BY score DESC, doc_id) AS place FROM scores) SELECT qid, round(1.0 / place, 6) AS mrr FROM p WHERE doc_id = 17")
def known_item_mrr(spark, sf):
    run, _ = run_and_qrels(spark, sf)
    one = ev.placed(run).where("doc_id = 17")
    return one.select("qid", F.round(1.0 / F.col("place"), 6).alias("mrr"))


GRID = ev.grid(0.25)


@query("grid_sweep", f"WITH {NORMED}, g(gid, comp, w) AS (VALUES {', '.join(f'({i}, {chr(39)}{c}{chr(39)}, {w})' for i, ws in enumerate(GRID) for c, w in zip(S.COMPONENTS, ws, strict=True))}), s AS (SELECT gid, doc_id, sum(norm * w) AS score FROM normed JOIN g USING (comp) GROUP BY 1, 2) SELECT CAST(gid AS INTEGER) AS gid, count(*) AS docs, round(max(score), 6) AS best, round(avg(score), 6) AS mean FROM s GROUP BY 1")
def grid_sweep(spark, sf):
    cells = F.array(*[F.struct(F.lit(i).alias("gid"), F.lit(c).alias("comp"), F.lit(float(w)).alias("w")) for i, ws in enumerate(GRID) for c, w in zip(S.COMPONENTS, ws, strict=True)])
    weights = spark.range(1).select(F.inline(cells))
    s = ev.sweep(search.minmax(V.scores(spark, sf)).withColumn("qid", F.lit("q")), weights)
    return rounded(s.groupBy("gid").agg(F.count("*").alias("docs"), F.max("score").alias("best"), F.avg("score").alias("mean")), "best", "mean")


@query("jaccard_matrix", "WITH m AS (SELECT DISTINCT event_type AS label, user_id AS item FROM events), s AS (SELECT label, count(*) AS n FROM m GROUP BY 1), p AS (SELECT a.label AS a, b.label AS b, count(*) AS n FROM m a JOIN m b ON a.item = b.item AND a.label < b.label GROUP BY 1, 2) SELECT x.label AS a, y.label AS b, coalesce(p.n, 0) AS \"both\", round(coalesce(p.n, 0) / (x.n + y.n - coalesce(p.n, 0)), 6) AS jaccard FROM s x JOIN s y ON x.label < y.label LEFT JOIN p ON p.a = x.label AND p.b = y.label")
def jaccard_matrix(spark, sf):
    e = V.table(spark, sf, "events").select(F.col("event_type").alias("label"), F.col("user_id").alias("item"))
    return rounded(ev.overlap(e), "jaccard")


@query("pearson_partial", "WITH r AS (SELECT corr(l_quantity, l_extendedprice) AS xy, corr(l_quantity, l_discount) AS xz, corr(l_extendedprice, l_discount) AS yz FROM lineitem) SELECT round(xy, 6) AS r_xy, round(xz, 6) AS r_xz, round(yz, 6) AS r_yz, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS partial FROM r")
def pearson_partial(spark, sf):
    return rounded(ev.partial_correlation(V.table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", "l_discount"), "r_xy", "r_xz", "r_yz", "partial")


@query("wilcoxon_bh")
def wilcoxon_bh(spark, sf):
    n = search.minmax(V.scores(spark, sf)).groupBy("doc_id").pivot("comp", list(S.COMPONENTS)).agg(F.first("norm")).fillna(0.0)
    pairs = F.inline(F.array(*[F.struct(F.lit(f"bm25-{c}").alias("comparison"), F.col("bm25").alias("a"), F.col(c).alias("b")) for c in S.COMPONENTS[1:]]))
    return ev.compare(n.select(pairs))
