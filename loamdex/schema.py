"""Table schemas and the constants that define results."""

from __future__ import annotations

from pyspark.sql import types as T

# They decide which rows and scores come out.
CHUNK_SIZE, CHUNK_OVERLAP = 500, 50
EXTRACT_CHUNK, EXTRACT_OVERLAP = 2400, 200
NGRAM_LOW, NGRAM_HIGH = 2, 3
K1, B = 1.2, 0.75
BODY_FLOOR = 60
DEPTHS = {"bm25": 300, "chunk": 300, "entity": 30, "relation": 40}
HOP, ANSWERS, RRF, MIN_POPULATION = 1.0, 20, 60, 3
DOCS_CAP, NEIGHBOUR_CAP, CANDIDATE_CAP = 10, 20, 10
EVENTS_CAP, TIMELINE_CAP = 60, 12
SHRINK_GUARD, STALE_WARN = 0.67, 0.20
MIN_COMMUNITY, TOP_COMMUNITIES = 30, 20
COMPONENTS = ("bm25", "chunk", "entity", "relation")
PRESETS = {
    "default": (0.18, 0.05, 0.18, 0.59),
    "graph": (0.20, 0.00, 0.30, 0.50),
    "keyword": (1.00, 0.00, 0.00, 0.00),
    "vector": (0.00, 1.00, 0.00, 0.00),
    "legacy": (0.20, 0.80, 0.00, 0.00),
}
ORIGINS = ("vault", "session", "slack", "notion", "gdrive", "web")
CANON_TYPES = ("artifact", "tool", "project", "method", "failure", "decision", "metric", "event", "actor", "concept")
# They decide an entity's type.
TYPE_SYNONYMS = {
    "file": "artifact",
    "path": "artifact",
    "config": "artifact",
    "schema": "artifact",
    "format": "artifact",
    "field": "artifact",
    "system": "tool",
    "application": "tool",
    "platform": "tool",
    "framework": "tool",
    "infrastructure": "tool",
    "hardware": "tool",
    "library": "tool",
    "service": "tool",
    "repository": "project",
    "product": "project",
    "codebase": "project",
    "pattern": "method",
    "process": "method",
    "practice": "method",
    "technique": "method",
    "plan": "method",
    "algorithm": "method",
    "workflow": "method",
    "error": "failure",
    "bug": "failure",
    "issue": "failure",
    "incident": "failure",
    "choice": "decision",
    "tradeoff": "decision",
    "rationale": "decision",
    "measurement": "metric",
    "benchmark": "metric",
    "statistic": "metric",
    "activity": "event",
    "milestone": "event",
    "person": "actor",
    "organization": "actor",
    "group": "actor",
    "team": "actor",
    "company": "actor",
    "role": "actor",
    "goal": "concept",
    "feature": "concept",
    "capability": "concept",
    "domain": "concept",
    "context": "concept",
    "topic": "concept",
    "principle": "concept",
    "reference": "concept",
}

EVENT = T.StructType([T.StructField(n, t) for n, t in (("at", T.StringType()), ("doc_id", T.IntegerType()), ("rev", T.StringType()), ("at_exact", T.BooleanType()), ("text", T.StringType()))])
CHANGE = T.StructType([T.StructField("at", T.StringType()), T.StructField("change", T.StringType())])
SENSE = T.StructType([T.StructField("label", T.StringType()), T.StructField("cue", T.ArrayType(T.StringType()))])

TABLES = {
    "meta": "key string, value string",
    "documents": "doc_id int, path string, abs_path string, title string, source_url string, folder string, size bigint, mtime bigint, content_hash string, indexed_at bigint, origin string, agent string, doc_type string, doc_date string, date_src string, doc_updated string, no_llm boolean",
    "chunks": "chunk_id bigint, doc_id int, seq int, char_start int, text string, origin string, vector array<float>",
    "ix_terms": "term_id int, term string, df int, idf float",
    "ix_postings": "term_id int, chunk_id bigint, tf int, positions array<int>, pos_truncated boolean",
    "ix_doclen": "chunk_id bigint, num_tokens int",
    "lr_entities": "entity_id int, name string, name_norm string, type string, type_raw string, description string, doc_ids array<int>, degree int, first_seen string, last_seen string, timeline string, events string, senses string, vector array<float>",
    "lr_relations": "rel_id int, src_id int, tgt_id int, src_name string, tgt_name string, directed boolean, keywords array<string>, description string, weight float, doc_ids array<int>, first_seen string, last_seen string, timeline string, events string, senses string, vector array<float>",
    "stale_docs": "doc_id int, path string, reason string, marked_at bigint",
}
