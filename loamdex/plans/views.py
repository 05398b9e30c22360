"""The tables that queries run on, made from the given Parquet tables; each view stands in SQL beside it."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from loamdex import schema as S
from loamdex.session import shared_dir
from loamdex.sources import published


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_ORIGIN = "CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN '{o}'" for i, o in enumerate(S.ORIGINS)) + " END"
_DOC = ["doc_id", "text", "concat(source, '/', doc_id, '.md') AS path", "source AS folder", f"{_ORIGIN} AS origin", "substr(text, 1, 40) AS title"]
DOCS = f"""docs AS (SELECT {", ".join(f"d.{c}" if c in ("doc_id", "text") else c for c in _DOC)}, strftime(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER), '%Y-%m-%d') AS doc_date,
    doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS no_llm FROM documents d)"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocked = toxic(spark, sf_dir).withColumn("no_llm", F.lit(True))
    d = table(spark, sf_dir, "documents").selectExpr(*_DOC, "date_format(date_add(DATE '2024-01-01', CAST(doc_id % 365 AS INT)), 'yyyy-MM-dd') AS doc_date")
    return d.join(blocked, "doc_id", "left").withColumn("no_llm", F.coalesce("no_llm", F.lit(False)))


def plain_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """docs() without the labels join."""
    return table(spark, sf_dir, "documents").selectExpr(*_DOC, "date_format(date_add(DATE '2024-01-01', CAST(doc_id % 365 AS INT)), 'yyyy-MM-dd') AS doc_date")


def search_index(spark: SparkSession, sf_dir: str) -> published.Index:
    """The published index of the documents, made on first use and again when their files change."""
    root = f"{shared_dir(spark).rstrip('/')}/index-{zlib.crc32(sf_dir.encode()):08x}"
    return published.current(spark, f"{sf_dir}/documents.parquet", plain_docs(spark, sf_dir), root)


def indexed_docs(spark: SparkSession, sf_dir: str, held: published.Index) -> DataFrame:
    """docs() from the index: no text is read."""
    blocked = toxic(spark, sf_dir).withColumn("no_llm", F.lit(True))
    return held.table("documents").join(blocked, "doc_id", "left").withColumn("no_llm", F.coalesce("no_llm", F.lit(False)))


TOXIC = "blocked AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1)"


def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()


# entities and a tree of relations over the embeddings
_KINDS = ["tool", "method", "bug", "person", "goal", "widget"]
_TYPE = "CASE label % 6 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS)) + " END"
_CANON = {"tool": "tool", "method": "method", "bug": "failure", "person": "actor", "goal": "concept", "widget": "other"}
_CTYPE = "CASE label % 6 " + " ".join(f"WHEN {i} THEN '{_CANON[k]}'" for i, k in enumerate(_KINDS)) + " END"
ENTITIES = f"""rel AS (SELECT vec_id AS rel_id, vec_id AS src_id, CAST(floor(vec_id / 2.0) AS BIGINT) AS tgt_id, embedding AS vector, [vec_id, vec_id + 1] AS doc_ids FROM embeddings WHERE vec_id > 0),
deg AS (SELECT id AS entity_id, count(*) AS degree FROM (SELECT src_id AS id FROM rel UNION ALL SELECT tgt_id FROM rel) GROUP BY 1),
ent AS (SELECT vec_id AS entity_id, concat('Entity ', vec_id) AS name, {_CTYPE} AS type, embedding AS vector, [vec_id, vec_id + 100, vec_id * 2 + 1] AS doc_ids, coalesce(degree, 0) AS degree
    FROM embeddings LEFT JOIN deg ON entity_id = vec_id)"""


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id > 0").selectExpr("vec_id AS rel_id", "vec_id AS src_id", "CAST(floor(vec_id / 2.0) AS BIGINT) AS tgt_id", "embedding AS vector", "array(vec_id, vec_id + 1) AS doc_ids")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamdex.functions.text import norm_type
    from loamdex.operators.resolve import degree

    e = table(spark, sf_dir, "embeddings").selectExpr("vec_id AS entity_id", "concat('Entity ', vec_id) AS name", f"{_TYPE} AS type_raw", "embedding AS vector", "array(vec_id, vec_id + 100, vec_id * 2 + 1) AS doc_ids")
    return e.join(degree(relations(spark, sf_dir)), "entity_id", "left").withColumns({"degree": F.coalesce("degree", F.lit(0)), "type": norm_type("type_raw")})


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector of vec_id 0: one row of the index table stands for an encoded query."""
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]


QUERY_VECTOR = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
SQUARED = f"power(list_distance(vector::DOUBLE[], {QUERY_VECTOR}), 2)"

# component scores of all documents
SCORES = """scores AS (SELECT c.comp, doc_id, ((doc_id * 37 + c.k * 101) % 997) / 10.0 AS score FROM documents, (VALUES ('bm25', 0), ('chunk', 1), ('entity', 2), ('relation', 3)) c(comp, k) WHERE (doc_id + c.k) % 3 <> 0)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    comps = F.array(*[F.struct(F.lit(c).alias("comp"), F.lit(k).alias("k")) for k, c in enumerate(S.COMPONENTS)])
    d = table(spark, sf_dir, "documents").select("doc_id", F.inline(comps))
    return d.where("(doc_id + k) % 3 <> 0").selectExpr("comp", "doc_id", "((doc_id * 37 + k * 101) % 997) / 10.0D AS score")


# a graph of customers, suppliers, nations and regions
GRAPH = """edges AS (SELECT concat('c', c_custkey) AS src, concat('n', c_nationkey) AS dst FROM customer UNION ALL SELECT concat('s', s_suppkey), concat('n', s_nationkey) FROM supplier UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey) FROM nation),
both_ways AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges),
gdeg AS (SELECT src AS id, count(*) AS degree FROM both_ways GROUP BY 1)"""


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").selectExpr("concat('c', c_custkey) AS src", "concat('n', c_nationkey) AS dst")
    s = table(spark, sf_dir, "supplier").selectExpr("concat('s', s_suppkey) AS src", "concat('n', s_nationkey) AS dst")
    n = table(spark, sf_dir, "nation").selectExpr("concat('n', n_nationkey) AS src", "concat('r', n_regionkey) AS dst")
    return c.unionByName(s).unionByName(n)


# document versions for sync: hashes change for every 11th document, some leave, some come, some move
OLD_NEW = """old_v AS (SELECT concat(source, '/', doc_id, '.md') AS path, substr(sha256(text), 1, 16) AS content_hash, doc_id FROM documents WHERE doc_id % 10 <> 0),
new_v AS (SELECT CASE WHEN doc_id % 13 = 0 THEN concat('moved/', doc_id, '.md') ELSE concat(source, '/', doc_id, '.md') END AS path,
    CASE WHEN doc_id % 11 = 0 THEN substr(sha256(concat(text, '!')), 1, 16) ELSE substr(sha256(text), 1, 16) END AS content_hash, doc_id FROM documents WHERE doc_id % 7 <> 0)"""


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents")
    old = d.where("doc_id % 10 <> 0").selectExpr("concat(source, '/', doc_id, '.md') AS path", "substr(sha2(text, 256), 1, 16) AS content_hash", "doc_id")
    new = d.where("doc_id % 7 <> 0").selectExpr("CASE WHEN doc_id % 13 = 0 THEN concat('moved/', doc_id, '.md') ELSE concat(source, '/', doc_id, '.md') END AS path", "CASE WHEN doc_id % 11 = 0 THEN substr(sha2(concat(text, '!'), 256), 1, 16) ELSE substr(sha2(text, 256), 1, 16) END AS content_hash", "doc_id")
    return old, new


# notes with tags and wiki links, from documents
NOTES = """notes AS (SELECT concat(source, '/n', doc_id, '.md') AS path, CAST(n_chars AS BIGINT) AS size, [concat('t', doc_id % 5), concat('t', doc_id % 7), lang] AS tags, concat('see [[n', doc_id + 1, ']] and [[n', doc_id * 2, '|later]] [[N', doc_id + 3, ']]') AS text, doc_id FROM documents)"""


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("concat(source, '/n', doc_id, '.md') AS path", "CAST(n_chars AS BIGINT) AS size", "array(concat('t', doc_id % 5), concat('t', doc_id % 7), lang) AS tags", "concat('see [[n', doc_id + 1, ']] and [[n', doc_id * 2, '|later]] [[N', doc_id + 3, ']]') AS text", "doc_id")
