"""The registered queries of the training-data operators: thin functions of (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from loamdex.llm import hnsw, licenses, line_dedup, mixing, packing, quality, secret_scan, simhash, tiff, toxicity, trie, warc, whitening
from loamdex.llm.common import crc_mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", modulus=4, held_out=2)
    held_out, predicted = crc_mod("doc_id", 4) == 2, (F.col("score") >= 0.3).cast("int")
    return toxicity.score(docs, net).select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"), "language")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, most=3, seed=42)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["number"] < len(secret_scan.BASE))
    count = lambda i: F.size(F.filter("spans", lambda x: x["number"] == i)).cast("long")
    counts = {f"n_{r.kind}": count(i) for i, r in enumerate(secret_scan.BASE)}
    lists = {"base_sha256": F.sha2(secret_scan.listed(base), 256), "spans": secret_scan.listed("spans")}
    return found.select("doc_id", *[(counts | lists)[c].alias(c) for c in counts | lists])


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(table(spark, sf_dir, "pages"), least_bytes=0)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    field = quality.fit(docs, table(spark, sf_dir, "labels"), "quality", modulus=5, held_out=0)
    held_out, predicted = crc_mod("doc_id", 5) == 0, (F.col("score") >= 0.3).cast("int")
    return quality.score(docs, field).select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


def op6_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = tiff.to_media(table(spark, sf_dir, "documents")).withColumns({"media_bytes": F.length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    found = tiff.text_features(tiff.pages(media))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no paths: they stand in a tree by source and id, and every fourth is named LICENSE."""
    up = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    name = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("LICENSE."), "doc_id")).otherwise(F.concat(F.lit("page"), "doc_id", F.lit(".txt")))
    docs = table(spark, sf_dir, "documents").withColumn("path", F.concat_ws("/", "source", up(16384), up(1024), name))
    return licenses.inherit(licenses.scan(docs))


def op9_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return hnsw.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


#: Production targets: shares of all tokens by domain of the labels table.
MIX_TARGETS = {"clean": 0.96, "noisy": 0.02, "toxic": 0.02}


def op10_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = mixing.label_domains(table(spark, sf_dir, "labels"))
    mixed = mixing.mix(table(spark, sf_dir, "documents"), labelled, MIX_TARGETS)
    shares = [F.get("posteriors", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(MIX_TARGETS)]
    return mixed.select("doc_id", "tokens", *shares, "rate", *[F.get("residuals", F.lit(i)).alias(f"residual_{d}") for i, d in enumerate(MIX_TARGETS)])


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = line_dedup.dedup(table(spark, sf_dir, "documents"), least=10, least_points=1)
    return lines.select("row.doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(F.col("lines.kept").cast("binary"), 256).alias("kept_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(table(spark, sf_dir, "embeddings"), components=8)
    each = white.select("id", "n", F.col("deviation").try_cast("long").alias("deviation"), F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "at"), "identity_error")
    return each.select(F.col("id").alias("vec_id"), (F.col("place") + 1).cast("int").alias("component"), "n", "deviation", "at.whitened", "at.explained", "identity_error")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: Lines by list functions; keys by trim and translate of the same characters.
LINE_DEDUP_SQL = """
WITH split AS (SELECT doc_id, str_split(coalesce(text, ''), chr(10)) AS lines, row_number() OVER () AS doc FROM documents),
each AS (SELECT doc, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM split),
keyed AS (SELECT *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM each),
common AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc) >= 10),
marked AS (SELECT *, key IN (SELECT key FROM common) AS goes FROM keyed)
SELECT min(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (goes) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT goes), '')) AS kept_sha256
FROM marked GROUP BY doc"""

#: A node is the SHA-256 chain of its turns; crc32 is folded bit by bit: o >= 0 takes in a byte, o = -1 shifts.
PREFIX_TRIE_SQL = """
WITH own AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS place FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(
    list_concat([4294967295::BIGINT], flatten([[ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN str_split(conv_id::VARCHAR, '')])),
    lambda x, o: CASE WHEN o >= 0 THEN xor(x, o) ELSE xor(x >> 1, 3988292384::BIGINT * (x & 1)) END), 4294967295::BIGINT) % 6 AS h FROM (SELECT DISTINCT conv_id FROM own)),
turns AS (SELECT i.conv_id, 0 AS part, o.place, o.role, o.text FROM ids i JOIN own o ON o.conv_id = i.base AND o.place <= i.h
    UNION ALL SELECT i.conv_id, 1, o.place, o.role, o.text FROM ids i JOIN own o ON o.conv_id = i.conv_id AND o.place > i.h),
numbered AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth, length(text) AS points, sha256(concat(length(role), ':', role, text)) AS turn FROM turns),
prefixes AS (SELECT conv_id, depth, points, sha256(string_agg(turn, ',') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM numbered UNION ALL SELECT conv_id, 0, 0, 'root' FROM ids),
lens AS (SELECT conv_id, max(depth) AS len FROM prefixes GROUP BY 1),
named AS (SELECT p.*, min(conv_id) OVER (PARTITION BY depth, node) AS name, p.depth = l.len AS is_end FROM prefixes p JOIN lens l USING (conv_id)),
nodes AS (SELECT depth, node, any_value(name) AS conv_id, count(*) AS n_convs, max(points) AS points, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256 FROM named GROUP BY 1, 2),
tops AS (SELECT n.depth, n.node, p.name AS parent_conv_id FROM nodes n JOIN named p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
kids AS (SELECT n.depth, n.node, count(t.node) AS n_children FROM nodes n LEFT JOIN tops t ON t.depth = n.depth + 1 AND t.parent_conv_id = n.conv_id GROUP BY 1, 2),
sums AS (SELECT a.depth, a.name AS conv_id, sum((n.n_convs - 1) * n.points)::BIGINT AS saved_tokens, count(*) FILTER (k.n_children = 0) AS n_leaves
    FROM nodes n JOIN kids k USING (depth, node) JOIN named a ON a.conv_id = n.conv_id AND a.depth <= n.depth GROUP BY 1, 2)
SELECT n.conv_id, n.depth, t.parent_conv_id, n.n_convs, k.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM nodes n JOIN kids k USING (depth, node) JOIN sums s ON s.depth = n.depth AND s.conv_id = n.conv_id LEFT JOIN tops t ON t.depth = n.depth AND t.node = n.node"""


def oracle_sql() -> dict[str, str]:
    return {"op11_line_dedup": LINE_DEDUP_SQL, "op13_prefix_trie": PREFIX_TRIE_SQL}
