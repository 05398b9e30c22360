"""Hybrid ranking: BM25, vectors, entity and relation components, fusion and its rivals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from loamdex import schema as S
from loamdex.functions import text as X


# --- BM25 ----------------------------------------------------------------------------------------
def bm25(chunks: DataFrame, query: str, k1: float = S.K1, b: float = S.B, binary: bool = False) -> DataFrame:
    """doc_id, chunk_id, score of the chunks that have any term of the query.

    Only the query's terms are looked at, so no posting is shuffled: one pass tells which chunks have which term
    and sums that to a single row, a second counts and scores the terms of the chunks that have any.
    """
    found = X.query_terms(query)
    if not found:
        return chunks.select("doc_id", "chunk_id", F.lit(0.0).alias("score")).limit(0)
    # made by a generator, so that no rule of the optimizer folds the text once more for each term
    low = chunks.select("doc_id", "chunk_id", F.inline(F.array(F.struct(X.ngram_count("text").alias("n"), F.lower("text").alias("_low")))))
    has = [F.contains("_low", F.lit(t)) for t in found]
    seen = low.agg(F.count("*").alias("chunks"), F.sum("n").alias("tokens"), F.array(*[F.sum(h.cast("long")) for h in has]).alias("df"))
    idf = F.transform("df", lambda d: F.log((F.col("chunks") - d + 0.5) / (d + 0.5) + 1))
    totals = seen.select((F.col("tokens") / F.col("chunks")).alias("mean"), idf.alias("idf"))
    counts = [F.when(h, X.occurrences("_low", t, folded=True)).otherwise(0) for h, t in zip(has, found, strict=True)]
    counted = low.select("doc_id", "chunk_id", "n", F.explode(F.array(F.array(*counts))).alias("tf"))
    hits = counted.where(F.exists("tf", lambda t: t > 0)).crossJoin(F.broadcast(totals))  # totals is one row
    norm = k1 * (1 - b + b * F.col("n") / F.col("mean"))
    tf = (lambda t: F.lit(1.0)) if binary else (lambda t: t.cast("double"))
    parts = F.zip_with("tf", "idf", lambda t, w: F.when(t > 0, w * tf(t) * (k1 + 1) / (tf(t) + norm)).otherwise(0.0))
    return hits.select("doc_id", "chunk_id", F.aggregate(parts, F.lit(0.0), lambda s, x: s + x).alias("score"))


def best_per_doc(hits: DataFrame) -> DataFrame:
    return hits.groupBy("doc_id").agg(F.max("score").alias("score"))


def top(df: DataFrame, n: int, by: str = "score", tie: str = "doc_id") -> DataFrame:
    """The n highest rows; scores that differ by rounding alone are ties, which go to the smaller ``tie``."""
    return df.orderBy(F.desc(F.round(by, 9)), tie).limit(n)


# --- vectors -------------------------------------------------------------------------------------
def dot(a: str | Column, b: str | Column) -> Column:
    """Dot product in double precision."""
    return F.aggregate(F.zip_with(X.col(a), X.col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def vector_top(table: DataFrame, query: list[float], k: int, key: str, vector: str = "vector") -> DataFrame:
    """key, dist (squared Euclidean) of the k nearest rows, ties to the smaller key."""
    q = F.array(*[F.lit(float(v)) for v in query])
    dist = F.aggregate(F.zip_with(vector, q, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, v: s + v)
    return table.withColumn("dist", dist).orderBy("dist", key).limit(k)


def ranked(df: DataFrame, *order: str) -> DataFrame:
    """rank from 0 of a bounded top-k frame."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)


def rrf_weight(rank: str | Column = "rank", k: int = S.RRF) -> Column:
    return 1.0 / (F.lit(float(k)) + X.col(rank))


def entity_component(hits: DataFrame) -> DataFrame:
    """doc_id, score from ranked entity rows (rank, doc_ids)."""
    return hits.select(F.explode("doc_ids").alias("doc_id"), rrf_weight().alias("w")).groupBy("doc_id").agg(F.sum("w").alias("score"))


def relation_component(hits: DataFrame, entities: DataFrame, hop: float = S.HOP) -> DataFrame:
    """doc_id, score: a relation's own documents, and at ``hop`` those of both its ends, repeats counted."""
    own = hits.select(F.explode("doc_ids").alias("doc_id"), rrf_weight().alias("w"))
    ends = hits.select(F.explode(F.array("src_id", "tgt_id")).alias("entity_id"), (rrf_weight() * hop).alias("w"))
    far = ends.join(entities.select("entity_id", "doc_ids"), "entity_id").select(F.explode("doc_ids").alias("doc_id"), "w")
    return own.unionByName(far).groupBy("doc_id").agg(F.sum("w").alias("score"))


def relations_by_degree(hits: DataFrame, entities: DataFrame, least: int, k: int) -> DataFrame:
    """Of candidates (k times 4, by rank) those with an end of ``least`` degree, cut to k."""
    degree = entities.select("entity_id", "degree")
    src = degree.select(F.col("entity_id").alias("src_id"), F.col("degree").alias("_s"))
    tgt = degree.select(F.col("entity_id").alias("tgt_id"), F.col("degree").alias("_t"))
    return hits.join(src, "src_id", "left").join(tgt, "tgt_id", "left").where(F.greatest(F.coalesce("_s", F.lit(0)), F.coalesce("_t", F.lit(0))) >= least).drop("_s", "_t").orderBy("rank").limit(k)


# --- fusion --------------------------------------------------------------------------------------
def union_components(parts: dict[str, DataFrame]) -> DataFrame:
    """comp, doc_id, score."""
    frames = [df.select(F.lit(name).alias("comp"), "doc_id", "score") for name, df in parts.items()]
    return reduce(DataFrame.unionByName, frames)


def of_groups(scores: DataFrame, by: str, **figures: Column) -> DataFrame:
    """scores with figures of each group: partial aggregates and a join with a row a group, so that no task holds a whole component."""
    return scores.join(F.broadcast(scores.groupBy(F.col(by).alias("_by")).agg(*[f.alias(n) for n, f in figures.items()])), F.col(by).eqNullSafe(F.col("_by"))).drop("_by")


def minmax(scores: DataFrame, by: str = "comp") -> DataFrame:
    """Adds norm: scores scaled to 0..1 within a component (components are few); a component without a range is all ones."""
    low, high = F.col("_low"), F.col("_high")
    rows = of_groups(scores, by, _low=F.min("score"), _high=F.max("score"))
    return rows.withColumn("norm", F.when(high - low < 1e-12, F.lit(1.0)).otherwise((F.col("score") - low) / (high - low))).drop("_low", "_high")


def small_components_out(scores: DataFrame, least: int = S.MIN_POPULATION, only: tuple[str, ...] = ("entity", "relation")) -> DataFrame:
    """Drop graph components that fewer than ``least`` documents are left in."""
    return of_groups(scores, "comp", _n=F.count("*")).where(~F.col("comp").isin(*only) | (F.col("_n") >= least)).drop("_n")


def fuse(normed: DataFrame, weights: tuple[float, ...] = S.PRESETS["default"], names: tuple[str, ...] = S.COMPONENTS) -> DataFrame:
    """doc_id, score: weighted sum of norms, a missing component counts 0."""
    if len(weights) != len(names):
        raise ValueError("a weight for each component")
    w = F.create_map(*[F.lit(x) for pair in zip(names, map(float, weights), strict=True) for x in pair])
    return normed.groupBy("doc_id").agg(F.sum(F.col("norm") * F.coalesce(F.try_element_at(w, F.col("comp")), F.lit(0.0))).alias("score"))


def rrf(scores: DataFrame, k: int = S.RRF) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("comp").orderBy(F.desc("score"), "doc_id"))
    return scores.withColumn("_r", rank).groupBy("doc_id").agg(F.sum(1.0 / (k + F.col("_r"))).alias("score"))


def zscore(scores: DataFrame) -> DataFrame:
    sd = F.col("_sd")
    rows = of_groups(scores, "comp", _sd=F.stddev_pop("score"), _mean=F.avg("score"))
    return rows.withColumn("norm", F.when(sd > 1e-12, (F.col("score") - F.col("_mean")) / sd).otherwise(F.lit(0.0))).drop("_sd", "_mean")


def theoretical_minmax(scores: DataFrame, low: dict[str, float]) -> DataFrame:
    """Scaling from a component's least possible score to the largest found."""
    floor = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in low.items() for x in pair]), F.col("comp")), F.lit(0.0))
    high = F.col("_high")
    return of_groups(scores, "comp", _high=F.max("score")).withColumn("norm", F.when(high - floor < 1e-12, F.lit(1.0)).otherwise((F.col("score") - floor) / (high - floor))).drop("_high")


def snippets(chunks: DataFrame, docs: DataFrame, query: list[float], n: int = 2, width: int = 340) -> DataFrame:
    """doc_id, place, chunk_id, snippet: the n chunks nearest the query of each listed document."""
    q = F.array(*[F.lit(float(v)) for v in query])
    near = chunks.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("_dot", dot("vector", q))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("_dot"), "chunk_id"))
    return near.withColumn("place", place).where(F.col("place") <= n).select("doc_id", "place", "chunk_id", F.substring("text", 1, width).alias("snippet"))


def with_metadata(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Hits with title and path; documents that are gone show "?"."""
    return hits.join(docs.select("doc_id", "title", "path"), "doc_id", "left").withColumns({c: F.coalesce(c, F.lit("?")) for c in ("title", "path")})


def search(parts: dict[str, DataFrame], docs: DataFrame, mode: str = "default", top_n: int = S.ANSWERS, origin: str | None = None) -> DataFrame:
    """The whole ranking: origin filter before scaling, fusion, cut, then documents that must not be shown go."""
    if mode not in S.PRESETS:
        raise ValueError(f"mode is one of {', '.join(S.PRESETS)}")
    if origin is not None and origin not in S.ORIGINS:
        raise ValueError(f"origin is one of {', '.join(S.ORIGINS)}")
    scores = union_components(parts)
    if origin:
        scores = small_components_out(scores.join(docs.where(F.col("origin") == origin).select("doc_id"), "doc_id", "left_semi"))
    cut = top(fuse(minmax(scores), S.PRESETS[mode]), top_n)
    return cut.join(docs.where(~F.col("no_llm")).select("doc_id", "title", "path"), "doc_id")
