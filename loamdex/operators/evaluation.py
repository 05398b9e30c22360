"""Retrieval evaluation and set comparison."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from loamdex.session import stored


def placed(run: DataFrame) -> DataFrame:
    """Adds place (from 1) by score within a query, ties to the smaller document."""
    return run.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")))


def metrics(run: DataFrame, qrels: DataFrame, k: int = 10, recall_at: int = 20) -> DataFrame:
    """qid, ndcg, recall, mrr, unjudged (share of the first k) of a run (qid, doc_id, score) by graded qrels (qid, doc_id, rel)."""
    hits = placed(run).where(F.col("place") <= max(k, recall_at)).join(qrels, ["qid", "doc_id"], "left")
    gain = lambda rel, place: (F.pow(F.lit(2.0), rel) - 1) / F.log2(place + 1.0)
    rel = F.coalesce("rel", F.lit(0))
    got = hits.groupBy("qid").agg(
        F.sum(F.when(F.col("place") <= k, gain(rel, F.col("place"))).otherwise(0.0)).alias("dcg"),
        F.count_if((F.col("place") <= recall_at) & (rel > 0)).alias("found"), F.min(F.when(rel > 0, F.col("place"))).alias("first"),
        F.count_if((F.col("place") <= k) & F.col("rel").isNull()).alias("unjudged"), F.count_if(F.col("place") <= k).alias("shown"),
    )
    best = qrels.where("rel > 0").withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rel"), "doc_id")))
    ideal = best.groupBy("qid").agg(F.sum(F.when(F.col("place") <= k, gain(F.col("rel"), F.col("place"))).otherwise(0.0)).alias("idcg"), F.count("*").alias("relevant"))
    j = ideal.join(got, "qid", "left")
    zero = F.lit(0.0)
    return j.select("qid", F.coalesce(F.col("dcg") / F.col("idcg"), zero).alias("ndcg"), F.coalesce(F.col("found") / F.col("relevant"), zero).alias("recall"), F.coalesce(1.0 / F.col("first"), zero).alias("mrr"), F.coalesce(F.col("unjudged") / F.col("shown"), zero).alias("unjudged"))


def grid(step: float = 0.1, parts: int = 4) -> list[tuple[float, ...]]:
    """All weights in steps that sum to one."""
    n = round(1 / step)

    def build(left: int, k: int):
        if k == 1:
            yield (left,)
            return
        for i in range(left + 1):
            for rest in build(left - i, k - 1):
                yield (i, *rest)

    return [tuple(round(i * step, 6) for i in w) for w in build(n, parts)]


def sweep(normed: DataFrame, weights: DataFrame) -> DataFrame:
    """gid, qid, doc_id, score for each row of a bounded weight grid (gid, comp, w): scores are computed once, weighed many times.

    A document's components meet once, whatever the grid, and are weighed where they lie.
    """
    once = weights.groupBy("gid", "comp").agg(F.sum("w").alias("w")).groupBy("gid").agg(F.map_from_entries(F.collect_list(F.struct("comp", "w"))).alias("_w"))
    each = normed.groupBy("qid", "doc_id").agg(F.collect_list(F.struct("comp", "norm")).alias("_c"))
    rows = each.crossJoin(F.broadcast(once)).withColumn("_c", F.filter("_c", lambda c: F.map_contains_key("_w", c["comp"]))).where(F.size("_c") > 0)

    def add(s: Column, c: Column) -> Column:
        x = c["norm"] * F.try_element_at(F.col("_w"), c["comp"])
        return F.coalesce(s + x, s, x)

    return rows.select("gid", "qid", "doc_id", F.aggregate("_c", F.lit(None).cast("double"), add).alias("score"))


def overlap(members: DataFrame, label: str = "label", item: str = "item") -> DataFrame:
    """a, b, both, jaccard of all pairs of labels (a < b) that share an item or not: counts by one self-join on items."""
    m = members.select(label, item).distinct()
    size = m.groupBy(label).agg(F.count("*").alias("n"))
    pairs = m.select(F.col(label).alias("a"), item).join(m.select(F.col(label).alias("b"), item), item).where("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    every = size.select(F.col(label).alias("a"), F.col("n").alias("na")).join(size.select(F.col(label).alias("b"), F.col("n").alias("nb")), F.col("a") < F.col("b"))
    j = every.join(pairs, ["a", "b"], "left").withColumn("both", F.coalesce("both", F.lit(0)))
    return j.select("a", "b", "both", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("jaccard"))


def partial_correlation(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """One row: r_xy, r_xz, r_yz and the correlation of x and y with z held."""
    r = df.agg(F.corr(x, y).alias("r_xy"), F.corr(x, z).alias("r_xz"), F.corr(y, z).alias("r_yz"))
    return r.withColumn("partial", (F.col("r_xy") - F.col("r_xz") * F.col("r_yz")) / F.sqrt((1 - F.col("r_xz") ** 2) * (1 - F.col("r_yz") ** 2)))


def signed_rank(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Wilcoxon's statistic and its two-sided p by the normal curve with ties corrected; (0, 1) without differences."""
    from math import erfc, sqrt

    d = np.asarray(a, float) - np.asarray(b, float)
    d = d[d != 0]
    n = len(d)
    if not n:
        return 0.0, 1.0
    size = np.abs(d)
    values, inverse, counts = np.unique(size, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    w = min(ranks[d > 0].sum(), ranks[d < 0].sum())
    var = n * (n + 1) * (2 * n + 1) / 24 - (counts**3 - counts).sum() / 48
    return float(w), float(erfc(abs(w - n * (n + 1) / 4) / sqrt(var) / sqrt(2))) if var > 0 else 1.0


#: Distinct differences of a comparison that are drawn from together.
DRAWN_TOGETHER = 1 << 16


def rank_sums(tally: DataFrame) -> DataFrame:
    """comparison, wp, wm (rank sums of positive and negative differences), m (their number), ties of (comparison, d, n).

    Sizes of differences are dealt by ranges; a size's rank is its place in its range after the ranges before.
    """
    sizes = tally.where("d <> 0").groupBy("comparison", F.abs("d").alias("size")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("d") > 0, F.col("n")).otherwise(0)).alias("plus"))
    parts = int(tally.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(sizes.repartitionByRange(parts, "comparison", "size").withColumn("piece", F.spark_partition_id()), "rank-sizes")
    pieces = dealt.groupBy("comparison", "piece").agg(F.sum("n").alias("_n"))  # a row a partition and comparison
    before = pieces.select("comparison", "piece", (F.sum("_n").over(Window.partitionBy("comparison").orderBy("piece")) - F.col("_n")).alias("before"))
    upto = F.sum("n").over(Window.partitionBy("comparison", "piece").orderBy("size").rowsBetween(Window.unboundedPreceding, 0))
    rank = F.col("before") + F.col("upto") - (F.col("n") - 1) / 2
    each = dealt.withColumn("upto", upto).join(F.broadcast(before), ["comparison", "piece"]).withColumn("rank", rank)
    cubes = F.col("n").cast("double") * F.col("n") * F.col("n") - F.col("n")
    return each.groupBy("comparison").agg(F.sum(F.col("rank") * F.col("plus")).alias("wp"), F.sum(F.col("rank") * (F.col("n") - F.col("plus"))).alias("wm"), F.sum("n").alias("m"), F.sum(cubes).alias("ties"))


def resampled(tally: DataFrame, seed: int, resamples: int) -> DataFrame:
    """comparison, r, mean: bootstrap means of the differences (comparison, d, n).

    A draw of all differences is a draw of how many fall into each block, and then of those within it: counts of blocks come
    from one generator, known to all tasks, and each block draws on its own. Equal differences are drawn together.
    """
    sized = tally.groupBy("comparison").agg(F.count("*").alias("_k"))
    block = F.pmod(F.xxhash64("d"), F.ceil(F.col("_k") / DRAWN_TOGETHER)).cast("int")
    dealt = stored(tally.join(F.broadcast(sized), "comparison").select("comparison", block.alias("block"), "d", "n"), "bootstrap-blocks")
    shares = dealt.groupBy("comparison", "block").agg(F.sum("n").alias("n")).groupBy("comparison").agg(F.array_sort(F.collect_list(F.struct("block", "n"))).alias("shares"))  # a row a block

    def draw(key, pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values("d")
        d, n = own["d"].to_numpy(float), own["n"].to_numpy(np.int64)
        blocks = [(s["block"], s["n"]) for s in pdf["shares"].iloc[0]]
        sizes = np.array([x for _, x in blocks], np.int64)
        at = [b for b, _ in blocks].index(key[1])
        name = zlib.crc32(str(key[0]).encode())
        common, mine = np.random.default_rng([seed, name]), np.random.default_rng([seed, name, key[1] + 1])
        whole, sums = sizes.sum(), np.empty(resamples)
        for r in range(resamples):
            sums[r] = mine.multinomial(common.multinomial(whole, sizes / whole)[at], n / n.sum()) @ d
        return pd.DataFrame({"comparison": key[0], "r": np.arange(resamples), "sum": sums, "whole": whole})

    held = dealt.join(F.broadcast(shares), "comparison")
    sums = held.groupBy("comparison", "block").applyInPandas(draw, "comparison string, r int, sum double, whole long")
    return sums.groupBy("comparison", "r").agg((F.sum("sum") / F.first("whole")).alias("mean"))


def _two_sided(w: float, m: int, ties: float) -> float:
    var = m * (m + 1) * (2 * m + 1) / 24 - ties / 48
    return math.erfc(abs(w - m * (m + 1) / 4) / math.sqrt(var) / math.sqrt(2)) if var > 0 else 1.0


def compare(scores: DataFrame, seed: int = 7, resamples: int = 1000) -> DataFrame:
    """comparison, n, delta, low, high (bootstrap 95 %), dz, w, p, p_bh for rows (comparison, a, b) of paired scores.

    Comparisons are few; the pairs of one are folded into a tally of equal differences and never meet in one task.
    """
    difference = (F.coalesce(F.col("a").cast("double"), F.lit(float("nan"))) - F.coalesce(F.col("b").cast("double"), F.lit(float("nan")))).alias("d")
    tally = stored(scores.select("comparison", difference).groupBy("comparison", "d").agg(F.count("*").alias("n")), "differences")
    total = F.sum("n")
    heads = tally.groupBy("comparison").agg(total.alias("n"), (F.sum(F.col("d") * F.col("n")) / total).alias("delta"))
    off = tally.join(F.broadcast(heads.select("comparison", "delta")), "comparison").groupBy("comparison").agg(F.sum(F.pow(F.col("d") - F.col("delta"), 2) * F.col("n")).alias("_ss"))
    ends = resampled(tally, seed, resamples).groupBy("comparison").agg(F.expr("percentile(mean, array(0.025, 0.975))").alias("e"))
    sd = F.when(F.col("n") > 1, F.sqrt(F.col("_ss") / (F.col("n") - 1))).otherwise(0.0)
    w = F.coalesce(F.least("wp", "wm"), F.lit(0.0))
    out = heads.join(off, "comparison").join(ends, "comparison").join(rank_sums(tally), "comparison", "left").select(
        "comparison", "n", "delta", F.get("e", F.lit(0)).alias("low"), F.get("e", F.lit(1)).alias("high"), F.when(sd != 0, F.col("delta") / sd).otherwise(0.0).alias("dz"),
        w.alias("w"), F.coalesce(F.udf(_two_sided, "double")(w, F.coalesce("m", F.lit(0)), F.coalesce("ties", F.lit(0.0))), F.lit(1.0)).alias("p"),
    )
    return benjamini_hochberg(out)


def benjamini_hochberg(tests: DataFrame, p: str = "p") -> DataFrame:
    """Adds p_bh; tests are few, a row for each comparison."""
    every = Window.partitionBy(F.lit(1))
    rank = F.row_number().over(every.orderBy(p, *[c for c in tests.columns if c != p][:1]))
    m = F.count("*").over(every)
    raw = tests.withColumn("_raw", F.col(p) * m / rank).withColumn("_rank", rank)
    return raw.withColumn("p_bh", F.least(F.lit(1.0), F.min("_raw").over(every.orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)))).drop("_raw", "_rank")


# --- selection and test sets -----------------------------------------------------------------------
def drawn(*counter: Column) -> Column:
    """A whole number below 2^32 drawn for a counter: the first half of 64 bits of its md5, the same wherever it is worked out."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *counter)), 1, 8), 16, 10).cast("long")


def splits(queries: DataFrame, seeds: int = 20) -> DataFrame:
    """seed, qid, in_a: each seed's own order of the queries, every other one for selection, the rest for the test."""
    each = queries.select("qid").distinct().select("qid", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("seed"))
    order = Window.partitionBy("seed").orderBy(drawn(F.col("seed"), F.col("qid")), "qid")
    return each.select("seed", "qid", (F.row_number().over(order) % 2 == 1).alias("in_a"))


def protocol(per_query: DataFrame, baseline: int, seeds: int = 20) -> DataFrame:
    """seed, best, n, delta, p of scores per query (gid, qid, value): weights are picked on the selection set alone and tested once.

    Of equal weights the smaller gid is picked. ``delta`` is the test set's mean gain over the baseline, ``p`` of Wilcoxon's test.
    """
    set_of = splits(per_query, seeds)
    judged = per_query.join(set_of, "qid")
    means = judged.where("in_a").groupBy("seed", "gid").agg(F.round(F.avg("value"), 9).alias("mean"))
    best = means.groupBy("seed").agg(F.max_by("gid", F.struct("mean", -F.col("gid"))).alias("best"))
    test = judged.where("not in_a").join(best, "seed")
    pairs = test.where((F.col("gid") == F.col("best")) | (F.col("gid") == baseline)).groupBy("seed", "best", "qid").agg(
        F.max(F.when(F.col("gid") == F.col("best"), F.col("value"))).alias("a"), F.max(F.when(F.col("gid") == baseline, F.col("value"))).alias("b"),
    )

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf["a"].to_numpy(float), pdf["b"].to_numpy(float)
        return pd.DataFrame([(*key, len(a), float((a - b).mean()), signed_rank(a, b)[1])], columns="seed best n delta p".split())

    return pairs.groupBy("seed", "best").applyInPandas(one, f"seed int, best {per_query.schema['gid'].dataType.simpleString()}, n long, delta double, p double")


def verdict(tests: DataFrame, level: float = 0.05) -> DataFrame:
    """One row on protocol(): seeds, median, low, high of the gains, how many seeds gain, and gain significantly."""
    gain = F.col("delta") > 0
    return tests.agg(
        F.count("*").alias("seeds"), F.expr("percentile(delta, 0.5)").alias("median"), F.min("delta").alias("low"), F.max("delta").alias("high"), F.count_if(gain).alias("gains"), F.count_if(gain & (F.col("p") < level)).alias("significant"),
    )


def bootstrap(differences: DataFrame, resamples: int = 1000) -> DataFrame:
    """comparison, n, delta, low, high: 95 % interval of the mean of paired differences (comparison, qid, d).

    Every draw is a row, and its number comes from (comparison, resample, place): draws are dealt over all tasks, and a
    task that is run again draws the same.
    """
    place = F.row_number().over(Window.partitionBy("comparison").orderBy("qid")) - 1
    items = differences.select("comparison", place.alias("place"), "d")
    sizes = items.groupBy("comparison").agg(F.count("*").alias("n"), F.avg("d").alias("delta"))
    draws = items.select("comparison", F.col("place").alias("j")).join(sizes, "comparison").select("comparison", "n", "j", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("r"))
    picked = draws.select("comparison", "r", (drawn(F.col("comparison"), F.col("r"), F.col("j")) % F.col("n")).alias("place"))
    means = picked.join(items, ["comparison", "place"]).groupBy("comparison", "r").agg(F.avg("d").alias("mean"))
    ends = means.groupBy("comparison").agg(F.expr("percentile(mean, array(0.025, 0.975))").alias("e"))
    return sizes.join(ends, "comparison").select("comparison", "n", "delta", F.get("e", F.lit(0)).alias("low"), F.get("e", F.lit(1)).alias("high"))


def ceiling(per_query: DataFrame, picked: DataFrame) -> DataFrame:
    """strategy, n, mean: each mode always, the mode that a rule picks (qid, mode), and the best mode of every query, which no rule can beat."""
    fixed = per_query.groupBy(F.concat(F.lit("always "), "mode").alias("strategy")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    auto = per_query.join(picked, ["qid", "mode"]).agg(F.lit("auto").alias("strategy"), F.count("*").alias("n"), F.avg("value").alias("mean"))
    best = per_query.groupBy("qid").agg(F.max("value").alias("value")).agg(F.lit("ceiling").alias("strategy"), F.count("*").alias("n"), F.avg("value").alias("mean"))
    return fixed.unionByName(auto).unionByName(best)


# --- two builds of a graph -------------------------------------------------------------------------
def frequency_floors(docs_of: DataFrame, quantiles: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 0.9)) -> list[int]:
    """Distinct least document counts of the strata at quantiles of the items' counts (item, doc)."""
    n = docs_of.distinct().groupBy("item").agg(F.count("*").alias("n"))
    at = n.agg(F.expr(f"percentile(n, array({', '.join(map(str, quantiles))}))").alias("q")).first()["q"]
    return sorted({int(np.ceil(x)) for x in at}) if at else []


def frequency_strata(a: DataFrame, b: DataFrame, floors: tuple[int, ...] | list[int] = (1, 2, 3, 5)) -> DataFrame:
    """floor, n_a, n_b, both, jaccard of the items that at least ``floor`` documents name, in two builds (item, doc)."""
    n = lambda df, c: df.distinct().groupBy("item").agg(F.count("*").alias(c))
    each = n(a, "a").join(n(b, "b"), "item", "full").fillna(0).select("a", "b", F.explode(F.array(*[F.lit(f) for f in floors])).alias("floor"))
    in_a, in_b = F.col("a") >= F.col("floor"), F.col("b") >= F.col("floor")
    counts = each.groupBy("floor").agg(F.count_if(in_a).alias("n_a"), F.count_if(in_b).alias("n_b"), F.count_if(in_a & in_b).alias("both"), F.count_if(in_a | in_b).alias("_any"))
    return counts.select("floor", "n_a", "n_b", "both", F.try_divide(F.col("both"), F.col("_any")).alias("jaccard"))


def edge_loss(a: DataFrame, b: DataFrame, items_a: DataFrame, items_b: DataFrame, floors: tuple[int, ...] | list[int] = (1, 2, 3, 5)) -> DataFrame:
    """floor, edges, lost, alive, lost_alive: edges (src, dst, either way) of a that b lacks, and of those whose ends both builds have.

    An edge stands in every stratum up to the lower document count of its ends in a.
    """
    way = lambda df: df.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src is not null and dst is not null").distinct()
    n = items_a.distinct().groupBy("item").agg(F.count("*").alias("n")).join(items_b.select("item", F.lit(1).alias("there")).distinct(), "item", "left")
    end = lambda c: n.select(F.col("item").alias(c), F.col("n").alias(f"n_{c}"), F.col("there").alias(f"there_{c}"))
    edges = way(a).join(way(b).withColumn("kept", F.lit(1)), ["src", "dst"], "left").join(end("src"), "src", "left").join(end("dst"), "dst", "left")
    low = F.least(F.coalesce("n_src", F.lit(0)), F.coalesce("n_dst", F.lit(0)))
    each = edges.withColumns({"low": low, "floor": F.explode(F.array(*[F.lit(f) for f in floors]))}).where("low >= floor")
    lost, alive = F.col("kept").isNull(), F.col("there_src").isNotNull() & F.col("there_dst").isNotNull()
    return each.groupBy("floor").agg(F.count("*").alias("edges"), F.count_if(lost).alias("lost"), F.count_if(alive).alias("alive"), F.count_if(lost & alive).alias("lost_alive"))
