"""Ledgers, run logs and usage: latest rows, running revisions, rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def latest(rows: DataFrame, keys: list[str], rank: list[str]) -> DataFrame:
    """The highest row of each key by a tuple of columns: one aggregation, no sort."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*rank)).alias("_r")).select(*keys, "_r.*")


def numbered(rows: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """Adds a place from 0 in an order within a key."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)


def merged_revisions(rows: DataFrame, keys: list[str], order: str = "ord", rev: str = "rev") -> DataFrame:
    """Adds revision = max(rev, previous revision + 1) in order: the closed form of the fold, i + max(rev_j - j)."""
    w = Window.partitionBy(*keys).orderBy(order)
    i = F.row_number().over(w)
    lead = F.max(F.col("_gap")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_i", i).withColumn("_gap", F.col(rev) - F.col("_i")).withColumn("revision", F.greatest(F.col("_i"), F.col("_i") + lead)).drop("_i", "_gap")


def appended(old: DataFrame, new: DataFrame, device: str) -> DataFrame:
    """New ledger rows with seq continuing a device's own."""
    last = old.where(F.col("device") == device).agg(F.coalesce(F.max("seq"), F.lit(0)).alias("_last"))
    w = Window.partitionBy("device").orderBy("source_type", "source_id")
    return new.withColumn("device", F.lit(device)).crossJoin(F.broadcast(last)).withColumn("seq", F.col("_last") + F.row_number().over(w)).drop("_last")


def summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source_type").agg(F.count("*").alias("n"), F.max("source_updated_at").alias("last"))


def median_rate(runs: DataFrame, least: int = 3) -> DataFrame:
    """step, n, rate (median units a second), floor (shortest run): null rates for steps with too few good runs."""
    good = runs.where("status = 'ok' and seconds > 0").withColumn("_rate", F.col("units") / F.col("seconds"))
    out = good.groupBy("step").agg(F.count("*").alias("n"), F.median("_rate").alias("_m"), F.min("seconds").alias("floor"))
    return out.select("step", "n", F.when(F.col("n") >= least, F.col("_m")).alias("rate"), "floor")


def estimate(pending: DataFrame, rates: DataFrame) -> DataFrame:
    """step, seconds: pending units at the rate, the shortest run at least."""
    j = pending.join(rates, "step", "left")
    return j.select("step", F.when(F.col("rate") > 0, F.greatest(F.col("units") / F.col("rate"), F.col("floor"))).alias("seconds"))


def monthly(rows: DataFrame, at: str = "ts", amount: str = "chars") -> DataFrame:
    return rows.groupBy(F.date_format(at, "yyyy-MM").alias("month")).agg(F.sum(amount).alias("total"))


def failure_verdict(calls: DataFrame) -> DataFrame:
    """One row: calls, failed, rate, abort (a tenth failed, or half of at least 20 early ones)."""
    t = calls.agg(F.count("*").alias("calls"), F.count_if(F.col("status") != "ok").alias("failed"), F.count_if((F.col("ord") <= 20) & (F.col("status") != "ok")).alias("_early"))
    rate = F.col("failed") / F.greatest(F.col("calls"), F.lit(1))
    return t.select("calls", "failed", rate.alias("rate"), ((rate >= 0.10) | ((F.col("calls") >= 20) & (F.col("_early") >= 10))).alias("abort"))


def severity_first(rows: DataFrame) -> DataFrame:
    """step, action: the worst recommendation of each step, worst first."""
    order = F.create_map(*[F.lit(x) for p in (("error", 0), ("warn", 1), ("info", 2)) for x in p])
    return rows.withColumn("_s", F.coalesce(F.try_element_at(order, F.col("severity")), F.lit(9))).groupBy("step").agg(F.min_by(F.struct("severity", "action"), F.struct("_s", "action")).alias("r")).select("step", "r.*")
