"""Suggestions for a person to check: homonyms, cue words, weak aliases, and the fuzzy search box."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loamdex.functions import text as X


def words(text: str = "text") -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^0-9a-z가-힣]+"), lambda w: F.char_length(w) >= 2))


def homonym_signals(mentions: DataFrame, share: float = 0.40) -> DataFrame:
    """name, docs, apart: names of which ``share`` or more of the documents share no word with the first one.

    Input rows: name, doc_id, text. The first document is the one with the smallest id.
    """
    per_doc = mentions.groupBy("name", "doc_id").agg(F.array_distinct(F.flatten(F.collect_list(words()))).alias("w"))
    first = per_doc.groupBy("name").agg(F.min_by("w", "doc_id").alias("_f"))
    j = per_doc.join(first, "name")
    out = j.groupBy("name").agg(F.count("*").alias("docs"), F.count_if(~F.arrays_overlap("w", "_f")).alias("apart"))
    return out.where((F.col("docs") >= 2) & (F.col("apart") >= share * F.col("docs")))


def cue_words(mentions: DataFrame, top: int = 30, shown: int = 6) -> DataFrame:
    """name, cues: frequent words of a name's texts, in how many rows they stand; ties to the one seen first (ord)."""
    each = mentions.select("name", "ord", F.posexplode(words()).alias("pos", "w"))
    n = each.groupBy("name", "w").agg(F.count("*").alias("n"), F.min(F.struct("ord", "pos")).alias("at"))
    place = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("n"), "at"))
    kept = n.withColumn("p", place).where(F.col("p") <= min(top, shown))
    return kept.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "w"))), lambda x: x["w"]).alias("cues"))


def search_box(nodes: DataFrame, asked: str, cap: int = 50, hubs: int = 20) -> DataFrame:
    """Nodes (id, name, degree) for what was typed: hubs for nothing, else whole, leading, contained and near names."""
    q = asked.strip().lower()
    if not q:
        return nodes.orderBy(F.desc("degree"), "id").limit(hubs).withColumn("fit", F.lit(0))
    n, lit = F.lower("name"), F.lit(q)
    fit = F.when(n == lit, 4).when(n.startswith(q), 3).when(n.contains(q), 2).when(F.levenshtein(n, lit) <= 2, 1)
    return nodes.withColumn("fit", fit).where("fit is not null").orderBy(F.desc("fit"), F.desc("degree"), "id").limit(cap)


def suggestions(entities: DataFrame, canon: DataFrame) -> DataFrame:
    """Alias groups a person should see: names of one canon, two or more."""
    g = canon.groupBy("canon").agg(F.sort_array(F.collect_set("name")).alias("names"))
    return g.where(F.size("names") > 1).join(entities.select(F.lower("name").alias("canon")).distinct(), "canon", "left_semi")


def display_name(forms: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """key, name: the declared spelling of a key, else its most frequent form, else the first by letter."""
    counts = forms.groupBy("key", "form").agg(F.count("*").alias("n"))
    best = counts.groupBy("key").agg(F.min_by("form", F.struct((-F.col("n")).alias("n"), "form")).alias("name"))
    if aliases is None:
        return best
    declared = aliases.select(X.merge_key("name").alias("key"), F.col("canon").alias("_d")).groupBy("key").agg(F.min("_d").alias("_d"))
    return best.join(declared, "key", "left").select("key", F.coalesce("_d", "name").alias("name"))
