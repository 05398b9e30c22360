"""Markdown folders as a document table, and the skip rules of a scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loamdex import schema as S
from loamdex.functions import text as X


def skipped(path: str | Column, anywhere: tuple[str, ...] = ("/.git/", "/node_modules/"), folders: tuple[str, ...] = (), prefixes: tuple[str, ...] = ()) -> Column:
    """Whether a path relative to the root stays out: substrings, folder names at any depth, index.md, path prefixes by component."""
    p = X.col(path)
    parts = F.split(p, "/")
    tests = [F.concat(F.lit("/"), p).contains(x) for x in anywhere] + [X.basename(p) == "index.md"]
    if folders:
        tests.append(F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*[F.lit(f) for f in folders])))
    tests += [(F.lower(p) == x.lower()) | F.lower(p).startswith(f"{x.lower()}/") for x in prefixes]
    return reduce(lambda a, b: a | b, tests)


def blocked_path(path: str | Column, rules: tuple[str, ...]) -> Column:
    """Whether a path lies under one of the root-anchored rules, by whole components and without case."""
    p = F.lower(X.col(path))
    tests = [(p == r.lower()) | p.startswith(f"{r.lower()}/") for r in rules]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def read_files(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """path (relative), raw, size, mtime."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    base = root.split("://", 1)[-1].rstrip("/") + "/"
    return files.select(F.substring_index("path", base, -1).alias("path"), F.col("content").cast("string").alias("raw"), F.col("content").alias("_bytes"), F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime"))


def origin(block: Column, path: Column) -> tuple[Column, Column]:
    """Origin and session agent of a document, by its frontmatter's sources; sessions come first."""
    uri = F.regexp_extract(block, r"(?m)^[ \t]*(?:-[ \t]+)?resource:[ \t]*\"?(claude|codex|hermes)-session://", 1)
    folder = path.startswith("raw/conversations/sessions/")
    named = F.lower(X.field(block, "session_agent"))
    agent = F.when(uri != "", uri).when(folder & (named == ""), "claude").when(folder & named.isin("claude", "codex", "hermes"), named).otherwise("")
    kind = F.lower(F.regexp_extract(block, r"(?s)(?:^|\n)sources:(?:[ \t]*\[[^\]]*?|[ \t]*\n(?:[ \t]+[^\n]*\n?)*?[ \t]+(?:-[ \t]+)?)\btype:[ \t]*[\"']?(\w+)", 1))
    return F.when((agent != "") | folder, "session").when(kind.isin("slack", "notion", "gdrive", "web"), kind).otherwise("vault"), agent


def documents(spark: SparkSession, root: str, folders: tuple[str, ...] = (), rules: tuple[str, ...] = ()) -> DataFrame:
    """The document table of a folder with ``status``: ok, short (body under the floor) or unreadable (no UTF-8)."""
    f = read_files(spark, root)
    block, text = X.frontmatter("raw"), X.body("raw")
    date, source = X.dated(F.col("block"))
    kind, agent = origin(F.col("block"), F.col("path"))
    bad = F.col("raw").isNull() | ~F.is_valid_utf8("raw")
    out = f.where(~skipped("path", folders=folders)).withColumns({"block": block, "text": text})
    title = X.field(F.col("block"), "title")
    return out.select(
        X.stable_doc_id("path").alias("doc_id"), "path", F.when(title != "", title).otherwise(F.regexp_replace(X.basename("path"), r"\.md$", "")).alias("title"), X.top_folder("path").alias("folder"), "size", "mtime",
        F.substring(F.sha2("_bytes", 256), 1, 16).alias("content_hash"), kind.alias("origin"), agent.alias("agent"), date.alias("doc_date"), source.alias("date_src"),
        ((F.lower(X.field(F.col("block"), "no_llm")) == "true") | blocked_path("path", rules)).alias("no_llm"),
        F.when(bad, "unreadable").when(F.char_length("text") < S.BODY_FLOOR, "short").otherwise("ok").alias("status"), "text",
    )


def indexable_count(docs: DataFrame, limit: int) -> int:
    """How many documents can be indexed, counted up to a limit."""
    return docs.where("status = 'ok'").limit(limit).count()


def refuse_collisions(docs: DataFrame) -> DataFrame:
    """Raise if two paths share an id."""
    twice = docs.groupBy("doc_id").agg(F.count_distinct("path").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"two paths have the id {twice[0]['doc_id']}")
    return docs
