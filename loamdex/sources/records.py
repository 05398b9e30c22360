"""JSON lines, transcripts, ledgers, run logs, canvases, rule files and session stores."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

EXTRACTION = "doc string, idx int, h string, pv string, model string, at string, seq long, entities array<struct<name:string,type:string,description:string>>, relationships array<struct<source:string,target:string,keywords:string,description:string>>"
LEDGER = "source_type string, source_id string, content_hash string, source_updated_at string, distilled_through_last_ts string, no_llm boolean, pages array<string>, seq long, device string"
RUN = "id string, step string, started_at timestamp, ended_at timestamp, exit_code int, status string, lines long, units long, origin string"
TURN = "type string, uuid string, timestamp string, sessionId string, isSidechain boolean, message struct<role:string,content:string>"
GRAPH = "version int, source string, built_at string, min_degree int, types array<string>, communities array<struct<id:int,label:string,count:int>>, entities array<struct<id:string,name:string,type:int,degree:int,community:int>>, relations array<array<int>>"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file with _file; bad lines are left out."""
    lines = spark.read.text(path).select(F.from_json("value", schema).alias("_r"), F.input_file_name().alias("_file"), F.col("value").alias("_v"))
    return lines.where(F.col("_r").isNotNull() & F.col("_v").rlike(r"^\s*\{.*\}\s*$")).select("_r.*", "_file")


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """Ledger rows of all devices; a row without a device takes its file's name."""
    name = F.regexp_extract("_file", r"([^/]+)\.jsonl?$", 1)
    return json_lines(spark, path, LEDGER).withColumn("device", F.coalesce("device", name)).drop("_file")


def runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN).option("multiLine", True).json(path).withColumn("seconds", F.col("ended_at").cast("double") - F.col("started_at").cast("double"))


def extraction_rows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Valid rows of an extraction cache, and rejected ones with the reason."""
    rows = json_lines(spark, path, EXTRACTION)
    reason = F.when(F.col("doc").isNull() | F.col("idx").isNull() | F.col("h").isNull(), "key").when(F.col("entities").isNull(), "shape").when(F.exists("entities", lambda e: e["name"].isNull()), "name")
    marked = rows.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def transcript(spark: SparkSession, path: str, cutoff: str | None = None) -> DataFrame:
    """session, turn, role, text of agent transcripts in JSON lines; content is a string or a list of blocks."""
    rows = json_lines(spark, path, TURN)
    blocks = F.from_json(F.col("message.content"), "array<struct<type:string,text:string,name:string>>")
    listed = F.array_join(F.array_compact(F.transform(blocks, lambda b: F.when(b["type"] == "text", b["text"]).when(b["type"] == "tool_use", F.concat(F.lit("[tool:"), F.coalesce(b["name"], F.lit("?")), F.lit("]"))))), "\n")
    text = F.when(F.col("message.content").startswith("["), listed).otherwise(F.col("message.content"))
    out = rows.where("message is not null").select(F.coalesce("sessionId", "_file").alias("session"), F.col("timestamp").alias("turn"), F.col("message.role").alias("role"), text.alias("text"))
    return out.where(F.col("turn") < cutoff) if cutoff else out


def rollout(spark: SparkSession, path: str, since: str | None = None, through: str | None = None) -> DataFrame:
    """session, turn, role, text of rollout files: message items, in a half-open range of time."""
    item = "timestamp string, type string, payload struct<type:string,role:string,content:array<struct<type:string,text:string>>>"
    rows = json_lines(spark, path, item).where("payload.type = 'message' and payload.role in ('user', 'assistant')")
    text = F.array_join(F.transform("payload.content", lambda c: F.coalesce(c["text"], F.lit(""))), "\n")
    out = rows.select(F.col("_file").alias("session"), F.col("timestamp").alias("turn"), F.col("payload.role").alias("role"), F.regexp_replace(text, r"(?s)<(user_instructions|environment_context)>.*?</\1>", "").alias("text"))
    out = out.where(F.col("turn") > since) if since else out
    return out.where(F.col("turn") <= through) if through else out


def store(spark: SparkSession, url: str, table: str, driver: str | None = None) -> DataFrame:
    """A table of a session store over JDBC (the driver's jar comes with the cluster)."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    return (reader.option("driver", driver) if driver else reader).load()


def canvas_links(canvases: DataFrame, path: str = "path", raw: str = "raw") -> DataFrame:
    """src, dst, n of the files that JSON canvases show; malformed canvases show none."""
    nodes = F.from_json(raw, "nodes array<struct<type:string,file:string>>")["nodes"]
    return canvases.select(F.col(path).alias("src"), F.explode(nodes).alias("n")).where("n.type = 'file' and n.file <> ''").groupBy("src", F.col("n.file").alias("dst")).agg(F.count("*").alias("n"))


def graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (idx, id, name, type, degree, community) and edges (src, dst as indexes) of an exported graph."""
    g = spark.read.schema(GRAPH).option("multiLine", True).json(path)
    nodes = g.select("types", F.posexplode("entities").alias("idx", "e")).select("idx", "e.id", "e.name", F.get("types", F.col("e.type")).alias("type"), "e.degree", "e.community")
    return nodes, g.select(F.explode("relations").alias("r")).select(F.get("r", F.lit(0)).alias("src"), F.get("r", F.lit(1)).alias("dst"))


def alias_rules(text: str) -> list[tuple[str, str]]:
    """(name, canon) pairs of a rule file: ``Canon: [a, b]`` or ``Canon:`` with ``- a`` lines."""
    out, canon = [], None
    for line in text.splitlines():
        line = line.split(" #", 1)[0].rstrip()
        if not line or line.lstrip().startswith("#"):
            continue
        item = re.match(r"\s+-\s*(.+)$", line)
        head = re.match(r"([^\s:][^:]*):\s*(?:\[(.*)\])?\s*$", line)
        names = [item[1]] if item and canon else []
        if head:
            canon = head[1].strip().strip("\"'")
            names = [canon, *(head[2] or "").split(",")]
        out += [(n.strip().strip("\"'"), canon) for n in names if n.strip()]
    return out


def homonym_rules(text: str) -> list[tuple[str, str, str, int]]:
    """(name, cue, label, ord) of ``name:`` blocks with ``- label: [cue, cue]`` lines."""
    out, name, at = [], None, 0
    for line in text.splitlines():
        if head := re.match(r"([^\s:][^:]*):\s*$", line):
            name = head[1].strip()
        elif (item := re.match(r"\s+-\s*([^:]+):\s*\[(.*)\]\s*$", line)) and name:
            for cue in filter(None, (c.strip().strip("\"'") for c in item[2].split(","))):
                out.append((name, cue, item[1].strip(), at))
            at += 1
    return out
