"""Shared extraction streams: one append-only file a device, checked row by row, merged by revision.

Rows that break a rule are kept apart with the reason. Revisions of a key rise within a device's stream; of all
devices' rows of a key, the one with the highest (revision, device, import id) holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loamdex.operators import ledger

#: Rows longer than this, and names of other shapes, are refused.
ROW_CHARS = 2_000_000
DEVICE = r"^[a-z0-9]+(-[a-z0-9]+)*$"
RECEIPT = r"^[0-9a-f]{64}$"
SUFFIX = ".lr_cache.jsonl"
KEY = ["doc", "idx", "h", "pv"]
ENTITY = "array<struct<name:string,type:string,description:string>>"
RELATION = "array<struct<source:string,target:string,keywords:string,description:string>>"


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """device, position, value of the streams in a folder (one file a device), blank lines left out; positions are in the file's order."""
    rows = spark.read.text(f"{folder}/*{SUFFIX}").select(F.regexp_extract("_metadata.file_name", r"^(.*)\.lr_cache\.jsonl$", 1).alias("device"), F.struct("_metadata.file_block_start", F.monotonically_increasing_id().alias("i")).alias("at"), "value")
    ordered = ledger.numbered(rows.where(F.trim("value") != ""), ["device"], "at", "position")
    return ordered.select("device", "position", "value")


def kind(row: Column, path: str) -> Column:
    """The JSON type at a path: STRING, BIGINT, BOOLEAN, VOID, OBJECT<...>, ARRAY<...>; null where there is nothing."""
    return F.schema_of_variant(F.variant_get(row, path, "variant"))


def items_are(row: Column, path: str, *fields: str) -> Column:
    """Whether the list at a path has only objects whose fields are strings."""
    each = F.try_variant_get(row, path, "array<variant>")
    good = lambda x: [kind(x, f"$.{f}") == "STRING" for f in fields]
    both = lambda x: F.coalesce(good(x)[0] if len(fields) == 1 else good(x)[0] & good(x)[1], F.lit(False))
    return F.coalesce(kind(row, path).startswith("ARRAY"), F.lit(False)) & F.coalesce(F.forall(each, both), F.lit(False))


def checked(rows: DataFrame, model: str = "") -> DataFrame:
    """rows (device, position, value) with their fields, and why a row is refused (reason: null if it holds, 'skipped' if it tells of no result)."""
    v = F.col("v")
    text = lambda f: F.try_variant_get(v, f"$.{f}", "string")
    has = lambda f: kind(v, f"$.{f}").isNotNull()
    is_text = lambda f: F.coalesce(kind(v, f"$.{f}") == "STRING", F.lit(False))
    number = lambda f: F.when(kind(v, f"$.{f}") == "BIGINT", F.try_variant_get(v, f"$.{f}", "bigint"))
    failed = F.coalesce(F.when(kind(v, "$.failed") == "STRING", text("failed") != "").otherwise(F.try_variant_get(v, "$.failed", "boolean")), F.lit(False))
    named = is_text("doc") & (text("doc") != "") & F.coalesce(number("idx") >= 0, F.lit(False)) & is_text("h") & (text("h") != "")
    optional = lambda f: ~has(f) | is_text(f)
    shape = items_are(v, "$.entities", "name") & items_are(v, "$.relationships", "source", "target")
    provenance = optional("repository") & optional("origin_device") & (~has("revision") | F.coalesce(number("revision") >= 0, F.lit(False)))
    receipt = lambda f: ~has(f) | (is_text(f) & F.coalesce(text(f).rlike(RECEIPT), F.lit(False)))
    reason = (
        F.when(F.char_length("value") > ROW_CHARS, "oversized").when(v.isNull(), "invalid JSON").when(~F.schema_of_variant(v).startswith("OBJECT"), "not an object")
        .when(failed | ~has("h"), "skipped").when(~(named & optional("pv") & optional("model")), "key").when(~shape, "shape")
        .when(~provenance, "provenance").when(~(receipt("import_id") & receipt("import_result")), "receipt").when(~F.col("device").rlike(DEVICE), "device")
    )
    # made by generators, so that no rule of the optimizer parses or judges a row once more for each field
    parsed = rows.select("device", "position", "value", F.inline(F.array(F.struct(F.when(F.char_length("value") <= ROW_CHARS, F.try_parse_json("value")).alias("v")))))
    parsed = parsed.select("*", F.inline(F.array(F.struct(reason.alias("reason")))))
    good = lambda c: F.when(F.col("reason").isNull(), c)
    fields = {
        "doc": text("doc"), "idx": number("idx"), "h": text("h"), "pv": F.coalesce(text("pv"), F.lit("")), "model": F.coalesce(text("model"), F.lit(model)), "at": F.substring(F.coalesce(text("at"), F.lit("")), 1, 32),
        "entities": F.try_variant_get(v, "$.entities", ENTITY), "relationships": F.try_variant_get(v, "$.relationships", RELATION),
        "repository": text("repository"), "revision": F.coalesce(number("revision"), F.lit(0)), "origin_device": text("origin_device"), "import_id": text("import_id"), "import_result": text("import_result"),
    }
    out = parsed.select("device", "position", "value", "reason", *[good(c).alias(f) for f, c in fields.items()])
    forged = F.col("import_id").isNotNull() & ~F.col("import_result").eqNullSafe(result_identity())
    return out.withColumns({"import_id": F.when(~forged, F.col("import_id")), "import_result": F.when(~forged, F.col("import_result"))})


def result_identity() -> Column:
    """A digest of what a row says, whoever wrote it and when."""
    return F.sha2(F.to_json(F.struct("repository", "doc", "idx", "h", "pv", "model", "entities", "relationships")), 256)


def merged(rows: DataFrame, repository: str) -> tuple[DataFrame, DataFrame]:
    """(all rows of the repository with revisions that rise and receipts, those refused) of checked() rows.

    Rows of other repositories, and rows that name another device than their stream's, are refused as 'repository' and 'origin'.
    """
    reason = F.when(F.col("reason").isNotNull(), F.col("reason")).when(~F.col("repository").eqNullSafe(F.lit(repository)), "repository").when(F.coalesce("origin_device", "device") != F.col("device"), "origin")
    marked = rows.withColumn("reason", reason)
    kept = marked.where("reason is null").drop("reason", "value")
    risen = ledger.merged_revisions(kept, ["device", *KEY], "position", "revision").withColumn("origin_device", F.col("device"))
    receipts = risen.withColumn("import_result", result_identity())
    event = F.sha2(F.to_json(F.struct("repository", "device", "position", "revision", "import_result")), 256)
    return receipts.withColumn("import_id", event), marked.where("reason is not null").select("device", "position", "reason", "value")


def held(rows: DataFrame) -> DataFrame:
    """Of each key (doc, idx, h, pv) the row that holds."""
    return ledger.latest(rows, KEY, ["revision", "origin_device", "import_id"])


def reconciled(local: DataFrame, pulled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, diverged): of each device the longer stream, the pulled one of two alike; and the devices whose streams differ where both have rows.

    A diverged device gives no rows: its history was rewritten and must be looked at.
    """
    a, b = (df.select("device", "position", F.col("value").alias(n)) for df, n in ((local, "a"), (pulled, "b")))
    both = a.join(b, ["device", "position"], "full")
    state = both.groupBy("device").agg(F.count("a").alias("na"), F.count("b").alias("nb"), F.min("position").alias("first"), F.bool_or(F.col("a") != F.col("b")).alias("differs"))
    diverged = state.where(F.coalesce("differs", F.lit(False))).select("device")
    value = F.when(F.col("nb") >= F.col("na"), F.col("b")).otherwise(F.col("a"))
    rows = both.join(state.where(~F.coalesce("differs", F.lit(False))), "device").select("device", "position", value.alias("value"))
    return rows.where("value is not null"), diverged
