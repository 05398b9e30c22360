"""Migration of frontmatter: first a table of edits, which can be looked at, then the notes rewritten by it; a second run plans nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Where the frontmatter stands, what a key is, and what a numbered source looks like.
BLOCK = r"(?s)\A(---[ \t]*\n)(.*?)(\n---[ \t]*\n)"
KEY = r"(?s)\A([A-Za-z_][\w-]*):\s*(.*)\z"
NUMBERED = r"\As(\d+):"
#: The key that is written from another, where that has a value and the key is not there.
ORIGINS = {"generated_by": "distilled_by", "generated_at": "captured"}
EDIT = "path string, line int, old string, new string, change string"


def block_lines(raw: Column) -> Column:
    """The lines between the fences; null without a block."""
    return F.when(raw.rlike(BLOCK), F.split(F.regexp_extract(raw, BLOCK, 2), "\n", -1))


def trimmed(c: Column, chars: str = " \t\r\n\x0b\x0c") -> Column:
    return F.btrim(c, F.lit(chars))


def key_of(line: Column) -> Column:
    return F.regexp_extract(line, KEY, 1)


def value_of(lines: Column, key: str) -> Column:
    """The value of the last line with the key; null without one."""
    hits = F.filter(lines, lambda x: key_of(x) == key)
    return trimmed(F.regexp_extract(F.try_element_at(hits, F.lit(-1)), KEY, 2))


def quoted(value: Column) -> Column:
    """The value, in quotes where a colon or an opening bracket would break it."""
    hard = value.contains(":") | value.rlike(r'\A[\[{"]')
    return F.when(hard, F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit("'")), F.lit('"'))).otherwise(value)


def numbered_sources(value: Column) -> Column:
    """A list of sources with a number before each that has none, from the highest number there on; null where nothing changes."""
    inner = F.substring(value, F.lit(2), F.char_length(value) - 2)
    items = F.transform(F.filter(F.split(inner, ",", -1), lambda x: trimmed(x) != ""), lambda x: F.btrim(trimmed(x), F.lit("\"'")))
    known = lambda x: x.rlike(NUMBERED)
    highest = F.coalesce(F.array_max(F.transform(F.filter(items, known), lambda x: F.regexp_extract(x, NUMBERED, 1).try_cast("long"))), F.lit(0))
    place = lambda i: F.size(F.filter(F.slice(items, 1, i + 1), lambda y: ~known(y)))
    made = F.transform(items, lambda x, i: F.when(known(x), x).otherwise(F.concat(F.lit("s"), (highest + place(i)).cast("string"), F.lit(":"), x)))
    new = F.concat(F.lit("["), F.array_join(F.transform(made, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", "), F.lit("]"))
    return F.when(value.rlike(r"(?s)\A\[.*\]\z") & (F.size(items) > 0) & (new != value), new)


def plan(notes: DataFrame) -> DataFrame:
    """EDIT rows of notes (path, raw): line from 0 within the block, or the number of its lines for a line that is added (old is null)."""
    rows = notes.select("path", F.inline(F.array(F.struct(block_lines(F.col("raw")).alias("lines"))))).where("lines is not null")
    fields = {k: value_of(F.col("lines"), k) for k in ("sources", *ORIGINS, *ORIGINS.values())}
    rows = rows.select("path", "lines", F.inline(F.array(F.struct(*[v.alias(k) for k, v in fields.items()], numbered_sources(fields["sources"]).alias("_new")))))
    first = F.array_position(F.transform("lines", key_of), "sources") - 1
    edit = lambda line, old, new, change: F.struct(line.cast("int").alias("line"), old.alias("old"), new.alias("new"), F.lit(change).alias("change"))
    nothing = F.lit(None).cast("string")
    old, new = F.get("lines", first.cast("int")), F.concat(F.lit("sources: "), "_new")
    # of two lines with the key the last is read and the first is written, so that may have been done already
    edits = [F.when(F.col("_new").isNotNull() & (old != new), edit(first, old, new, "sources numbered"))]
    for key, origin in ORIGINS.items():
        wanted = F.col(key).isNull() & F.col(origin).isNotNull() & (F.col(origin) != "")
        edits.append(F.when(wanted, edit(F.size("lines"), nothing, F.concat(F.lit(f"{key}: "), quoted(F.col(origin))), f"{key} from {origin}")))
    return rows.select("path", F.inline(F.array_compact(F.array(*edits))))


def apply(notes: DataFrame, edits: DataFrame) -> DataFrame:
    """notes rewritten by a plan; a line that is no longer what the plan saw is left as it is, as are notes without edits."""
    told = edits.groupBy("path").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("old").isNotNull(), F.struct("line", F.struct("old", "new"))))).alias("_at"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("old").isNull(), F.struct("change", "new")))), lambda x: x["new"]).alias("_added"),
    )
    rows = notes.join(told, "path", "left")
    raw, lines = F.col("raw"), block_lines(F.col("raw"))
    change = lambda i: F.try_element_at(F.col("_at"), i)
    kept = F.transform(lines, lambda x, i: F.when(change(i)["old"] == x, change(i)["new"]).otherwise(x))
    missing = F.filter("_added", lambda x: ~F.exists(lines, lambda y: key_of(y) == key_of(x)))
    head, tail = F.regexp_extract(raw, BLOCK, 1), F.regexp_extract(raw, BLOCK, 3)
    rest = F.substring(raw, F.char_length(F.regexp_extract(raw, BLOCK, 0)) + 1, F.char_length(raw))
    new = F.concat(head, F.array_join(F.concat(kept, missing), "\n"), tail, rest)
    return rows.withColumn("raw", F.when(F.col("_at").isNotNull() & lines.isNotNull(), new).otherwise(raw)).drop("_at", "_added")
