"""Media folders: files listed without being read, read where they are new, paired with sidecars and notes, one row a content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loamdex.functions import text as X
from loamdex.operators import media

# What is a picture or a film, how strong a link is, and how much of a field the manifest holds.
PICTURES = ("png", "jpg", "jpeg", "gif", "webp", "heic", "heif")
FILMS = ("mp4", "mov", "m4v", "webm")
MIME = {"jpg": "image/jpeg", "m4v": "video/x-m4v", "mov": "video/quicktime"}
SCORES = {"manual": 1.0, "embed": 0.9, "ocr": 0.7}
RANKS = {"manual": 3, "embed": 2, "ocr": 1}
CAPS = {"source": 512, "doc": 512, "entity": 512, "taken_at": 40}
MOST_DOCS = 50
EMBED_WIKI = r"!\[\[([^\]|#]+?)(?:[#|][^\]]*)?\]\]"
EMBED_MARKDOWN = r"!\[[^\]]*\]\(\s*<?([^)\s>]+)>?(?:\s+\"[^\"]*\")?\s*\)"
FILE = "path string, mtime timestamp, bytes long"


def extension(path: str | Column) -> Column:
    return F.lower(F.regexp_extract(X.col(path), r"\.([^./]+)$", 1))


def is_media(path: str | Column) -> Column:
    return extension(path).isin(*PICTURES, *FILMS)


def listing(spark: SparkSession, root: str, private: tuple[str, ...] = (), since: str | None = None) -> DataFrame:
    """path (below the root), mtime, bytes, content of all files, hidden ones and private folders left out.

    With ``since`` (a timestamp) only files changed after it: the source skips the others before any is opened. The
    content is read only by queries that ask for it.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    reader = reader.option("modifiedAfter", since) if since else reader
    base = root.split("://", 1)[-1].rstrip("/") + "/"
    # the source writes "file:/x" for "file:///x"
    path = F.regexp_replace(F.col("path"), r"^[a-z0-9]+:/+", "/")
    files = reader.load(root).select(F.expr("url_decode(replace(path, '+', '%2B'))").alias("path"), "modificationTime", "length", "content").withColumn("path", path)
    below = F.substring_index("path", base, -1)
    out = files.select(below.alias("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("bytes"), "content").where(~F.concat(F.lit("/"), "path").rlike(r"/\."))
    for p in private:
        out = out.where(~F.col("path").startswith(p.rstrip("/") + "/"))
    return out


def hashed(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """path, mtime, bytes, sha of media files; those that ``known`` (the same columns) has with their time and size are not read again."""
    found = files.where(is_media("path"))
    if known is None:
        return found.select("path", "mtime", "bytes", F.sha2("content", 256).alias("sha"))
    keys = ["path", "mtime", "bytes"]
    old = found.select(*keys).join(known.select(*keys, "sha"), keys)
    fresh = found.join(known.select(*keys), keys, "left_anti")
    return old.unionByName(fresh.select(*keys, F.sha2("content", 256).alias("sha")))


def listed(value: Column) -> Column:
    """The names of a one-line list, brackets and quotes dropped by field()."""
    return F.filter(F.transform(F.split(value, ","), lambda x: F.btrim(x)), lambda x: x != "")


def sidecars(files: DataFrame) -> DataFrame:
    """path (of the medium), entity of files named as a medium with .md or .json after it; the .md one counts where both can be read."""
    side = files.where(F.col("path").rlike(r"(?i)\.(md|json)$")).select(F.regexp_replace("path", r"(?i)\.(md|json)$", "").alias("path"), extension("path").alias("kind"), F.col("content").cast("string").alias("raw")).where(is_media("path"))
    block = X.frontmatter("raw")
    from_json = F.coalesce(F.from_json("raw", "entities array<string>")["entities"], listed(F.coalesce(F.get_json_object("raw", "$.entities"), F.lit(""))))
    names = F.when(F.col("kind") == "json", from_json).otherwise(listed(X.field(block, "entities")))
    readable = (F.col("kind") == "md") | F.try_parse_json("raw").isNotNull()
    first = side.where(readable).groupBy("path").agg(F.max_by(names, "kind").alias("names"))  # md after json in the alphabet
    return first.select("path", F.explode("names").alias("entity")).where("entity <> ''").distinct()


def embeds(notes: DataFrame, files: DataFrame) -> DataFrame:
    """note, path, section of the media that notes (path, text, no_llm) embed; section is the text of the heading's part around the embed.

    Notes that must not be shown give none. References resolve beside the note, from the root, then by name.
    """
    shown = notes.where(~F.coalesce("no_llm", F.lit(False)))
    parts = shown.select(F.col("path").alias("note"), F.explode(F.split("text", r"(?m)^(?=#{1,6}\s)")).alias("section"))
    found = F.concat(F.regexp_extract_all("section", F.lit(EMBED_WIKI), 1), F.regexp_extract_all("section", F.lit(EMBED_MARKDOWN), 1))
    refs = parts.select("note", "section", F.explode(F.array_distinct(found)).alias("written"))
    # no address of another scheme; %20 and the like are undone
    refs = refs.where(~F.col("written").rlike(r"(?i)^[a-z][a-z0-9+.\-]*:")).withColumn("ref", F.btrim(F.expr("try_url_decode(replace(written, '+', '%2B'))"))).where(is_media("ref"))
    targets = media.embed_targets(refs.select("note", "ref").distinct(), files.where(is_media("path")).select("path"))
    return refs.join(targets, ["note", "ref"]).select("note", "path", "section")


def links(files: DataFrame, notes: DataFrame, entities: DataFrame) -> DataFrame:
    """path, entity, basis, score, doc (null for a sidecar) of the entities that sidecars name, or that stand in a section that embeds the file."""
    manual = sidecars(files).select("path", "entity", F.lit("manual").alias("basis"), F.lit(None).cast("string").alias("doc"))
    around = embeds(notes, files)
    plain = F.lower(F.regexp_replace(F.regexp_replace("section", EMBED_WIKI, " "), EMBED_MARKDOWN, " "))
    texts = around.select(F.struct("path", "note").alias("sha"), F.lit("embed").alias("basis"), plain.alias("text"))
    named = media.name_links(texts, entities.select(F.col("name").alias("entity")))
    shown = named.select("sha.path", "entity", "basis", F.col("sha.note").alias("doc"))
    score = F.create_map(*[F.lit(x) for kv in SCORES.items() for x in kv])[F.col("basis")]
    return manual.unionByName(shown).withColumn("score", score)


def manifest(hashes: DataFrame, linked: DataFrame, around: DataFrame) -> DataFrame:
    """sha, kind, mime, bytes, taken_at, source, paths, entities, docs of each content: of its links to an entity the strongest holds.

    Entities stand by score, then name; notes by path, at most MOST_DOCS of those whose path fits.
    """
    rank = F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv])[F.col("basis")]
    of = hashes.select("path", "sha")
    best = linked.join(of, "path").groupBy("sha", "entity").agg(F.max_by(F.struct("score", "basis"), F.struct(rank.alias("r"), "score")).alias("l"))
    names = best.where(F.octet_length("entity") <= CAPS["entity"]).groupBy("sha").agg(F.array_sort(F.collect_list(F.struct((-F.col("l.score")).alias("s"), "entity", F.col("l.basis").alias("basis")))).alias("e"))
    docs = around.join(of, "path").where(F.octet_length("note") <= CAPS["doc"]).groupBy("sha").agg(F.slice(F.sort_array(F.collect_set("note")), 1, MOST_DOCS).alias("docs"))
    kind = extension(F.col("source"))
    fixed = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    whole = hashes.groupBy("sha").agg(F.max("bytes").alias("bytes"), F.min("mtime").alias("taken_at"), F.sort_array(F.collect_set("path")).alias("paths"))
    rows = whole.withColumn("source", F.substring(F.get("paths", F.lit(0)), 1, CAPS["source"]))
    rows = rows.withColumns({"kind": F.when(kind.isin(*FILMS), "video").otherwise("image")}).withColumn("mime", F.coalesce(F.try_element_at(fixed, kind), F.concat("kind", F.lit("/"), kind)))
    out = rows.join(names, "sha", "left").join(docs, "sha", "left")
    empty = F.array().cast("array<string>")
    return out.select("sha", "kind", "mime", "bytes", "taken_at", "source", "paths", F.coalesce(F.transform("e", lambda x: x["entity"]), empty).alias("entities"), F.coalesce(F.transform("e", lambda x: x["basis"]), empty).alias("bases"), F.coalesce("docs", empty).alias("docs"))
