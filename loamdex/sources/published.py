"""A published index: document, chunk, term, posting and length tables of a version, meta last, read by search without texts.

Postings lie in buckets by the term's crc32, sorted by term within a file, so a query reads the row groups of its own
terms. A row holds the postings of a term in a block of neighbouring chunks, which are known by a number (n) that
ix_doclen resolves; blocks are made where chunks are read, so no posting is shuffled. Versions are numbered and never changed: a reader stays on the version it opened while a writer makes the next.
Two writers cannot make the same version, since a version is claimed by a file that must not exist yet.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from loamdex import schema as S
from loamdex.functions import grams, text as X
from loamdex.operators import index
from loamdex.operators.sync import guard_shrink

#: Characters of chunk text a bucket; each task that reads chunks writes one file of every bucket.
BUCKET_CHARS = 64 << 20
FEWEST_BUCKETS, MOST_BUCKETS = 8, 64
#: The postings of a term in a block of chunks: number of the first chunk, largest chunk_id, then of each posting the
#: chunk's number after ``base`` and tf, and all their positions in a row.
PACKED = "term string, base long, last_chunk long, places array<short>, tfs array<short>, positions array<short>"
#: Gaps of rising numbers take few bits in the second version of Parquet's encodings.
ENCODED = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary#places.list.element": "false"}


@dataclass(frozen=True)
class Index:
    """A version of an index: its folder and meta."""

    spark: SparkSession
    path: str
    meta: dict[str, str]

    def table(self, name: str) -> DataFrame:
        """A table of the version; ix_postings as a row a posting (bucket, term, doc_id, chunk_id, tf, positions, num_tokens)."""
        if name == "ix_postings":
            return unpacked(self.packed()).join(self.table("ix_doclen"), "n").select("bucket", "term", "doc_id", "chunk_id", "tf", "positions", "num_tokens")
        return self.spark.read.parquet(f"{self.path}/{name}")

    def packed(self) -> DataFrame:
        """ix_postings as they lie: a row (PACKED, bucket) a term and block."""
        return self.spark.read.parquet(f"{self.path}/ix_postings")


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _folder(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def stamp_of(spark: SparkSession, path: str) -> str:
    """What tells a table's state: names, lengths and times of its files."""
    fs, at = _folder(spark, path)
    files = fs.listFiles(at, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}")
    return f"{zlib.crc32('|'.join(sorted(found)).encode()):08x}-{len(found)}"


def claimed(spark: SparkSession, root: str) -> str:
    """A version of its own for a writer: the next number that nobody has claimed."""
    n = max([int(x[1:7]) for x in _names(spark, root) if x.startswith("v")], default=0)
    while True:
        n += 1
        fs, at = _folder(spark, f"{root}/v{n:06d}.claim")
        if fs.createNewFile(at):
            return f"v{n:06d}"


def versions(spark: SparkSession, root: str) -> list[str]:
    """Whole versions, oldest first: those with meta, which is written last."""
    every = [n for n in _names(spark, root) if n.startswith("v") and not n.endswith(".claim")]
    return [v for v in every if "_SUCCESS" in _names(spark, f"{root}/{v}/meta")]


def opened(spark: SparkSession, root: str) -> Index | None:
    """The newest whole version."""
    whole = versions(spark, root)
    if not whole:
        return None
    path = f"{root}/{whole[-1]}"
    return Index(spark, path, {r["key"]: r["value"] for r in spark.read.parquet(f"{path}/meta").collect()})


def refreshed(held: Index, root: str) -> Index:
    """The version that is held, if it is still the newest; else the newest."""
    whole = versions(held.spark, root)
    return held if whole and held.path.endswith(whole[-1]) else opened(held.spark, root) or held


def drop_versions(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete all but the newest ``keep`` whole versions and what lies unfinished before them; names of those that went."""
    whole = versions(spark, root)
    if len(whole) <= keep:
        return []
    first = whole[-keep]
    gone = [n for n in _names(spark, root) if n.startswith("v") and n[:7] < first]
    for n in gone:
        fs, at = _folder(spark, f"{root}/{n}")
        fs.delete(at, True)
    return [n for n in gone if not n.endswith(".claim")]


def bucket_of(term: str, buckets: int) -> int:
    return zlib.crc32(term.encode()) % buckets


def packed_postings(chunks: DataFrame) -> DataFrame:
    """PACKED of chunks (n, chunk_id, text): the n-grams of a block of chunks are grouped where it is read, a row a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for numbers, ids, texts in grams.blocks(batches):
            g = grams.grouped(texts)
            # a list ends where a term does; the largest chunk_id of a list stands beside it
            heads = np.append(g.first_of_term, len(g.owner)).astype(np.int32)
            ends = np.append(g.first, len(g.place))[heads].astype(np.int32)
            last = np.maximum.reduceat(ids[g.owner], heads[:-1]) if len(g.owner) else np.empty(0, np.int64)
            lists = lambda at, x: pa.ListArray.from_arrays(pa.array(at), pa.array(x.astype(np.int16), pa.int16()))
            terms = pa.array(map(grams.term_text, g.code.tolist()), pa.string())
            columns = [terms, pa.array(np.full(len(g.code), numbers[0])), pa.array(last), lists(heads, numbers[g.owner] - numbers[0]), lists(heads, g.tf), lists(ends, g.place)]
            yield pa.RecordBatch.from_arrays(columns, ["term", "base", "last_chunk", "places", "tfs", "positions"])

    return chunks.select(F.col("n"), F.col("chunk_id").cast("long").alias("chunk_id"), F.lower("text").alias("low")).mapInArrow(run, PACKED)


def unpacked(packed: DataFrame) -> DataFrame:
    """bucket, term, n, tf, positions: a row a posting."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                b = whole.slice(i, 256)
                places, tfs, found = (b.column(c) for c in ("places", "tfs", "positions"))
                sizes = places.value_lengths().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(b.num_rows), sizes)
                tf = tfs.flatten().to_numpy().astype(np.int32)
                n = b.column("base").to_numpy()[row] + places.flatten().to_numpy()
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(tf)).astype(np.int32)), found.flatten().cast(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column("bucket").take(pa.array(row)), b.column("term").take(pa.array(row)), pa.array(n), pa.array(tf), lists], ["bucket", "term", "n", "tf", "positions"])

    return packed.select("bucket", "term", "base", "places", "tfs", "positions").mapInArrow(run, "bucket int, term string, n long, tf int, positions array<int>")


def publish(docs: DataFrame, root: str, stamp: str = "", extra: dict[str, str] | None = None, least_share: float = S.SHRINK_GUARD, allow_shrink: bool = False) -> Index:
    """Write the next version of the index of docs (doc_id, text and what else shall be kept of a document).

    A version with fewer documents than ``least_share`` of the one before is refused, unless ``allow_shrink``.
    """
    spark = docs.sparkSession
    before = opened(spark, root)
    if before and not allow_shrink:
        guard_shrink(docs.count(), int(before.meta["documents"]), least_share)
    path = f"{root}/{claimed(spark, root)}"
    docs.drop("text").write.parquet(f"{path}/documents")
    index.chunk_table(docs.where("text is not null")).withColumn("n", F.monotonically_increasing_id()).write.parquet(f"{path}/chunks")
    chunks = spark.read.parquet(f"{path}/chunks")
    lens = chunks.select("n", F.col("doc_id").cast("long").alias("doc_id"), F.col("chunk_id").cast("long").alias("chunk_id"), X.ngram_count("text").alias("num_tokens"))
    lens.write.parquet(f"{path}/ix_doclen")
    chars = chunks.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()[0]
    totals = spark.read.parquet(f"{path}/ix_doclen").agg(F.count("*").alias("n"), F.coalesce(F.sum("num_tokens"), F.lit(0)).alias("tokens")).first()
    buckets = min(MOST_BUCKETS, max(FEWEST_BUCKETS, -(-chars // BUCKET_CHARS)))
    bucket = (F.crc32(F.col("term").cast("binary")) % buckets).cast("int")
    packed_postings(chunks).withColumn("bucket", bucket).sortWithinPartitions("bucket", "term", "base").write.partitionBy("bucket").options(**ENCODED).parquet(f"{path}/ix_postings")
    held = spark.read.parquet(f"{path}/ix_postings").groupBy("bucket", "term").agg(F.sum(F.size("places")).alias("df"))
    idf = F.log((F.lit(float(totals["n"])) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    held.withColumn("idf", idf).repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/ix_terms")
    meta = {
        "documents": spark.read.parquet(f"{path}/documents").count(), "chunks": totals["n"], "tokens": totals["tokens"], "buckets": buckets, "stamp": stamp,
        "chunk_chars": S.CHUNK_SIZE, "chunk_overlap": S.CHUNK_OVERLAP, "ngrams": f"{S.NGRAM_LOW},{S.NGRAM_HIGH}", "schema_version": "4",
    }
    rows = [(k, str(v)) for k, v in (meta | (extra or {})).items()]
    spark.createDataFrame(rows, "key string, value string").coalesce(1).write.parquet(f"{path}/meta")
    return Index(spark, path, dict(rows))


def current(spark: SparkSession, source: str, docs: DataFrame, root: str) -> Index:
    """The published index of the table at ``source``: the newest version, if it was made of the table as it stands, else a new one."""
    stamp = stamp_of(spark, source)
    held = opened(spark, root)
    return held if held and held.meta["stamp"] == stamp and held.meta["schema_version"] == "4" else publish(docs, root, stamp, allow_shrink=True)


def lookup(held: Index, name: str, terms: list[str]) -> DataFrame:
    """Rows of a bucketed table, as they lie, for the terms alone."""
    buckets = sorted({bucket_of(t, int(held.meta["buckets"])) for t in terms})
    rows = held.packed() if name == "ix_postings" else held.table(name)
    return rows.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))


def bm25(held: Index, query: str, k1: float = S.K1, b: float = S.B, binary: bool = False) -> DataFrame:
    """doc_id, chunk_id, score of the chunks that have any term of the query, from postings alone."""
    terms = X.query_terms(query)
    mean = int(held.meta["tokens"]) / max(int(held.meta["chunks"]), 1)
    lists = lookup(held, "ix_postings", terms).select("term", "base", "places", "tfs")
    weights = lookup(held, "ix_terms", terms).select("term", "idf")  # a row a term of the query
    norm = k1 * (1 - b + b * F.col("num_tokens") / F.lit(mean))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + norm)
    each = lists.join(F.broadcast(weights), "term").select("idf", "base", F.inline(F.arrays_zip("places", "tfs")))
    found = each.select((F.col("base") + F.col("places")).alias("n"), "idf", F.lit(1.0).alias("tf") if binary else F.col("tfs").cast("double").alias("tf"))
    scored = found.join(held.table("ix_doclen"), "n").groupBy("n", "doc_id", "chunk_id").agg(F.sum(part).alias("score"))
    return scored.drop("n")


# --- stale marks beside the versions ---------------------------------------------------------------
MARK = "doc_id long, path string, reason string, marked_at long"


def mark_stale(marks: DataFrame, root: str) -> None:
    """Append marks (MARK): documents that changed after the extraction saw them."""
    marks.select("doc_id", "path", "reason", "marked_at").write.mode("append").parquet(f"{root}/stale_docs")


def marks_at(spark: SparkSession, root: str) -> tuple[DataFrame, list[str]]:
    """(the latest mark of each document, the files they stand in): a snapshot that later marks do not change."""
    files = [f"{root}/stale_docs/{n}" for n in _names(spark, f"{root}/stale_docs") if n.startswith("part-")]
    rows = spark.read.schema(MARK).parquet(*files) if files else spark.createDataFrame([], MARK)
    latest = F.max_by(F.struct("path", "reason", "marked_at"), F.struct("marked_at", "reason", "path")).alias("m")
    return rows.groupBy("doc_id").agg(latest).select("doc_id", "m.*"), files


def settle_marks(spark: SparkSession, files: list[str]) -> None:
    """Delete the marks of a snapshot, once a rebuild that began with it is published; marks made meanwhile stay."""
    for f in files:
        fs, at = _folder(spark, f)
        fs.delete(at, False)
