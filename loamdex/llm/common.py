"""Helpers shared by the training-data operators."""

from __future__ import annotations

import pickle
import warnings
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loamdex.session import discard, stored

#: Rows up to which a list of ids is broadcast (about 12 MB); longer lists are joined by a shuffle.
BROADCAST_ROWS = 500_000


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the column as text, modulo ``modulus``; null ids count as remainder 0 of the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def whole_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Only the id and the text (null: empty), so that other columns can clash with nothing."""
    return df.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(text_col), *more)


#: Bytes of text that a training sample may bring to the driver.
SAMPLE_BYTES = 64 << 20


def sampled(docs: DataFrame, labels: DataFrame, label: str, per_class: int, modulus: int, held_out: int, most_bytes: int = SAMPLE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text, y of a bounded training sample; the stored table it is read from): at most ``per_class`` rows of either label and ``most_bytes`` in all.

    Rows come from ``labels`` where crc32(doc_id) mod ``modulus`` is not ``held_out``, smallest
    xxhash64(doc_id) first, so the sample is the same on every run. Null ids and labels are left out;
    of repeated labels of a document the largest counts, of several texts of an id the smallest. Each id
    is one row before anything is collected. A text that does not fit the bytes left for its class is passed over, and
    the next ones are tried; none is cut. A class of which no text fits is warned of.
    """
    known = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .where("doc_id is not null and y in (0, 1)")
        .where(crc_mod("doc_id", modulus) != held_out)
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    )
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    picked = picked[0].unionByName(picked[1])  # at most 2 * per_class short rows: a proven bound for the broadcast
    once = (
        docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null")
        .join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    )
    once = stored(once.withColumn("bytes", F.octet_length("text")), "sample")  # 2 * per_class rows at most
    order = once.select("doc_id", "y", "bytes", F.xxhash64("doc_id").alias("h")).collect()
    taken, left = [], {0: most_bytes // 2, 1: most_bytes // 2}  # both classes keep their share of the bytes
    for r in sorted(order, key=lambda r: (r["h"], r["doc_id"])):
        if r["bytes"] <= left[r["y"]]:
            left[r["y"]] -= r["bytes"]
            taken.append(r["doc_id"])
    for y in {r["y"] for r in order} - {r["y"] for r in order if r["doc_id"] in set(taken)}:
        warnings.warn(f"every labelled text of class {y} is longer than {most_bytes // 2} bytes: none is in the sample", stacklevel=2)
    return once.where(F.col("doc_id").isin(taken) if taken else F.lit(False)).select("doc_id", "text", "y"), once


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, modulus: int, held_out: int, most_bytes: int = SAMPLE_BYTES) -> list:
    """The rows of sampled() as (text, label) pairs on the driver, by doc_id."""
    rows, once = sampled(docs, labels, label, per_class, modulus, held_out, most_bytes)
    out = rows.collect()
    discard(once)
    return [(r.text, r.y) for r in sorted(out, key=lambda r: (r.doc_id, r.text))]


def learned(learn: Callable[[list], object], docs: DataFrame, labels: DataFrame, label: str, per_class: int, modulus: int, held_out: int):
    """What ``learn`` makes of the (text, label) pairs of sampled(), by doc_id, in one task of an executor: neither texts nor training come to the driver."""
    rows, once = sampled(docs, labels, label, per_class, modulus, held_out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted(row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "y")), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(learn([(t, y) for _, t, y in held]))], pa.binary())], ["model"])

    found = rows.repartition(1).mapInArrow(run, "model binary").collect()  # the sample is bounded
    discard(once)
    return pickle.loads(found[0]["model"]) if found else learn([])


def text_hash(text_col: str = "text") -> Column:
    """A hash of the text (null: empty) that tells rows of one id apart."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def first_of_each(docs: DataFrame, marked: DataFrame, groups: DataFrame) -> DataFrame:
    """Of each root the document with the smallest ``least`` (doc_id, _th), once; documents with a null id all stay.

    ``marked`` has doc_id, _th of every document; ``groups`` has root, least of every group of copies, a null least
    standing for null ids alone. Only the texts whose fate is not simply to stay are looked up: the ids that go, and
    those that stand in several equal rows, are a short list, broadcast behind a count and joined by a shuffle beyond it.
    """
    first = groups.groupBy("root").agg(F.min("least").alias("least")).where("least is not null").select("least.doc_id", "least._th", F.lit(True).alias("first"))
    rows = marked.where("doc_id is not null").groupBy("doc_id", "_th").agg(F.count("*").alias("n")).join(first, ["doc_id", "_th"], "left")
    fate = rows.where("first is null or n > 1").select("doc_id", "_th", F.coalesce("first", F.lit(False)).alias("_repeated"))
    fate = stored(fate, "fates")
    small = fate.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    fate = F.broadcast(fate) if small else fate
    whole = docs.select(F.struct("*").alias("_row"), F.col("doc_id"), text_hash().alias("_th"))
    stays = whole.join(fate, ["doc_id", "_th"], "left_anti")
    once = whole.join(fate.where("_repeated"), ["doc_id", "_th"], "left_semi").groupBy("doc_id", "_th").agg(F.min_by("_row", F.to_json("_row")).alias("_row"))
    return stays.select("_row").unionByName(once.select("_row")).select("_row.*")
