"""Embedding whitening by TSQR: exact means, a QR in each partition, a tree of QRs over the R factors, SVD of the last R.

The covariance of the vectors is never formed: the right singular vectors of the centred rows are its eigenvectors, and
the squared singular values, over n, its eigenvalues.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loamdex.session import discard, stored

#: R factors that one task merges.
FAN = 16
#: Rows of a block that joins the R factor in one QR.
BLOCK = 4096
#: Entries count as this far from zero at most, so that they fit a long.
FURTHEST = 2.0**53
STATS = "size int, n long, sums array<decimal(38,0)>, furthest long"


def whole_numbers(vector: Column) -> Column:
    """floor(1024 c) + 100000 of each entry; entries beyond +-2^53 / 1024 count as those."""
    held = lambda c: F.greatest(F.lit(-FURTHEST), F.least(F.lit(FURTHEST), c.cast("double") * 1024))
    return F.transform(vector, lambda c: F.floor(held(c)) + F.lit(100000))


def usable(vector: Column) -> Column:
    """Not null, not empty, no entry null or not finite."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def wide_sum(a: np.ndarray) -> list[int]:
    """Column sums of whole numbers, exact beyond 64 bits."""
    high, low = (a >> 20).sum(axis=0), (a & 0xFFFFF).sum(axis=0)
    return [(int(h) << 20) + int(x) for h, x in zip(high, low, strict=True)]


def sums(rows: DataFrame) -> tuple[int, int, list[int], int] | None:
    """(size, n, sums, largest magnitude) of the vectors x of the commonest length (the longer, of two); None without rows.

    A partition gives one row a length, and these rows are added up by entry. What is collected is a row an entry.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            sizes = b.column("x").value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                a = matrix(b.column("x").filter(pa.array(sizes == size)), int(size))
                n, s, far = held.get(int(size), (0, [0] * int(size), 0))
                held[int(size)] = [n + len(a), [x + y for x, y in zip(s, wide_sum(a), strict=True)], max(far, int(np.abs(a).max()))]
        if held:
            totals = [[Decimal(v) for v in s] for _, s, _ in held.values()]
            columns = [pa.array(list(held), pa.int32()), pa.array([v[0] for v in held.values()]), pa.array(totals, pa.list_(pa.decimal128(38, 0))), pa.array([v[2] for v in held.values()])]
            yield pa.RecordBatch.from_arrays(columns, ["size", "n", "sums", "furthest"])

    parts = stored(rows.select("x").mapInArrow(add, STATS), "whitening-sums")
    most = parts.groupBy("size").agg(F.sum("n").alias("n"), F.max("furthest").alias("furthest")).orderBy(F.desc("n"), F.desc("size")).first()
    if most is None:
        discard(parts)
        return None
    each = parts.where(F.col("size") == most["size"]).select(F.posexplode("sums").alias("entry", "part")).groupBy("entry").agg(F.sum("part").alias("total"))
    totals = [int(r["total"]) for r in each.orderBy("entry").collect()]
    discard(parts)
    return most["size"], most["n"], totals, most["furthest"]


def centred(x: np.ndarray, n: int, totals: list[int], small: bool) -> np.ndarray:
    """n x - S, exact: 64-bit where ``small`` says that it fits, else Python's whole numbers."""
    return x * n - np.array(totals, np.int64) if small else x.astype(object) * n - np.array(totals, object)


def squares(exact: np.ndarray) -> pa.Array:
    """Each row's sum of squares as decimal(38, 0); null where that does not hold it."""
    size, far = exact.shape[1], int(np.abs(exact).max(initial=0))
    if size * far**2 < 2**63:
        return pa.array((exact * exact).sum(axis=1).astype(np.int64)).cast(pa.decimal128(38, 0))
    if far < 2**52 and size < 2**10:  # in two halves of 26 bits, put together a row at a time
        a = np.abs(exact).astype(np.int64)
        high, low = a >> 26, a & (2**26 - 1)
        parts = [(p * q).sum(axis=1).tolist() for p, q in ((high, high), (high, low), (low, low))]
        totals = [(hh << 52) + (hl << 27) + ll for hh, hl, ll in zip(*parts, strict=True)]
    else:
        totals = [sum(int(c) ** 2 for c in row) for row in exact]
    return pa.array([Decimal(t) if t < 10**38 else None for t in totals], pa.decimal128(38, 0))


def r_factors(rows: DataFrame, size: int, n: int, totals: list[int], small: bool) -> DataFrame:
    """part, r (d x d at most, row by row) of each partition that has rows; in memory are one block and one factor."""

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = np.empty((0, size))
        for b in batches:
            a = centred(matrix(b.column("x"), size), n, totals, small).astype(np.float64) / n
            for i in range(0, len(a), BLOCK):
                r = np.linalg.qr(np.vstack([r, a[i : i + BLOCK]]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()])], ["part", "r"])

    return rows.select("x").mapInArrow(factor, "part long, r binary")


def merged(factors: DataFrame, size: int) -> np.ndarray:
    """The R factor of all rows: FAN factors a task and a round, until one is left."""

    def merge(key, pdf: pd.DataFrame) -> pd.DataFrame:
        stack = np.vstack([np.frombuffer(r, np.float64).reshape(-1, size) for r in pdf.sort_values("part")["r"]])
        return pd.DataFrame({"part": [key[0]], "r": [np.linalg.qr(stack, mode="r").tobytes()]})

    at = stored(factors, "whitening-r")
    while at.count() > 1:
        above = stored(at.groupBy(F.floor(F.col("part") / FAN).alias("above")).applyInPandas(merge, "part long, r binary"), "whitening-r")
        discard(at)
        at = above
    last = np.frombuffer(at.first()["r"], np.float64).reshape(-1, size)
    discard(at)
    return last


def whiten(table: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, n, deviation, whitened (an array, largest eigenvalue first), explained (likewise), identity_error of each fitted row.

    Rows whose vector is null or empty or holds null or non-finite entries are left out, and so are vectors of another
    length than the commonest (of two, the longer). All others are the fit list: repeated rows and null ids stay, each
    for itself. ``deviation`` is a decimal, exact, and null beyond 38 digits. Components of equal eigenvalues come in any order.
    There are min(components, length) of them; where the rows do not vary along one (its singular value is rounding
    noise), its whitened value is null and it takes no part in ``identity_error``, which is null if none does. Other
    columns of the table are not read. An empty table gives no rows.
    """
    spark = table.sparkSession
    rows = table.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(usable(F.col("v"))).select("id", whole_numbers(F.col("v")).alias("x"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, deviation decimal(38,0), whitened array<double>"
    found = sums(rows)
    if found is None:
        return spark.createDataFrame([], f"{schema}, n bigint, explained array<double>, identity_error double")
    size, n, totals, furthest = found
    rows = rows.where(F.size("x") == size)
    reach = n * furthest + max(map(abs, totals))  # no entry of n x - S is larger
    small = reach < 2**63
    r = merged(r_factors(rows, size, n, totals, small), size)
    _, s, vt = np.linalg.svd(r, full_matrices=True)
    s = np.concatenate([s, np.zeros(size - len(s))])
    k = min(components, size)
    varies = s[:k] > max(n, size) * np.finfo(np.float64).eps * s[0]
    share = s[:k] ** 2 / (s**2).sum() if s[0] > 0 else np.zeros(k)
    onto = vt[:k].T / np.where(varies, s[:k] / np.sqrt(n), np.nan)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            exact = centred(matrix(b.column("x"), size), n, totals, small)
            w = exact.astype(np.float64) / n @ onto
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, k), pa.int32()), pa.array(w.ravel(), from_pandas=True))
            yield pa.RecordBatch.from_arrays([b.column("id"), squares(exact), lists], ["id", "deviation", "whitened"])

    white = stored(rows.mapInArrow(project, schema), "whitened")
    kept = [i for i in range(k) if varies[i]]
    w = lambda i: F.get("whitened", F.lit(i))
    pairs = [(i, j) for i in kept for j in kept if i <= j]
    # centred, one pass, partial sums that merge: Spark's population covariance
    found_row = white.agg(*[F.covar_pop(w(i), w(j)).alias(f"c{i}_{j}") for i, j in pairs]).first() if pairs else None
    error = max(abs(found_row[f"c{i}_{j}"] - (i == j)) for i, j in pairs) if pairs else None
    return white.withColumns({"n": F.lit(n).cast("long"), "explained": F.array(*[F.lit(float(e)) for e in share]), "identity_error": F.lit(error).cast("double")})
