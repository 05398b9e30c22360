"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, shard results merged.

Equal vectors fold into one node with its smallest ids first, so ties and repeated vectors need no room in
the graph. Distinct vectors are dealt to shards by hash, a shard being bounded in bytes; each shard's graph is one
row of flat arrays (vectors, levels, neighbours) in a folder of its own. Queries are a table of numbered blocks in
the shared folder. A task takes one shard and one block, so that no task's work or output grows with the input;
the shards' results merge by the k best of each query, folded before the shuffle.

Graphs hold the vectors in double precision, scaled by a power of two where their squares would leave its range.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from loamdex.session import scratch_path, stored

#: Neighbours of a node on upper layers (twice as many on the ground layer), and beam widths.
M, BUILD_BEAM, SEARCH_BEAM = 12, 48, 96
#: Bytes of the vectors of a shard, on average; there are at least MIN_SHARDS for parallel building.
SHARD_BYTES, MIN_SHARDS = 32 << 20, 8
#: Queries of a block.
BLOCK = 4096
#: Largest components outside this range of binary exponents are scaled into it: their squares could overflow or vanish.
EXPONENTS = (-300, 300)


def exponent_of(X: np.ndarray) -> int:
    """The binary exponent to scale vectors by: 0 unless the largest component lies outside EXPONENTS."""
    e = int(np.frexp(np.abs(X).max(initial=0.0))[1])
    return 0 if EXPONENTS[0] <= e <= EXPONENTS[1] else e


def scaled(X: np.ndarray, exponent: int) -> np.ndarray:
    return np.ldexp(X, -exponent) if exponent else X


def distances(X: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision; those whose squares leave its range are taken of scaled differences."""
    off = X - q
    with np.errstate(over="ignore", under="ignore"):
        d = np.sqrt((off * off).sum(axis=1))
        odd = ~np.isfinite(d) | (d < 1e-140)
        if odd.any():
            e = np.frexp(np.abs(off[odd]).max(axis=1, initial=0.0))[1]
            part = np.ldexp(off[odd], -e[:, None])
            d[odd] = np.ldexp(np.sqrt((part * part).sum(axis=1)), e)
    return d


class Graph:
    """One shard: X (n, d) float64, ground neighbours (n, 2M) int32, -1 padded, and upper layers as (nodes, neighbours) arrays."""

    def __init__(self, X: np.ndarray, m: int = M):
        self.X, self.m = np.ascontiguousarray(X, np.float64), m
        self.norms = (self.X * self.X).sum(axis=1)
        n = len(X)
        self.levels = np.minimum(-np.log(np.random.default_rng(17).random(n) + 1e-12) / np.log(m), 12).astype(np.int32)
        self.layers: list[np.ndarray | dict[int, np.ndarray]] = [np.full((n, 2 * m), -1, np.int32)]
        self.layers += [{int(i): np.full(m, -1, np.int32) for i in np.nonzero(self.levels >= k)[0]} for k in range(1, int(self.levels.max(initial=0)) + 1)]
        self.entry = -1
        self.seen = np.zeros(n, np.int64)
        self.round = 0

    def near(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Squared distances less the query's own squared norm: the same order, one product."""
        return self.norms[rows] - 2 * (self.X[rows] @ q)

    def beam(self, q: np.ndarray, entries: list[tuple[float, int]], width: int, layer: int) -> list[tuple[float, int]]:
        """The ``width`` nearest nodes found on a layer, nearest first."""
        links, self.round = self.layers[layer], self.round + 1
        seen, mark = self.seen, self.round
        open_, best = list(entries), [(-d, i) for d, i in entries]
        heapq.heapify(open_)
        heapq.heapify(best)
        seen[[i for _, i in entries]] = mark
        while open_:
            d, i = heapq.heappop(open_)
            if d > -best[0][0] and len(best) >= width:
                break
            around = links[i]
            around = around[around >= 0]
            around = around[seen[around] != mark]
            if not len(around):
                continue
            seen[around] = mark
            dist = self.near(q, around)
            if len(best) >= width:
                close = dist < -best[0][0]
                around, dist = around[close], dist[close]
            for e, j in zip(dist.tolist(), around.tolist(), strict=True):
                if len(best) < width:
                    heapq.heappush(best, (-e, j))
                elif e < -best[0][0]:
                    heapq.heapreplace(best, (-e, j))
                else:
                    continue
                heapq.heappush(open_, (e, j))
        return sorted((-d, i) for d, i in best)

    def choose(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours that are closer to the new node than to any already chosen; the rest fill up."""
        if len(found) <= most:
            return [i for _, i in found]
        rows = np.array([i for _, i in found])
        V = self.X[rows]
        between = self.norms[rows][:, None] + self.norms[rows][None] - 2 * (V @ V.T)
        own = np.array([d for d, _ in found])
        kept: list[int] = []
        closest = np.full(len(rows), np.inf)
        for k in range(len(rows)):
            if own[k] < closest[k]:
                kept.append(k)
                if len(kept) == most:
                    break
                np.minimum(closest, between[k], out=closest)
        for k in range(len(rows)):
            if len(kept) == most:
                break
            if k not in kept:
                kept.append(k)
        return rows[kept].tolist()

    def insert(self, i: int) -> None:
        if self.entry < 0:
            self.entry = i
            return
        q, norm, top = self.X[i], float(self.norms[i]), int(self.levels[self.entry])
        at = [(float(self.near(q, np.array([self.entry]))[0]), self.entry)]
        for layer in range(top, int(self.levels[i]), -1):
            at = self.beam(q, at, 1, layer)
        for layer in range(min(top, int(self.levels[i])), -1, -1):
            at = self.beam(q, at, BUILD_BEAM, layer)
            most = self.m
            picked = self.choose([(d + norm, j) for d, j in at], most)
            links = self.layers[layer]
            links[i][: len(picked)] = picked
            for j in picked:
                row = links[j]
                free = np.nonzero(row < 0)[0]
                if len(free):
                    row[free[0]] = i
                    continue
                others = np.append(row, i)
                d = self.near(self.X[j], others) + self.norms[j]
                kept = self.choose(sorted(zip(d.tolist(), others.tolist(), strict=True)), len(row))
                row[:] = -1
                row[: len(kept)] = kept
        if self.levels[i] > top:
            self.entry = i

    def build(self) -> Graph:
        for i in range(len(self.X)):
            self.insert(i)
        return self

    def search(self, q: np.ndarray, width: int) -> list[int]:
        if self.entry < 0:
            return []
        at = [(float(self.near(q, np.array([self.entry]))[0]), self.entry)]
        for layer in range(int(self.levels[self.entry]), 0, -1):
            at = self.beam(q, at, 1, layer)
        return [i for _, i in self.beam(q, at, width, 0)]

    def flat(self) -> dict[str, bytes | int]:
        """The arrays of the graph, but its vectors, as bytes: ground neighbours, then (layer, node, neighbours) rows of the upper layers."""
        upper = [np.concatenate([[k, i], row]) for k, layer in enumerate(self.layers[1:], 1) for i, row in layer.items()]
        return {
            "n": len(self.X), "dim": self.X.shape[1], "entry": self.entry, "levels": self.levels.tobytes(),
            "ground": self.layers[0].tobytes(), "upper": (np.array(upper, np.int32) if upper else np.empty((0, 2 + self.m), np.int32)).tobytes(),
        }

    @classmethod
    def of(cls, row, m: int = M) -> Graph:
        g = cls.__new__(cls)
        g.m, g.entry = m, int(row["entry"])
        g.X = scaled(np.frombuffer(row["vectors"], np.float64).reshape(int(row["n"]), int(row["dim"])), int(row["exponent"]))
        g.norms = (g.X * g.X).sum(axis=1)
        g.levels = np.frombuffer(row["levels"], np.int32)
        g.layers = [np.frombuffer(row["ground"], np.int32).reshape(-1, 2 * m)]
        g.layers += [{} for _ in range(int(g.levels.max(initial=0)))]
        for k, i, *around in np.frombuffer(row["upper"], np.int32).reshape(-1, 2 + m):
            g.layers[k][int(i)] = np.array(around, np.int32)
        g.seen, g.round = np.zeros(len(g.X), np.int64), 0
        return g


def usable(vector: str | Column) -> Column:
    """Neither null nor empty nor zero, and no component null or not finite."""
    v = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def nodes(table: DataFrame, id_col: str, vector_col: str, ids_kept: int) -> DataFrame:
    """vector, ids (the ``ids_kept`` smallest of the rows with that vector) of each distinct usable vector."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(usable("vector") & F.col("id").isNotNull()).distinct()
    # two steps, so that a vector that very many rows share is folded in parts
    part = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    place = F.row_number().over(Window.partitionBy("vector", "salt").orderBy("id"))
    short = part.withColumn("place", place).where(F.col("place") <= ids_kept)
    return short.groupBy("vector").agg(F.slice(F.array_sort(F.collect_list("id")), 1, ids_kept).alias("ids"))


GRAPH = "shard int, dim int, n int, entry int, exponent int, vectors binary, levels binary, ground binary, upper binary, ids array<array<bigint>>"


def build_index(folded: DataFrame, shard_bytes: int = SHARD_BYTES, min_shards: int = MIN_SHARDS) -> tuple[DataFrame, str]:
    """A row per (shard, dim) with the graph's flat arrays, vectors and ids, and the shared folder it is stored in, by shard and dim."""
    cells = folded.agg(F.sum(F.size("vector"))).first()[0] or 0
    shards = max(min_shards, -(-8 * cells // shard_bytes))
    spark = folded.sparkSession
    fields = [f.split()[0] for f in GRAPH.split(", ")]

    def make(key, pdf: pd.DataFrame) -> pd.DataFrame:
        exact = np.stack(pdf["vector"].to_numpy()).astype(np.float64)
        exponent = exponent_of(exact)
        flat = Graph(scaled(exact, exponent)).build().flat()
        return pd.DataFrame([{"shard": key[0], **flat, "exponent": exponent, "vectors": exact.tobytes(), "ids": [list(map(int, x)) for x in pdf["ids"]]}])[fields]

    dealt = folded.withColumns({"shard": F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int"), "dim": F.size("vector")})
    path = scratch_path(spark, "hnsw")
    # by number, not by hash: one shard a task
    dealt.repartitionById(shards, F.col("shard")).groupBy("shard", "dim").applyInPandas(make, GRAPH).write.partitionBy("shard", "dim").parquet(path)
    return spark.read.schema(GRAPH).parquet(path), path


def search(index: DataFrame, index_path: str, queries_path: str, k: int, beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, vec_id, score: each shard's ``k`` nearest rows of every query (id, vector) of the blocks stored at a path.

    A query's own id is no candidate. Distances are Euclidean, in double precision, on the vectors as given.
    """
    from loamdex.llm.warc import open_fs

    spark = index.sparkSession
    blocks = spark.read.parquet(queries_path).select("block", "dim").distinct()
    tasks = stored(index.select("shard", "dim").join(blocks, "dim"), "hnsw-tasks")  # of equal length only; both sides are short lists
    n = tasks.count()
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds

        fs, queries_at = open_fs(queries_path)
        _, index_at = open_fs(index_path)
        held, g, exact, ids = None, None, None, None
        for b in batches:
            for shard, dim, block in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if held != (shard, dim):
                    row = ds.dataset(f"{index_at}/shard={shard}/dim={dim}", filesystem=fs, format="parquet").to_table().to_pylist()[0] | {"dim": dim}
                    g, exact, ids = Graph.of(row), np.frombuffer(row["vectors"], np.float64).reshape(row["n"], dim), row["ids"]
                    held = (shard, dim)
                asked = ds.dataset(f"{queries_at}/block={block}/dim={dim}", filesystem=fs, format="parquet").to_table(columns=["id", "vector"])
                out: list[tuple] = []
                for own, v in zip(asked.column(0).to_pylist(), asked.column(1).to_pylist(), strict=True):
                    q = np.array(v, np.float64)
                    found = np.array(g.search(scaled(q, int(row["exponent"])), max(beam, k + 1)), np.int64)
                    out += [(own, i, e) for e, i in sorted((float(e), i) for e, n in zip(distances(exact[found], q), found, strict=True) for i in ids[n] if i != own)[:k]]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    dealt = tasks.withColumn("place", F.row_number().over(Window.partitionBy("dim").orderBy("shard", "block")))  # a row a task
    parts = max(1, min(n, 4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    each = dealt.repartitionById(parts, F.pmod(F.col("place"), F.lit(parts)).cast("int")).select("shard", "dim", "block")
    return each.mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(table: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k nearest rows found; ties go to the smaller vec_id.

    Unusable vectors (see usable()) and null ids take no part on either side; vectors of another length than
    the query's are no candidates. Exactly repeated rows count once. An id with several vectors may be found
    at each. Empty tables give no rows.
    """
    spark = table.sparkSession
    index, index_path = build_index(nodes(table, id_col, vector_col, k + 1))
    path = scratch_path(spark, "hnsw-queries")
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(usable("vector") & F.col("id").isNotNull()).distinct()
    asked = stored(asked, "hnsw-asked")
    blocks = max(1, -(-asked.count() // BLOCK))
    asked.withColumns({"block": F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), "dim": F.size("vector")}).repartition("block", "dim").write.partitionBy("block", "dim").parquet(path)
    if asked.isEmpty() or index.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = search(index, index_path, path, k)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
