"""Graph operators over vertex and edge DataFrames."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from loamdex import schema as S
from loamdex.session import discard, settled, stored


def doubled(edges: DataFrame) -> DataFrame:
    """Each edge in both directions."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def degrees(edges: DataFrame) -> DataFrame:
    """id, out_degree, in_degree, degree."""
    rows = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return rows.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.count("*").alias("degree"))


def adjacency(edges: DataFrame) -> DataFrame:
    """id, neighbours sorted."""
    return doubled(edges).groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("neighbours")).withColumnRenamed("src", "id")


def within(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """id, depth of all nodes at most ``depth`` steps from the roots (id): a frontier join and an anti-join a step."""
    both = doubled(edges)
    seen = roots.select("id").distinct().withColumn("depth", F.lit(0))
    front = seen
    for step in range(1, depth + 1):
        front = front.join(both, front["id"] == both["src"]).select(F.col("dst").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(step))
        if step % 4 == 0:
            front, seen = settled(front), settled(seen)
        seen = seen.unionByName(front)
    return seen


def shortest_path(edges: DataFrame, start, end) -> list:
    """Node ids of a shortest path, the first by node order among equals; [start] for the same node, [] if there is none.

    Breadth first: each step keeps, for a newly reached node, the smallest parent of the front, as a table of its own, and
    whether the end is among them comes to the driver. The path is then walked back by one chain of joins over the
    steps, a row each. The search ends when nothing new is reached.
    """
    if start == end:
        return [start]
    kind = edges.schema["src"].dataType
    both = stored(doubled(edges).distinct(), "path-edges")
    first = edges.sparkSession.range(1).select(F.lit(start).cast(kind).alias("id"), F.lit(None).cast(kind).alias("parent"))
    fronts = [stored(first, "path-front")]
    found = False
    while not found:
        reached = fronts[-1].select(F.col("id").alias("src")).join(both, "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        for seen in fronts[-2:]:  # an undirected step leads to the front before, the same front, or on
            reached = reached.join(seen.select("id"), "id", "left_anti")
        fronts.append(stored(reached, "path-front"))
        state = fronts[-1].agg(F.count("*").alias("n"), F.bool_or(F.col("id") == F.lit(end)).alias("found")).first()
        if not state["n"]:
            discard(both, *fronts)
            return []
        found = state["found"]
    path = fronts[-1].where(F.col("id") == F.lit(end)).select(F.array("id", "parent").alias("path"), F.col("parent").alias("at"))
    for front in reversed(fronts[1:-1]):
        up = front.select(F.col("id").alias("at"), "parent")
        path = up.join(F.broadcast(path), "at").select(F.concat("path", F.array("parent")).alias("path"), F.col("parent").alias("at"))  # path is one row
    out = path.first()["path"][::-1]
    discard(both, *fronts)
    return out


def closed(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes (id)."""
    n = nodes.select("id").distinct()
    return edges.join(n.select(F.col("id").alias("src")), "src", "left_semi").join(n.select(F.col("id").alias("dst")), "dst", "left_semi")


def subgraph(nodes: DataFrame, edges: DataFrame, least_degree: int = 0, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, degree) of a degree, the highest first where limited, and the edges between them."""
    kept = nodes.where(F.col("degree") >= least_degree)
    kept = kept.orderBy(F.desc("degree"), "id").limit(limit) if limit else kept
    return kept, closed(edges, kept)


def capped_links(edges: DataFrame, nodes: DataFrame, cap: int) -> DataFrame:
    """The links whose weaker end has the highest degree, ties by ends."""
    d = nodes.select("id", "degree")
    j = edges.join(d.select(F.col("id").alias("src"), F.col("degree").alias("_s")), "src").join(d.select(F.col("id").alias("dst"), F.col("degree").alias("_d")), "dst")
    return j.withColumn("weaker", F.least("_s", "_d")).drop("_s", "_d").orderBy(F.desc("weaker"), "src", "dst").limit(cap)


def recounted(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with the degree they have on the kept edges."""
    return nodes.drop("degree").join(degrees(edges).select("id", "degree"), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def note_graph(files: DataFrame, links: DataFrame, tag_hubs: int = 0, orphans: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, unresolved, tag, size, in_degree, out_degree, degree) and edges of notes.

    files: path, size, tags. links: src, dst, n. Targets that are no file become ghosts; the most used tags
    become hubs where asked; notes without an edge go unless orphans stay.
    """
    known = files.select(F.col("path").alias("dst"))
    real = links.join(files.select(F.col("path").alias("src")), "src", "left_semi")
    ghosts = real.join(known, "dst", "left_anti").select(F.col("dst").alias("id")).distinct()
    edges = real.select("src", "dst")
    parts = [files.select(F.col("path").alias("id"), F.lit(False).alias("unresolved"), F.lit(False).alias("tag"), "size"), ghosts.select("id", F.lit(True).alias("unresolved"), F.lit(False).alias("tag"), F.lit(0).cast("long").alias("size"))]
    if tag_hubs:
        used = files.select("path", F.explode(F.array_distinct("tags")).alias("t"))
        hubs = used.groupBy("t").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "t").limit(tag_hubs)
        parts.append(hubs.select(F.concat(F.lit("#"), "t").alias("id"), F.lit(False).alias("unresolved"), F.lit(True).alias("tag"), F.lit(0).cast("long").alias("size")))
        edges = edges.unionByName(used.join(F.broadcast(hubs), "t").select(F.col("path").alias("src"), F.concat(F.lit("#"), "t").alias("dst")))
    nodes = parts[0]
    for p in parts[1:]:
        nodes = nodes.unionByName(p)
    nodes = nodes.join(degrees(edges), "id", "left").fillna(0, ["out_degree", "in_degree", "degree"])
    return nodes if orphans else nodes.where("degree > 0"), edges


def tag_counts(files: DataFrame, n: int, active: str | None = None) -> DataFrame:
    """tag, n: notes of each tag (once a note), the n most used and the active one."""
    counts = files.select(F.explode(F.array_distinct("tags")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    first = counts.orderBy(F.desc("n"), "tag").limit(n)
    return first if active is None else first.unionByName(counts.where(F.col("tag") == active).join(first.select("tag"), "tag", "left_anti"))


def tag_focus(files: DataFrame, edges: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
    nodes = files.where(F.array_contains("tags", tag)).select(F.col("path").alias("id"))
    return nodes, closed(edges, nodes)


def ghost_edges(suggested: DataFrame, nodes: DataFrame) -> DataFrame:
    """src, dst, score of suggestions: no loops, both ends known, score in 0..1 (half if missing), deferred ones at 0.6 of it."""
    s = F.least(F.greatest(F.coalesce("score", F.lit(0.5)), F.lit(0.0)), F.lit(1.0))
    rows = suggested.where("src <> dst").withColumn("score", F.when(F.coalesce("deferred", F.lit(False)), s * 0.6).otherwise(s))
    return closed(rows.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "score"), nodes)


def overlay(*tables: DataFrame) -> DataFrame:
    """src, dst, n: the largest count of any table."""
    out = tables[0].select("src", "dst", "n")
    for t in tables[1:]:
        out = out.unionByName(t.select("src", "dst", "n"))
    return out.groupBy("src", "dst").agg(F.max("n").alias("n"))


# --- communities ---------------------------------------------------------------------------------
def communities(edges: DataFrame, least_gain: float = 1e-6) -> DataFrame:
    """id, community: Louvain over DataFrames, the same method at every size.

    Each round every node sees the gain in modularity of joining each neighbouring community, and half of those that
    would gain move (the half changes by hash, so that two nodes do not swap for ever). Rounds go on while modularity
    rises by ``least_gain``; then communities become the nodes of the next level, until a level merges nothing. A round
    shuffles edges twice and is written to the shared folder, from where the round before it is deleted; only its
    modularity comes to the driver. Joins are merged: tables that are broadcast would pass the driver in every round. A community is named after its smallest node.
    """
    both = doubled(edges).where("src is not null and dst is not null")
    now = stored(both.groupBy("src", "dst").agg(F.sum(F.lit(1.0)).alias("w")), "louvain-edges")
    label = stored(now.select(F.col("src").alias("id")).distinct().withColumn("community", F.col("id")), "louvain-label")
    whole = now.agg(F.sum("w")).first()[0]
    while whole:
        mass = now.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k"))
        moved = _moves(now, mass, whole, least_gain)
        names = moved.groupBy("community").agg(F.min("id").alias("name"))
        found = stored(moved.join(names.hint("merge"), "community").select("id", F.col("name").alias("community")), "louvain-found")
        size = found.agg(F.count("*").alias("n"), F.countDistinct("community").alias("left")).first()
        before, label = label, stored(label.join(found.select(F.col("id").alias("community"), F.col("community").alias("_to")).hint("merge"), "community").select("id", F.col("_to").alias("community")), "louvain-label")
        discard(before, moved)
        if size["left"] == size["n"]:
            discard(now, found)
            break
        ends = now.join(found.select(F.col("id").alias("src"), F.col("community").alias("a")).hint("merge"), "src").join(found.select(F.col("id").alias("dst"), F.col("community").alias("b")).hint("merge"), "dst")
        before, now = now, stored(ends.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")), "louvain-edges")
        discard(before, found)
    return label


def _moves(now: DataFrame, mass: DataFrame, whole: float, least_gain: float) -> DataFrame:
    """id, community after the local moves of one level. now: src, dst, w in both directions; mass: id, k."""
    own = stored(mass.select("id", "k", F.col("id").alias("community")), "louvain-own")
    best, kept, quiet = None, own, 0
    for turn in itertools.count():
        tot = own.groupBy("community").agg(F.sum("k").alias("t"))
        near = now.join(own.select(F.col("id").alias("dst"), F.col("community").alias("c")).hint("merge"), "dst").groupBy(F.col("src").alias("id"), "c").agg(F.sum("w").alias("w"), F.sum(F.when(F.col("src") == F.col("dst"), F.col("w")).otherwise(0.0)).alias("loop"))
        mine = own.join(tot.withColumnRenamed("t", "own_t").hint("merge"), "community")
        seen = stored(near.join(tot.select(F.col("community").alias("c"), "t").hint("merge"), "c").join(mine.hint("merge"), "id"), "louvain-seen")
        stay = F.col("c") == F.col("community")
        score = (seen.agg(F.sum(F.when(stay, F.col("w") / whole))).first()[0] or 0.0) - (tot.agg(F.sum((F.col("t") / whole) ** 2)).first()[0] or 0.0)
        if best is None or score > best + least_gain:
            if kept is not own:
                discard(kept)
            best, kept, quiet = score, own, 0
        else:
            quiet += 1
            if quiet == 2:  # either half had its turn
                discard(own, seen)
                return kept
        gain = F.col("w") - F.when(stay, F.col("loop")).otherwise(0.0) - F.col("k") * (F.col("t") - F.when(stay, F.col("k")).otherwise(0.0)) / whole
        choice = seen.withColumn("g", gain).groupBy("id", "k", "community", "own_t").agg(F.max(F.when(stay, F.col("g"))).alias("g0"), F.max("g").alias("g1"), F.min_by("c", F.struct((-F.col("g")).alias("g"), "c")).alias("to"))
        staying = F.coalesce("g0", -F.col("k") * (F.col("own_t") - F.col("k")) / whole)
        turns = F.pmod(F.xxhash64("id", F.lit(turn // 2)), F.lit(2)) == turn % 2
        before, own = own, stored(choice.select("id", "k", F.when((F.col("g1") > staying + 1e-12) & turns, F.col("to")).otherwise(F.col("community")).alias("community")), "louvain-own")
        discard(*([seen] if before is kept else [seen, before]))


def ranked_communities(members: DataFrame, least: int = S.MIN_COMMUNITY, top: int = S.TOP_COMMUNITIES) -> DataFrame:
    """id, community: numbers from 0 by size (ties by smallest member) for the largest of ``least`` members, else -1."""
    size = members.groupBy("community").agg(F.count("*").alias("n"), F.min("id").alias("first")).where(F.col("n") >= least)
    rank = size.orderBy(F.desc("n"), "first").limit(top).withColumn("_rank", F.row_number().over(Window.orderBy(F.desc("n"), "first")) - 1)  # top rows
    return members.join(F.broadcast(rank.select("community", "_rank")), "community", "left").select("id", F.coalesce("_rank", F.lit(-1)).alias("community"))


def modularity(edges: DataFrame, members: DataFrame) -> DataFrame:
    """One row: modularity of the communities (id, community) on undirected edges."""
    m = members.select("id", "community")
    j = edges.join(m.select(F.col("id").alias("src"), F.col("community").alias("a")), "src").join(m.select(F.col("id").alias("dst"), F.col("community").alias("b")), "dst")
    inside = j.where("a = b").groupBy(F.col("a").alias("community")).agg(F.count("*").alias("inner"))
    mass = degrees(edges).join(m, "id").groupBy("community").agg(F.sum("degree").alias("deg"))
    total = edges.agg(F.count("*").alias("m"))
    parts = mass.join(inside, "community", "left").crossJoin(F.broadcast(total))
    return parts.agg(F.sum(F.coalesce("inner", F.lit(0)) / F.col("m") - (F.col("deg") / (2.0 * F.col("m"))) ** 2).alias("modularity"))


# --- layout --------------------------------------------------------------------------------------
def spring_layout(n: int, src: np.ndarray, dst: np.ndarray, rounds: int = 60, seed: int = 7, sample: int = 64) -> np.ndarray:
    """(n, 3) places within 100 of the origin: springs on edges, repulsion from a sample of nodes, cooling."""
    rng = np.random.default_rng(seed)
    at = rng.normal(0, 10, (n, 3))
    for r in range(rounds):
        force = np.zeros_like(at)
        if len(src):
            d = at[dst] - at[src]
            np.add.at(force, src, 0.05 * d)
            np.add.at(force, dst, -0.05 * d)
        others = rng.integers(0, n, (n, min(n, sample)))
        gap = at[:, None] - at[others]
        near = np.maximum((gap**2).sum(axis=2, keepdims=True), 1e-3)
        force += 30.0 * (gap / near).mean(axis=1)
        size = np.maximum(np.linalg.norm(force, axis=1, keepdims=True), 1e-9)
        at += force / size * np.minimum(size, 5.0 * (1 - r / rounds))
    spread = np.abs(at).max()
    return at / spread * 100 if spread else at


def layout(edges: DataFrame, seed: int = 7) -> DataFrame:
    """id, x, y, z of a graph that fits a task (exports cut it first)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, at = np.unique(np.concatenate([pdf["src"].to_numpy(), pdf["dst"].to_numpy()]), return_inverse=True)
        xyz = spring_layout(len(ids), at[: len(pdf)], at[len(pdf) :], seed=seed)
        return pd.DataFrame({"id": ids, "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]})

    kind = edges.schema["src"].dataType.simpleString()
    return edges.select("src", "dst").orderBy("src", "dst").withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(one, f"id {kind}, x double, y double, z double")


def fnv1a(text: str) -> Column:
    """The 32-bit FNV-1a hash of a text's UTF-16 code units below 65536, as a long."""
    units = F.transform(F.filter(F.split(F.col(text), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    step = lambda h, u: F.pmod(h.bitwiseXOR(u) * F.lit(16777619), F.lit(1 << 32))
    return F.aggregate(units, F.lit(2166136261).cast("long"), step)


def seed_place(node: str) -> Column:
    """x, y, z of a node's hash on the unit sphere."""
    h = fnv1a(node)
    u = F.pmod(h, F.lit(1 << 16)) / float(1 << 16)
    v = F.shiftrightunsigned(h, 16) / float(1 << 16)
    z, a = 2 * u - 1, 2 * np.pi * v
    r = F.sqrt(F.greatest(F.lit(0.0), 1 - z * z))
    return F.struct((r * F.cos(a)).alias("x"), (r * F.sin(a)).alias("y"), z.alias("z"))


def carried_places(nodes: DataFrame, previous: DataFrame) -> DataFrame:
    """Nodes with their earlier place (id, x, y, z), or that of their hash."""
    j = nodes.join(previous.select("id", F.struct("x", "y", "z").alias("_old")), "id", "left")
    return j.withColumn("_at", F.coalesce("_old", seed_place("id"))).select(*nodes.columns, "_at.x", "_at.y", "_at.z")


def fit_radius(places: DataFrame, weight: str = "degree", share: float = 0.95) -> DataFrame:
    """One row: weighted centre and the radius that holds ``share`` of the nodes."""
    w = F.greatest(F.col(weight), F.lit(1))
    c = places.agg(*[(F.sum(F.col(a) * w) / F.sum(w)).alias(f"c{a}") for a in "xyz"])
    d = places.crossJoin(F.broadcast(c)).withColumn("_d", F.sqrt(sum((F.col(a) - F.col(f"c{a}")) ** 2 for a in "xyz")))
    return d.agg(F.first("cx").alias("cx"), F.first("cy").alias("cy"), F.first("cz").alias("cz"), F.percentile_approx("_d", share, 10000).alias("radius"))
