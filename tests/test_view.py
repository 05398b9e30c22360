"""Composed views, migration of frontmatter, ids by ranges, paths and communities."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loamdex.operators import graph, index, migrate, status, view


# --- migration ---------------------------------------------------------------------------------------
def plain_migrated(raw):
    m = re.match(r"(---[ \t]*\n)(.*?)(\n---[ \t]*\n)", raw or "", re.S)
    if not m:
        return raw
    lines, keys = m.group(2).split("\n"), {}
    for x in lines:
        k = re.match(r"([A-Za-z_][\w-]*):\s*(.*)\Z", x, re.S | re.A)
        if k:
            keys[k.group(1)] = k.group(2).strip()
    out, value = list(lines), keys.get("sources", "")
    items = [x.strip().strip("\"'") for x in value[1:-1].split(",") if x.strip()]
    if re.fullmatch(r"\[.*\]", value, re.S) and items:
        n = max([int(i.group(1)) for x in items if (i := re.match(r"s(\d+):", x))], default=0)
        done = []
        for x in items:
            n += not re.match(r"s(\d+):", x)
            done.append(x if re.match(r"s(\d+):", x) else f"s{n}:{x}")
        at = next(i for i, x in enumerate(lines) if x.startswith("sources:"))
        new = "[" + ", ".join(f'"{x}"' for x in done) + "]"
        out[at] = out[at] if new == value else f"sources: {new}"
    for key, origin in sorted(migrate.ORIGINS.items()):
        if key not in keys and keys.get(origin):
            v = keys[origin]
            out.append(f'{key}: "{v.replace(chr(34), chr(39))}"' if ":" in v or v.startswith(("[", "{", '"')) else f"{key}: {v}")
    return m.group(1) + "\n".join(out) + m.group(3) + raw[m.end() :]


def test_migration_against_plain_and_twice(spark):
    rng = random.Random(3)
    lines = ["title: a", 'sources: ["x", y]', 'sources: ["s2:x", \'z\', s1:q, "w"]', "sources: []", "sources: x", "distilled_by: model: 3", 'distilled_by: "q"', "distilled_by:", "captured: 2024", "generated_at: 1", "generated_by:", "no key", "  captured: in", "é: 1", ""]
    raws = [None, "", "no block", "---\n---\n", "---\ntitle: a\n", "---\n\n---\nbody ---\n---\n", "x\n---\ncaptured: 1\n---\n"]
    raws += ["---\n" + "\n".join(rng.sample(lines, rng.randint(1, 7))) + "\n---\n" + rng.choice(["", "body\n", "sources: [a]\n---\n$1 \\"]) for _ in range(120)]
    notes = spark.createDataFrame([(f"p{i}", r, i) for i, r in enumerate(raws)], "path string, raw string, place int").repartition(3)
    edits = migrate.plan(notes)
    out = migrate.apply(notes, edits).cache()
    assert [r.raw for r in sorted(out.collect(), key=lambda r: r.place)] == [plain_migrated(r) for r in raws]
    assert edits.count() > 50 and migrate.plan(out).count() == 0
    moved = notes.withColumn("raw", F.replace("raw", F.lit("sources: "), F.lit("sources:  ")))  # changed after the plan was made
    kept = migrate.apply(moved, edits.where("old is not null")).join(moved.withColumnRenamed("raw", "was"), "path").where("not raw <=> was")
    assert kept.count() == 0


# --- views ----------------------------------------------------------------------------------------------
def test_options():
    assert [view.hub_limit(x) for x in (None, -4, 0, 7, 10**6)] == [30, 0, 0, 7, 200]
    with pytest.raises(ValueError):
        view.Options(nodes=-1)
    with pytest.raises(ValueError):
        view.group_of("folder")


def files(spark):
    return spark.createDataFrame([("a/x.md", 1, ["t", "u"]), ("a/y.md", 2, ["t"]), ("b/z.md", 3, ["t"]), ("c.md", 4, [])], "path string, size long, tags array<string>")


def test_note_view(spark):
    links = spark.createDataFrame([("a/x.md", "a/y.md", 1), ("a/x.md", "ghost", 2), ("b/z.md", "a/x.md", 1), ("a/y.md", "b/z.md", 1), ("gone.md", "a/x.md", 1)], "src string, dst string, n long")
    over = spark.createDataFrame([("c.md", "a/x.md", 9), ("a/x.md", "a/y.md", 5)], "src string, dst string, n long")
    at = lambda v: ({r.id: r.degree for r in v.nodes.collect()}, {(r.src, r.dst) for r in v.edges.collect()})
    nodes, edges = at(view.note_view(files(spark), links, (over,)))
    assert nodes == {"a/x.md": 4, "a/y.md": 2, "b/z.md": 2, "c.md": 1, "ghost": 1} and ("gone.md", "a/x.md") not in edges and len(edges) == 5
    nodes, edges = at(view.note_view(files(spark), links, (over,), view.Options(filter="-path:b/", ghosts=False, orphans=False)))
    assert nodes == {"a/x.md": 2, "a/y.md": 1, "c.md": 1}  # a filtered note is no ghost
    nodes, edges = at(view.note_view(files(spark), links, (), view.Options(nodes=3, links=2, tag_hubs=1)))
    assert nodes == {"#t": 1, "a/x.md": 2, "a/y.md": 1} and edges == {("a/x.md", "#t"), ("a/x.md", "a/y.md")}
    assert at(view.note_view(files(spark), links, (), view.Options(nodes=0)))[0] == {}
    legend = view.ordered_legend(view.note_view(files(spark), links, (), view.Options(filter="nothing")))
    assert [tuple(r) for r in legend.collect()][0] == ("a", 2)


def test_entity_view(spark):
    e = spark.createDataFrame([(1, "Ada", "actor", "x", 3), (2, "Bob", "actor", None, 2), (3, "Cy", "tool", "x", 2), (4, "Dee", "tool", "y", 1), (5, "Zero", "tool", "y", 0)], "id int, name string, type string, community string, degree int")
    r = spark.createDataFrame([(1, 1, 2), (2, 1, 1), (3, 3, 1), (4, 2, 3), (5, 1, 4), (6, 9, 1)], "ord int, src int, dst int")
    v = view.entity_view(e, r)
    assert {x.id: (x.out_degree, x.in_degree, x.degree) for x in v.nodes.collect()} == {1: (2, 1, 3), 2: (1, 1, 2), 3: (1, 1, 2), 4: (0, 1, 1)}
    assert [tuple(x)[:2] for x in view.ordered_legend(v).collect()] == [("actor", 2), ("tool", 2)]
    v = view.entity_view(e, r, "community", view.Options(hidden=("x",), links=1))
    assert {x.id for x in v.nodes.collect()} == {2, 4} and [tuple(x)[:2] for x in view.ordered_legend(v).collect()] == [("x", 2), ("y", 1), ("Other", 1)]
    v = view.entity_view(e, r, options=view.Options(nodes=2, links=1, filter="-dee"))
    assert {x.id: x.degree for x in v.nodes.collect()} == {1: 1, 2: 1} and [x.ord for x in v.edges.collect()] == [1]


# --- ids, samples, paths, communities -----------------------------------------------------------------------
def test_dense_ids_with_one_lead_and_nulls(spark):
    rows = [(f"Entity {i:05d}", i) for i in range(500)] + [(None, -1)]
    random.Random(1).shuffle(rows)
    out = index.dense_ids(spark.createDataFrame(rows, "k string, v int"), "k", "i").collect()
    assert [r.v for r in sorted(out, key=lambda r: r.i)] == list(range(-1, 500)) and [r.i for r in sorted(out, key=lambda r: r.i)] == list(range(501))
    assert index.dense_ids(spark.createDataFrame([], "k string"), "k", "i").count() == 0


def test_sample_is_spaced_by_value(spark):
    got = sorted(r.n for r in status.systematic_sample(spark.range(1000).select(F.col("id").alias("n")), "n", 10).collect())
    assert got == [99, 199, 299, 399, 499, 599, 699, 799, 899, 999]


def plain_louvain(edges):
    """Modularity of plain Louvain by node order."""
    nodes = {x: i for i, x in enumerate(sorted({n for e in edges for n in e}))}
    level = {}
    for a, b in edges:
        for s, t in ((a, b), (b, a)):
            level[nodes[s], nodes[t]] = level.get((nodes[s], nodes[t]), 0) + 1
    whole = sum(level.values())
    of = list(range(len(nodes)))
    while True:
        n = max(max(k) for k in level) + 1
        near = [{} for _ in range(n)]
        for (s, t), w in level.items():
            near[s][t] = near[s].get(t, 0) + w
        k = [sum(x.values()) for x in near]
        com, tot, moved, any_move = list(range(n)), list(k), True, False
        while moved:
            moved = False
            for v in range(n):
                tot[com[v]] -= k[v]
                to = {}
                for t, w in near[v].items():
                    if t != v:
                        to[com[t]] = to.get(com[t], 0) + w
                best = max([com[v], *sorted(to)], key=lambda c: (to.get(c, 0) - tot[c] * k[v] / whole, c == com[v]))
                moved |= best != com[v]
                com[v] = best
                tot[best] += k[v]
            any_move |= moved
        names = {c: i for i, c in enumerate(sorted(set(com)))}
        of = [names[com[c]] for c in of]
        if len(names) == n:
            break
        nxt = {}
        for (s, t), w in level.items():
            nxt[names[com[s]], names[com[t]]] = nxt.get((names[com[s]], names[com[t]]), 0) + w
        level = nxt
    deg, inside = {}, 0
    for a, b in edges:
        inside += of[nodes[a]] == of[nodes[b]]
        for x in (a, b):
            deg[of[nodes[x]]] = deg.get(of[nodes[x]], 0) + 1
    return inside / len(edges) - sum((d / whole) ** 2 for d in deg.values())


def test_louvain_comes_near_plain(spark):
    rng = random.Random(9)
    pairs = {(a, b) for a in range(80) for b in range(a) if rng.random() < (0.35 if a % 5 == b % 5 else 0.03)}
    edges = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in pairs], "src string, dst string")
    members = graph.communities(edges)
    ours, plain = graph.modularity(edges, members).first()[0], plain_louvain([(f"n{a}", f"n{b}") for a, b in pairs])
    assert ours > plain - 0.05 and members.count() == len({x for p in pairs for x in p})


def test_shortest_path_against_search(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(12)] + [(rng.randrange(40, 70), rng.randrange(40, 70)) for _ in range(40)] + [(3, 8)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def steps(start):
        at, d = {start: 0}, [start]
        for x in d:
            for y in near.get(x, ()):
                if y not in at:
                    at[y] = at[x] + 1
                    d.append(y)
        return at

    for start, end in ((0, 12), (0, 50), (45, 60), (5, 5), (99, 1)):
        path = graph.shortest_path(edges, start, end)
        wanted = steps(start).get(end) if start in near else (0 if start == end else None)
        assert (len(path) - 1 if path else None) == wanted and all(b in near[a] for a, b in zip(path, path[1:]))
