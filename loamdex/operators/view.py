"""What a graph view shows: filters, ghosts, tag hubs, caps and degrees counted anew after each stage, for notes and for entities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from loamdex.functions import filters
from loamdex.functions import text as X
from loamdex.operators import graph

#: Fixed value: the group of entities that are in no other; it stands last whatever its size.
OTHER = "Other"
#: Tag hubs that may be shown, and how many are unless asked.
HUBS_MOST, HUBS = 200, 30


@dataclass(frozen=True)
class Options:
    """What is shown. Caps of None are none; the filter is one of the note filter language."""

    filter: str = ""
    nodes: int | None = None
    links: int | None = None
    least_degree: int = 1
    hidden: tuple[str, ...] = ()
    ghosts: bool = True
    orphans: bool = True
    tags: bool = True
    tag_hubs: int = 0

    def __post_init__(self):
        for name in ("nodes", "links"):
            if getattr(self, name) is not None and getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")


@dataclass(frozen=True)
class View:
    nodes: DataFrame
    edges: DataFrame
    #: Counts of all that the filter and the degree allow, hidden groups included, so that these can be shown again.
    legend: DataFrame


def hub_limit(asked: int | None) -> int:
    """How many tag hubs are shown: HUBS unless asked, HUBS_MOST at most, none below 0."""
    return HUBS if asked is None else max(0, min(HUBS_MOST, int(asked)))


def first_links(edges: DataFrame, cap: int | None, order: tuple[str, ...]) -> DataFrame:
    return edges if cap is None else edges.orderBy(*order).limit(cap)


def note_view(files: DataFrame, links: DataFrame, overlays: tuple[DataFrame, ...] = (), options: Options = Options()) -> View:
    """The view of notes: files (path, size, tags), links and overlays (src, dst, n; an overlay's count holds where it is larger).

    In order: the filter takes files; links of all tables are laid over each other; what they point to and no file is
    becomes a ghost; tag hubs are added; the node cap keeps the highest degrees; edges need both ends; the link cap keeps
    those whose weaker end has the highest degree; degrees are those of the edges that are left. Folders are counted
    over all files, whatever the filter takes.
    """
    legend = files.groupBy(X.top_folder("path").alias("name")).agg(F.count("*").alias("n"))
    shown = files.where(filters.matches(options.filter, tags="tags" if options.tags else None))
    laid = graph.overlay(links, *overlays) if overlays else links.select("src", "dst", "n")
    known = files.select(F.col("path").alias("dst"))
    # a link to a file that the filter took away points to nothing: it is no ghost
    gone = known.join(shown.select(F.col("path").alias("dst")), "dst", "left_anti")
    laid = laid.join(gone, "dst", "left_anti")
    if not options.ghosts:
        laid = laid.join(known, "dst", "left_semi")
    nodes, edges = graph.note_graph(shown, laid, hub_limit(options.tag_hubs) if options.tags else 0, options.orphans)
    if options.nodes is not None:
        nodes = nodes.orderBy(F.desc("degree"), "id").limit(options.nodes)
        edges = graph.closed(edges, nodes)
    if options.links is not None:
        edges = graph.capped_links(edges, nodes, options.links).select("src", "dst")
    nodes = graph.recounted(nodes.drop("in_degree", "out_degree"), edges)
    return View(nodes, edges, legend)


def group_of(by: str) -> Column:
    if by not in ("type", "community"):
        raise ValueError("entities are grouped by type or by community")
    return F.col("type") if by == "type" else F.coalesce("community", F.lit(OTHER))


def entity_view(entities: DataFrame, relations: DataFrame, by: str = "type", options: Options = Options()) -> View:
    """The view of entities: entities (id, name, type, community, degree), relations (ord, src, dst).

    In order: entities below the degree, of hidden groups, or whose name the filter does not take, go; the node cap keeps
    the highest degrees, ties to the smaller id; relations need two different ends that are left, and the first of them in
    their order stay under the link cap; degrees are those of the relations that are left, both ends counted. The legend
    is by size, then name, with OTHER last.
    """
    rows = entities.withColumn("group", group_of(by))
    allowed = rows.where((F.col("degree") >= max(1, options.least_degree)) & filters.matches(options.filter, path="name"))
    legend = allowed.groupBy(F.col("group").alias("name")).agg(F.count("*").alias("n")).withColumn("last", F.col("name") == OTHER)
    kept = allowed.where(~F.col("group").isin(*options.hidden)) if options.hidden else allowed
    if options.nodes is not None:
        kept = kept.orderBy(F.desc("degree"), "id").limit(options.nodes)
    edges = graph.closed(relations.where("src <> dst"), kept)
    edges = first_links(edges, options.links, ("ord", "src", "dst"))
    out = F.sum(F.col("out")).alias("out_degree"), F.sum(F.col("in")).alias("in_degree")
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    nodes = kept.drop("degree").join(ends.groupBy("id").agg(*out), "id", "left").fillna(0, ["out_degree", "in_degree"]).withColumn("degree", F.col("out_degree") + F.col("in_degree"))
    return View(nodes, edges, legend)


def ordered_legend(view: View) -> DataFrame:
    """The legend in the order it is shown."""
    return view.legend.orderBy("last", F.desc("n"), "name") if "last" in view.legend.columns else view.legend.orderBy(F.desc("n"), "name")
