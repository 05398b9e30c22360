"""What of a session, a page or a store may go on: calls of programs, injected instructions, tails, masks and ownership."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from loamdex.functions import masking, text as X
from loamdex.operators import transcripts

# How the first prompt of a session opens that a program wrote. The mark is what one's own programs set before
# each prompt; other openings are told by parameter.
MARK = "<!-- pipeline-call:"
OPENINGS = ("You extract a knowledge graph from text", "You are a knowledge-graph curator", "Below are documents distilled separately", "Condense the tool payload below")
HEAD = 1200

# What is injected into a prompt, and paragraphs that nobody wrote.
ENVELOPE = r"(?s)<INSTRUCTIONS>.*?</INSTRUCTIONS>"
HEADING = r"(?md)^\s*#{1,6}[^\n]*$"
PARAGRAPH_OPENINGS = ("<system-reminder>", "<command-name>", "<local-command-", "Caveat: The messages below", "[Request interrupted")
PARAGRAPH_SHAPES = (r"^\s*\|.{0,4}\|.{0,4}\|", r"^\s*(\d+→|\s{4,}\d+\t)", r"^[\s\-=_*#]{40,}$")

# Tools whose results are the words of another agent.
AGENT_TOOLS = ("Task", "Agent")

#: A line of frontmatter that says that a session made the page; what follows a key of a block scalar is no such line.
PROVENANCE = r"(?m)^[ \t]*(?:-[ \t]+)?resource:[ \t]*[\"']?[a-z]+-session://"
SCALAR = r"^[ \t]*[^\s:#][^:]*:[ \t]*[|>][-+0-9]*[ \t]*$"
#: Files that belong to a folder and not to its pages.
INDEX, MANIFEST = "index.md", "manifest.json"

SPACE = " \t\r\n\f\x0b"


def is_pipeline_call(text: str | Column, mark: str = MARK, openings: tuple[str, ...] = OPENINGS) -> Column:
    """Whether a program wrote the first prompt. Only how it opens counts: a talk about such a prompt quotes it further on.

    Null texts are no such call.
    """
    head = F.substring(F.coalesce(X.col(text), F.lit("")), 1, HEAD)
    after = F.instr(head, "**Me**:")
    first = F.ltrim(F.when(after > 0, F.substring(head, after + 7, F.lit(HEAD))).otherwise(head), F.lit(SPACE))
    return reduce(lambda a, b: a | b, [first.startswith(o) for o in (mark, *openings)])


def uninjected(text: str | Column) -> Column:
    """The text without instructions put into it; the headings over them go only where there were any."""
    t = F.coalesce(X.col(text), F.lit(""))
    rest = F.regexp_replace(t, ENVELOPE, "")
    return F.btrim(F.when(t.rlike(ENVELOPE), F.regexp_replace(rest, HEADING, "")).otherwise(rest), F.lit(SPACE))


def paragraphs(text: Column) -> Column:
    """The text without paragraphs that are blank or noise. Unlike is_noise() short ones stay."""

    def written(p: Column) -> Column:
        s = F.btrim(p, F.lit(SPACE))
        noise = [s.startswith(o) for o in PARAGRAPH_OPENINGS] + [s.rlike(shape) for shape in PARAGRAPH_SHAPES]
        return (s != "") & ~reduce(lambda a, b: a | b, noise)

    return F.btrim(F.array_join(F.filter(F.split(text, "\n\n"), written), "\n\n"), F.lit(SPACE))


def assemble_rollout(turns: DataFrame, session: str = "session", order: str = "turn", cutoff=None) -> DataFrame:
    """session, text, n_msg, first_turn, last_turn of turns (role, text) of users and assistants before the cutoff.

    Injected instructions and noise go by paragraph; of turns that are equal but for white space the first stays; no role
    stands before a turn and none is cut. The first of each is a minimum by (session, text), aggregated where it is read.
    Turns without a place go where there is a cutoff, else they come first. A session of which nothing is left has no row.
    """
    said = turns.where(F.col("role").isin("user", "assistant"))
    said = said.where(F.col(order) < cutoff) if cutoff is not None else said
    body = said.select(session, F.col(order).alias("_o"), paragraphs(uninjected("text")).alias("_b")).where("_b <> ''")
    first = body.groupBy(session, F.md5(F.regexp_replace("_b", r"\s+", " ")).alias("_k")).agg(F.min(F.struct("_o", "_b")).alias("_t"))
    joined = first.groupBy(session).agg(F.array_sort(F.collect_list(F.struct("_t._o", "_t._b", "_k"))).alias("_p"), F.count("*").alias("n_msg"), F.min("_t._o").alias("first_turn"), F.max("_t._o").alias("last_turn"))
    return joined.select(session, F.array_join(F.transform("_p", lambda p: p["_b"]), "\n\n").alias("text"), "n_msg", "first_turn", "last_turn")


def spoken(blocks: DataFrame, session: str = "session", tools: tuple[str, ...] = AGENT_TOOLS) -> DataFrame:
    """The blocks (kind, tool, call, text) that are words: texts, and results of calls of other agents.

    The calls are looked up over the whole session, since a call may stand before a boundary and its result after it.
    """
    calls = blocks.where((F.col("kind") == "tool_use") & F.col("tool").isin(*tools) & F.col("call").isNotNull()).select(session, "call").distinct()
    answers = blocks.where("kind = 'tool_result'").join(calls, [session, "call"], "left_semi").select(*blocks.columns)
    return blocks.where("kind = 'text'").unionByName(answers)


def clean_tail(turns: DataFrame, since, through=None, cutoff=None, session: str = "session", order: str = "turn", patterns: list[tuple[str, str]] = masking.PATTERNS) -> DataFrame:
    """session, text, n_msg, last_turn, mask_counts of what was said after ``since``, up to ``through`` and before ``cutoff``.

    Turns are assembled as whole sessions are. last_turn is the last in the range, noise or not. A tail that a program
    began, that holds nothing, or that still leaks after masking has no row: what cannot be made safe goes no further.
    """
    within = F.col(order) > since
    within = within & (F.col(order) <= through) if through is not None else within
    within = within & (F.col(order) < cutoff) if cutoff is not None else within
    turns = turns.where(within)
    last = turns.groupBy(session).agg(F.max(order).alias("last_turn"))
    kept = transcripts.assemble(turns, session, order).where(~is_pipeline_call("text")).select(session, "text", "n_msg")
    safe = masking.masked(kept, patterns=patterns).where(F.size(masking.leaks("text", patterns)) == 0)
    return safe.join(last, session).select(session, "text", "n_msg", "last_turn", "mask_counts")


def remask(store: DataFrame, text: str = "text", patterns: list[tuple[str, str]] = masking.PATTERNS) -> DataFrame:
    """The rows of a store that masking changes, with their new text and mask_counts: what a store is to be merged with.

    A store that was masked already gives no rows, so that nothing of it is written again.
    """
    return masking.masked(store, text, patterns).where(F.size("mask_counts") > 0)


def remask_totals(changed: DataFrame) -> DataFrame:
    """pattern, rows, hits of remask()."""
    each = changed.select(F.explode("mask_counts").alias("pattern", "n"))
    return each.groupBy("pattern").agg(F.count("*").alias("rows"), F.sum("n").cast("long").alias("hits"))


def scalar_free(block: str | Column) -> Column:
    """Frontmatter without the bodies of block scalars: lines deeper than their key, up to a blank one."""
    lines = F.split(X.col(block), "\n")
    start = F.struct(F.lit(-1).alias("skip"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, line: Column) -> Column:
        depth = F.char_length(line) - F.char_length(F.ltrim(line, F.lit(" \t")))
        inside = (s["skip"] >= 0) & (F.btrim(line, F.lit(SPACE)) != "") & (depth > s["skip"])
        skip = F.when(inside, s["skip"]).when(line.rlike(SCALAR), depth).otherwise(-1)
        return F.struct(skip.alias("skip"), F.when(inside, s["out"]).otherwise(F.concat(s["out"], F.array(line))).alias("out"))

    return F.array_join(F.aggregate(lines, start, step, lambda s: s["out"]), "\n")


def ownership(pages: DataFrame, touched: DataFrame, provenance: str = PROVENANCE) -> DataFrame:
    """path, owner (ours, foreign) of files (path, raw) that lie in a touched folder (dir) itself, not deeper.

    Ours are Markdown pages whose frontmatter says that a session made them; they may be replaced. All others are left
    alone. Index pages and manifests are neither. Null texts are foreign.
    """
    name = X.basename("path")
    folder = F.regexp_replace(F.regexp_extract("path", r"^(.*)/[^/]*$", 1), "/+$", "")
    here = pages.withColumns({"dir": folder, "_name": name}).where(~F.col("_name").isin(INDEX, MANIFEST)).join(touched.select(F.regexp_replace("dir", "/+$", "").alias("dir")).distinct(), "dir", "left_semi")
    ours = F.col("_name").endswith(".md") & F.coalesce(scalar_free(X.frontmatter("raw")).rlike(provenance), F.lit(False))
    return here.select("path", F.when(ours, "ours").otherwise("foreign").alias("owner"))
