"""Secret scans over a trigram inverted index, with DataFrame functions only.

Each rule's regular expression is read into a Boolean trigram query: an OR of clauses, a clause being the
trigrams that every match of one of its alternatives contains. Postings (trigram, doc_id) of the queried
trigrams are cut from the folded texts; a clause's postings are intersected by a bit per trigram; the
candidates are verified by the expression itself. A rule without mandatory trigrams scans every text.
"""

from __future__ import annotations

import re
import re._constants as sre
from dataclasses import dataclass
from re import _parser

from pyspark.sql import Column, DataFrame, functions as F

from loamdex.session import stored

#: Candidate rows up to which their list is broadcast; longer lists are joined by a shuffle.
BROADCAST_ROWS = 500_000
MOST_ALTERNATIVES = 512
#: Matches whose places are summed up at a time.
BLOCK = 256


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has ``least`` characters or more. ``scan`` may be a faster equal of the pattern."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    ignore_case: bool = False
    scan: str | None = None

    @property
    def java(self) -> str:
        return ("(?i)" if self.ignore_case else "") + (self.scan or self.pattern)


# The three base rules, in order. A run's leftmost match is the whole run, so a lower bound
# inside the expression finds the same spans as dropping short matches.
BASE = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, scan=r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]+", 0, 32, scan=r"[0-9a-f]{32,}"),
]
PEM = r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[\s\S]*?(?:-----END [A-Z ]{0,20}PRIVATE KEY-----|"
# Public formats of further credentials.
MORE = [
    # the whole block; without an END marker, to the end of the text
    Rule("private_key", PEM + r"\Z)", scan=PEM + r"\z)"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
]
RULES = BASE + MORE


# --- trigram queries -----------------------------------------------------------------------------
GAP = None


def _alternatives(items) -> list[tuple]:
    """All strings of letters and gaps that a parsed expression can stand for; a gap stands for anything."""
    out: list[tuple] = [()]
    for op, arg in items:
        if op is sre.LITERAL:
            step = [(chr(arg),)]
        elif op is sre.IN:
            ends = [(a, a) if o is sre.LITERAL else a for o, a in arg if o in (sre.LITERAL, sre.RANGE)]
            chars = {c for lo, hi in ends for c in range(lo, min(hi, lo + 9) + 1)}
            step = [(chr(c),) for c in sorted(chars)] if len(ends) == len(arg) and len(chars) <= 8 else [(GAP,)]
        elif op is sre.SUBPATTERN:
            step = _alternatives(arg[3])
        elif op is sre.BRANCH:
            step = [a for branch in arg[1] for a in _alternatives(branch)]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, inner = arg
            if (low, high) == (0, 1):
                step = [(), *_alternatives(inner)]
            else:
                step = [()]
                for _ in range(min(low, 8)):
                    step = [a + b for a in step for b in _alternatives(inner)]
                    if len(step) > MOST_ALTERNATIVES:
                        step = [(GAP,)]
                        break
                step = step if low == high <= 8 else [(*a, GAP) for a in step]
        else:
            step = [(GAP,)] if op is not sre.AT else [()]
        if len(out) * len(step) > MOST_ALTERNATIVES:
            step = [(GAP,)]
        out = [a + b for a in out for b in step]
    return out


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Clauses of folded trigrams of which one must be in a text that matches; None where a match needs no trigram."""
    clauses = set()
    for alternative in _alternatives(_parser.parse(pattern)):
        runs = "".join("\0" if c is GAP else c for c in alternative).lower().split("\0")
        grams = frozenset(r[i : i + 3] for r in runs for i in range(len(r) - 2))
        if not grams:
            return None
        clauses.add(grams)
    return sorted((c for c in clauses if not any(o < c for o in clauses)), key=sorted)


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """trigram, doc_id: the index of the given trigrams over whole folded texts. Rows with null ids are left out."""
    folded = docs.select("doc_id", F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("folded")).where("doc_id is not null")
    present = F.array(*[F.when(F.contains("folded", F.lit(t)), F.lit(t)) for t in trigrams])
    return folded.select("doc_id", F.explode(F.array_compact(present)).alias("trigram"))


def candidates(index: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, rules: a bit for each rule of which some clause has all its trigrams in the document."""
    rows = [(t, r, c, 1 << i, (1 << len(clause)) - 1) for r, rule in enumerate(rules) for c, clause in enumerate(trigram_query(rule.pattern) or []) for i, t in enumerate(sorted(clause))]
    names = ("trigram", "rule", "clause", "bit", "whole")
    wanted = index.sparkSession.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in rows])))  # a row per trigram of a rule
    met = index.join(F.broadcast(wanted), "trigram").groupBy("doc_id", "rule", "clause").agg(F.bit_or("bit").alias("bits"), F.max("whole").alias("whole")).where("bits = whole")
    return met.groupBy("doc_id").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("rules"))


# --- verification --------------------------------------------------------------------------------
def _spans(rule: Rule, number: int, flag: Column) -> dict[str, Column]:
    """Columns that lead to the spans of one rule: matches, lengths between them, spans. Each stands in a step of its own."""
    none = F.array().cast("array<string>")
    m, g, p, b = f"_m{number}", f"_g{number}", f"_p{number}", f"_b{number}"
    java = F.lit(rule.java)
    steps = {m: F.when(flag, F.regexp_extract_all("_text", java, 0)).otherwise(none)}
    steps[g] = F.when(F.size(m) > 0, F.regexp_extract_all("_text", java, rule.group)).otherwise(none) if rule.group else F.col(m)
    steps[p] = F.when(F.size(m) > 0, F.split("_text", rule.java, -1)).otherwise(none)
    i = f"_i{number}"
    steps[i] = F.expr(f"""zip_with(zip_with({m}, {g}, (a, b) -> named_struct('n', char_length(a), 'v', char_length(b))), slice({p}, 1, size({m})),
        (a, b) -> named_struct('gap', char_length(b), 'n', a.n, 'v', a.v))""")
    steps[b] = F.expr(f"if(size({i}) = 0, array(), transform(sequence(0, (size({i}) - 1) div {BLOCK}), k -> slice({i}, k * {BLOCK} + 1, {BLOCK})))")
    # places are running sums: of whole blocks first, then inside each block, so that very many matches cost little more than few
    place = "array<struct<start:int, number:int, end:int, v:int>>"
    walk = f"""
        filter(flatten(zip_with({b}, aggregate({b},
            named_struct('at', 0, 'out', cast(array() as array<int>)),
            (s, x) -> named_struct('at', s.at + aggregate(x, 0, (n, y) -> n + y.gap + y.n), 'out', concat(s.out, array(s.at)))).out,
            (x, at) -> aggregate(x, named_struct('at', at, 'out', cast(array() as {place})),
                (s, y) -> named_struct('at', s.at + y.gap + y.n, 'out', concat(s.out, array(named_struct('start', s.at + y.gap, 'number', {number}, 'end', s.at + y.gap + y.n, 'v', y.v))))).out
        )), x -> x.v >= {rule.least})"""
    steps[f"_s{number}"] = F.when(F.size(m) > 0, F.expr(walk)).otherwise(F.array().cast("array<struct<start:int, number:int, end:int, v:int>>"))
    return steps


def scan(docs: DataFrame, rules: list[Rule] = RULES, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The kept columns (doc_id) and ``spans``: array of (start, number, end, v) by start, then rule number.

    Positions are code points, the end is exclusive, ``v`` is the length of the rule's group. Null texts are
    empty, very long ones are scanned whole. Rows with null ids are not in the index and are scanned by every rule.
    Repeated rows are repeated; an empty table gives no rows. Kept columns may have any name but ``spans``.
    """
    keep = keep or ["doc_id"]
    return _scanned(docs, rules, text_col).select(*[F.col("_row")[c].alias(c) for c in keep], "spans")


def _scanned(docs: DataFrame, rules: list[Rule], text_col: str) -> DataFrame:
    """_row (the whole row) and spans."""
    queries = [trigram_query(r.pattern) for r in rules]
    vocabulary = sorted({t for q in queries for c in q or [] for t in c})
    full = sum(1 << i for i, q in enumerate(queries) if q is None)
    all_rules = (1 << len(rules)) - 1
    source = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    if vocabulary:
        index = postings(docs.select("doc_id", F.col(text_col).alias("text")), vocabulary)
        found = stored(candidates(index, rules), "secret-candidates").select(F.col("doc_id").alias("_found"), F.col("rules").alias("_rules"))
        small = found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        source = source.join(F.broadcast(found) if small else found, F.col("_id") == F.col("_found"), "left").drop("_found")
    else:
        source = source.withColumn("_rules", F.lit(None).cast("long"))
    out = source.withColumn("_rules", F.when(F.col("_id").isNull(), F.lit(all_rules)).otherwise(F.coalesce("_rules", F.lit(0))).bitwiseOR(F.lit(full)))
    steps = [list(_spans(rule, i, F.col("_rules").bitwiseAND(F.lit(1 << i)) != 0).items()) for i, rule in enumerate(rules)]
    for layer in zip(*steps, strict=True):
        out = out.withColumns(dict(layer))
    return out.select("_row", F.array_sort(F.concat(*[F.col(f"_s{i}") for i in range(len(rules))])).alias("spans"))


def listed(spans: str, rules: list[Rule] = RULES) -> Column:
    """kind:start:end of the spans, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["number"]), x["start"], x["end"])), ",")


def redact(docs: DataFrame, rules: list[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """The documents with every span replaced by [REDACTED:kind]; overlapping spans fold into the first. n_chars follows.

    The documents' columns may have any names. A text that is no string stays as it is unless it holds a secret. Texts are
    cut in blocks of spans, each within its own stretch, so that very many secrets in one text cost little more than few.
    """
    names = docs.columns
    kinds = ", ".join(f"'{r.kind}'" for r in rules)
    # where the text is written up to before each block of spans: the largest end of all blocks before
    ends = "array_max(transform({}, x -> x.end))"
    starts = f"""aggregate(_blocks, named_struct('at', 0, 'out', cast(array() as array<int>)),
        (s, b) -> named_struct('at', greatest(s.at, {ends.format("b")}), 'out', concat(s.out, array(s.at)))).out"""
    stretches = f"""zip_with(_blocks, _starts, (b, at) -> named_struct('spans', b, 'at', at,
        'text', substring(_text, at + 1, greatest(at, {ends.format("b")}) - at)))"""
    cut = f"""transform(_stretches, p -> aggregate(p.spans, named_struct('at', p.at, 'out', ''), (s, x) -> if(x.start >= s.at,
        named_struct('at', x.end, 'out', concat(s.out, substring(p.text, s.at - p.at + 1, x.start - s.at), '[REDACTED:', array({kinds})[x.number], ']')),
        named_struct('at', greatest(s.at, x.end), 'out', s.out)), s -> s.out))"""
    found = _scanned(docs, rules, text_col).withColumn("_text", F.col("_row")[text_col].cast("string"))
    steps = {
        "_blocks": f"if(size(spans) = 0, array(), transform(sequence(0, (size(spans) - 1) div {BLOCK}), i -> slice(spans, i * {BLOCK} + 1, {BLOCK})))",
        "_starts": starts,
        "_stretches": stretches,
        "_new": f"if(size(spans) = 0, _text, concat(array_join({cut}, ''), substring(_text, {ends.format('spans')} + 1)))",
    }
    for name, step in steps.items():
        found = found.withColumn(name, F.expr(step))
    changed = {text_col: F.col("_new")}
    if "n_chars" in names:
        own = F.col("_row")["n_chars"]
        changed["n_chars"] = F.when(F.size("spans") > 0, F.char_length("_new").cast(docs.schema["n_chars"].dataType)).otherwise(own)
    return found.select(*[changed.get(c, F.col("_row")[c]).alias(c) for c in names])


def python_spans(text: str, rules: list[Rule] = RULES) -> list[tuple[int, int, int]]:
    """The plain definition, for tests: (start, rule number, end) of all spans."""
    out = []
    for i, r in enumerate(rules):
        for m in re.finditer(r.pattern, text, re.IGNORECASE | re.ASCII if r.ignore_case else 0):
            if len(m.group(r.group)) >= r.least:
                out.append((m.start(), i, m.end()))
    return sorted(out)
