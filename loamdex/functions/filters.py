"""The note filter language as a Column: words, "quoted words", file:, path:, tag:, -negation; all must hold."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

from loamdex.functions import text as X

#: A term: a minus, a field right before its value, and the value, in quotes (to the end if they stay open) or up to a space.
TERM = re.compile(r'(-?)(?:(file|path|tag):)?(?:"([^"]*)(?:"|$)|([^ ]*))', re.IGNORECASE)


def parse(query: str) -> list[tuple[bool, str, str]]:
    """(negated, field, folded text) of each term; terms without a value, as they stand while one types, are left out."""
    terms = ((neg, field.lower() or "path", (quoted or word).lower()) for neg, field, quoted, word in TERM.findall(query))
    return [(bool(neg), field, value) for neg, field, value in terms if value]


def matches(query: str, path: str = "path", tags: str | None = None) -> Column:
    """Whether a note meets the query; an empty query meets all."""
    fields = {"path": F.lower(F.col(path)), "file": F.lower(X.basename(path))}
    tests = []
    for negated, field, value in parse(query):
        if field == "tag":
            hit = F.array_contains(F.transform(tags, F.lower), value) if tags else F.lit(False)
        else:
            hit = fields[field].contains(value)
        tests.append(~hit if negated else hit)
    return reduce(lambda a, b: a & b, tests, F.lit(True))
