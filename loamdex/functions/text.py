"""Scalar text functions as Columns; Python only where no built-in has the semantics."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from loamdex import schema as S

BLANK = r"\s"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- hashing and ids -----------------------------------------------------------------------------
def stable_doc_id(path: str | Column) -> Column:
    """crc32 of the path, in 31 bits."""
    return F.crc32(col(path).cast("binary")).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


def content_hash(text: str | Column) -> Column:
    return F.substring(F.sha2(col(text), 256), 1, 16)


def chunk_hash(text: str | Column) -> Column:
    return F.substring(F.sha1(col(text)), 1, 12)


def dedupe_key(text: str | Column, chars: int = 400) -> Column:
    """md5 of the first characters, white space folded."""
    return F.md5(F.substring(F.regexp_replace(F.btrim(col(text)), r"\s+", " "), 1, chars))


# --- windows and n-grams -------------------------------------------------------------------------
def windows(text: str | Column, size: int = S.CHUNK_SIZE, overlap: int = S.CHUNK_OVERLAP, keep_blank: bool = False) -> Column:
    """array of (seq, char_start, text): windows from 0 in steps of size - overlap; blank ones leave a gap in seq."""
    t, step = col(text), size - overlap
    n = F.ceil(F.char_length(t) / F.lit(step)).cast("int")
    made = F.transform(
        F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(i.alias("seq"), (i * step).alias("char_start"), F.substring(t, i * step + 1, F.lit(size)).alias("text")),
    )
    return made if keep_blank else F.filter(made, lambda w: w["text"].rlike(r"\S"))


def ngrams(text: str | Column, low: int = S.NGRAM_LOW, high: int = S.NGRAM_HIGH) -> Column:
    """array of (pos, term): folded character n-grams that are not blank, by length, then place."""
    t = F.lower(col(text))
    return F.filter(F.concat(*[_grams(t, n) for n in range(low, high + 1)]), lambda g: g["term"].rlike(r"\S"))


def _grams(t: Column, n: int) -> Column:
    made = F.transform(F.sequence(F.lit(0), F.char_length(t) - n), lambda i: F.struct(i.alias("pos"), F.substring(t, i + 1, F.lit(n)).alias("term")))
    return F.when(F.char_length(t) >= n, made).otherwise(F.array().cast("array<struct<pos:int,term:string>>"))


def ngram_count(text: str | Column, low: int = S.NGRAM_LOW, high: int = S.NGRAM_HIGH) -> Column:
    """How many n-grams ngrams() has, without making them: all places less the blank ones."""
    t = col(text)
    parts = [F.greatest(F.char_length(t) - (n - 1), F.lit(0)) - F.regexp_count(t, F.lit(f"(?={BLANK * n})")) for n in range(low, high + 1)]
    return reduce(lambda a, b: a + b, parts).cast("int")


def occurrences(text: str | Column, term: str, folded: bool = False) -> Column:
    """How often a folded term stands in the text, overlaps included.

    A term that no end of itself begins cannot overlap itself: what its removal takes from the length tells the
    count. Others are counted by a lookahead.
    """
    t = col(text) if folded else F.lower(col(text))
    if any(term[:i] == term[-i:] for i in range(1, len(term))):
        return F.regexp_count(t, F.lit(f"(?=\\Q{term}\\E)"))
    gone = F.octet_length(t) - F.octet_length(F.replace(t, F.lit(term), F.lit("")))
    return (gone / len(term.encode())).cast("int")


def query_terms(query: str, low: int = S.NGRAM_LOW, high: int = S.NGRAM_HIGH) -> list[str]:
    """Distinct n-grams of a query, in order."""
    q = query.lower()
    grams = (q[i : i + n] for n in range(low, high + 1) for i in range(len(q) - n + 1))
    return list(dict.fromkeys(g for g in grams if g.strip()))


# --- names ---------------------------------------------------------------------------------------
def norm_name(name: str | Column) -> Column:
    """White space folded, one trailing note in parentheses dropped, ends trimmed of separators."""
    n = F.btrim(F.regexp_replace(F.coalesce(col(name), F.lit("")), r"\s+", " "))
    return F.btrim(F.regexp_replace(n, r"\s*\([^)]{0,40}\)\s*$", ""), F.lit(" .,·-"))


def norm_type(kind: str | Column) -> Column:
    """A canonical entity type; unknown ones are "other", missing ones "concept"."""
    known = S.TYPE_SYNONYMS | {t: t for t in S.CANON_TYPES}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    k = F.lower(F.btrim(F.coalesce(F.nullif(col(kind), F.lit("")), F.lit("concept"))))
    return F.coalesce(F.try_element_at(table, k), F.lit("other"))


@F.pandas_udf(T.StringType())
def nfkc(names: pd.Series) -> pd.Series:
    return names.map(lambda s: unicodedata.normalize("NFKC", s or ""))


def merge_key(name: str | Column, normalised: bool = False) -> Column:
    """Letters and digits of the folded name; empty: no candidate for merging. ``normalised``: the name is NFKC already."""
    n = F.coalesce(col(name), F.lit(""))
    return F.regexp_replace(F.lower(n if normalised else nfkc(n)), "[^0-9a-z가-힣]", "")


def squash(name: str | Column) -> Column:
    return F.regexp_replace(col(name), r"(.)\1+", "$1")


def acronym(name: str | Column) -> Column:
    """Initials of a name of several parts, three letters at least, else empty."""
    parts = F.filter(F.split(F.btrim(F.coalesce(col(name), F.lit(""))), r"[\s_\-./]+"), lambda p: p != "")
    a = F.lower(F.array_join(F.transform(parts, lambda p: F.substring(p, 1, 1)), ""))
    return F.when((F.size(parts) >= 2) & (F.char_length(a) >= 3), a).otherwise(F.lit(""))


def slugify(title: str | Column, most: int = 60) -> Column:
    s = F.regexp_replace(F.lower(F.coalesce(col(title), F.lit(""))), r"[^0-9a-z가-힣]+", "-")
    s = F.btrim(F.substring(F.btrim(s, F.lit("-")), 1, most), F.lit("-"))
    return F.when(s == "", F.lit("untitled")).otherwise(s)


def safe_name(name: str | Column, most: int = 120) -> Column:
    return F.substring(F.regexp_replace(F.coalesce(col(name), F.lit("")), r"[\p{C}\p{Zl}\p{Zp}]|[\p{Zs}&&[^ ]]", ""), 1, most)


def occurs(name: Column, text: Column) -> Column:
    """Whether a name stands in a text as a whole ASCII word."""
    return F.rlike(F.lower(text), F.concat(F.lit(r"(?<![0-9a-z_])\Q"), F.lower(name), F.lit(r"\E(?![0-9a-z_])")))


def top_folder(path: str | Column) -> Column:
    return F.when(col(path).contains("/"), F.substring_index(col(path), "/", 1)).otherwise(F.lit(""))


def basename(path: str | Column) -> Column:
    return F.substring_index(col(path), "/", -1)


def clip(text: str | Column, limit: int) -> Column:
    t = F.btrim(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"\s+", " "))
    return F.when(F.char_length(t) > limit, F.concat(F.rtrim(F.substring(t, 1, limit)), F.lit("…"))).otherwise(t)


def clean_desc(text: str | Column, limit: int = 240) -> Column:
    """The first two sentences of 12 letters or more that open differently (first 40 letters, folded); without any the whole
    text. White space is folded, what is over the limit is cut. Null texts are empty."""
    t = F.btrim(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"\s+", " "))
    opening = lambda p: F.lower(F.substring(p, 1, 40))

    def step(kept: Column, part: Column) -> Column:
        p = F.btrim(part, F.lit(" .·"))
        new = (F.size(kept) < 2) & (F.char_length(p) >= 12) & ((F.size(kept) == 0) | (opening(F.get(kept, F.lit(0))) != opening(p)))
        return F.when(new, F.concat(kept, F.array(p))).otherwise(kept)

    parts = F.aggregate(F.split(t, r"(?<=[.。!?])\s+"), F.array().cast("array<string>"), step)
    return clip(F.when(F.size(parts) > 0, F.array_join(parts, ". ")).otherwise(t), limit)


def first_sentence(text: str | Column, limit: int = 160) -> Column:
    t = F.btrim(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"\s+", " "))
    cut = F.regexp_extract(t, r"^(.*?[.!?])(\s|$)", 1)
    return F.substring(F.when(cut != "", cut).otherwise(t), 1, limit)


def token_estimate(text: str | Column) -> Column:
    return F.floor(F.octet_length(col(text)) / 3).cast("long")


# --- dates ---------------------------------------------------------------------------------------
def effective_date(doc_date: str | Column, doc_updated: str | Column) -> Column:
    """The later of two ISO dates; empty means missing."""
    e = F.lit("")
    return F.coalesce(F.greatest(F.nullif(col(doc_date), e), F.nullif(col(doc_updated), e)), F.nullif(col(doc_date), e), F.nullif(col(doc_updated), e), e)


def bad_date(date: str | Column) -> Column:
    """Whether a date that is not empty has another shape than YYYY-MM-DD."""
    d = F.coalesce(col(date), F.lit(""))
    return (d != "") & ~d.rlike(r"^\d{4}-\d{2}-\d{2}$")


# --- frontmatter, links --------------------------------------------------------------------------
FENCE = r"(?s)^\x{FEFF}?\s*---[ \t]*\r?\n(.*?)\r?\n(?:---|\.\.\.)[ \t]*(?:\r?\n|$)"


def frontmatter(raw: str | Column) -> Column:
    """The block between the fences; empty without one."""
    return F.regexp_extract(col(raw), FENCE, 1)


def body(raw: str | Column) -> Column:
    return F.btrim(F.regexp_replace(col(raw), FENCE, ""), F.lit(" \t\r\n"))


def field(block: Column, key: str) -> Column:
    """A one-line value of a frontmatter block, quotes and brackets dropped."""
    v = F.regexp_extract(block, rf"(?m)^{re.escape(key)}[ \t]*:[ \t]*(.*)$", 1)
    return F.btrim(F.regexp_replace(v, r"[\[\]\"']", " "))


def dated(block: Column) -> tuple[Column, Column]:
    """Date and which key it is from: generated.at, then generated_at, captured, created, updated."""
    nested = F.regexp_extract(block, r"(?m)^generated[ \t]*:[^\n]*(?:\n[ \t]+[^\n]*)*?\bat[ \t]*:[ \t]*[\"']?(\d{4}-\d{2}-\d{2})", 1)
    keys = ["generated_at", "captured", "created", "updated"]
    found = [("generated.at", nested), *((k, F.regexp_extract(field(block, k), r"^(\d{4}-\d{2}-\d{2})", 1)) for k in keys)]
    date, source = F.lit(""), F.lit("")
    for name, value in reversed(found):
        date, source = F.when(value != "", value).otherwise(date), F.when(value != "", F.lit(name)).otherwise(source)
    return date, source


def wikilinks(text: str | Column) -> Column:
    """Targets of [[target|label]] and [[target#part]], in order."""
    return F.transform(F.regexp_extract_all(col(text), F.lit(r"\[\[([^\]|#]+)(?:[|#][^\]]*)?\]\]"), 1), lambda x: F.btrim(x))


def hrefs(html: str | Column) -> Column:
    return F.regexp_extract_all(col(html), F.lit(r'href="([^"]*)"'), 1)


def external_url(url: str | Column) -> Column:
    """An http(s) address with a host that has a dot and no user part; else null."""
    u = F.btrim(F.coalesce(col(url), F.lit("")))
    return F.when(u.rlike(r"^(?i)https?://[^\s/@?#:]+\.[^\s/@?#:]+(:\d+)?([/?#]\S*)?$"), u)


# --- noise ---------------------------------------------------------------------------------------
# Openings and line shapes of text that nobody wrote.
NOISE_OPENINGS = ("<system-reminder>", "<command-name>", "<local-command-stdout>", "Caveat:", "[Request interrupted")
NOISE_LINE = r"^\s*(\d+[\t→|]|\|.*\||[-=_*]{3,}\s*$|[+-]{3} )"


def is_noise(text: str | Column) -> Column:
    """Under 40 characters, a machine's opening, or at least half (three at least) of the first 20 lines tables or listings."""
    s = F.btrim(F.coalesce(col(text), F.lit("")), F.lit(" \t\r\n"))
    head = F.slice(F.split(s, "\n"), 1, 20)
    hits = F.size(F.filter(head, lambda line: line.rlike(NOISE_LINE)))
    opening = reduce(lambda a, b: a | b, [s.startswith(p) for p in NOISE_OPENINGS])
    return (F.char_length(s) < 40) | opening | (hits >= F.greatest(F.lit(3.0), F.size(head) * 0.5))


def head_tail(n: Column, i: Column, most: int = 8) -> Column:
    """Whether fragment i of n stays when at most ``most`` do: the first half (rounded down) and the rest from the end."""
    head = most // 2
    return (n <= most) | (i < head) | (i >= n - (most - head))
