"""Mixing to target weights over soft domain membership, with DataFrame functions only.

A Bernoulli naive Bayes classifier is trained on two thirds of the labelled sample and gives each document posteriors
over domains; a temperature, chosen on the last third, makes them as sure as they are right. Document rates r >= 0 are
then fitted by projected gradient: with n the tokens of a document and p its posteriors, the expected domain totals
T_d(r) = sum of n * r * p_d are to equal the targets t_d. The gradient is taken in the metric of the token counts, and the
squares of T - t are weighted by the inverse of H = sum of n * p * p' over the rows whose rate is above 0, so that a step
without projection would meet the targets at once: r <- max(0, r - p' W (T - t)), W = H^-1. A step that leaves a larger
residual is halved. The moves W (T - t) of all steps are a few numbers on the driver, so each document's rate is a fold
over them: a step is one aggregation, no rate is stored or shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from loamdex.session import stored

#: Most labelled rows of each domain to train on, features kept, and letters of a word's prefix.
SAMPLE_PER_DOMAIN, FEATURES, PREFIX = 2000, 192, 5
#: How many times likelier a feature must be in some domain than in the rest; common words tell length, not domain.
LIFT = 4.0
#: Training rows below which a domain's feature rates are those of a few texts: it is then told of no document.
LEAST_ROWS = 10
STEPS, HALVINGS, TOLERANCE = 40, 6, 1e-5
#: The log posterior of a domain that cannot be told: exp() of it is 0 at every temperature.
NEVER = -1e9
#: Temperatures that the log posteriors may be divided by.
TEMPERATURES = [1, 1.5, 2, 3, 4, 6, 8, 12, 16, 24]


def words(text: str) -> Column:
    return F.split(F.lower(F.col(text)), r"[^\p{L}]+", -1)


def with_terms(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds _words (the folded words of the text) and _shape (marks of its form: capitals, symbols and repeated words in tenths of its words)."""
    size = F.greatest(F.size("_words"), F.lit(1))
    tenths = lambda n: F.least(F.floor(n * 10 / size), F.lit(10)).cast("string")
    marks = {
        "#caps": F.regexp_count("_text", F.lit(r"\p{Lu}{2}")),
        "#symbols": F.regexp_count("_text", F.lit(r"[^\p{L}\p{N}\s.,;:'\"?()-]+")),
        "#distinct": F.size(F.array_distinct("_words")),
    }
    out = docs.withColumn("_text", F.coalesce(F.col(text).cast("string"), F.lit(""))).withColumn("_words", words("_text"))
    return out.withColumn("_shape", F.array(*[F.concat(F.lit(name), tenths(n)) for name, n in marks.items()]))


def terms() -> Column:
    """The distinct features of a row: word prefixes and marks of form."""
    return F.concat(F.transform("_words", lambda w: F.substring(w, 1, PREFIX)), F.col("_shape"))


@dataclass
class Classifier:
    """Bernoulli naive Bayes over a bounded list of features: log prior terms and log odds per domain."""

    domains: list[str]
    base: list[float]
    features: list[str] = field(default_factory=list)
    odds: list[list[float]] = field(default_factory=list)  # one list per domain
    temperature: float = 1.0

    def present(self) -> Column:
        """Places (from 1) of the known features that a row with with_terms() columns has."""
        known = F.array(*[F.lit(f) for f in self.features]).cast("array<string>")
        return F.transform(F.array_intersect(terms(), known), lambda f: F.array_position(known, f).cast("int"))

    def logs(self) -> Column:
        """Log posteriors by domain up to a constant, from _present."""

        def log(base: float, odds: list[float]) -> Column:
            if not odds:
                return F.lit(base)
            table = F.array(*[F.lit(v) for v in odds])
            return F.aggregate("_present", F.lit(base), lambda s, i: s + F.get(table, i - 1))

        return F.array(*[log(b, o) for b, o in zip(self.base, self.odds or [[]] * len(self.base), strict=True)])

    def apply(self, docs: DataFrame) -> DataFrame:
        """docs with _tokens (words, one at least) and _p (posteriors by domain)."""
        out = with_terms(docs).withColumn("_present", self.present()).withColumn("_tokens", F.greatest(F.size(F.filter("_words", lambda w: w != "")), F.lit(1)).cast("long"))
        out = out.drop("_words", "_shape", "_text").withColumn("_logs", self.logs())
        return out.withColumn("_p", softmax("_logs", self.temperature)).drop("_present", "_logs")


def softmax(logs: str, temperature: float) -> Column:
    e = F.transform(logs, lambda v: F.exp((v - F.array_max(logs)) / temperature))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def label_domains(labels: DataFrame) -> DataFrame:
    """doc_id, domain of the labels table: toxic, else noisy (quality 0), else clean. Nulls of a label count as unknown."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "noisy").when((F.col("quality") == 1) & (F.col("toxic") == 0), "clean")
    return labels.select("doc_id", domain.alias("domain")).where("doc_id is not null and domain is not null")


def train(docs: DataFrame, labelled: DataFrame, domains: list[str], per_domain: int = SAMPLE_PER_DOMAIN, features: int = FEATURES) -> Classifier:
    """Train on at most ``per_domain`` labelled rows of each domain (smallest xxhash64(doc_id) first).

    The prior is the share of a domain among all labels. Features are those whose presence differs most
    between a domain and the rest, by chi-square, among those LIFT times likelier in some domain. Every third row
    (by hash) trains nothing and chooses the temperature. A domain with fewer than LEAST_ROWS training rows, where another
    has that many, has a posterior of 0 everywhere, so its target is missed and the residual says by how much. Without
    labels the posterior is even.
    """
    once = labelled.where(F.col("domain").isin(domains)).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    totals = {r["domain"]: r["n"] for r in once.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    everything = sum(totals.values())
    prior = [math.log((totals.get(d, 0) + 1) / (everything + len(domains))) for d in domains]
    picks = [once.where(F.col("domain") == d).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_domain) for d in domains]
    sample = picks[0]
    for p in picks[1:]:
        sample = sample.unionByName(p)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("domain").alias("domain"))  # per_domain short rows a domain: a proven bound
    sampled = stored(with_terms(rows).select("domain", "_words", "_shape", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0).alias("held")), "mixing-sample")
    marked = sampled.where("not held").select("domain", F.array_distinct(terms()).alias("terms"))
    sizes = {r["domain"]: r["n"] for r in marked.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    told = {d: n for d, n in sizes.items() if n >= LEAST_ROWS} or sizes
    marked, m = marked.where(F.col("domain").isin(list(told))), [told.get(d, 0) for d in domains]
    if not sum(m):
        return Classifier(domains, prior)
    seen = marked.select("domain", F.explode("terms").alias("term")).where("term <> ''").groupBy("term").agg(*[F.sum((F.col("domain") == d).cast("double")).alias(f"c{i}") for i, d in enumerate(domains)])
    df = sum((F.col(f"c{i}") for i in range(len(domains))), F.lit(0.0))
    whole, chi, lift = float(sum(m)), [], []
    for i, n in enumerate(m):
        a, b = F.col(f"c{i}"), df - F.col(f"c{i}")
        c, d = F.lit(float(n)) - a, F.lit(whole - n) - b
        lift.append((a + 0.1) / (n + 0.2) / ((b + 0.1) / (whole - n + 0.2)))
        chi.append(whole * (a * d - b * c) ** 2 / F.greatest((a + b) * (c + d) * (a + c) * (b + d), F.lit(1e-9)))
    best = seen.where((df >= 10) & (F.greatest(*lift, F.lit(0.0)) >= LIFT)).withColumn("chi", F.greatest(*chi) if len(chi) > 1 else chi[0]).orderBy(F.desc("chi"), "term").limit(features).collect()
    share = [[(r[f"c{i}"] + 0.1) / (m[i] + 0.2) for r in best] for i in range(len(domains))]
    base = [q + sum(math.log(1 - s) for s in own) if n else NEVER for q, own, n in zip(prior, share, m, strict=True)]
    model = Classifier(domains, base, [r["term"] for r in best], [[math.log(s / (1 - s)) if n else 0.0 for s in own] for own, n in zip(share, m, strict=True)])
    return calibrate(model, sampled.where("held").where(F.col("domain").isin(list(told))), totals)


def calibrate(model: Classifier, held: DataFrame, totals: dict[str, int]) -> Classifier:
    """Take the temperature with the least log loss on rows that trained nothing; a domain's rows weigh as much as its labels."""
    held = held.withColumn("_present", model.present()).withColumn("_logs", model.logs())
    place = F.coalesce(*[F.when(F.col("domain") == d, F.lit(i)) for i, d in enumerate(model.domains)])
    loss = [F.avg(-F.log(F.greatest(F.get(softmax("_logs", float(t)), place), F.lit(1e-12)))).alias(f"l{i}") for i, t in enumerate(TEMPERATURES)]
    found = held.groupBy("domain").agg(*loss).collect()
    whole = [sum(r[f"l{i}"] * totals[r["domain"]] for r in found) for i in range(len(TEMPERATURES))]
    model.temperature = float(TEMPERATURES[whole.index(min(whole))]) if found else 1.0
    return model


def rate(steps: list[list[float]], most: float | None = None) -> Column:
    """The rate of a row from its posteriors _p: the fold of all steps, from 1, never above ``most``."""
    if not steps:
        return F.lit(1.0)
    moves = F.array(*[F.array(*[F.lit(float(v)) for v in e]) for e in steps])
    dot = lambda e: F.aggregate(F.zip_with("_p", e, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    clip = lambda r: F.greatest(F.lit(0.0), r if most is None else F.least(r, F.lit(most)))
    return F.aggregate(moves, F.lit(1.0), lambda r, e: clip(r - dot(e)))


@dataclass
class Fit:
    """Steps of the gradient, the residual of each domain as a share of all tokens, and whether all are within the tolerance.

    Where they are not, the residuals stopped shrinking (no nonnegative rates reach the targets) or the steps ran out.
    """

    steps: list[list[float]]
    residuals: list[float]
    settled: bool


def fit(members: DataFrame, weights: list[float], steps: int = STEPS, tolerance: float = TOLERANCE, anchor: int | None = None) -> Fit:
    """Projected gradient for rows of (_tokens, _p), so that expected totals match ``weights`` of all tokens.

    Stops when all residuals are below ``tolerance`` of all tokens, or no longer shrink: targets that no
    nonnegative rates reach are met as closely as least squares allow. With an ``anchor`` no rate is above 1: the
    weights of the other domains are the most they may have of what is kept, so those above are thinned to them, and
    those below stay whole (their residual is negative).
    """
    d = len(weights)
    want, free = np.array(weights), np.array([i != anchor for i in range(d)])
    cells = [(i, j) for i in range(d) for j in range(i, d)]
    most = None if anchor is None else 1.0

    def totals(steps: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
        rows = members.select("_tokens", "_p", rate(steps, most).alias("_r"))
        p = lambda i: F.get("_p", F.lit(i))
        live = F.when(F.col("_r") > 0, F.col("_tokens")).otherwise(0)
        sums = [F.sum(F.col("_tokens") * F.col("_r") * p(i)) for i in range(d)] + [F.sum(live * p(i) * p(j)) for i, j in cells]
        row = [v or 0.0 for v in rows.agg(*sums).first()]
        H = np.zeros((d, d))
        for (i, j), v in zip(cells, row[d:], strict=True):
            H[i, j] = H[j, i] = v
        return np.array(row[:d]), H

    now, H = totals([])
    whole = float(now.sum())
    if not whole:
        return Fit([], [0.0] * d, True)
    beyond = lambda now: now / whole - want * (1.0 if anchor is None else now.sum() / whole)
    # what counts of a residual: with an anchor, a domain that nothing was taken from may be short
    counts = lambda off, taken: np.where(free & ((anchor is None) | (off > 0) | (taken > 1e-12)), off, 0.0)
    taken, out = np.zeros(d), []
    off = counts(beyond(now), taken)
    while np.abs(off).max() >= tolerance and len(out) < steps:
        move = np.zeros(d)
        at = np.nonzero(off)[0]
        move[at] = np.linalg.lstsq(H[np.ix_(at, at)] / whole, off[at], rcond=1e-10)[0]
        move = move if anchor is None else np.maximum(move, -taken)
        for halving in range(HALVINGS):
            part = move / 2**halving
            now_, H_ = totals([*out, part.tolist()])
            new = counts(beyond(now_), taken + part)
            if np.square(new).sum() < np.square(off).sum() * (1 - 1e-6):
                break
        else:
            break
        out, taken, off, now, H = [*out, part.tolist()], taken + part, new, now_, H_
    return Fit(out, (beyond(now) if anchor is None else now / now.sum() - want).tolist(), bool(np.abs(off).max() < tolerance))


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], keep: list[str] | None = None) -> DataFrame:
    """The kept columns (doc_id), tokens, posteriors (array in the order of ``targets``), rate and residuals of every row.

    ``residuals`` are the same in every row: by how much of all tokens each domain misses its target. Null and empty
    texts are one token and classified by what they lack. Very long texts are taken whole. Null ids and repeated rows
    stay; an empty table gives no rows. Kept columns that are called like a column of the result give way to it.
    """
    mixed, _ = fitted(docs, labelled, targets)
    own = ["tokens", "posteriors", "rate", "residuals"]
    return mixed.select(*[F.col("_row")[c].alias(c) for c in keep or ["doc_id"] if c not in own], *own)


def fitted(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], anchor: str | None = None) -> tuple[DataFrame, Fit]:
    """The result of mix() with each whole row in _row, and the fit."""
    domains = list(targets)
    model = train(docs, labelled, domains)
    members = stored(model.apply(docs.select(F.struct("*").alias("_row"), F.col("text"))).select("_row", "_tokens", "_p"), "mixing-members")
    weight, at = sum(targets.values()), domains.index(anchor) if anchor else None
    if anchor:  # a row that is likeliest the anchor's is wholly so: what it may hold of other domains never thins it
        sole = F.array(*[F.lit(float(d == anchor)) for d in domains])
        members = members.withColumn("_p", F.when(F.get("_p", F.lit(at)) >= F.array_max("_p"), sole).otherwise(F.col("_p")))
    # without a feature to tell domains by nothing can be thinned
    found = Fit([], [0.0] * len(domains), False) if anchor and not model.features else fit(members.select("_tokens", "_p"), [targets[d] / weight for d in domains], anchor=at)
    more = {"tokens": F.col("_tokens"), "posteriors": F.col("_p"), "rate": rate(found.steps, 1.0 if anchor else None), "residuals": F.array(*[F.lit(float(v)) for v in found.residuals])}
    return members.withColumns(more), found


def uniform(id_col: str | Column, seed: int = 0) -> Column:
    """A number in [0, 1) by hash of the id."""
    return F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)


def thin(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], anchor: str, id_col: str = "doc_id", seed: int = 0) -> DataFrame:
    """The rows of docs, each at most once, of which no domain but the anchor has more than its target; see fit().

    Rows whose likeliest domain is the anchor all stay; they count as the anchor's alone, and only the others are thinned.
    """
    mixed, _ = fitted(docs, labelled, targets, anchor)
    return mixed.where(uniform(F.col("_row")[id_col], seed) < F.col("rate")).select("_row.*")


def realise(mixed: DataFrame, id_col: str = "doc_id", seed: int = 0) -> DataFrame:
    """Rows repeated floor(rate + u) times, u uniform by hash of the id."""
    copies = F.floor(F.col("rate") + uniform(F.col(id_col), seed)).cast("int")
    return mixed.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), copies))).drop("_copy")
