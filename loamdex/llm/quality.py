"""Document quality from a linear-chain conditional random field over lines.

Every line that is not blank is a state, good or bad. Its features are those of the line itself, in bins,
and the plain values of the lines before and after it. Forward-backward gives each line's probability of
being good; a document's quality is their mean weighted by line length, mapped to a probability by a logistic
curve. Only document labels are known: lines first take their document's label and are fitted each for itself;
lines of bad documents that look like those of good ones turn good, and the chain is trained on the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from loamdex.llm.common import learned

#: Most labelled rows of each class to train on; a third of them calibrates.
SAMPLE_PER_CLASS = 1500
BINS = 6
STEPS, RATE, PENALTY = 120, 0.08, 1e-3
#: Padded cells of a forward-backward block: bounds memory for documents of any number of lines.
BLOCK_CELLS = 1 << 18

CLASSES = ["upper", "lower", "digit", "space", "stop", "bang", "pipe", "symbol", "other"]
_TABLE = np.full(256, CLASSES.index("other"), np.uint8)
for _name, _chars in {"upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": b"0123456789", "space": b" \t\r\x0b\x0c", "stop": b".,;:'\"?-()", "bang": b"!", "pipe": b"|", "symbol": b"#$%&*+/<=>@[\\]^_`{}~"}.items():
    _TABLE[list(_chars)] = CLASSES.index(_name)


def lines_of(text: str | None) -> list[str]:
    """The lines that are not blank; a text without any has one line, a space."""
    return [x for x in (text or "").split("\n") if x and not x.isspace()] or [" "]


def line_values(docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Plain feature values of all lines of all documents, and the lines' lengths in bytes."""
    raw = [x.encode("utf-8", "replace") for d in docs for x in d]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    kinds = _TABLE[np.frombuffer(b"".join(raw), np.uint8)]
    starts = np.cumsum(size) - size
    share = [np.add.reduceat(kinds == k, starts, dtype=np.int64) / size for k in range(len(CLASSES))]
    extra, at = np.zeros((len(raw), 6)), 0
    for d in docs:
        seen: set[str] = set()
        for line in d:
            words = line.split()
            n = max(1, len(words))
            extra[at] = (len(set(words)) / n, sum(map(str.__eq__, words, words[1:])) / n, len(line) / n / 20, line in seen, words[-1][-1:] == "." if words else 0, line[:1].isupper())
            seen.add(line)
            at += 1
    return np.column_stack([np.log1p(size) / 8, *share, extra]), size


def expand(values: np.ndarray, counts: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Bins of each line's own values, and the plain values of its neighbours within the document."""
    n, k = values.shape
    bins = (values[:, :, None] > edges[None]).sum(axis=2)
    hot = np.zeros((n, k, edges.shape[1] + 1), np.float32)
    np.put_along_axis(hot, bins[:, :, None], 1, axis=2)
    before, after = np.zeros_like(values), np.zeros_like(values)
    before[1:], after[:-1] = values[:-1], values[1:]
    ends = np.cumsum(counts)
    before[ends - counts], after[ends - 1] = 0, 0
    first, last = np.zeros((n, 1)), np.zeros((n, 1))
    first[ends - counts], last[ends - 1] = 1, 1
    return np.column_stack([hot.reshape(n, -1), values, before, after, first, last, np.ones((n, 1))]).astype(np.float32)


def forward_backward(emit: np.ndarray, counts: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and expected transition counts (2, 2). emit: score of good over bad, lines of all documents in turn."""
    out, moves = np.zeros(len(emit)), np.zeros((2, 2))
    starts = np.cumsum(counts) - counts
    order = np.argsort(counts, kind="stable")
    at = 0
    while at < len(order):
        size = 1
        while at + size < len(order) and (size + 1) * counts[order[at + size]] <= BLOCK_CELLS:
            size += 1
        docs = order[at : at + size]
        at += size
        n, t = counts[docs], int(counts[docs[-1]])
        cell = np.minimum(np.arange(t)[None], n[:, None] - 1) + starts[docs][:, None]
        live = np.arange(t)[None] < n[:, None]
        e = np.stack([np.zeros(cell.shape), np.where(live, emit[cell], 0)], axis=2)
        fwd, bwd = np.empty_like(e), np.zeros_like(e)
        fwd[:, 0] = e[:, 0]
        for i in range(1, t):
            step = fwd[:, i - 1, :, None] + trans[None]
            fwd[:, i] = np.where(live[:, i, None], np.logaddexp(step[:, 0], step[:, 1]) + e[:, i], fwd[:, i - 1])
        for i in range(t - 2, -1, -1):
            step = trans[None] + (e[:, i + 1] + bwd[:, i + 1])[:, None, :]
            bwd[:, i] = np.where(live[:, i + 1, None], np.logaddexp(step[:, :, 0], step[:, :, 1]), 0)
        z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
        both = np.exp(fwd + bwd - z[:, None, None])
        out[cell[live]] = both[:, :, 1][live]
        if t > 1:
            pair = fwd[:, :-1, :, None] + trans[None, None] + (e + bwd)[:, 1:, None, :] - z[:, None, None, None]
            moves += np.exp(np.minimum(pair, 0))[live[:, 1:]].sum(axis=0)
    return out, moves


class LineField:
    """The trained field: bin edges, emission weights, transitions and the logistic curve of document quality."""

    def __init__(self, edges: np.ndarray, weights: np.ndarray, trans: np.ndarray):
        self.edges, self.weights, self.trans, self.curve = edges, weights, trans, (1.0, 0.0)

    def marginals(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) of all lines, their lengths, and the number of lines of each document."""
        counts = np.fromiter(map(len, docs), np.int64, len(docs))
        values, size = line_values(docs)
        return forward_backward(expand(values, counts, self.edges) @ self.weights, counts, self.trans)[0], size, counts

    def raw(self, docs: list[list[str]]) -> np.ndarray:
        good, size, counts = self.marginals(docs)
        at = np.cumsum(counts) - counts
        q = np.clip(np.add.reduceat(good * size, at) / np.add.reduceat(size, at), 1e-4, 1 - 1e-4)
        return np.log(q / (1 - q))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * self.raw([lines_of(t) for t in texts]) + b, -30, 30))) if texts else np.empty(0)


def train(texts: list[str], y: np.ndarray) -> LineField:
    docs = [lines_of(t) for t in texts]
    counts = np.fromiter(map(len, docs), np.int64, len(docs))
    values, _ = line_values(docs)
    edges = np.quantile(values, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T.copy()
    X = expand(values, counts, edges)
    own = np.repeat(y, counts)
    line = own.astype(float)
    # a document counts once, and both classes alike, however many lines it has
    weight = np.repeat(np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) / counts, counts) * len(docs)
    starts = np.cumsum(counts) - counts
    inner = np.ones(len(line), bool)
    inner[starts] = False
    alone = np.zeros(X.shape[1], bool)
    alone[: values.shape[1] * (edges.shape[1] + 2)] = True  # a line's own bins and values, no neighbours
    alone[-1] = True
    for chained in (False, True):
        # first each line for itself, without neighbours and transitions; then the chain on the lines relabelled by that
        w, trans = np.zeros(X.shape[1], np.float32), np.zeros((2, 2))
        m, v, mt, vt = np.zeros_like(w), np.zeros_like(w), np.zeros((2, 2)), np.zeros((2, 2))
        known = np.zeros((2, 2))
        np.add.at(known, (line[:-1].astype(int)[inner[1:]], line[1:].astype(int)[inner[1:]]), 1)
        for t in range(1, STEPS + 1):
            score = X @ w
            good, moves = forward_backward(score, counts, trans) if chained else (1 / (1 + np.exp(-np.clip(score, -30, 30))), known)
            g = X.T @ ((good - line) * weight).astype(np.float32) / len(docs) + PENALTY * w
            g = g if chained else g * alone
            gt = (moves - known) / max(1, len(line)) + PENALTY * trans
            m, v, mt, vt = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mt + 0.1 * gt, 0.99 * vt + 0.01 * gt * gt
            w = (w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
            trans = trans - RATE * (mt / (1 - 0.9**t)) / (np.sqrt(vt / (1 - 0.99**t)) + 1e-8)
        if not chained:
            # lines of bad documents that look like those of good ones turn good, but never the worst of a document
            good = 1 / (1 + np.exp(-np.clip(X @ w, -30, 30)))
            worst = np.repeat(np.minimum.reduceat(good, starts), counts)
            line = np.where((own == 0) & (good > 0.5) & (good > worst), 1.0, own.astype(float))
    return LineField(edges, w, trans)


def calibrate(field: LineField, texts: list[str], y: np.ndarray, weight: np.ndarray) -> LineField:
    """Fit the logistic curve by Newton steps, a row counting as its weight."""
    x = field.raw([lines_of(t) for t in texts])
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        r, h = (p - y) * weight, np.maximum(p * (1 - p), 1e-6) * weight
        g = np.array([(r * x).sum() + 0.01 * a, r.sum()])
        H = np.array([[(h * x * x).sum() + 0.01, (h * x).sum()], [(h * x).sum(), h.sum()]]) + 1e-6 * np.eye(2)
        d = np.linalg.solve(H, g)
        a, b = a - np.clip(d[0], -1, 1), b - np.clip(d[1], -1, 1)
    field.curve = (float(a), float(b))
    return field


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = SAMPLE_PER_CLASS, modulus: int = 5, held_out: int = 0) -> LineField | None:
    """Train on two thirds of a bounded labelled sample, calibrate on the rest, in a task. None without both classes."""
    return learned(learn, docs, labels, label, per_class, modulus, held_out)


def learn(sample: list[tuple[str, int]]) -> LineField | None:
    y = np.array([v for _, v in sample], np.int64)
    if not len(y) or y.min() == y.max():
        return None
    texts = [t for t, _ in sample]
    third = np.random.default_rng(5).permutation(len(y)) % 3 == 0
    if y[third].min() == y[third].max() or y[~third].min() == y[~third].max():
        third = np.zeros(len(y), bool)
    field = train([t for t, x in zip(texts, third, strict=True) if not x], y[~third])
    use = third if third.any() else ~third
    return calibrate(field, [t for t, x in zip(texts, use, strict=True) if x], y[use], np.ones(int(use.sum())))


def score(docs: DataFrame, field: LineField | None, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The kept columns (doc_id) and the score of every row, in a column called ``name``. Null and empty texts count as one blank line.

    Without a field (no labels of both kinds) every score is 1, so a filter drops nothing. Null ids and
    repeated rows stay; a kept column called ``name`` must not be asked for (wrap the row in a struct instead).
    Very long texts are taken whole, line by line.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)  # some kB, whatever the input
    keep = keep or ["doc_id"]
    at = keep.index("text") if "text" in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                texts = part.column(at).to_pylist()
                p = shared.value.scores(texts) if shared.value else np.ones(len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(p, pa.float64())], names=[*keep, name])

    rows = docs.select(*keep, *([] if "text" in keep else [F.col("text").cast("string").alias("text")]))
    return rows.mapInArrow(run, StructType([*(docs.schema[c] for c in keep), StructField(name, DoubleType())]))
