"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy on all labelled rows.

A word's embedding is the mean of the embeddings of hashed features: the word, its prefixes and its suffixes.
Filters of width 1, 2 and 3 slide over the words of the whole text, each is max-pooled, and a logistic
layer gives the probability. Thresholds are calibrated by language: the language is told from the text's
own function words, and each language's scores are shifted so that its best threshold lies at 0.3.

Training is a job of the cluster: counts are added up over all training rows, then in each round every shard of them
improves its own copy of the network, and the copies' changes are averaged by rows. Thresholds come from counts of all
calibrating rows by logit. What comes to the driver has the size of the network, or of the logits' bins.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loamdex.llm.common import BROADCAST_ROWS, crc_mod
from loamdex.session import discard, stored

WORD = re.compile(r"\w+")
BUCKETS, DIM = 1 << 15, 12
FILTERS = {1: 12, 2: 6, 3: 6}
THRESHOLD = 0.3
#: Labelled rows of a shard, half of them for each class if both were as frequent. Every labelled row is in a shard.
SHARD_PER_CLASS = 1000
#: Rounds over all shards; rows of one step; logits of a unit that thresholds tell apart, and the largest told apart.
ROUNDS, BATCH, BINS, LARGEST = 2, 64, 1024, 40
#: Steps of a unit that changes of weights are added up in: whole numbers have one sum in any order.
UNIT = 1 << 24
#: Words whose projections a worker keeps before it starts anew.
CACHE_WORDS = 200_000
#: Words scored at a time; longer texts go through in blocks that overlap by the widest filter.
BLOCK_WORDS = 200_000
RATE, PENALTY = 0.03, 1e-4

# Frequent function words that tell a language.
LANGUAGE_WORDS = {
    "en": "the and of to in is that it was for on are with as be this by from at not",
    "de": "der die und das den von ist mit sich des ein nicht auf für im dem eine auch zu an",
    "fr": "le la les et des est un une du en que dans pour qui sur par avec au il ne",
    "es": "el los de que y las en del se por con una para su al lo como es más no",
}
LANGUAGES = [*LANGUAGE_WORDS, "other"]


def features(word: str) -> list[int]:
    """Hashed features of a word: itself, prefixes of 3 to 8 and suffixes of 3 to 5 letters, all shorter than it."""
    n, crc = len(word), zlib.crc32
    own = word.encode()
    if len(own) == n:  # letters are bytes: nothing else to encode
        return [crc(own, _EQUAL) % BUCKETS, *[crc(own[:k], _CARET) % BUCKETS for k in range(3, min(9, n))], *[crc(b"$", crc(own[-k:])) % BUCKETS for k in range(3, min(6, n))]]
    grams = [f"={word}", *(f"^{word[:k]}" for k in range(3, min(9, n))), *(f"{word[-k:]}$" for k in range(3, min(6, n)))]
    return [crc(g.encode()) % BUCKETS for g in grams]


_EQUAL, _CARET = zlib.crc32(b"="), zlib.crc32(b"^")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def language_of(words: list[str]) -> int:
    """Index in LANGUAGES of the language with most function words; ties to the first, none to "other"."""
    counts = [sum(map(own.__contains__, words)) for own in _FUNCTION_WORDS]
    best = max(range(len(counts)), key=counts.__getitem__)
    return best if counts[best] else len(counts)


_FUNCTION_WORDS = [frozenset(v.split()) for v in LANGUAGE_WORDS.values()]


class Network:
    """Weights, forward and backward passes. Positions of filter j of width w share one projection matrix."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.E = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.K = {w: rng.normal(0, 0.5, (w, DIM, f)).astype(np.float32) for w, f in FILTERS.items()}
        self.B = {w: np.zeros(f, np.float32) for w, f in FILTERS.items()}
        self.V = rng.normal(0, 0.3, sum(FILTERS.values())).astype(np.float32)
        self.c = np.float32(0)
        self.shift = np.zeros(len(LANGUAGES), np.float32)

    def embed(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of each word the mean over its features, which stand in turn in flat."""
        return np.add.reduceat(self.E[flat], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None].astype(np.float32)

    def project(self, X: np.ndarray) -> np.ndarray:
        """Per word, what it adds to each filter at each of its positions: sum of w * f columns."""
        return np.concatenate([X @ self.K[w][j] for w in FILTERS for j in range(w)], axis=1)

    def pool(self, P: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pooled sums of one text from its words' projections, and where each maximum stands (-inf and -1: none)."""
        n, out, where, at = len(P), [], [], 0
        for w, f in FILTERS.items():
            if n < w:
                out.append(np.full(f, -np.inf, np.float32))
                where.append(np.full(f, -1))
            else:
                s = P[: n - w + 1, at : at + f].copy()
                for j in range(1, w):
                    s += P[j : n - w + 1 + j, at + j * f : at + (j + 1) * f]
                k = s.argmax(axis=0)
                out.append(s[k, np.arange(f)])
                where.append(k)
            at += w * f
        return np.concatenate(out), np.concatenate(where)

    def pooled(self, table: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Activations of a text of any length, whose words' projections are those rows of the table, and the maxima's places."""
        widest, best, where = max(FILTERS), None, None
        for at in range(0, max(1, len(rows)), BLOCK_WORDS):
            a, k = self.pool(table[rows[at : at + BLOCK_WORDS + widest - 1]])
            if best is None:
                best, where = a, k
            else:
                where = np.where(a > best, k + at, where)
                best = np.maximum(a, best)
        a = np.maximum(best + np.concatenate([self.B[w] for w in FILTERS]), 0)
        return a, np.where(a > 0, where, -1)

    def weights(self) -> np.ndarray:
        """All trained values in rows of DIM, the embeddings first."""
        flat = np.concatenate([self.E.ravel(), *[k.ravel() for k in self.K.values()], *self.B.values(), self.V, np.atleast_1d(self.c)])
        return np.pad(flat, (0, -len(flat) % DIM)).reshape(-1, DIM).astype(np.float64)

    def put(self, weights: np.ndarray) -> Network:
        """Take the values of weights()."""
        flat, at = weights.ravel().astype(np.float32), 0

        def taken(like: np.ndarray) -> np.ndarray:
            nonlocal at
            at += like.size
            return flat[at - like.size : at].reshape(like.shape).copy()

        self.E = taken(self.E)
        self.K = {w: taken(k) for w, k in self.K.items()}
        self.B = {w: taken(b) for w, b in self.B.items()}
        self.V, self.c = taken(self.V), taken(np.zeros(1, np.float32))[0]
        return self


class Vocabulary:
    """Numbers of words and their features, kept for at most CACHE_WORDS words (and those of one batch)."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.flat, self.ends = array("i"), array("q", [0])

    def numbers(self, words: list[str]) -> np.ndarray:
        index = self.index
        for w in words:
            if w not in index:
                index[w] = len(index)
                self.flat.extend(features(w))
                self.ends.append(len(self.flat))
        return np.fromiter(map(index.__getitem__, words), np.int64, len(words))

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """All features in turn, and where each word's begin (and the last one's end)."""
        return np.array(self.flat, np.int64), np.array(self.ends, np.int64)

    def renewed(self) -> Vocabulary:
        return Vocabulary() if len(self.index) > CACHE_WORDS else self


def listed(numbers: np.ndarray, flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of these words in turn, and how many each has."""
    sizes = ends[numbers + 1] - ends[numbers]
    return flat[np.arange(sizes.sum()) + np.repeat(ends[numbers] - (np.cumsum(sizes) - sizes), sizes)], sizes


class Trainer:
    """Adam on the logistic loss, a batch of texts a step; sparse updates of the embeddings."""

    def __init__(self, net: Network, weight: tuple[float, float]):
        self.net, self.weight, self.moments, self.t = net, weight, {}, 0

    def adam(self, name: str, value: np.ndarray, grad: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        m, v = self.moments.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
        at = slice(None) if rows is None else rows
        m[at] = 0.9 * m[at] + 0.1 * grad
        v[at] = 0.99 * v[at] + 0.01 * grad * grad
        value[at] -= RATE * (m[at] / (1 - 0.9**self.t)) / (np.sqrt(v[at] / (1 - 0.99**self.t)) + 1e-6)
        return value

    def step(self, docs: list[np.ndarray], y: np.ndarray, words: Vocabulary) -> None:
        """docs: each text's words by their numbers."""
        net, self.t = self.net, self.t + 1
        used, own = np.unique(np.concatenate(docs), return_inverse=True)
        flat, sizes = listed(used, *words.arrays())
        X = net.embed(flat, sizes) if len(used) else np.zeros((0, DIM), np.float32)
        P = net.project(X)
        ends = np.cumsum([len(d) for d in docs])
        texts = [own[e - len(d) : e] for d, e in zip(docs, ends, strict=True)]
        pooled = [net.pooled(P, rows) for rows in texts]
        A, where = np.stack([a for a, _ in pooled]), np.stack([k for _, k in pooled])
        p = 1 / (1 + np.exp(-np.clip(A @ net.V + net.c, -30, 30)))
        g = ((p - y) * np.where(y == 1, self.weight[1], self.weight[0]) / len(docs)).astype(np.float32)
        gA = np.where(where >= 0, g[:, None] * net.V, 0).astype(np.float32)
        gX, gK, gB, at = np.zeros_like(X), {}, {}, 0
        for w, f in FILTERS.items():
            ga, i_q = gA[:, at : at + f], np.nonzero(where[:, at : at + f] >= 0)
            gK[w], gB[w] = np.zeros_like(net.K[w]), ga.sum(axis=0)
            for j in range(w):
                rows = np.array([texts[i][where[i, at + q] + j] for i, q in zip(*i_q, strict=True)], np.int64)
                lent = ga[i_q][:, None]
                np.add.at(gK[w][j].T, i_q[1], lent * X[rows])
                np.add.at(gX, rows, lent * net.K[w][j].T[i_q[1]])
            at += f
        for w in FILTERS:
            net.K[w] = self.adam(f"K{w}", net.K[w], gK[w] + PENALTY * net.K[w])
            net.B[w] = self.adam(f"B{w}", net.B[w], gB[w])
        net.V = self.adam("V", net.V, g @ A + PENALTY * net.V)
        net.c = np.float32(self.adam("c", np.atleast_1d(net.c), np.atleast_1d(g.sum()))[0])
        touched = np.nonzero(gX.any(axis=1))[0]
        if len(touched):
            own, many = listed(touched, flat, np.append(0, np.cumsum(sizes)))
            buckets, place = np.unique(own, return_inverse=True)
            grads = np.zeros((len(buckets), DIM), np.float32)
            np.add.at(grads, place, np.repeat(gX[touched] / many[:, None].astype(np.float32), many, axis=0))
            net.E = self.adam("E", net.E, grads, buckets)


class Scorer:
    """Scores texts with a bounded cache of word projections."""

    def __init__(self, net: Network):
        self.net, self.index = net, {}
        self.table = np.empty((0, sum(w * f for w, f in FILTERS.items())), np.float32)

    def logit(self, words: list[str]) -> float:
        a, _ = self.net.pooled(self.table, np.fromiter(map(self.index.__getitem__, words), np.int64, len(words)))
        return float(a @ self.net.V + self.net.c)

    def raw(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Logits and languages."""
        split = [words_of(t) for t in texts]
        if len(self.index) > CACHE_WORDS:
            self.index, self.table = {}, self.table[:0]
        new = list(set().union(*split) - self.index.keys()) if split else []
        if new:
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
            lists = [features(w) for w in new]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            flat = np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum()))
            self.table = np.concatenate([self.table, self.net.project(self.net.embed(flat, sizes))])
        return np.array([self.logit(s) for s in split]), np.array([language_of(s) for s in split], np.int64)

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        logits, langs = self.raw(texts)
        return 1 / (1 + np.exp(-np.clip(logits + self.net.shift[langs], -30, 30))), langs


def best_threshold(logits: np.ndarray, n: np.ndarray, hits: np.ndarray) -> float:
    """The logit with the best F1, in the middle of the gap below it. n, hits: rows and those of class 1 at each logit."""
    order = np.argsort(-logits, kind="stable")
    logits, n, hits = logits[order], n[order], hits[order]
    f1 = 2 * np.cumsum(hits) / (np.cumsum(n) + max(1, hits.sum()))
    k = int(np.argmax(f1))
    low = logits[k + 1] if k + 1 < len(logits) else logits[k] - 1
    return float(logits[k] + low) / 2


def calibrate(net: Network, rows: DataFrame, least: int = 30) -> Network:
    """Shift each language so that its best threshold gives THRESHOLD; languages with few rows take the overall one.

    rows: text, y. They are counted by language and logit in steps of 1 / BINS, which is all that comes to the driver.
    """
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                logits, langs = scorer.raw(part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.int32()), pa.array(np.round(np.clip(logits, -LARGEST, LARGEST) * BINS).astype(np.int32)), part.column(1)], names=["language", "bin", "y"])

    counts = rows.select("text", "y").mapInArrow(run, "language int, bin int, y int").groupBy("language", "bin").agg(F.count("*").alias("n"), F.sum("y").alias("hits"))
    held = counts.toPandas()  # a row a language and bin at most
    langs, logits, n, hits = (held[c].to_numpy() for c in ("language", "bin", "n", "hits"))
    logits = logits / BINS
    base = np.log(THRESHOLD / (1 - THRESHOLD))
    bins, place = np.unique(logits, return_inverse=True)
    net.shift[:] = base - best_threshold(bins, np.bincount(place, n), np.bincount(place, hits))
    for k in range(len(LANGUAGES)):
        own = langs == k
        if n[own].sum() >= least and least // 3 <= hits[own].sum() < n[own].sum():
            net.shift[k] = base - best_threshold(logits[own], n[own], hits[own])
    return net


def labelled(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, shard_rows: int) -> DataFrame:
    """text, y, shard, calibrates of every labelled row that is not held out, stored by shard in an order drawn by doc_id.

    Null ids, labels and texts are left out; of repeated labels of a document the largest counts, of several texts of
    an id the smallest. A third calibrates. Shards grow in number with the rows, not in size.
    """
    known = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .where("doc_id is not null and y in (0, 1)")
        .where(crc_mod("doc_id", modulus) != held_out)
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    )
    known = stored(known, "labels")
    n = known.count()
    shards = max(1, -(-n * 2 // (3 * shard_rows)))
    known = F.broadcast(known) if n <= BROADCAST_ROWS else known
    once = (
        docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null")
        .join(known, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    )
    drawn = F.xxhash64("doc_id", F.lit("drawn"))
    dealt = once.withColumns({"calibrates": F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(3)) == 0, "shard": F.pmod(drawn, F.lit(shards)), "drawn": drawn})
    return stored(dealt.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "drawn", "doc_id").select("text", "y", "shard", "calibrates"), "labelled")


def feature_counts(rows: DataFrame) -> np.ndarray:
    """Texts of either class that have each feature, over all rows: (2, BUCKETS)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, words = np.zeros((2, BUCKETS), np.int64), Vocabulary()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part, words = b.slice(at, 256), words.renewed()
                docs = [words.numbers(list(set(words_of(t)))) for t in part.column(0).to_pylist()]
                flat, ends = words.arrays()
                for numbers, y in zip(docs, part.column(1).to_pylist(), strict=True):
                    own = np.zeros(BUCKETS, bool)
                    own[listed(numbers, flat, ends)[0]] = True
                    seen[y] += own
        at = np.nonzero(seen.any(axis=0))[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[0, at]), pa.array(seen[1, at])], names=["bucket", "n0", "n1"])

    seen = np.zeros((2, BUCKETS), np.float32)
    for r in rows.select("text", "y").mapInArrow(run, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).collect():
        seen[:, r["bucket"]] = r["n0"], r["n1"]
    return seen


def trained(net: Network, rows: DataFrame, weight: tuple[float, float]) -> Network:
    """One round: each shard trains a copy of the network on all its rows; the copies' changes are averaged by rows.

    rows: text, y, shard, with the rows of a shard in turn.
    """
    shared = rows.sparkSession.sparkContext.broadcast(net)
    names = [f"w{i}" for i in range(DIM)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = shared.value.weights()
        words, docs, y, shard, seen, trainer = Vocabulary(), [], [], None, 0, None

        def step() -> None:
            nonlocal words, docs, y
            if docs:
                trainer.step(docs, np.array(y), words)
            words, docs, y = words.renewed(), [], []

        def changes() -> Iterator[pa.RecordBatch]:
            step()
            if seen:
                change = trainer.net.weights() - start
                at = np.nonzero(change.any(axis=1))[0]
                whole = np.round(change[at] * UNIT).astype(np.int64) * seen
                yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(whole[:, i]) for i in range(DIM)]], names=["place", *names])

        for b in batches:
            for text, label, own in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                if own != shard:
                    yield from changes()
                    shard, seen, trainer = own, 0, Trainer(Network().put(start), weight)
                docs.append(words.numbers(words_of(text)))
                y.append(label)
                seen += 1
                if len(docs) == BATCH or sum(map(len, docs)) > BLOCK_WORDS:
                    step()
        yield from changes()

    spec = ", ".join(["place long", *[f"{c} long" for c in names]])
    added = rows.select("text", "y", "shard").mapInArrow(run, spec).groupBy("place").agg(*[F.sum(c).alias(c) for c in names]).toPandas()  # the network's size
    weights, n = net.weights(), rows.count()
    weights[added["place"].to_numpy()] += added[names].to_numpy() / (UNIT * n)
    return net.put(weights)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = SHARD_PER_CLASS, modulus: int = 4, held_out: int = 2) -> Network | None:
    """Train on two thirds of all labelled rows, calibrate on the others. None without both classes.

    ``per_class`` sets the rows of a shard (twice as many), not how many are learned from. Where one of the parts lacks
    a class, both are made of all rows. The first embedding coordinate starts as the smoothed log odds of its feature in
    the training texts, which puts informative words where max pooling finds them from the first step on.
    """
    table = labelled(docs, labels, label, modulus, held_out, 2 * per_class)
    sizes = {(r["calibrates"], r["y"]): r["count"] for r in table.groupBy("calibrates", "y").count().collect()}
    if {y for _, y in sizes} != {0, 1}:
        discard(table)
        return None
    train, hold = (table.where("not calibrates"), table.where("calibrates")) if len(sizes) == 4 else (table, table)
    n = [sizes[False, y] if len(sizes) == 4 else sizes.get((False, y), 0) + sizes.get((True, y), 0) for y in (0, 1)]
    net, seen = Network(), feature_counts(train) + 1
    net.E[:, 0] = (np.log(seen[1] / (1 + n[1])) - np.log(seen[0] / (1 + n[0]))) / 4
    for w in FILTERS:
        net.K[w][:, 0, : FILTERS[w] // 2] = 1.0 / w
    for _ in range(ROUNDS):
        net = trained(net, train, (sum(n) / (2 * n[0]), sum(n) / (2 * n[1])))
    net = calibrate(net, hold)
    discard(table)
    return net


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, score, language of every row. Null and empty texts have no words and score like any text without one.

    Without a network (no labels of both kinds) every score is 0. Null ids and repeated rows stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value) if shared.value else None
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = part.column(1).to_pylist()
                p, langs = scorer.scores(texts) if scorer else (np.zeros(len(texts)), [len(LANGUAGES) - 1] * len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p, pa.float64()), pa.array([LANGUAGES[i] for i in langs])], names=["doc_id", "score", "language"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, language string")
