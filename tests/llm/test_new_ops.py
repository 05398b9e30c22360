"""Line dedup, whitening and the prefix trie against plain versions."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("loamdex.llm")

from loamdex.llm import line_dedup, queries, trie, whitening

from conftest import SF


def plain_key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def plain_dedup(texts, least, least_points):
    found = Counter(k for t in texts for k in {plain_key(x) for x in (t or "").split("\n")} if len(k) >= least_points)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if found[plain_key(x)] < least]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


LINES = ["Same  line", " same  LINE\t", "sämé", "SÄMÉ", "", " \x0b", "x", " x", "İ", "a\rb", "only here", "\x1cx", "😀", "ÀB"]


@pytest.mark.parametrize(("least", "least_points"), [(2, 1), (3, 0), (10, 1), (1, 2), (1000, 1)])
def test_line_dedup_against_plain(spark, least, least_points):
    rng = np.random.default_rng(least)
    texts = [None, "", "\n", "\n\n x", "x" * 300_000, "\n".join(f"row {i % 7000}" for i in range(60_000))]
    texts += ["\n".join(rng.choice(LINES, rng.integers(1, 9))) for _ in range(60)] + ["same line\nsame line"] * 4
    docs = spark.createDataFrame([(i // 2, t, "v", i) for i, t in enumerate(texts)], "doc_id long, text string, lines string, row int")
    out = line_dedup.dedup(docs.repartition(3), least, least_points, shard_keys=700).select("row.row", "row.lines", F.col("lines").alias("m")).collect()
    got = [(r.m.n_lines, r.m.n_dropped, r.m.kept) for r in sorted(out, key=lambda r: r.row)]
    assert got == plain_dedup(texts, least, least_points) and {r.lines for r in out} == {"v"}


def test_line_dedup_of_nothing(spark):
    assert line_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash_is_minimal(n):
    rng = np.random.default_rng(n)
    h1, h2 = rng.integers(0, 1 << 63, n, np.uint64), rng.integers(0, 1 << 63, n, np.uint64)
    h1[: n // 3] = h1[:1]  # equal first hashes are told apart by the second
    h = line_dedup.PerfectHash.of(h1, h2)
    assert sorted(h.numbers(h1, h2)) == list(range(n))
    assert len(h.words) * 64 <= 4.5 * n + 64 * 16
    others = rng.integers(0, 1 << 63, 1000, np.uint64)
    shard = line_dedup.Shard(line_dedup.make_shard(h1, h2, np.arange(n) + 1))
    assert (shard.counts(h1, h2) == np.arange(n) + 1).all()
    if n:
        assert not shard.counts(others, others + np.uint64(1)).any()


def test_workers_keep_few_shards(spark, monkeypatch, tmp_path):
    docs = spark.createDataFrame([(i, f"line {i // 2}") for i in range(200)], "doc_id long, text string")
    path, shards = line_dedup.build_index(docs, floor=2, shard_keys=10)
    assert shards == 10
    monkeypatch.setattr(line_dedup, "HELD_BYTES", 1000)
    rows = sum(line_dedup.shard_at(path, s).hash.sizes.size > 0 and len(line_dedup.shard_at(path, s).found) for s in range(shards))
    assert rows == 100 and sum(s.bytes for s in line_dedup._held.values()) <= 1000


def plain_white(vectors, k):
    x = np.array([[int(np.floor(1024 * float(c))) + 100000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(axis=0)
    deviation = [sum(int(c) ** 2 for c in n * row - s) for row in x]
    centred = np.array([[float(c) for c in n * row - s] for row in x]) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-e)
    return deviation, centred @ v[:, order[:k]] / np.sqrt(e[order[:k]]), e[order[:k]] / e.sum()


def test_whitening_against_plain(spark):
    rng = np.random.default_rng(5)
    good = (rng.normal(size=(400, 12)) * np.arange(1, 13) + 3).astype(np.float32).tolist()
    bad = [None, [], [float("nan")] * 12, [1.0] * 11 + [float("inf")], [None] + [1.0] * 11, [1.0] * 5]
    rows = [(i, v) for i, v in enumerate(good)] + [(1000 + i, v) for i, v in enumerate(bad)] + [(None, good[3]), (3, good[3])]
    table = spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<float>, id long")
    kept = good + [good[3], good[3]]
    deviation, white, explained = plain_white(kept, 8)
    out = whitening.whiten(table.repartition(40)).collect()  # more partitions than one task merges
    assert len(out) == len(kept) and {r.n for r in out} == {len(kept)}
    sign = np.sign(np.array(next(r.whitened for r in out if r.id == 0)) * white[0])
    for r in out:
        i = 3 if r.id is None else r.id
        assert int(r.deviation) == deviation[i]
        np.testing.assert_allclose(np.array(r.whitened) * sign, white[i], atol=1e-8)
        np.testing.assert_allclose(r.explained, explained, rtol=1e-9)
        assert r.identity_error < 1e-10


def test_whitening_of_few_rows(spark):
    of = lambda rows: whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert of([]) == [] and of([(1, None)]) == []
    one = of([(1, [0.5, 2.0])])
    assert one[0].deviation == 0 and list(one[0].whitened) == [None, None] and one[0].identity_error is None and list(one[0].explained) == [0.0, 0.0]
    line = of([(i, [float(i), 2.0 * i, 1.0]) for i in range(5)])
    assert [line[0].whitened[i] is None for i in range(3)] == [False, True, True] and line[0].identity_error < 1e-9
    huge = of([(i, [1e300 * (-1) ** i, float(i)]) for i in range(4)])
    assert {r.id: int(r.deviation) for r in huge} == {i: 16 * 2**106 + (1024 * (4 * i - 6)) ** 2 for i in range(4)}


def test_squares_in_halves():
    rng = np.random.default_rng(2)
    for far in (10, 2**31, 2**45, 2**51):
        a = rng.integers(-far, far, (9, 64))
        assert [int(x) for x in whitening.squares(a).to_pylist()] == [sum(int(c) ** 2 for c in row) for row in a]


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    whole = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = int(np.fix(c / 100)) * 100
        whole[c] = tuple(own.get(base, [])[:h] + t[h:])
    members = defaultdict(list)
    for c, t in whole.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[k] for k in kids[p])
    out = []
    for p, m in members.items():
        ended = ",".join(map(str, sorted(c for c in m if len(whole[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for c in [*range(-3, 30), *range(95, 130), *range(300, 310), 7777, 12345678901]:
        n = int(rng.integers(1, 9))
        rows += [(c, None if rng.random() < 0.1 else int(t), [None, "", "user", "bot"][rng.integers(4)], [None, "", "hi", "ho", "a\nb", "é😀"][rng.integers(6)]) for t in rng.integers(0, 9, n)]
    rows += [(500 + i, t, "u", f"copy {t}") for i in range(40) for t in range(12)]  # a large group of copies
    return rows + [(None, 1, "user", "lost"), (3, 0, "user", "hi"), (3, 0, "user", "hi")]


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_against_plain(spark, seed):
    rows = conversations(seed)
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int")
    out = trie.trie(table.repartition(5))
    assert out.schema.simpleString() == "struct<" + trie.NODE.replace(" ", ":").replace(",:", ",") + ">"
    assert sorted(map(tuple, out.collect()), key=repr) == plain_trie(rows)


def test_trie_of_a_long_conversation_and_hot_nodes(spark, monkeypatch):
    monkeypatch.setattr(trie, "SEGMENT", 64)
    monkeypatch.setattr(trie, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(trie, "HOT", 3)
    monkeypatch.setattr(trie, "ID_BITS", 1)
    rows = [(41, t, "u", f"t{t}") for t in range(1000)] + [r for r in conversations(3) if r[0] is not None and r[0] > 250]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, trie.trie(table.repartition(4)).collect()), key=repr) == plain_trie(rows)
    assert trie.trie(table.where("false")).collect() == []


def test_queries_give_the_contracts_columns(spark):
    types = {
        "op11_line_dedup": "struct<doc_id:bigint,n_lines:bigint,n_dropped:bigint,kept_sha256:string>",
        "op12_whitening": "struct<vec_id:bigint,component:int,n:bigint,deviation:bigint,whitened:double,explained:double,identity_error:double>",
        "op13_prefix_trie": "struct<" + trie.NODE.replace(" ", ":").replace(",:", ",") + ">",
    }
    for name, wanted in types.items():
        assert queries.queries()[name](spark, SF).schema.simpleString() == wanted


def test_line_dedup_query_against_plain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    wanted = {d.doc_id: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, (n, gone, kept) in zip(docs, plain_dedup([d.text for d in docs], 10, 1), strict=True)}
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in queries.op11_line_dedup(spark, SF).collect()} == wanted


def test_trie_query_against_plain(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, queries.op13_prefix_trie(spark, SF).collect()), key=repr) == plain_trie(rows)


# --- faults of earlier operators -----------------------------------------------------------------------
def test_sample_passes_over_long_texts_alone(spark):
    from loamdex.llm import common

    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.when(F.col("id").isin(4, 5, 6, 7), F.repeat(F.lit("x"), 3_000_000)).otherwise(F.col("id").cast("string")).alias("text"))
    labels = spark.range(40).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("toxic"))
    got = common.labelled_sample(docs, labels, "toxic", 100, 4, 2, most_bytes=2_000_000)
    wanted = {str(i) for i in range(40) if i not in (4, 5, 6, 7) and zlib.crc32(str(i).encode()) % 4 != 2}
    assert {t for t, _ in got} == wanted and {y for _, y in got} == {0, 1}
    with pytest.warns(UserWarning, match="class 0"):
        assert common.labelled_sample(docs.where("doc_id in (4, 6, 8) or doc_id % 2 = 1"), labels.where("doc_id in (4, 6) or doc_id % 2 = 1"), "toxic", 100, 4, 2, most_bytes=2_000_000)


def test_any_header_gives_a_record_or_an_error(spark, tmp_path):
    import gzip

    from loamdex.llm import warc

    rng = np.random.default_rng(6)
    values = ["", "x", "-3", "3", "99999999999999999999", "１", "3 ", "4", "2", "+3", "0x3", "\udcff"]
    names = ["Content-Length", "content-length", "CONTENT-LENGTH ", "X-Page-Id", "WARC-Type", "no colon", "X-Payload-Bytes", "WARC-Payload-Digest"]
    data, n = b"", 300
    for _ in range(n):
        head = ["WARC/1.1", str(rng.choice(["WARC-Type: response", "warc-type: revisit", "Warc-Type:x"])), *(f"{rng.choice(names)}:{rng.choice(values)}" for _ in range(rng.integers(0, 5)))]
        data += gzip.compress("\r\n".join(head).encode("utf-8", "surrogateescape") + (b"\r\n\r\nabc\r\n\r\n" if rng.random() < 0.9 else b""))
    (tmp_path / "a.warc.gz").write_bytes(data)
    manifest = spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz", len(data), n)], "path string, bytes long, records long")
    assert warc.read(spark, manifest, 1000).count() == n
    fields, body, wrong = warc.parse(b"WARC/1.1\r\ncontent-LENGTH:3\r\n\r\nabc\r\n\r\n")
    assert body == b"abc" and wrong is None
    assert [warc.parse(b"WARC/1.1\r\nContent-Length: " + v + b"\r\n\r\nabc")[2] is None for v in (b"3", b"4", b"-1", b"x", b"")] == [True, False, False, False, False]
