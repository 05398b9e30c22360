"""Edge cases of single operators, against plain definitions."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamdex import schema as S
from loamdex.functions import filters, masking, text as X
from loamdex.operators import components, evaluation as ev, extract, gate, graph, index, ledger, resolve, search, sync, transcripts
from loamdex.sources import records, sinks, vault


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("v")).first()["v"]


def test_ngrams_and_count(spark):
    for t in ["", "a", "ab", "a  b", "aaa\n\naa", "été à la", "x" * 40, " \n "]:
        grams = [(i, t.lower()[i : i + n]) for n in (2, 3) for i in range(len(t) - n + 1) if t.lower()[i : i + n].strip()]
        got = one(spark, X.ngrams(F.lit(t)))
        assert [(g["pos"], g["term"]) for g in got] == grams
        assert one(spark, X.ngram_count(F.lit(t))) == len(grams)


def test_windows(spark):
    t = "".join(random.Random(3).choice("ab ") for _ in range(1234)) + " " * 600
    want = [(i, i * 450, t[i * 450 : i * 450 + 500]) for i in range(-(-len(t) // 450)) if t[i * 450 : i * 450 + 500].strip()]
    assert [tuple(w) for w in one(spark, X.windows(F.lit(t)))] == want
    assert one(spark, X.windows(F.lit(""))) == []


def test_overlapping_occurrences(spark):
    assert one(spark, X.occurrences(F.lit("aaaa"), "aa")) == 3
    assert one(spark, X.occurrences(F.lit("a.b.c"), ".b")) == 1


def test_names(spark):
    assert one(spark, X.norm_name(F.lit("  qmd \n tool (by someone) "))) == "qmd tool"
    assert one(spark, X.merge_key(F.lit("Ｆｕｌｌ-Width 2"))) == "fullwidth2"
    assert one(spark, X.acronym(F.lit("Natural language processing"))) == "nlp"
    assert one(spark, X.acronym(F.lit("Deep learning"))) == ""
    assert one(spark, X.slugify(F.lit("  "))) == "untitled"
    assert one(spark, resolve.folded(F.lit("Jin woo"))) == "jin u" and one(spark, resolve.folded(F.lit("jinwoo"))) == one(spark, resolve.folded(F.lit("진우"))) == "jinu"
    assert one(spark, resolve.romanized(F.lit("한글 x 값"))) == "hangeul x gap"


def test_alias_candidates(spark):
    names = ["Kim Taehyun", "김태현", "taehyunkim", "Natural Language Processing", "NLP", "ABI", "api", "graph store", "graph", "database", "metadatabases", "Graph-Store"]
    rows = [(i, n, "t") for i, n in enumerate(names)] + [(20, "nlp", "u"), (21, None, "t"), (22, " ", "t")]
    e = spark.createDataFrame(rows, "entity_id long, name string, type string")
    assert {tuple(r) for r in resolve.alias_pairs(e).collect()} == {(0, 1, "fused spelling"), (0, 2, "fused spelling"), (3, 4, "abbreviation")}
    korean = spark.createDataFrame([(1, "지누", "t"), (2, "jinoo", "t"), (3, "jinu", "t")], "entity_id long, name string, type string")
    assert {tuple(r) for r in resolve.alias_pairs(korean).collect()} == {(1, 2, "romanised match"), (1, 3, "romanised match")}
    weak = {tuple(r) for r in resolve.weak_aliases(e).collect()}
    assert weak == {(7, 8, "token containment"), (8, 11, "token containment"), (9, 10, "substring")}


def test_weak_aliases_of_repeated_names(spark):
    rows = [(10 * i + c, n, t) for c in range(6) for i, (n, t) in enumerate([("graph store", "t"), ("graph", "t"), (" graph ", "t"), ("graph", "u")])]
    e = spark.createDataFrame(rows, "entity_id long, name string, type string")
    got = [tuple(r) for r in resolve.weak_aliases(e).collect()]
    same = {(0, 10 * 0 + c) for c in range(1, 6)} | {(10, x) for x in [10 + c for c in range(1, 6)] + [20 + c for c in range(6)]} | {(30, 30 + c) for c in range(1, 6)}
    assert sorted(got) == sorted([(0, 10, "token containment"), *((a, b, "same name") for a, b in same)])


def test_frontmatter_and_dates(spark):
    raw = "---\ntitle: \"A b\"\ngenerated_at: 2024-05-06T01\ncreated: 2023-01-01\nno_llm: true\n---\n\nBody here"
    block = X.frontmatter(F.lit(raw))
    date, source = X.dated(block)
    assert one(spark, X.field(block, "title")) == "A b"
    assert (one(spark, date), one(spark, source)) == ("2024-05-06", "generated_at")
    assert one(spark, X.body(F.lit(raw))) == "Body here"
    assert one(spark, X.frontmatter(F.lit("no fence"))) == ""


def test_external_url(spark):
    for u, ok in [("https://a.example.com/x?y", True), ("http://localhost/", False), ("https://u:p@a.com", False), ("ftp://a.com", False), (None, False), ("https://a.b c", False)]:
        assert (one(spark, X.external_url(F.lit(u))) is not None) == ok, u


def test_masking(spark):
    text = 'x AKIA' + "A" * 16 + ' password="Abcdefgh12345678" gone'
    row = masking.masked(spark.createDataFrame([(text,), (None,)], "text string")).collect()
    assert row[0]["mask_counts"] == {"AWS_KEY": 1, "GENERIC_SECRET": 1} and "Abcdefgh" not in row[0]["text"] and "password=" in row[0]["text"]
    assert row[1]["text"] is None and row[1]["mask_counts"] == {}
    with pytest.raises(ValueError):
        masking.refuse_leaks(spark.createDataFrame([(text,)], "text string"))


def test_every_restored_mask(spark):
    value = "Abcdefgh12345678"
    cases = [("ANTHROPIC_KEY", "see sk-ant-api03-" + "a" * 24), ("ANTHROPIC_OAUTH", "see sk-ant-oat01-" + "a" * 24)]
    cases += [("OWN_TOKEN", f"see {before}own_" + "a" * 32) for before in ("", "/u/", "%2F", "%252F", "\\n", "\\x2F", "\\u002F", "\ud1a0\ud070\uc740")]
    cases += [("POSTMARK_TOKEN", "X-Postmark-Server-Token: " + "a1-" * 9)]
    labels = "credential credentials pass pwd pw DB_PASS datadog dd-api dd_api accountkey secret_key auth-token refresh_token \ube44\ubc00\ubc88\ud638 \uc554\ud638".split()
    cases += [("GENERIC_SECRET", f'{label}={value}') for label in labels] + [("GENERIC_SECRET", f'{{"pwd": "{value}"}}')]
    frame = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "i int, text string")
    known = masking.with_own(masking.own_token("OWN_TOKEN", "own_"))
    for r in masking.masked(frame, patterns=known).collect():
        name, text = cases[r["i"]]
        assert r["mask_counts"] == {name: 1} and f"[REDACTED:{name}]" in r["text"], text
        assert value not in r["text"] and "own_" not in r["text"] and "sk-ant" not in r["text"], text
    assert all(cases[r["i"]][0] in r["names"] for r in frame.select("i", masking.leaks("text", known).alias("names")).collect())
    kept = spark.createDataFrame([("file_own_" + "a" * 32,), ("1Password:domain-key-acls-of-it",)], "text string")
    assert all(r["mask_counts"] == {} for r in masking.masked(kept, patterns=known).collect())
    assert masking.masked(spark.createDataFrame([("X-Postmark-Server-Token: " + "a1-" * 9,)], "text string")).first()["text"] == "X-Postmark-Server-Token: [REDACTED:POSTMARK_TOKEN]"


def test_masking_is_worked_out_once_and_needs_hold(spark):
    from loamdex.operators import hygiene

    frame = spark.createDataFrame([("password = " + "A1" * 16,), ("PassWord=" + "b2" * 8 + " COOKIE: sid=abcdefgh1",)], "text string")
    changed = hygiene.remask(frame)
    plan = changed._jdf.queryExecution().optimizedPlan().toString()
    pattern = dict(masking.PATTERNS)["JWT"]
    assert 0 < plan.count(pattern) <= 2 and set(masking.NEEDS) == set(dict(masking.PATTERNS))  # one count, one replacement
    assert [r["mask_counts"] for r in changed.orderBy("text").collect()] == [{"GENERIC_SECRET": 1, "COOKIE": 1}, {"GENERIC_SECRET": 1}]


def test_masking_against_plain(spark):
    import re

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = [(-1, "a password=Abcdefgh12345678 b\nAuthorization: Basic " + "QWxhZGRpbjpvcGVuIHNlc2FtZQ== https://u:secret99@h.io/ Cookie: sid=abcdefgh123"), (-2, ""), (-3, "sk-proj-" + "a1" * 20 + " postgres://u:longpass@h/db " + "hf_" + "b" * 40)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    got = {r["doc_id"]: (r["text"], r["mask_counts"]) for r in masking.masked(docs).collect()}
    plain = [(n, re.compile(p.replace(r"\z", r"\Z"))) for n, p in masking.PATTERNS]
    seen = set()
    for r in docs.collect():
        text, counts = r["text"], {}
        for name, pattern in plain:
            text, n = pattern.subn(lambda m, name=name: (m.group(1) if m.lastindex else "") + f"[REDACTED:{name}]", text)
            counts |= {name: n} if n else {}
        assert got[r["doc_id"]] == (text, counts)
        seen |= counts.keys()
    assert len(seen) > 5


def test_filter_language():
    assert filters.parse('"a b') == [(False, "path", "a b")] and filters.parse("file: x -file: tag:") == [(False, "path", "x")] and filters.parse("") == []
    assert filters.parse('foo:bar FILE:"A  b"c -"x') == [(False, "path", "foo:bar"), (False, "file", "a  b"), (False, "path", "c"), (True, "path", "x")]
    assert filters.parse('a file:B -path:"c d" -') == [(False, "path", "a"), (False, "file", "b"), (True, "path", "c d")]


def test_vault(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/one.md").write_text("---\ntitle: One\nsources:\n  - type: slack\n---\n" + "word " * 30)
    (tmp_path / "a/two.md").write_text("short")
    (tmp_path / "a/index.md").write_text("x" * 100)
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe" + b"a" * 80)
    (tmp_path / "s.md").write_text("---\nresource: claude-session://1\n---\n" + "y" * 80)
    d = {r["path"]: r for r in vault.documents(spark, str(tmp_path)).collect()}
    assert {p: r["status"] for p, r in d.items()} == {"a/one.md": "ok", "a/two.md": "short", "bad.md": "unreadable", "s.md": "ok"}
    assert (d["a/one.md"]["title"], d["a/one.md"]["origin"], d["s.md"]["origin"], d["s.md"]["agent"]) == ("One", "slack", "session", "claude")
    assert vault.indexable_count(vault.documents(spark, str(tmp_path)), 1) == 1


def test_json_lines_and_transcripts(spark, tmp_path):
    (tmp_path / "dev1.jsonl").write_text('{"source_type":"s","source_id":"1","seq":1}\nnot json\n{"source_type":"s","source_id":"1","seq":2,"device":"d"}\n')
    assert sorted((r["seq"], r["device"]) for r in records.ledger(spark, str(tmp_path)).collect()) == [(1, "dev1"), (2, "d")]
    (tmp_path / "t").mkdir()
    (tmp_path / "t/x.jsonl").write_text('{"type":"user","sessionId":"s","timestamp":"1","message":{"role":"user","content":"hello"}}\n{"type":"assistant","sessionId":"s","timestamp":"2","message":{"role":"assistant","content":[{"type":"text","text":"hi"},{"type":"tool_use","name":"Read"}]}}\n')
    got = records.transcript(spark, str(tmp_path / "t")).orderBy("turn").collect()
    assert [r["text"] for r in got] == ["hello", "hi\n[tool:Read]"]
    assert records.alias_rules("A B: [x, 'y']\nC:\n  - z # note\n") == [("A B", "A B"), ("x", "A B"), ("y", "A B"), ("C", "C"), ("z", "C")]
    assert records.homonym_rules("N:\n  - one: [p, q]\n  - two: [r]\n") == [("N", "p", "one", 0), ("N", "q", "one", 0), ("N", "r", "two", 1)]


def test_gate(spark):
    rows = spark.createDataFrame([(1, [5]), (2, [5, 6]), (3, [6, 7]), (4, [])], "id int, doc_ids array<int>")
    blocked = spark.createDataFrame([(5,)], "doc_id int")
    got = {r["id"]: r["verdict"] for r in gate.verdicts(rows, blocked, "id").collect()}
    assert got == {1: "block", 2: "redact", 3: "pass", 4: "block"}
    assert {r["verdict"] for r in gate.verdicts(rows, blocked.where("false"), "id").collect()} == {"pass"}


def test_minmax_and_fuse(spark):
    s = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 5.0), ("b", 1, 0.0), ("b", 2, 10.0)], "comp string, doc_id int, score double")
    got = {(r["comp"], r["doc_id"]): r["norm"] for r in search.minmax(s).collect()}
    assert got == {("a", 1): 1.0, ("a", 2): 1.0, ("b", 1): 0.0, ("b", 2): 1.0}
    with pytest.raises(ValueError):
        search.fuse(search.minmax(s), (1.0,), ("a", "b"))


def test_bm25_against_plain(spark):
    texts = {1: "the cat sat", 2: "a dog", 3: "cat cat aaa", 4: "   "}
    c = index.chunk_table(spark.createDataFrame(list(texts.items()), "doc_id int, text string"))
    got = {r["doc_id"]: r["score"] for r in search.bm25(c, "cat aa").collect()}
    terms = X.query_terms("cat aa")
    grams = {d: [t.lower()[i : i + n] for n in (2, 3) for i in range(len(t) - n + 1) if t[i : i + n].strip()] for d, t in texts.items() if t.strip()}
    mean, want = sum(map(len, grams.values())) / len(grams), {}
    for d, g in grams.items():
        for t in terms:
            if tf := g.count(t):
                df = sum(t in x for x in grams.values())
                want[d] = want.get(d, 0) + np.log((len(grams) - df + 0.5) / (df + 0.5) + 1) * tf * (S.K1 + 1) / (tf + S.K1 * (1 - S.B + S.B * len(g) / mean))
    assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-9 for d in want)
    assert search.bm25(c, " ").count() == 0


def test_components_random(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(50)] + [(7, 7), (100, 100)]
    parent = {n: n for e in edges for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {n: find(n) for n in parent}
    chain = spark.createDataFrame([(i, i + 1) for i in range(50)], "src long, dst long")
    assert {r["component"] for r in components.connected_components(chain).collect()} == {0}
    assert components.connected_components(chain.where("false")).count() == 0


def test_graph_paths(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (1, 4), (8, 9)], "src long, dst long")
    assert graph.shortest_path(e, 0, 3) == [0, 1, 2, 3] and graph.shortest_path(e, 2, 2) == [2] and graph.shortest_path(e, 0, 9) == []
    long = spark.range(0, 34).selectExpr("id AS src", "id + 1 AS dst")
    assert graph.shortest_path(long, 0, 34) == list(range(35))
    roots = spark.createDataFrame([(0,)], "id long")
    assert {r["id"]: r["depth"] for r in graph.within(e, roots, 2).collect()} == {0: 0, 1: 1, 2: 2, 4: 2}


def test_louvain_splits_cliques(spark):
    cliques = [(a, b) for base in (0, 10) for a, b in itertools.combinations(range(base, base + 5), 2)] + [(0, 10)]
    got = {r["id"]: r["community"] for r in graph.communities(spark.createDataFrame(cliques, "src long, dst long")).collect()}
    assert len({got[i] for i in range(5)}) == 1 and len({got[i] for i in range(10, 15)}) == 1 and got[0] != got[10]
    assert graph.communities(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_seed_hash(spark):
    def plain(text):
        h = 2166136261
        for c in text:
            h = (h ^ ord(c)) * 16777619 % 2**32
        return h

    names = ["", "a", "note/one.md", "메모", "é" * 50]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(graph.fnv1a("n").alias("h")).collect()
    assert [r["h"] for r in got] == [plain(n) for n in names]


def test_sync(spark):
    with pytest.raises(ValueError):
        sync.guard_shrink(66, 100)
    with pytest.raises(ValueError):
        sync.guard_shrink(1, None)
    sync.guard_shrink(67, 100)
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2")], "path string, content_hash string")
    new = spark.createDataFrame([("c", "3"), ("x", "1"), ("y", "1")], "path string, content_hash string")
    assert sorted(map(tuple, sync.renames(old, new).collect())) == [("a", "x"), ("b", "y")]


def test_build_canon(spark):
    s = spark.createDataFrame([("hermes", 5, 1), ("her-mes", 9, 1), ("~/.hermes", 9, 9), ("x y", 1, 1), ("xy", 1, 1), ("!!", 1, 1)], "name string, touches int, docs int")
    key = lambda n: X.merge_key(n, True)
    got = {r["name"]: r["canon"] for r in resolve.build_canon(s, key=key).collect()}
    assert got == {"hermes": "hermes", "her-mes": "her-mes", "~/.hermes": "~/.hermes", "x y": "x y", "xy": "x y", "!!": "!!"}
    rules = spark.createDataFrame([("hermes", "Hermes")], "name string, canon string")
    got = {r["name"]: r["canon"] for r in resolve.build_canon(s, rules, key).collect()}
    assert (got["hermes"], got["her-mes"], got["~/.hermes"]) == ("Hermes", "Hermes", "~/.hermes")


def test_alias_pairs(spark):
    e = spark.createDataFrame([(1, "hwang taehyun", "actor"), (2, "taehyunhwang", "actor"), (3, "Natural Language Processing", "concept"), (4, "nlp", "concept"), (5, "nlp", "tool")], "entity_id int, name string, type string")
    assert sorted((r["a"], r["b"], r["why"]) for r in resolve.alias_pairs(e).collect()) == [(1, 2, "fused spelling"), (3, 4, "abbreviation")]


def test_louvain_broadcasts_nothing(spark, monkeypatch):
    plans, stored = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stored(df, label))
    edges = [(a, b) for c in (0, 10) for a in range(c, c + 5) for b in range(a + 1, c + 5)] + [(0, 10)]
    found = {r["id"]: r["community"] for r in graph.communities(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert found == {i: i // 10 * 10 for c in (0, 10) for i in range(c, c + 5)}
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_signed_rank_and_bh(spark):
    w, p = ev.signed_rank(np.arange(1, 11), np.zeros(10))
    assert w == 0 and 0.004 < p < 0.006
    assert ev.signed_rank(np.ones(3), np.ones(3)) == (0.0, 1.0)
    t = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "comparison string, p double")
    assert {r["comparison"]: round(r["p_bh"], 6) for r in ev.benjamini_hochberg(t).collect()} == {"a": 0.03, "b": 0.04, "c": 0.04}


def test_compare_in_blocks_against_plain(spark, monkeypatch):
    monkeypatch.setattr(ev, "DRAWN_TOGETHER", 16)
    rng = np.random.default_rng(3)
    sides = {"x": (rng.integers(0, 9, 400) / 4, rng.integers(0, 8, 400) / 4), "y": (rng.normal(0.2, 1, 300), rng.normal(0, 1, 300)), "z": (np.ones(5), np.ones(5))}
    rows = [(c, float(a), float(b)) for c, (x, y) in sides.items() for a, b in zip(x, y, strict=True)]
    scores = spark.createDataFrame(rows, "comparison string, a double, b double").repartition(5)
    for r in ev.compare(scores, resamples=600).collect():
        a, b = sides[r["comparison"]]
        w, p = ev.signed_rank(a, b)
        d, sd = a - b, (a - b).std(ddof=1)
        assert r["n"] == len(a) and r["delta"] == pytest.approx(d.mean()) and r["w"] == pytest.approx(w) and r["p"] == pytest.approx(p) and r["dz"] == pytest.approx(d.mean() / sd if sd else 0.0)
        off = 1.96 * d.std() / len(d) ** 0.5
        assert r["low"] == pytest.approx(d.mean() - off, abs=0.3 * off) and r["high"] == pytest.approx(d.mean() + off, abs=0.3 * off)


def test_scaling_holds_no_component_in_a_task(spark):
    s = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 4.0), ("b", 1, 3.0), (None, 1, 1.0)], "comp string, doc_id int, score double")
    for f in (search.minmax, search.zscore, search.small_components_out, lambda x: search.theoretical_minmax(x, {"a": 0.0})):
        assert "Window" not in f(s)._jdf.queryExecution().executedPlan().toString()
        assert f(s).count() == (3 if f is search.small_components_out else 4)  # a null name is no component that may stay
    weights = spark.createDataFrame([(0, "a", 0.25), (0, "b", 0.75), (1, "b", 1.0)], "gid int, comp string, w double")
    got = {(r["gid"], r["doc_id"]): r["score"] for r in ev.sweep(search.minmax(s).withColumn("qid", F.lit("q")), weights).collect()}
    assert got == {(0, 1): 0.75, (0, 2): 0.25, (1, 1): 1.0}


def test_revisions_fold(spark):
    rng = random.Random(2)
    revs = [rng.randrange(6) for _ in range(30)]
    want, last = [], 0
    for r in revs:
        last = max(r, last + 1)
        want.append(last)
    df = spark.createDataFrame([("k", i, r) for i, r in enumerate(revs)], "k string, ord int, rev int")
    assert [r["revision"] for r in ledger.merged_revisions(df, ["k"]).orderBy("ord").collect()] == want


def test_chain_roots_refuse_loops(spark):
    with pytest.raises(ValueError):
        transcripts.chain_roots(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "id int, parent int"), most=3)


def test_publish_and_streaming(spark, tmp_path):
    docs = spark.createDataFrame([(1, "vault"), (2, "web")], "doc_id int, origin string")
    where = sinks.publish({"documents": docs}, str(tmp_path), "v1", {"model": "m"}, {"documents": 2})
    assert spark.read.parquet(f"{where}/documents").count() == 2 and spark.read.parquet(f"{where}/meta").count() == 1
    with pytest.raises(ValueError):
        sinks.publish({"documents": docs}, str(tmp_path), "v2", {}, {"documents": 20})
    from loamdex.streaming import incremental

    docs.write.parquet(str(tmp_path / "in"))
    seen = []
    incremental.document_sync(spark, str(tmp_path / "in"), "doc_id int, origin string", lambda df, _: seen.append(df.count()), str(tmp_path / "cp")).awaitTermination()
    assert sum(seen) == 2


def test_extract_and_encode(spark):
    v = extract.hashed_vectors(["a b", ""])
    assert abs(np.linalg.norm(v[0]) - 1) < 1e-6 and not v[1].any()
    assert extract.capitalised("Alpha met Beta Gamma")["relationships"][0]["target"] == "Beta Gamma"
