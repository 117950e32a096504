"""Limits in batch and as a stream, splits and section handling."""

import difflib
from collections import deque

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ticketloom.operators import corpus, knowledge, replay, search, serving, splits
from ticketloom.plans import assist
from ticketloom.streaming import limits


def loop(times, limit=5, span=20.0):
    recent, out = deque(), []
    for t in times:
        while recent and t - recent[0] > span:
            recent.popleft()
        out.append(len(recent) < limit)
        if out[-1]:
            recent.append(t)
    return out


def test_strict_eviction():
    assert serving.admit([0.0] * 5 + [20.0, 20.01], deque()) == [True] * 5 + [False, True]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(0, 100), max_size=40))
def test_never_more_than_limit(times):
    times.sort()
    passed = [t for t, ok in zip(times, serving.admit(times, deque()), strict=True) if ok]
    assert all(sum(a <= t <= a + 20.0 for t in passed) <= 5 for a in passed)


def test_limiter_batch(spark):
    rows = [(c, i, float((i * 7 + c) % 50)) for c in range(3) for i in range(40)]
    got = serving.limiter(spark.createDataFrame(rows, "client long, id long, t double")).collect()
    for c in range(3):
        mine = sorted((r["t"], r["id"], r["admitted"]) for r in got if r["client"] == c)
        assert [a for *_, a in mine] == loop([t for t, *_ in mine])


def test_limiter_stream(spark, tmp_path):
    rows = [(c, i, float(i)) for c in range(2) for i in range(30)]
    spark.createDataFrame(rows, "client long, id long, t double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("client long, id long, t double").parquet(str(tmp_path / "in"))
    query = limits.stream_limiter(stream).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    got = sorted((r["client"], r["t"], r["admitted"]) for r in spark.table("limited").collect())
    for c in range(2):
        assert [a for k, _, a in got if k == c] == loop([float(i) for i in range(30)])


def test_webster_fills_quotas(spark):
    units = spark.createDataFrame([(f"u{i:02}",) for i in range(20)], "unit string")
    got = corpus.webster(units, {"a": 12, "b": 8}).groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in got} == {"a": 12, "b": 8}


def test_collapse_keeps_own_sentences(spark):
    base = "Please send us a screenshot of your payment and the last digits of the card. " * 3
    own = base + "Check the spam folder of your mail first of all. The report is sent by mail within a day of payment."
    rows = [("s", 1, 0, base), ("s", 2, 0, base), ("s", 3, 0, own), ("s", 4, 0, "Something else entirely, about birds in winter.")]
    got = {r["doc_id"]: r["kept"] for r in knowledge.collapse(spark.createDataFrame(rows, "source string, doc_id int, n int, body string")).collect()}
    assert got == {1: True, 2: True, 3: True, 4: True}  # 2 is its document's only section
    rows += [("s", 2, 1, "A second section with other words, which is kept here.")]
    got = {(r["doc_id"], r["n"]): r["kept"] for r in knowledge.collapse(spark.createDataFrame(rows, "source string, doc_id int, n int, body string")).collect()}
    assert not got[2, 0] and got[2, 1]


def test_navigation(spark):
    df = spark.createDataFrame([("1. Web\n2. Apple .", ["Web", "Apple"]), ("Web\nHow to cancel\nOpen the page", ["Web"]), ("", ["Web"])], "body string, heads array<string>")
    assert [r["x"] for r in df.select(knowledge.is_navigation(F.col("body"), F.col("heads")).alias("x")).collect()] == [True, False, True]


def test_fusion_ties(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, doc_id int, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 10, 2), (1, 12, 3)], "query_id int, doc_id int, rank int")
    assert [r["doc_id"] for r in search.fuse(a, b).orderBy("rank").collect()] == [10, 11, 12]


def test_coverage_repair():
    rows = [{"unit": f"u{i:02}", "part": "few" if i < 4 else "dev", "cat": "a" if i < 8 else "b"} for i in range(12)]
    fixed = splits.repair_coverage(rows, "few", "cat", "dev")
    few = [r["cat"] for r in fixed if r["part"] == "few"]
    assert sorted(few) == ["a", "a", "a", "b"]
    assert splits.repair_coverage(fixed, "few", "cat", "dev") == fixed


def test_capabilities_and_citations(spark):
    rows = spark.createDataFrame([("m", "e1", ["seed", "top_p"]), ("m", "e2", ["seed"])], "model string, endpoint string, params array<string>")
    assert tuple(replay.capabilities(rows, "model", "params").first()) == ("m", ["seed"], ["seed", "top_p"])
    df = spark.createDataFrame([("A  quote", "Has a QUOTE in it", "d1", ["d1"]), ("A quote", "Has a quote", "d1", ["d2"]), (" ", "x", "d1", ["d1"]), ("q", None, "d1", ["d1"])], "q string, b string, c string, r array<string>")
    assert [bool(r["x"]) for r in df.select(replay.citation_ok(*(F.col(x) for x in "qbcr")).alias("x")).collect()] == [True, False, False, False]


def test_cells_round_the_binary_value(spark):
    values = [30274.9125, 64760.6925, 0.0625, 0.1875, 2.5, 1e-9, -0.0004, 123456789.1, None, float("nan")]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in rows.select(replay.cell(F.col("v"))).collect()]
    assert got == ["н/д" if v is None else f"{v:.3f}".replace(".", ",") for v in values]  # 30274,912 and not ,913


def test_dense_blocks_give_what_pairs_give(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 8)).round(1)
    x[50:90] = x[3]  # ties go to the smaller id
    rows = [(i, [float(v) for v in x[i]]) for i in range(400)] + [(400, None), (401, [1.0, None] * 4), (402, [float("inf")] + [1.0] * 7), (500, [float("nan")] * 8), (600, [-9.0] * 8), (3, [0.5] * 8)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    asked = vectors.filter("vec_id % 20 = 0 or vec_id = 3")
    d, q = vectors.selectExpr("vec_id doc_id", "embedding"), asked.selectExpr("vec_id query_id", "embedding q")
    plain = search.ranked(d.join(q, F.col("doc_id") != F.col("query_id")).select("query_id", "doc_id", F.round(search.dot("embedding", "q"), 6).alias("score")), 5)
    monkeypatch.setattr(search, "QUERY_BLOCK", 9)
    monkeypatch.setattr(search, "QUERY_TILE", 4)
    found = search.dense(vectors, asked, 5)
    got, want = (sorted(repr((r["query_id"], r["doc_id"], r["score"], r["rank"])) for r in f.collect()) for f in (found, plain))
    assert got == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") >= 3


def test_dense_without_queries(spark):
    vectors = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert search.dense(vectors, vectors.filter("vec_id = 100")).collect() == []


def test_collapse_is_the_greedy_pass(spark):
    rng = np.random.default_rng(3)
    words = "invoice refund card trial page cancel order report support crash".split()
    bodies = []
    for _ in range(14):
        text = list(rng.choice(words, 24))
        bodies += [" ".join(text), " ".join(text[:18] + list(rng.choice(words, 6))), " ".join(text)]
    bodies += ["", "...", "", "x"]
    rows = [("s", i // 2, i % 2, b) for i, b in enumerate(bodies)]
    kept, want = [], {}
    for _, d, n, body in rows:
        mine = knowledge.flat(body)
        twin = next((w for o, w in kept if difflib.SequenceMatcher(None, mine, o).ratio() >= knowledge.RATIO), None)
        pool = " ".join(knowledge.sentences(twin)).lower() if twin is not None else ""
        want[d, n] = twin is None or sum(s.lower() not in pool for s in knowledge.sentences(body)) >= knowledge.OWN
        if want[d, n]:
            kept.append((mine, body))
    for d in {d for d, _ in want}:
        group = [(d, n) for n in (0, 1)]
        if not any(want[g] for g in group):
            want[max(group, key=lambda g: (len(bodies[2 * g[0] + g[1]]), -g[1]))] = True
    frame = spark.createDataFrame(rows, "source string, doc_id int, n int, body string")
    assert {(r["doc_id"], r["n"]): r["kept"] for r in knowledge.collapse(frame).collect()} == want


def test_lexical_gives_what_postings_give(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = ["red", "green", "blue", "Kühe", "sea", "x_1", "sun", "the"]
    text = lambda: " ".join(rng.choice(words, rng.integers(0, 30), p=[0.05, 0.05, 0.1, 0.1, 0.1, 0.1, 0.1, 0.4]))
    rows = [(i, text()) for i in range(300)] + [(1000 + i, "the sea, the SEA and the sun") for i in range(40)]
    rows += [(7, text()), (7, text()), (7, rows[7][1]), (301, None), (302, ""), (303, "?!"), (5000, "nothing of it")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame([(1, "The sun and the sea"), (2, "red red KÜHE"), (3, "absent"), (4, None), (5, "x_1 blue"), (5, "blue green"), (6, "the")], "query_id long, text string")
    terms = asked.select("query_id", F.explode(search.tokens(F.col("text"))).alias("term")).distinct()
    tf = search.postings(docs)
    weights = tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(search.corpus_facts(docs)).select("term", "avgdl", search.idf(F.col("n"), F.col("df")).alias("idf"))
    norm = F.col("tf") + search.K1 * (1 - search.B + search.B * F.col("len") / F.col("avgdl"))
    pairs = terms.join(tf, "term").join(weights, "term").groupBy("query_id", "doc_id")
    by_score = search.ranked(pairs.agg(F.round(F.sum(F.col("idf") * F.col("tf") * (search.K1 + 1) / norm), 6).alias("score")), 20)
    by_overlap = search.ranked(pairs.agg(F.count("*").alias("score")), 20)
    monkeypatch.setattr(search, "QUERY_BLOCK", 2)
    monkeypatch.setattr(search, "CELLS", 50)
    found = search.lexical(docs, asked, 20)
    for got, want in zip(found, (by_score, by_overlap), strict=True):
        assert sorted(map(repr, got.select("query_id", "doc_id", "score", "rank").collect())) == sorted(map(repr, want.select("query_id", "doc_id", "score", "rank").collect()))
    # what is ranked are the best of each task, not a row for each query and matching document
    kept = spark.read.parquet(*found[0].inputFiles()).filter("way = 0 and query_id = 6").count()
    assert 20 <= kept < pairs.count().filter("query_id = 6").count()
    assert search.lexical(docs, asked.filter("query_id = 4"))[1].collect() == []
    assert search.bm25(docs.filter("doc_id < 0"), asked).collect() == []


def test_lexical_takes_a_null_id_as_one_document(spark):
    docs = spark.createDataFrame([(None, "sea sun"), (None, "sea"), (2, "sun")], "doc_id long, text string")
    asked = spark.createDataFrame([("a", "sea sun")], "query_id string, text string")
    assert [(r["query_id"], r["doc_id"], r["score"]) for r in search.lexical(docs, asked)[1].orderBy("rank").collect()] == [("a", None, 3), ("a", 2, 1)]


def test_kept_finds_what_the_matcher_finds(monkeypatch):
    rng = np.random.default_rng(5)
    calls = []

    class Counted(difflib.SequenceMatcher):
        def __init__(self, *args, **kwargs):
            calls.append(1)
            super().__init__(*args, **kwargs)

    syllables = "ti on en er ch ie ou eau la ción de st ß ê k7 xz j ж 字 😀".split()
    texts = []
    for size in (3, 60, 90, 130, 190, 420):
        weights = rng.dirichlet(np.full(len(syllables), 0.5))
        for _ in range(4):
            text = "".join(s + " " * (rng.random() < 0.4) for s in rng.choice(syllables, size, p=weights))
            cut, edited = int(rng.integers(len(text))), list(text)
            for i in rng.choice(len(text), len(text) // 12, replace=False):
                edited[i] = "q"
            texts += [text, text[cut:] + text[:cut], "".join(edited), text[: len(text) * 2 // 3]]
    texts += ["", "", "ab" * 150, "ab" * 300, "ba" * 350, "a" * 500, "a" * 300 + "z" + "b" * 300]
    texts = [texts[i] for i in rng.permutation(len(texts))]
    kept, want, got = knowledge.Kept(), [], []
    for i, text in enumerate(texts):
        pairs = (difflib.SequenceMatcher(None, text, x) for x in texts[:i])
        near = (j for j, m in enumerate(pairs) if m.real_quick_ratio() >= knowledge.RATIO and m.ratio() >= knowledge.RATIO)
        want.append(next(near, None))
    monkeypatch.setattr(difflib, "SequenceMatcher", Counted)
    for text in texts:
        got.append(kept.first(text))
        kept.add(text, text)
    assert got == want and 20 < sum(x is not None for x in want) < len(texts)
    assert len(calls) < 3 * len(texts)  # of some 5,000 pairs


def test_means_add_up_in_the_order_of_the_file(spark, tmp_path):
    groups = [[46484.1, 52514.05, 25164.09, 24933.21], [104223.77, 90420.43, 13484.64, 35533.57], [87306.72, 70678.81, 32480.66, 62067.14]]
    prices = {3 * i + g: x for i in range(2) for g, group in enumerate(groups) for x in [group[::-1] if i else group]}
    rows = [(n, k, 50.0, prices[k][n]) for n in range(4) for k in prices] + [(9, 6, 50.0, None), (9, 0, 50.0, None)]
    lines = spark.createDataFrame(rows, "n int, l_partkey long, l_quantity double, l_extendedprice double").coalesce(1)
    lines.drop("n").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k,) for k in range(8)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    got = {r["p_partkey"]: r["cell"] for r in assist.QUERIES["comparison_cells"](spark, str(tmp_path)).collect()}
    means = {k: ((x[0] + x[1] + x[2]) + x[3]) / 4 for k, x in prices.items()}
    assert got == {k: f"{v:.3f}".replace(".", ",") for k, v in means.items()} | {6: "н/д", 7: "н/д"}
    mean = replay.mean_in_order(F.col("l_extendedprice"), -F.col("n"))  # another order, other last bits
    back = {r["l_partkey"]: r["v"] for r in lines.repartition(5).groupBy("l_partkey").agg(mean.alias("v")).collect()}
    assert back == {k: (((x[3] + x[2]) + x[1]) + x[0]) / 4 for k, x in prices.items()} | {6: None}
    assert any(round(back[k], 3) != round(means[k], 3) for k in means)
