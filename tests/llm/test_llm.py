"""The training-data operators against brute force, exact round trips and held-out accuracy, with awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from ticketloom.llm import bpe, fingerprints, langid, licenses, packing, quality, simhash, substring, suffixtree, toxicity
from ticketloom.llm.components import components
from ticketloom.session import load, materialise

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, loom_block string, score string"
rnd = random.Random(3)
PASSAGE = " ".join(f"w{rnd.randrange(50)}" for _ in range(60))
LONG = " ".join(f"x{rnd.randrange(3000)}" for _ in range(30_000))
AWKWARD = [
    (1, PASSAGE, "en", "a", 1, "b", "s"), (2, "Before. " + PASSAGE + "\nafter it", "en", None, None, None, None), (3, None, None, None, None, None, None), (4, "", "en", "a", 0, "b", "s"),
    (5, " \t\n\x0b ", "en", "a", 5, "b", "s"), (6, "Häuser 漢字 É İ ΣΑΣ <|endoftext|> don't!", "de", "a", 9, "b", "s"), (7, LONG, "en", "a", 9, "b", "s"), (8, PASSAGE, "en", "a", 1, "b", "s"),
    (8, PASSAGE, "en", "a", 1, "b", "s"), (9, "one", "en", "a", 3, "b", "s"), (9, "two words", "en", "a", 9, "b", "s"), (10, PASSAGE + " " + PASSAGE, "en", "a", 9, "b", "s"), (11, "!?. 123", "fr", "a", 7, "b", "s"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return load(spark, SF, "documents")


def texts(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


def split(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def rows(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)


def repeats(pairs, k=20):
    first = {}
    words = [split(t) for _, t in pairs]
    order = sorted(range(len(pairs)), key=lambda i: pairs[i][0])
    for i in order:
        for p in range(len(words[i]) - k + 1):
            key = tuple(words[i][p : p + k])
            first[key] = min(first.get(key, (pairs[i][0], p)), (pairs[i][0], p))
    out = []
    for i in order:
        w, gone = words[i], set()
        for p in range(len(w) - k + 1):
            if first[tuple(w[p : p + k])] < (pairs[i][0], p):
                gone.update(range(p, p + k))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((pairs[i][0], len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches", [1, 5])
def test_substring_awkward(awkward, batches):
    got = substring.remove_repeats(awkward, batches=batches, fan_in=2)
    assert rows(got, "doc_id", "loom_n_words", "loom_n_removed", "loom_sha256") == repeats(texts(awkward))
    assert set(awkward.columns) <= set(got.columns)


def test_substring_documents(docs):
    got = substring.remove_repeats(docs)
    assert rows(got, "doc_id", "loom_n_words", "loom_n_removed", "loom_sha256") == repeats(texts(docs))


@pytest.mark.parametrize("batches", [1, 5])
def test_substring_awkward_passes(awkward, monkeypatch, batches):
    monkeypatch.setattr(substring, "BUCKET_BYTES", 5000)
    got = substring.remove_repeats(awkward, batches=batches, fan_in=2)
    assert rows(got, "doc_id", "loom_n_words", "loom_n_removed", "loom_sha256") == repeats(texts(awkward))


def test_substring_passes(docs, spark, monkeypatch):
    """The runs on disk hold a share of the windows at once, and no repeat is lost between shares."""
    held, add = [], substring.FingerprintIndex.add

    def on_disk(index):
        return sum(f.stat().st_size for run in index.runs for f in Path(run.removeprefix("file:")).rglob("*.parquet"))

    def counted(self, *args, **kinds):
        found = add(self, *args, **kinds)
        held.append(on_disk(self))
        return found

    size = sum(len((t or "").encode()) for _, t in texts(docs))
    monkeypatch.setattr(substring, "BUCKET_BYTES", size // 24)
    whole = substring.FingerprintIndex(spark, size)
    whole.add(docs)
    all_windows = on_disk(whole)
    whole.close()
    monkeypatch.setattr(substring.FingerprintIndex, "add", counted)
    got = substring.remove_repeats(docs)
    assert rows(got, "doc_id", "loom_n_words", "loom_n_removed", "loom_sha256") == repeats(texts(docs))
    assert 0 < max(held) < 0.5 * all_windows


def brute_fingerprint(text):
    w = split((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in ([b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)])]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, ids):
    up = list(range(len(prints)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        least[top(i)] = min(least.get(top(i), d), d)
    return [least[top(i)] for i in range(len(ids))]


@pytest.mark.parametrize("name", ["awkward", "docs"])
def test_simhash(request, name):
    frame = request.getfixturevalue(name)
    pairs = texts(frame)
    prints = [brute_fingerprint(t) for _, t in pairs]
    want = sorted(((d, f"{p:016x}", c) for (d, _), p, c in zip(pairs, prints, brute_components(prints, [d for d, _ in pairs]), strict=True)), key=repr)
    assert rows(simhash.near_duplicates(frame), "doc_id", "fingerprint", "component_id") == want


@pytest.mark.parametrize("group", [8192, 20, 3])
def test_simhash_large_groups(spark, group):
    base, found = rnd.getrandbits(64), set()
    for _ in range(200):
        x = base
        for _ in range(rnd.randint(0, 4)):
            x ^= 1 << rnd.randrange(64)
        found.add(x)
    prints = sorted(found)
    frame = spark.createDataFrame([(simhash.signed(x), i) for i, x in enumerate(prints)], "fp long, rep long")
    got = {r["vertex"]: r["component"] for r in components(simhash.link(frame, group=group)).collect()}
    assert [got.get(i, i) for i in range(len(prints))] == brute_components(prints, list(range(len(prints))))


def test_thresholds_keep_the_pigeonhole():
    for n in (10, 10**5, 10**9):
        chosen = simhash.plan(n, np.full((64, 64), n // 4) + np.diag([n // 4] * 64))
        assert sum(t + 1 for _, t in chosen) == simhash.TAU + 1


def test_language(docs, awkward, empty):
    model = langid.train(docs.filter(~langid.held_out()))
    got = langid.identify(docs, model).filter(langid.held_out()).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)
    odd = {(r["doc_id"], r["text"]): (r["lang_pred"], r["score"]) for r in langid.identify(awkward, model).collect()}
    for key in ((3, None), (4, ""), (5, " \t\n\x0b "), (11, "!?. 123")):
        assert odd[key] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in odd.values())
    assert langid.identify(empty, langid.train(empty)).count() == 0


def test_bpe(awkward, docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_tokenizer())
    for frame in (awkward, docs):
        want = []
        for doc, text in texts(frame):
            ids = library.encode(text or "", add_special_tokens=False).ids
            raw = b"".join(i.to_bytes(4, "little") for i in ids)
            want.append((doc, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        assert rows(bpe.encode_documents(frame), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert bpe.encode_documents(empty).count() == 0


def test_automaton_arcs_follow_the_gadgets():
    automaton = bpe.tokenizer(bpe.read_spec(bpe.default_tokenizer())).automaton
    ids = [rnd.randrange(49_000) for _ in range(4000)]
    assert all(automaton._arc(a, b) == automaton._has(automaton.target[a], b, 1 << 59) for a, b in zip(ids, ids[1:], strict=False))


def brute_quality(text):
    w, text = split(text), text or ""
    lines = [x for x in text.split("\n") if split(x)]
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    n = len(w)
    return (n, sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover), n < 20 or 100 * len(cover) > 30 * n)


def test_quality_metrics(awkward, docs):
    for frame in (awkward, docs):
        got = rows(quality.metrics(frame), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        assert got == sorted(((d, *brute_quality(t)) for d, t in texts(frame)), key=repr)


def test_quality_cutoffs_are_certified(spark):
    rows_ = [(i, "word " * 5 + " ".join(f"v{i}x{j}" for j in range(30)) + (" ####" * 9 if i % 100 == 0 else ""), "en") for i in range(1500)]
    frame = spark.createDataFrame(rows_, "doc_id long, text string, lang string")
    labels = frame.select("doc_id", F.lit(1).alias("quality"))
    measured = quality.metrics(frame).cache()
    table = quality.cutoffs(measured, labels).first()
    n, risk = table["n_labelled"], quality.ALPHA

    def tail(k):
        return 1.0 if k >= n * risk else sum(math.comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(k + 1))

    lost = [measured.filter("NOT base_failed AND " + quality.rejected_at(j)).count() for j in range(quality.STEPS)]
    assert lost == sorted(lost) and n == 1500
    want = next((j for j, k in enumerate(lost) if tail(k) > quality.DELTA), quality.STEPS)  # one stratum
    assert table["steps"] == want > 0
    few = quality.cutoffs(measured, labels.limit(20)).first()
    assert few["steps"] == 0  # too few labels
    judged = quality.judge(frame, labels)
    assert judged.filter("base_failed and kept").count() == 0
    assert {r["doc_id"] for r in judged.filter("kept").collect()} == {r["doc_id"] for r in measured.filter(f"NOT base_failed AND NOT ({quality.rejected_at(want - 1)})").collect()}
    assert quality.judge(frame, labels.limit(0)).filter("kept = base_failed").count() == 0
    assert sorted(r["doc_id"] for r in quality.keep_good(frame, labels).collect()) == sorted(r["doc_id"] for r in judged.filter("kept").collect())


def test_quality_awkward(awkward, empty, spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (7, None)], "doc_id long, quality int")
    kept = quality.keep_good(awkward, labels)
    assert kept.columns == awkward.columns and kept.count() == quality.judge(awkward, labels).filter("kept").count()
    assert quality.judge(empty, labels).count() == quality.keep_good(empty, labels).count() == 0


def test_quality_equals_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.01/{t}.parquet'")
    cursor = con.execute(quality.sql())
    names = [d[0] for d in cursor.description]
    got = quality.judge(load(spark, "/root/testdata/sf0.01", "documents"), load(spark, "/root/testdata/sf0.01", "labels"))
    assert rows(got, *names) == sorted(cursor.fetchall(), key=repr)
    assert got.filter("NOT base_failed AND NOT kept").count() > 0


def brute_stage(pairs, width=5, least=0.8):
    """The ids that stay, by all pairs of texts."""
    up, shingles = list(range(len(pairs))), []
    for _, t in pairs:
        w = split((t or "").translate({c: c + 32 for c in range(65, 91)}))
        shingles.append({b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            a, b = shingles[i], shingles[j]
            if a == b or len(a & b) >= least * len(a | b):
                x, y = top(i), top(j)
                up[max(x, y, key=lambda k: pairs[k][0])] = min(x, y, key=lambda k: pairs[k][0])
    return sorted({pairs[top(i)][0] for i in range(len(pairs))})


def test_near_copies_of_the_stage(spark):
    r = random.Random(5)
    base, made = [f"w{r.randrange(4000)}" for _ in range(300)], []
    for i in range(60):  # copies with up to six words replaced; texts of their own
        w = list(base)
        for _ in range(i % 4):
            w[r.randrange(300)] = f"n{r.randrange(9999)}"
        made += [(i, " ".join(w)), (1000 + i, " ".join(f"u{r.randrange(4000)}" for _ in range(120)))]
    odd = [(None, "a b c"), (None, "x y z q"), (None, "x y z q"), (5000, None), (5001, "")]
    frame = spark.createDataFrame(made + odd, "doc_id long, text string")
    got = [(x["doc_id"], x["text"]) for x in simhash.keep_one(frame).collect()]
    assert sorted(d for d, _ in got if d is not None) == [*brute_stage(made), 5000]
    assert sorted(t for d, t in got if d is None) == ["a b c", "x y z q"]
    shared = spark.createDataFrame([(7, t) for _, t in made], "doc_id long, text string")
    assert shared.count() > simhash.keep_one(shared).count() == len(brute_stage(made))


def test_links_hold_where_others_fail():
    r, tau = random.Random(9), 6
    base = [r.getrandbits(64) for _ in range(400)]
    sets = [set(base[i % 40 :]) | {r.getrandbits(64) for _ in range(i % 7 * 12)} for i in range(120)]
    prints = np.unique(np.array([r.getrandbits(6) for _ in range(400)], np.uint64))
    sets = sets[: len(prints)]
    brief = np.frombuffer(b"".join(simhash.bins(np.array(sorted(x), np.uint64)) for x in sets), np.uint8).reshape(-1, simhash.BINS)
    n = len(sets)
    share = [[float(simhash.likely(brief, np.array([i]), np.array([j]))[0]) for j in range(n)] for i in range(n)]

    def parts(edges):
        up = list(range(n))
        for _ in range(n):
            for x, y in edges:
                up[x] = up[y] = min(up[x], up[y])
        return up

    for made in (simhash.likely_forest(prints[:n], brief, tau, 16), simhash.probe_forest(prints[:n], list(range(6)), tau, brief)):
        assert len(made) < n
        for least in simhash.TIERS:
            want = parts([(i, j) for i in range(n) for j in range(i) if share[i][j] >= least])
            assert parts([(i, j) for i, j in made if share[i][j] >= least]) == want


def test_likeness_is_jaccard():
    a, b = {rnd.getrandbits(64) for _ in range(300)}, {rnd.getrandbits(64) for _ in range(80)}
    for x, y in ((a, a | b), (a, b), (set(), set()), (a, set())):
        pack = lambda s: np.unique(np.array(sorted(s), np.uint64))[: simhash.SKETCH].tobytes()
        assert simhash.likeness(pack(x), pack(y)) == pytest.approx(len(x & y) / len(x | y) if x | y else 1.0)


@pytest.mark.parametrize(("n", "k", "p"), [(500, 1, 0.01), (50, 0, 0.1), (3000, 10, 0.01), (100_000, 850, 0.01)])
def test_binomial_tail(spark, n, k, p):
    got = spark.sql(f"select {quality.binomial_tail('k', 'n', f'{p}D')} x from (select {n}L n, {k}L k)").first()["x"]
    want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
    assert got == pytest.approx(want, rel=1e-8)


def test_licences(spark, docs):
    model = licenses.train(docs)
    said = [(1, "Intro line.\nLicensed under the Apache License, Version 2.0"), (2, "all the work is done under the sun"), (3, None), (4, "xx released under the MIT License yy"), (4, ""), (5, "This work is licensed under CC BY-NC 4.0.")]
    got = {(r["doc_id"], r["families"]) for r in licenses.licences(spark.createDataFrame(said, "doc_id long, text string"), model).collect()}
    assert {(1, "apache"), (2, ""), (3, ""), (4, "mit"), (5, "cc-by-nc")} <= got
    spans = licenses.scan(spark.createDataFrame(said[:1], "doc_id long, text string"), model).first()
    assert said[0][1][spans["start"] : spans["start"] + spans["length"]] == said[0][1].split("\n")[1]


@pytest.mark.parametrize("bucket", [suffixtree.BUCKET_BYTES, 50_000])
def test_suffix_tree(awkward, docs, empty, monkeypatch, bucket):
    monkeypatch.setattr(suffixtree, "BUCKET_BYTES", bucket)
    condition = "crc32(cast(cast(doc_id as string) as binary)) % 10 <> 0"
    for frame in (awkward, docs):
        pairs = texts(frame)
        tokens = [[x.lower() for x in split(t)] + [None] for _, t in pairs]
        train = [zlib.crc32(str(d).encode()) % 10 != 0 for d, _ in pairs]
        c = Counter(w for t, use in zip(tokens, train, strict=True) if use for w in t)
        n, v = sum(c.values()), len(c)
        want = sorted((d, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 4)) for (d, _), t in zip(pairs, tokens, strict=True))
        found = suffixtree.score_documents(frame, condition).collect()
        assert sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in found) == want
        assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in found)
    held = [r for r in found if zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert suffixtree.score_documents(empty, condition).count() == 0


def test_packing(awkward, docs, empty):
    tok = bpe.tokenizer(bpe.read_spec(bpe.default_tokenizer()))
    for frame in (awkward, docs):
        got = packing.pack_documents(frame).collect()
        by_sequence, by_doc = {}, Counter()
        for r in got:
            by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            by_doc[r["doc_id"]] += r["length"]
        for pieces in by_sequence.values():
            end = 0
            for offset, length in sorted(pieces):
                assert offset == end and length > 0
                end += length
            assert end <= packing.WINDOW
        want = Counter()
        ids_of = {}
        for d, t in texts(frame):
            ids_of.setdefault(d, []).append(tok.encode((t or "").encode()) + (2).to_bytes(4, "little"))
            want[d] += len(ids_of[d][-1]) // 4
        assert by_doc == want
        for r in got:
            pieces = [zlib.crc32(ids[4 * r["start"] : 4 * (r["start"] + r["length"])]) for ids in ids_of[r["doc_id"]] if len(ids) // 4 == r["doc_tokens"]]
            assert r["ids_crc32"] in pieces
    assert 1 - sum(want.values()) / (len(by_sequence) * packing.WINDOW) < 0.05
    assert packing.pack_documents(empty).count() == 0


def test_differencing_balances():
    sizes = np.array([rnd.randrange(1, 1000) for _ in range(400)])
    where = packing.difference(sizes, 20)
    sums = np.bincount(where, sizes, 20)
    assert sums.max() - sums.min() <= 10


def test_fingerprints(awkward, docs, empty):
    for frame in (awkward, docs):
        pairs = sorted(((d, t or "") for d, t in texts(frame)), key=lambda x: (-x[0], x[1]))
        want = []
        for i, (d, t) in enumerate(pairs):
            n, after = len(t) // 3, pairs[(i + 1) % len(pairs)][1]
            want.append((d, len(t), hashlib.sha256((t[: len(t) - n] + after[:n]).encode()).hexdigest()))
        found = fingerprints.fingerprint_versions(frame)
        assert rows(found, "doc_id", "n_chars", "edited_sha256") == sorted(want, key=repr)
        by_text = {}
        for r in found.join(frame.select("doc_id", "text").dropDuplicates(), "doc_id").filter("length(coalesce(text, '')) = n_chars").collect():
            by_text.setdefault(r["text"] or "", set()).add(r["fingerprint"])
            assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert max(map(len, by_text.values())) == 1
    assert fingerprints.fingerprint_versions(empty).count() == 0


def test_sketch_peeling_recovers_sets():
    for n in (0, 1, 40, 900):
        a = {rnd.getrandbits(64) for _ in range(n)}
        b = set(list(a)[: n // 2]) | {rnd.getrandbits(64) for _ in range(n // 3)}
        keys = np.array([*sorted(a), *sorted(b)], np.uint64)
        first = np.array([0, len(a), len(a) + len(b)])
        got = fingerprints.differences(keys, first, np.array([0]), np.array([1]))[0]
        assert tuple(got) == (len(a - b), len(b - a))


def test_toxicity(spark):
    words = [f"{a}{b}{c}" for a in ("er", "on", "th", "in") for b in ("a", "re", "ou") for c in ("n", "st", "ly")]
    data, labels = [], []
    for i in range(600):
        w = [rnd.choice(words) for _ in range(rnd.randint(5, 60))]
        if i % 3 == 0:
            w[rnd.randrange(len(w))] = rnd.choice(["gormless", "nitwit", "blighter"])
        data.append((i, " ".join(w)))
        labels.append((i, int(i % 3 == 0)))
    frame, marks = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(frame, marks.filter("doc_id < 480"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score_documents(frame, model).collect()}
    held = range(480, 600)
    assert sum((got[i] >= 0.5) == (i % 3 == 0) for i in held) >= 0.95 * len(held)
    odd = model.score([b"er ona nitwitt inren", None, b"", b" \n", LONG.encode()])
    assert odd[0] >= 0.5 and all(0 <= x <= 1 for x in odd)
    assert set(toxicity.ToxicModel().score([b"x", None]).round(6)) == {0.0}


def test_pipeline(spark):
    done = corpus_pipeline.run(spark, SF)
    assert done.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(done.columns)
    assert len(corpus_pipeline.STAGES) == 5
    docs = load(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas(), docs.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    ids = [r["doc_id"] for r in docs.collect()]
    assert len(ids) == len(set(ids))


def test_wide_probes_are_sent_in_passes(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 15, np.int64)
    fps = sorted({int(b) ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(0, 4), replace=False)) for b in base for _ in range(6)})
    frame = spark.createDataFrame([(f, f, b"\1" * simhash.BINS) for f in fps], "fp long, rep long, brief binary")
    sent = []
    monkeypatch.setattr(simhash, "materialise", lambda df, label: (sent.append(label), materialise(df, label))[1])
    monkeypatch.setattr(simhash, "PASS_PROBES", 2)
    label = list(range(len(fps)))
    for i, x in enumerate(fps):
        for j in range(i):
            if (x ^ fps[j]).bit_count() <= 5 and label[i] != label[j]:
                label = [min(label[i], label[j]) if k in (label[i], label[j]) else k for k in label]
    want = {f: fps[k] for f, k in zip(fps, label, strict=True)}
    got = {r["vertex"]: r["component"] for r in components(simhash.link(frame, 5)).collect()}
    assert {f: got.get(f, f) for f in fps} == want
    assert "probes" not in sent and sent.count("level") > 1  # wide rows are not written as a table


def test_licences_short_and_wrapped(spark):
    docs = load(spark, "/root/testdata/sf0.001", "documents")
    model = licenses.train(docs)
    said = {
        1: ("SPDX-License-Identifier: MIT", "mit"), 2: ("some words here\nLicense: Apache-2.0\nmore of them", "apache"), 3: ("// SPDX-License-Identifier: GPL-3.0-or-later", "gpl"),
        4: ("Redistribution and use in source\nand binary forms, with or without\nmodification, are permitted", "bsd"), 5: ("", ""), 6: ("\n\n", ""), 7: (None, ""), 8: ("Das Haus steht am Fluss.", ""),
    }
    frame = spark.createDataFrame([(i, t) for i, (t, _) in said.items()], "doc_id long, text string")
    got = {r["doc_id"]: r["families"] for r in licenses.licences(frame, model).collect()}
    assert got == {i: f for i, (_, f) in said.items()}
    span = licenses.scan(frame.filter("doc_id = 4"), model).collect()
    assert [(r["line"], r["start"], r["length"], r["family"]) for r in span] == [(0, 0, len(said[4][0]), "bsd")]


def test_stages_leave_no_copies_of_texts(spark):
    from ticketloom.session import shared_dir

    base = Path(shared_dir(spark).removeprefix("file:")) / "ticketloom"
    docs = load(spark, SF, "documents")
    left = {}
    for name, stage in corpus_pipeline.STAGES[1:4]:
        before = {*base.glob("*")}
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas(), docs.schema)
        left[name] = sorted({x.name.rpartition("-")[0] for x in {*base.glob("*")} - before})
    assert left == {"quality": ["cutoffs"], "near_duplicates": ["kept"], "repeated_passages": ["fingerprints"]}


def test_quality_keeps_rows_by_their_own_verdict(spark, awkward):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    good = " ".join(f"word{i}" for i in range(40))
    docs = awkward.select("doc_id", "text").unionByName(spark.createDataFrame([(None, good), (None, "short"), (None, good), (0, good), (0, "short"), (5, None)], "doc_id long, text string"))
    for frame in (docs, docs.withColumn("lang", F.lit(None).cast("string")), docs.withColumn("lang", F.lit("de")).withColumn("loom_key", F.lit(1))):
        want = quality.judge(frame, labels).filter("kept").groupBy("doc_id", "n_words").count()
        words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
        got = quality.keep_good(frame, labels)
        assert got.columns == frame.columns
        assert sorted(map(repr, got.groupBy("doc_id", words.alias("n_words")).count().collect())) == sorted(map(repr, want.collect()))


@pytest.mark.parametrize(("n", "k"), [(1, 3), (5, 2), (30, 30), (20, 50), (300, 7)])
def test_differencing_is_the_plain_one(n, k):
    sizes = np.random.default_rng(n).integers(1, 40, n)
    heap = [(-s, i, [0] * (k - 1) + [s]) for i, s in enumerate(sizes.tolist())]
    while len(heap) > 1:
        heap.sort()
        (_, _, a), (_, _, b), *heap = heap
        both = sorted(x + y for x, y in zip(a, b[::-1], strict=True))
        heap.append((both[0] - both[-1], n + len(sizes) * 9 - len(heap), [x - both[0] for x in both]))
    got = np.sort(np.bincount(packing.difference(sizes, k), sizes, k).astype(int))
    assert (got - got[0]).tolist() == heap[0][2]
