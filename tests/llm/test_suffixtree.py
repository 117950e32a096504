"""The suffix tree against a tree grown in memory: every child of a kept context that is common enough and diverges is kept."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from ticketloom.llm import suffixtree
from ticketloom.session import load

CONDITION = "crc32(cast(cast(doc_id as string) as binary)) % 10 <> 0"
CELLS, PRIOR = suffixtree.CELLS, suffixtree.PRIOR


def cell(word):
    h = int(suffixtree.END) if word == "</s>" else int.from_bytes(xxhash.xxh3_128_digest(word.encode())[:8], "little")
    return h % CELLS


def brute_scores(pairs, least, divergence):
    """Scores of the texts, the number of kept contexts, and the greatest depth of one."""
    texts = [["<s>", *re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")), "</s>"] for _, t in pairs]
    use = [zlib.crc32(str(d).encode()) % 10 != 0 for d, _ in pairs]
    unigrams = Counter(w for t, u in zip(texts, use, strict=True) if u for w in t[1:])
    tokens = sum(unigrams.values())
    levels = Counter(unigrams.values())
    d = levels[1] / (levels[1] + 2 * levels[2]) if levels[1] and levels[2] else 0.5
    shares = {(): [(sum(n for w, n in unigrams.items() if cell(w) == k) + 1) / (tokens + CELLS) for k in range(CELLS)]}
    facts = {}

    def p(context, word):
        if not context:
            return (unigrams[word] - d if word in unigrams else d * len(unigrams)) / tokens
        nxt, total = facts[context]
        return (nxt[word] + PRIOR * p(context[1:], word)) / (total + PRIOR)

    for depth in range(1, suffixtree.deepest(tokens, least) + 1):
        follow = defaultdict(Counter)
        for t, u in zip(texts, use, strict=True):
            for i in range(depth, len(t)) if u else ():
                if tuple(t[i - depth + 1 : i]) in shares and (depth == 1 or tuple(t[i - depth : i - 1]) in shares):
                    follow[tuple(t[i - depth : i])][t[i]] += 1
        for context, nxt in follow.items():
            total = sum(nxt.values())
            parent = shares[context[1:]]
            by_cell = [sum(n for w, n in nxt.items() if cell(w) == k) for k in range(CELLS)]
            found = sum(n * (math.log(n / total) - math.log(q)) for n, q in zip(by_cell, parent, strict=True) if n)
            if total >= least:
                assert abs(found - divergence) > 1e-4
                if found >= divergence:
                    facts[context] = (nxt, total)
                    shares[context] = [(n + PRIOR * q) / (total + PRIOR) for n, q in zip(by_cell, parent, strict=True)]
    scores = []
    for t in texts:
        total = 0.0
        for i in range(1, len(t)):
            k = 0
            while k < i and tuple(t[i - k - 1 : i]) in shares:
                k += 1
            total += math.log10(p(tuple(t[i - k : i]), t[i]))
        scores.append(total)
    return scores, len(facts), max(map(len, shares))


@pytest.mark.parametrize(("least", "divergence"), [(64, 29.0), (8, 6.0)])
def test_every_diverging_context_is_kept(spark, monkeypatch, least, divergence):
    monkeypatch.setattr(suffixtree, "BUCKET_BYTES", 200_000)
    monkeypatch.setattr(suffixtree, "BLOCK_BYTES", 150_000)
    docs = load(spark, "/root/testdata/sf0.001", "documents")
    pairs = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want, kept, deepest = brute_scores(pairs, least, divergence)
    got = suffixtree.score_documents(docs, CONDITION, least, divergence).collect()
    assert kept and deepest >= (2 if least < 64 else 1)
    want = {d: s for (d, _), s in zip(pairs, want, strict=True)}
    assert {r["doc_id"]: r["score"] for r in got} == pytest.approx(want, abs=2e-2)


def test_contexts_grow_with_the_corpus(spark):
    # 400 words with fixed successors: 400 contexts pass the test, each in less than a thousandth of larger corpora
    rows = [(i, " ".join(f"k{(i * 7 + j * 13) % 400} v{(i * 7 + j * 13) % 400}" for j in range(100))) for i in range(600)]
    got = suffixtree.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), "true").collect()
    want, kept, _ = brute_scores([(next(k for k in range(10**6) if zlib.crc32(str(k).encode()) % 10), t) for _, t in rows], 64, 29.0)
    assert kept > 400
    assert sorted(r["score"] for r in got) == pytest.approx(sorted(want), abs=2e-2)


def test_the_test_on_classes_is_the_likelihood_ratio():
    cells = np.array([[30.0, 2.0, 0.0], [10.0, 10.0, 10.0]])
    q = np.array([0.5, 0.25, 0.25])
    got = suffixtree.ratio(cells, (cells * np.log(q)).sum(axis=1))
    want = [sum(n * math.log(n / sum(c) / s) for n, s in zip(c, q, strict=True) if n) for c in cells.tolist()]
    assert got == pytest.approx(want)
