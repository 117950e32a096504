"""Retrieval queries: BM25, dense, fusion, roll-up and their scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.operators import search
from ticketloom.plans.registry import Registry
from ticketloom.session import load

R = Registry()
query = R.query

POSTINGS = r"""d AS (SELECT doc_id, source, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM documents),
facts AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
p AS (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM d),
tf AS (SELECT doc_id, len, term, count(*) AS tf FROM p GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
idf AS (SELECT term, df, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM df, facts)"""
BM25 = rf"""{POSTINGS},
q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS term FROM benchmark),
s AS (SELECT query_id, doc_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))), 6) AS score FROM q JOIN tf USING (term) JOIN idf USING (term), facts GROUP BY ALL),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s))"""
DENSE = """dn AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, round(list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score
 FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id),
dr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM dn))"""


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _dense(spark: SparkSession, sf_dir: str, top: int) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings")
    return search.dense(vectors, vectors.filter("vec_id % 100 = 0"), top)  # the stated query set of a search


def _bm25(spark: SparkSession, sf_dir: str, top: int) -> DataFrame:
    return search.bm25(load(spark, sf_dir, "documents"), _queries(spark, sf_dir), top)


@query(f"WITH {POSTINGS} SELECT n AS n_docs, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM df) AS n_terms FROM facts")
def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    terms = search.postings(docs).agg(F.countDistinct("term").alias("n_terms"))
    return search.corpus_facts(docs).crossJoin(terms).select(F.col("n").alias("n_docs"), F.round("avgdl", 6).alias("avgdl"), "n_terms")


@query(f"WITH {POSTINGS} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.term_idf(load(spark, sf_dir, "documents")).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {BM25} SELECT query_id, doc_id, score, rank FROM bm WHERE rank <= 5 AND score > 0")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, 5)


@query(f"WITH {DENSE} SELECT query_id, doc_id, score, rank FROM dr WHERE rank <= 5 AND score > 0")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir, 5)


@query(f"""WITH {DENSE}, h AS (SELECT d.query_id, min(CASE WHEN e.label = q.label AND score > 0 THEN rank END) AS first FROM dr d
 JOIN embeddings e ON e.vec_id = d.doc_id JOIN embeddings q ON q.vec_id = d.query_id WHERE rank <= 5 GROUP BY d.query_id)
SELECT count(*) AS n_queries, round(avg((coalesce(first, 99) <= 1)::INT), 6) AS recall_1, round(avg((coalesce(first, 99) <= 3)::INT), 6) AS recall_3,
 round(avg((coalesce(first, 99) <= 5)::INT), 6) AS recall_5, round(avg(CASE WHEN first <= 5 THEN 1.0::DOUBLE / first ELSE 0 END), 6) AS mrr_5 FROM h""")
def dense_recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", "label")
    hits = _dense(spark, sf_dir, 5)
    keys = hits.join(vectors.withColumnsRenamed({"vec_id": "doc_id", "label": "l"}), "doc_id").join(vectors.withColumnsRenamed({"vec_id": "query_id", "label": "ql"}), "query_id")
    good = keys.filter("l = ql").select("query_id", "doc_id", "rank")
    asked = load(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"))
    return search.retrieval_scores(good, asked.join(good.select("query_id", "doc_id"), "query_id", "left"))


@query(f"""WITH {BM25},
o AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, doc_id) AS rank FROM
 (SELECT query_id, doc_id, count(*) AS overlap FROM q JOIN tf USING (term) GROUP BY ALL)),
f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, a.rank AS r1, b.rank AS r2,
 round(coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0), 9) AS score
 FROM (SELECT * FROM bm WHERE rank <= 20 AND score > 0) a FULL JOIN (SELECT * FROM o WHERE rank <= 20) b ON a.query_id = b.query_id AND a.doc_id = b.doc_id),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, coalesce(r1, 1073741824), coalesce(r2, 1073741824), doc_id) AS rank FROM f)
SELECT query_id, doc_id, score, rank FROM g WHERE rank <= 5""")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, asked = load(spark, sf_dir, "documents"), _queries(spark, sf_dir)
    deep = max(4 * 5, 20)
    by_score, by_overlap = search.lexical(docs, asked, deep)
    return search.fuse(by_score, by_overlap, 5)


@query(f"""WITH {BM25}, h AS (SELECT query_id, source AS parent, min(rank) AS best FROM bm JOIN d USING (doc_id) WHERE rank <= 25 AND score > 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best) AS rank FROM h)
SELECT query_id, parent, best, rank, max(best) OVER (PARTITION BY query_id) AS used FROM r WHERE rank <= 5""")
def rollup_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = load(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("parent"))
    return search.roll_up(_bm25(spark, sf_dir, 25).join(parents, "doc_id"), 5)


@query("""WITH g AS (SELECT label, count(*) AS g FROM embeddings GROUP BY label), n AS (SELECT count(*) AS n FROM embeddings), k AS (SELECT unnest([1, 3, 5]) AS k)
SELECT k, round(avg(1 - list_product(list_transform(range(0, k), lambda i: greatest(0, n - g - i)::DOUBLE / (n - i)))), 6) AS floor FROM g, n, k GROUP BY k""")
def chance_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = load(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("g"))
    total = groups.agg(F.sum("g").alias("n"))
    rows = groups.crossJoin(F.broadcast(total))  # the total is one row
    n = F.col("n")
    floors = []
    for k in (1, 3, 5):
        missed = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda a, i: a * F.greatest(F.lit(0), n - F.col("g") - i) / (n - i))
        floors.append(F.struct(F.lit(k).alias("k"), F.avg(1 - missed).alias("f")))
    return rows.agg(F.array(*floors).alias("x")).select(F.explode("x").alias("x")).select("x.k", F.round("x.f", 6).alias("floor"))


@query("""SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)""")
def contamination_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark text: its second and third word first, then the exact test."""
    words = lambda c: F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ")
    items = load(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"), words(F.col("text")).alias("w"))
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    pair = F.concat_ws(" ", F.get("w", F.lit(1)), F.get("w", F.lit(2)))
    long = items.filter(F.size("w") >= 4).select("item_id", "item", pair.alias("pair"))
    docs_pairs = docs.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", F.explode_outer(F.array_distinct(F.zip_with("w", F.expr("slice(w, 2, size(w))"), lambda x, y: F.concat_ws(" ", x, y)))).alias("pair"))
    candidates = docs_pairs.join(long, "pair").select("doc_id", "item_id", "item").distinct()
    short = items.filter(F.size("w") < 4).select("item_id", "item")
    found = candidates.join(docs, "doc_id").filter(F.contains("text", "item")).select("doc_id", "item_id")
    few = docs.join(short, F.contains("text", "item")).select("doc_id", "item_id")  # items too short for a pair: usually none
    return found.unionByName(few)


QUERIES, ORACLE_SQL = R.queries, R.sql
