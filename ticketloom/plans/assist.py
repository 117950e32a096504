"""Queries over replayed model calls, samples and draft checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketloom.operators import replay, splits
from ticketloom.plans.registry import Registry
from ticketloom.session import load

R = Registry()
query = R.query


@query("SELECT doc_id FROM documents ORDER BY md5('7:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 50")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.seeded_sample(load(spark, sf_dir, "documents").select("doc_id"), "doc_id", 50, 7)


@query("""WITH b AS (SELECT doc_id, 0 AS i, 'spanish' AS branch, 5 AS n FROM documents WHERE lang = 'es' UNION ALL SELECT doc_id, 1, 'long', 8 FROM documents WHERE n_chars > 5000 UNION ALL SELECT doc_id, 2, 'any', 10 FROM documents),
t AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY doc_id) AS rn FROM b)
SELECT doc_id, arg_min(branch, i) AS branch FROM t WHERE rn <= n GROUP BY doc_id""")
def smoke_picker(spark: SparkSession, sf_dir: str) -> DataFrame:
    branches = [("spanish", F.col("lang") == "es", 5), ("long", F.col("n_chars") > 5000, 8), ("any", F.lit(True), 10)]
    return splits.smoke(load(spark, sf_dir, "documents"), "doc_id", branches)


@query("""WITH l AS (SELECT DISTINCT user_id % 10 AS model, user_id AS endpoint, event_type AS p FROM events), n AS (SELECT model, count(DISTINCT endpoint) AS n FROM l GROUP BY model),
c AS (SELECT model, p, count(*) AS c FROM l GROUP BY ALL)
SELECT model, coalesce(string_agg(CASE WHEN c = n THEN p END, ',' ORDER BY p), '') AS all_params, string_agg(p, ',' ORDER BY p) AS any_params FROM c JOIN n USING (model) GROUP BY model""")
def capability_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users stand in for endpoints of ten models, event types for their parameters."""
    rows = load(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("model"), F.col("user_id").alias("endpoint"), "event_type").distinct()
    table = replay.capabilities(rows.groupBy("model", "endpoint").agg(F.collect_set("event_type").alias("params")), "model", "params")
    return table.select("model", F.array_join("all", ",").alias("all_params"), F.array_join("any", ",").alias("any_params"))


@query("""WITH u AS (SELECT event_type, user_id % 3 AS run, avg(value) AS v FROM events GROUP BY ALL), s AS (SELECT event_type, avg(v) AS mean, max(v) - min(v) AS range FROM u GROUP BY event_type)
SELECT a.event_type AS old, b.event_type AS new, round(b.mean - a.mean, 6) AS delta, b.mean - a.mean > greatest(a.range, b.range) AS promoted FROM s a JOIN s b ON a.event_type < b.event_type""")
def promotion_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change counts if the means differ by more than either repeats' range."""
    runs = load(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 3).alias("run")).agg(F.avg("value").alias("v"))
    s = runs.groupBy("event_type").agg(F.avg("v").alias("mean"), (F.max("v") - F.min("v")).alias("range"))
    a, b = s.alias("a"), s.alias("b")
    delta = F.col("b.mean") - F.col("a.mean")
    return a.join(b, F.col("a.event_type") < F.col("b.event_type")).select(F.col("a.event_type").alias("old"), F.col("b.event_type").alias("new"), F.round(delta, 6).alias("delta"), (delta > F.greatest("a.range", "b.range")).alias("promoted"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN least(event_id % 90, 60)::DOUBLE ELSE least(power(2, event_id % 8), 30)::DOUBLE END AS wait FROM events""")
def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 90).cast("double"))
    return load(spark, sf_dir, "events").select("event_id", replay.backoff(F.col("event_id") % 8, asked).alias("wait"))


@query("""WITH m AS (SELECT p.p_partkey, avg(l_extendedprice) AS v FROM part p LEFT JOIN lineitem l ON l_partkey = p_partkey AND l_quantity > 49 GROUP BY 1)
SELECT p_partkey, coalesce(replace(printf('%.3f', v), '.', ','), 'н/д') AS cell FROM m""")
def comparison_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a measurement stay, with a mark in place of the number. Sums are taken in the order of the files, as one thread of the SQL does."""
    mean = replay.mean_in_order(F.col("l_extendedprice"), F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    lines = load(spark, sf_dir, "lineitem").filter("l_quantity > 49").groupBy(F.col("l_partkey").alias("p_partkey")).agg(mean.alias("v"))
    return load(spark, sf_dir, "part").select("p_partkey").join(lines, "p_partkey", "left").select("p_partkey", replay.cell(F.col("v")).alias("cell"))


@query("""SELECT a.conv_id, a.turn, trim(b.text) <> '' AND contains(lower(trim(regexp_replace(a.text, '\\s+', ' ', 'g'))), lower(trim(regexp_replace(split_part(b.text, '.', 1), '\\s+', ' ', 'g')))) AS cited
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def citation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the first sentence of a turn stands in the turn before it."""
    rows = load(spark, sf_dir, "conversations")
    after = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    both = rows.join(after, ["conv_id", "turn"])
    quote = F.split_part("next", F.lit("."), F.lit(1))
    held = F.contains(replay.flatten(F.col("text")), replay.flatten(quote))
    return both.select("conv_id", "turn", ((F.trim("next") != "") & held).alias("cited"))


@query("SELECT doc_id, CASE WHEN lower(trim(lang)) = 'fr' THEN 'Ukrainian' ELSE trim(lang) END AS answer_in FROM documents")
def answer_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", replay.answer_language(F.col("lang"), {"fr": "Ukrainian"}).alias("answer_in"))


@query()
def tone_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequence ratio of an answer and the conversation's answer before it."""
    rows = load(spark, sf_dir, "conversations").filter("role = 'assistant'")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return replay.similarity(rows.select("conv_id", "turn", "text", before.alias("before")).filter("before IS NOT NULL"), "text", "before").select("conv_id", "turn", F.round("ratio", 6).alias("ratio"))


@query("""WITH m AS (SELECT doc_id, CAST(quality AS INT) AS q FROM labels), r AS (SELECT d.doc_id, q FROM documents d LEFT JOIN m USING (doc_id))
SELECT count(*) AS n, count(q) AS answered, count(*) FILTER (q IS NULL) AS failed, round(count(q) / count(*), 6) AS share FROM r""")
def replay_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets with a recorded prediction; those without stay as failures."""
    found = replay.predict(load(spark, sf_dir, "documents").select("doc_id"), load(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("q")), "doc_id")
    return found.agg(F.count("*").alias("n"), F.count("q").alias("answered"), F.count_if(F.col("q").isNull()).alias("failed"), F.round(F.count("q") / F.count("*"), 6).alias("share"))


QUERIES, ORACLE_SQL = R.queries, R.sql
