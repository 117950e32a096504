"""Evaluation queries over recorded predictions; labels stand in for gold, a length rule for the prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketloom.operators import metrics
from ticketloom.plans.registry import Registry
from ticketloom.session import load

R = Registry()
query = R.query

PRED = "CASE WHEN n_chars < 400 THEN 0 WHEN n_chars < 4000 THEN 1 ELSE 2 END"
ROWS = f"r AS (SELECT d.doc_id, lang, source, CAST(quality AS INT) AS gold, {PRED} AS pred FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
CLASSES = f"""{ROWS}, c AS (SELECT label, sum(g) AS support, sum(p) AS predicted, sum(g * hit) AS tp FROM
 (SELECT gold AS label, 1 AS g, 0 AS p, (gold = pred)::INT AS hit FROM r UNION ALL SELECT pred, 0, 1, (gold = pred)::INT FROM r) GROUP BY label),
m AS (SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS p, CASE WHEN support = 0 THEN 0 ELSE tp / support END AS q FROM c),
f AS (SELECT label, support, predicted, tp, round(p, 6) AS precision, round(q, 6) AS recall, round(CASE WHEN p + q = 0 THEN 0 ELSE 2 * p * q / (p + q) END, 6) AS f1 FROM m)"""


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(load(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "source", F.col("quality").cast("int").alias("gold"), F.expr(PRED).alias("pred"))


@query(f"WITH {CLASSES} SELECT label, CAST(support AS BIGINT) AS support, CAST(predicted AS BIGINT) AS predicted, CAST(tp AS BIGINT) AS tp, precision, recall, f1 FROM f")
def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.class_metrics(_rows(spark, sf_dir))


@query(f"WITH {CLASSES} SELECT round(avg(CASE WHEN support >= 15 THEN f1 END), 6) AS macro_core, round(avg(f1), 6) AS macro_all, count(*) FILTER (support < 15) AS rare_classes FROM f")
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.macro_f1(_rows(spark, sf_dir))


@query(f"WITH {ROWS} SELECT gold, pred, count(*) AS n FROM r WHERE gold <> pred GROUP BY ALL ORDER BY n DESC, gold, pred LIMIT 5")
def confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusions(_rows(spark, sf_dir))


@query(f"WITH {ROWS}, c AS (SELECT gold, count(*) AS n FROM r GROUP BY gold) SELECT arg_max(gold, n * 10 + gold) AS label, round(max(n) / sum(n), 6) AS share FROM c")
def majority_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.majority(_rows(spark, sf_dir))


@query(f"WITH {ROWS} SELECT count(*) AS n, round(avg((gold = pred)::INT), 6) AS accuracy, count(*) FILTER (gold = pred AND lang = 'en') AS exact_en FROM r")
def exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.col("gold") == F.col("pred")
    return _rows(spark, sf_dir).agg(F.count("*").alias("n"), F.round(F.avg(hit.cast("double")), 6).alias("accuracy"), F.count_if(hit & (F.col("lang") == "en")).alias("exact_en"))


@query(f"WITH {ROWS} SELECT lang, source, count(*) AS n, round(avg((gold = pred)::INT), 6) AS accuracy FROM r GROUP BY GROUPING SETS ((lang), (source))")
def breakdown_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    sets = rows.groupingSets([["lang"], ["source"]], "lang", "source")
    return sets.agg(F.count("*").alias("n"), F.round(F.avg((F.col("gold") == F.col("pred")).cast("double")), 6).alias("accuracy"))


@query("""WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(n) AS n, max(CASE WHEN rn = least(n, floor(n * 0.5) + 1) THEN value END) AS p50, max(CASE WHEN rn = least(n, floor(n * 0.95) + 1) THEN value END) AS p95,
 max(CASE WHEN rn = least(n, floor(n * 0.99) + 1) THEN value END) AS p99, max(value) AS max FROM o GROUP BY event_type""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.nearest_rank(load(spark, sf_dir, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("""SELECT event_type, count(*) AS n_live, round(sum(value), 4) AS total, round(sum(value) / count(*) * 10000, 4) AS per_10k
FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) % 10 <> 0 GROUP BY event_type""")
def cost_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of live rows; those marked as cache hits do not count."""
    live = load(spark, sf_dir, "events").filter(F.get_json_object("props", "$.k").cast("long") % 10 != 0)
    total = F.sum("value")
    return live.groupBy("event_type").agg(F.count("*").alias("n_live"), F.round(total, 4).alias("total"), F.round(total / F.count("*") * 10000, 4).alias("per_10k"))


@query("""WITH u AS (SELECT event_type, user_id % 3 AS run, avg(value) AS v FROM events GROUP BY ALL),
s AS (SELECT event_type, avg(v) AS mean, min(v) AS low, max(v) AS high FROM u GROUP BY event_type)
SELECT event_type, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high, round(high - low, 6) AS range FROM s""")
def spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, lowest, highest and range of a metric over repeated runs (users dealt to three runs)."""
    runs = load(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 3).alias("run")).agg(F.avg("value").alias("v"))
    stats = runs.groupBy("event_type").agg(F.avg("v").alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"))
    return stats.select("event_type", *(F.round(c, 6).alias(c) for c in ("mean", "low", "high")), F.round(F.col("high") - F.col("low"), 6).alias("range"))


@query("""WITH i AS (SELECT n_name AS item, count(DISTINCT c_custkey) AS a, round(sum(c_acctbal), 2) AS b FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name),
p AS (SELECT sign((x.a - y.a) * (x.b - y.b)) AS s FROM i x JOIN i y ON x.item < y.item)
SELECT count(*) FILTER (s > 0) AS concordant, count(*) FILTER (s < 0) AS discordant,
 round((count(*) FILTER (s > 0) - count(*) FILTER (s < 0)) / (count(*) FILTER (s <> 0)), 6) AS tau FROM p""")
def kendall_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations, customers = load(spark, sf_dir, "nation"), load(spark, sf_dir, "customer")
    items = nations.join(customers, F.col("n_nationkey") == F.col("c_nationkey")).groupBy(F.col("n_name").alias("item")).agg(F.countDistinct("c_custkey").cast("double").alias("a"), F.round(F.sum("c_acctbal"), 2).alias("b"))
    return metrics.kendall(items)


@query("""WITH t AS (SELECT unnest([10, 20, 40, 80]) AS threshold)
SELECT threshold, count(*) FILTER (event_type <> 'click' AND value < threshold) AS caught, count(*) FILTER (event_type = 'click' AND value < threshold) AS lost FROM t, events GROUP BY threshold""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an abstention threshold catches and loses: all thresholds in one pass."""
    click = F.col("event_type") == "click"
    cells = [F.struct(F.lit(t).alias("threshold"), F.count_if(~click & (F.col("value") < t)).alias("caught"), F.count_if(click & (F.col("value") < t)).alias("lost")) for t in (10, 20, 40, 80)]
    return load(spark, sf_dir, "events").agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


@query("""WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events),
j AS (SELECT *, least(greatest((n + 1) // 20, 1), n - 1) AS k, (n + 1) / 20.0 - least(greatest((n + 1) // 20, 1), n - 1) AS f FROM o)
SELECT event_type, round(max(CASE WHEN rn = k THEN value * (1 - f) END) + max(CASE WHEN rn = k + 1 THEN value * f END), 6) AS p5, round(min(value), 6) AS low, round(max(value), 6) AS high FROM j GROUP BY event_type""")
def quantiles_exclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5th percentile by the exclusive method, with the extremes."""
    by = Window.partitionBy("event_type")
    rows = load(spark, sf_dir, "events").select("event_type", "value", F.row_number().over(by.orderBy("value")).alias("rn"), F.count("*").over(by).alias("n"))
    rows = rows.withColumn("k", F.least(F.greatest(F.floor((F.col("n") + 1) / 20), F.lit(1)), F.col("n") - 1)).withColumn("f", (F.col("n") + 1) / 20 - F.col("k"))
    p5 = F.max(F.when(F.col("rn") == F.col("k"), F.col("value") * (1 - F.col("f")))) + F.max(F.when(F.col("rn") == F.col("k") + 1, F.col("value") * F.col("f")))
    return rows.groupBy("event_type").agg(F.round(p5, 6).alias("p5"), F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high"))


FAILURES = [("timeout", "timeout:%"), ("rate_limit", "%HTTP 429%"), ("provider_5xx", "%HTTP 5%"), ("invalid_json", "%JSON%"), ("transport", "transport:%"), ("http_4xx", "%HTTP 4%")]
KIND = "CASE " + " ".join(f"WHEN e LIKE '{pattern}' THEN '{name}'" for name, pattern in FAILURES) + " ELSE 'other' END"
ERROR = "CASE CAST(event_id AS BIGINT) % 7 WHEN 0 THEN 'timeout: 60 s' WHEN 1 THEN 'HTTP 429 slow down' WHEN 2 THEN 'HTTP 503' WHEN 3 THEN 'no JSON object' WHEN 4 THEN 'transport: reset' WHEN 5 THEN 'HTTP 404' ELSE 'odd' END"


@query(f"SELECT {KIND} AS kind, count(*) AS n FROM (SELECT {ERROR} AS e FROM events) GROUP BY 1")
def failure_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures by kind; the first pattern that fits decides."""
    return load(spark, sf_dir, "events").select(F.expr(ERROR).alias("e")).select(F.expr(KIND).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


QUERIES, ORACLE_SQL = R.queries, R.sql
