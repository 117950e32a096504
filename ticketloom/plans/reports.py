"""Queries over ticket selection, run reports and draft checks; events with invented sentences stand in for tickets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketloom.operators import reports, tickets
from ticketloom.plans.registry import Registry
from ticketloom.session import load

R = Registry()
query = R.query

BRAND = "acme"
FIRST = [
    "Please refund the second payment", "Beware of this thing", "My card shows an amount nobody explained", "How do I cancel the trial", "I like the colours",
    "Your app took money twice", "Do not install it", "Kindly look into the order", "Worst service, such thieves", "Reembolsen el dinero por favor", "환불 부탁드립니다", "Верните деньги",
]
SECOND = ["and the page is stuck.", "and I was charged again.", "because of a crash on start.", "and all went well.", "while support gave no reply.", "since the report never arrived.", "¿no funciona nada?"]
PAD = "It has been like this for a number of days now and there is nothing else that comes to mind about it, apart from the weather."


def _case(expression: str, values: list[str]) -> str:
    return f"CASE {expression} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


SCORE = "CAST(event_id % 5 + 1 AS INT)"
TEXT = f"concat({_case('event_id % 12', FIRST)}, ' ', {_case('user_id % 7', SECOND)}, CASE WHEN event_id % 11 = 0 THEN '' ELSE ' {PAD}' END)"
TICKETS = f"t AS (SELECT event_id AS id, CAST(ts AS DATE) AS day, {SCORE} AS score, {TEXT} AS text FROM events)"
P = {name: pattern.replace("'", "''") for name, pattern in tickets.patterns(BRAND).items()}
AS_OF = "2025-01-10"
BASE = f"day >= DATE '{AS_OF}' - INTERVAL 365 DAY AND score IN (1, 2, 3, 4) AND length(text) >= 120"
FOUND = {name: f"regexp_matches(text, '(?is){pattern}')" for name, pattern in P.items()}
SCRIPT = "regexp_matches(text, '" + "|".join(tickets.SCRIPTS.values()) + "')"


def _tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("date").alias("day"), F.expr(SCORE).alias("score"), F.expr(TEXT).alias("text"))


@query(f"""WITH {TICKETS} SELECT id, {', '.join(f'{e} AS {n}' for n, e in FOUND.items())}, {BASE} AND {FOUND['asks']} AND {FOUND['faulty']} AND {FOUND['addressed']} AND NOT {FOUND['warns']} AS ticket FROM t""")
def ticket_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    whole = tickets.is_ticket(F.col("day"), F.col("score"), text, AS_OF, BRAND)
    return _tickets(spark, sf_dir).select("id", *(c.alias(n) for n, c in tickets.shape(text, BRAND).items()), whole.alias("ticket"))


@query(f"""WITH {TICKETS} SELECT id FROM t WHERE {BASE} AND {SCRIPT}""")
def script_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the language stream that are there by their script."""
    rows = _tickets(spark, sf_dir).filter(tickets.non_latin(F.col("text")))
    return rows.filter(tickets.language_stream(F.col("day"), F.col("score"), F.col("text"), AS_OF)).select("id")


@query("""SELECT doc_id, CASE WHEN trim(source) <> '' THEN trim(trim(source) || chr(10) || chr(10) || text, ' ' || chr(9) || chr(10) || chr(13)) ELSE text END AS ticket,
 CASE WHEN lang IN ('es', 'pt', 'fr', 'de', 'tr') THEN lang ELSE 'other_lang' END AS bucket, coalesce(length(text) BETWEEN 1 AND 12000, false) AS accepted FROM documents""")
def ticket_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that is classified, its stratum's language and whether it is let in; sources stand in for titles."""
    docs = load(spark, sf_dir, "documents")
    return docs.select("doc_id", tickets.ticket_text(F.col("source"), F.col("text")).alias("ticket"), tickets.language_bucket(F.col("lang")).alias("bucket"), tickets.accepted(F.col("text")).alias("accepted"))


# Orders stand in for classified rows: three fields with a label and a prediction each.
FIELDS = {"category": ("o_orderkey % 6", "CASE WHEN o_custkey % 4 = 0 THEN o_custkey % 6 ELSE o_orderkey % 6 END"), "priority": ("o_custkey % 3", "CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_custkey % 3 END"), "next_step": ("o_orderkey % 7", "CASE WHEN o_custkey % 3 = 0 THEN 2 ELSE o_orderkey % 7 END")}


def _field_sql(field: str) -> str:
    gold, pred = FIELDS[field]
    return f"""SELECT '{field}' AS field, avg(CASE WHEN support >= 15 THEN CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (support + predicted) END END) AS f1 FROM (
 SELECT label, sum(g) AS support, sum(p) AS predicted, sum(g * hit) AS tp FROM (
 SELECT {gold} AS label, 1 AS g, 0 AS p, (({gold}) = ({pred}))::INT AS hit FROM orders UNION ALL SELECT {pred}, 0, 1, (({gold}) = ({pred}))::INT FROM orders) GROUP BY label)"""


def _field(spark: SparkSession, sf_dir: str, field: str) -> DataFrame:
    gold, pred = FIELDS[field]
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr(gold).alias("gold"), F.expr(pred).alias("pred"))


@query(f"SELECT CASE WHEN count(f1) = 3 THEN round(avg(f1), 4) END AS headline FROM ({' UNION ALL '.join(map(_field_sql, FIELDS))})")
def headline_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.headline({f: _field(spark, sf_dir, f) for f in FIELDS}).select(F.round("headline", 4).alias("headline"))


_STEP = FIELDS["next_step"]


@query(f"""SELECT o_orderkey AS id, CASE WHEN ({_STEP[0]}) = 2 AND ({_STEP[1]}) = 2 THEN 'found' WHEN ({_STEP[0]}) = 2 THEN 'missed' ELSE 'extra' END AS kind FROM orders WHERE ({_STEP[0]}) = 2 OR ({_STEP[1]}) = 2""")
def escalation_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _field(spark, sf_dir, "next_step").select("id", F.col("gold").cast("string").alias("gold"), F.col("pred").cast("string").alias("pred"))
    return reports.hits_and_misses(rows, "2")


@query(f"""WITH k AS (SELECT CASE WHEN ({_STEP[0]}) = 2 AND ({_STEP[1]}) = 2 THEN 'found' WHEN ({_STEP[0]}) = 2 THEN 'missed' ELSE 'extra' END AS kind FROM orders WHERE ({_STEP[0]}) = 2 OR ({_STEP[1]}) = 2)
SELECT count(*) FILTER (kind = 'found') AS found, count(*) FILTER (kind <> 'extra') AS gold, count(*) FILTER (kind <> 'missed') AS predicted FROM k""")
def escalation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("kind")
    return escalation_cases(spark, sf_dir).agg(F.count_if(kind == "found").alias("found"), F.count_if(kind != "extra").alias("gold"), F.count_if(kind != "missed").alias("predicted"))


@query("""WITH c AS (SELECT p_type AS label, count(*) AS n FROM part GROUP BY 1) SELECT label, n, n >= 15 AS counts, row_number() OVER (ORDER BY n DESC, label) AS place FROM c""")
def class_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.support(load(spark, sf_dir, "part"), "p_type")


@query("""WITH r AS (SELECT o_orderpriority AS encoder, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 3 END AS want, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_custkey % 3 END AS got,
 o_orderkey % 7 = 0 AS uncertain, o_custkey % 11 <> 0 AS returned FROM orders)
SELECT encoder, count(*) FILTER (got = want) AS "right", count(*) FILTER (got <> want) AS wrong, count(*) FILTER (got IS NULL) AS silent, round(count(*) FILTER (got = want) / count(*), 6) AS share
FROM r WHERE want IS NOT NULL AND NOT uncertain AND returned GROUP BY encoder""")
def rail_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    rows = load(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("encoder"), F.when(key % 4 != 0, key % 3).alias("want"), F.when(customer % 5 != 0, customer % 3).alias("got"), (key % 7 == 0).alias("uncertain"), (customer % 11 != 0).alias("returned"))
    return reports.rail(rows, "encoder")


@query("""SELECT event_type, round(avg(value), 6) AS mean, round(max(value), 6) AS highest, arg_max(event_id, value * 1e6 - event_id / 1e6) AS worst FROM events GROUP BY event_type""")
def tone_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and largest similarity of each pair of tones, and where; event values stand in for similarities."""
    place = F.col("value") * 1e6 - F.col("event_id") / 1e6
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value"), 6).alias("highest"), F.max_by("event_id", place).alias("worst"))


DRAFTS = ["Hello there. We sent it back!", "The money is on its way. Best regards, Acme team", "Rest assured. It is done. Is it? Yes! Good evening.", "Dear all, please wait. Sincerely", "Done"]
CHECKS = {
    "concise_short": "{n} <= 3", "concise_no_greeting": "NOT {g}", "concise_no_signoff": "NOT {s}", "formal_greeting": "{g2}", "formal_signoff": "{s2}", "empathetic_no_greeting": "NOT {g3}", "empathetic_no_filler": "NOT {f3}",
}


def _drafts_sql() -> str:
    greet = lambda c: f"regexp_matches({c}, '(?i){reports.GREETING}')"
    sign = lambda c: f"regexp_matches({c}, '(?i){'|'.join([*reports.SIGNOFF, 'acme team'])}')"
    n = lambda c: f"len(list_filter(regexp_split_to_array(trim({c}), '{reports.SENTENCE_END}'), lambda s: trim(s) <> ''))"
    made = {"n": n("concise"), "g": greet("concise"), "s": sign("concise"), "g2": greet("formal"), "s2": sign("formal"), "g3": greet("empathetic"), "f3": f"regexp_matches(empathetic, '(?i){'|'.join(reports.FILLER)}')"}
    tones = ", ".join(f"{_case(f'(event_id + {k}) % 5', DRAFTS)} AS {t}" for k, t in enumerate(("concise", "formal", "empathetic")))
    return f"d AS (SELECT event_id AS id, {tones} FROM events), s AS (SELECT id, {', '.join(f'{e.format(**made)} AS {c}' for c, e in CHECKS.items())}, {n('concise')} AS sentences FROM d)"


def _drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), *(F.expr(_case(f"(event_id + {k}) % 5", DRAFTS)).alias(t) for k, t in enumerate(("concise", "formal", "empathetic"))))
    checks = reports.draft_shape(F.col("concise"), F.col("formal"), F.col("empathetic"), "acme team")
    return rows.select("id", *(c.alias(n) for n, c in checks.items()), reports.sentences(F.col("concise")).alias("sentences"))


@query(f"WITH {_drafts_sql()} SELECT * FROM s")
def draft_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drafts(spark, sf_dir)


@query(f"WITH {_drafts_sql()} SELECT {', '.join(f'count(*) FILTER ({c}) AS {c}' for c in CHECKS)}, median(sentences) AS median, min(sentences) AS least, max(sentences) AS most FROM s")
def draft_shape_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = F.col("sentences")
    return _drafts(spark, sf_dir).agg(*(F.count_if(F.col(c)).alias(c) for c in CHECKS), F.median(length).alias("median"), F.min(length).alias("least"), F.max(length).alias("most"))


@query("""WITH f AS (SELECT doc_id, unnest(list_filter([CASE WHEN n_chars > 4000 THEN 'long' END, CASE WHEN lang = 'fr' THEN 'fr' END, CASE WHEN text LIKE '%@%' THEN 'mail' END], lambda x: x IS NOT NULL)) AS flag FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY doc_id) AS place FROM f)
SELECT flag, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 6) AS share, string_agg(CASE WHEN place <= 4 THEN CAST(doc_id AS VARCHAR) END, ' ' ORDER BY doc_id) AS ids FROM r GROUP BY flag""")
def flag_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = F.array(F.when(F.col("n_chars") > 4000, "long"), F.when(F.col("lang") == "fr", "fr"), F.when(F.contains("text", F.lit("@")), "mail"))
    rows = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.filter(flags, F.isnotnull).alias("flags"))
    return reports.flag_rates(rows, "flags").withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), " "))


@query("SELECT count(*) FILTER (toxic = 1) AS hits, count(*) FILTER (toxic <> 1) AS misses, round(count(*) FILTER (toxic = 1) / count(toxic), 6) AS hit_rate FROM labels")
def cache_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.hit_rate(load(spark, sf_dir, "labels").select((F.col("toxic") == 1).alias("hit")), "hit")


@query("""WITH c AS (SELECT strftime(ts, '%Y%m%d') AS stamp, event_type, avg(value) AS v FROM events GROUP BY ALL), l AS (SELECT DISTINCT stamp FROM c ORDER BY stamp DESC LIMIT 2),
a AS (SELECT * FROM c WHERE stamp = (SELECT max(stamp) FROM l)), b AS (SELECT * FROM c WHERE stamp = (SELECT min(stamp) FROM l))
SELECT event_type, round(b.v, 6) AS before, round(a.v, 6) AS after, round(a.v - b.v, 6) AS delta FROM a LEFT JOIN b USING (event_type)""")
def run_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last two days as runs, event types as cells."""
    cells = load(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyyMMdd").alias("stamp"), "event_type").agg(F.avg("value").alias("v"))
    return reports.run_delta(cells, "stamp", ["event_type"], "v").select("event_type", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), "delta")


@query("""WITH m AS (SELECT unnest(['bm25', 'dense', 'hybrid']) AS method), v AS (SELECT unnest(['article', 'section']) AS variant), e AS (SELECT r_name AS encoder FROM region WHERE r_regionkey < 3 UNION ALL SELECT NULL)
SELECT variant, method, encoder FROM v, m, e WHERE (method = 'bm25') = (encoder IS NULL)""")
def retrieval_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants by methods by encoders (three regions stand in); only the lexical method has none. Three short lists."""
    encoders = load(spark, sf_dir, "region").filter("r_regionkey < 3").select(F.col("r_name").alias("encoder")).unionByName(spark.sql("SELECT CAST(NULL AS STRING) AS encoder"))
    grid = spark.sql("SELECT explode(array('article', 'section')) AS variant").crossJoin(spark.sql("SELECT explode(array('bm25', 'dense', 'hybrid')) AS method")).crossJoin(encoders)
    return grid.filter((F.col("method") == "bm25") == F.col("encoder").isNull()).select("variant", "method", "encoder")


@query("""SELECT s_suppkey, coalesce(n_name, '') AS section, coalesce(r_name, '') AS category FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 4 <> 0) n ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def article_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with their section and its category; what is missing is empty. Suppliers, nations and regions stand in."""
    sections, categories = load(spark, sf_dir, "nation").filter("n_nationkey % 4 <> 0"), load(spark, sf_dir, "region")
    joined = load(spark, sf_dir, "supplier").join(sections, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(categories, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return joined.select("s_suppkey", F.coalesce("n_name", F.lit("")).alias("section"), F.coalesce("r_name", F.lit("")).alias("category"))


@query("""WITH a AS (SELECT n_regionkey AS k, n_name AS article FROM nation WHERE n_regionkey <> 2), t AS (SELECT o_orderkey AS id, unnest([o_orderkey % 5, o_custkey % 5]) AS k FROM orders WHERE o_orderkey % 3 <> 0)
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'unknown' WHEN count(article) > 0 THEN 'covered' ELSE 'uncovered' END AS coverage, coalesce(string_agg(DISTINCT article, ',' ORDER BY article), '') AS articles
FROM orders LEFT JOIN t ON id = o_orderkey LEFT JOIN a USING (k) GROUP BY o_orderkey""")
def topic_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles for the topics of a row: unknown without a topic, else covered or not. The table of topics is a literal map's worth."""
    answers = load(spark, sf_dir, "nation").filter("n_regionkey <> 2").groupBy(F.col("n_regionkey").cast("long").alias("k")).agg(F.collect_list("n_name").alias("listed"))
    topics = F.when(F.col("o_orderkey") % 3 != 0, F.array(F.col("o_orderkey") % 5, F.col("o_custkey") % 5)).otherwise(F.array().cast("array<bigint>"))
    rows = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.array_distinct(topics).alias("topics"))
    table = answers.agg(F.map_from_entries(F.collect_list(F.struct("k", "listed"))).alias("answers"))  # one row
    found = F.array_sort(F.array_distinct(F.flatten(F.filter(F.transform("topics", lambda t: F.try_element_at("answers", t)), F.isnotnull))))
    state = F.when(F.size("topics") == 0, "unknown").when(F.size("found") > 0, "covered").otherwise("uncovered")
    return rows.crossJoin(F.broadcast(table)).withColumn("found", found).select("id", state.alias("coverage"), F.array_join("found", ",").alias("articles"))


@query("""WITH e AS (SELECT user_id AS model, event_id AS place, event_type AS tag, round(value, 4) AS price FROM events) SELECT model, arg_min(tag, place) AS tag, arg_min(price, place) AS price FROM e WHERE tag IN ('purchase', 'view') GROUP BY model""")
def pinned_endpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first endpoint of each model whose whole tag is pinned."""
    rows = load(spark, sf_dir, "events").filter(F.col("event_type").isin("purchase", "view"))
    return rows.groupBy(F.col("user_id").alias("model")).agg(F.min_by("event_type", "event_id").alias("tag"), F.min_by(F.round("value", 4), "event_id").alias("price"))


@query("""WITH r AS (SELECT doc_id, source, toxic = 0 AS passed, left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 60) AS c FROM documents JOIN labels USING (doc_id))
SELECT doc_id, passed, replace(c, '|', '\\|') AS clip, row_number() OVER (PARTITION BY source ORDER BY passed, doc_id) AS place FROM r""")
def failures_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a report table in each set: failures first, texts clipped."""
    rows = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id").withColumn("passed", F.col("toxic") == 0)
    place = F.row_number().over(Window.partitionBy("source").orderBy("passed", "doc_id"))
    return rows.select("doc_id", "passed", reports.clip(F.col("text"), 60).alias("clip"), place.alias("place"))


@query("SELECT doc_id FROM documents ORDER BY length(text) DESC NULLS LAST, doc_id LIMIT 2")
def longest_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").orderBy(F.length("text").desc_nulls_last(), "doc_id").limit(2).select("doc_id")


@query("SELECT doc_id AS id, text, 'golden' AS origin FROM documents WHERE lang = 'en' UNION ALL SELECT item_id, text, 'synthetic' FROM benchmark")
def tagged_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    golden = load(spark, sf_dir, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("id"), "text", F.lit("golden").alias("origin"))
    return golden.unionByName(load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text", F.lit("synthetic").alias("origin")))


@query("""WITH m AS (SELECT c_nationkey AS model, count(*) AS n, count(*) FILTER (c_custkey % 13 = 0) AS failed, count(*) FILTER (c_custkey % 26 = 0) AS rate_limited, CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE round(avg(c_acctbal), 2) END AS headline FROM customer GROUP BY c_nationkey)
SELECT model, headline FROM m WHERE (failed - rate_limited) / n <= 0.05 ORDER BY headline DESC NULLS LAST, model LIMIT 3""")
def model_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = load(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("model")).agg(
        F.count("*").alias("n"), F.count_if(F.col("c_custkey") % 13 == 0).alias("failed"), F.count_if(F.col("c_custkey") % 26 == 0).alias("rate_limited"),
        F.when(F.col("c_nationkey") % 5 != 0, F.round(F.avg("c_acctbal"), 2)).alias("headline"),
    )
    return reports.shortlist(models).select("model", "headline")


@query("""WITH u AS (SELECT event_id, unnest([value, CASE WHEN event_type <> 'click' THEN value / 2 END, CASE WHEN user_id % 2 = 0 THEN -1.0 END]) AS p FROM events)
SELECT event_id, round(avg(p), 5) AS mean, round(min(p), 5) AS least FROM u GROUP BY event_id""")
def logprob_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and least token log probability of an answer; three numbers of an event stand in, some of them missing."""
    p = F.array("value", F.when(F.col("event_type") != "click", F.col("value") / 2), F.when(F.col("user_id") % 2 == 0, -1.0))
    mean, least = reports.logprob_summary(p)
    return load(spark, sf_dir, "events").select("event_id", F.round(mean, 5).alias("mean"), F.round(least, 5).alias("least"))


@query("""SELECT user_id, count(*) AS attempts, CAST(sum(coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0)) AS BIGINT) AS tokens, round(sum(coalesce(value, 0)), 4) AS cost, round(sum(coalesce(value, 0)) + sum(coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0)), 4) AS total FROM events GROUP BY user_id""")
def attempt_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage over all attempts of a request, repairs included; what is not reported counts as nothing."""
    tokens, cost = F.sum(F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0))), F.sum(F.coalesce("value", F.lit(0.0)))
    return load(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("attempts"), tokens.alias("tokens"), F.round(cost, 4).alias("cost"), F.round(cost + tokens, 4).alias("total"))


@query("""WITH d AS (SELECT o_orderkey, o_custkey % 3 = 0 AS expects_none, o_custkey % 7 <> 0 AS found, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS k FROM orders)
SELECT CAST(coalesce(k, -1) AS INT) AS keys, count(*) AS n, count(*) FILTER (k = 2) AS unknown_ids, count(*) FILTER (k > 0 AND NOT found) AS unfound, count(*) FILTER (k > 0 AND expects_none) AS disagreed FROM d GROUP BY 1""")
def gold_draft_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed keys of orders: none, no key, one that was shown, or one more that was not."""
    key = F.col("o_orderkey") % 4
    ids = F.when(key == 1, F.array().cast("array<bigint>")).when(key == 2, F.array(F.lit(1).cast("bigint"))).when(key == 3, F.array(F.lit(1).cast("bigint"), F.lit(9).cast("bigint")))
    rows = load(spark, sf_dir, "orders").select(ids.alias("doc_ids"), F.array(F.lit(1).cast("bigint")).alias("shown"), (F.col("o_custkey") % 7 != 0).alias("found"), (F.col("o_custkey") % 3 == 0).alias("expects_none"))
    return reports.gold_report(rows)


@query("""SELECT source, lang, count(*) AS rows, count(text) AS texts FROM documents GROUP BY ALL""")
def file_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("rows"), F.count("text").alias("texts"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 OR url = '' THEN url ELSE url || '#' || 'a' || page_id END AS link, string_split('Help > Billing > Topic ' || page_id, ' > ')[3] AS leaf FROM pages""")
def section_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The address of a section (with its anchor, if both are there) and the last step of its breadcrumb."""
    anchor = F.when(F.col("page_id") % 3 == 0, "").otherwise(F.concat(F.lit("a"), F.col("page_id")))
    rows = load(spark, sf_dir, "pages").select("page_id", "url", anchor.alias("anchor"), F.concat(F.lit("Help > Billing > Topic "), F.col("page_id")).alias("heading"))
    link = F.when((F.col("anchor") != "") & (F.col("url") != ""), F.concat("url", F.lit("#"), "anchor")).otherwise(F.col("url"))
    return rows.select("page_id", link.alias("link"), F.trim(F.element_at(F.split("heading", " > "), -1)).alias("leaf"))


QUERIES, ORACLE_SQL = R.queries, R.sql
