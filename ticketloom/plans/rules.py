"""Rule-engine queries, relational checks and content-addressed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.functions.language import ENGLISH, FUNCTION_WORDS, SCRIPTS, guess_language
from ticketloom.operators import rules
from ticketloom.plans.registry import Registry
from ticketloom.session import load

R = Registry()
query = R.query

# Orders stand in for classified tickets.
CATEGORY = "CASE CAST(o_orderkey AS BIGINT) % 6 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(rules.ALLOWED)) + " END"
STEPS = ["refund_and_cancel", "cancel_only", "explain_charge", "bug_report", "redeliver", rules.ESCALATE, "route_to_human_review"]
STEP = "CASE CAST(o_custkey AS BIGINT) % 7 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(STEPS)) + " END"
PRIORITY = "CASE WHEN o_totalprice > 200000 THEN 'P1' WHEN o_totalprice > 100000 THEN 'P2' ELSE 'P3' END"
FACT = "CASE CAST(o_orderkey AS BIGINT) % 5 WHEN 0 THEN 'hardship' WHEN 1 THEN 'deadline' ELSE '' END"
OK = "(" + " OR ".join(f"(category = '{c}' AND step IN ({', '.join(repr(s) for s in steps)}))" for c, steps in rules.ALLOWED.items()) + ")"
TICKETS = f"t AS (SELECT o_orderkey AS id, {CATEGORY} AS category, {STEP} AS step, {PRIORITY} AS priority, {FACT} AS fact, o_orderpriority AS evidence FROM orders)"
VIOLATES = f"CASE WHEN step = '{rules.ESCALATE}' THEN priority <> 'P1' ELSE NOT {OK} END"
IMPLIED = "CASE WHEN fact = 'hardship' THEN 'P1' WHEN fact <> '' THEN 'P2' ELSE 'P3' END"


def _tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr(CATEGORY).alias("category"), F.expr(STEP).alias("step"), F.expr(PRIORITY).alias("priority"), F.expr(FACT).alias("fact"), F.col("o_orderpriority").alias("evidence"))
    return rows.withColumn("facts", F.expr("filter(array(fact), f -> f <> '')"))


@query(f"WITH {TICKETS} SELECT category, step, count(*) AS n FROM t WHERE {VIOLATES} GROUP BY ALL")
def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tickets(spark, sf_dir)
    return rows.filter(rules.violation(F.col("category"), F.col("step"), F.col("priority"))).groupBy("category", "step").agg(F.count("*").alias("n"))


@query(f"WITH {TICKETS} SELECT id, {IMPLIED} AS implied, {IMPLIED} <> priority AS contradicts FROM t")
def priority_from_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    implied = rules.priority_of(F.col("facts"))
    return _tickets(spark, sf_dir).select("id", implied.alias("implied"), (implied != F.col("priority")).alias("contradicts"))


@query(f"""WITH {TICKETS} SELECT id, concat_ws(',', CASE WHEN priority = 'P1' THEN 'p1' END, CASE WHEN category = 'other' THEN 'other' END, CASE WHEN {IMPLIED} <> priority THEN 'contradiction' END,
 CASE WHEN {VIOLATES} THEN 'table_violation' END, CASE WHEN evidence <> '' AND NOT contains('1-URGENT 2-HIGH', evidence) THEN 'evidence_invented' END) AS flags FROM t""")
def review_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = rules.review_flags(F.col("category"), F.col("step"), F.col("priority"), F.col("facts"), F.col("evidence"), F.lit("1-URGENT 2-HIGH"))
    return _tickets(spark, sf_dir).select("id", F.array_join(flags, ",").alias("flags"))


@query()
def boundary_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-behind patterns: no SQL here; tests hold them against must-fire and must-not-fire sentences."""
    found = rules.boundaries(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.array_join("flags", ",").alias("flags"), "halts")


@query()
def policy_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.guards(load(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", "turn", "text"))
    return found.select("conv_id", "turn", F.array_join("banned", ",").alias("banned"))


def _language_sql() -> str:
    words, turkish = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')", "regexp_extract_all(regexp_replace(lower(text), '[''’]ve|ve[''’]', ' ', 'g'), '[\\p{L}\\p{N}_]+')"
    score = lambda listed, source: f"len(list_intersect({source}, {listed.split()!r}))"
    best = ", ".join(f"{{'n': {score(w, turkish if lang == 'tr' else words)}, 'i': {-i}, 'lang': '{lang}'}}" for i, (lang, w) in enumerate(FUNCTION_WORDS.items()))
    scripts = " ".join(f"WHEN len(regexp_extract_all(text, '{p}')) >= 3 THEN '{name}'" for name, p in SCRIPTS.items())
    return f"""WITH s AS (SELECT doc_id, text, list_max([{best}]) AS b, {score(ENGLISH, words)} AS e FROM documents)
SELECT doc_id, CASE {scripts} WHEN b.n > e AND (b.n >= 3 OR e = 0) THEN b.lang ELSE 'en_or_unknown' END AS guess FROM s"""


@query(_language_sql())
def language_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", guess_language(F.col("text")).alias("guess"))


# Names and patterns of topics as these texts have them; any table of this form can be given.
PROBES = {"licence": "licen[cs]e", "network": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "address": "[a-z0-9.]+@[a-z0-9]+", "table": r" \| ", "shouting": "!!", "rights": "rights reserved"}


@query("SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN '{n}' END" for n, p in PROBES.items()) + ") AS topics FROM documents")
def topic_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("text")
    return load(spark, sf_dir, "documents").select("doc_id", F.concat_ws(",", *(F.when(low.rlike(p), n) for n, p in PROBES.items())).alias("topics"))


@query("""SELECT 'customers_without_orders' AS name, count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
UNION ALL SELECT 'customers_with_orders', count(*) FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
UNION ALL SELECT 'orders_without_customer', count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE o_custkey = c_custkey)
UNION ALL SELECT 'labels_without_document', count(*) FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)""")
def anti_semi_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Referential integrity as semi and anti joins."""
    customers, orders = load(spark, sf_dir, "customer").select("c_custkey"), load(spark, sf_dir, "orders").select("o_custkey")
    labels, docs = load(spark, sf_dir, "labels").select("doc_id"), load(spark, sf_dir, "documents").select("doc_id")
    on = F.col("c_custkey") == F.col("o_custkey")
    parts = {"customers_without_orders": customers.join(orders, on, "left_anti"), "customers_with_orders": customers.join(orders, on, "left_semi"), "orders_without_customer": orders.join(customers, on, "left_anti"), "labels_without_document": labels.join(docs, "doc_id", "left_anti")}
    counts = [rows.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, rows in parts.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@query("""SELECT 'union' AS op, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'except', count(*) FROM (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'union_all', count(*) FROM (SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier)""")
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("k"))
    s = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("k"))
    n = load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    parts = {"union": c.union(s).distinct(), "intersect": c.intersect(s), "except": n.subtract(s), "union_all": c.union(s)}
    out = None
    for name, rows in parts.items():
        one = rows.agg(F.lit(name).alias("op"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT source, sha256(string_agg(CAST(doc_id AS VARCHAR) || ':' || sha256(text), ';' ORDER BY doc_id)) AS fingerprint FROM documents GROUP BY source")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest over the ordered ids and text digests of each source: what an index was built from."""
    rows = load(spark, sf_dir, "documents").select("source", "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.sha2("text", 256)).alias("part"))
    ordered = F.array_sort(F.collect_list(F.struct("doc_id", "part")))
    return rows.groupBy("source").agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["part"]), ";"), 256).alias("fingerprint"))


@query("SELECT event_id, substr(sha256(concat_ws(chr(31), event_type, CAST(user_id AS VARCHAR), printf('%.3f', value))), 1, 16) AS key FROM events")
def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.concat_ws("\u001f", "event_type", F.col("user_id").cast("string"), F.format_string("%.3f", "value"))
    return load(spark, sf_dir, "events").select("event_id", F.substring(F.sha2(parts, 256), 1, 16).alias("key"))


@query("""WITH old AS (SELECT user_id AS run, min(event_id) AS v FROM events WHERE event_type <> 'click' GROUP BY user_id), new AS (SELECT user_id AS run, max(event_id) AS v FROM events WHERE event_type = 'click' GROUP BY user_id)
SELECT run, v FROM new UNION ALL SELECT run, v FROM old WHERE run NOT IN (SELECT run FROM new)""")
def ledger_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with the same key are replaced, others are kept."""
    events = load(spark, sf_dir, "events")
    old = events.filter("event_type <> 'click'").groupBy(F.col("user_id").alias("run")).agg(F.min("event_id").alias("v"))
    new = events.filter("event_type = 'click'").groupBy(F.col("user_id").alias("run")).agg(F.max("event_id").alias("v"))
    return old.join(new, "run", "left_anti").unionByName(new)


QUERIES, ORACLE_SQL = R.queries, R.sql
