"""Corpus queries: derived columns, deduplication, funnels, pages, redaction, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketloom.functions import text as T
from ticketloom.operators import corpus, knowledge, redaction
from ticketloom.plans.registry import Registry
from ticketloom.session import load

R = Registry()
query = R.query
NORM = r"trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g'), '^ | $', '', 'g'))"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


@query("SELECT doc_id, length(text) AS chars, n_chars >= 150 AS usable_as_ticket, CAST(round_even(length(text) / 4, 0) AS BIGINT) AS tokens_est, CAST(doc_id % 5 + 1 <= 2 AS BOOLEAN) AS is_complaint, concat('dc:', doc_id, '/', lang) AS uid FROM documents")
def corpus_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return docs.select("doc_id", F.length("text").cast("long").alias("chars"), (F.col("n_chars") >= 150).alias("usable_as_ticket"), T.tokens_estimate(F.col("text")).alias("tokens_est"), (F.col("doc_id") % 5 + 1 <= 2).alias("is_complaint"), F.concat(F.lit("dc:"), "doc_id", F.lit("/"), "lang").alias("uid"))


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS digest, count(*) AS copies FROM documents GROUP BY text")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first copy of each text; keyed by digest, so that texts are not shuffled."""
    return load(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest")).groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query(rf"SELECT min(doc_id) AS doc_id, count(*) AS copies, sha256({NORM}) AS digest FROM documents GROUP BY {NORM}")
def dedup_norm_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(T.strip(T.normalise(F.col("text"))), 256)
    return load(spark, sf_dir, "documents").select("doc_id", digest.alias("digest")).groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("WITH d AS (SELECT DISTINCT sha256(text) AS k, source FROM documents), f AS (SELECT k, min(source) AS first FROM d GROUP BY k) SELECT source, count(*) AS got, count(*) FILTER (source = first) AS new FROM d JOIN f USING (k) GROUP BY source")
def novelty_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("k"), "source")
    return corpus.novelty(rows, "k", "source")


ASKS, WRONG, WARNS = (rf"(^|[^\p{{L}}\p{{N}}_])({w})($|[^\p{{L}}\p{{N}}_])" for w in ("this|that|what|que|die", "not|was|les|der|las", "beware|avoid"))


@query(rf"""WITH s AS (SELECT count(*) AS total, count(*) FILTER (a) AS s0, count(*) FILTER (a AND b) AS s1, count(*) FILTER (a AND b AND c) AS s2, count(*) FILTER (a AND b AND c AND d) AS s3 FROM
 (SELECT n_chars >= 120 AS a, regexp_matches(lower(text), '{ASKS}') AS b, regexp_matches(lower(text), '{WRONG}') AS c, NOT regexp_matches(lower(text), '{WARNS}') AS d FROM documents)),
u AS (SELECT 0 AS stage, 'long_enough' AS name, s0 AS n, total AS before FROM s UNION ALL SELECT 1, 'asks', s1, s0 FROM s UNION ALL SELECT 2, 'problem', s2, s1 FROM s UNION ALL SELECT 3, 'no_warning', s3, s2 FROM s)
SELECT stage, name, n, round(n / before, 6) AS share FROM u""")
def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shape of a selection funnel on these texts; the selection rules for tickets are in operators.tickets."""
    low = F.lower("text")
    stages = {"long_enough": F.col("n_chars") >= 120, "asks": low.rlike(ASKS), "problem": low.rlike(WRONG), "no_warning": ~low.rlike(WARNS)}
    return corpus.funnel(load(spark, sf_dir, "documents"), stages)


@query(rf"SELECT doc_id, lower(nullif(regexp_extract(text, '{EMAIL}'), '')) AS email, CASE WHEN regexp_extract(text, '{EMAIL}') = '' THEN NULL ELSE regexp_extract(text, '{EMAIL}') LIKE '%example.com' END AS valid FROM documents")
def first_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first address of a text and whether it is of an allowed domain; null where there is none."""
    found = load(spark, sf_dir, "documents").select("doc_id", T.first_email(F.col("text")).alias("email"), F.nullif(F.regexp_extract("text", EMAIL, 0), F.lit("")).alias("raw"))
    return found.select("doc_id", "email", F.col("raw").endswith("example.com").alias("valid"))


@query("""WITH t AS (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT event_id, CAST(date_diff('second', date_trunc('second', before), date_trunc('second', ts)) AS BIGINT) AS latency_sec FROM t""")
def reply_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds from a client's last request to this one; null for the first."""
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = load(spark, sf_dir, "events").select("event_id", "user_id", "ts").withColumn("before", before)
    return rows.select("event_id", (F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.col("before").cast("timestamp"))).alias("latency_sec"))


@query("SELECT a.conv_id, a.turn, length(a.text) AS asked, length(b.text) AS answered FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant' WHERE a.role = 'user'")
def thread_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the answer right after it, if there is one."""
    rows = load(spark, sf_dir, "conversations")
    asked = rows.filter("role = 'user'").select("conv_id", "turn", F.length("text").cast("long").alias("asked"))
    answered = rows.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.length("text").cast("long").alias("answered"))
    return asked.join(answered, ["conv_id", "turn"], "left")


_HTML = r"regexp_replace(html, '<li[^>]*>', chr(10) || '- ', 'gi')"
_HTML = rf"regexp_replace({_HTML}, '<(?:br|/p|/div|/h[1-6]|/li|/ul|/ol|/tr)[^>]*>', chr(10), 'gi')"
_HTML = rf"regexp_replace({_HTML}, '<[^>]+>', '', 'g')"
for _a, _b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _HTML = f"replace({_HTML}, '{_a}', '{_b}')"
_HTML = rf"trim(regexp_replace(regexp_replace({_HTML}, '[ \t]+', ' ', 'g'), '\n[ \n]*\n', chr(10) || chr(10), 'g'), ' ')"


@query(f"SELECT page_id, {_HTML} AS text FROM pages")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


HOST = r"regexp_extract(url, '^[a-z]+://([^/]+)', 1)"


@query(f"SELECT page_id, {HOST} AS host, {HOST} <> '' AND count(*) OVER (PARTITION BY {HOST}) > 1 AS shared FROM pages")
def shared_url_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose host other pages share; counted first and joined, so that a hot host is not gathered."""
    pages = load(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("host"))
    counts = pages.groupBy("host").agg(F.count("*").alias("n"))
    return pages.join(counts, "host").select("page_id", "host", ((F.col("host") != "") & (F.col("n") > 1)).alias("shared"))


CONTACT = [(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[Email]"), (r"\+?[0-9][0-9 ().-]{7,}[0-9]", "[Phone]"), (r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "[Address]")]
_RED = "text"
for _p, _s in CONTACT:
    _RED = f"regexp_replace({_RED}, '{_p}', '{_s}', 'g')"


@query(f"SELECT doc_id, sha256({_RED}) AS digest, {_RED} <> text AS changed FROM documents")
def redact_contact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contact data replaced by placeholders, in order, with a mark where something changed."""
    x = F.col("text")
    for pattern, sign in CONTACT:
        x = F.regexp_replace(x, pattern, sign)
    return load(spark, sf_dir, "documents").select("doc_id", "text", x.alias("after")).select("doc_id", F.sha2("after", 256).alias("digest"), (F.col("after") != F.col("text")).alias("changed"))


@query(" UNION ALL ".join(f"SELECT '{s}' AS category, count(*) FILTER (n > 0) AS rows, CAST(sum(n) AS BIGINT) AS findings FROM (SELECT len(regexp_extract_all(text, '{p}')) AS n FROM documents)" for p, s in CONTACT))
def audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an audit of the unredacted texts finds, by category, in one pass."""
    cells = [F.struct(F.lit(sign).alias("category"), F.regexp_count("text", F.lit(p)).cast("long").alias("n")) for p, sign in CONTACT]
    found = load(spark, sf_dir, "documents").select(F.explode(F.array(*cells)).alias("c"))
    return found.groupBy("c.category").agg(F.count_if(F.col("c.n") > 0).alias("rows"), F.sum("c.n").alias("findings"))


@query("SELECT source, 'lang' AS dimension, lang AS value, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT source, 'size', CASE WHEN n_chars < 1000 THEN 'short' ELSE 'long' END, count(*) FROM documents GROUP BY ALL")
def composition_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").select("source", "lang", F.when(F.col("n_chars") < 1000, "short").otherwise("long").alias("size"))
    return corpus.composition(rows, "source", ["lang", "size"])


@query("SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'es') AS es FROM documents GROUP BY source")
def pivot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").groupBy("source").pivot("lang", ["en", "fr", "de", "es"]).agg(F.count(F.lit(1))).na.fill(0)


@query("WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents) SELECT doc_id FROM o WHERE (rn - 1) % 7 = 0 AND rn <= 7 * 100")
def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A systematic sample: a limit of 100 rows, every seventh, is the operator's own."""
    return corpus.stride(load(spark, sf_dir, "documents").select("doc_id"), "doc_id", 7, 100)


@query("""WITH RECURSIVE u AS (SELECT n_name AS unit, row_number() OVER (ORDER BY n_name) AS i FROM nation),
w AS (SELECT 0::BIGINT AS i, 0 AS a, 0 AS b, 0 AS c, '' AS part UNION ALL
 SELECT i + 1, a + (p = 'dev')::INT, b + (p = 'few')::INT, c + (p = 'gold')::INT, p FROM
 (SELECT *, list_sort([{'p': CASE WHEN a < 8 THEN 8 / (a + 0.5) ELSE -1 END, 'n': 'dev'}, {'p': CASE WHEN b < 3 THEN 3 / (b + 0.5) ELSE -1 END, 'n': 'few'}, {'p': CASE WHEN c < 14 THEN 14 / (c + 0.5) ELSE -1 END, 'n': 'gold'}])[3].n AS p FROM w WHERE i < 25))
SELECT unit, part FROM w JOIN u USING (i)""")
def webster_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.webster(load(spark, sf_dir, "nation").select(F.col("n_name").alias("unit")), {"dev": 8, "few": 3, "gold": 14})


@query()
def audit_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an audit finds in replies before redaction; look-behind patterns, so tests hold it against sentences."""
    rows = load(spark, sf_dir, "documents").select("doc_id", "text")
    return redaction.audit_report(redaction.audit(rows, "text"))


@query()
def redact_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = redaction.redact(load(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return done.select("doc_id", "changed", F.sha2("text", 256).alias("digest"))


@query()
def html_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of pages, small ones merged into the one before."""
    return knowledge.merge_small(knowledge.sections(load(spark, sf_dir, "pages"))).select("doc_id", "n", "heading", F.length("body").alias("chars"))


@query()
def near_dup_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' sections without near-duplicates, host by host."""
    pages = load(spark, sf_dir, "pages")
    hosts = pages.select(F.col("page_id").alias("doc_id"), F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("source"))
    return knowledge.collapse(knowledge.merge_small(knowledge.sections(pages)).join(hosts, "doc_id"))


QUERIES, ORACLE_SQL = R.queries, R.sql
