"""Quality rules with risk-controlled thresholds (operator 5), in DataFrame functions alone.

A rule rejects a document whose metric is above its cutoff. The cutoffs of all rules
are taken along one path of steps, from the loosest to the strictest. For every
stratum (language) the steps are tested in order on all its labelled good documents:
a step passes if the exact binomial probability of at most the rejections seen by any
rule, were the rate of false rejections ``ALPHA``, is no more than ``DELTA`` / strata.
The last step before the first that fails is used. Testing in a fixed order needs no
correction among the steps; the division corrects among the strata that have labels
enough to pass a step without rejections, which does not depend on any rejection. So
with probability 1 - ``DELTA`` no stratum loses more than ``ALPHA`` of its good
documents to the rules. A stratum without enough labels (about 200) has no cutoffs.

Defined results: null and empty texts have no words and fail the base; a null
language and an empty one are one stratum; repeated labels of a document count once,
as bad if any says so; rows that share a doc_id, and repeated rows, are judged one by
one; a null doc_id has no label; very long texts are measured whole; without labels
only the base rejects; other columns do not matter whatever their names; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.session import drop_table, materialise

ALPHA, DELTA = 0.02, 0.1
WINDOW = 8
GAP = r"[\x20\x09-\x0D]+"
#: Steps of the path, and each rule's metric with its cutoffs at the first step and at the last; between them they fall evenly by ratio.
STEPS = 24
RULES: dict[str, tuple[str, float, float]] = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", 0.6, 0.002),
    "capitals": ("n_capitals / greatest(word_chars, 1)", 0.9, 0.05),
    "exclamations": ("n_exclamations / greatest(n_words, 1)", 2.0, 0.01),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", 0.28, 0.01),
    "lines": ("n_dup_lines / greatest(n_lines, 1)", 0.95, 0.02),
}


def cutoff(rule: str, step: int) -> float:
    """The cutoff of a rule at a step."""
    _, loose, strict = RULES[rule]
    return round(loose * (strict / loose) ** (step / (STEPS - 1)), 6)


def repeat_words(hashes: str) -> Column:
    """Words in windows that occur twice or more, of the window hashes in start order (each window once sorted by hash)."""
    return F.expr(f"""
      CASE WHEN size({hashes}) = size(array_distinct({hashes})) THEN 0L ELSE
        element_at(transform(array(sort_array(transform({hashes}, (h, i) -> named_struct('h', h, 'i', i)))), s ->
          aggregate(
            sort_array(transform(filter(sequence(0, size(s) - 1), j -> (j > 0 AND get(s, j).h = get(s, j - 1).h) OR (j < size(s) - 1 AND get(s, j).h = get(s, j + 1).h)), j -> get(s, j).i)),
            named_struct('n', 0L, 'e', 0L),
            (a, p) -> named_struct('n', a.n + {WINDOW} - greatest(0L, a.e - p), 'e', cast(p + {WINDOW} AS long)),
            a -> a.n)), 1) END""")


def metrics(docs: DataFrame, carried: Column | None = None) -> DataFrame:
    """doc_id, lang and the counts of each row, beside ``carried`` as loom_row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    beside = [] if carried is None else ["loom_row"]
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), text.alias("text"), *([carried.alias("loom_row")] if beside else []))
    split = base.select(
        "doc_id", "lang", "text", *beside,
        F.filter(F.split("text", GAP), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    hashed = split.select("*", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    eight = ", ".join(f"get(hashes, i + {k})" for k in range(WINDOW))
    windows = hashed.select("*", F.expr(f"CASE WHEN size(hashes) < {WINDOW} THEN array() ELSE transform(sequence(0, size(hashes) - {WINDOW}), i -> xxhash64({eight})) END").alias("windows"))
    without = lambda pattern: F.length("text") - F.length(F.regexp_replace("text", pattern, ""))
    return windows.select(
        "doc_id", "lang", *beside,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        without("[#*$%&|<>]+").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words("windows").cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        without("[A-Z]+").cast("long").alias("n_capitals"),
        without("!+").cast("long").alias("n_exclamations"),
    ).withColumn("base_failed", F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words"))


def log_factorial(x: str) -> str:
    """ln x!; exact up to 20, then Stirling's series, whose relative error is below 1e-11 there."""
    return f"(CASE WHEN {x} <= 20 THEN ln(cast(factorial(cast(least({x}, 20) AS int)) AS double)) ELSE {x} * ln({x}) - {x} + 0.5 * ln(2 * pi() * {x}) + 1 / (12D * {x}) - 1 / (360D * pow({x}, 3)) + 1 / (1260D * pow({x}, 5)) END)"


def binomial_tail(k: str, n: str, p: str) -> str:
    """P(X <= k) for X binomial(n, p) below its mean (1 above): the terms from k down, until they are no part of a double.

    Terms fall faster than those of a normal distribution, so that 14 of its widths hold all that counts.
    """
    term = f"exp({log_factorial(n)} - {log_factorial('i')} - {log_factorial(f'({n} - i)')} + i * ln({p}) + ({n} - i) * ln(1 - {p}))"
    low = f"greatest(0L, {k} - 100L - cast(14 * sqrt({n} * {p}) AS long))"
    return f"(CASE WHEN {n} = 0 OR {k} >= {n} * {p} THEN 1D ELSE least(1D, aggregate(sequence({low}, {k}), 0D, (a, i) -> a + {term})) END)"


def stratum(lang: str = "lang") -> Column:
    return F.coalesce(F.col(lang), F.lit(""))


def rejected_at(step: int) -> str:
    """Whether any rule rejects at a step; metrics are rounded, so that sums in any order agree."""
    return "(" + " OR ".join(f"round({metric}, 9) > {cutoff(rule, step)}D" for rule, (metric, *_) in RULES.items()) + ")"


def first_rejected() -> Column:
    """The first step of the path that rejects a document; STEPS if none does. Later steps reject it too."""
    return F.expr("CASE " + " ".join(f"WHEN {rejected_at(j)} THEN {j}" for j in range(STEPS)) + f" ELSE {STEPS} END")


def good_labels(labels: DataFrame) -> DataFrame:
    """doc_id of documents that are labelled good and nowhere bad."""
    return labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("quality")).filter("quality = 1").select("doc_id")


def certified(counts: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, n_labelled, steps (that passed) of (stratum, first, n): good documents by the first step that rejects them."""
    by = counts.groupBy("stratum").agg(F.sum("n").alias("n_labelled"), F.map_from_entries(F.collect_list(F.struct("first", "n"))).alias("at"))  # STEPS + 1 entries
    testable = by.agg(F.count_if(F.expr(f"pow(1 - {alpha}D, n_labelled) <= {delta}D")).alias("strata"))
    tests = by.crossJoin(F.broadcast(testable)).select("*", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1))).alias("step"))  # testable is one row
    tests = tests.withColumn("k", F.expr("aggregate(sequence(0, step), 0L, (a, i) -> a + coalesce(at[i], 0L))"))
    tests = tests.withColumn("passed", F.expr(f"{binomial_tail('k', 'n_labelled', f'{alpha}D')} <= {delta}D / greatest(strata, 1)"))
    return tests.groupBy("stratum").agg(F.max("n_labelled").alias("n_labelled"), F.coalesce(F.min(F.when(~F.col("passed"), F.col("step"))), F.lit(STEPS)).alias("steps"))


def cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Of each stratum how many steps of the path are certified."""
    held = measured.filter("NOT base_failed").join(good_labels(labels), "doc_id").select(stratum().alias("stratum"), first_rejected().alias("first"))
    return certified(held.groupBy("stratum", "first").agg(F.count("*").alias("n")), alpha, delta)


def decide(measured: DataFrame, table: DataFrame) -> DataFrame:
    """``kept`` for each row of metrics(); the table of strata is small in practice, and is joined as its size allows."""
    joined = measured.join(table.select("stratum", "steps"), stratum() == F.col("stratum"), "left")
    kept = (~F.col("base_failed")) & (first_rejected() >= F.coalesce("steps", F.lit(0)))
    return joined.withColumn("kept", kept).drop("stratum", "steps")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """metrics() of each row with ``kept``."""
    measured = materialise(metrics(docs), "metrics")
    return decide(measured, materialise(cutoffs(measured, labels), "cutoffs"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that judge() keeps.

    Metrics are taken twice, first for the cutoffs and then beside the rows, so that texts are neither written a
    second time nor shuffled; the tables for the cutoffs are deleted.
    """
    names = docs.columns
    whole = F.struct(*(docs[c].alias(f"c{i}") for i, c in enumerate(names)))
    measured = materialise(metrics(docs), "metrics")
    table = materialise(cutoffs(measured, labels), "cutoffs")
    drop_table(measured)
    # a generator between keeps the optimizer from writing the metrics anew into each rule of the filter
    again = metrics(docs, whole)
    again = again.select(F.explode_outer(F.array(F.struct(*again.columns))).alias("x")).select("x.*")
    return decide(again, table).filter("kept").select(*(F.col("loom_row")[f"c{i}"].alias(c) for i, c in enumerate(names)))


def sql() -> str:
    """The same for an SQL engine, over documents and labels with unique doc_ids."""
    word = r"[^\x20\x09-\x0D]"
    plain = lambda step: rejected_at(step).replace("D)", ")").replace("D OR", " OR")
    first = "CASE " + " ".join(f"WHEN {plain(j)} THEN {j}" for j in range(STEPS)) + f" ELSE {STEPS} END"
    term = f"exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA}) + (n - i) * ln(1 - {ALPHA}))"
    return f"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{word}')) AS l FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS p, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS gram FROM w WHERE len(w) >= {WINDOW}),
r AS (SELECT doc_id, p FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
c AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + {WINDOW})) AS q FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
 CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(l) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals, length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclamations FROM w LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {first} AS first FROM m),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
h AS (SELECT stratum, first FROM b JOIN good USING (doc_id) WHERE NOT base_failed),
s AS (SELECT stratum, count(*) AS n FROM h GROUP BY stratum),
z AS (SELECT greatest(count(*) FILTER (pow(1 - {ALPHA}, n) <= {DELTA}), 1) AS strata FROM s),
t AS (SELECT stratum, n, step, (SELECT count(*) FROM h WHERE h.stratum = s.stratum AND first <= step) AS k FROM s, (SELECT unnest(range({STEPS})) AS step)),
p AS (SELECT stratum, step, CASE WHEN k >= n * {ALPHA} THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda i: {term})) END <= {DELTA} / strata AS passed FROM t, z),
f AS (SELECT stratum, coalesce(min(step) FILTER (NOT passed), {STEPS}) AS steps FROM p GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND first >= coalesce(steps, 0) AS kept FROM b LEFT JOIN f USING (stratum)"""
