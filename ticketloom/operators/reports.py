"""Reports over evaluation runs and drafts: every figure is an aggregate, ids are rows or short lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.functions.text import strip
from ticketloom.operators.metrics import CORE_SUPPORT, macro_f1, ratio

# What a draft must or must not hold.
GREETING = r"^\s*(hello|hi|dear|good (morning|afternoon|evening))"
SIGNOFF = ["best regards", "kind regards", "sincerely", "warm regards", "best wishes", "regards,"]
FILLER = [r"we understand your frustration", r"apolog\w+ for any inconvenience", "we value your feedback", "thank you for your patience", "rest assured"]
SENTENCE_END = r"[.!?]+(?:\s|$)"


def headline(fields: dict[str, DataFrame], support: int = CORE_SUPPORT) -> DataFrame:
    """The mean core score of several fields' (gold, pred) rows; null unless each field has one."""
    parts = [macro_f1(rows, support).select(F.lit(name).alias("field"), F.col("macro_core").alias("f1")) for name, rows in fields.items()]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.agg(F.round(F.when(F.count("f1") == len(fields), F.avg("f1")), 6).alias("headline"))


def hits_and_misses(rows: DataFrame, step: str) -> DataFrame:
    """How often one label was found, and the rows that missed it or have it in excess."""
    gold, pred = F.coalesce(F.col("gold") == step, F.lit(False)), F.coalesce(F.col("pred") == step, F.lit(False))
    return rows.filter(gold | pred).select("id", F.when(gold & pred, "found").when(gold, "missed").otherwise("extra").alias("kind"))


def support(rows: DataFrame, label: str, least: int = CORE_SUPPORT) -> DataFrame:
    """Rows of each label, the most common first, and whether it counts for the headline."""
    counts = rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy(F.desc("n"), "label"))  # a vocabulary of labels
    return counts.select("label", "n", (F.col("n") >= least).alias("counts"), place.alias("place"))


def rail(rows: DataFrame, by: str) -> DataFrame:
    """Whether the first section returned (``got``, null if none) is the wanted one, where one is wanted."""
    known = rows.filter("want IS NOT NULL AND NOT uncertain AND returned")
    right, silent = F.count_if(F.col("got") == F.col("want")), F.count_if(F.col("got").isNull())
    return known.groupBy(by).agg(right.alias("right"), F.count_if(F.col("got") != F.col("want")).alias("wrong"), silent.alias("silent"), F.round(right / F.count("*"), 6).alias("share"))


def run_delta(runs: DataFrame, stamp: str, cell: list[str], value: str) -> DataFrame:
    """The newest two runs side by side by cell; a cell that the older lacks has no delta."""
    newest = runs.select(stamp).distinct().orderBy(F.desc(stamp)).limit(2)
    place = newest.select(stamp, F.row_number().over(Window.orderBy(F.desc(stamp))).alias("place"))  # two rows
    both = runs.join(F.broadcast(place), stamp).groupBy(*cell).agg(F.max(F.when(F.col("place") == 2, F.col(value))).alias("before"), F.max(F.when(F.col("place") == 1, F.col(value))).alias("after"))
    return both.filter("after IS NOT NULL").withColumn("delta", F.round(F.col("after") - F.col("before"), 6))


def sentences(text: Column) -> Column:
    """Parts between ends of sentences that hold something."""
    return F.size(F.filter(F.split(strip(text), SENTENCE_END), lambda s: strip(s) != ""))


def draft_shape(concise: Column, formal: Column, empathetic: Column, team: str, most: int = 3) -> dict[str, Column]:
    """Seven checks of the three tones of a draft; ``team`` is the name that signs."""
    greets = lambda c: c.rlike(f"(?iU){GREETING}")
    signs = lambda c: c.rlike(f"(?iU){'|'.join([*SIGNOFF, team])}")
    return {
        "concise_short": sentences(concise) <= most, "concise_no_greeting": ~greets(concise), "concise_no_signoff": ~signs(concise),
        "formal_greeting": greets(formal), "formal_signoff": signs(formal), "empathetic_no_greeting": ~greets(empathetic), "empathetic_no_filler": ~empathetic.rlike(f"(?iU){'|'.join(FILLER)}"),
    }


def flag_rates(rows: DataFrame, flags: str, first: int = 4) -> DataFrame:
    """Rows with each flag, their share of all rows and the smallest ids."""
    total = rows.agg(F.count("*").alias("total"))
    hit = rows.select("id", F.explode(flags).alias("flag"))
    ranked = hit.withColumn("place", F.row_number().over(Window.partitionBy("flag").orderBy("id")))  # Spark keeps the first per task
    least = ranked.filter(F.col("place") <= first).groupBy("flag").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    counts = hit.groupBy("flag").agg(F.count("*").alias("n"))
    return counts.join(least, "flag").crossJoin(total).select("flag", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"), "ids")


def hit_rate(rows: DataFrame, hit: str) -> DataFrame:
    hits, n = F.count_if(F.col(hit)), F.count(hit)
    return rows.agg(hits.alias("hits"), (n - hits).alias("misses"), F.round(ratio(hits.cast("double"), n), 6).alias("hit_rate"))


def clip(text: Column, n: int) -> Column:
    """Single spaces, the first n characters, pipes escaped for a table."""
    flat = strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.replace(F.substring(flat, 1, n), F.lit("|"), F.lit("\\|"))


def logprob_summary(logprobs: Column) -> tuple[Column, Column]:
    """Mean and least of an array's numbers, null without any."""
    known = F.filter(logprobs, F.isnotnull)
    total = F.aggregate(known, F.lit(0.0), lambda a, x: a + x)
    return F.try_divide(total, F.size(known)), F.array_min(known)


def shortlist(models: DataFrame, best: int = 3, failures: float = 0.05) -> DataFrame:
    """Models that fail on too many rows (rate limits aside) go; the highest headlines stay, null ones last."""
    fit = models.filter(F.coalesce(F.try_divide(F.col("failed") - F.col("rate_limited"), F.col("n")), F.lit(0.0)) <= failures)
    return fit.orderBy(F.desc_nulls_last("headline"), "model").limit(best)


def gold_report(drafts: DataFrame) -> DataFrame:
    """Proposed keys by number (-1: no draft), with ids that were not shown, quotes not found and refusals against the label."""
    size = F.when(F.col("doc_ids").isNull(), -1).otherwise(F.size("doc_ids"))
    unknown = F.coalesce(F.size(F.filter("doc_ids", lambda i: ~F.array_contains("shown", i))), F.lit(0))
    return drafts.groupBy(size.alias("keys")).agg(
        F.count("*").alias("n"), F.sum(unknown).alias("unknown_ids"),
        F.count_if((size > 0) & ~F.coalesce("found", F.lit(False))).alias("unfound"), F.count_if((size > 0) & F.col("expects_none")).alias("disagreed"),
    )
