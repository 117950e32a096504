"""Evaluation over recorded predictions: everything is an aggregate of a table of (gold, pred) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CORE_SUPPORT = 15


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def class_metrics(rows: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each label that is gold or predicted; zero where undefined."""
    sides = rows.select(F.explode(F.array(F.struct(F.col("gold").alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p")), F.struct(F.col("pred").alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p")))).alias("x"), (F.col("gold") == F.col("pred")).cast("int").alias("hit"))
    counts = sides.filter("x.label is not null").groupBy("x.label").agg(F.sum("x.g").alias("support"), F.sum("x.p").alias("predicted"), F.sum(F.col("x.g") * F.coalesce("hit", F.lit(0))).alias("tp"))
    p, r = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    scored = counts.withColumns({"precision": p, "recall": r}).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return scored.select("label", "support", "predicted", "tp", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


def macro_f1(rows: DataFrame, support: int = CORE_SUPPORT) -> DataFrame:
    """Mean F1 of the labels with enough support (null if none) and of all."""
    f1 = class_metrics(rows)
    return f1.agg(F.round(F.avg(F.when(F.col("support") >= support, F.col("f1"))), 6).alias("macro_core"), F.round(F.avg("f1"), 6).alias("macro_all"), F.count_if(F.col("support") < support).alias("rare_classes"))


def confusions(rows: DataFrame, top: int = 5) -> DataFrame:
    """The most frequent wrong pairs."""
    wrong = rows.filter("pred is not null and gold <> pred").groupBy("gold", "pred").agg(F.count("*").alias("n"))
    return wrong.orderBy(F.desc("n"), "gold", "pred").limit(top)


def majority(rows: DataFrame) -> DataFrame:
    """The most common gold label and its share."""
    counts = rows.groupBy("gold").agg(F.count("*").alias("n"))
    return counts.agg(F.max_by("gold", F.struct("n", "gold")).alias("label"), F.round(F.max("n") / F.sum("n"), 6).alias("share"))


def nearest_rank(values: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Sorted values at the truncated index n * p (clamped), of each group, with the largest."""
    order = Window.partitionBy(*by).orderBy(value)
    rows = values.select(*by, F.col(value).alias("v"), F.row_number().over(order).alias("rn"), F.count("*").over(Window.partitionBy(*by)).alias("n"))
    picks = [F.max(F.when(F.col("rn") == F.least(F.col("n"), F.floor(F.col("n") * p) + 1), F.col("v"))).alias(name) for name, p in shares.items()]
    return rows.groupBy(*by).agg(F.max("n").alias("n"), *picks, F.max("v").alias("max"))


def kendall(pairs: DataFrame) -> DataFrame:
    """Rank agreement of columns a and b over all pairs of items (a short list of ranked systems)."""
    x, y = pairs.alias("x"), pairs.alias("y")
    joined = x.join(y, F.col("x.item") < F.col("y.item"))
    sign = F.signum((F.col("x.a") - F.col("y.a")) * (F.col("x.b") - F.col("y.b")))
    agg = joined.agg(F.count_if(sign > 0).alias("concordant"), F.count_if(sign < 0).alias("discordant"))
    return agg.withColumn("tau", F.round(ratio((F.col("concordant") - F.col("discordant")).cast("double"), F.col("concordant") + F.col("discordant")), 6))
