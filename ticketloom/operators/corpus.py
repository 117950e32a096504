"""Corpus building: deduplication in read order, novelty, selection funnels, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(rows: DataFrame, keys: list[Column | str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in the given order."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("loom_rn", F.row_number().over(first)).filter("loom_rn = 1").drop("loom_rn")


def novelty(rows: DataFrame, key: str, group: str) -> DataFrame:
    """Of each group, in its order: distinct keys, and those that no earlier group has."""
    distinct = rows.select(key, group).distinct()
    first = distinct.groupBy(key).agg(F.min(group).alias("first"))
    return distinct.join(first, key).groupBy(group).agg(F.count("*").alias("got"), F.count_if(F.col(group) == F.col("first")).alias("new"))


def funnel(rows: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """Rows left after each stage, and their share of those before it, in one pass."""
    kept, sums = F.lit(True), []
    for i, (name, condition) in enumerate(stages.items()):
        kept = kept & condition
        sums.append(F.struct(F.lit(i).alias("stage"), F.lit(name).alias("name"), F.count_if(kept).alias("n")))
    table = rows.agg(F.count("*").alias("total"), F.array(*sums).alias("s")).select("total", F.explode("s").alias("s")).select("total", "s.*")
    before = F.coalesce(F.lag("n").over(Window.orderBy("stage")), F.col("total"))  # one row for each stage
    return table.select("stage", "name", "n", F.round(F.coalesce(F.try_divide(F.col("n"), before), F.lit(0.0)), 6).alias("share"))


def stride(rows: DataFrame, order: str, step: int, limit: int) -> DataFrame:
    """Every step-th row in order, up to a limit; a systematic sample by rank."""
    ranked = rows.withColumn("loom_rank", F.row_number().over(Window.orderBy(order)))
    return ranked.filter(((F.col("loom_rank") - 1) % step == 0) & (F.col("loom_rank") <= step * limit)).drop("loom_rank")


def composition(rows: DataFrame, part: str, dimensions: list[str]) -> DataFrame:
    """Counts of each value of each dimension in each part."""
    cells = F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions))
    return rows.select(part, F.explode(cells).alias("c")).groupBy(part, "c.dimension", "c.value").agg(F.count("*").alias("n"))


def webster(units: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """Units in order, each to the set with room and the largest quota / (assigned + 0.5); ties by the larger name.

    Sequential by definition: the fold runs over the (few) ordered units of a labelled set.
    """
    names = sorted(quotas)
    init = F.struct(F.array(*(F.lit(0) for _ in names)).alias("got"), F.array().cast("array<string>").alias("out"))
    quota = F.array(*(F.lit(quotas[n]) for n in names))
    label = F.array(*(F.lit(n) for n in names))

    def place(state: Column, _: Column) -> Column:
        options = F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda i: F.struct((F.get(quota, i) / (F.get(state["got"], i) + 0.5)).alias("p"), F.get(label, i).alias("name"), i.alias("i"), (F.get(state["got"], i) < F.get(quota, i)).alias("room")))
        best = F.array_max(F.filter(options, lambda o: o["room"]))
        got = F.transform(state["got"], lambda g, i: g + F.when(i == best["i"], 1).otherwise(0))
        return F.struct(got.alias("got"), F.concat(state["out"], F.array(best["name"])).alias("out"))

    listed = units.agg(F.array_sort(F.collect_list("unit")).alias("units"))
    folded = listed.select("units", F.aggregate("units", init, place, lambda s: s["out"]).alias("sets"))
    return folded.select(F.explode(F.arrays_zip("units", "sets")).alias("x")).select(F.col("x.units").alias("unit"), F.col("x.sets").alias("part"))
