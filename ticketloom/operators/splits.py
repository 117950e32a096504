"""Samples and split repairs of small labelled sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows by a seeded digest of the key: the same whatever the partitioning."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def smoke(rows: DataFrame, key: str, branches: list[tuple[str, Column, int]]) -> DataFrame:
    """The union of small samples in order; a row counts for the first branch that takes it."""
    hits = F.array(*(F.when(condition, F.struct(F.lit(i).alias("i"), F.lit(name).alias("branch"), F.lit(n).alias("n"))) for i, (name, condition, n) in enumerate(branches)))
    listed = rows.select(key, F.explode(F.filter(hits, F.isnotnull)).alias("b")).select(key, "b.*")
    taken = listed.withColumn("rn", F.row_number().over(Window.partitionBy("i").orderBy(key))).filter("rn <= n")
    return taken.groupBy(key).agg(F.min_by("branch", "i").alias("branch"))


def repair_coverage(assigned: list[dict], part: str, by: str, donor: str, least: int = 1) -> list[dict]:
    """Swaps between two parts until each value of ``by`` that has ``least`` rows is in ``part``.

    A row of the missing value comes from ``donor``; a row of the most common value of ``part`` goes there.
    Rows are dicts with ``unit``, ``part`` and ``by``; the order of units decides ties. For sets of a few hundred rows.
    """
    rows = [dict(r) for r in sorted(assigned, key=lambda r: r["unit"])]
    totals: dict[str, int] = {}
    for r in rows:
        totals[r[by]] = totals.get(r[by], 0) + 1
    for value in sorted(v for v, n in totals.items() if n >= least):
        inside = [r for r in rows if r["part"] == part]
        if any(r[by] == value for r in inside):
            continue
        giver = next((r for r in rows if r["part"] == donor and r[by] == value), None)
        counts: dict[str, int] = {}
        for r in inside:
            counts[r[by]] = counts.get(r[by], 0) + 1
        spare = [r for r in inside if counts[r[by]] > 1]
        if giver and spare:
            common = max(spare, key=lambda r: (counts[r[by]], r[by]))
            giver["part"], common["part"] = part, donor
    return rows
