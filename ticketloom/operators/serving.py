"""Admission control over a request log: sliding limits and daily budgets."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LIMIT, SPAN = 5, 20.0


def admit(times: list[float], recent: deque[float], limit: int = LIMIT, span: float = SPAN) -> list[bool]:
    """Which requests pass; only admitted ones count, and they count for more than ``span`` seconds."""
    out = []
    for now in times:
        while recent and now - recent[0] > span:
            recent.popleft()
        ok = len(recent) < limit
        if ok:
            recent.append(now)
        out.append(ok)
    return out


def limiter(requests: DataFrame, limit: int = LIMIT, span: float = SPAN) -> DataFrame:
    """requests (client, id, t) with ``admitted``; clients are independent, each one's requests in order of time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, recent = None, deque()  # rows come sorted by client and time; a client's state ends with its rows
        for rows in batches:
            out = []
            for who, part in rows.groupby("client", sort=False):
                if who != client:
                    client, recent = who, deque()
                out += admit(part["t"].tolist(), recent, limit, span)
            yield rows.assign(admitted=out)

    ordered = requests.select("client", "id", "t").repartition("client").sortWithinPartitions("client", "t", "id")
    return ordered.mapInPandas(run, requests.select("client", "id", "t").schema.add("admitted", "boolean"))


def daily_budget(requests: DataFrame, ceiling: float) -> DataFrame:
    """Requests (day, id, ts, cost) that come before the day's spend has reached the ceiling."""
    before = Window.partitionBy("day").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum("cost").over(before), F.lit(0.0))
    return requests.withColumn("spent", F.round(spent, 6)).withColumn("admitted", spent < ceiling)
