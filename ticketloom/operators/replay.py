"""Model calls as tables: replayed predictions, capabilities, usage and checks of drafts."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.functions.text import flatten

BACKOFF_CAP, RETRY_CAP = 30, 60


def predict(tickets: DataFrame, predictions: DataFrame, key: str = "id") -> DataFrame:
    """Tickets with their recorded prediction; a missing one is a null answer, not a lost row."""
    return tickets.join(predictions, key, "left")


def capabilities(endpoints: DataFrame, model: str, params: str) -> DataFrame:
    """Parameters that all endpoints of a model support, and that any does."""
    listed = endpoints.select(model, "endpoint", F.explode(params).alias("p")).distinct()
    total = endpoints.groupBy(model).agg(F.countDistinct("endpoint").alias("n"))
    counts = listed.groupBy(model, "p").agg(F.count("*").alias("c")).join(total, model)
    return counts.groupBy(model).agg(F.array_sort(F.collect_list(F.when(F.col("c") == F.col("n"), F.col("p")))).alias("all"), F.array_sort(F.collect_list("p")).alias("any"))


def dropped(wanted: Column, supported: Column) -> Column:
    """Parameters to leave out; unknown support (null) drops none."""
    return F.when(supported.isNull(), F.array().cast("array<string>")).otherwise(F.array_except(wanted, supported))


def backoff(attempt: Column, retry_after: Column) -> Column:
    """Seconds to wait: what the server asks for, capped, or a power of two, capped."""
    return F.when(retry_after.isNotNull(), F.least(retry_after, F.lit(RETRY_CAP))).otherwise(F.least(F.pow(F.lit(2.0), attempt), F.lit(BACKOFF_CAP)))


def citation_ok(quote: Column, body: Column, cited: Column, retrieved: Column) -> Column:
    """A quote counts if it is not empty, its document was retrieved and holds it, white space and case aside."""
    held = F.contains(flatten(body), flatten(quote))
    return (F.trim(quote) != "") & body.isNotNull() & F.array_contains(retrieved, cited) & F.coalesce(held, F.lit(False))


def answer_language(lang: Column, substitutes: dict[str, str]) -> Column:
    table = F.create_map(*(F.lit(x) for pair in substitutes.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(lang))), F.trim(lang))


def cell(value: Column, digits: int = 3, missing: str = "н/д") -> Column:
    """A number with a decimal comma, rounded by its exact binary value as C's printf does; a mark where there is none.

    Java's formatter rounds the shortest decimal form half up instead, which differs on ties.
    """
    special = F.when(F.isnan(value), "nan").when(value == float("inf"), "inf").when(value == float("-inf"), "-inf")
    plain = F.call_function("format_number", value, F.lit("0." + "0" * digits if digits else "0"))
    return F.when(value.isNull(), missing).otherwise(F.coalesce(special, F.translate(plain, ".", ",")))


def mean_in_order(value: Column, *order: Column) -> Column:
    """An aggregate: the mean of the values that are not null, summed up in the order given, so that its last bits are
    always the same; avg() adds up partial sums in the order in which tasks end. Gathers a group's values."""
    rows = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(*(c.alias(f"k{i}") for i, c in enumerate(order)), value.alias("v")))))
    return F.when(F.size(rows) > 0, F.aggregate(rows, F.lit(0.0), lambda acc, x: acc + x["v"]) / F.size(rows))


def similarity(rows: DataFrame, first: str, second: str) -> DataFrame:
    """The sequence ratio of two texts of each row."""

    @F.pandas_udf("double")
    def ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])

    return rows.withColumn("ratio", ratio(first, second))
