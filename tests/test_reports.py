"""Ticket selection and report operators on own sentences."""

import pytest
from pyspark.sql import functions as F

from ticketloom.operators import reports, tickets

CASES = [
    ("I was billed again and I want you to return it: the page is stuck.", "asks faulty addressed"),
    ("The order was cancelled and your app never arrived", "asks faulty addressed"),
    ("Stay away. They charge twice and never answer", "faulty warns"),
    ("Ich bitte um Klärung, es funktioniert nicht, Betrug!", "asks faulty addressed aggressive"),
    ("Dear Acme, I expect a reply", "asks addressed"),
    ("Dear Other, nothing", ""),
    ("Прошу вернуть деньги, это обман", "addressed aggressive"),
    ("All good", ""), ("", ""), (None, ""),
]


@pytest.fixture(scope="module")
def shapes(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "id int, text string")
    found = rows.select("id", *(c.alias(n) for n, c in tickets.shape(F.col("text"), "acme").items()))
    return {r["id"]: {n for n, v in r.asDict().items() if v is True and n != "id"} for r in found.collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_shape(shapes, i):
    assert shapes[i] == set(CASES[i][1].split())


def test_a_late_warning_is_no_warning(spark):
    text = "I cancelled a month ago and the amount was taken all the same, with no answer until today. Beware"
    rows = spark.createDataFrame([(text,), ("Beware: " + text,)], "text string")
    assert [r[0] for r in rows.select(tickets.shape(F.col("text"), "acme")["warns"]).collect()] == [False, True]


def test_window_and_nulls(spark):
    rows = spark.createDataFrame([("2024-01-11", 1, "x" * 120), ("2024-01-10", 1, "x" * 120), ("2024-05-01", 5, "x" * 120), (None, None, None)], "day string, score int, text string")
    got = rows.select(tickets.in_window(F.col("day"), "2025-01-10"), tickets.gradable(F.col("text"), F.col("score")), tickets.accepted(F.col("text"))).collect()
    assert [tuple(r) for r in got] == [(True, True, True), (False, True, True), (True, False, True), (False, False, False)]


def test_compatible_forms(spark):
    rows = spark.createDataFrame([("ﬁne   Ｔ１ ",), (None,)], "text string")
    assert [r["out"] for r in tickets.compatible(rows, "text", "out").collect()] == ["fine T1", ""]


def test_ticket_text(spark):
    rows = spark.createDataFrame([(" a ", "b "), ("", " b "), (None, "b"), ("a", None)], "t string, b string")
    assert [r[0] for r in rows.select(tickets.ticket_text(F.col("t"), F.col("b"))).collect()] == ["a\n\nb", " b ", "b", "a"]


def test_headline_needs_every_field(spark):
    full = spark.createDataFrame([("x", "x")] * 20, "gold string, pred string")
    few = full.limit(3)
    assert reports.headline({"a": full, "b": full}).first()[0] == 1.0
    assert reports.headline({"a": full, "b": few}).first()[0] is None


def test_clip_and_logprobs(spark):
    rows = spark.createDataFrame([("a |  b\n c", [-1.0, None, -3.0]), (None, []), ("x", None)], "t string, p array<double>")
    mean, least = reports.logprob_summary(F.col("p"))
    got = [tuple(r) for r in rows.select(reports.clip(F.col("t"), 5), mean, least).collect()]
    assert got == [("a \\| b", -2.0, -3.0), ("", None, None), ("x", None, None)]


def test_run_delta_of_a_new_cell(spark):
    runs = spark.createDataFrame([("1", "a", 0.1), ("2", "a", 0.5), ("3", "a", 0.7), ("3", "b", 0.2)], "stamp string, cell string, v double")
    got = {r["cell"]: (r["before"], r["after"], r["delta"]) for r in reports.run_delta(runs, "stamp", ["cell"], "v").collect()}
    assert got == {"a": (0.5, 0.7, 0.2), "b": (None, 0.2, None)}
