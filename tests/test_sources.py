"""Readers and writers on small files."""

import base64
import json

import numpy as np

from ticketloom.sources import io


def dump(path, data):
    path.write_text(json.dumps(data), encoding="utf-8")


def test_corpus(spark, tmp_path):
    (tmp_path / "as").mkdir()
    (tmp_path / "gp").mkdir()
    review = {"id": "1", "rating": 1, "title": "", "text": "x" * 150, "date": "2026-01-02T03:04:05Z", "is_edited": False, "reply": "Write to Support@Example.com", "reply_date": "2026-01-02T04:04:05Z"}
    dump(tmp_path / "as/ec.json", {"store": "appstore", "reviews": [review, {**review, "id": "2", "text": "y" * 149, "reply": "", "reply_date": "never", "rating": 5}]})
    play = {"reviewId": "0123456789abXX", "score": 2, "content": "z", "reply": "mail other@else.org", "at": "2026-01-01 00:00:00", "repliedAt": "None", "version": None, "thumbsUp": 3}
    dump(tmp_path / "gp/a.json", {"lang": "sr", "country": "rs", "sampled_with_filter": 1, "reviews": [{**play, "content": "sampled"}]})
    dump(tmp_path / "gp/b.json", {"lang": "sr", "country": "rs", "reviews": [play]})
    rows = io.read_app_store(spark, str(tmp_path / "as")).unionByName(io.read_play(spark, str(tmp_path / "gp")))
    got = {r["uid"]: r for r in io.corpus(rows, since="2026-01-01").collect()}
    assert set(got) == {"as:1", "as:2", "gp:0123456789ab"}
    one, two, three = got["as:1"], got["as:2"], got["gp:0123456789ab"]
    assert (one["locale"], one["reply_latency_sec"], one["usable_as_ticket"], one["is_complaint"]) == ("-/ec", 3600, True, True)
    assert (one["reply_channel"], one["reply_channel_valid"]) == ("support@example.com", True)
    assert (two["usable_as_ticket"], two["reply_channel"], two["reply_channel_valid"], two["reply_latency_sec"]) == (False, None, None, None)
    assert (three["text"], three["reply_date"], three["reply_channel_valid"]) == ("z", None, False)


def test_tickets_round_trip(spark, tmp_path):
    rows = [("1", 'say "hi"; now', "дві\nлінії")]
    io.write_tickets(spark.createDataFrame(rows, "id string, a string, b string"), str(tmp_path / "t"))
    assert [tuple(r) for r in io.read_tickets(spark, str(tmp_path / "t")).collect()] == rows
    (tmp_path / "bom.csv").write_bytes("﻿id;x\n1;2\n".encode())
    assert io.read_tickets(spark, str(tmp_path / "bom.csv")).columns == ["id", "x"]


def test_vectors_and_coverage(spark, tmp_path):
    v = np.arange(6, dtype="<f4").reshape(2, 3)
    dump(tmp_path / "v.json", {"model": "m", "variant": "a", "dims": 3, "count": 2, "fingerprint": "f", "ids": ["p", "q"], "vectors_b64": base64.b64encode(v.tobytes()).decode()})
    got = io.read_vectors(spark, str(tmp_path / "v.json")).orderBy("pos").collect()
    assert [(r["id"], r["embedding"]) for r in got] == [("p", [0, 1, 2]), ("q", [3, 4, 5])]
    dump(tmp_path / "c.json", {"ec": 3, "zz": -1, "aa": 0})
    assert tuple(io.coverage_report(io.read_coverage(spark, str(tmp_path / "c.json"))).first()) == (1, 1, 1)


def test_knowledge_and_upsert(spark, tmp_path):
    a = {"id": "7", "title": "t", "body": "b", "url": ""}
    dump(tmp_path / "h.json", {"articles": [{**a, "url": "https://x/7"}]})
    dump(tmp_path / "f.json", {"url": "https://x/faq", "articles": [a]})
    dump(tmp_path / "p.json", {"articles": [a]})
    got = {r["id"]: r["url"] for r in io.read_knowledge(spark, *(str(tmp_path / f"{x}.json") for x in "hfp")).collect()}
    assert got == {"hc-7": "https://x/7", "faq-7": "https://x/faq", "pol-7": ""}
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(tuple(r) for r in io.upsert(old, new, "k").collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_run_header(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"kind": "header", "model": "m"}\n{"id": "1", "ok": true}\n')
    records, header = io.read_run(spark, str(tmp_path / "r.jsonl"), "id string, ok boolean")
    assert records.count() == 1 and header.first()["model"] == "m"


def test_partitions_that_exist_stay(spark, tmp_path):
    path = str(tmp_path / "parts")
    make = lambda rows: spark.createDataFrame(rows, "id int, locale string")
    io.write_partitions(make([(1, "a"), (2, "b")]), path)
    io.write_partitions(make([(3, "a"), (4, "c")]), path)
    assert sorted((r["id"], r["locale"]) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "b"), (4, "c")]
    io.write_partitions(make([(5, "a")]), path, force=True)
    assert sorted((r["id"], r["locale"]) for r in spark.read.parquet(path).collect()) == [(2, "b"), (4, "c"), (5, "a")]
    old, new = make([(1, "x")]), spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "id int, locale string, at int")
    assert [r["locale"] for r in io.upsert(old.selectExpr("*", "0 as at"), new, "id", "at").collect()] == ["z"]
