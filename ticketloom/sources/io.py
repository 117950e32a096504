"""Readers and writers of the review, ticket, run and knowledge formats, with explicit schemas."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

APP_STORE = "store string, country string, fetched_at string, count int, with_reply int, reviews array<struct<id string, rating int, title string, text string, date string, is_edited boolean, reply string, reply_date string>>"
PLAY = "store string, lang string, country string, fetched_at string, count int, sampled_with_filter int, reviews array<struct<reviewId string, score int, content string, reply string, at string, repliedAt string, version string, thumbsUp int>>"
ALLOWED_CHANNELS = ("support@example.com",)
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def _stem() -> Column:
    return F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)


def _seconds(later: Column, earlier: Column) -> Column:
    return F.unix_timestamp(F.try_to_timestamp(later)) - F.unix_timestamp(F.try_to_timestamp(earlier))


def read_app_store(spark: SparkSession, path: str) -> DataFrame:
    """One row per review of a directory of country dumps; a missing country is the file's name."""
    dumps = spark.read.schema(APP_STORE).json(path, multiLine=True).withColumn("file", _stem())
    rows = dumps.select("file", F.coalesce("country", "file").alias("cc"), F.posexplode("reviews").alias("pos", "r"))
    return rows.select(
        F.concat(F.lit("as:"), "r.id").alias("uid"), F.lit("appstore").alias("store"), F.concat(F.lit("-/"), "cc").alias("locale"), F.col("r.rating").alias("score"),
        F.nullif("r.title", F.lit("")).alias("title"), "r.text", F.nullif(F.substring("r.date", 1, 10), F.lit("")).alias("date"), F.lit(None).cast("string").alias("app_version"), F.lit(0).alias("thumbs_up"),
        F.nullif("r.reply", F.lit("")).alias("official_reply"), F.nullif(F.substring("r.reply_date", 1, 10), F.lit("")).alias("reply_date"), _seconds(F.col("r.reply_date"), F.col("r.date")).alias("reply_latency_sec"),
        F.lit(None).cast("int").alias("sampled_with_filter"), F.struct(F.lit(0).alias("store"), F.lit(False).alias("sampled"), "file", "pos").alias("read_order"),
    )


def read_play(spark: SparkSession, path: str) -> DataFrame:
    """One row per review of a directory of language dumps; the string None is null, sampled pulls come last."""
    dumps = spark.read.schema(PLAY).json(path, multiLine=True).withColumn("file", _stem())
    rows = dumps.select("file", "lang", "country", "sampled_with_filter", F.posexplode("reviews").alias("pos", "r"))
    replied = F.nullif("r.repliedAt", F.lit("None"))
    return rows.select(
        F.concat(F.lit("gp:"), F.substring("r.reviewId", 1, 12)).alias("uid"), F.lit("googleplay").alias("store"), F.concat_ws("/", "lang", "country").alias("locale"), "r.score",
        F.lit(None).cast("string").alias("title"), F.col("r.content").alias("text"), F.nullif(F.substring("r.at", 1, 10), F.lit("")).alias("date"), F.col("r.version").alias("app_version"), F.coalesce("r.thumbsUp", F.lit(0)).alias("thumbs_up"),
        F.nullif("r.reply", F.lit("")).alias("official_reply"), F.nullif(F.substring(replied, 1, 10), F.lit("")).alias("reply_date"), _seconds(replied, F.col("r.at")).alias("reply_latency_sec"),
        "sampled_with_filter", F.struct(F.lit(1).alias("store"), F.col("sampled_with_filter").isNotNull().alias("sampled"), "file", "pos").alias("read_order"),
    )


def corpus(reviews: DataFrame, since: str | None = None, channels: tuple[str, ...] = ALLOWED_CHANNELS) -> DataFrame:
    """The corpus: filtered by date, one row per uid (the first read), with derived columns."""
    from ticketloom.operators.corpus import keep_first

    rows = reviews.filter(F.col("date") >= since) if since else reviews
    rows = keep_first(rows, ["uid"], ["read_order"])
    channel = F.lower(F.nullif(F.regexp_extract("official_reply", EMAIL, 0), F.lit("")))
    return rows.withColumns({"chars": F.length("text"), "is_complaint": F.col("score") <= 2, "usable_as_ticket": F.length("text") >= 150, "reply_channel": channel, "reply_channel_valid": channel.isin(*channels)}).drop("read_order")


def read_tickets(spark: SparkSession, path: str) -> DataFrame:
    """A semicolon table with a header; a byte order mark before the first name goes."""
    rows = spark.read.csv(path, sep=";", header=True, multiLine=True, escape='"')
    return rows.withColumnRenamed(rows.columns[0], rows.columns[0].lstrip("﻿"))


def write_tickets(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, sep=";", header=True, quoteAll=True, escape='"')


def read_run(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Records and header of a run file: the header has ``kind``."""
    rows = spark.read.schema("kind string, " + schema).json(path)
    return rows.filter("kind IS NULL").drop("kind"), spark.read.json(path).filter("kind = 'header'")


def read_coverage(spark: SparkSession, path: str) -> DataFrame:
    """key and n of a JSON map; -1 is a missing storefront, 0 an empty one."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string, int>")).alias("key", "n")).orderBy("key")


def coverage_report(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(F.col("n") > 0).alias("live"), F.count_if(F.col("n") == 0).alias("empty"), F.count_if(F.col("n") < 0).alias("missing"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """id, pos and embedding of a packed block of little-endian 32-bit floats."""
    @F.pandas_udf("array<array<float>>")
    def unpack(blobs: pd.Series, dims: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(b, "<f4").reshape(-1, d).tolist() for b, d in zip(blobs, dims, strict=True)])

    block = spark.read.schema("model string, variant string, dims int, count int, fingerprint string, ids array<string>, vectors_b64 string").json(path, multiLine=True)
    both = block.select("model", "variant", "fingerprint", "ids", unpack(F.unbase64("vectors_b64"), "dims").alias("v"))
    return both.select("model", "variant", "fingerprint", F.posexplode(F.arrays_zip("ids", "v")).alias("pos", "x")).select("model", "variant", "fingerprint", "pos", F.col("x.ids").alias("id"), F.col("x.v").alias("embedding"))


def read_knowledge(spark: SparkSession, help_centre: str, faq: str, policies: str) -> DataFrame:
    """Three sources as one table of documents; a FAQ entry inherits its page's address."""
    article = "id string, category string, section string, title string, body string, url string, updated_at string"
    hc = spark.read.schema(f"articles array<struct<{article.replace(' string', ': string')}>>").json(help_centre, multiLine=True).select(F.lit("hc").alias("source"), F.lit("").alias("page"), F.explode("articles").alias("a"))
    fq = spark.read.schema(f"url string, articles array<struct<{article.replace(' string', ': string')}>>").json(faq, multiLine=True).select(F.lit("faq").alias("source"), F.col("url").alias("page"), F.explode("articles").alias("a"))
    po = spark.read.schema(f"articles array<struct<{article.replace(' string', ': string')}>>").json(policies, multiLine=True).select(F.lit("pol").alias("source"), F.lit("").alias("page"), F.explode("articles").alias("a"))
    rows = hc.unionByName(fq).unionByName(po)
    return rows.select(F.concat_ws("-", "source", "a.id").alias("id"), "source", "a.title", "a.body", "a.category", "a.section", F.coalesce(F.nullif("a.url", F.lit("")), "page").alias("url"), "a.updated_at")


def upsert(ledger: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Rows with a known key are replaced, others appended; of new rows with one key the last in ``order`` wins."""
    if order:
        new = new.groupBy(key).agg(F.max_by(F.struct(*new.columns), order).alias("loom_last")).select("loom_last.*")
    return ledger.join(new, key, "left_anti").unionByName(new)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def write_partitions(rows: DataFrame, path: str, by: str = "locale", force: bool = False) -> None:
    """One folder for each value of ``by``; values that are there already stay as they are, unless ``force`` replaces them."""
    spark = rows.sparkSession
    writer = rows
    if exists(spark, path) and not force:
        known = spark.read.parquet(path).select(F.col(by).cast("string").alias("loom_by")).distinct()
        writer = rows.join(known, F.col(by).cast("string").eqNullSafe(F.col("loom_by")), "left_anti")
    mode = "overwrite" if force else "append"
    writer.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
