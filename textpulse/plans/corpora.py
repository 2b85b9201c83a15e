"""Adapters that present the shared tables as grouped, dated corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textpulse.session import spread
from textpulse.sources.items import LIST_KIND


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def doc_day():
    """``documents`` has no date: a fixed rule gives each one of 30 days."""
    return F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") * 7919 % 1009 % 30).cast("int"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """C1 with texts: doc_id, grp (source), day, text."""
    docs = table(spark, folder, "documents").select("doc_id", F.col("source").alias("grp"), doc_day().alias("day"), "text")
    return spread(docs, "doc_id")


def document_keys(spark: SparkSession, folder: str) -> DataFrame:
    """C1 without texts, for denominators: the scan reads two narrow columns."""
    return table(spark, folder, "documents").select("doc_id", F.col("source").alias("grp"), doc_day().alias("day"))


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id (conversation and turn), grp (role), text."""
    turns = table(spark, folder, "conversations")
    return spread(turns.select(F.concat_ws("-", "conv_id", "turn").alias("doc_id"), F.col("role").alias("grp"), "text"), "doc_id")


def monthly_words(spark: SparkSession, folder: str) -> DataFrame:
    """Per (month, region), the share of line items whose part name holds the word, dense over all three.

    Line items are counted per (month, region, part name) before names are split into words.
    """
    nations = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    suppliers = table(spark, folder, "supplier").join(
        nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "r_name")
    lines = table(spark, folder, "lineitem").select(
        "l_partkey", "l_suppkey", F.to_date(F.date_trunc("month", F.col("l_shipdate").cast("timestamp"))).alias("day"))
    parts = table(spark, folder, "part").select("p_partkey", "p_name")
    counted = (
        lines.join(suppliers, lines.l_suppkey == suppliers.s_suppkey).join(parts, lines.l_partkey == parts.p_partkey)
        .groupBy("day", F.col("r_name").alias("grp"), "p_name").agg(F.count("*").alias("n"))
    )
    cells = counted.groupBy("day", "grp").agg(F.sum("n").alias("n_cell"))
    words = counted.select("day", "grp", "n", F.explode(F.array_distinct(F.split("p_name", " "))).alias("term"))
    words = words.groupBy("day", "grp", "term").agg(F.sum("n").alias("n_word"))
    vocab = words.agg(F.collect_set("term")).scalar()  # the words that part names are made of: a fixed small list
    days = cells.agg(F.collect_set("day")).scalar()
    frame = cells.select("grp").distinct().select("grp", F.explode(days).alias("day")).join(
        cells, ["day", "grp"], "left").select("day", "grp", "n_cell", F.explode(vocab).alias("term"))
    return frame.join(words, ["day", "grp", "term"], "left").select(
        "day", "grp", "term", (F.coalesce("n_word", F.lit(0)) / F.col("n_cell")).alias("mean_prop"))


def item_documents(spark: SparkSession, folder: str) -> DataFrame:
    """C1 as item documents in JSON text: both shapes, some without a playlist title, every text whole.

    The first line of a text is the title and the rest the description.
    """
    docs = documents(spark, folder)
    title = F.split_part("text", F.lit("\n"), F.lit(1))
    snippet = F.struct(
        F.col("grp").alias("channelId"), title.alias("title"),
        F.expr("substring(text, length(split_part(text, '\\n', 1)) + 2)").alias("description"),
        F.date_format(F.col("day").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt"))
    entry = F.struct(F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("id"), snippet.alias("snippet"))
    listed = F.col("doc_id") % 2 == 0
    playlist = F.struct(F.when(F.col("doc_id") % 3 != 0, F.struct(
        F.concat(F.lit("list "), F.col("grp")).alias("title"))).alias("snippet"))
    return docs.select("doc_id", F.to_json(F.struct(
        F.when(listed, F.lit(LIST_KIND)).otherwise(F.lit("playlistItem")).alias("kind"),
        F.when(~listed, entry["id"]).alias("id"),
        F.when(~listed, entry["snippet"]).alias("snippet"),
        F.when(listed, F.array(entry)).alias("items"),
        playlist.alias("playlist"))).alias("json"))
