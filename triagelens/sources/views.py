"""Ticket tables derived from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Phrases that give the invented document text something to match.
PHRASES = (
    "production down since noon", "minor typo in footer",
    "we see a data breach in progress", "this is not a data breach",
    "checkout error and api failure", "font color suggestion, no rush",
    "payroll is blocked, legal deadline today", "question about my invoice",
    "extremely slow sync for multiple users", "all users affected, locked out",
    "login works fine now", "very bad <b>outage</b> see https://x.test/a?b=1",
)
# Labels dealt out by event and user number.
PRIORITIES = ("Low", "Medium", "High", "Critical", " low ", "CRITICAL", "Unspecified")
CHANNELS = ("Email", "Chat", "Phone", "Social Media", "Web", "Portal", "Fax", None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def tickets_from(events: DataFrame, documents: DataFrame) -> DataFrame:
    """One raw ticket per event, its description holding one whole document.

    ``events`` may be a stream.  The document is found by an equi-join on a computed
    key, so both sides are hash partitioned (or broadcast by AQE when small).
    """
    event, user = F.col("event_id"), F.col("user_id")
    n_docs = documents.agg(F.count(F.lit(1))).scalar()
    block = F.floor(event / F.lit(12)).cast("bigint")
    keyed = events.select(
        event, user, "event_type", "value", "ts", (event % n_docs).alias("doc_id")
    )
    # Both sides are hashed on the document: each document moves once, before it is
    # repeated per event.  The number of partitions is given because the join's output
    # is many times its input, which would make AQE merge partitions by the input size.
    # The computed key spreads events evenly, so no partition is hot.
    spark = documents.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                spark.sparkContext.defaultParallelism)
    texts = documents.select("doc_id", "text").repartition(parts, "doc_id").hint("merge")
    joined = keyed.repartition(parts, "doc_id").join(texts, "doc_id")
    return joined.select(
        F.concat(F.lit("T"), F.lpad(event.cast("string"), 8, "0")).alias("ticket_id"),
        _pick(PHRASES, event % 12).alias("ticket_subject"),
        F.concat(_pick(PHRASES, block % 12), F.lit(". "), F.col("text")).alias(
            "ticket_description"
        ),
        _pick(PRIORITIES, event % 7).alias("priority_level"),
        _pick(CHANNELS, user % 8).alias("ticket_channel"),
        F.col("event_type").alias("issue_category"),
        F.when(user % 3 == 0, F.concat(F.lit("u"), user.cast("string"), F.lit("@gmail.com")))
        .when(user % 3 == 1,
              F.concat(F.lit("u"), user.cast("string"), F.lit("@My-Corp.example.com")))
        .alias("customer_email"),
        F.when(event % 11 != 0, F.col("value")).alias("resolution_time_hours"),
        F.col("ts").alias("created_at"),
    )


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tickets_from(table(spark, sf_dir, "events"), table(spark, sf_dir, "documents"))


def conversation_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw ticket per user turn, under the other accepted column names.

    Turns are not gathered per conversation, so a very long one is no hot group.
    """
    conv, turn = F.col("conv_id"), F.col("turn")
    return table(spark, sf_dir, "conversations").filter(F.col("role") == "user").select(
        F.concat_ws("-", F.lpad(conv.cast("string"), 8, "0"), turn.cast("string")).alias("Ticket_ID"),
        F.concat(F.lit("conversation turn "), turn.cast("string")).alias(" Subject "),
        F.col("text").alias("Description"),
        _pick(PRIORITIES, (conv + turn) % 7).alias("Priority"),
        _pick(CHANNELS, conv % 8).alias("Channel"),
        F.concat(F.lit("topic "), (conv % 5).cast("string")).alias("Category"),
        F.concat(F.lit("c"), conv.cast("string"), F.lit("@desk.example.org")).alias("Email"),
        F.when(conv % 9 != 0, ((conv * 37 + turn) % 240).cast("string"))
        .otherwise(F.lit("n.a.")).alias("Resolution Time"),
    )
