"""Mail relations over the driver's tables: the queries run the package's operators on these.

messages <- orders, recipients <- lineitem, addresses <- customer and supplier, bodies <- documents, streams <- events,
threads <- conversations, paths <- pages. SQL has the same relations as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pk, sender, subject, date, category): every tenth customer is an owner, whose open orders are sent mail."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("pk"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("@example.org")).alias("sender"),
        F.concat(F.col("o_orderpriority"), F.lit(" "), (F.col("o_orderkey") % 97).cast("string")).alias("subject"),
        F.col("o_orderdate").alias("date"),
        F.when(F.col("o_orderstatus") == "P", "INFECTED").when((F.col("o_orderstatus") == "O") & (F.col("o_custkey") % 10 == 0), "Sent").otherwise("Archive").alias("category"),
    )


def recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pk, address, role), distinct: suppliers, and for returned parts a customer."""
    line = table(spark, sf_dir, "lineitem")
    role = F.when(F.col("l_returnflag") == "A", "to").when(F.col("l_returnflag") == "N", "cc").otherwise("bcc")
    address = F.when(F.col("l_linenumber") == 3, F.concat(F.lit("c"), (F.col("l_partkey") % 150).cast("string"), F.lit("@example.org"))).otherwise(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string"), F.lit("@example.net"))
    )
    return line.select(F.col("l_orderkey").alias("pk"), address.alias("address"), role.alias("role")).distinct()


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pk, volume, mailbox, body)."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pk"), F.col("lang").alias("volume"), F.col("source").alias("mailbox"), F.col("text").alias("body"))


def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pk, content): the text of a conversation's turns, attached to the document of its number."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("pk"), F.col("text").alias("content"))


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(container, position, own_date, path_year): messages of a container in order; errors carry no date."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("container"), F.col("event_id").alias("position"), F.when(F.col("event_type") != "error", F.col("ts")).alias("own_date"), F.lit(1999).alias("path_year")
    )


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pk, volume, path): a page's scheme and host are the volume, its path the mailbox."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("pk"), F.regexp_extract(url, "^([^:]*://[^/?#]*)", 1).alias("volume"), F.regexp_extract(url, "^[^:]*://[^/?#]*(/[^?#]*)", 1).alias("path"))


SQL = """
messages AS (
  SELECT o_orderkey AS pk, 'c' || o_custkey || '@example.org' AS sender, o_orderpriority || ' ' || (o_orderkey % 97) AS subject, o_orderdate AS date,
    CASE WHEN o_orderstatus = 'P' THEN 'INFECTED' WHEN o_orderstatus = 'O' AND o_custkey % 10 = 0 THEN 'Sent' ELSE 'Archive' END AS category
  FROM orders),
recipients AS (
  SELECT DISTINCT l_orderkey AS pk, CASE WHEN l_linenumber = 3 THEN 'c' || (l_partkey % 150) || '@example.org' ELSE 's' || l_suppkey || '@example.net' END AS address,
    CASE l_returnflag WHEN 'A' THEN 'to' WHEN 'N' THEN 'cc' ELSE 'bcc' END AS role
  FROM lineitem),
bodies AS (SELECT doc_id AS pk, lang AS volume, source AS mailbox, text AS body FROM documents),
attachments AS (SELECT conv_id AS pk, text AS content FROM conversations),
stream AS (SELECT user_id AS container, event_id AS position, CASE WHEN event_type <> 'error' THEN ts END AS own_date, 1999 AS path_year FROM events),
paths AS (SELECT page_id AS pk, regexp_extract(url, '^([^:]*://[^/?#]*)', 1) AS volume, regexp_extract(url, '^[^:]*://[^/?#]*(/[^?#]*)', 1) AS path FROM pages)
"""
