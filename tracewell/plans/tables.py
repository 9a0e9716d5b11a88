"""The driver's tables in the roles that the operators need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def funds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfers ``src, dst, amount, ts, seq, status``: a customer pays a supplier, and a returned item is paid back."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_shipdate")
    customer, supplier = F.concat(F.lit("ACCOUNT|C"), F.col("o_custkey")), F.concat(F.lit("ACCOUNT|S"), F.col("l_suppkey"))
    back = F.col("l_returnflag") == "R"
    seq = ((F.col("l_orderkey").cast("long") * 8 + F.col("l_linenumber")) * 65536 + F.col("l_partkey")) * 4096 + F.col("l_suppkey")  # line numbers repeat within an order
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.when(back, supplier).otherwise(customer).alias("src"), F.when(back, customer).otherwise(supplier).alias("dst"), F.col("l_extendedprice").alias("amount"), F.col("l_shipdate").cast("timestamp_ntz").alias("ts"), seq.alias("seq"), F.col("o_orderstatus").alias("status"))


FUNDS = """
funds as (
  select case when l_returnflag = 'R' then 'ACCOUNT|S' || l_suppkey else 'ACCOUNT|C' || o_custkey end as src,
    case when l_returnflag = 'R' then 'ACCOUNT|C' || o_custkey else 'ACCOUNT|S' || l_suppkey end as dst,
    l_extendedprice as amount, cast(l_shipdate as timestamp) as ts, ((l_orderkey::bigint * 8 + l_linenumber) * 65536 + l_partkey) * 4096 + l_suppkey as seq, o_orderstatus as status
  from lineitem join orders on l_orderkey = o_orderkey)"""


def two_statements(spark: SparkSession, sf_dir: str, *dealt_by: str) -> DataFrame:
    """Each transfer as both banks record it, the second half a minute later; dealt by columns that all later steps group by, transfers are shuffled once, before they double."""
    f = funds(spark, sf_dir)
    f = f.repartition(*dealt_by) if dealt_by else f
    both = F.array(F.struct(F.col("ts"), F.col("seq")), F.struct((F.col("ts") + F.expr("interval 30 seconds")).alias("ts"), (-F.col("seq")).alias("seq")))
    return f.select("src", "dst", "amount", F.explode(both).alias("of"), "status").select("src", "dst", "amount", "of.ts", "of.seq", "status")


TWO = FUNDS + """,
two as (select * from funds union all select src, dst, amount, ts + interval 30 seconds, -seq, status from funds),
marked as (
  select *, coalesce(epoch_us(ts) // 60000000 - lag(epoch_us(ts) // 60000000) over (partition by src, dst, cast(amount as decimal(18, 2)), ts is null order by ts, seq) <= 1, false) as corroborated
  from two)"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log: ``node, ts, event_type, value, seq``."""
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("PHONE|"), F.col("user_id")).alias("node"), F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type", "value", F.col("event_id").alias("seq"), "props")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed links that the tables suggest: events as handsets, cards, addresses and devices of a user; customers as names and numbers of accounts; pages as domains."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    phone = F.concat(F.lit("PHONE|"), F.col("user_id"))
    imei = F.concat(F.lit("IMEI|"), F.col("user_id") % 40)
    ip = F.concat(F.lit("IP|49.36."), (F.col("user_id") % 7).cast("string"), F.lit("."), (F.col("event_id") % 50).cast("string"))
    parts = [
        e.filter("event_type = 'click'").select(phone.alias("src"), imei.alias("dst"), F.lit("USES_HANDSET").alias("rel")),
        e.filter("event_type = 'view'").select(F.concat(F.lit("IMSI|"), F.col("user_id")).alias("src"), imei.alias("dst"), F.lit("SIM_IN_HANDSET").alias("rel")),
        e.filter("event_type = 'click'").select(phone.alias("src"), ip.alias("dst"), F.lit("USED_IP").alias("rel")),
        e.filter("event_type = 'purchase'").select(F.concat(F.lit("UPI|u"), F.col("user_id")).alias("src"), F.concat(F.lit("DEVICE|"), F.col("user_id") % 60).alias("dst"), F.lit("USED_DEVICE").alias("rel")),
    ]
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    account = F.concat(F.lit("ACCOUNT|C"), F.col("c_custkey"))
    parts.append(c.select(F.concat(F.lit("PERSON|"), F.col("c_nationkey"), F.lit("-"), F.col("c_custkey") % 9).alias("src"), account.alias("dst"), F.lit("HOLDS").alias("rel")))
    parts.append(c.select(account.alias("src"), F.concat(F.lit("PHONE|"), F.col("c_custkey") % 150).alias("dst"), F.lit("REGISTERED_ON").alias("rel")))
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    parts.append(table(spark, sf_dir, "pages").filter("url is not null").select(F.concat(F.lit("EMAIL|p"), F.col("page_id")).alias("src"), F.concat(F.lit("DOMAIN|"), host).alias("dst"), F.lit("LINKS_TO").alias("rel")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.distinct()


LINKS = """
links as (
  select distinct src, dst, rel from (
    select 'PHONE|' || user_id as src, 'IMEI|' || user_id % 40 as dst, 'USES_HANDSET' as rel from events where event_type = 'click'
    union all select 'IMSI|' || user_id, 'IMEI|' || user_id % 40, 'SIM_IN_HANDSET' from events where event_type = 'view'
    union all select 'PHONE|' || user_id, 'IP|49.36.' || user_id % 7 || '.' || event_id % 50, 'USED_IP' from events where event_type = 'click'
    union all select 'UPI|u' || user_id, 'DEVICE|' || user_id % 60, 'USED_DEVICE' from events where event_type = 'purchase'
    union all select 'PERSON|' || c_nationkey || '-' || c_custkey % 9, 'ACCOUNT|C' || c_custkey, 'HOLDS' from customer
    union all select 'ACCOUNT|C' || c_custkey, 'PHONE|' || c_custkey % 150, 'REGISTERED_ON' from customer
    union all select 'EMAIL|p' || page_id, 'DOMAIN|' || regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), 'LINKS_TO' from pages where url is not null))"""


def identity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts that one mobile number is registered on, as pairs (account, number)."""
    return links(spark, sf_dir).filter("rel = 'REGISTERED_ON'").select("src", "dst")


# Accounts of one number are one component; numbers touch nothing else, so a component is its smallest node.
CLUSTERS = """
clusters as (
  with e as (select src, dst, min(src) over (partition by dst) as low from links where rel = 'REGISTERED_ON')
  select src as node, low as component from e union select dst, low from e)"""
